"""JSON values as Python values: text forms, equality, paths."""

from __future__ import annotations

import json
import math
import re
from typing import Any

from .errors import EvalError


class _Missing:
    """The value of a path that does not exist; not the same as null."""

    def __repr__(self) -> str:
        return "MISSING"

    def __reduce__(self):
        return "MISSING"

    def __bool__(self) -> bool:
        return False


MISSING = _Missing()
INT = re.compile(r"[+-]?[0-9]+", re.ASCII)
FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", re.ASCII)
I64 = (-(2**63), 2**63 - 1)


def is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def float_text(x: float) -> str:
    """Shortest digits; 1e21 and 1e-7 for large and small ones."""
    s = repr(x)
    if "e" in s:
        head, tail = s.split("e")
        return f"{head}e{int(tail)}"
    return s


def dumps(x: Any) -> str:
    """Compact JSON with sorted keys; an integer and an integral float stay apart."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dumps(v)}" for k, v in sorted(x.items())) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(dumps, x)) + "]"
    if isinstance(x, float):
        return float_text(x)
    return json.dumps(x, ensure_ascii=False)


def text(x: Any, version: int, path: str = "") -> str:
    """A scalar as text; version 1 drops the fraction of an integral float."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, str):
        return x
    if isinstance(x, int):
        return str(x)
    if isinstance(x, float):
        return (str(int(x)) if x.is_integer() else float_text(x)) if version == 1 else float_text(x)
    raise EvalError("ExprError", "value must be string/number/bool", path)


def strictly_equal(a: Any, b: Any) -> bool:
    """Equality of JSON values, in which 1 and 1.0 differ; missing equals null."""
    a, b = None if a is MISSING else a, None if b is MISSING else b
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(strictly_equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list):
        return len(a) == len(b) and all(map(strictly_equal, a, b))
    return a == b


def parse_number(s: str) -> float | None:
    if FLOAT.fullmatch(s):
        return float(s)
    if s.lower().lstrip("+-") in ("inf", "infinity", "nan") and s[:2] not in ("++", "--", "+-", "-+"):
        return float(s)
    return None


def to_float(x: Any, finite: bool = True) -> float | None:
    """Numbers and numeric strings; None for others."""
    y = float(x) if is_number(x) else parse_number(x) if isinstance(x, str) else None
    return None if y is None or finite and not math.isfinite(y) else y


def to_int(x: Any) -> int | None:
    """Integers, integral floats and integer strings within 64 bits."""
    if isinstance(x, bool):
        return None
    if isinstance(x, int):
        y = x
    elif isinstance(x, float):
        if not x.is_integer():
            return None
        y = int(x)
    elif isinstance(x, str) and INT.fullmatch(x):
        y = int(x)
    else:
        return None
    return y if I64[0] <= y <= I64[1] else None


def plain(x: float, path: str = "") -> int | float:
    """A version 1 result: an integral float is an integer."""
    if not math.isfinite(x):
        raise EvalError("ExprError", "number result is not finite", path)
    return max(I64[0], min(I64[1], int(x))) if x.is_integer() else x


def cast(x: Any, kind: str, path: str = "") -> Any:
    """The declared type of a mapping; null stays."""
    if x is None:
        return None
    out: Any = None
    if kind == "string":
        out = text(x, 1) if isinstance(x, (str, bool, int, float)) else None
    elif kind == "int":
        out = to_int(x)
    elif kind == "float":
        out = to_float(x)
    elif kind == "bool":
        out = x if isinstance(x, bool) else {"true": True, "false": False}.get(x.lower()) if isinstance(x, str) else None
    if out is None:
        raise EvalError("TypeCastFailed", f"value cannot be cast to {kind}", path)
    return out


def get_path(x: Any, path: tuple) -> Any:
    for k in path:
        if isinstance(k, int):
            if not isinstance(x, list) or k >= len(x):
                return MISSING
            x = x[k]
        else:
            if not isinstance(x, dict) or k not in x:
                return MISSING
            x = x[k]
    return x


def set_path(out: dict, path: tuple, value: Any, where: str = "") -> None:
    """Write at a path of keys, in a copy-on-write manner for the objects on the way."""
    for k in path[:-1]:
        nxt = out.get(k)
        if nxt is None and k not in out:
            nxt = out[k] = {}
        elif not isinstance(nxt, dict):
            raise EvalError("InvalidTarget", "target path conflicts with a value that is not an object", where)
        else:
            nxt = out[k] = dict(nxt)
        out = nxt
    out[path[-1]] = value


def deep_merge(a: dict, b: dict) -> dict:
    """Objects merge recursively, anything else of ``b`` replaces."""
    out = dict(a)
    for k, v in b.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
