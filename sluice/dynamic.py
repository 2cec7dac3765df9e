"""The record evaluator: any rule on any JSON value, one record at a time.

The columnar compiler covers what has a static type; this covers the rest, in
Arrow batches on the executors. Both read the same plan.
"""

from __future__ import annotations

import functools
import math
import re
from datetime import UTC
from typing import Any, NamedTuple

from .errors import EvalError
from .functions import dates
from .plans import ops
from .plans.ast import All, AnyOf, Assert, Branch, Call, Compare, Finalize, If, Let, Lit, Mapping, Mappings, MapStep, Pipe, RecordWhen, Ref, Rule, Truth
from .plans.parse import Fault, path_tokens
from .values import MISSING, cast, deep_merge, dumps, get_path, is_number, plain, set_path, strictly_equal, text, to_float, to_int


class Env(NamedTuple):
    input: Any
    context: Any = MISSING
    out: Any = None
    pipe: Any = MISSING
    item: Any = MISSING
    index: Any = MISSING
    acc: Any = MISSING
    names: dict = {}
    path: str = ""


def fail(env: Env, message: str, kind: str = "ExprError") -> EvalError:
    return EvalError(kind, message, env.path)


@functools.lru_cache(512)
def regex(pattern: str) -> re.Pattern:
    """Patterns of the linear-time dialect: no look-around and no back-references."""
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    return re.compile(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern))


def evaluate(e: Any, env: Env) -> Any:
    if isinstance(e, Lit):
        return e.value
    if isinstance(e, Ref):
        if e.ns == "pipe":
            return env.pipe
        if e.ns == "local":
            if e.name not in env.names:
                raise fail(env, f"undefined variable: @{e.name}")
            return get_path(env.names[e.name], e.path) if e.path else env.names[e.name]
        base = getattr(env, e.ns)
        return base if base is MISSING else get_path(base, e.path)
    if isinstance(e, Pipe):
        return steps(e.steps, env._replace(pipe=evaluate(e.start, env)))
    if isinstance(e, Call):
        return call(e, env, env.pipe if e.subject is None else evaluate(e.subject, env))
    if isinstance(e, (All, AnyOf, Compare, Truth)):
        return holds(e, env)
    raise fail(env, f"cannot evaluate {type(e).__name__}")


def steps(items: tuple, env: Env) -> Any:
    for s in items:
        if isinstance(s, Call):
            value = call(s, env, env.pipe)
        elif isinstance(s, Let):
            for name, x in s.bindings:
                env = env._replace(names=env.names | {name: evaluate(x, env)})
            continue
        elif isinstance(s, If):
            if holds(s.cond, env):
                value = evaluate(s.then, env)
            elif s.other is not None:
                value = evaluate(s.other, env)
            else:
                continue
        elif isinstance(s, MapStep):
            if env.pipe is MISSING:
                value = MISSING
            elif not isinstance(env.pipe, list):
                raise fail(env, "map step requires array")
            else:
                got = [steps(s.steps, env._replace(pipe=x, item=x, index=i)) for i, x in enumerate(env.pipe)]
                value = [x for x in got if x is not MISSING]
        else:
            value = evaluate(s, env)
        env = env._replace(pipe=value)
    return env.pipe


# conditions


def holds(c: Any, env: Env) -> bool:
    if isinstance(c, All):
        return all(holds(x, env) for x in c.conds)
    if isinstance(c, AnyOf):
        return any(holds(x, env) for x in c.conds)
    if isinstance(c, Compare):
        a, b = evaluate(c.left, env), evaluate(c.right, env)
        if c.op in ("eq", "ne"):
            return strictly_equal(a, b) == (c.op == "eq")
        if c.op == "match":
            return matches(a, b, env)
        x, y = to_float(a, False), to_float(b, False)
        if x is None or y is None:
            if not (isinstance(a, str) and isinstance(b, str)):
                raise fail(env, "comparison requires two numbers or two strings")
            x, y = a.encode(), b.encode()
        elif math.isnan(x) or math.isnan(y):
            x = y = 0.0
        return {"gt": x > y, "gte": x >= y, "lt": x < y, "lte": x <= y}[c.op]
    v = evaluate(c.expr, env)
    if v is MISSING and c.version == 2:
        return False
    if not isinstance(v, bool):
        raise fail(env, "condition must evaluate to boolean")
    return v


def matches(a: Any, b: Any, env: Env) -> bool:
    if not isinstance(a, str) or not isinstance(b, str):
        raise fail(env, "match requires strings")
    try:
        return regex(b).search(a) is not None
    except (re.error, ValueError) as x:
        raise fail(env, f"invalid regex: {x}") from x


# operations


def number(x: Any, env: Env, finite: bool = True) -> float:
    y = to_float(x, finite)
    if y is None:
        raise fail(env, "operand must be a number or numeric string")
    return y


def integer(x: Any, env: Env) -> int:
    y = to_int(x)
    if y is None:
        raise fail(env, "value must be an integer")
    return y


def string(x: Any, env: Env) -> str:
    if not isinstance(x, str):
        raise fail(env, "value must be a string")
    return x


def array(x: Any, env: Env) -> list:
    """Missing and null count as an empty array."""
    if x is MISSING or x is None:
        return []
    if not isinstance(x, list):
        raise fail(env, "expr arg must be array")
    return x


def obj(x: Any, env: Env) -> dict:
    if not isinstance(x, dict):
        raise fail(env, "expr arg must be object")
    return x


def nullable(x: Any) -> Any:
    return None if x is MISSING else x


def loose(x: Any, env: Env) -> Any:
    """The form in which pipes compare: text of scalars, null apart."""
    if x is None or x is MISSING:
        return None
    return text(x, 1, env.path)


def key(x: Any, env: Env) -> str:
    if x is None or x is MISSING:
        raise fail(env, "key must not be null")
    return text(x, 1, env.path)


def true(x: Any, env: Env) -> bool:
    if x is MISSING or x is None:
        return False
    if not isinstance(x, bool):
        raise fail(env, "predicate must be boolean")
    return x


def per_item(e: Any, items: list, env: Env) -> list:
    return [evaluate(e, env._replace(item=x, index=i, pipe=x)) for i, x in enumerate(items)]


def paths(values: list, env: Env) -> list[tuple]:
    flat: list = []
    for v in values:
        flat += v if isinstance(v, list) else [v]
    out: list[tuple] = []
    for v in flat:
        try:
            p = path_tokens(string(v, env))
        except Fault as x:
            raise fail(env, x.message) from x
        if p not in out:
            if any(p[: len(q)] == q or q[: len(p)] == p for q in out):
                raise fail(env, "paths conflict")
            out.append(p)
    return out


def bounds(start: int, end: int | None, n: int) -> tuple[int, int]:
    s = max(0, start + n) if start < 0 else min(start, n)
    e = n if end is None else max(0, end + n) if end < 0 else min(end, n)
    return s, max(s, e)


def flatten(x: list, depth: int) -> list:
    while depth > 0 and any(isinstance(v, list) for v in x):
        x = [w for v in x for w in (v if isinstance(v, list) else [v])]
        depth -= 1
    return x


def half_away(x: float, scale: int) -> float:
    f = 10.0**scale
    y = x * f
    return math.copysign(math.floor(abs(y) + 0.5), y) / f if math.isfinite(y) else x


def to_base(n: int, base: int) -> str:
    digits, m = "", abs(n)
    while m or not digits:
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[m % base] + digits
        m //= base
    return "-" * (n < 0) + digits


def replacement(s: str) -> str:
    """``$1``, ``$name`` and ``${name}`` as Python's form; ``$$`` is a dollar."""
    def one(m: re.Match) -> str:
        name = m[1] or m[2]
        return "$" if m[0] == "$$" else f"\\g<{name}>"

    return re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)", one, s.replace("\\", r"\\"))


def _picked(x: Any, ps: list[tuple]) -> Any:
    out: Any = {}
    for p in ps:
        v = get_path(x, p)
        if v is MISSING:
            continue
        at = out
        for k, nxt in zip(p, (*p[1:], None), strict=True):
            fresh = v if nxt is None else [] if isinstance(nxt, int) else {}
            if isinstance(k, int):
                at.extend([None] * (k + 1 - len(at)))
                if at[k] is None:
                    at[k] = fresh
            elif k not in at:
                at[k] = fresh
            at = at[k]
    return out


def _omitted(x: Any, p: tuple) -> Any:
    if len(p) == 1:
        return {k: v for k, v in x.items() if k != p[0]} if isinstance(x, dict) else x
    if isinstance(p[0], int):
        return [_omitted(v, p[1:]) if i == p[0] else v for i, v in enumerate(x)] if isinstance(x, list) else x
    return {k: _omitted(v, p[1:]) if k == p[0] else v for k, v in x.items()} if isinstance(x, dict) else x


def _flat(x: dict, before: str, env: Env) -> dict:
    out = {}
    for k, v in x.items():
        if not k or "[" in k or "]" in k:
            raise fail(env, "object key cannot be a path")
        name = '["' + k.replace("\\", "\\\\").replace('"', '\\"') + '"]' if "." in k else k
        at = before + ("." if before and not name.startswith("[") else "") + name
        if isinstance(v, dict) and v:
            out |= _flat(v, at, env)
        else:
            out[at] = v
    return out


def lookup(e: Call, env: Env, subject: Any) -> Any:
    first, n = e.op == "lookup_first", len(e.args)
    if e.version == 1:
        args = [evaluate(a, env) for a in e.args]
        items, (k, want, *get) = subject, args
        if items is MISSING:
            return MISSING
        if not isinstance(items, list):
            raise fail(env, "lookup needs an array")
        if want is MISSING:
            return MISSING
        if want is None:
            raise fail(env, "lookup match must not be null")
        kp, gp, want = path_tokens(string(k, env)), path_tokens(string(get[0], env)) if get else (), text(want, 1, env.path)
        out = []
        for x in items:
            v = get_path(x, kp)
            if isinstance(v, (str, int, float)) and text(v, 1) == want:
                got = get_path(x, gp) if gp else x
                if got is not MISSING:
                    if first:
                        return got
                    out.append(got)
        return out or MISSING
    args = [evaluate(a, env) for a in e.args]
    if n == 4 or n == 3 and (isinstance(args[0], list) or args[0] is MISSING and env.pipe is not MISSING):
        items, k, want, *get = args
    else:
        items, (k, want, *get) = subject, args
    if items is MISSING:
        return MISSING if first else []
    if not isinstance(items, list):
        raise fail(env, "lookup needs an array")
    string(k, env)
    if get:
        string(get[0], env)
    found = [x for x in items if isinstance(x, dict) and k in x and strictly_equal(x[k], want)]
    if first:
        return MISSING if not found else found[0].get(get[0], MISSING) if get else found[0]
    return [x[get[0]] for x in found if get[0] in x] if get else found


def _zone(x: Any, env: Env):
    z = dates.offset(string(x, env))
    if z is None:
        raise fail(env, "timezone must be UTC or an offset")
    return z


def _formats(x: Any, env: Env) -> list[str]:
    out = x if isinstance(x, list) else [x]
    if not out or not all(isinstance(f, str) and f for f in out):
        raise fail(env, "input_format must not be empty")
    return out


def _date(x: Any, formats: list[str] | None, zone, env: Env):
    d = dates.parse(string(x, env), formats)
    if d is None:
        raise fail(env, "date format is invalid")
    return d if d.tzinfo else d.replace(tzinfo=zone or UTC)


def fold(e: Call, env: Env, items: list, acc: Any, body: Any, first: int) -> Any:
    for i, x in enumerate(items, first):
        acc = nullable(evaluate(body, env._replace(item=x, index=i, acc=acc, pipe=x)))
    return acc


def _sorted(e: Call, env: Env, x: Any) -> list:
    items = array(x, env)
    keys = per_item(e.args[0], items, env)
    order = evaluate(e.args[1], env) if len(e.args) > 1 else "asc"
    if order not in ("asc", "desc"):
        raise fail(env, "order must be asc or desc")
    kinds = {bool if isinstance(k, bool) else str if isinstance(k, str) else float if is_number(k) else None for k in keys}
    if None in kinds or len(kinds) > 1:
        raise fail(env, "sort_by keys must be strings, numbers or booleans of one kind")
    at = sorted(range(len(items)), key=lambda i: keys[i].encode() if isinstance(keys[i], str) else keys[i], reverse=order == "desc")
    if order == "desc":  # stable: equal keys keep their order
        ranks = {i: (keys[i].encode() if isinstance(keys[i], str) else keys[i]) for i in at}
        groups: dict = {}
        for i in at:
            groups.setdefault(ranks[i], []).append(i)
        at = [i for g in groups.values() for i in sorted(g)]
    return [items[i] for i in at]


ARRAY_LAMBDA = frozenset("filter flat_map group_by key_by partition distinct_by find find_index".split())


def call(e: Call, env: Env, x: Any) -> Any:
    op, v = e.op, e.version
    if op in ("lookup", "lookup_first"):
        return lookup(e, env, x)
    if op == "coalesce":
        if x is not MISSING and x is not None:
            return x
        for a in e.args:
            y = evaluate(a, env)
            if y is not MISSING and y is not None:
                return y
        return MISSING
    if op in ("and", "or"):
        missing = False
        for i in range(len(e.args) + 1):
            y = x if i == 0 else evaluate(e.args[i - 1], env)
            if y is MISSING:
                missing = True
            elif not isinstance(y, bool):
                raise fail(env, "expr arg must be boolean")
            elif y == (op == "or"):
                return y
        return MISSING if missing else op == "and"
    if op == "map":
        if v == 2 and x is MISSING:
            return MISSING
        if v == 2 and not isinstance(x, list):
            raise fail(env, "map requires array")
        got = per_item(e.args[0], array(x, env), env)
        return [y for y in got if y is not MISSING] if v == 2 else [nullable(y) for y in got]
    if op in ARRAY_LAMBDA:
        items = array(x, env)
        got = per_item(e.args[0], items, env)
        if op == "filter":
            return [y for y, g in zip(items, got, strict=True) if true(g, env)]
        if op == "flat_map":
            return [w for g in got for w in (g if isinstance(g, list) else [nullable(g)])]
        if op == "partition":
            yes = [true(g, env) for g in got]
            return [[y for y, t in zip(items, yes, strict=True) if t], [y for y, t in zip(items, yes, strict=True) if not t]]
        if op == "find":
            return next((y for y, g in zip(items, got, strict=True) if true(g, env)), None)
        if op == "find_index":
            return next((i for i, g in enumerate(got) if true(g, env)), -1)
        keys = [key(g, env) for g in got]
        if op == "key_by":
            return dict(zip(keys, items, strict=True))
        if op == "distinct_by":
            return [items[i] for i, k in enumerate(keys) if keys.index(k) == i]
        groups: dict = {}
        for k, y in zip(keys, items, strict=True):
            groups.setdefault(k, []).append(y)
        return groups
    if op == "sort_by":
        return _sorted(e, env, x)
    if op == "reduce":
        items = array(x, env)
        return fold(e, env, items[1:], items[0], e.args[0], 1) if items else None
    if op == "fold":
        acc = evaluate(e.args[0], env)
        return MISSING if acc is MISSING else fold(e, env, array(x, env), acc, e.args[1], 0)
    if op == "zip_with":
        rows = [list(r) for r in zip(array(x, env), *[array(evaluate(a, env), env) for a in e.args[:-1]])]
        return [nullable(y) for y in per_item(e.args[-1], rows, env)]

    args = [evaluate(a, env) for a in e.args]
    if op in ("first", "last"):
        if x is MISSING:
            return MISSING
        if not isinstance(x, list):
            raise fail(env, f"{op} requires array")
        return (x[0] if op == "first" else x[-1]) if x else MISSING
    if op in ("flatten", "take", "drop", "slice", "chunk", "unzip", "unique", "zip", "index_of", "contains", "sum", "avg", "min", "max"):
        return arrays(op, x, args, env)
    if op in ("merge", "deep_merge"):
        some = [obj(y, env) for y in (x, *args) if y is not MISSING]
        return functools.reduce(deep_merge if op == "deep_merge" else lambda a, b: a | b, some) if some else MISSING
    if op in ("==", "!="):
        return (loose(x, env) == loose(args[0], env)) == (op == "==")
    # from here on a missing operand gives missing and null is an error
    if op == "get":
        if x is MISSING or x is None:
            return MISSING
        return get_path(x, paths(args, env)[0])
    if op == "to_string" and v == 2 and x is not MISSING and not isinstance(x, (str, bool, int, float)):
        return dumps(x)
    if any(y is MISSING for y in (x, *args)):
        return MISSING
    if x is None and op not in ("from_entries",) or any(y is None for y in args) and op not in ("from_entries",):
        raise fail(env, "expr arg must not be null")
    if op in ("pick", "omit"):
        ps = paths(args, env)
        if op == "pick":
            return _picked(obj(x, env), ps)
        if any(isinstance(p[-1], int) for p in ps):
            raise fail(env, "omit path must end with a key")
        return functools.reduce(_omitted, ps, obj(x, env))
    if op in ("keys", "values", "entries"):
        items = sorted(obj(x, env).items())
        return [k for k, _ in items] if op == "keys" else [y for _, y in items] if op == "values" else [{"key": k, "value": y} for k, y in items]
    if op == "len":
        if not isinstance(x, (str, list, dict)):
            raise fail(env, "len requires string/array/object")
        return len(x)
    if op == "from_entries":
        if args:
            return {key(x, env): args[0]}
        if isinstance(x, dict):
            return x
        out = {}
        for y in array(x, env):
            if isinstance(y, list) and len(y) == 2:
                out[key(y[0], env)] = y[1]
            elif isinstance(y, dict) and "key" in y and "value" in y:
                out[key(y["key"], env)] = y["value"]
            else:
                raise fail(env, "entries are pairs or objects with key and value")
        return out
    if op == "object_flatten":
        return _flat(obj(x, env), "", env)
    if op == "object_unflatten":
        out = {}
        for k, y in sorted(obj(x, env).items()):
            p = paths([k], env)[0]
            if any(isinstance(t, int) for t in p):
                raise fail(env, "object_unflatten paths have no indexes")
            at = get_path(out, p)
            if at is not MISSING:
                raise fail(env, "paths conflict")
            try:
                set_path(out, p, y)
            except EvalError as bad:
                raise fail(env, "paths conflict") from bad
        return out
    return scalar(op, v, x, args, env)


def arrays(op: str, x: Any, args: list, env: Env) -> Any:
    items = array(x, env)
    if op in ("sum", "avg", "min", "max"):
        if not items:
            return None
        n = [number(y, env) for y in items]
        return plain(sum(n) if op == "sum" else sum(n) / len(n) if op == "avg" else min(n) if op == "min" else max(n), env.path)
    if op == "flatten":
        depth = integer(args[0], env) if args and args[0] is not MISSING else 1
        if depth < 0:
            raise fail(env, "depth must be non-negative")
        return flatten(items, depth)
    if op in ("take", "drop", "slice", "chunk") and any(a is MISSING for a in args):
        return MISSING
    if op == "take":
        n = integer(args[0], env)
        return items[:n] if n >= 0 else items[max(0, len(items) + n) :]
    if op == "drop":
        n = integer(args[0], env)
        return items[n:] if n >= 0 else items[: max(0, len(items) + n)]
    if op == "slice":
        s, t = bounds(integer(args[0], env), integer(args[1], env) if len(args) > 1 else None, len(items))
        return items[s:t]
    if op == "chunk":
        n = integer(args[0], env)
        if n < 1:
            raise fail(env, "chunk size must be positive")
        return [items[i : i + n] for i in range(0, len(items), n)]
    if op == "zip":
        return [list(r) for r in zip(items, *[array(a, env) for a in args])]
    if op == "unzip":
        if not all(isinstance(r, list) and len(r) == len(items[0]) for r in items):
            raise fail(env, "unzip rows must be arrays of one length")
        return [list(c) for c in zip(*items, strict=True)]
    if op == "unique":
        seen: dict = {}
        for y in items:
            seen.setdefault(loose(y, env), y)
        return list(seen.values())
    want = loose(args[0], env)
    at = next((i for i, y in enumerate(items) if not isinstance(y, (list, dict)) and loose(y, env) == want), -1)
    return at if op == "index_of" else at >= 0


def scalar(op: str, v: int, x: Any, args: list, env: Env) -> Any:
    if op == "concat":
        return "".join(text(y, v, env.path) for y in (x, *args))
    if op in ("to_string", "string"):
        return text(x, v if op == "to_string" else 1, env.path)
    if op in ("trim", "lowercase", "uppercase"):
        s = text(x, 2, env.path) if v == 2 else string(x, env)
        return s.strip(SPACE) if op == "trim" else s.lower() if op == "lowercase" else s.upper()
    if op in ("int", "float", "bool"):
        try:
            return cast(x, op, env.path)
        except EvalError as bad:
            raise fail(env, bad.message, "ExprError" if v == 1 else "TypeCastFailed") from bad
    if op == "replace":
        s, pattern, new, *mode = (string(y, env) for y in (x, *args))
        mode = mode[0] if mode else ""
        if mode in ("regex", "regex_all"):
            try:
                return regex(pattern).sub(replacement(new), s, 0 if mode == "regex_all" else 1)
            except (re.error, ValueError, IndexError) as bad:
                raise fail(env, f"invalid regex: {bad}") from bad
        if mode not in ("", "all"):
            raise fail(env, "unknown replace mode")
        return s.replace(pattern, new) if mode == "all" else s.replace(pattern, new, 1)
    if op == "split":
        if not string(args[0], env):
            raise fail(env, "split delimiter must not be empty")
        return string(x, env).split(args[0])
    if op in ("pad_start", "pad_end"):
        s, n, pad = string(x, env), integer(args[0], env), string(args[1], env) if len(args) > 1 else " "
        if n < 0:
            raise fail(env, "pad length must be non-negative")
        more = n - len(s)
        fill = (pad * (more // len(pad) + 1))[:more] if pad and more > 0 else ""
        return fill + s if op == "pad_start" else s + fill
    if op in ("+", "-", "*", "/"):
        n = [number(y, env, v == 1) for y in (x, *args)]
        if op == "/" and 0 in n[1:]:
            raise fail(env, "division by zero")
        out = functools.reduce({"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b}[op], n)
        return plain(out, env.path) if v == 1 else out
    if op == "round":
        scale = integer(args[0], env) if args else 0
        if not 0 <= scale <= 308:
            raise fail(env, "scale must be between 0 and 308")
        return plain(half_away(number(x, env), scale), env.path)
    if op == "to_base":
        base = integer(args[0], env)
        if not 2 <= base <= 36:
            raise fail(env, "base must be between 2 and 36")
        n = integer(x, env)
        if n == -(2**63):
            raise fail(env, "value is out of range")
        return to_base(n, base)
    if op == "not":
        if not isinstance(x, bool):
            raise fail(env, "expr arg must be boolean")
        return not x
    if op in ("<", "<=", ">", ">="):
        a, b = number(x, env), number(args[0], env)
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if op == "~=":
        return matches(x, args[0], env)
    if op == "date_format":
        out, *rest = args
        formats = zone = None
        if len(rest) == 2:
            formats, zone = _formats(rest[0], env), _zone(rest[1], env)
        elif rest:
            if isinstance(rest[0], str) and dates.is_zone(rest[0]):
                zone = _zone(rest[0], env)
            else:
                formats = _formats(rest[0], env)
        d = _date(x, formats, zone, env)
        s = dates.write(d.astimezone(zone) if zone else d, string(out, env))
        if s is None:
            raise fail(env, "output format is invalid")
        return s
    if op == "to_unixtime":
        unit, zone = "s", None
        if args and not (isinstance(args[0], str) and dates.is_zone(args[0]) and len(args) == 1):
            unit = string(args[0], env)
            zone = _zone(args[1], env) if len(args) > 1 else None
        elif args:
            zone = _zone(args[0], env)
        if unit not in ("s", "ms"):
            raise fail(env, "unit must be s or ms")
        d = _date(x, None, zone, env)
        micros = round((d - dates.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1_000_000)
        return micros // (1_000_000 if unit == "s" else 1000)
    raise fail(env, f"unknown operation: {op}")


#: Characters of the property White_Space.
SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


# records


def _mapping(m: Mapping, env: Env, warnings: list) -> None:
    if m.when is not None:
        try:
            if not holds(m.when, env._replace(path=f"{m.path}.when")):
                return
        except EvalError as x:
            warnings.append({"kind": x.kind, "message": x.message, "path": x.path})
            return
    value = evaluate(m.expr, env._replace(path=f"{m.path}.expr"))
    if value is MISSING:
        if m.has_default:
            value = m.default
        elif m.required:
            raise EvalError("MissingRequired", "required value is missing", m.path)
        else:
            return
    if value is None and m.required:
        raise EvalError("MissingRequired", "required value is null", m.path)
    if m.type and value is not None:
        value = cast(value, m.type, f"{m.path}.type")
    set_path(env.out, m.target, value, f"{m.path}.target")


def run(rule: Rule, record: Any, context: Any = MISSING, trace: list | None = None) -> tuple[Any, list]:
    """(output or MISSING if the record is dropped, warnings); finalize not applied.

    ``trace`` gets a node for each condition, assert, branch and mapping that is
    reached: its kind, path, status and what it gave, branches with their own nodes."""
    warnings: list = []

    def note(kind: str, path: str, status: str, **more: Any) -> None:
        if trace is not None:
            trace.append({"kind": kind, "path": path, "status": status, **more})

    def decided(kind: str, s: Any) -> bool:
        try:
            return holds(s.cond, env._replace(path=s.path))
        except EvalError as x:
            note(kind, s.path, "error", error=f"{x.kind}: {x.message}")
            raise

    env = Env(record, context, {})
    for s in rule.steps:
        if isinstance(s, Mappings):
            for m in s.items:
                if trace is None:
                    _mapping(m, env, warnings)
                    continue
                before = len(warnings)
                try:
                    _mapping(m, env, warnings)
                except EvalError as x:
                    note("mapping", m.path, "error", target=".".join(map(str, m.target)), error=f"{x.kind}: {x.message}")
                    raise
                got = get_path(env.out, m.target)
                note("mapping", m.path, "warning" if len(warnings) > before else "skipped" if got is MISSING else "ok", target=".".join(map(str, m.target)), **({} if got is MISSING else {"output": got}))
        elif isinstance(s, RecordWhen):
            try:
                keep = decided("record_when", s)
            except EvalError as x:
                if s.strict:
                    raise
                warnings.append({"kind": x.kind, "message": x.message, "path": x.path})
                keep = False
            note("record_when", s.path, "ok" if keep else "dropped")
            if not keep:
                return MISSING, warnings
        elif isinstance(s, Assert):
            fine = decided("assert", s)
            note("assert", s.path, "ok" if fine else "error")
            if not fine:
                raise EvalError("AssertionFailed", f"{s.code}: {s.message}", s.path)
        elif isinstance(s, Branch):
            taken = decided("branch", s)
            rule_ = s.then if taken else s.other
            inner: list | None = None if trace is None else []
            note("branch", s.path, "skipped" if rule_ is None else "ok", taken="then" if taken else "else", nodes=inner)
            if rule_ is None:
                continue
            got, more = run(rule_, env.out, context, inner)
            warnings += more
            if got is MISSING:
                return MISSING, warnings
            if rule_.finalize:
                got = finalize(rule_.finalize, [got], context)
                if not rule_.finalize.has_wrap:
                    if not got:
                        return MISSING, warnings
                    got = got[0] if not s.returns else got
            if s.returns:
                return got, warnings
            if not isinstance(got, dict):
                raise EvalError("InvalidTarget", "a branch result must be an object", s.path)
            merged = deep_merge(env.out, got)
            env.out.clear()
            env.out.update(merged)
    return env.out, warnings


def finalize(f: Finalize, rows: list, context: Any = MISSING) -> Any:
    if f.filter is not None:
        rows = [r for i, r in enumerate(rows) if holds(f.filter, Env(r, context, rows, item=r, index=i, path="finalize.filter"))]
    if f.sort is not None:
        keys = [get_path(r, f.sort[0]) for r in rows]
        for k in keys:
            if k is MISSING:
                raise EvalError("InvalidRef", "sort key is missing", "finalize.sort.by")
            if k is None or isinstance(k, (list, dict)):
                raise EvalError("ExprError", "sort key must be a scalar", "finalize.sort.by")
        kinds = {bool if isinstance(k, bool) else str if isinstance(k, str) else float for k in keys}
        if len(kinds) == 1:
            comparable = [k.encode() if isinstance(k, str) else k for k in keys]
            order = sorted(range(len(rows)), key=comparable.__getitem__)
            if f.sort[1]:
                groups: dict = {}
                for i in order:
                    groups.setdefault(comparable[i], []).append(i)
                order = [i for k in reversed(groups) for i in groups[k]]
            rows = [rows[i] for i in order]
    rows = rows[f.offset or 0 :]
    if f.limit is not None:
        rows = rows[: f.limit]
    if not f.has_wrap:
        return rows

    def fill(t: Any, path: str) -> Any:
        if isinstance(t, dict):
            return {k: fill(v, f"{path}.{k}") for k, v in t.items()}
        return nullable(evaluate(t, Env(rows, context, rows, path=path)))

    return fill(f.wrap, "finalize.wrap")
