"""Rule files to logical plans. Faults raise ``InvalidRule`` with all that were found."""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path as File
from typing import Any

import yaml

from ..errors import EvalError, InvalidRule, RuleError
from . import ops
from .ast import All, AnyOf, Assert, Branch, Call, Compare, Finalize, If, Let, Lit, Mapping, Mappings, MapStep, Pipe, RecordWhen, Ref, Rule, Truth

_PLAIN = re.compile(r"[^.\[\]]+")
_INDEX = re.compile(r"\[(\d+)\]")
_QUOTED = re.compile(r"""\[(["'])((?:\\["'\\]|[^\\\[\]"'])*)\1\]""")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Comparison conditions.
COMPARE = ("eq", "ne", "gt", "gte", "lt", "lte", "match")
TYPES = ("string", "int", "float", "bool")


class Fault(Exception):
    def __init__(self, code: str, message: str, path: str = "") -> None:
        super().__init__(message)
        self.code, self.message, self.path = code, message, path


def at(path: str, f, *args) -> Any:
    """``f(*args)``; its faults get the path in front."""
    try:
        return f(*args)
    except Fault as x:
        raise Fault(x.code, x.message, path + x.path) from None


def path_tokens(text: str) -> tuple:
    """``a.b[0]["k.x"]`` to ("a", "b", 0, "k.x")."""
    out: list[str | int] = []
    pos, fresh = 0, True  # fresh: a key may come without a dot
    while pos < len(text):
        if text[pos] == "[":
            if m := _INDEX.match(text, pos):
                if not out:
                    raise Fault("InvalidPath", f"a path cannot begin with an index: {text}")
                out.append(int(m[1]))
            elif m := _QUOTED.match(text, pos):
                out.append(re.sub(r"\\(.)", r"\1", m[2]))
            else:
                raise Fault("InvalidPath", f"odd brackets in path: {text}")
            pos, fresh = m.end(), False
            continue
        if not fresh:
            if text[pos] != ".":
                raise Fault("InvalidPath", f"a dot is missing in path: {text}")
            pos += 1
            if text[pos : pos + 1] == "[":
                continue
        m = _PLAIN.match(text, pos)
        if not m:
            raise Fault("InvalidPath", f"empty key in path: {text}")
        out.append(m[0])
        pos, fresh = m.end(), False
    if not out:
        raise Fault("InvalidPath", "empty path")
    return tuple(out)


def _item(rest: tuple) -> Ref:
    if rest[:1] == ("value",):
        rest = rest[1:]
    return Ref("index") if rest == ("index",) else Ref("item", rest)


def at_ref(text: str) -> Ref:
    """``@input.x`` and the like."""
    body = text[1:]
    head = re.match(r"[^.\[]*", body)[0]
    rest = body[len(head) :].removeprefix(".")
    if body.endswith("."):
        raise Fault("InvalidRefNamespace", f"a reference ends with a dot: {text}")
    tokens = path_tokens(rest) if rest else ()
    if head in ("input", "context", "out"):
        return Ref(head, tokens)
    if head == "item":
        return _item(tokens)
    if head == "acc":
        return Ref("acc", tokens[1:] if tokens[:1] == ("value",) else tokens)
    if not _NAME.fullmatch(head) or tokens:
        raise Fault("InvalidRefNamespace", f"not a reference: {text}")
    return Ref("local", (), head)


def dotted_ref(text: str) -> Ref:
    """``input.x`` and the like, of version 1 and of ``source``."""
    tokens = path_tokens(text)
    if tokens[0] in ("input", "context", "out") and len(tokens) > 1:
        return Ref(str(tokens[0]), tokens[1:])
    if tokens[0] == "item" and len(tokens) > 1:
        return _item(tokens[1:])
    if tokens[0] == "acc" and tokens[1:2] == ("value",):
        return Ref("acc", tokens[2:])
    if str(tokens[0]).startswith("local") and len(tokens) > 1:
        return Ref("local", tokens[2:], str(tokens[1]))
    raise Fault("InvalidRefNamespace", f"not a namespace: {text}")


def source_ref(text: str) -> Ref:
    tokens = path_tokens(text)
    return Ref("input", tokens) if len(tokens) == 1 else dotted_ref(text)


def check_call(op: str, n: int, version: int) -> str:
    name = ops.canonical(op)
    if name not in ops.ARITY or version == 1 and name in ops.V2_ONLY:
        raise Fault("UnknownOp", f"no such operation: {op}", ".op" if version == 1 else "")
    least, most = ops.ARITY[name]
    if version == 1 and name in ("-", "/"):
        most = 1
    if n < least or most is not None and n > most:
        raise Fault("InvalidArgs", f"{op} takes {least}" + ("" if most == least else f" to {most}" if most is not None else " or more") + f" arguments, not {n}")
    return name


# version 2


def start_v2(x: Any) -> Any:
    if isinstance(x, str):
        if x == "$":
            return Ref("pipe")
        if x.startswith("lit:"):
            return Lit(x[4:])
        if x.startswith("@"):
            return at_ref(x)
    return Lit(x)


def expr_v2(x: Any) -> Any:
    return pipe_v2(x) if isinstance(x, list) else start_v2(x)


def _is_step(x: Any) -> bool:
    if not isinstance(x, dict):
        return False
    return any(k in x for k in ("op", "let", "if", "map")) or len(x) == 1 and ops.known(next(iter(x)))


def pipe_v2(x: list) -> Any:
    if not x:
        raise Fault("EmptyPipe", "a pipe needs a start")
    if len(x) == 1 and _is_step(x[0]):
        return Pipe(Ref("pipe"), (step_v2(x[0]),))
    start = at("[0]", start_v2, x[0])
    steps = tuple(at(f"[{i}]", step_v2, s) for i, s in enumerate(x[1:], 1))
    return Pipe(start, steps) if steps else start


def _args(x: Any) -> list:
    return x if isinstance(x, list) else [x]


def step_v2(x: Any) -> Any:
    if isinstance(x, str):
        if x.startswith("@"):
            return at_ref(x)
        if x == "$":
            raise Fault("InvalidPipeStep", "$ is a start, not a step")
        return Call(check_call(x, 0, 2), None, (), 2)
    if not isinstance(x, dict):
        raise Fault("InvalidPipeStep", "a step is an object or a name")
    if "op" in x:
        args = x.get("args", [])
        if not isinstance(args, list):
            raise Fault("InvalidArgs", "args is not a list")
        return Call(check_call(str(x["op"]), len(args), 2), None, tuple(expr_v2(a) for a in args), 2)
    if "let" in x:
        if not isinstance(x["let"], dict):
            raise Fault("InvalidPipeStep", "let takes an object")
        return Let(tuple((k, expr_v2(v)) for k, v in sorted(x["let"].items())))
    if "if" in x:
        inner = x["if"] if isinstance(x["if"], dict) and ("cond" in x["if"] or "then" in x["if"]) else {"cond": x["if"]} | {k: x[k] for k in ("then", "else") if k in x}
        if "cond" not in inner or "then" not in inner:
            raise Fault("InvalidPipeStep", "if needs a condition and then")
        return If(cond_v2(inner["cond"]), expr_v2(inner["then"]), expr_v2(inner["else"]) if "else" in inner else None)
    if "map" in x:
        if not isinstance(x["map"], list):
            raise Fault("InvalidPipeStep", "map takes a list of steps")
        return MapStep(tuple(step_v2(s) for s in x["map"]))
    if len(x) == 1:
        (op, args), = x.items()
        args = _args(args)
        return Call(check_call(str(op), len(args), 2), None, tuple(expr_v2(a) for a in args), 2)
    raise Fault("InvalidPipeStep", "unknown step")


def cond_v2(x: Any) -> Any:
    if isinstance(x, dict) and len(x) == 1:
        (k, v), = x.items()
        if k in ("all", "any"):
            if not isinstance(v, list):
                raise Fault("InvalidExprShape", f"{k} takes a list")
            return (All if k == "all" else AnyOf)(tuple(cond_v2(c) for c in v))
        if k in COMPARE:
            if not isinstance(v, list) or len(v) != 2:
                raise Fault("InvalidArgs", f"{k} compares two values")
            return Compare(k, expr_v2(v[0]), expr_v2(v[1]))
    return Truth(expr_v2(x), 2)


# version 1


def expr_v1(x: Any) -> Any:
    if not isinstance(x, dict):
        return Lit(x)
    if set(x) == {"ref"}:
        return dotted_ref(str(x["ref"]))
    if "op" in x and set(x) <= {"op", "args"}:
        args = x.get("args", [])
        if not isinstance(args, list):
            raise Fault("InvalidArgs", "args is not a list")
        if not args:
            raise Fault("InvalidArgs", f"{x['op']} needs a subject")
        name = check_call(str(x["op"]), len(args) - 1, 1)
        return Call(name, at(".args[0]", expr_v1, args[0]), tuple(at(f".args[{i}]", expr_v1, a) for i, a in enumerate(args[1:], 1)), 1)
    if set(x) == {"chain"}:
        steps = x["chain"]
        if not isinstance(steps, list) or not steps:
            raise Fault("InvalidArgs", "a chain needs a start")
        out = expr_v1(steps[0])
        for s in steps[1:]:
            if not isinstance(s, dict) or "op" not in s:
                raise Fault("InvalidExprShape", "a chain goes on with operations")
            args = s.get("args", [])
            out = Call(check_call(str(s["op"]), len(args), 1), out, tuple(expr_v1(a) for a in args), 1)
        return out
    return Lit(x)


def is_v2(x: Any) -> bool:
    """Within ``version: 2``: pipes, @, $ and lit: are version 2 syntax, the rest is version 1."""
    return isinstance(x, list) or isinstance(x, str) and (x.startswith(("@", "lit:")) or x == "$") or isinstance(x, dict) and not (set(x) == {"ref"} or set(x) == {"chain"} or "op" in x)


def expression(x: Any, version: int) -> Any:
    return expr_v2(x) if version == 2 and is_v2(x) else expr_v1(x)


def boolean_kind(e: Any) -> str:
    """yes, no or maybe: whether a version 1 expression gives a boolean."""
    if isinstance(e, Lit):
        return "yes" if isinstance(e.value, bool) else "no"
    if isinstance(e, Call):
        if e.op == "coalesce":
            kinds = {boolean_kind(a) for a in (e.subject, *e.args)}
            return kinds.pop() if len(kinds) == 1 else "maybe"
        return "yes" if e.op in ops.BOOLEAN else "maybe" if e.op in ops.MAYBE_BOOLEAN else "no"
    return "maybe"


def condition(x: Any, version: int) -> Any:
    if version == 2 and not (isinstance(x, dict) and (set(x) in ({"ref"}, {"chain"}) or "op" in x)):
        return cond_v2(x)
    e = expression(x, version)
    if boolean_kind(e) == "no":
        raise Fault("InvalidWhenType", "the condition is not boolean")
    return Truth(e, 1)


class Scope:
    """Static checks of references: locals, item and accumulator, outputs so far."""

    def __init__(self, outs: set[tuple] | None, item: bool = False, acc: bool = False, names: frozenset[str] = frozenset(), version: int = 2) -> None:
        self.outs, self.item, self.acc, self.names, self.version = outs, item, acc, names, version

    def inside(self, acc: bool) -> Scope:
        return Scope(self.outs, True, acc or self.acc, self.names, self.version)

    def check(self, e: Any) -> None:
        if isinstance(e, Ref):
            if e.ns in ("item", "index") and not self.item:
                raise Fault("InvalidItemRef" if self.version == 2 else "InvalidRefNamespace", "@item is only known inside an array operation")
            if e.ns == "acc" and not self.acc:
                raise Fault("InvalidAccRef" if self.version == 2 else "InvalidRefNamespace", "@acc is only known inside reduce and fold")
            if e.ns == "local" and e.name not in self.names:
                raise Fault("UndefinedVariable", f"@{e.name} is not bound")
            if e.ns == "out" and e.path and self.outs is not None:
                keys = tuple(k for k in e.path if isinstance(k, str))
                if not any(keys[: len(o)] == o or o[: len(keys)] == keys for o in self.outs):
                    raise Fault("ForwardOutReference", f"@out.{'.'.join(keys)} is not written before")
        elif isinstance(e, Pipe):
            self.check(e.start)
            self.steps(e.steps)
        elif isinstance(e, Call):
            at = ops.LAMBDAS.get(e.op)
            at = len(e.args) - 1 if at == -1 else at
            if e.subject is not None:
                self.check(e.subject)
            for i, a in enumerate(e.args):
                (self.inside(e.op in ops.FOLDS) if i == at else self).check(a)
        elif isinstance(e, (All, AnyOf)):
            for c in e.conds:
                self.check(c)
        elif isinstance(e, Compare):
            self.check(e.left)
            self.check(e.right)
        elif isinstance(e, Truth):
            self.check(e.expr)

    def steps(self, steps: tuple) -> None:
        scope = self
        for s in steps:
            if isinstance(s, Let):
                for name, x in s.bindings:
                    scope.check(x)
                    scope = Scope(scope.outs, scope.item, scope.acc, scope.names | {name}, scope.version)
            elif isinstance(s, If):
                scope.check(s.cond)
                scope.check(s.then)
                if s.other is not None:
                    scope.check(s.other)
            elif isinstance(s, MapStep):
                scope.inside(False).steps(s.steps)
            else:
                scope.check(s)


class Reader:
    """One rule file; collects faults with their paths."""

    def __init__(self, raw: dict, base: File | None, loading: tuple[File, ...], lines: dict[str, tuple[int, int]], strict: bool) -> None:
        self.raw, self.base, self.loading, self.lines, self.strict = raw, base, loading, lines, strict
        self.errors: list[RuleError] = []
        self.outs: set[tuple] | None = set()
        self.targets: set[tuple] = set()

    def fault(self, code: str, message: str, path: str) -> None:
        at = path
        while at and at not in self.lines:
            at = re.sub(r"(\.[^.\[]*|\[\d+\])$", "", at) if re.search(r"[.\[]", at) else ""
        self.errors.append(RuleError(code, message, path, *self.lines.get(at, (0, 0))))

    def safely(self, path: str, f, *args) -> Any:
        try:
            return f(*args)
        except Fault as x:
            self.fault(x.code, x.message, path + x.path)
            return None

    def checked(self, path: str, make, x: Any, version: int, outs: set | None = None, item: bool = False) -> Any:
        def run() -> Any:
            e = make(x, version)
            Scope(outs, item=item, version=version).check(e)
            return e

        return self.safely(path, run)

    def mapping(self, m: Any, path: str, version: int) -> Mapping | None:
        if not isinstance(m, dict):
            self.fault("MissingTarget", "a mapping is an object", path)
            return None
        target = None
        if not str(m.get("target") or "").strip():
            self.fault("MissingTarget", "target is required", f"{path}.target")
        else:
            target = self.safely(f"{path}.target", path_tokens, str(m["target"]))
            if target and any(isinstance(k, int) for k in target):
                self.fault("InvalidPath", "a target has no indexes", f"{path}.target")
            elif target in self.targets:
                self.fault("DuplicateTarget", f"{m['target']} is written twice", f"{path}.target")
        given = [k for k in ("source", "value", "expr") if k in m and (k == "value" or m[k] is not None)]
        expr = None
        if len(given) > 1:
            self.fault("SourceValueExprExclusive", "only one of source, value and expr", path)
        elif not given:
            self.fault("MissingMappingValue", "one of source, value and expr is required", path)
        elif given == ["source"]:
            expr = self.checked(f"{path}.source", lambda x, _: source_ref(str(x)), m["source"], version, self.outs)
        elif given == ["value"]:
            expr = Lit(m["value"])
        else:
            expr = self.checked(f"{path}.expr", expression, m["expr"], version, self.outs)
        when = self.checked(f"{path}.when", condition, m["when"], version, self.outs) if m.get("when") is not None else None
        if m.get("type") is not None and m["type"] not in TYPES:
            self.fault("InvalidTypeName", f"no such type: {m['type']}", f"{path}.type")
        if target:
            self.targets.add(target)
            if self.outs is not None:
                self.outs.add(target)
        return Mapping(target or ("?",), expr, path, when, m.get("type"), bool(m.get("required", False)), m.get("default"), m.get("default") is not None)

    def mappings(self, items: Any, path: str, version: int) -> Mappings:
        return Mappings(tuple(m for i, x in enumerate(items or []) if (m := self.mapping(x, f"{path}[{i}]", version))))

    def step(self, s: Any, path: str, version: int) -> list:
        kinds = [k for k in ("mappings", "record_when", "asserts", "branch") if isinstance(s, dict) and s.get(k) is not None]
        if len(kinds) != 1:
            self.fault("InvalidStep", "a step is one of mappings, record_when, asserts and branch", path)
            return []
        if kinds == ["mappings"]:
            return [self.mappings(s["mappings"], f"{path}.mappings", version)]
        if kinds == ["record_when"]:
            return [RecordWhen(self.checked(f"{path}.record_when", condition, s["record_when"], version, self.outs), f"{path}.record_when", True)]
        if kinds == ["asserts"]:
            out = []
            for i, a in enumerate(s["asserts"]):
                p = f"{path}.asserts[{i}]"
                out.append(Assert(self.checked(f"{p}.when", condition, a.get("when"), version, self.outs), str(a["error"]["code"]), str(a["error"]["message"]), p))
            return out
        b = s["branch"]
        cond = self.checked(f"{path}.branch.when", condition, b.get("when"), version, self.outs)
        if b.get("return") is not True:
            self.outs = None  # a branch writes what its rule says
        return [Branch(cond, self.sub(b.get("then"), f"{path}.branch.then"), self.sub(b["else"], f"{path}.branch.else") if b.get("else") else None, bool(b.get("return", False)), f"{path}.branch")]

    def sub(self, name: Any, path: str) -> Rule | None:
        if not name:
            self.fault("InvalidStep", "a branch names a rule file", path)
            return None
        file = (self.base or File(".")) / str(name)
        if file.resolve() in self.loading:
            self.fault("CyclicDependency", f"{name} includes itself", path)
            return None
        if not file.exists():
            self.fault("InvalidStep", f"no such rule file: {name}", path)
            return None
        try:
            return load_rule(file, self.loading)
        except InvalidRule as x:
            self.errors += x.errors
            return None

    def finalize(self, f: Any, version: int) -> Finalize | None:
        if f is None:
            return None
        if not isinstance(f, dict) or set(f) - {"filter", "sort", "limit", "offset", "wrap"}:
            self.fault("InvalidFinalize", "finalize takes filter, sort, offset, limit and wrap", "finalize")
            return None
        sort = None
        if (s := f.get("sort")) is not None:
            if not isinstance(s, dict) or not s.get("by") or s.get("order", "asc") not in ("asc", "desc"):
                self.fault("InvalidFinalize", "sort takes by, and order asc or desc", "finalize.sort")
            elif p := self.safely("finalize.sort.by", path_tokens, str(s["by"])):
                sort = (p, s.get("order") == "desc")
        for k in ("limit", "offset"):
            if f.get(k) is not None and (not isinstance(f[k], int) or isinstance(f[k], bool) or f[k] < 0):
                self.fault("InvalidFinalize", f"{k} is not a count", f"finalize.{k}")

        def leaves(x: Any, path: str) -> Any:
            if isinstance(x, dict):
                return {k: leaves(v, f"{path}.{k}") for k, v in x.items()}
            return self.checked(path, lambda y, _: expr_v2(y), x, 2, None)

        cond = self.checked("finalize.filter", condition, f["filter"], 2, None, True) if f.get("filter") is not None else None
        return Finalize(cond, sort, f.get("offset"), f.get("limit"), leaves(f["wrap"], "finalize.wrap") if f.get("wrap") is not None else None, f.get("wrap") is not None)

    def rule(self) -> Rule:
        raw = self.raw
        version = raw.get("version")
        if version not in (1, 2):
            self.fault("InvalidVersion", "version is 1 or 2", "version")
            version = 2
        if odd := set(raw) - {"version", "input", "output", "record_when", "mappings", "steps", "finalize"}:
            self.fault("InvalidExprShape", f"unknown fields: {', '.join(sorted(map(str, odd)))}", "")
        inp = raw.get("input") or {}
        form = inp.get("format")
        csv, js = inp.get("csv"), inp.get("json")
        if not form:
            self.fault("MissingInputFormat", "input.format is required", "input.format")
        elif form not in ("csv", "json", "parquet"):
            self.fault("InvalidInputFormat", f"no such format: {form}", "input.format")
        if form == "csv":
            if csv is None:
                self.fault("MissingCsvSection", "input.csv is required", "input.csv")
            else:
                if len(str(csv.get("delimiter", ","))) != 1:
                    self.fault("InvalidDelimiterLength", "the delimiter is one character", "input.csv.delimiter")
                if csv.get("has_header", True) is False and not csv.get("columns"):
                    self.fault("MissingCsvColumns", "columns are required without a header", "input.csv.columns")
        if form == "json" and js is None and self.strict:
            self.fault("MissingJsonSection", "input.json is required", "input.json")
        csv, js = csv or {}, js or {}
        steps: list = []
        if raw.get("steps") is not None and version != 2:
            self.fault("InvalidStep", "steps need version 2", "steps")
        if raw.get("record_when") is not None:
            steps.append(RecordWhen(self.checked("record_when", condition, raw["record_when"], version, set()), "record_when", False))
        if raw.get("steps") is not None:
            if raw.get("mappings") or raw.get("record_when") is not None:
                self.fault("StepsMappingExclusive", "steps exclude mappings and record_when", "steps")
            for i, s in enumerate(raw["steps"]):
                steps += self.step(s, f"steps[{i}]", version)
        elif not raw.get("mappings"):
            self.fault("MissingMappings", "mappings or steps are required", "mappings")
        else:
            steps.append(self.mappings(raw["mappings"], "mappings", version))
        final = self.finalize(raw.get("finalize"), version)
        if self.errors:
            raise InvalidRule(self.errors)
        return Rule(version, form, tuple(steps), final, js.get("records_path"), csv.get("has_header", True), str(csv.get("delimiter", ",")), tuple(c["name"] for c in csv.get("columns") or ()), (raw.get("output") or {}).get("name"), raw)


def _lines(node: yaml.Node | None, path: str, out: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    if node is not None:
        out[path] = (node.start_mark.line + 1, node.start_mark.column + 1)
        if isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                _lines(v, f"{path}.{k.value}" if path else str(k.value), out)
        elif isinstance(node, yaml.SequenceNode):
            for i, v in enumerate(node.value):
                _lines(v, f"{path}[{i}]", out)
    return out


@lru_cache(128)
def _parsed(text: str) -> tuple[Any, dict[str, tuple[int, int]]]:
    return yaml.safe_load(text), _lines(yaml.compose(text, Loader=yaml.SafeLoader), "", {})


def parse_rule(text: str | dict, base: str | File | None = None, loading: tuple[File, ...] = (), strict: bool = False) -> Rule:
    """A rule from YAML text or a dict; branch files are relative to ``base``.
    ``strict`` also asks for sections that evaluation can do without."""
    raw, lines = (text, {}) if isinstance(text, dict) else _parsed(text)
    if not isinstance(raw, dict):
        raise InvalidRule([RuleError("InvalidExprShape", "a rule is an object")])
    return Reader(raw, File(base) if base else None, loading, lines, strict).rule()


def load_rule(file: str | File, loading: tuple[File, ...] = ()) -> Rule:
    file = File(file)
    try:
        text = file.read_text()
    except OSError as x:
        raise EvalError("InvalidInput", f"cannot read rule file: {x}") from x
    return parse_rule(text, file.parent, (*loading, file.resolve()))


def validate_rule(text: str | dict, base: str | File | None = None) -> list[RuleError]:
    """All faults of a rule; empty if it is valid."""
    try:
        parse_rule(text, base, strict=True)
    except InvalidRule as x:
        return x.errors
    return []
