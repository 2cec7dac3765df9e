"""Expressions to columns.

Each expression compiles once, on the driver, to a value with a static type, a
flag for "missing" (None when it cannot be), and the conditions under which its
evaluation is an error. Nothing raises inside an expression, so Catalyst may
reorder and push down what it likes; the plan decides what an error does.
What has no static type raises ``NotTyped``: the record evaluator takes over.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dynamic import regex
from ..functions import columns as X
from ..functions import dates
from ..values import MISSING, get_path, parse_number, to_int
from . import ops
from .ast import All, AnyOf, Call, Compare, If, Let, Lit, MapStep, Pipe, Ref, Truth
from .parse import Fault, path_tokens

NULL, STRING, LONG, DOUBLE, BOOL = T.NullType(), T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
#: The index of an element where a body is only looked at.
PLACE = "_sluice_place"


class NotTyped(Exception):
    """The static types do not determine the result."""


class Error(NamedTuple):
    cond: Column
    kind: str
    message: str


class Val(NamedTuple):
    col: Column
    type: T.DataType
    missing: Column | None = None
    errors: tuple[Error, ...] = ()
    literal: Any = MISSING  # of a constant


@dataclass(frozen=True)
class Scope:
    input: Val | Callable[[], Val]
    field: Callable[[str], Val | None]  # a top-level input field
    context: Any
    out: dict
    path: str = ""
    pipe: Val | None = None
    item: Val | None = None
    index: Val | None = None
    acc: Val | None = None
    names: tuple = ()
    lookup: Callable | None = None  # turns a lookup in a constant or a DataFrame into a join
    frames: frozenset = frozenset()  # entries of the context that are DataFrames
    stage: Callable[[Val], Val] | None = None  # makes a value a column; None inside of array bodies


def native(t: T.DataType) -> T.DataType:
    """The types of JSON: integers are long, decimals and floats double."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return LONG
    if isinstance(t, (T.FloatType, T.DecimalType)):
        return DOUBLE
    if isinstance(t, T.ArrayType):
        return T.ArrayType(native(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, native(f.dataType)) for f in t.fields])
    if isinstance(t, T.MapType):
        return T.MapType(t.keyType, native(t.valueType))
    return t


def of_column(c: Column, t: T.DataType) -> Val:
    want = native(t)
    return Val(c if want == t or isinstance(want, (T.ArrayType, T.StructType, T.MapType)) and _same(want, t) else c.cast(want), want)


def _same(a: T.DataType, b: T.DataType) -> bool:
    return a.simpleString() == b.simpleString()


def constant(x: Any) -> Val:
    if x is None:
        return Val(F.lit(None), NULL, literal=x)
    if isinstance(x, bool):
        return Val(F.lit(x), BOOL, literal=x)
    if isinstance(x, int):
        return Val(F.lit(x).cast("bigint"), LONG, literal=x)
    if isinstance(x, float):
        return Val(F.lit(x), DOUBLE, literal=x)
    if isinstance(x, str):
        return Val(F.lit(x), STRING, literal=x)
    if isinstance(x, list):
        if not x:
            raise NotTyped("an empty array has no element type")
        parts = unify([constant(v) for v in x])
        return Val(F.array(*[p.col for p in parts]), T.ArrayType(parts[0].type), literal=x)
    if isinstance(x, dict):
        if not x:
            raise NotTyped("an empty object has no fields")
        return struct({k: constant(v) for k, v in sorted(x.items())})._replace(literal=x)
    raise NotTyped(f"a constant of {type(x).__name__}")


def struct(fields: dict[str, Val]) -> Val:
    """Missing fields are null here; sinks omit them by their own flags."""
    return Val(
        F.struct(*[value(v).alias(k) for k, v in fields.items()]),
        T.StructType([T.StructField(k, v.type) for k, v in fields.items()]),
        None, tuple(e for v in fields.values() for e in v.errors),
    )


def value(v: Val) -> Column:
    """The column, null where missing."""
    return v.col if v.missing is None else F.when(~v.missing, v.col)


def common(types: list[T.DataType]) -> T.DataType:
    out = NULL
    for t in types:
        if isinstance(t, T.NullType) or t == out:
            continue
        if isinstance(out, T.NullType):
            out = t
        elif {type(t), type(out)} == {T.LongType, T.DoubleType}:
            out = DOUBLE
        elif isinstance(t, T.ArrayType) and isinstance(out, T.ArrayType):
            out = T.ArrayType(common([t.elementType, out.elementType]))
        elif not _same(t, out):
            raise NotTyped(f"{t.simpleString()} beside {out.simpleString()}")
    return out


def unify(vals: list[Val]) -> list[Val]:
    t = common([v.type for v in vals])
    return [v if _same(v.type, t) or isinstance(t, T.NullType) else v._replace(col=v.col.cast(t), type=t) for v in vals]


def either(*flags: Column | None) -> Column | None:
    some = [f for f in flags if f is not None]
    return X.any_of(some) if some else None


def guarded(cond: Column, errors: tuple[Error, ...]) -> tuple[Error, ...]:
    return tuple(Error(cond & e.cond, e.kind, e.message) for e in errors)


def errors_of(*vals: Val) -> tuple[Error, ...]:
    return tuple(e for v in vals for e in v.errors)


def is_null(v: Val) -> Column:
    c = v.col.isNull()
    return c if v.missing is None else ~v.missing & c


def failed(errors: tuple[Error, ...]) -> Column:
    return X.any_of([F.coalesce(e.cond, F.lit(False)) for e in errors])


def error(cond: Column, message: str, kind: str = "ExprError") -> Error:
    return Error(cond, kind, message)


# references


def field(v: Val, path: tuple) -> Val:
    """A path below a value; missing where it does not exist."""
    for k in path:
        t, gone = v.type, v.missing
        if isinstance(k, int):
            if not isinstance(t, T.ArrayType):
                return absent()
            v = Val(F.get(v.col, F.lit(k)), t.elementType, either(gone, F.coalesce(F.size(v.col) <= k, F.lit(True))), v.errors)
        elif isinstance(t, T.StructType):
            if k not in t.names:
                return absent()
            v = Val(v.col.getField(k), t[k].dataType, either(gone, v.col.isNull()), v.errors)
        elif isinstance(t, T.MapType):
            v = Val(F.try_element_at(v.col, F.lit(k)), t.valueType, either(gone, ~F.coalesce(F.map_contains_key(v.col, F.lit(k)), F.lit(False))), v.errors)
        else:
            return absent()
    return v


def absent() -> Val:
    return Val(F.lit(None), NULL, F.lit(True))


def out_value(tree: dict, path: tuple) -> Val:
    if isinstance(tree, Val):
        return field(tree, path)
    node: Any = tree
    for i, k in enumerate(path):
        if isinstance(node, Val):
            return field(node, path[i:])
        if k not in node:
            return absent()
        node = node[k]
    return node if isinstance(node, Val) else tree_value(node)


def tree_value(tree: dict) -> Val:
    if not tree:
        raise NotTyped("an empty object")
    return struct({k: v if isinstance(v, Val) else tree_value(v) for k, v in sorted(tree.items())})


def reference(r: Ref, s: Scope) -> Val:
    if r.ns == "input":
        if not r.path:
            return s.input() if callable(s.input) else s.input
        top = s.field(r.path[0])
        return absent() if top is None else field(top, r.path[1:])
    if r.ns == "context":
        if r.path and r.path[0] in s.frames:  # only a lookup can use it
            return Val(F.lit(None), NULL, F.lit(True), (), r)
        got = s.context if s.context is MISSING else get_path(s.context, r.path)
        if isinstance(got, list):
            try:
                return constant(got)
            except NotTyped:  # a lookup can still use it
                return Val(F.lit(None), NULL, None, (), got)
        return absent() if got is MISSING else constant(got)
    if r.ns == "out":
        return out_value(s.out, r.path)
    if r.ns == "local":
        return field(dict(s.names)[r.name], r.path)
    v = {"pipe": s.pipe, "item": s.item, "index": s.index, "acc": s.acc}[r.ns]
    if v is None:
        raise NotTyped(f"no {r.ns} here")
    return field(v, r.path)


# expressions


def compile_expr(e: Any, s: Scope) -> Val:
    if isinstance(e, Lit):
        return constant(e.value)
    if isinstance(e, Ref):
        return reference(e, s)
    if isinstance(e, Pipe):
        return compile_steps(e.steps, replace(s, pipe=staged(compile_expr(e.start, s), s)))
    if isinstance(e, Call):
        if e.subject is None:
            if s.pipe is None:
                raise NotTyped("no pipe value here")
            return compile_call(e, s, s.pipe)
        return compile_call(e, s, None if e.op in ("lookup", "lookup_first") else compile_expr(e.subject, s))
    if isinstance(e, (All, AnyOf, Compare, Truth)):
        return compile_cond(e, s)
    raise NotTyped(type(e).__name__)


def staged(v: Val, s: Scope) -> Val:
    """What the next step and its errors read again and again, computed once."""
    return s.stage(v) if s.stage is not None and (isinstance(v.type, (T.ArrayType, T.MapType)) or "lambda" in repr(v.col)) else v


def compile_steps(steps: tuple, s: Scope) -> Val:
    for n, step in enumerate(steps):
        if isinstance(step, Call):
            v = compile_call(step, s, s.pipe)
        elif isinstance(step, Let):
            for name, x in step.bindings:
                s = replace(s, names=(*s.names, (name, compile_expr(x, s))))
            continue
        elif isinstance(step, If):
            c = compile_cond(step.cond, s)
            v = choose(c, compile_expr(step.then, s), s.pipe if step.other is None else compile_expr(step.other, s))
        elif isinstance(step, MapStep):
            v = compile_map(s, s.pipe, lambda t: compile_steps(step.steps, t), 2)  # noqa: B023
        else:
            v = compile_expr(step, s)
        s = replace(s, pipe=v if n == len(steps) - 1 else staged(v, s))
    return s.pipe


def choose(c: Val, a: Val, b: Val) -> Val:
    x, y = unify([a, b])
    gone = None
    if x.missing is not None or y.missing is not None:
        gone = F.when(c.col, x.missing if x.missing is not None else F.lit(False)).otherwise(y.missing if y.missing is not None else F.lit(False))
    fine = ~failed(c.errors) if c.errors else F.lit(True)
    errors = (*c.errors, *guarded(fine & c.col, x.errors), *guarded(fine & ~c.col, y.errors))
    return Val(F.when(c.col, x.col).otherwise(y.col), x.type if not isinstance(x.type, T.NullType) else y.type, gone, errors)


def compile_cond(c: Any, s: Scope) -> Val:
    """A boolean that is never null or missing; later terms of all and any are
    evaluated, and fail, only if the earlier ones do not decide."""
    if isinstance(c, (All, AnyOf)):
        every = isinstance(c, All)
        out, errors = F.lit(every), ()
        for x in c.conds:
            v = compile_cond(x, s)
            errors += guarded(out if every else ~out, v.errors) if v.errors else ()
            out = v.col if len(c.conds) == 1 else (out & v.col) if every else (out | v.col)
        return Val(out, BOOL, None, errors)
    if isinstance(c, Truth):
        v = compile_expr(c.expr, s)
        if isinstance(v.type, T.NullType):
            bad = ~v.missing if v.missing is not None and c.version == 2 else F.lit(True)
            return Val(F.lit(False), BOOL, None, (*v.errors, error(bad, "condition must evaluate to boolean")))
        if not isinstance(v.type, T.BooleanType):
            raise NotTyped("a condition that is not boolean")
        errors = v.errors
        bad = is_null(v) if c.version == 2 or v.missing is None else v.missing | v.col.isNull()
        return Val(F.coalesce(value(v), F.lit(False)), BOOL, None, (*errors, error(bad, "condition must evaluate to boolean")))
    a, b = compile_expr(c.left, s), compile_expr(c.right, s)
    errors = errors_of(a, b)
    if c.op in ("eq", "ne"):
        out = equal_strict(a, b)
        return Val(out if c.op == "eq" else ~out, BOOL, None, errors)
    if c.op == "match":
        return matched(a, b, errors)
    gone = either(a.missing, b.missing, a.col.isNull(), b.col.isNull())
    if isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType):
        if any(isinstance(v.literal, str) and parse_number(v.literal) is None for v in (a, b)):
            return Val(total(order(c.op, a.col, b.col), a, b), BOOL, None, (*errors, error(gone, "comparison requires two numbers or two strings")))
        na, nb = numeric_text(a), numeric_text(b)
        both = na.isNotNull() & nb.isNotNull()
        out = F.when(both, order(c.op, na, nb)).otherwise(order(c.op, a.col, b.col))
        return Val(F.coalesce(out, F.lit(False)), BOOL, None, (*errors, error(gone, "comparison requires two numbers or two strings")))
    if any(isinstance(v.type, TIMES) for v in (a, b)):
        a, b = timed(a), timed(b)
        return compile_text_order(c.op, a, b, errors, gone)
    if isinstance(a.type, T.LongType) and isinstance(b.type, T.LongType):
        out, bad = total(order(c.op, a.col, b.col), a, b), gone
    else:
        na, nb = as_number(a), as_number(b)
        texts = [n.isNull() for n, v in ((na, a), (nb, b)) if isinstance(v.type, (T.StringType, T.NullType))]
        out, bad = F.coalesce(order(c.op, na, nb), F.lit(False)) if texts else total(order(c.op, na, nb), a, b), either(gone, *texts)
    return Val(out, BOOL, None, (*errors, error(bad, "comparison requires two numbers or two strings")))


def total(cond: Column, *vals: Val) -> Column:
    """A comparison as plain conjuncts that are never null: those reach the scan."""
    for v in vals:
        if v.literal is MISSING:
            cond = cond & v.col.isNotNull()
        if v.missing is not None:
            cond = cond & ~v.missing
    return cond


def compile_text_order(op: str, a: Val, b: Val, errors: tuple, gone: Column) -> Val:
    if not (isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType)):
        raise NotTyped("a time beside something else than text")
    return Val(total(order(op, a.col, b.col), a, b), BOOL, None, (*errors, error(gone, "comparison requires two numbers or two strings")))


def timed(v: Val) -> Val:
    """Times are texts in JSON."""
    if isinstance(v.type, T.DateType):
        return v._replace(col=F.date_format(v.col, "yyyy-MM-dd"), type=STRING)
    return v._replace(col=F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss"), type=STRING) if isinstance(v.type, TIMES) else v


def order(op: str, a: Column, b: Column) -> Column:
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def equal_strict(a: Val, b: Val) -> Column:
    """Kinds must agree; integer and float columns are compared as numbers."""
    a, b = timed(a), timed(b)
    if isinstance(a.type, T.NullType) or isinstance(b.type, T.NullType):
        return value(a).isNull() & value(b).isNull()
    numbers = (T.LongType, T.DoubleType)
    if not _same(a.type, b.type) and not (isinstance(a.type, numbers) and isinstance(b.type, numbers)):
        if isinstance(a.type, (T.ArrayType, T.StructType, T.MapType)) or isinstance(b.type, (T.ArrayType, T.StructType, T.MapType)):
            raise NotTyped("equality of arrays or objects of different types")
        return value(a).isNull() & value(b).isNull()
    return value(a).eqNullSafe(value(b))


def numeric_text(v: Val) -> Column:
    if isinstance(v.literal, str):
        return F.lit(parse_number(v.literal)).cast("double")
    return X.parse_float(v.col)


def as_number(v: Val) -> Column:
    """Double; null where it is no number."""
    if isinstance(v.type, T.StringType):
        return numeric_text(v)
    if isinstance(v.type, T.DoubleType):
        return v.col
    if isinstance(v.type, T.LongType):
        return F.lit(float(v.literal)) if isinstance(v.literal, int) else v.col.cast("double")
    if isinstance(v.type, T.NullType):
        return F.lit(None).cast("double")
    raise NotTyped(f"{v.type.simpleString()} as a number")


def pattern_of(v: Val) -> str:
    if not isinstance(v.literal, str):
        raise NotTyped("a pattern that is not constant")
    try:
        regex(v.literal)
    except Exception as x:
        raise NotTyped(f"pattern: {x}") from x
    return v.literal


def matched(a: Val, b: Val, errors: tuple) -> Val:
    if not isinstance(a.type, T.StringType):
        raise NotTyped("match of something else than a string")
    bad = either(a.missing, a.col.isNull())
    return Val(total(a.col.rlike(pattern_of(b)), a), BOOL, None, (*errors, error(bad, "match requires strings")))


def text_of(v: Val, version: int) -> Column:
    v = timed(v)
    if isinstance(v.type, T.StringType):
        return v.col
    if isinstance(v.type, T.DoubleType):
        return X.float_text(v.col, version)
    if isinstance(v.type, (T.LongType, T.BooleanType)):
        return v.col.cast("string")
    raise NotTyped(f"{v.type.simpleString()} as text")


# arrays


def elements(v: Val) -> Val:
    """An array subject; missing and null are empty."""
    if not isinstance(v.type, T.ArrayType):
        raise NotTyped(f"{v.type.simpleString()} as an array")
    none = F.array().cast(v.type)
    return Val(F.coalesce(value(v), none), v.type, None, v.errors)


class Each(NamedTuple):
    """A body over the elements of an array."""

    at: Callable[[Column, Column], Val]  # of an element and its index
    values: Column  # of every element; null where missing
    gone: bool  # whether some may be missing
    type: T.DataType
    errors: tuple[Error, ...]


def each(s: Scope, arr: Val, body: Callable[[Scope], Val]) -> Each:
    def at(x: Column, i: Column) -> Val:
        item = Val(x, arr.type.elementType)
        return body(replace(s, item=item, pipe=item, index=Val(i.cast("bigint"), LONG), stage=None))

    probe = at(F.col("x"), F.col(PLACE))
    errors = []
    for n, e in enumerate(probe.errors):
        errors.append(Error(any_element(arr.col, lambda x, i: at(x, i).errors[n].cond, PLACE in repr(e.cond)), e.kind, e.message))  # noqa: B023
    return Each(at, F.transform(arr.col, lambda x, i: value(at(x, i))), probe.missing is not None, probe.type, tuple(errors))


def any_element(arr: Column, cond: Callable[[Column, Column], Column], placed: bool) -> Column:
    if not placed:
        return F.exists(arr, lambda x: F.coalesce(cond(x, F.lit(0)), F.lit(False)))
    return F.exists(F.transform(arr, lambda x, i: F.coalesce(cond(x, i), F.lit(False))), lambda b: b)


def compile_map(s: Scope, v: Val, body: Callable[[Scope], Val], version: int) -> Val:
    if version == 1:
        arr = elements(v)
        got = each(s, arr, body)
        return Val(got.values, T.ArrayType(got.type), None, (*v.errors, *got.errors))
    if not isinstance(v.type, T.ArrayType):
        raise NotTyped("map of something else than an array")
    got = each(s, Val(F.coalesce(v.col, F.array().cast(v.type)), v.type), body)
    out = got.values
    if got.gone:
        def row(x: Column, i: Column) -> Column:
            y = got.at(x, i)
            return F.struct(y.col.alias("v"), (F.lit(False) if y.missing is None else y.missing).alias("gone"))

        some = F.coalesce(v.col, F.array().cast(v.type))
        out = F.transform(F.filter(F.transform(some, row), lambda r: ~r["gone"]), lambda r: r["v"])
    return Val(out, T.ArrayType(got.type), v.missing, (*v.errors, error(is_null(v), "map requires array"), *got.errors))


def predicate(got: Each) -> Callable[[Column, Column], Column]:
    if not isinstance(got.type, (T.BooleanType, T.NullType)):
        raise NotTyped("a predicate that is not boolean")
    return lambda x, i: F.coalesce(value(got.at(x, i)).cast("boolean"), F.lit(False))


def keys_of(keys: Column, t: T.DataType, s: Scope) -> Column:
    """The keys of all elements, which the result and the errors read."""
    return staged(Val(keys, T.ArrayType(t)), s).col


def int_arg(v: Val) -> int:
    n = to_int(v.literal) if v.literal is not MISSING else None
    if n is None:
        raise NotTyped("an argument that is not a constant integer")
    return n


def str_arg(v: Val) -> str:
    if not isinstance(v.literal, str):
        raise NotTyped("an argument that is not a constant string")
    return v.literal


def numbers(v: Val) -> tuple[Val, Column, tuple[Error, ...]]:
    arr = elements(v)
    one = lambda x: as_number(Val(x, arr.type.elementType))
    return arr, arr.col if arr.type.elementType == DOUBLE else F.transform(arr.col, one), (*v.errors, error(F.exists(arr.col, lambda x: one(x).isNull()), "operand must be a number or numeric string"))


def whole(c: Column, source: T.DataType) -> tuple[Column, T.DataType]:
    """Version 1 numbers are integers when integral: exact for integer sources,
    else the column stays double."""
    return (c.cast("bigint"), LONG) if isinstance(source, T.LongType) else (c, DOUBLE)


def compile_arrays(e: Call, s: Scope, x: Val) -> Val:
    op = e.op
    if op in ("sum", "avg", "min", "max"):
        arr, nums, errors = numbers(x)
        n = F.size(arr.col)
        got = {"sum": lambda: F.aggregate(nums, F.lit(0.0), lambda a, b: a + b), "avg": lambda: F.aggregate(nums, F.lit(0.0), lambda a, b: a + b) / F.nullif(n, F.lit(0)), "min": lambda: F.array_min(nums), "max": lambda: F.array_max(nums)}[op]()
        col, t = (got, DOUBLE) if op == "avg" else whole(got, arr.type.elementType)
        return Val(F.when(n > 0, col), t, None, errors)
    if op == "map":
        return compile_map(s, x, lambda t: compile_expr(e.args[0], t), e.version)
    if op in ("first", "last"):
        if not isinstance(x.type, T.ArrayType):
            raise NotTyped(f"{op} of something else than an array")
        n = F.size(x.col)
        got = F.get(x.col, F.lit(0) if op == "first" else n - 1)
        return Val(got, x.type.elementType, either(x.missing, F.coalesce(n == 0, F.lit(False))), (*x.errors, error(is_null(x), f"{op} requires array")))
    arr = elements(x)
    element = arr.type.elementType
    if op in ("filter", "partition", "find", "find_index", "flat_map", "group_by", "key_by", "distinct_by", "sort_by"):
        got = each(s, arr, lambda t: compile_expr(e.args[0], t))
        errors = (*x.errors, *got.errors)
        if op == "flat_map":
            if isinstance(got.type, T.ArrayType):
                return Val(F.flatten(got.values), got.type, None, errors)
            return Val(got.values, T.ArrayType(got.type), None, errors)
        if op in ("filter", "partition", "find", "find_index"):
            fits = predicate(got)
            keep = F.filter(arr.col, fits)
            if op == "filter":
                return Val(keep, arr.type, None, errors)
            if op == "find":
                return Val(F.get(keep, F.lit(0)), element, None, errors)
            if op == "find_index":
                return Val(F.coalesce(F.array_position(F.transform(arr.col, fits), F.lit(True)), F.lit(0)).cast("bigint") - 1, LONG, None, errors)
            return Val(F.array(keep, F.filter(arr.col, lambda y, i: ~fits(y, i))), T.ArrayType(arr.type), None, errors)
        if op == "sort_by":
            if not isinstance(got.type, (T.StringType, T.LongType, T.DoubleType, T.BooleanType)):
                raise NotTyped("sort keys without order")
            order_ = str_arg(compile_expr(e.args[1], s)) if len(e.args) > 1 else "asc"
            keys = keys_of(got.values, got.type, s)
            bad = F.exists(keys, lambda k: k.isNull())
            return Val(X.sort_by(arr.col, keys, order_ == "desc"), arr.type, None, (*errors, error(bad, "sort_by keys must be strings, numbers or booleans of one kind")))
        names = keys_of(F.transform(got.values, lambda k: text_of(Val(k, got.type), 1)), STRING, s)
        errors = (*errors, error(F.exists(names, lambda k: k.isNull()), "key must not be null"))
        if op == "distinct_by":
            return Val(X.distinct(arr.col, names), arr.type, None, errors)
        fine = F.transform(names, lambda k: F.coalesce(k, F.lit("")))
        if op == "key_by":
            return Val(X.last_wins(fine, arr.col), T.MapType(STRING, element), None, errors)
        return Val(X.grouped(fine, arr.col), T.MapType(STRING, arr.type), None, errors)
    if op == "reduce":
        start = Val(F.get(arr.col, F.lit(0)), element)
        return fold(s, e.args[0], F.slice(arr.col, 2, F.greatest(F.size(arr.col) - 1, F.lit(0))), element, start, 1, x.errors)
    if op == "fold":
        start = compile_expr(e.args[0], s)
        out = fold(s, e.args[1], arr.col, element, start, 0, (*x.errors, *start.errors))
        return out._replace(missing=start.missing)
    if op == "zip_with":
        others = [elements(compile_expr(a, s)) for a in e.args[:-1]]
        rows = zipped([arr, *others])
        got = each(s, rows, lambda t: compile_expr(e.args[-1], t))
        return Val(got.values, T.ArrayType(got.type), None, (*x.errors, *errors_of(*others), *got.errors))
    args = [compile_expr(a, s) for a in e.args]
    errors = (*x.errors, *errors_of(*args))
    if op == "zip":
        return zipped([arr, *[elements(a) for a in args]])._replace(errors=errors)
    if op == "unzip":
        if not isinstance(element, T.ArrayType):
            raise NotTyped("unzip of rows that are not arrays")
        wide = lambda a: F.size(F.get(a, F.lit(0)))
        bad = X.let(wide(arr.col), lambda width: F.exists(arr.col, lambda r: r.isNull() | (F.size(r) != width)))
        cols = lambda a: F.transform(F.sequence(F.lit(0), F.greatest(wide(a) - 1, F.lit(0))), lambda i: F.transform(a, lambda r: F.get(r, i)))
        return Val(X.let(arr.col, lambda a: F.when((F.size(a) > 0) & (wide(a) > 0), cols(a)).otherwise(F.slice(cols(a), 1, 0))), T.ArrayType(element), None, (*errors, error(bad, "unzip rows must be arrays of one length")))
    if op == "flatten":
        depth = int_arg(args[0]) if args else 1
        out = arr
        for _ in range(depth):
            if not isinstance(out.type.elementType, T.ArrayType):
                break
            out = Val(F.flatten(out.col), out.type.elementType)
        return out._replace(errors=errors)
    if op in ("take", "drop"):
        n = int_arg(args[0])
        col = X.slice_range(arr.col, *{("take", True): (0, n), ("take", False): (n, None), ("drop", True): (n, None), ("drop", False): (0, n)}[op, n >= 0])
        return Val(col if -(2**31) < n < 2**31 else arr.col if op == "take" else F.slice(arr.col, 1, 0), arr.type, None, errors)
    if op == "slice":
        return Val(X.slice_range(arr.col, int_arg(args[0]), int_arg(args[1]) if len(args) > 1 else None), arr.type, None, errors)
    if op == "chunk":
        n = int_arg(args[0])
        if n < 1:
            return Val(F.array().cast(T.ArrayType(arr.type)), T.ArrayType(arr.type), None, (*errors, error(F.lit(True), "chunk size must be positive")))
        return Val(X.chunk(arr.col, n), T.ArrayType(arr.type), None, errors)
    if op == "unique":
        if isinstance(element, (T.StringType, T.LongType, T.BooleanType)):  # equal where their texts are
            return Val(F.array_distinct(arr.col), arr.type, None, errors)
        names = F.transform(arr.col, lambda y: text_of(Val(y, element), 1))
        return Val(X.distinct(arr.col, names), arr.type, None, errors)
    if op in ("index_of", "contains"):
        want = args[0] if isinstance(args[0].type, T.NullType) else Val(text_of(args[0], 1), STRING, args[0].missing)
        needle = value(want).cast("string")
        same = lambda y, n: text_of(Val(y, element), 1).eqNullSafe(n)
        if op == "contains":
            return Val(X.let(needle, lambda n: F.exists(arr.col, lambda y: same(y, n))), BOOL, None, errors)
        flags = X.let(needle, lambda n: F.transform(arr.col, lambda y: same(y, n)))
        return Val(F.coalesce(F.array_position(flags, F.lit(True)), F.lit(0)).cast("bigint") - 1, LONG, None, errors)
    raise NotTyped(op)


def zipped(arrs: list[Val]) -> Val:
    """Rows of the shortest length; the elements have one type."""
    t = common([a.type.elementType for a in arrs])
    cols = [a.col.cast(T.ArrayType(t)) for a in arrs]
    n = F.least(*[F.size(c) for c in cols]) if len(cols) > 1 else F.size(cols[0])

    def rows(others: tuple[Column, ...]) -> Column:
        if len(others) < len(cols) - 1:
            return X.let(cols[len(others) + 1], lambda c: rows((*others, c)))
        return F.transform(F.slice(cols[0], 1, n), lambda x, i: F.array(x, *[F.get(c, i) for c in others]))

    return Val(rows(()), T.ArrayType(T.ArrayType(t)))


def null_where_bad(body: Any) -> bool:
    """Whether a step that fails, and any step after it, gives null: a result that
    is not null then tells that no step failed."""
    first, calls = (body.start, body.steps) if isinstance(body, Pipe) else (body.subject, (body,)) if isinstance(body, Call) else (None, ())
    here = lambda a: isinstance(a, Lit) or isinstance(a, Ref) and a.ns in ("item", "acc", "index") and not a.path
    return first == Ref("acc") and all(isinstance(c, Call) and (c is body or c.subject is None) and c.op in ("concat", "+", "-", "*", "/") and all(map(here, c.args)) for c in calls)


def fold(s: Scope, body: Any, items: Column, element: T.DataType, start: Val, first: int, errors: tuple) -> Val:
    def step(acc: Column, x: Column, i: Column, t: T.DataType) -> Val:
        item = Val(x, element)
        return compile_expr(body, replace(s, item=item, pipe=item, index=Val(i.cast("bigint"), LONG), acc=Val(acc, t), stage=None))

    t = start.type
    for _ in range(3):  # the accumulator's type settles: null, then integer, then float
        got = common([t, step(F.col("a"), F.col("x"), F.lit(0), t).type])
        if _same(got, t):
            break
        t = got
    if isinstance(t, T.NullType):
        raise NotTyped("an accumulator without a type")
    # the state carries the accumulator and whether a step failed
    probe = step(F.col("a"), F.col("x"), F.col(PLACE), t)
    n = len(probe.errors)
    placed = any(PLACE in repr(c) for c in (value(probe), *[e.cond for e in probe.errors]))
    rows = F.transform(items, lambda x, i: F.struct(x.alias("x"), (i + first).alias("i"))) if placed else items
    state = lambda a, bad: F.struct(a.cast(t).alias("a"), bad.alias("bad"))

    def go(acc: Column, row: Column) -> Column:
        v = step(acc["a"], row["x"], row["i"], t) if placed else step(acc["a"], row, F.lit(0), t)
        return state(value(v), acc["bad"] | failed(v.errors))

    if not n or null_where_bad(body) and probe.missing is None:
        plain = lambda acc, row: value(step(acc, row["x"], row["i"], t) if placed else step(acc, row, F.lit(0), t)).cast(t)
        got = F.aggregate(rows, value(start).cast(t), plain)
        if not n:
            return Val(got, t, None, errors)
        got = got if s.stage is None else s.stage(Val(got, t)).col
        bad = F.when(got.isNull(), F.aggregate(rows, state(value(start), F.lit(False)), go)["bad"])
        return Val(got, t, None, (*errors, error(bad, "operand is not valid in reduce or fold")))
    out = F.aggregate(rows, state(value(start), F.lit(False)), go)
    if s.stage is not None:
        out = s.stage(Val(out, T.StructType([T.StructField("a", t), T.StructField("bad", BOOL)]))).col
    return Val(out["a"], t, None, (*errors, error(out["bad"], "operand is not valid in reduce or fold")))


# objects


def fields_of(v: Val) -> dict[str, Val]:
    if not isinstance(v.type, T.StructType):
        raise NotTyped(f"{v.type.simpleString()} as an object")
    return {f.name: Val(v.col.getField(f.name), f.dataType) for f in v.type.fields}


def object_paths(args: list[Val]) -> list[tuple]:
    out = []
    for a in args:
        for p in a.literal if isinstance(a.literal, list) else [str_arg(a)]:
            try:
                out.append(path_tokens(p))
            except (Fault, TypeError) as x:
                raise NotTyped(str(x)) from x
    return list(dict.fromkeys(out))


def compile_objects(e: Call, s: Scope, x: Val) -> Val:
    op = e.op
    args = [compile_expr(a, s) for a in e.args]
    errors = (*x.errors, *errors_of(*args))
    nothing = error(is_null(x), "expr arg must not be null")
    if op == "get":
        (p,) = object_paths(args)
        if isinstance(x.type, T.NullType):
            return absent()
        got = field(x, p)
        return got._replace(missing=either(got.missing, x.missing, x.col.isNull()), errors=errors)
    if op == "from_entries":
        return from_entries(x, args, errors)
    if op == "len":
        if isinstance(x.type, T.StructType):
            n = F.lit(len(x.type.fields))
        elif isinstance(x.type, T.StringType):
            n = F.length(x.col)
        elif isinstance(x.type, (T.ArrayType, T.MapType)):
            n = F.size(x.col)
        else:
            raise NotTyped("len of a scalar")
        return Val(n.cast("bigint"), LONG, x.missing, (*errors, nothing))
    if isinstance(x.type, T.MapType) and op in ("keys", "values", "entries"):
        if op == "keys":
            return Val(F.sort_array(F.map_keys(x.col)), T.ArrayType(STRING), x.missing, (*errors, nothing))
        if op == "values":
            return Val(X.by_key(x.col, lambda _, v: v), T.ArrayType(x.type.valueType), x.missing, (*errors, nothing))
        t = T.StructType([T.StructField("key", STRING), T.StructField("value", x.type.valueType)])
        return Val(X.by_key(x.col, lambda k, v: F.struct(k.alias("key"), v.alias("value"))), T.ArrayType(t), x.missing, (*errors, nothing))
    if isinstance(x.type, T.MapType) and op == "merge" and all(isinstance(a.type, T.MapType) for a in args):
        out = x.col
        for a in args:
            out = X.let(a.col, lambda m: F.map_concat(F.map_filter(out, lambda k, _: ~F.map_contains_key(m, k)), m))  # noqa: B023
        return Val(out, x.type, x.missing, (*errors, nothing))
    if op in ("merge", "deep_merge"):
        out: dict = {}
        for v in (x, *args):
            if v.missing is not None:
                raise NotTyped("merge of an object that may be missing")
            out = merged(out, fields_of(v), op == "deep_merge")
        bad = either(*[v.col.isNull() for v in (x, *args)])
        return struct(dict(sorted(out.items())))._replace(errors=(*errors, error(bad, "expr arg must be object")))
    fields = dict(sorted(fields_of(x).items()))
    errors = (*errors, nothing)
    if op == "keys":
        return Val(F.array(*[F.lit(k) for k in fields]), T.ArrayType(STRING), x.missing, errors)
    if op in ("values", "entries"):
        parts = unify(list(fields.values()))
        if op == "values":
            return Val(F.array(*[p.col for p in parts]), T.ArrayType(parts[0].type), x.missing, errors)
        t = T.StructType([T.StructField("key", STRING), T.StructField("value", parts[0].type)])
        return Val(F.array(*[F.struct(F.lit(k).alias("key"), p.col.alias("value")) for k, p in zip(fields, parts, strict=True)]), T.ArrayType(t), x.missing, errors)
    if op in ("pick", "omit"):
        ps = object_paths(args)
        if any(isinstance(k, int) for p in ps for k in p):
            raise NotTyped("paths with indexes")
        out = picked(fields, ps) if op == "pick" else omitted(fields, ps)
        if not out:
            raise NotTyped("an empty object")
        return struct(out)._replace(missing=x.missing, errors=errors)
    if op == "object_flatten":
        return struct(dict(sorted(flat(fields, "").items())))._replace(missing=x.missing, errors=errors)
    if op == "object_unflatten":
        tree: dict = {}
        for k, v in fields.items():
            at, p = tree, path_tokens(k)
            for key in p[:-1]:
                at = at.setdefault(key, {})
                if not isinstance(at, dict):
                    raise NotTyped("paths conflict")
            if p[-1] in at:
                raise NotTyped("paths conflict")
            at[p[-1]] = v
        return tree_value(tree)._replace(missing=x.missing, errors=errors)
    raise NotTyped(op)


def merged(a: dict, b: dict, deep: bool) -> dict:
    out = dict(a)
    for k, v in b.items():
        if deep and k in out and isinstance(v.type, T.StructType) and isinstance(out[k].type, T.StructType):
            v = struct(dict(sorted(merged(fields_of(out[k]), fields_of(v), True).items())))
        out[k] = v
    return out


def picked(fields: dict[str, Val], ps: list[tuple]) -> dict[str, Val]:
    out: dict[str, Val] = {}
    for k in dict.fromkeys(p[0] for p in ps):
        if k not in fields:
            continue
        below = [p[1:] for p in ps if p[0] == k]
        if () in below:
            out[k] = fields[k]
        elif inner := picked(fields_of(fields[k]), below):
            out[k] = struct(inner)
    return dict(sorted(out.items()))


def omitted(fields: dict[str, Val], ps: list[tuple]) -> dict[str, Val]:
    out = {}
    for k, v in fields.items():
        below = [p[1:] for p in ps if p[0] == k]
        if () in below:
            continue
        if below and isinstance(v.type, T.StructType):
            inner = omitted(fields_of(v), below)
            if not inner:
                raise NotTyped("an empty object")
            v = struct(inner)
        out[k] = v
    return out


def flat(fields: dict[str, Val], before: str) -> dict[str, Val]:
    out = {}
    for k, v in fields.items():
        name = '["' + k.replace("\\", "\\\\").replace('"', '\\"') + '"]' if "." in k else k
        at = before + ("." if before and not name.startswith("[") else "") + name
        if isinstance(v.type, T.StructType) and v.type.fields:
            out |= flat(fields_of(v), at)
        else:
            out[at] = v
    return out


def from_entries(x: Val, args: list[Val], errors: tuple) -> Val:
    if args:
        return Val(F.create_map(text_of(x, 1), args[0].col), T.MapType(STRING, args[0].type), either(x.missing, args[0].missing), (*errors, error(is_null(x), "key must not be null")))
    if isinstance(x.type, (T.StructType, T.MapType)):
        return x
    arr = elements(x)
    t = arr.type.elementType
    if isinstance(t, T.StructType) and {"key", "value"} <= set(t.names):
        key, val, vt = (lambda p: text_of(Val(p["key"], t["key"].dataType), 1)), (lambda p: p["value"]), t["value"].dataType
    elif isinstance(t, T.ArrayType):
        key, val, vt = (lambda p: text_of(Val(F.get(p, F.lit(0)), t.elementType), 1)), (lambda p: F.get(p, F.lit(1))), t.elementType
    else:
        raise NotTyped("entries of another shape")
    keys = F.transform(arr.col, key)
    bad = F.exists(keys, lambda k: k.isNull())
    out = X.last_wins(F.transform(keys, lambda k: F.coalesce(k, F.lit(""))), F.transform(arr.col, val))
    return Val(out, T.MapType(STRING, vt), x.missing, (*errors, error(bad, "key must not be null")))


# scalars

ARRAYS = frozenset("sum avg min max map first last filter partition find find_index flat_map group_by key_by distinct_by sort_by reduce fold zip_with zip unzip flatten take drop slice chunk unique index_of contains".split())
OBJECTS = frozenset("get from_entries len keys values entries merge deep_merge pick omit object_flatten object_unflatten".split())


def compile_call(e: Call, s: Scope, x: Val | None) -> Val:
    op = e.op
    if op in ("lookup", "lookup_first"):
        if s.lookup is None:
            raise NotTyped("a lookup inside an array operation")
        return s.lookup(e, s)
    if op in ARRAYS:
        return compile_arrays(e, s, x)
    if op in OBJECTS:
        return compile_objects(e, s, x)
    args = [compile_expr(a, s) for a in e.args]
    vals = [x, *args]
    errors = errors_of(*vals)
    if op == "coalesce":
        parts = unify(vals)
        gone = F.lit(True)
        for p in parts:
            gone = gone & value(p).isNull()
        never = any(p.literal is not MISSING and p.literal is not None for p in parts)
        return Val(F.coalesce(*[value(p) for p in parts]), common([p.type for p in parts]), None if never else gone, errors)
    if op in ("and", "or"):
        return logic(op, vals)
    if op in ("==", "!="):
        a, b = (F.lit(None).cast("string") if isinstance(v.type, T.NullType) else text_of(v, 1) if v.missing is None else F.when(~v.missing, text_of(v, 1)) for v in vals)
        out = a.eqNullSafe(b)
        return Val(out if op == "==" else ~out, BOOL, None, errors)
    gone = either(*[v.missing for v in vals])
    null = either(*[v.col.isNull() for v in vals if v.literal is MISSING])
    if any(v.literal is None for v in vals):
        null = F.lit(True)
    if op == "to_string" and e.version == 2 and null is not None:
        if isinstance(x.type, (T.ArrayType, T.StructType, T.MapType)):
            raise NotTyped("text of an object")
        return Val(F.lit("null") if isinstance(x.type, T.NullType) else F.coalesce(text_of(x, 2), F.lit("null")), STRING, gone, errors)
    if null is not None:
        here = null if gone is None else ~gone & null
        errors = (*errors, error(here, "expr arg must not be null"))
    fine = Context(e, vals, gone, errors)
    return scalar(op, fine)


class Context(NamedTuple):
    call: Call
    vals: list[Val]
    gone: Column | None
    errors: tuple[Error, ...]

    def out(self, col: Column, t: T.DataType, *more: Error) -> Val:
        return Val(col, t, self.gone, (*self.errors, *more))

    def present(self, cond: Column) -> Column:
        """A condition that only counts where all operands are there."""
        here = [v.col.isNotNull() for v in self.vals if v.literal is MISSING]
        for h in here:
            cond = h & cond
        return cond if self.gone is None else ~self.gone & cond


def logic(op: str, vals: list[Val]) -> Val:
    out, errors = None, ()
    for v in vals:
        if not isinstance(v.type, (T.BooleanType, T.NullType)):
            raise NotTyped("a logical operand that is not boolean")
        undecided = F.lit(True) if out is None else F.coalesce(out != F.lit(op == "or"), F.lit(True))
        errors += (*guarded(undecided, v.errors), error(undecided & is_null(v), "expr arg must be boolean"))
        c = value(v).cast("boolean")
        out = c if out is None else (out & c) if op == "and" else (out | c)
    gone = either(*[v.missing for v in vals])
    return Val(out, BOOL, None if gone is None else out.isNull(), errors)


def scalar(op: str, c: Context) -> Val:
    x, args, v = c.vals[0], c.vals[1:], c.call.version
    if op == "concat":
        return c.out(F.concat(*[text_of(y, v) for y in c.vals]), STRING)
    if op in ("to_string", "string"):
        return c.out(text_of(x, v if op == "to_string" else 1), STRING)
    if op in ("trim", "lowercase", "uppercase"):
        if v == 1 and not isinstance(x.type, T.StringType):
            raise NotTyped(f"{op} of something else than a string")
        s = text_of(x, 2)
        return c.out({"trim": X.trim, "lowercase": F.lower, "uppercase": F.upper}[op](s), STRING)
    if op in ("int", "float", "bool"):
        return cast_value(x, op, c.gone, c.errors, "ExprError" if v == 1 else "TypeCastFailed")
    if op in ("replace", "split", "pad_start", "pad_end"):
        if not isinstance(x.type, T.StringType):
            raise NotTyped(f"{op} of something else than a string")
        return strings(op, c, x.col, args)
    if op in ("+", "-", "*", "/"):
        nums = [as_number(y) for y in c.vals]
        bad = [error(c.present(n.isNull()), "operand must be a number or numeric string") for n, y in zip(nums, c.vals, strict=True) if isinstance(y.type, T.StringType)]
        out = nums[0]
        for n, y in zip(nums[1:], args, strict=True):
            if op == "/":
                if y.literal is MISSING or not y.literal:
                    bad.append(error(c.present(n == 0), "division by zero"))
                    n = F.nullif(n, F.lit(0.0))
                out = out / n
            else:
                out = out + n if op == "+" else out - n if op == "-" else out * n
        integral = v == 1 and op != "/" and all(isinstance(y.type, T.LongType) for y in c.vals)
        return c.out(out.cast("bigint") if integral else out, LONG if integral else DOUBLE, *bad)
    if op == "round":
        scale = int_arg(args[0]) if args else 0
        if not 0 <= scale <= 308:
            raise NotTyped("scale out of range")
        n = as_number(x)
        bad = [error(c.present(n.isNull()), "operand must be a number or numeric string")] if isinstance(x.type, T.StringType) else []
        if scale == 0:
            return c.out(X.half_away(n, 0).cast("bigint"), LONG, *bad)
        return c.out(X.half_away(n, scale), DOUBLE, *bad)
    if op == "to_base":
        base = int_arg(args[0])
        if not 2 <= base <= 36:
            raise NotTyped("base out of range")
        n = integer_of(x)
        return c.out(F.lower(F.conv(n.cast("string"), 10, -base)), STRING, error(c.present(n.isNull()), "value must be an integer"))
    if op == "not":
        if not isinstance(x.type, T.BooleanType):
            raise NotTyped("not of something else than a boolean")
        return c.out(~x.col, BOOL)
    if op in ("<", "<=", ">", ">="):
        a, b = as_number(x), as_number(args[0])
        bad = error(c.present(a.isNull() | b.isNull()), "operand must be a number or numeric string")
        return c.out(order(op, a, b), BOOL, bad)
    if op == "~=":
        if not isinstance(x.type, T.StringType):
            raise NotTyped("match of something else than a string")
        return c.out(x.col.rlike(pattern_of(args[0])), BOOL)
    if op == "date_format":
        return date_text(c, x, args)
    if op == "to_unixtime":
        return unixtime(c, x, args)
    raise NotTyped(op)


def integer_of(v: Val) -> Column:
    if isinstance(v.type, T.LongType):
        return v.col
    if isinstance(v.type, T.DoubleType):
        return F.when((v.col == F.floor(v.col)) & (F.abs(v.col) < 2.0**63), v.col.cast("bigint"))
    if isinstance(v.type, T.StringType):
        return X.parse_int(v.col)
    raise NotTyped(f"{v.type.simpleString()} as an integer")


def cast_value(v: Val, kind: str, gone: Column | None, errors: tuple, error_kind: str = "TypeCastFailed") -> Val:
    """The declared type of a mapping and the cast operations; null stays null."""
    if isinstance(v.type, T.NullType):
        return v._replace(missing=gone, errors=errors)
    if kind == "string":
        return Val(text_of(v, 1), STRING, gone, errors)
    if kind == "int":
        out, t = integer_of(v) if not isinstance(v.type, T.BooleanType) else F.lit(None).cast("bigint"), LONG
    elif kind == "float":
        out, t = as_number(v) if not isinstance(v.type, T.BooleanType) else F.lit(None).cast("double"), DOUBLE
    else:
        t = BOOL
        out = v.col if isinstance(v.type, T.BooleanType) else X.parse_bool(v.col) if isinstance(v.type, T.StringType) else F.lit(None).cast("boolean")
    same = _same(t, v.type) or isinstance(v.type, T.LongType) and t == DOUBLE
    if same:
        return Val(out, t, gone, errors)
    bad = v.col.isNotNull() & out.isNull()
    return Val(out, t, gone, (*errors, Error(bad if gone is None else ~gone & bad, error_kind, f"value cannot be cast to {kind}")))


def strings(op: str, c: Context, s: Column, args: list[Val]) -> Val:
    if op == "split":
        by = str_arg(args[0])
        if not by:
            raise NotTyped("split by nothing")
        return c.out(F.split(s, X.literal_regex(by), -1), T.ArrayType(STRING))
    if op in ("pad_start", "pad_end"):
        n = int_arg(args[0])
        if n < 0:
            raise NotTyped("a negative length")
        return c.out(X.pad(s, n, str_arg(args[1]) if len(args) > 1 else " ", op == "pad_start"), STRING)
    mode = str_arg(args[2]) if len(args) > 2 else ""
    old, new = str_arg(args[0]), str_arg(args[1])
    if mode == "":
        return c.out(X.replace_first(s, old, new) if old else F.concat(F.lit(new), s), STRING)
    if mode == "all" and old:
        return c.out(F.replace(s, F.lit(old), F.lit(new)), STRING)
    if mode == "regex_all":
        return c.out(F.regexp_replace(s, pattern_of(args[0]), X.java_replacement(new)), STRING)
    if mode == "regex":
        return c.out(X.replace_regex_first(s, pattern_of(args[0]), new), STRING)
    raise NotTyped("a replace mode")


def zone_arg(v: Val) -> str:
    z = dates.offset(str_arg(v))
    if z is None:
        raise NotTyped("not a timezone")
    minutes = int(z.utcoffset(None).total_seconds() // 60)
    return f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"


def instant(x: Val, formats: list[str] | None, zone: str | None) -> tuple[Column, bool]:
    """A time as a wall clock of UTC or of ``zone``, and whether it is one of UTC."""
    if isinstance(x.type, TIMES):
        return x.col.cast("timestamp"), True
    if not isinstance(x.type, T.StringType):
        raise NotTyped("a date that is not text")
    if formats is None:
        # one look at the shape, one cast: dashes for slashes and for none at all
        iso = x.col.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})$")
        zoned = F.when(iso, F.regexp_replace(F.regexp_replace(x.col, "[Tt]", " "), r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
        dashed = F.translate(x.col, "/", "-")
        dashed = F.when(F.length(dashed) <= 8, F.regexp_replace(dashed, r"^(\d{4})(\d{2})(\d{1,2})$", "$1-$2-$3")).otherwise(dashed)
        local = F.when(x.col.rlike(dates.COMMON), dashed.try_cast("timestamp"))
        if zone and zone != "+00:00":
            local = F.to_utc_timestamp(local, zone)
        return F.when(iso, zoned).otherwise(local), True
    reads = []
    for f in formats:
        if "%z" in f or "%:z" in f:
            raise NotTyped("formats with a zone")
        p = X.spark_pattern(f.replace("%.f", ""))
        if p is None:
            raise NotTyped(f"format {f}")
        if "%.f" in f:
            reads.append(F.when(x.col.rlike(r"\.\d{1,9}$"), F.try_to_timestamp(x.col, F.lit(p + "[.SSSSSS][.SSS]"))))
        else:
            # texts of another shape are not tried: a failing parse is slow
            reads.append(F.when(x.col.rlike(dates.shape(f)), F.try_to_timestamp(x.col, F.lit(p))))
    local = F.coalesce(*reads)
    if zone and zone != "+00:00":
        local = F.to_utc_timestamp(local, zone)
    return local, True


def date_text(c: Context, x: Val, args: list[Val]) -> Val:
    formats = zone = None
    if len(args) == 3:
        formats, zone = format_list(args[1]), zone_arg(args[2])
    elif len(args) == 2:
        if isinstance(args[1].literal, str) and dates.is_zone(args[1].literal):
            zone = zone_arg(args[1])
        else:
            formats = format_list(args[1])
    p = X.spark_pattern(str_arg(args[0]))
    if p is None:
        raise NotTyped("an output format that Spark lacks")
    if zone is None and formats is None and isinstance(x.type, T.StringType) and "x" in p:
        raise NotTyped("the offset of each value is kept")
    ts, _ = instant(x, formats, zone)
    if zone is None and formats is None and isinstance(x.type, T.StringType):
        # a value with an offset keeps its wall clock
        clock = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(x.col, r"^(.*?)([Zz]|[+-]\d{2}:?\d{2})$", 1), "[Tt]", " "))
        offset = x.col.rlike(r"\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})$")
        ts = F.coalesce(F.when(offset, clock), ts)
    shown = F.from_utc_timestamp(ts, zone) if zone and zone != "+00:00" else ts
    text = p.replace("xxx", f"'{zone or '+00:00'}'").replace("xx", f"'{(zone or '+00:00').replace(':', '')}'")
    return c.out(F.date_format(shown, text), STRING, error(c.present(ts.isNull()), "date format is invalid"))


def format_list(v: Val) -> list[str]:
    if isinstance(v.literal, list) and v.literal and all(isinstance(f, str) and f for f in v.literal):
        return v.literal
    return [str_arg(v)]


def unixtime(c: Context, x: Val, args: list[Val]) -> Val:
    unit, zone = "s", None
    if len(args) == 1 and isinstance(args[0].literal, str) and dates.is_zone(args[0].literal):
        zone = zone_arg(args[0])
    elif args:
        unit = str_arg(args[0])
        zone = zone_arg(args[1]) if len(args) > 1 else None
    if unit not in ("s", "ms"):
        raise NotTyped("a unit")
    ts, _ = instant(x, None, zone)
    return c.out(F.unix_seconds(ts) if unit == "s" else F.unix_millis(ts), LONG, error(c.present(ts.isNull()), "date format is invalid"))

