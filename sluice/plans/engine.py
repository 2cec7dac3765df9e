"""Rules to DataFrames.

One rule becomes filters, joins for its lookups, and one select. Catalyst sees
plain columns, so filters and the columns that are read reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dynamic
from ..errors import EvalError
from ..functions import columns as X
from ..operators import lookup as L
from ..ship import ship
from ..values import MISSING, dumps, get_path
from .ast import All, Assert, Branch, Call, Compare, Finalize, Lit, Mapping, Mappings, Pipe, RecordWhen, Ref, Rule
from .compiler import BOOL, LONG, STRING, Error, NotTyped, Scope, Val, as_number, cast_value, choose, compile_cond, compile_expr, compile_steps, constant, either, elements, error, errors_of, failed, is_null, native, of_column, str_arg, struct, text_of, tree_value, unify, value

MODES = ("strict", "quarantine", "null")
#: The place of a record in the input, while lookups are joined.
ORDER = "_sluice_order"
#: Expressions whose text is as long are computed once, if outputs are read again.
LONG_EXPRESSION = 300
#: The text of a column that only names another.
PLAIN = re.compile(r"Column<'[\w`.]+'>$")


class Result:
    """Outputs and the rows that count."""

    def __init__(self, tree: dict, keep: Column) -> None:
        self.tree, self.keep = tree, keep


class Builder:
    """Compiles one rule against one DataFrame."""

    def __init__(self, df: DataFrame, context: Any) -> None:
        self.df = df
        #: joins of lookups and columns that are read again, in the order in which they were met
        self.pending: list[Callable[[DataFrame], DataFrame] | tuple[str, Column]] = []
        #: the outputs that some expression of the rule reads
        self.read_again: frozenset = frozenset()
        #: first matches by frame, key and wanted value: their name and the fields that are read
        self.shared: dict[tuple, tuple[str, dict[str | None, str]]] = {}
        self.frames = {k: v for k, v in context.items() if isinstance(v, DataFrame)} if isinstance(context, dict) else {}
        self.context = {k: v for k, v in context.items() if k not in self.frames} if isinstance(context, dict) else context
        self.columns = {f.name: f.dataType for f in df.schema.fields}
        self.errors: list[tuple[Error, str]] = []
        self.warnings: list[tuple[Column, str, str, str]] = []
        self.joins = self.staged = 0
        self.fallbacks: list[str] = []
        #: conditions known to hold before a join, for filters that can go first
        self.filters: list[Column] = []

    # scopes

    def input_scope(self) -> Scope:
        def field(name: str) -> Val | None:
            return of_column(F.col(f"`{name}`"), self.columns[name]) if name in self.columns else None

        def whole() -> Val:
            return struct({k: field(k) for k in sorted(self.columns)})

        return Scope(whole, field, self.context, {}, lookup=self.lookup, frames=frozenset(self.frames), stage=self.stage)

    def out_scope(self, tree: dict) -> Scope:
        def field(name: str) -> Val | None:
            v = tree.get(name)
            return v if v is None or isinstance(v, Val) else tree_value(v)

        return Scope(lambda: tree_value(tree), field, self.context, {}, lookup=self.lookup, frames=frozenset(self.frames), stage=self.stage)

    # lookups

    def lookup(self, e: Call, s: Scope) -> Val:
        first, args = e.op == "lookup_first", list(e.args)
        if e.version == 1:
            source, (key, want, *get) = e.subject, args
        elif len(args) == 4 or len(args) == 3 and self._is_array(args[0], s):
            source, key, want, *get = args
        else:
            source, (key, want, *get) = None, args
        key_name = str_arg(compile_expr(key, s))
        get_name = str_arg(compile_expr(get[0], s)) if get else None
        if e.version == 1 and any("." in (n or "") or "[" in (n or "") for n in (key_name, get_name)):
            raise NotTyped("a lookup by paths")
        w = compile_expr(want, s)
        ref = source if isinstance(source, Ref) and source.ns == "context" else s.pipe.literal if source is None and s.pipe is not None else None
        if isinstance(ref, Ref) and len(ref.path) == 1 and ref.path[0] in self.frames:
            if first:
                return self._first_of_frame(ref.path[0], key_name, get_name, w, e.version)
            return self._join(self._frame_side(ref.path[0], key_name, get_name, e.version), first, w, e.version)
        items = get_path(self.context, ref.path) if isinstance(ref, Ref) and self.context is not MISSING else ref if isinstance(ref, list) else None
        if isinstance(items, list):
            return self._join(self._list_side(items, key_name, get_name, w, e.version, first), first, w, e.version)
        arr = s.pipe if source is None else compile_expr(source, s)
        return self._in_record(arr, key_name, get_name, w, e.version, first, s.stage)

    def _is_array(self, e: Any, s: Scope) -> bool:
        if isinstance(e, Ref) and e.ns == "context":
            return e.path[:1] and e.path[0] in self.frames or isinstance(get_path(self.context, e.path), list)
        try:
            return isinstance(compile_expr(e, s).type, T.ArrayType)
        except NotTyped:
            return False

    def _frame_side(self, name: str, key: str, get: str | None, version: int) -> tuple[L.Side, T.DataType, T.DataType]:
        df = self.frames[name]
        types = {f.name: f.dataType for f in df.schema.fields}
        item = struct({k: of_column(F.col(f"`{k}`"), t) for k, t in sorted(types.items())}) if get is None else of_column(F.col(f"`{get}`"), types[get])
        df, kt, order = self._keyed(name, key, version, get is not None)
        return L.side_of_frame(df, "_lookup_key", item.col, order), kt, item.type

    def _keyed(self, name: str, key: str, version: int, known: bool) -> tuple[DataFrame, T.DataType, list[str] | None]:
        df = self.frames[name]
        types = {f.name: f.dataType for f in df.schema.fields}
        k = of_column(F.col(f"`{key}`"), types[key])
        kc, kt = (text_of(k, 1), STRING) if version == 1 else (k.col, k.type)
        if version == 1 and known:
            df = df.where(F.col(f"`{key}`").isNotNull())
        return df.withColumn("_lookup_key", kc), kt, [c for c in ("_ordinal",) if c in types] or None

    def _first_of_frame(self, name: str, key: str, get: str | None, want: Val, version: int) -> Val:
        """A field of the first match; all fields of one match come from one join."""
        types = {f.name: f.dataType for f in self.frames[name].schema.fields}
        item = lambda g: struct({k: of_column(F.col(f"`{k}`"), t) for k, t in sorted(types.items())}) if g is None else of_column(F.col(f"`{g}`"), types[g])
        keyed, kt, order = self._keyed(name, key, version, get is not None)
        w = self._wanted(want, kt, version)
        at = (name, key, version, get is None, repr(w))
        if "lambda" in at[-1] or at not in self.shared:  # the names of lambda variables are not the same twice
            self.joins += 1
            fields: dict[str | None, str] = {}
            self.shared[at] = f"_lookup{self.joins}", fields

            def matches() -> DataFrame:
                values = F.struct(*[item(g).col.alias(f) for g, f in fields.items()])
                return L.first_match(L.side_of_frame(keyed, "_lookup_key", values, order))

            self.pending.append(lambda df, to=self.shared[at][0]: L.attach(df, matches(), w, to))
        hit, fields = self.shared[at]
        field = fields.setdefault(get, f"f{len(fields)}")
        return Val(F.col(hit)["value"][field], item(get).type, F.col(hit).isNull(), self._want_errors(want, version))

    @staticmethod
    def _wanted(want: Val, kt: T.DataType, version: int) -> Column:
        w = text_of(want, 1) if version == 1 else want.col.cast(kt)
        return w if want.missing is None else F.when(~want.missing, w)

    @staticmethod
    def _want_errors(want: Val, version: int) -> tuple[Error, ...]:
        return (*want.errors, *([error(is_null(want), "lookup match must not be null")] if version == 1 else []))

    def attached(self) -> DataFrame:
        """The input with all lookups and columns, each after those that it may read."""
        df, level, waiting = self.df, {}, {}
        for step in [*self.pending, lambda df: df]:
            if isinstance(step, tuple):  # one projection for all columns that read the same ones
                name, col = step
                level[name] = 1 + max((level.get(n, 0) for n in re.findall(r"\b_out\d+\b", repr(col))), default=0)
                waiting.setdefault(level[name], {})[name] = col
                continue
            for _, cols in sorted(waiting.items()):
                df = df.withColumns(cols)
            waiting = {}
            df = step(df)
        return df

    def stage(self, v: Val) -> Val:
        """A computed value as a column of its own."""
        if v.literal is not MISSING or isinstance(v.type, T.NullType) or PLAIN.match(repr(v.col)):
            return v
        self.staged += 1
        name = f"_out{self.staged}"
        self.pending.append((name, v.col))
        return v._replace(col=F.col(name))

    def once(self, v: Val) -> Val:
        """A long expression as a column of its own, which later ones read."""
        return v if len(repr(v.col)) < LONG_EXPRESSION else self.stage(v)

    def _list_side(self, items: list, key: str, get: str | None, want: Val, version: int, first: bool) -> tuple[L.Side, T.DataType, T.DataType]:
        rows, kt = [], want.type
        for i, x in enumerate(items):
            if not isinstance(x, dict) or key not in x or x[key] is None or isinstance(x[key], (dict, list)):
                continue
            k = x[key]
            if version == 1:
                k = dynamic.text(k, 1)
            else:
                t = constant(k).type
                both = isinstance(t, (type(LONG), T.DoubleType)) and isinstance(kt, (type(LONG), T.DoubleType))
                if t != kt and not both:
                    continue  # strict equality of different kinds
                k = float(k) if isinstance(kt, T.DoubleType) else k
                if isinstance(kt, T.LongType) and isinstance(k, float):
                    continue
            if get is None:
                rows.append((i, k, x))
            elif get in x:
                rows.append((i, k, x[get]))
            elif version == 2 and first:
                rows.append((i, k, MISSING))
        vt = _type_of([r[2] for r in rows if r[2] is not MISSING])
        seen = set()
        if version == 2 and first:  # the first key decides, even if it lacks the value
            rows = [r for r in rows if not (r[1] in seen or seen.add(r[1]))]
        rows = [(i, k, _shape(v, vt)) for i, k, v in rows if v is not MISSING]
        key_type = STRING if version == 1 else kt
        return L.side_of_rows(self.df.sparkSession, rows, key_type, vt), key_type, vt

    def _join(self, side: tuple[L.Side, T.DataType, T.DataType], first: bool, want: Val, version: int) -> Val:
        rows, kt, vt = side
        self.joins += 1
        name = f"_lookup{self.joins}"
        key = self._wanted(want, kt, version)
        self.pending.append(lambda df: L.attach(df, L.first_match(rows) if first else L.all_matches(rows), key, name))
        hit = F.col(name)
        errors = self._want_errors(want, version)
        if first:
            return Val(hit["value"], vt, hit.isNull(), errors)
        t = T.ArrayType(vt)
        return Val(hit, t, hit.isNull(), errors) if version == 1 else Val(F.coalesce(hit, F.array().cast(t)), t, None, errors)

    @staticmethod
    def _in_record(arr: Val, key: str, get: str | None, want: Val, version: int, first: bool, stage: Callable[[Val], Val] | None) -> Val:
        if not isinstance(arr.type, T.ArrayType) or not isinstance(arr.type.elementType, T.StructType) or key not in arr.type.elementType.names:
            raise NotTyped("a lookup in something else than an array of objects")
        t = arr.type.elementType
        k = lambda x: Val(x[key], t[key].dataType)
        if version == 1:
            hits = F.filter(elements(arr).col, lambda x: text_of(k(x), 1) == text_of(want, 1))
        else:
            hits = F.filter(elements(arr).col, lambda x: x[key].eqNullSafe(value(want).cast(t[key].dataType)))
        if stage is not None:
            hits = stage(Val(hits, arr.type)).col
        vt = t if get is None else t[get].dataType
        out = hits if get is None else F.transform(hits, lambda x: x[get])
        errors = (*arr.errors, *want.errors)
        if first:
            return Val(F.get(out, F.lit(0)), vt, F.size(hits) == 0, errors)
        return Val(out, T.ArrayType(vt), F.size(hits) == 0 if version == 1 else None, errors)

    # steps

    def report(self, errors: tuple[Error, ...], live: Column, path: str) -> None:
        self.errors += [(Error(live & e.cond, e.kind, e.message), path) for e in errors]

    def run(self, steps: tuple, scope: Scope, tree: dict, live: Column, top: bool) -> Result:
        """``tree`` is what earlier steps wrote; ``live`` are the rows that come here."""
        keep = F.lit(True)
        for n, s in enumerate(steps):
            if isinstance(s, Mappings):
                for m in s.items:
                    self.mapping(m, tree, scope, live & keep)
                continue
            path = s.path
            c = compile_cond(s.cond, replace(scope, out=tree))
            if isinstance(s, RecordWhen):
                if s.strict:
                    self.report(c.errors, live & keep, path)
                    fine = c.col
                else:
                    self.warnings += [(live & keep & e.cond, e.kind, e.message, path) for e in c.errors]
                    # a comparison that fails is false, which only matters under a negation
                    fine = c.col if plain_terms(s.cond) else c.col & ~failed(c.errors)
                if top and n == 0 and not self.joins:
                    self.filters.append(fine)
                else:
                    keep = keep & fine
                continue
            self.report(c.errors, live & keep, path)
            if isinstance(s, Assert):
                self.report((Error(~c.col & ~failed(c.errors), "AssertionFailed", f"{s.code}: {s.message}"),), live & keep, path)
                continue
            yes, no = self.branch(s.then, tree, live & keep & c.col), self.branch(s.other, tree, live & keep & ~c.col)
            if s.returns:  # the rows that do not return go on
                other = no or self.run(steps[n + 1 :], scope, copy_tree(tree), live & keep & ~c.col, False)
                return Result(pick_tree(c.col, yes.tree, other.tree), keep & F.when(c.col, yes.keep).otherwise(other.keep))
            keep = keep & F.when(c.col, yes.keep).otherwise(no.keep if no else F.lit(True))
            tree = pick_tree(c.col, deep(tree, yes.tree), deep(tree, no.tree) if no else tree)
        return Result(tree, keep)

    def branch(self, rule: Rule | None, tree: dict, live: Column) -> Result | None:
        if rule is None:
            return None
        if rule.finalize is not None:
            raise NotTyped("a branch rule with finalize")
        return self.run(rule.steps, self.out_scope(tree), {}, live, False)

    def mapping(self, m: Mapping, tree: dict, scope: Scope, live: Column) -> None:
        s = replace(scope, out=tree)
        cond = None
        if m.when is not None:
            c = compile_cond(m.when, s)
            cond = c.col & ~failed(c.errors) if c.errors else c.col
            self.warnings += [(live & e.cond, e.kind, e.message, f"{m.path}.when") for e in c.errors]
            live = live & cond
        try:
            v = compile_expr(m.expr, s)
        except NotTyped as x:
            self.fallbacks.append(f"{m.path}: {x}")
            v = self.dynamic(m, s)
        if m.has_default and v.missing is not None:
            d = constant(m.default)
            a, b = unify([d, v])
            v = Val(F.when(v.missing, a.col).otherwise(b.col), a.type if not isinstance(a.type, T.NullType) else b.type, None, errors_of(v))
        if m.required:
            self.report((Error(value(v).isNull() & ~failed(v.errors), "MissingRequired", "required value is missing or null"),), live, m.path)
        if m.type:
            v = cast_value(v, m.type, v.missing, v.errors)
        self.report(v.errors, live, m.path)
        v = v._replace(errors=())
        if m.target[0] in self.read_again:
            v = self.once(v)
        if cond is not None:
            before = out_leaf(tree, m.target)
            if before is None:
                v = v._replace(missing=either(~cond, v.missing))
            else:
                v = choose(Val(cond, BOOL), v, before)._replace(errors=())
        put(tree, m.target, v)

    def dynamic(self, m: Mapping, s: Scope) -> Val:
        """One mapping in the record evaluator: it gets the fields that it reads as
        JSON and gives JSON; scalars of a declared type become columns again."""
        ship(self.df.sparkSession)
        expr, context, kind = m.expr, self.context, m.type
        uses = {r.path[0] if r.path else None for r in refs(expr) if r.ns == "input"}
        if any(r.ns == "context" and r.path[:1] and r.path[0] in self.frames for r in refs(expr)):
            raise NotTyped("a DataFrame of the context outside a lookup")
        if callable(s.input) and None in uses:
            inp = s.input()
        else:
            got = {k: s.field(k) for k in sorted(uses - {None})}
            inp = struct({k: v for k, v in got.items() if v is not None} or {"_": constant(True)})
        outs = tree_value(s.out) if any(r.ns == "out" for r in refs(expr)) and s.out else struct({"_": constant(True)})
        as_json = lambda v: F.to_json(v.col, {"ignoreNullFields": "false"})

        @F.pandas_udf("struct<value:string,missing:boolean,error:string>")
        def go(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            import json

            out = []
            for x, y in zip(a, b, strict=True):
                try:
                    r = dynamic.evaluate(expr, dynamic.Env(json.loads(x), context, json.loads(y)))
                    if r is not MISSING and kind:
                        r = dynamic.cast(r, kind)
                    plain_text = r if isinstance(r, str) and kind == "string" else None if r is None or r is MISSING else dumps(r)
                    out.append((plain_text, r is MISSING, None))
                except EvalError as x_:
                    out.append((None, False, f"{x_.kind}: {x_.message}"))
            return pd.DataFrame(out, columns=["value", "missing", "error"])

        r = go(as_json(inp), as_json(outs))
        t = {"int": LONG, "float": T.DoubleType(), "bool": BOOL}.get(kind, STRING)
        bad = Error(r["error"].isNotNull(), "ExprError", "the expression fails on this record")
        return Val(r["value"].cast(t), t, r["missing"], (bad,))


def plain_terms(c: Any) -> bool:
    """Conditions that are false where they fail: comparisons of references and constants, joined by ``all``."""
    if isinstance(c, All):
        return all(plain_terms(x) for x in c.conds)
    return isinstance(c, Compare) and all(isinstance(x, (Ref, Lit)) for x in (c.left, c.right))


def refs(e: Any) -> list[Ref]:
    if isinstance(e, Ref):
        return [e]
    if isinstance(e, tuple):
        return [r for x in e for r in refs(x)]
    return []


def _type_of(values: list) -> T.DataType:
    from .compiler import common

    types = []
    for v in values:
        if isinstance(v, dict):
            types.append(T.StructType([T.StructField(k, _type_of([x])) for k, x in sorted(v.items())]))
        elif isinstance(v, list):
            types.append(T.ArrayType(_type_of(v)))
        else:
            types.append(constant(v).type)
    structs = [t for t in types if isinstance(t, T.StructType)]
    if structs:
        names = sorted({n for t in structs for n in t.names})
        return T.StructType([T.StructField(n, common([t[n].dataType for t in structs if n in t.names])) for n in names])
    out = common(types)
    return STRING if isinstance(out, T.NullType) else out


def _shape(v: Any, t: T.DataType) -> Any:
    if isinstance(t, T.StructType):
        return None if v is None else tuple(_shape(v.get(f.name), f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return None if v is None else [_shape(x, t.elementType) for x in v]
    return float(v) if isinstance(t, T.DoubleType) and v is not None else v


# output trees


def copy_tree(t: dict) -> dict:
    return {k: v if isinstance(v, Val) else copy_tree(v) for k, v in t.items()}


def put(tree: dict, path: tuple, v: Val) -> None:
    for k in path[:-1]:
        nxt = tree.setdefault(k, {})
        if isinstance(nxt, Val):
            if not isinstance(nxt.type, T.StructType):
                raise EvalError("InvalidTarget", "target path conflicts with a value that is not an object", ".".join(map(str, path)))
            nxt = tree[k] = {f.name: Val(nxt.col.getField(f.name), f.dataType, nxt.missing) for f in nxt.type.fields}
        tree = nxt
    tree[path[-1]] = v


def out_leaf(tree: dict, path: tuple) -> Val | None:
    node: Any = tree
    for k in path:
        if not isinstance(node, dict) or k not in node:
            return None
        node = node[k]
    return node if isinstance(node, Val) else None


def deep(a: dict, b: dict) -> dict:
    """``b`` over ``a``; where ``b`` is missing, ``a`` stays."""
    out = copy_tree(a)
    for k, v in b.items():
        old = out.get(k)
        if isinstance(v, dict) and isinstance(old, dict):
            out[k] = deep(old, v)
        elif isinstance(v, Val) and v.missing is not None and isinstance(old, Val):
            out[k] = choose(Val(v.missing, BOOL), old, v._replace(missing=None))
        else:
            out[k] = v if isinstance(v, Val) else copy_tree(v)
    return out


def pick_tree(c: Column, a: dict, b: dict) -> dict:
    """Field by field; a field of one side is missing on the other."""
    out: dict = {}
    for k in dict.fromkeys((*a, *b)):
        x, y = a.get(k), b.get(k)
        if isinstance(x, dict) and isinstance(y, dict) or isinstance(x, dict) and y is None or x is None and isinstance(y, dict):
            out[k] = pick_tree(c, x or {}, y or {})
        elif isinstance(x, dict) or isinstance(y, dict):
            raise NotTyped(f"{k} is an object on one side of a branch only")
        elif x is y:
            out[k] = x
        else:
            gone = Val(F.lit(None), T.NullType(), F.lit(True))
            out[k] = choose(Val(c, BOOL), x or gone, y or gone)
    return out


# the plan of a rule


class Compiled:
    """A rule applied to a DataFrame; nothing has run yet."""

    def __init__(self, df: DataFrame, tree: dict, errors: list, warnings: list, fallbacks: list[str], rule: Rule, order: list[Column], context: Any, joined: bool) -> None:
        self.base, self.tree, self.errors, self.warnings, self.fallbacks, self.rule, self.order, self.context = df, tree, errors, warnings, fallbacks, rule, order, context
        #: whether lookups are joins, which may change the order of records
        self.joined = joined

    def message(self) -> Column | None:
        """The first error of a record as text, or null."""
        if not self.errors:
            return None
        return F.coalesce(*[F.when(F.coalesce(e.cond, F.lit(False)), F.lit(f"{e.kind}: {e.message} (path: {p})")) for e, p in self.errors])

    def columns(self) -> list[Column]:
        return [(value(v) if isinstance(v, Val) else value(tree_value(v))).alias(k) for k, v in self.tree.items()]

    def warning_column(self) -> Column:
        t = "array<struct<kind:string,message:string,path:string>>"
        if not self.warnings:
            return F.array().cast(t)
        one = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("kind"), F.lit(m).alias("message"), F.lit(p).alias("path"))) for c, k, m, p in self.warnings]
        return F.filter(F.array(*one), lambda x: x.isNotNull()).cast(t)

    def frame(self, mode: str = "strict", warnings: bool = False, keep_order: bool = False) -> DataFrame:
        """strict: the first bad record fails the job. quarantine: an ``_error`` column,
        null where a record is fine. null: an error is a null."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        df, bad = self.base, self.message()
        extra = [self.warning_column().alias("_warnings")] if warnings else []
        order = [c.alias(f"_ord{i}") for i, c in enumerate(self.order)] if keep_order else []
        cols = self.columns()
        if bad is not None and mode == "strict":
            # one projection for outputs and errors, which share what they compute: the partition's
            # number keeps Catalyst from moving the check below it as a second copy of everything
            fault = F.when(F.spark_partition_id() < 0, F.lit("")).otherwise(bad).alias("_fault")
            warned = self.warning_column().alias("_warnings")
            df = df.select(*cols, *order, *([warned] if warnings else []), fault)
            df = df.where(F.when(F.col("_fault").isNotNull(), F.raise_error(F.col("_fault")).cast("boolean")).otherwise(F.lit(True)))
            return df.drop("_fault")
        if bad is not None and mode == "quarantine":
            cols = [F.when(bad.isNull(), c).alias(n) for c, n in zip(cols, self.tree, strict=True)]
        if mode == "quarantine":
            extra.append((bad if bad is not None else F.lit(None).cast("string")).alias("_error"))
        return df.select(*cols, *order, *extra)

    def json(self, mode: str = "strict") -> DataFrame:
        """``value``: each record as JSON with sorted keys, missing fields left out."""
        df, bad = self.base, self.message()
        if bad is not None and mode == "strict":
            df = df.where(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(F.lit(True)))
        return df.select(json_text(self.tree).alias("value"))


def json_text(tree: dict) -> Column:
    """An object as text; a field that is missing is left out with its comma."""
    parts = []
    for k, v in sorted(tree.items()):
        if isinstance(v, dict):
            body, missing = json_text(v), None
        else:
            body, missing = json_value(v.col, v.type), v.missing
        pair = F.concat(F.lit(dumps(k) + ":"), body)
        parts.append(pair if missing is None else F.when(~missing, pair))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_value(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.NullType):
        return F.lit("null")
    if isinstance(t, T.StringType):
        out = F.concat(F.lit('"'), json_escape(c), F.lit('"'))
    elif isinstance(t, T.DoubleType):
        out = X.float_text(c, 2)
    elif isinstance(t, T.StructType):
        out = json_text({f.name: Val(c.getField(f.name), f.dataType) for f in t.fields})
    elif isinstance(t, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: json_value(x, t.elementType)), ","), F.lit("]"))
    elif isinstance(t, T.MapType):
        pairs = X.by_key(c, lambda k, v: F.concat(json_value(k, T.StringType()), F.lit(":"), json_value(v, t.valueType)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        out = F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"'))
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit("null"))


def json_escape(c: Column) -> Column:
    """Spark's own escapes, taken from an array of one string."""
    quoted = F.to_json(F.array(c))
    return F.when(c.isNotNull(), quoted.substr(F.lit(3), F.length(quoted) - 4))


def compile_rule(rule: Rule, df: DataFrame, context: Any = None, order_by: list[Column] | None = None) -> Compiled:
    """Raises ``NotTyped`` if a condition, branch or object has no static type."""
    b = Builder(df, MISSING if context is None else context)
    b.read_again = frozenset(r.path[0] for r in refs(rule.steps) if r.ns == "out" and r.path)
    got = b.run(rule.steps, b.input_scope(), {}, F.lit(True), True)
    for f in b.filters:  # before the lookups; Catalyst moves them into the scan
        b.df = b.df.where(f)
    order = order_by or [F.monotonically_increasing_id()]
    if rule.finalize is not None and not order_by and b.joins:
        # joins may shuffle: the order of reading is noted before the first of them
        b.df = b.df.withColumn(ORDER, order[0])
        order = [F.col(ORDER)]
    base = b.attached().where(F.coalesce(got.keep, F.lit(False)))
    return Compiled(base, got.tree, b.errors, b.warnings, b.fallbacks, rule, order, b.context, bool(b.joins))


def finalize_frame(c: Compiled, f: Finalize, mode: str = "strict") -> DataFrame:
    """filter, sort, offset, limit and wrap over the output records."""
    df = c.frame(mode, keep_order=True)
    order = [x for x in df.columns if x.startswith("_ord")]
    outs = [x for x in df.columns if x not in order]
    types = {x.name: x.dataType for x in df.schema.fields if x.name in outs}
    record = struct({k: of_column(F.col(f"`{k}`"), native(t)) for k, t in sorted(types.items())})
    scope = lambda: Scope(record, lambda n: of_column(F.col(f"`{n}`"), types[n]) if n in types else None, c.context, {}, item=record)
    if f.filter is not None:
        s = scope()
        if any(r.ns == "index" for r in refs(f.filter)):
            from pyspark.sql import Window

            # the position in the whole result needs one order over all rows
            df = df.withColumn("_index", F.row_number().over(Window.orderBy(*order)) - 1)
            s = replace(s, index=Val(F.col("_index").cast("bigint"), LONG))
        cond = compile_cond(f.filter, s)
        df = checked(df.where(cond.col | failed(cond.errors)) if cond.errors else df.where(cond.col), cond.errors, mode, "finalize.filter")
    if f.sort is not None:
        path, desc = f.sort
        k = field_of(types, path)
        if k.missing is not None or isinstance(k.type, (T.StructType, T.ArrayType, T.MapType, T.NullType)):
            if k.missing is None:
                raise EvalError("ExprError", "sort key must be a scalar", "finalize.sort.by")
        df = checked(df, (Error(value(k).isNull(), "ExprError", "sort key must be a scalar"),), mode, "finalize.sort.by")
        df = df.orderBy(k.col.desc() if desc else k.col.asc(), *order)
    elif f.offset or f.limit is not None:
        df = df.orderBy(*order)
    if f.offset:
        df = df.offset(f.offset)
    if f.limit is not None:
        df = df.limit(f.limit)
    if not f.has_wrap:
        return df.select(*outs)
    return wrap(df, f.wrap, outs, order, types, c.context)


def field_of(types: dict[str, T.DataType], path: tuple) -> Val:
    from .compiler import field

    if path[0] not in types:
        raise EvalError("InvalidRef", "sort key is missing", "finalize.sort.by")
    return field(of_column(F.col(f"`{path[0]}`"), types[path[0]]), path[1:])


def checked(df: DataFrame, errors: tuple[Error, ...], mode: str, path: str) -> DataFrame:
    if not errors or mode != "strict":
        return df
    text = F.coalesce(*[F.when(F.coalesce(e.cond, F.lit(False)), F.lit(f"{e.kind}: {e.message} (path: {path})")) for e in errors])
    return df.where(F.when(text.isNotNull(), F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))


def wrap(df: DataFrame, template: Any, outs: list[str], order: list[str], types: dict, context: Any) -> DataFrame:
    """One row. Counts and sums over ``@out`` are plain aggregates; only a template
    that shows the records themselves gathers them."""
    aggs: dict[str, Column] = {}
    leaves: dict[tuple, Val] = {}
    rows_type = T.ArrayType(T.StructType([T.StructField(k, native(types[k])) for k in sorted(outs)]))

    def visit(t: Any, path: tuple) -> None:
        if isinstance(t, dict):
            for k, v in t.items():
                visit(v, (*path, k))
            return
        name = f"_w{len(leaves)}"
        if (simple := aggregate(t, types)) is not None:
            aggs[name], kind, rest = simple
            leaves[path] = compile_steps(rest, Scope(Val(F.lit(None), T.NullType()), lambda _: None, context, {}, pipe=Val(F.col(name), kind)))
            return
        aggs.setdefault("_rows", F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*[F.col(f"`{k}`").cast(native(types[k])).alias(k) for k in sorted(outs)]).alias("r")))), lambda r: r["r"]))
        rows = Val(F.col("_rows"), rows_type)
        leaves[path] = compile_expr(t, Scope(rows, lambda _: None, context, rows))

    visit(template, ())
    one = df.agg(*[v.alias(k) for k, v in aggs.items()]) if aggs else df.sparkSession.range(1)
    if () in leaves:
        return one.select(value(leaves[()]).alias("value"))
    tree: dict = {}
    for path, v in leaves.items():
        put(tree, path, v)
    return one.select(*[(value(v) if isinstance(v, Val) else value(tree_value(v))).alias(k) for k, v in tree.items()])


def aggregate(t: Any, types: dict) -> tuple[Column, T.DataType, tuple] | None:
    """len, sum, avg, min and max over all records or over one field of them:
    the aggregate, its type and the steps that follow."""
    if not isinstance(t, Pipe) or not isinstance(t.start, Ref) or t.start.ns not in ("out", "input") or t.start.path:
        return None
    steps = t.steps
    if isinstance(steps[0], Call) and steps[0].op == "len":
        return F.count(F.lit(1)), LONG, steps[1:]
    if len(steps) < 2 or not isinstance(steps[1], Call) or steps[1].op not in ("sum", "avg", "min", "max"):
        return None
    inner = getattr(steps[0], "steps", None) or (steps[0].args if isinstance(steps[0], Call) and steps[0].op == "map" else None)
    if not inner or len(inner) != 1 or not isinstance(inner[0], Ref) or inner[0].ns != "item" or len(inner[0].path) != 1 or inner[0].path[0] not in types:
        return None
    v = of_column(F.col(f"`{inner[0].path[0]}`"), types[inner[0].path[0]])
    n = as_number(v)
    out = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[steps[1].op](n)
    integral = isinstance(v.type, T.LongType) and steps[1].op != "avg"
    return out.cast("bigint") if integral else out, LONG if integral else T.DoubleType(), steps[2:]
