"""Entry points: rules on DataFrames and on JSON records."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dynamic
from .errors import EvalError
from .plans.ast import Rule
from .plans.compiler import NotTyped
from .plans.engine import Compiled, compile_rule, finalize_frame
from .plans.parse import load_rule, parse_rule
from .ship import ship
from .values import MISSING, dumps


def as_rule(rule: Rule | str | dict | Path, base: str | None = None) -> Rule:
    """A rule, its YAML text, its dict or its file."""
    if isinstance(rule, Rule):
        return rule
    if isinstance(rule, Path) or isinstance(rule, str) and "\n" not in rule and rule.endswith((".yaml", ".yml")):
        return load_rule(rule)
    return parse_rule(rule, base)


def compiled(df: DataFrame, rule: Rule | str | dict | Path, context: Any = None, base: str | None = None, order_by: list[Column] | None = None) -> Compiled:
    return compile_rule(as_rule(rule, base), df, context, order_by)


def transform(df: DataFrame, rule: Rule | str | dict | Path, context: Any = None, mode: str = "strict", warnings: bool = False, base: str | None = None, order_by: list[Column] | None = None) -> DataFrame:
    """Apply a rule to a DataFrame of typed records, as columns.

    ``context`` is a JSON-like value whose entries may also be DataFrames for
    lookups. ``order_by`` is the record order, which finalize needs; by default
    the order of reading. ``mode``: see ``Compiled.frame``. Works on streaming
    DataFrames unless the rule has finalize.
    """
    rule = as_rule(rule, base)
    if rule.finalize is not None and df.isStreaming:
        raise EvalError("InvalidInput", "finalize needs all records, a stream has no end")
    c = compile_rule(rule, df, context, order_by)
    if rule.finalize is None:
        return c.frame(mode, warnings)
    return finalize_frame(c, rule.finalize, mode)


def preflight(df: DataFrame, rule: Rule | str | dict | Path, context: Any = None, base: str | None = None) -> list[dict]:
    """Evaluate everything and keep nothing: the errors by message, with counts."""
    c = compiled(df, rule, context, base)
    bad = c.frame("quarantine").where("_error is not null")
    return [{"error": r["_error"], "records": r["n"]} for r in bad.groupBy("_error").agg(F.count(F.lit(1)).alias("n")).orderBy("_error").collect()]


def write_noop(df: DataFrame) -> None:
    """Run a strict plan to its end without output: the first error surfaces."""
    df.write.format("noop").mode("overwrite").save()


# records as JSON


def transform_json(df: DataFrame, rule: Rule | str | dict | Path, context: Any = None, column: str = "value", order_by: list[Column] | None = None, base: str | None = None) -> DataFrame:
    """Apply a rule to records held as JSON text, exactly: integers and floats stay
    apart, missing is not null, arrays may be mixed. One row per record that is
    kept, ``value`` (JSON) and ``warnings`` (JSON array); the first error fails."""
    rule = as_rule(rule, base)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for o, text in zip(b["_ord"], b["value"], strict=True):
                out, warnings = dynamic.run(rule, json.loads(text), MISSING if context is None else context)
                if out is not MISSING or warnings:
                    rows.append((o, None if out is MISSING else dumps(out), dumps(warnings)))
            yield pd.DataFrame(rows, columns=["_ord", "value", "warnings"])

    if rule.finalize is not None and df.isStreaming:
        raise EvalError("InvalidInput", "finalize needs all records, a stream has no end")
    ship(df.sparkSession)
    order = order_by[0] if order_by else F.monotonically_increasing_id()
    rows = df.select(order.cast("bigint").alias("_ord"), F.col(column).alias("value")).mapInPandas(run, "_ord bigint, value string, warnings string")
    if rule.finalize is None:
        # without an order of its own the input's stays: nothing here moves a row
        return (rows.orderBy("_ord") if order_by and not df.isStreaming else rows).select("value", "warnings")
    return _finalize_json(rows.where("value is not null"), rule, context)


def _finalize_json(rows: DataFrame, rule: Rule, context: Any) -> DataFrame:
    """Sort, offset and limit stay with Spark; only what a wrap shows is gathered."""
    f = rule.finalize
    ctx = MISSING if context is None else context

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for o, text in zip(b["_ord"], b["value"], strict=True):
                r = json.loads(text)
                k = dynamic.get_path(r, f.sort[0])
                if k is MISSING:
                    raise EvalError("InvalidRef", "sort key is missing", "finalize.sort.by")
                if k is None or isinstance(k, (list, dict)):
                    raise EvalError("ExprError", "sort key must be a scalar", "finalize.sort.by")
                out.append((o, text, float(k) if not isinstance(k, str) else None, k if isinstance(k, str) else None))
            yield pd.DataFrame(out, columns=["_ord", "value", "_n", "_s"])

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flags = []
            for i, text in zip(b["_index"], b["value"], strict=True):
                r = json.loads(text)
                flags.append(dynamic.holds(f.filter, dynamic.Env(r, ctx, MISSING, item=r, index=i, path="finalize.filter")))
            yield b.loc[flags, ["_ord", "value"]]

    rows = rows.select("_ord", "value")
    if f.filter is not None:
        from pyspark.sql import Window

        uses_index = "index" in repr(f.filter)
        index = F.row_number().over(Window.orderBy("_ord")) - 1 if uses_index else F.lit(0)
        rows = rows.withColumn("_index", index.cast("bigint")).mapInPandas(keep, "_ord bigint, value string")
    if f.sort is not None:
        rows = rows.mapInPandas(keys, "_ord bigint, value string, _n double, _s string")
        rows = rows.orderBy(*([F.desc("_n"), F.desc("_s")] if f.sort[1] else [F.asc("_n"), F.asc("_s")]), "_ord")
    else:
        rows = rows.orderBy("_ord")
    if f.offset:
        rows = rows.offset(f.offset)
    if f.limit is not None:
        rows = rows.limit(f.limit)
    if not f.has_wrap:
        return rows.select("value", F.lit("[]").alias("warnings"))
    records = [json.loads(r["value"]) for r in rows.select("value").toLocalIterator()]
    only_wrap = type(f)(wrap=f.wrap, has_wrap=True)
    return rows.sparkSession.createDataFrame([(dumps(dynamic.finalize(only_wrap, records, ctx)), "[]")], "value string, warnings string")


def transform_record(record: Any, rule: Rule | str | dict | Path, context: Any = None, base: str | None = None) -> Any:
    """One record on the driver; MISSING if it is dropped. finalize sees an array of one."""
    rule = as_rule(rule, base)
    ctx = MISSING if context is None else context
    out, _ = dynamic.run(rule, record, ctx)
    if rule.finalize is None or out is MISSING and not rule.finalize.has_wrap:
        return out
    got = dynamic.finalize(rule.finalize, [] if out is MISSING else [out], ctx)
    if rule.finalize.has_wrap:
        return got
    return got[0] if got else MISSING


def transform_records(records: list, rule: Rule | str | dict | Path, context: Any = None, base: str | None = None) -> tuple[Any, list]:
    """A list of records on the driver: (output, warnings)."""
    rule = as_rule(rule, base)
    ctx = MISSING if context is None else context
    out, warnings = [], []
    for r in records:
        got, more = dynamic.run(rule, r, ctx)
        warnings += more
        if got is not MISSING:
            out.append(got)
    return (dynamic.finalize(rule.finalize, out, ctx) if rule.finalize else out), warnings


__all__ = ["NotTyped", "as_rule", "compiled", "preflight", "transform", "transform_json", "transform_record", "transform_records", "write_noop"]
