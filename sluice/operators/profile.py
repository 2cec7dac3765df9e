"""Profiles of inputs: for each leaf path its count, types and a few examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXAMPLES = 3
MAX_PATHS = 200


def leaves(t: T.DataType, path: tuple = ()) -> list[tuple[tuple, T.DataType]]:
    """Leaf paths of a schema; arrays are leaves."""
    if isinstance(t, T.StructType):
        return [x for f in t.fields for x in leaves(f.dataType, (*path, f.name))]
    return [(path, t)]


def kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "float"
    return "array" if isinstance(t, T.ArrayType) else "object" if isinstance(t, T.MapType) else "string"


def cell_kind(c):
    """The type that a CSV cell looks like."""
    s = F.trim(c)
    return (
        F.when(s == "", "null").when(F.lower(s).isin("true", "false"), "bool").when(s.rlike(r"^[+-]?[0-9]+$"), "int")
        .when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "float").otherwise("string")
    )


def analyse(df: DataFrame, cells: bool = False, max_paths: int = MAX_PATHS) -> DataFrame:
    """(path, count, types, examples), sorted by path: one aggregation for all
    paths; each keeps three examples at most. ``cells``: type strings as CSV cells."""
    found = sorted(leaves(df.schema), key=lambda x: x[0])[:max_paths]
    rows = []
    for path, t in found:
        c = F.col(".".join(f"`{p}`" for p in path))
        name = F.lit(kind(t)) if not (cells and isinstance(t, T.StringType)) else cell_kind(c)
        shown = c.cast("string") if not isinstance(t, (T.ArrayType, T.MapType)) else F.lit(None).cast("string")
        rows.append(F.struct(F.lit(".".join(path)).alias("path"), F.when(c.isNull(), "null").otherwise(name).alias("type"), shown.alias("example")))
    flat = df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    # distinct (path, type, example) would shuffle every value: the least, the greatest and two picked by hash are enough
    picked = [F.min_by("example", F.when(F.col("example").isNotNull(), F.xxhash64(F.lit(i), "example"))).alias(f"pick{i}") for i in range(2)]
    by_type = flat.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"), F.min("example").alias("low"), F.max("example").alias("high"), *picked)
    out = by_type.groupBy("path").agg(
        F.sum("n").alias("count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array("low", "high", "pick0", "pick1")))))), 1, EXAMPLES).alias("examples"),
    )
    return out.orderBy("path")
