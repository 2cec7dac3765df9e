"""Dataset-level forms of the array operations, for large data: the groups of an
array operation become groups of rows, with partial aggregation, and the order
of the array becomes explicit order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _struct(order: list[str], item: Column) -> Column:
    return F.struct(*[F.col(c) for c in order], item.alias("_item"))


def group_by(df: DataFrame, key: Column, item: Column, order: list[str]) -> DataFrame:
    """(key, items): the items of each key in order."""
    rows = df.groupBy(key.cast("string").alias("key")).agg(F.array_sort(F.collect_list(_struct(order, item))).alias("r"))
    return rows.select("key", F.transform("r", lambda r: r["_item"]).alias("items"))


def summarise(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, len, sum, avg, min, max), without building the groups."""
    v = value.cast("double")
    return df.groupBy(key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("len"), F.sum(v).alias("sum"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"))


def key_by(df: DataFrame, key: Column, item: Column, order: list[str]) -> DataFrame:
    """(key, item): the last item of each key."""
    return df.groupBy(key.cast("string").alias("key")).agg(F.max_by(F.struct(item.alias("item")), F.struct(*[F.col(c) for c in order])).alias("r")).select("key", "r.item")


def distinct_by(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key, by partial aggregation rather than a window sort."""
    cols = df.columns
    first = df.groupBy(key.cast("string").alias("_key")).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order])).alias("_r"))
    return first.select("_r.*")


def unique(df: DataFrame, value: Column, order: list[str]) -> DataFrame:
    return distinct_by(df, value, order)


def partition(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that match and rows that do not; null does not."""
    yes = F.coalesce(predicate, F.lit(False))
    return df.where(yes), df.where(~yes)


def flag_partition(df: DataFrame, predicate: Column, name: str = "matched") -> DataFrame:
    """Both sides in one scan: all rows, with a boolean of the side; null is false."""
    return df.withColumn(name, F.coalesce(predicate, F.lit(False)))


def flat_map(df: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """One row per element, with its position."""
    return df.select("*", F.posexplode(items).alias(f"{name}_index", name))


def contains(df: DataFrame, value: Column, others: DataFrame, other: str) -> DataFrame:
    """Rows whose value occurs in another dataset."""
    return df.join(others.select(F.col(other).cast("string").alias("_o")).distinct(), value.cast("string") == F.col("_o"), "left_semi")


def lacks(df: DataFrame, value: Column, others: DataFrame, other: str) -> DataFrame:
    """Rows whose value does not occur in another dataset; a null value occurs nowhere."""
    return df.join(others.select(F.col(other).cast("string").alias("_o")).distinct(), value.cast("string") == F.col("_o"), "left_anti")


def chunk(df: DataFrame, size: int, partition_by: list[str], order: list[str]) -> DataFrame:
    """``chunk`` numbers within each partition of rows."""
    n = F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order)) - 1
    return df.withColumn("chunk", F.floor(n / size).cast("bigint"))
