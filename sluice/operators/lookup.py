"""Lookups as joins: side rows are reduced to one row per key first, so a lookup
never multiplies records, and Catalyst picks the join."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Side rows from a driver-side document that are broadcast, at most, and their
#: size; beyond it (and for DataFrames, whose size Spark estimates) the planner decides.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Side:
    """(ord, key, value) rows; ``rows`` and ``size`` are known for driver-side documents."""

    df: DataFrame
    rows: int | None = None
    size: int = 0

    def hint(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.rows is not None and self.rows <= BROADCAST_ROWS and self.size <= BROADCAST_BYTES else df


def side_of_rows(spark: SparkSession, rows: list[tuple[int, Any, Any]], key: T.DataType, value: T.DataType) -> Side:
    schema = T.StructType([T.StructField("ord", T.LongType()), T.StructField("key", key), T.StructField("value", value)])
    return Side(spark.createDataFrame(rows, schema), len(rows), sum(len(repr(r)) for r in rows))


def side_of_frame(df: DataFrame, key: str, value: Column, order: list[str] | None = None) -> Side:
    """Rows of a DataFrame; ``order`` decides which of several matches is first."""
    ord_ = F.struct(*[F.col(c) for c in order]) if order else F.monotonically_increasing_id()
    return Side(df.select(ord_.alias("ord"), F.col(key).alias("key"), value.alias("value")))


def first_match(side: Side) -> DataFrame:
    """One row per key: the value that comes first."""
    return side.hint(side.df.groupBy("key").agg(F.min_by(F.struct("value"), "ord").alias("hit")))


def all_matches(side: Side) -> DataFrame:
    """One row per key: its values in order."""
    rows = side.df.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct("value").alias("v")))).alias("r"))
    return side.hint(rows.select("key", F.transform("r", lambda r: r["v"]["value"]).alias("hit")))


def attach(df: DataFrame, matches: DataFrame, want: Column, name: str) -> DataFrame:
    """Left join: the hit of each record's key under ``name``; null without one."""
    right = matches.select(F.col("key").alias(f"{name}_key"), F.col("hit").alias(name))
    return df.join(right, want == F.col(f"{name}_key"), "left").drop(f"{name}_key")
