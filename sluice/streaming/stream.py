"""Rules on streams: the same plan, stateless and map-only."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import api


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options: Any) -> DataFrame:
    """A file source; new files are new records."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def transform_stream(df: DataFrame, rule: Any, context: Any = None, mode: str = "quarantine", warnings: bool = True) -> DataFrame:
    """A rule over a stream. A bad record is marked rather than stopping the query;
    records that a filter drops are gone. finalize is refused."""
    if not df.isStreaming:
        raise ValueError("not a stream")
    return api.transform(df, rule, context, mode, warnings)


def run_available(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Process what is there, exactly once, to files; restarts go on from the checkpoint."""
    return df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
