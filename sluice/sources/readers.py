"""Sources: CSV and JSON as rules describe them, Parquet, contexts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EvalError
from ..plans.ast import Rule
from ..plans.parse import Fault, path_tokens
from ..ship import ship
from ..values import MISSING, dumps, get_path

#: Order columns of a file source: file, position in the file, row within it.
ORDINAL = "_ordinal"


def read_csv(spark: SparkSession, path: str, rule: Rule) -> DataFrame:
    """Every cell a string, an empty cell an empty string; a ragged row fails."""
    if len(rule.delimiter) != 1:
        raise EvalError("InvalidInput", "the delimiter is one character")
    reader = spark.read.option("sep", rule.delimiter).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").option("enforceSchema", False)
    if rule.has_header:
        df = reader.option("header", True).option("inferSchema", False).csv(path)
    else:
        if not rule.columns:
            raise EvalError("InvalidInput", "columns are required without a header")
        df = reader.option("header", False).schema(T.StructType([T.StructField(c, T.StringType()) for c in rule.columns])).csv(path)
    return df.na.fill("")


def read_json_typed(spark: SparkSession, path: str, rule: Rule, schema: T.StructType) -> DataFrame:
    """Records of a known schema as columns; absent and null are both null there.
    Newline-delimited files split; a records path reads whole documents."""
    if rule.records_path is None:
        return spark.read.schema(schema).json(path, multiLine=False)
    tokens = path_tokens(rule.records_path)
    nested: T.DataType = T.ArrayType(schema)
    for k in reversed(tokens):
        if not isinstance(k, str):
            raise EvalError("InvalidRecordsPath", "records_path has no indexes here")
        nested = T.StructType([T.StructField(k, nested)])
    docs = spark.read.schema(nested).json(path, multiLine=True)
    column = ".".join(f"`{k}`" for k in tokens)
    return docs.select(F.posexplode(column).alias(ORDINAL, "_r")).select(ORDINAL, "_r.*")


def records_of(document: Any, records_path: str | None) -> list:
    """The records of one document: an array's elements, or one object."""
    if records_path:
        try:
            document = get_path(document, path_tokens(records_path))
        except Fault as x:
            raise EvalError("InvalidRecordsPath", x.message, "input.json.records_path") from x
        if document is MISSING:
            raise EvalError("InvalidRecordsPath", "records_path does not exist", "input.json.records_path")
    if isinstance(document, list):
        return document
    if isinstance(document, dict):
        return [document]
    raise EvalError("InvalidRecordsPath" if records_path else "InvalidInput", "records are an array or an object", "input.json.records_path" if records_path else "")


def read_json(spark: SparkSession, path: str, rule: Rule) -> DataFrame:
    """(_ordinal, value): each record as JSON text, exactly. One document per file."""
    where = rule.records_path

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["value"]:
                try:
                    document = json.loads(text)
                except ValueError as x:
                    raise EvalError("InvalidInput", f"not JSON: {x}") from x
                rows = [dumps(r) for r in records_of(document, where)]
                yield pd.DataFrame({"pos": range(len(rows)), "value": rows})

    ship(spark)
    docs = spark.read.text(path, wholetext=True)
    return docs.mapInPandas(split, "pos bigint, value string").select(F.monotonically_increasing_id().alias(ORDINAL), "value")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_ordinal, value): one record a line; files split, so any number of tasks read one."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias(ORDINAL), "value")


def csv_as_json(df: DataFrame) -> DataFrame:
    """(_ordinal, value): CSV records as JSON objects of strings."""
    return df.select(F.monotonically_increasing_id().alias(ORDINAL), F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def read_records(spark: SparkSession, path: str, rule: Rule, fmt: str | None = None) -> DataFrame:
    """Records as JSON text; ``fmt`` overrides the rule's format."""
    fmt = fmt or rule.format
    if fmt == "csv":
        return csv_as_json(read_csv(spark, path, rule))
    if fmt == "json":
        return read_json(spark, path, rule)
    if fmt == "ndjson":
        return read_json_lines(spark, path)
    if fmt == "parquet":
        return csv_as_json(spark.read.parquet(path))
    raise EvalError("InvalidInput", f"no such format: {fmt}")


def load_context(path: str | Path) -> Any:
    """The context document; it stays on the driver, lookups broadcast its arrays."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError) as x:
        raise EvalError("InvalidInput", f"cannot read context: {x}") from x
