"""Sinks: newline-delimited JSON by the executors, one JSON document by the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from ..values import dumps


def write_ndjson(values: DataFrame, path: str, column: str = "value") -> None:
    """One object per line, a file per partition."""
    values.select(column).write.mode("overwrite").text(path)


def write_json_array(values: DataFrame, path: str | Path, column: str = "value") -> int:
    """One array in one file; records stream through the driver, partition by partition."""
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with file.open("w") as out:
        out.write("[")
        for row in values.select(column).toLocalIterator(prefetchPartitions=True):
            out.write((",\n " if n else "\n ") + row[0])
            n += 1
        out.write("\n]\n" if n else "]\n")
    return n


def preview(values: DataFrame, rows: int, max_bytes: int | None = None, column: str = "value") -> tuple[str, bool]:
    """The first ``rows`` records as an array, and whether the text was cut."""
    text = dumps([json.loads(r[0]) for r in values.select(column).limit(rows).collect()])
    raw = text.encode()
    if max_bytes is None or len(raw) <= max_bytes:
        return text, False
    return raw[:max_bytes].decode(errors="ignore"), True
