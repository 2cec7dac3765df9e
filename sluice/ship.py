"""The package for Python workers: executors need no copy of it."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once for an application.

    The driver serves the archive from its own disk; nothing has to be shared."""
    context = spark.sparkContext
    if getattr(context, "_sluice_shipped", False) or not PACKAGE.is_dir():
        return
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f"{PACKAGE.name}/{f.relative_to(PACKAGE)}")
    file = Path(tempfile.mkdtemp(prefix="sluice-")) / "sluice.zip"
    file.write_bytes(raw.getvalue())
    context.addPyFile(str(file))
    context._sluice_shipped = True
