"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import string
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot when it holds more than 1 / HOT_KEYS of all rows, so at
#: most HOT_KEYS keys are hot whatever the input: that bounds what is broadcast.
HOT_KEYS = 10_000
#: Ids that are sent by broadcast, at most (eight bytes each).
BROADCAST_IDS = 1 << 20
ARROW_BYTES = "4m"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts go to Python workers in batches of ARROW_BYTES, unless the session sets a size itself.

    Spark's own limits are 10,000 rows and 64 MB, and a worker holds a batch more than once."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "64m", "67108864b"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session; where it is unset a temporary
    folder is made once and set for the session, but only where driver and
    executors are one process (local tests): on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sluice.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("sluice.checkpoint.dir", path)
    return path


def work_dir(spark: SparkSession) -> str:
    """This application's files in the shared folder."""
    return f"{shared_dir(spark)}/sluice/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all that the operators wrote, once their results are written elsewhere."""
    _delete(spark, work_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def materialise(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, so a lost
    executor costs only the tasks that it ran. ``codec`` overrides the session's."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._sluice_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    path = getattr(df, "_sluice_path", None)
    if path:
        _delete(df.sparkSession, path)


def join_by_digest(rows: DataFrame, side: DataFrame, key: str, size: str, total: int, spread: str) -> DataFrame:
    """Left join of many ``rows`` to ``side`` (one row a key, ``size`` rows each).

    Hot keys go by broadcast (at most HOT_KEYS of them, see there), the rest by
    a shuffle in which no key has more than 1 / HOT_KEYS of the rows. Rows that
    the broadcast has served get a key of their own, so they are spread too.
    """
    cols = [c for c in side.columns if c != key]
    is_hot = F.col(size) * HOT_KEYS > F.lit(total)
    hot = side.where(is_hot).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in cols], F.lit(True).alias("_hit"))
    cold = side.where(~is_hot).select(F.col(key).alias("_ck"), *[F.col(c).alias(f"_c_{c}") for c in cols])
    a = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    # a spread key may equal another's: its match is not used
    mixed = F.xxhash64(spread)
    kind = dict(rows.dtypes)[key]
    own = F.when(F.col("_hit"), {"bigint": mixed, "binary": F.unhex(F.hex(mixed))}.get(kind, F.concat(F.lit("-"), mixed.cast("string")))).otherwise(F.col(key))
    b = a.withColumn("_jk", own).join(cold, F.col("_jk") == F.col("_ck"), "left")
    return b.select(*rows.columns, *[F.when(F.col("_hit"), F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in cols])


def without(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``rows`` but those whose id is in ``ids`` (one column); rows with a null id stay.

    Up to BROADCAST_IDS ids are broadcast, more are shuffled with the rows."""
    gone = materialise(ids.toDF("_gone").where("_gone is not null").distinct(), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    packed = rows.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"))
    return packed.join(F.broadcast(gone) if few else gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")


def once(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rows`` without repeated rows of one id and text; rows with a null id stay.

    Ids are counted first: where none is repeated, no text is moved."""
    ids = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if not ids.take(1):
        return rows
    ids = materialise(ids.select("_again"), "repeated")
    packed = rows.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.sha2(whole_text(text_col), 256).alias("_text"))
    known = F.col("_id") == F.col("_again")
    left = packed.join(ids, known, "left_anti").unionByName(packed.join(ids, known, "left_semi").dropDuplicates(["_id", "_text"]))
    return left.select("_row.*")


def ship(name: str) -> None:
    """Send a module's functions to Python workers by value: executors need no
    copy of this repository."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)
