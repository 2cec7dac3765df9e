"""Exact deduplication by skew-safe combining, with DataFrame functions only.

1. Local: Spark's partial aggregation merges equal texts within each input task.
2. Salted: groups of (digest, salt, text) merge across tasks; the salt spreads
   a group of any size over many reducers.
3. Global: the salt winners of (digest, text) are combined.

Each stage groups by the digest and by the whole text, so a digest collision
never merges different texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty. The largest id of a group is kept. Null ids lose to any other id; a
    group of null ids only has a null ``keep_id`` and its rows count as kept.
    Repeated rows (same id, same text) are counted and share one verdict. An
    empty table gives an empty result; other columns are ignored.
    """
    norm = docs.select(F.col(id_col).alias("doc_id"), C.ascii_lower(C.whole_text(text_col)).alias("_norm"))
    keyed = norm.withColumn("text_sha256", digest(F.col("_norm")))
    salted = (
        keyed.groupBy("text_sha256", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("_salt"), "_norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    merged = salted.groupBy("text_sha256", "_norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    small = C.materialise(merged.select("text_sha256", "keep_id", "group_size", F.xxhash64("_norm").alias("_check")), "exact-dedup")
    total, groups = small.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.count(F.lit(1))).first()
    digests = small.agg(F.count_distinct("text_sha256")).first()[0]
    if digests == groups:  # no digest stands for two texts: it identifies the text
        out = C.join_by_digest(keyed.select("doc_id", "text_sha256"), small.drop("_check"), "text_sha256", "group_size", total, "doc_id")
    else:  # a collision: join by the whole text as well
        out = keyed.join(merged, ["text_sha256", "_norm"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of equal texts the row with the largest id.

    Of rows with one id and equal texts one stays, and of equal texts without
    any id one. Where every id is there once, ids tell rows apart; else ids and
    digests of the text do."""
    verdict = exact_dedup(docs, id_col, text_col)
    ids = docs.groupBy(F.col(id_col).alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    if not ids.where("n > 1 or doc_id is null").take(1):
        return C.without(docs, id_col, verdict.where("not kept").select("doc_id"))
    kept = verdict.where("kept").select(F.col("doc_id").alias("_k"), F.col("text_sha256").alias("_s")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), sha256(C.ascii_lower(C.whole_text(text_col))).alias("_sha"))
    left = rows.join(kept, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_sha") == F.col("_s")), "left_semi").dropDuplicates(["_id", "_sha"])
    return left.select("_row.*")
