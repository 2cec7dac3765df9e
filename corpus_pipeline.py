"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage works on all that the one before kept; its rows are written as
Parquet and read again as the next one's input. All but the last return COLUMNS;
further columns of ``documents``, whatever their names, are left behind by the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import _common as C
from sluice.llm import exact_dedup, mixing, near_dedup, packing
from sluice.llm import toxicity as tox

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents of a partition of the packing stage, at least: ten packing groups.
PART_DOCS = 4000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not reject; the model is fitted on the labels
    of the training fold of these documents. A null text counts as empty and a null
    id as unlabelled; without labels of both kinds, or without rows, nothing is rejected."""
    rows = docs.select(F.col("doc_id"), C.whole_text("text").alias("text"))
    model = tox.fit(rows, C.read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    return tox.keep_clean(docs, model).select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id, once where its row is repeated.
    A null text equals an empty one; of texts without any id one row stays."""
    return exact_dedup.keep_unique(docs).select(*COLUMNS)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8.
    Texts without words and rows without an id are no near-duplicates and stay."""
    return near_dedup.keep_one(docs).select(*COLUMNS)


def _in_order(docs: DataFrame, parts: int) -> DataFrame:
    """The documents in the order of the mix, which depends on their ids and sources only."""
    return mixing.mix(docs).repartitionByRange(parts, "_position").sortWithinPartitions("_position", "doc_id").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: files and rows follow the schedule.
    Null sources are a source of their own; repeated rows and null ids are all mixed."""
    return _in_order(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, numbered in the order of the mix.

    Spark reads files in an order of its own, so the mix is computed again from
    ids and sources: each packing group, and each prefix of whole groups, has
    the target weights. A null text is its end token alone; no rows, no pieces."""
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART_DOCS))
    return packing.pack(_in_order(docs, max(1, parts)), None, carry=False)


STAGES = [("toxicity", toxicity), ("exact_dedup", dedup), ("near_dedup", near_dup), ("mixing", mix), ("packing", pack)]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = C.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = C.materialise(docs, f"stage-{name}")
    return docs
