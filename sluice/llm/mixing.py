"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source is a task with weight w; its j-th block (``block_docs`` documents)
is released at floor(t(j / w)) and due at ceil(t((j + 1) / w)), and earliest
deadline first fills one slot after another. t(v) is the number of slots after
which sources in exact shares would have given min(blocks, w v) blocks each, so
a source that runs dry leaves its share to the others. In each prefix of the
mix every source is less than one block from its share. Weights are exact
rationals: nothing is rounded. The driver schedules blocks, not rows; a block
has more documents where a mix would have more than MAX_BLOCKS of them, so the
schedule is bounded and goes out by broadcast; documents find the slots of their
blocks by a join.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

#: Blocks of a source whose slots are one row of the schedule.
CHUNK = 1024
#: Blocks of a schedule, besides one for each source: 16 MB of slots.
MAX_BLOCKS = 1 << 21
#: The stream of the sources that ``weights`` does not name.
REST = "\x00rest"
RESULT = ("_stream", "_block", "_slot", "_position")


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, array]:
    """The slot of each block of each source."""
    names = sorted(s for s, b in blocks.items() if b > 0)
    exact = [Fraction(weights[s]) for s in names]
    scale = lcm(*[w.denominator for w in exact])
    w, n = [int(x * scale) for x in exact], [blocks[s] for s in names]
    # up to the p-th source running dry, t(v) = given[p] + rate[p] * v
    dry = sorted((Fraction(b, x), i) for i, (b, x) in enumerate(zip(n, w, strict=True)))
    ends, given, rate = [v for v, _ in dry], [0], [sum(w)]
    for _, i in dry:
        given.append(given[-1] + n[i])
        rate.append(rate[-1] - w[i])
    phase = [0] * len(names)

    def passes(i: int, j: int) -> tuple[int, int]:
        """floor and ceil of t(j / w)."""
        p = phase[i]
        if p < len(ends) and ends[p].numerator * w[i] <= j * ends[p].denominator:
            p = phase[i] = bisect_right(ends, Fraction(j, w[i]), p)
        x = rate[p] * j
        return given[p] + x // w[i], given[p] - (-x // w[i])

    slots = [array("q") for _ in names]
    ready, waiting = [], []
    following = [0] * len(names)
    for i in range(len(names)):
        following[i], due = passes(i, 1)
        ready.append((due, i))
    heapq.heapify(ready)
    for t in range(sum(n)):
        while waiting and waiting[0][0] <= t:
            _, due, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i))
        _, i = heapq.heappop(ready)
        slots[i].append(t)
        done = len(slots[i])
        if done < n[i]:
            release = following[i]
            following[i], due = passes(i, done + 1)
            if release <= t + 1:
                heapq.heappush(ready, (due, i))
            else:
                heapq.heappush(waiting, (release, due, i))
    return dict(zip(names, slots, strict=True))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = 16, rows_per_bucket: int = 4096) -> DataFrame:
    """All rows and columns of ``docs``, with ``_stream``, ``_block``, ``_slot``, ``_position``.

    ``_position`` orders the mix. ``weights`` are targets per source (named
    sources only need a positive number); by default the square root of a
    source's share of documents, which lifts small sources. Every source has its
    own weight; only those that ``weights`` does not name share one stream. No
    row is dropped or repeated: a source that runs dry leaves the mix and the
    rest goes on. Within a source the order is by a hash of the id, then the id.
    Null sources form a source of their own, null ids come in any order,
    repeated rows are scheduled each, and an empty table stays empty. A column
    of ``docs`` with the name of a result gives way to it; texts may be null,
    empty or of any length, they are not looked at.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(source_col).cast("string"), F.lit("\x00null"))
    counts = docs.groupBy(name.alias("s")).count()
    own = counts if weights is None else counts.where(F.col("s").isin(list(weights)))
    sizes = {r["s"]: r["count"] for r in own.collect()}
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    if rest := total - sum(sizes.values()):
        sizes[REST] = rest
    block_docs = max(block_docs, -(-total // MAX_BLOCKS))
    share = {s: (weights or {}).get(s, min((weights or {1: 1}).values())) if weights else n**0.5 for s, n in sizes.items()}
    blocks = {s: -(-n // block_docs) for s, n in sizes.items()}
    chunks = [(s, c // CHUNK, x[c : c + CHUNK].tolist()) for s, x in schedule(blocks, share).items() for c in range(0, len(x), CHUNK)]
    table = C.materialise(spark.createDataFrame(chunks, "_ps string, _chunk bigint, _slots array<bigint>"), "mixing-slots")

    named = F.lit(True) if weights is None else name.isin(list(weights))
    buckets = max(1, -(-total // rows_per_bucket))
    # the input's columns travel in one struct, so no name of theirs meets one of ours
    rows = docs.select(F.struct("*").alias("_row"), F.when(named, name).otherwise(F.lit(REST)).alias("_stream"), F.col(id_col).alias("_id"))
    rows = rows.withColumn("_hash", F.when(F.col("_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(F.lit(7), "_id")))
    # unsigned buckets of the hash, so that buckets follow the order within a source
    rows = rows.withColumn("_bucket", F.floor((F.col("_hash").cast("double") / F.lit(2.0**64) + 0.5) * buckets).cast("bigint"))
    inside = Window.partitionBy("_stream", "_bucket").orderBy("_hash", "_id")
    numbered = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    # how many rows of the source come before a bucket: prefix sums in two levels
    per = rows.groupBy("_stream", "_bucket").count().withColumn("_group", F.expr(f"_bucket div {max(1, int(buckets ** 0.5))}"))
    near = Window.partitionBy("_stream", "_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    far = Window.partitionBy("_stream").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = per.groupBy("_stream", "_group").agg(F.sum("count").alias("_n")).select("_stream", "_group", F.coalesce(F.sum("_n").over(far), F.lit(0)).alias("_far"))
    before = per.withColumn("_near", F.coalesce(F.sum("count").over(near), F.lit(0))).join(groups, ["_stream", "_group"]).select("_stream", "_bucket", (F.col("_near") + F.col("_far")).alias("_before"))
    index = F.col("_before") + F.col("_rank")
    placed = numbered.join(before, ["_stream", "_bucket"]).withColumn("_index", index).withColumn("_block", F.expr(f"_index div {block_docs}"))
    joined = placed.join(F.broadcast(table), (F.col("_stream") == F.col("_ps")) & (F.expr(f"_block div {CHUNK}") == F.col("_chunk")))
    slot = F.expr(f"get(_slots, cast(_block % {CHUNK} as int))")
    out = joined.withColumn("_slot", slot).withColumn("_position", F.col("_slot") * block_docs + F.col("_index") % block_docs)
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in RESULT], *RESULT)


C.ship(__name__)
