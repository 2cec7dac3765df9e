"""Approximate nearest neighbours by additive quantisation.

A vector is encoded as a sum of one codeword from each of several
full-dimensional codebooks, by beam search over the residuals. The norms of the
vector and of that sum are stored with the codes as their quotient: sums of
codewords fall short by different amounts, and the quotient makes up for it. A
query's inner products with all codewords make a lookup table, and a
candidate's score is the sum of its entries, times the quotient. The best
candidates are scored again on the original vectors in double precision.
Codebooks are fitted on a bounded sample; every vector is indexed. Equal vectors
are one entry; different vectors with equal codes, which codes cannot tell
apart, go along with their codes and are scored on them.

Queries meet the index in blocks: a task has one block of queries and streams
one stripe of the codes, of which it keeps each query's best as it goes. Stripes
are dealt at random and their number is bounded, so the best of all are among
the few that each stripe gives, and what a query gives does not grow with the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

BOOKS = 32
WORDS = 32
BEAM = 4
#: Vectors that the codebooks are fitted on, at most.
MAX_TRAIN = 16384
#: Entries of a query that are scored exactly, the best by their codes; as many again
#: of those that share codes.
RERANK = 300
BLOCK_QUERIES = 2048
#: Codes of a stripe, until there are MAX_STRIPES of them.
STRIPE_CODES = 8192
MAX_STRIPES = 64


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rnd = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rnd.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = count == 0
        c = np.where(empty[:, None], x[rnd.choice(len(x), k)], total / np.maximum(count, 1)[:, None])
    return c


def encode(x: np.ndarray, books: list[np.ndarray], beam: int = BEAM) -> np.ndarray:
    """Codes of the rows of ``x``: the ``beam`` best partial sums go on from book to book."""
    n = len(x)
    residual, codes, loss = x[:, None, :], np.zeros((n, 1, 0), dtype=np.uint8), np.zeros((n, 1))
    for c in books:
        d = (residual**2).sum(2)[:, :, None] - 2 * residual @ c.T + (c * c).sum(1)[None, None, :]
        flat = d.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        from_, word = best // len(c), best % len(c)
        at = np.arange(n)[:, None]
        residual = residual[at, from_] - c[word]
        codes = np.concatenate([codes[at, from_], word[:, :, None].astype(np.uint8)], axis=2)
        loss = flat[at, best]
    return codes[np.arange(n), loss.argmin(1)]


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, refine: int = 1) -> list[np.ndarray]:
    """Residual codebooks by k-means, then refined together: each pass encodes the
    sample by beam search and solves all codewords by least squares."""
    out: list[np.ndarray] = []
    residual = x
    for b in range(books):
        c = kmeans(residual, words, 17 + b)
        residual = residual - c[((c * c).sum(1)[None, :] - 2 * residual @ c.T).argmin(1)]
        out.append(c)
    for _ in range(refine):
        codes = encode(x, out)
        starts = np.cumsum([0, *[len(c) for c in out]])
        # normal equations of the one-hot design, with a ridge towards the codewords so far
        g = np.zeros((starts[-1], starts[-1]))
        cols = codes.astype(int) + starts[:-1]
        for i in range(books):
            for j in range(i, books):
                np.add.at(g, (cols[:, i], cols[:, j]), 1.0)
        g = np.triu(g) + np.triu(g, 1).T
        rhs = np.zeros((starts[-1], x.shape[1]))
        for i in range(books):
            np.add.at(rhs, cols[:, i], x)
        ridge = 1.0
        solved = np.linalg.solve(g + ridge * np.eye(len(g)), rhs + ridge * np.concatenate(out))
        out = [solved[starts[i] : starts[i + 1]] for i in range(books)]
    return [c.astype(np.float32) for c in out]


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: arrays without null or
    non-finite components, not all zero; of floats, if the input has floats."""
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast(kind).alias("v"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("v", odd) & F.exists("v", lambda x: x != 0))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def share(rerank: int, stripes: int) -> int:
    """How many of the ``rerank`` best may be in one of ``stripes`` random stripes:
    the mean and five standard deviations."""
    mean = rerank / stripes
    return rerank if stripes == 1 else min(rerank, int(mean + 5 * mean**0.5) + 5)


class Best:
    """The best ``k`` scores of each of several queries, and all that equal the last of them."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(queries)]
        self.size = [0] * queries

    def add(self, q: int, scores: np.ndarray, entries: np.ndarray) -> None:
        at = np.flatnonzero((scores >= self.least[q]) & (scores > -np.inf))
        if len(at):
            self.held[q].append((scores[at], entries[at]))
            self.size[q] += len(at)
            if self.size[q] > 4 * self.k:
                self.of(q)

    def of(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.held[q]:
            return np.zeros(0), np.zeros(0, dtype=np.int64)
        s, e = (np.concatenate(x) for x in zip(*self.held[q], strict=True))
        if len(s) > self.k:
            self.least[q] = -np.partition(-s, self.k - 1)[self.k - 1]
            keep = s >= self.least[q]
            s, e = s[keep], e[keep]
        self.held[q], self.size[q] = [(s, e)], len(s)
        return s, e


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = RERANK, train: int = MAX_TRAIN, books: int = BOOKS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest of each row whose id
    is divisible by ``every``, by largest inner product, among all rows with another id.

    Ties go to the smaller id. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do rows with a null id or a length
    other than the most common one. Of rows with one id, equal or not, each is a
    candidate, the best of them is returned once. Fewer than ``k`` candidates
    are all returned; an empty table gives an empty result.
    """
    rows = clean(vectors, id_col, vec_col)
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("v") == (width[0]["d"] if width else 0))
    # at most `train` vectors
    part = rows.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(train).collect()
    x = np.asarray([r["v"] for r in part], dtype=np.float64)
    codebooks = fit(x, books, min(WORDS, max(1, len(x) // 8))) if len(x) else []
    books = len(codebooks)
    stacked = np.stack(codebooks) if codebooks else np.zeros((0, 0, 0), dtype=np.float32)

    # rows with equal vectors are one entry of the index: it has their k + 1 smallest ids, of
    # which one may be the query's own, so no other id of theirs can be among its k nearest
    same = [F.xxhash64("v"), F.col("v")]
    least = rows.dropDuplicates(["vec_id", "v"]).withColumn("_r", F.row_number().over(Window.partitionBy(*same).orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    entries = least.groupBy(*same).agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("entry"), "ids", "v")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 1024):
                p = b.iloc[i : i + 1024]
                v = np.stack(p["v"].to_list()).astype(np.float32)
                codes = encode(v, list(stacked))
                sums = stacked[np.arange(books)[None, :], codes].sum(1)
                quotient = np.sqrt((v * v).sum(1) / np.maximum((sums * sums).sum(1), 1e-30))
                yield pd.DataFrame({"entry": p["entry"], "ids": p["ids"], "v": p["v"], "codes": [c.tobytes() for c in codes], "norm": quotient.astype("float32")})

    kind = dict(rows.dtypes)["v"]
    codes = C.materialise(entries.mapInPandas(index, f"entry bigint, ids array<bigint>, v {kind}, codes binary, norm float"), "ann-codes")
    total, n_entries = rows.count(), codes.count()
    stripes, blocks = min(MAX_STRIPES, max(1, -(-n_entries // STRIPE_CODES))), max(1, -(-total // (every * BLOCK_QUERIES)))
    queries = rows.where(F.col("vec_id") % every == 0)

    # codes that different vectors share cannot tell them apart: only these take their vectors along
    shared = codes.groupBy("codes").agg(F.count("*").alias("n")).where("n > 1")
    keyed = C.join_by_digest(codes, shared, "codes", "n", n_entries, "entry")

    deal = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda t: F.lit(None).cast(t)
    cols = ("q", "c", "kind", "id", "codes", "norm", "v")
    left = queries.select(to(stripes).alias("c"), deal("vec_id", blocks).alias("q"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), none("binary").alias("codes"), none("float").alias("norm"), "v")
    right = keyed.select(to(blocks).alias("q"), deal("entry", stripes).alias("c"), F.lit(1).alias("kind"), F.col("entry").alias("id"), "codes", "norm", F.when(F.col("n") > 1, F.col("v")).alias("v"))
    quota = share(rerank, stripes)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, odd = (stacked.shape[1] if books else 0), books % 2
        group, ids, vectors, plain, alike = None, [], [], None, None

        def result() -> pd.DataFrame:
            out = [(i, *best.of(q), best is alike) for best in (plain, alike) for q, i in enumerate(ids)]
            size = [len(x[1]) for x in out]
            return pd.DataFrame({"query_id": np.repeat([x[0] for x in out], size).astype("int64"), "entry": np.concatenate([x[2] for x in out]), "alike": np.repeat([x[3] for x in out], size), "approx": np.concatenate([x[1] for x in out])})

        for b in batches:
            at = b[["q", "c"]].to_numpy()
            starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(1)))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
                if group != (here := tuple(at[s])):
                    if plain:
                        yield result()
                    group, ids, vectors, plain, alike = here, [], [], None, None
                part = b.iloc[s:e]
                asked = part["kind"].to_numpy() == 0
                if asked.any():
                    ids += part["id"][asked].tolist()
                    vectors += part["v"][asked].to_list()
                part = part[~asked]
                if not len(part) or not ids:
                    continue
                if plain is None:  # a group's queries come first
                    plain, alike = Best(len(ids), quota), Best(len(ids), quota)
                    u = np.stack(vectors).astype(np.float64)
                entry, crowd = part["id"].to_numpy(), part["v"].notna().to_numpy()
                if crowd.any():
                    full = np.stack(part["v"][crowd].to_list()).astype(np.float64)
                    for q in range(len(ids)):
                        alike.add(q, full @ u[q], entry[crowd])
                if crowd.all():
                    continue
                one, scale = entry[~crowd], part["norm"].to_numpy()[~crowd]
                code = np.frombuffer(b"".join(part["codes"][~crowd]), dtype=np.uint8).reshape(len(one), books).T.astype(np.intp)
                # two books share one table of their sums: half the look-ups
                pairs = [code[m] * n + code[m + 1] for m in range(0, books - odd, 2)]
                for q in range(len(ids)):
                    table = stacked @ u[q].astype(np.float32)  # books x words
                    sums = (table[0 : books - odd : 2, :, None] + table[1::2, None, :]).reshape(len(pairs), -1)
                    x = table[-1][code[-1]] if odd else np.zeros(len(one), dtype=np.float32)
                    for t, at_ in zip(sums, pairs, strict=True):
                        x += t[at_]
                    plain.add(q, x * scale, one)
        if plain:
            yield result()

    met = left.select(*cols).union(right.select(*cols)).repartition("q", "c").sortWithinPartitions("q", "c", "kind")
    found = met.mapInPandas(scan, "query_id bigint, entry bigint, alike boolean, approx double")
    near = Window.partitionBy("query_id", "alike").orderBy(F.desc("approx"))
    chosen = found.withColumn("_r", F.rank().over(near)).where(F.col("_r") <= rerank).select("query_id", "entry").distinct()
    exact = chosen.join(codes.select("entry", "ids", "v"), "entry").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("u")), "query_id")
    each = exact.select("query_id", _dot("v", "u").alias("score"), F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    scored = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


C.ship(__name__)
