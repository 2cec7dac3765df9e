"""MinHash near-duplicates by a signature-coordinate inverted join.

Equal shingle sets collapse first, so copies cost one member each. Every set
has COORDS MinHash coordinates; a coordinate with its value is an element, and
documents whose elements collide at least MATCHES times are candidates. At
similarity 0.8 a link has fewer collisions with probability 1.2e-6; candidates
are confirmed on full shingle sets.

*Posting with prefixes.* Elements are counted over all documents. One that a
single document has can collide with nothing, and a document with fewer than
MATCHES others has no candidate: both are skipped. Of a document's m elements
that are left, in one order for all documents (rarest first), it is posted under
the first m - MATCHES + 1: two documents with MATCHES elements in common always
share one of those. Frequent elements are rarely in a prefix.

*Counting.* A posting carries the signature, a byte a coordinate, so a list
counts the collisions of its members where they meet, and a task merges the
lists' candidates on the spot: it keeps a spanning forest of them, not pairs.
Lists of more than BLOCK members meet in blocks.

*Links.* The forest's edges are confirmed, links merge components, and only
documents with a candidate go on: once more with other forests, then exactly.
Members with a candidate in another component form clusters, and within a
cluster the documents outside its largest component meet all others, on full
sets, in blocks of a bounded size. A block gives a spanning forest of its links,
so no link between components is lost and no list of pairs is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

COORDS = 32
MATCHES = 14
#: Rounds of forests, before the clusters.
ROUNDS = 2
#: Members of a posting list, and full sets, that meet in one task.
BLOCK = 2048
SET_BLOCK = 256
#: Pairs of members whose collisions are counted at a time.
PAIRS = 1 << 17
_SEED = np.random.default_rng(20240229)
MULTIPLY = _SEED.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _SEED.integers(0, 2**63, COORDS, dtype=np.uint64)


class WordHash(dict):
    """64-bit hashes of words; bounded."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h
        return h


def shingle_set(text: str, k: int, words: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles. bytes.lower and
    bytes.split know A-Z and the six ASCII white-space characters only."""
    w = text.encode().lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, w), dtype=np.uint64, count=len(w))
    k = min(k, len(w))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.empty(COORDS, dtype=np.uint32)
        for i in range(COORDS):
            out[i] = ((s * MULTIPLY[i] + ADD[i]) >> np.uint64(32)).min()
    return out.view(np.int32)


def prepare(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, at, n_shingles, set_key, sig, bytes) of each row of (doc_id, at, text); ``at`` is a hash of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        words = WordHash()
        for b in batches:
            rows = []
            for t in b["text"]:
                s = shingle_set(t, k, words)
                sig = signature(s) if len(s) else None
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), sig, sig.astype(np.uint8).tobytes()) if len(s) else (0, None, None, None))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "at": b["at"], "n_shingles": [r[0] for r in rows], "set_key": [r[1] for r in rows], "sig": [r[2] for r in rows], "bytes": [r[3] for r in rows]})

    return docs.mapInPandas(run, "doc_id bigint, at bigint, n_shingles bigint, set_key binary, sig array<int>, bytes binary")


def confirm(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) of (a, b, ta, tb) whose full sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, last = WordHash(), (None, None)
        for b in batches:
            keep = []
            for a, ta, tb in zip(b["a"], b["ta"], b["tb"], strict=True):
                if last[0] != a:
                    last = (a, shingle_set(ta, k, words))
                y = shingle_set(tb, k, words)
                both = len(np.intersect1d(last[1], y, assume_unique=True))
                keep.append(100 * both >= percent * (len(last[1]) + len(y) - both))
            yield b.loc[keep, ["a", "b"]]

    return pairs.select("a", "b", "ta", "tb").mapInPandas(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of (a, b) edges reaches.

    Labels fall to the least of the neighbours' labels and then to the label of
    the label, until nothing changes; labels are written each round.
    """
    both = C.materialise(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = C.materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("low"))
        low = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        up = labels.select(F.col("node").alias("up"), F.col("comp").alias("upper"))
        new = C.materialise(low.join(up, F.col("comp") == F.col("up"), "left").select("node", "was", F.least("comp", "upper").alias("comp")), "labels")
        C.discard(labels)
        labels = new
        if not new.where("was <> comp").take(1):
            C.discard(both)
            return new.select("node", "comp")


def postings(nodes: DataFrame) -> DataFrame:
    """Each document of (node, n, sig, bytes) with its prefix: ``keys`` of (df, key), rarest
    first. Documents with fewer than MATCHES elements that others have are left out."""
    elements = nodes.select("node", F.posexplode("sig").alias("i", "value")).select("node", (F.shiftleft(F.col("i").cast("bigint"), 32) + F.col("value").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    counts = C.materialise(elements.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "near-counts")
    total = counts.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    common = C.join_by_digest(elements, counts, "key", "df", total, "node").where("df is not null")
    own = common.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("e")).where(F.size("e") >= MATCHES)
    prefix = own.select("node", F.slice("e", F.lit(1), F.size("e") - (MATCHES - 1)).alias("keys"))
    out = C.materialise(prefix.join(nodes, "node").select("node", "keys", "n", "bytes"), "near-prefixes")
    C.discard(counts)
    return out


def spanning(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Indices of a spanning forest of the edges (a, b) of nodes 0 to ``nodes`` - 1; earlier edges come first."""
    label, chosen, live = np.arange(nodes), [], np.flatnonzero(a != b)
    while len(live):  # each component takes its first edge; no two are equal, so no cycle arises
        best = np.full(nodes, len(a))
        np.minimum.at(best, label[a[live]], live)
        np.minimum.at(best, label[b[live]], live)
        taken = np.unique(best[best < len(a)])
        chosen.append(taken)
        x, y = label[a[taken]], label[b[taken]]
        parent = np.arange(nodes)
        while (parent[x] != parent[y]).any():  # the least label spreads over the edges taken
            low = np.minimum(parent[x], parent[y])
            np.minimum.at(parent, parent[x], low)
            np.minimum.at(parent, parent[y], low)
            while (parent[parent] != parent).any():
                parent = parent[parent]
        label = parent[label]
        live = live[label[a[live]] != label[b[live]]]
    return np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)


def forest(rows: DataFrame, percent: int, seed: int | None, merge: bool) -> DataFrame:
    """Edges (a, b) of candidates, a spanning forest in each group of ``cols``.

    Candidates have at least MATCHES collisions, sizes that allow a link, and
    different components. With ``merge`` components count as one node; without,
    each document does. Edges of many collisions come first, or, with a
    ``seed``, in an order by hash."""
    groups = [c for c in rows.columns if c not in ("node", "comp", "n", "bytes")]

    def pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) of the rows that meet, at most about PAIRS at a time."""
        left = np.concatenate([np.arange(s, s + n - 1) for s, n in zip(starts, sizes, strict=True)])
        count = np.repeat(starts + sizes, sizes - 1) - left - 1
        ends = np.cumsum(count)
        at = 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            i = np.repeat(left[at:to], count[at:to])
            first = np.repeat(ends[at:to] - count[at:to], count[at:to]) - (ends[at - 1] if at else 0)
            yield i, i + 1 + np.arange(len(i)) - first
            at = to

    def candidates(node: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, label = np.unique(comp if merge else node, return_inverse=True)
        # a component is told apart in each group
        group = np.zeros(len(node), dtype=np.int64)
        group[np.concatenate([np.arange(s, s + k) for s, k in zip(starts, sizes, strict=True)])] = np.repeat(np.arange(len(starts)), sizes)
        _, label = np.unique(group * (label.max() + 1) + label, return_inverse=True)
        ii, jj, hh = [], [], []
        for i, j in pairs(starts, sizes):
            may = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
            i, j = i[may], j[may]
            hits = (sig[i] == sig[j]).sum(1)
            may = hits >= MATCHES
            ii.append(i[may])
            jj.append(j[may])
            hh.append(hits[may])
        i, j, hits = np.concatenate(ii), np.concatenate(jj), np.concatenate(hh)
        low, high = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        if seed is None:  # pairs that are almost surely links go by their ids, so lists with the same members choose the same
            first = np.lexsort((high, low, -np.minimum(hits, COORDS - 4)))
        else:
            mixed = low.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + high.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed)
            first = np.argsort((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93), kind="stable")
        at = first[spanning(label[i[first]], label[j[first]], int(label.max()) + 1)]
        return low[at], high[at]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by group; a group may go over the end of a batch, most have a few rows
        held = None
        for b in (*batches, None):
            rows = held if b is None else b if held is None else pd.concat([held, b], ignore_index=True)
            if rows is None or not len(rows):
                continue
            keys = rows[groups].to_numpy()
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
            ends = np.append(starts[1:], len(rows))
            if b is not None:
                held = rows.iloc[starts[-1] :]
                starts, ends = starts[:-1], ends[:-1]
            starts, sizes = starts[ends - starts > 1], (ends - starts)[ends - starts > 1]
            if not len(starts):
                continue
            sig = np.frombuffer(b"".join(rows["bytes"]), dtype=np.uint8).reshape(len(rows), COORDS)
            with np.errstate(over="ignore"):
                low, high = candidates(rows["node"].to_numpy(), rows["comp"].to_numpy(), rows["n"].to_numpy(), sig, starts, sizes)
            yield pd.DataFrame({"a": low, "b": high})

    return rows.repartition(*groups).sortWithinPartitions(*groups, "node").mapInPandas(run, "a bigint, b bigint").distinct()


def in_blocks(docs: DataFrame, seed: int) -> DataFrame:
    """Members of each list in blocks, which are others with another seed."""
    each = docs.select("node", "comp", "n", "bytes", F.explode("keys").alias("k")).select(F.col("k.key").alias("key"), F.ceil(F.col("k.df") / F.lit(BLOCK)).alias("blocks"), "node", "comp", "n", "bytes")
    return each.select("key", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")).alias("block"), "node", "comp", "n", "bytes")


def all_blocks(docs: DataFrame) -> DataFrame:
    """Members of the lists that hold several components, in blocks in which each member
    outside a list's largest component meets all others."""
    each = docs.select("node", "comp", F.explode("keys.key").alias("key"))
    counts = each.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    large = counts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("x"), F.sum("c").alias("m")).where("m > x.c").select("key", F.col("x.comp").alias("main"), "m", (F.col("m") - F.col("x.c")).alias("n_out"))
    large = C.materialise(large, "near-lists")
    total = large.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    rows = C.join_by_digest(each, large, "key", "m", total, "node").where("m is not null")
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK))
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(6)), blocks(n))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), blocks(n) - 1)
    one = rows.where((F.col("m") <= BLOCK)).select("key", F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j"), "node")
    many = rows.where(F.col("m") > BLOCK)
    # a document outside its list's largest component is on both sides
    left = many.where("comp <> main").select("key", own("n_out").alias("i"), F.explode(every("m")).alias("j"), "node")
    right = many.select("key", F.explode(every("n_out")).alias("i"), own("m").alias("j"), "node")
    return one.union(left.union(right).distinct()).join(docs.select("node", "comp", "n", "bytes"), "node")


def across(members: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between components within clusters: (cluster, node, comp, text).

    Documents outside the largest component of their cluster meet all of the
    cluster, block by block; a block gives a spanning forest of its links."""
    counts = members.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("c"))
    large = counts.groupBy("cluster").agg(F.max(F.struct("c", "comp")).alias("x"), F.sum("c").alias("m")).select("cluster", F.col("x.comp").alias("main"), "m", (F.col("m") - F.col("x.c")).alias("n_out"))
    large = C.materialise(large, "near-sizes")
    total = large.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    rows = C.join_by_digest(members, large, "cluster", "m", total, "node")
    blocks = lambda n: F.ceil(F.greatest(F.col(n), F.lit(1)) / F.lit(SET_BLOCK)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(6)), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    cols = ("cluster", "i", "j", "node", "comp", "text")
    left = rows.where("comp <> main").withColumn("i", own("n_out")).withColumn("j", every("m")).select(*cols).toDF(*cols)
    right = rows.withColumn("j", own("m")).withColumn("i", every("n_out")).select(*cols).toDF(*cols)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            words = WordHash()
            sets = [shingle_set(t, k, words) for t in b["text"]]
            sizes, comp = np.array([len(x) for x in sets]), b["comp"].to_numpy()
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            for c, t in zip(a["comp"], a["text"], strict=True):
                x = shingle_set(t, k, words)
                at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
                both = np.bincount(owner[x[at] == flat], minlength=len(sets))
                out.append(np.flatnonzero((comp != c) & (100 * both >= percent * (sizes + len(x) - both))))
            i, j = np.repeat(np.arange(len(a)), [len(x) for x in out]), np.concatenate(out)
            names, label = np.unique(np.concatenate([a["comp"].to_numpy()[i], comp[j]]), return_inverse=True)
            at = spanning(label[: len(i)], label[len(i) :], len(names))
            return pd.DataFrame({"a": a["node"].to_numpy()[i[at]], "b": b["node"].to_numpy()[j[at]]})
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")

    keys = ("cluster", "i", "j")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when the Jaccard similarity of their sets of
    ``shingle``-word shingles is at least ``percent`` / 100; words are
    separated by ASCII white space, A-Z is lower-cased, a document of fewer
    words is one shingle. ``component_id`` is the smallest id reachable by
    links. A null or empty text has no shingle and no link. Rows with a null id
    make no link themselves, and take the component of an equal set that has an
    id. Repeated rows are reported each, as are different texts under one id.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = C.small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), C.whole_text(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("at"), "text")
    prep = C.materialise(prepare(rows, shingle), "near-prep")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "at"))).alias("first")
    classes = prep.where("n_shingles > 0").groupBy("set_key", F.col("n_shingles").alias("n"), "sig").agg(first, F.count(F.lit(1)).alias("size"), F.first("bytes").alias("bytes"))
    classes = C.materialise(classes.select(F.monotonically_increasing_id().alias("node"), "set_key", "n", "sig", "bytes", F.col("first.doc_id").alias("rep"), F.col("first.at").alias("at"), "size"), "near-classes")
    docs_in = postings(classes.where("rep is not null").select("node", "n", "sig", "bytes"))

    texts: list[DataFrame] = []

    def text_of(nodes: DataFrame) -> DataFrame:
        """(node, text) of at least these nodes; each text is looked up once."""
        new = nodes.distinct()
        for t in texts:
            new = new.join(t.select("node"), "node", "left_anti")
        new = C.materialise(new.join(classes, "node").select("node", F.col("rep").alias("doc_id"), "at"), "near-wanted")
        few = new.limit(C.BROADCAST_IDS + 1).count() <= C.BROADCAST_IDS
        found = rows.join(F.broadcast(new) if few else new, ["doc_id", "at"]).select("node", "text").dropDuplicates(["node"])
        texts.append(C.materialise(found, "near-texts"))
        C.discard(new)
        out = texts[0]
        for t in texts[1:]:
            out = out.union(t)
        return out

    def confirmed(pairs: DataFrame) -> DataFrame:
        text = text_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        side = lambda c: text.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
        return C.materialise(confirm(pairs.join(side("b"), "b").join(side("a"), "a"), shingle, percent), "near-links")

    def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after links merge their components."""
        comp = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
        merged = components(links.join(comp("a"), "a").join(comp("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        new = labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        new = C.materialise(new, "near-labels")
        C.discard(labels)
        C.discard(links)
        return new

    # a spanning forest touches every document with a candidate; lists of several blocks stay open as a whole
    edges = C.materialise(forest(in_blocks(docs_in.withColumn("comp", F.col("node")), 0), percent, None, True), "near-edges")
    touched = edges.select(F.explode(F.array("a", "b")).alias("node")).union(docs_in.where(F.exists("keys", lambda x: x["df"] > BLOCK)).select("node")).distinct()
    still = C.materialise(docs_in.join(touched, "node", "left_semi"), "near-open")
    C.discard(docs_in)
    labels = joined(C.materialise(still.select("node", F.col("node").alias("comp")), "near-labels"), confirmed(edges))
    C.discard(edges)
    for r in range(1, ROUNDS):
        edges = C.materialise(forest(in_blocks(still.join(labels, "node"), r), percent, r, True), "near-edges")
        labels = joined(labels, confirmed(edges))
        C.discard(edges)

    near = C.materialise(forest(all_blocks(still.join(labels, "node")), percent, None, False), "near-edges")
    clusters = components(near)
    whole = clusters.select("node", F.col("comp").alias("cluster")).join(labels, "node").join(text_of(clusters.select("node")), "node")
    labels = joined(labels, C.materialise(across(C.materialise(whole, "near-clusters"), shingle, percent), "near-links"))
    for t in (*texts, near, still):
        C.discard(t)

    least = labels.join(classes, "node").groupBy("comp").agg(F.min("rep").alias("least"))
    found = labels.join(least, "comp").select("node", "least")
    side = classes.join(found, "node", "left").select("set_key", "size", F.coalesce("least", "rep").alias("comp"))
    own = prep.select("doc_id", "n_shingles", F.coalesce("set_key", F.unhex(F.hex(F.xxhash64("doc_id")))).alias("set_key"))
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    out = C.join_by_digest(own, side, "set_key", "size", total, "doc_id")
    comp = F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component the smallest id.

    Rows with a null id cannot be told apart and stay. Of rows with one id and
    equal texts one stays; different texts under one id stay both."""
    dropped = near_duplicates(docs, shingle, percent, id_col, text_col).where("not kept and doc_id is not null").select("doc_id")
    return C.once(C.without(docs, id_col, dropped), id_col, text_col)


C.ship(__name__)
