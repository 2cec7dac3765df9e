"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag is labelled. A sentence has
the probability sigmoid(bias + sum of its words' weights); a document combines
them by a noisy-or with a leak, which takes up labels that no sentence
explains. Weights are fitted on the driver from a bounded sample of labelled
documents; scoring is one pass without a shuffle, and the sentences at or over
the threshold are located.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Labelled documents that a model is fitted on, at most, and its vocabulary.
MAX_TRAIN = 20_000
MAX_WORDS = 256
#: A vocabulary word occurs in so many labelled documents at least.
LEAST_DOCS = 4
#: Features beside whole words: the first letters of words, written with a star.
PREFIXES = (3, 5, 7)
#: Limit of the bias: a sentence without vocabulary words is at most this likely.
MAX_BIAS = -14.0

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*\n?|[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: The same words, for Java.
WORD_GAP = r"[^\p{L}\p{M}]+"


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    leak: float

    def sentence(self, words: set[str]) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + sum(self.weights[w] for w in sorted(words))))))


def split_vocabulary(names) -> dict[int, set[str]]:
    """Whole words under 0, prefixes under their length."""
    out: dict[int, set[str]] = {n: set() for n in (0, *PREFIXES)}
    for w in names:
        out[len(w) - 1 if w.endswith("*") else 0].add(w)
    return {n: v for n, v in out.items() if v}


def hits(words: set[str], vocabulary: dict[int, set[str]]) -> set[str]:
    out: set[str] = set()
    for n, v in vocabulary.items():
        out |= v & ({f"{w[:n]}*" for w in words if len(w) >= n} if n else words)
    return out


def bag(text: str, vocabulary: dict[int, set[str]]) -> tuple[list[tuple[int, int, set[str]]], int]:
    """Sentences with vocabulary features as (start, end, features), and the count of the others."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change length; positions must not
        low = "".join(x if len(x) == 1 else c for c in text for x in [c.lower()])
    if not hits(set(WORD.findall(low)), vocabulary):
        return [], len(SENTENCE.findall(low))
    found, others = [], 0
    for m in SENTENCE.finditer(low):
        if words := hits(set(WORD.findall(m[0])), vocabulary):
            found.append((m.start(), m.end(), words))
        else:
            others += 1
    return found, others


def sample(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents outside the held-out fold, at
    most ``most`` of them, the first by a hash of the id; equal texts count once."""
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id"))
    chosen = known.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(most)
    # at most `most` rows of two integers
    rows = docs.join(F.broadcast(chosen), "doc_id")
    return rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min(F.struct("doc_id", "toxic", "text")).alias("x")).select("x.doc_id", "x.text", "x.toxic")


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def choose_words(train: DataFrame, most_words: int = MAX_WORDS) -> list[str]:
    """Words that toxic documents have significantly more often: ``most_words`` at
    most, of the highest likelihood ratio."""
    one = F.array_remove(F.array_distinct(F.split(F.lower("text"), WORD_GAP, -1)), "")
    begin = lambda n: F.array_distinct(F.transform(F.filter("one", lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))))
    words = train.select("toxic", one.alias("one")).select("toxic", F.explode(F.concat("one", *[begin(n) for n in PREFIXES])).alias("w"))
    n1, n0 = train.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not n1 or not n0:
        return []
    df = words.groupBy("w").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    ratio = (a / n1) / ((b + 0.5) / n0)
    expect = (a + b) * (n1 / (n1 + n0))
    gain = a * F.log(a / expect) + F.when(b > 0, b * F.log(b / (a + b - expect))).otherwise(0.0)
    top = df.where((a + b >= LEAST_DOCS) & (ratio > 2) & (a > 0)).select("w", gain.alias("g")).where("g > 5")
    return [r["w"] for r in top.orderBy(F.desc("g"), "w").limit(most_words).collect()]


def fit_bags(bags: list[tuple[int, list[list[int]], int]], words: list[str], steps: int = 500, rate: float = 0.1, ridge: float = 1e-5) -> Model:
    """Maximum likelihood of the leaky noisy-or, by Adam over all bags at once.

    A bag: its label, the word indices of its sentences, the number of sentences without any."""
    y = np.array([b[0] for b in bags], dtype=float)
    owner = np.array([i for i, b in enumerate(bags) for _ in b[1]], dtype=int)
    sent = np.array([j for j, s in enumerate(s for b in bags for s in b[1]) for _ in s], dtype=int)
    word = np.array([w for b in bags for s in b[1] for w in s], dtype=int)
    bare = np.array([b[2] for b in bags], dtype=float)
    n_sent = len(owner)
    # weights, bias, leak as a logit; at weights near -bias a word is uncertain evidence and the slope is large
    x = np.concatenate([np.full(len(words), -0.9 * MAX_BIAS), [MAX_BIAS, -4.0]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for t in range(1, steps + 1):
        z = x[-2] + np.bincount(sent, x[:-2][word], n_sent) if n_sent else np.zeros(0)
        p, p0, leak = sig(z), sig(x[-2]), sig(x[-1])
        # log of the probability that nothing fires
        quiet = np.log1p(-leak) + bare * np.log1p(-p0) + np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags))
        quiet = np.minimum(quiet, -1e-9)
        # d loss / d quiet: 1 for label 0 is -1, for label 1 is exp(quiet) / (1 - exp(quiet))
        g = np.where(y == 1, np.exp(quiet) / -np.expm1(quiet), -1.0) / len(bags)
        dz = g[owner] * -p if n_sent else np.zeros(0)
        grad = np.zeros_like(x)
        grad[:-2] = np.bincount(word, dz[sent], len(words)) if n_sent else 0
        grad[-2] = dz.sum() + (g * bare * -p0).sum()
        grad[-1] = (g * -leak).sum()
        grad = -grad  # of the log likelihood, uphill
        grad[:-2] -= ridge * x[:-2]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        x[:-2] = np.maximum(x[:-2], 0)  # a word is evidence or none
        x[-2] = min(x[-2], MAX_BIAS)
        x[-1] = min(x[-1], -2.0)  # the leak alone never decides
    return Model(dict(zip(words, x[:-2].tolist(), strict=True)), float(x[-2]), float(sig(x[-1])))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, most_words: int = MAX_WORDS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic): of at most
    ``most`` labelled documents and ``most_words`` vocabulary words."""
    train = C.materialise(sample(C.small_batches(docs), labels, most), "toxic-sample")
    words = choose_words(train, most_words)
    index = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = split_vocabulary(index)
        for b in batches:
            got = [bag(t, vocabulary) for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "sentences": [[sorted(index[w] for w in s[2]) for s in f] for f, _ in got], "bare": [n for _, n in got]})

    # one short row for each sampled document
    rows = train.mapInPandas(run, "toxic int, sentences array<array<int>>, bare int").collect()
    C.discard(train)
    return fit_bags([(r["toxic"], r["sentences"], r["bare"]) for r in rows], words) if words else Model({}, MAX_BIAS, 0.01)


def document_score(model: Model, found: list[tuple[int, int, set[str]]], bare: int) -> float:
    """The leaky noisy-or of all sentences."""
    quiet = math.log1p(-model.leak) + bare * math.log1p(-model.sentence(set()))
    return -math.expm1(quiet + sum(math.log1p(-min(model.sentence(w), 1 - 1e-12)) for _, _, w in found))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, sentences) of (doc_id, text); ``sentences`` are the offending
    ones as (start, end, score) in code points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = split_vocabulary(model.weights)
        for b in batches:
            scores, spans = [], []
            for t in b["text"]:
                found, bare = bag(t, vocabulary)
                scores.append(document_score(model, found, bare))
                spans.append([{"start": s, "end": e, "score": p} for s, e, w in found if (p := model.sentence(w)) >= threshold])
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": scores, "sentences": spans})

    return C.small_batches(docs).mapInPandas(run, "doc_id bigint, score double, sentences array<struct<start:bigint,end:bigint,score:double>>")


def keep_clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose own text scores under ``threshold``, all columns, in one pass."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = split_vocabulary(model.weights)
        for texts in batches:
            yield pd.Series([document_score(model, *bag(t, vocabulary)) for t in texts])

    return C.small_batches(docs).where(F.pandas_udf(run, "double")(C.whole_text(text_col)) < threshold)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN, threshold: float = 0.5, most_words: int = MAX_WORDS) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score``, ``predicted``, ``sentences``.

    Fitted on at most ``most`` labelled rows outside the held-out fold (crc32 of
    the id as text, mod 5, is 0). Null texts count as empty and get the score of a
    document without sentences. A null id is never a training row and its
    ``held_out`` is false. Labels other than 0 and 1 are ignored; of several
    labels of one id the highest counts. Without both labels, or with an empty
    table, every score is the leak. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), C.whole_text(text_col).alias("text"))
    model = fit(rows, labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), most, most_words)
    out = score(rows, model, threshold)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")


C.ship(__name__)
