"""The registered queries of this subpackage, with production parameters, and
their SQL. Each is a thin layer: rows come from the operator, the query only
derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import ann, exact_dedup, html_text, licenses, mixing, near_dedup, packing, pii, secrets, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(C.read(spark, sf_dir, "documents"), None)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_history(C.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(C.read(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("doc_id", "source", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_position").alias("position"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(C.read(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(C.read(spark, sf_dir, "documents"), shingle=2, percent=80)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")).drop("sentences")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(C.read(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(C.read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["base"])
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed("found").alias("spans"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(C.read(spark, sf_dir, "documents")).drop("places")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(C.read(spark, sf_dir, "embeddings"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NORM = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op2_sql() -> str:
    """Matches lie between the pieces of a split: starts are sums of lengths."""
    parts, kinds = [], []
    for i, r in enumerate(secrets.RULES):
        pattern = r.pattern
        for name in (r"\x20", r"\s"):
            pattern = pattern.replace(name, {r"\x20": " ", r"\s": r"\s"}[name])
        size = "length(m[j])" if r.group == 0 else f"length(regexp_extract(m[j], {_q(pattern)}, {r.group}))"
        parts.append(f"""
        SELECT doc_id, '{r.kind}' AS kind, {i} AS k, {str(r.base).lower()} AS base,
               list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS s, length(m[j]) AS n
        FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS j FROM
              (SELECT doc_id, regexp_extract_all(text, {_q(pattern)}) AS m, string_split_regex(text, {_q(pattern)}) AS g FROM d))
        WHERE {size} >= {r.least}""")
        if r.base:
            kinds.append(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    spans AS ({" UNION ALL ".join(parts)}),
    a AS (SELECT doc_id, {", ".join(kinds)},
                 coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, k) FILTER (base), '') AS b,
                 string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, k) AS spans
          FROM spans GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (doc_id)"""


def _op9_sql() -> str:
    """Words as a list; a place of a phrase is a start whose slice equals it."""
    places = []
    for t in licenses.TEMPLATES:
        words = t.phrase.split(" ")
        places.append(f"""
        SELECT doc_id, '{t.label}' AS label, {str(t.base).lower()} AS base, {len(words)} AS n, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + {len(words)}] = {words!r})) AS s
        FROM d WHERE list_contains(w, '{words[0]}') AND list_contains(w, '{words[-1]}')""")
    return rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_NORM}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    p AS ({" UNION ALL ".join(places)}),
    a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, sum(n) AS covered
          FROM p GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(1.0 AS DOUBLE) - CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + coalesce(covered, 0)) AS score
    FROM d LEFT JOIN a USING (doc_id)"""


OP5_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_NORM}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.b AS component_id, d.doc_id = m.b AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id
"""


def queries() -> dict[str, Query]:
    return {
        "op1_packing": op1_packing,
        "op2_secrets": op2_secrets,
        "op3_mixing": op3_mixing,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_near_dedup": op5_near_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_html_text": op7_html_text,
        "op8_pii": op8_pii,
        "op9_licenses": op9_licenses,
        "op10_ann": op10_ann,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": _op2_sql(), "op4_exact_dedup": OP4_SQL, "op5_near_dedup": OP5_SQL, "op9_licenses": _op9_sql()}
