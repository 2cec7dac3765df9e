r"""Secret scanning over an incremental blob ledger, with DataFrame functions only.

Every version of every path is content-addressed by SHA-256. A blob is scanned
once per (rule, rule version), however many paths or commits hold it; the
ledger remembers what each pair gave, so a later run scans only unseen pairs.
Findings are joined back to all paths by digest.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str  # Java regular expression
    hint: str  # cheaper pattern that every match contains
    group: int  # this group ...
    least: int  # ... has so many characters at least
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which spans of equal start are listed.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i:passw|secret|token|api_?key)", 2, 8, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA", 0, 16, True),
    Rule("hex", 1, r"[0-9a-f]+", r"[0-9a-f]{32}", 0, 32, True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s]{64,}-----END [A-Z ]{0,24}PRIVATE KEY-----", r"PRIVATE KEY-----", 0, 100),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", r"eyJ", 0, 40),
    Rule("vcs", 1, r"(?:gh[pousr]|github_pat|glpat)[_-][A-Za-z0-9_-]{20,}", r"gh[pousr]_|github_pat|glpat", 0, 24),
)


def _spans(text: str, rule: Rule) -> Column:
    """The pieces between matches and the matches, as one struct, so that the hint
    is looked for once; null without the hint."""
    pattern = F.lit(rule.pattern)
    return F.when(F.col(text).rlike(rule.hint), F.struct(F.split(F.col(text), rule.pattern, -1).alias("gaps"), F.regexp_extract_all(F.col(text), pattern, F.lit(0)).alias("hits")))


SPAN = "array<struct<s:bigint,k:int,e:bigint,kind:string>>"


def _placed(gaps: Column, hits: Column, rule: Rule, order: int) -> Column:
    """Spans in code points: a match starts after all gaps and matches before it."""
    start = F.struct(F.lit(0).cast("bigint").alias("p"), F.array().cast(SPAN).alias("o"))

    def step(acc: Column, i: Column) -> Column:
        hit = F.get(hits, i)
        at = acc["p"] + F.length(F.get(gaps, i))
        end = at + F.length(hit)
        part = hit if rule.group == 0 else F.regexp_extract(hit, rule.pattern, rule.group)
        span = F.struct(at.cast("bigint").alias("s"), F.lit(order).alias("k"), end.cast("bigint").alias("e"), F.lit(rule.kind).alias("kind"))
        grown = F.when(F.length(part) >= rule.least, F.concat(acc["o"], F.array(span))).otherwise(acc["o"])
        return F.struct(end.cast("bigint").alias("p"), grown.alias("o"))

    some = F.size(hits) > 0
    return F.when(some, F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), start, step, lambda acc: acc["o"])).otherwise(F.array().cast(SPAN))


def scan_blobs(blobs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blobs`` (sha, text) to (sha, spans, seen): all spans of all rules.

    ``ledger`` (sha, rule, spans) supplies the pairs already scanned.
    """
    cols = [c for c in blobs.columns if c != "text"]
    if ledger is not None:
        known = ledger.where(F.col("rule").isin([r.key for r in rules])).groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct("rule", "spans"))).alias("_known"))
        blobs = blobs.join(known, "sha", "left")
    else:
        blobs = blobs.withColumn("_known", F.lit(None).cast(f"map<string,{SPAN}>"))
    for i, r in enumerate(rules):
        blobs = blobs.withColumn(f"_x{i}", F.when(F.col("_known")[r.key].isNull(), _spans("text", r)))
    spans = [F.coalesce(F.col("_known")[r.key], _placed(F.col(f"_x{i}.gaps"), F.col(f"_x{i}.hits"), r, i)) for i, r in enumerate(rules)]
    return blobs.select(*cols, *[s.alias(f"_s{i}") for i, s in enumerate(spans)])


def ledger_rows(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after a scan: one row per blob and rule version."""
    pairs = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.col(f"_s{i}").alias("spans")) for i, r in enumerate(rules)])
    return scanned.select("sha", F.explode(pairs).alias("_p")).select("sha", "_p.rule", "_p.spans")


def _joined(spans: Column) -> Column:
    sorted_ = F.array_sort(spans)
    return F.array_join(F.transform(sorted_, lambda x: F.concat(x["kind"], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def scan_versions(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings per path, and the findings of each distinct blob.

    ``versions`` has one row per path and version. The first result has one row
    per input row: the id, ``blob_sha256``, ``n_<kind>`` of every rule,
    ``base_sha256``, ``spans`` (``kind:start:end``, code points, end exclusive).
    The second is for ``ledger_rows``. Null texts count as empty, null ids are
    kept as they are, repeated rows are reported each, an empty table gives an
    empty result and columns beside the two named are ignored. Of overlapping
    spans of different rules, all are reported.
    """
    rows = versions.select(F.col(id_col).alias("doc_id"), C.whole_text(text_col).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    # the whole text is a grouping key: equal texts merge map-side, and a digest collision merges nothing
    blobs = rows.groupBy("sha", "text").agg(F.count(F.lit(1)).alias("n_paths"))
    # written before anything filters by findings: such a filter would move below the grouping and scan every copy
    scanned = C.materialise(scan_blobs(blobs, ledger, rules), "secrets-scanned")
    found = F.lit(False)
    for i in range(len(rules)):
        found = found | (F.size(f"_s{i}") > 0)
    base = F.concat(*[F.col(f"_s{i}") for i, r in enumerate(rules) if r.base])
    every = F.concat(*[F.col(f"_s{i}") for i in range(len(rules))])
    side = scanned.where(found).select("sha", "n_paths", *[F.size(f"_s{i}").cast("bigint").alias(f"n_{r.kind}") for i, r in enumerate(rules)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"))
    total = side.agg(F.coalesce(F.sum("n_paths"), F.lit(0))).first()[0]
    out = C.join_by_digest(rows.select("doc_id", "sha"), side, "sha", "n_paths", total, "doc_id")
    return out.select(
        "doc_id",
        *[F.coalesce(F.col(f"n_{r.kind}"), F.lit(0).cast("bigint")).alias(f"n_{r.kind}") for r in rules],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.col("sha").alias("blob_sha256"),
    ), scanned


def scan_history(versions: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The first result of ``scan_versions`` for all rows, taken in as ``batches``
    batches: each scans the pairs that the ledger of those before it has not seen."""
    out = None
    for i in range(batches):
        found, scanned = scan_versions(versions.where(F.pmod(F.xxhash64(id_col), F.lit(batches)) == i), id_col, text_col, ledger, rules)
        out = found if out is None else out.union(found)
        if i + 1 < batches:
            new = ledger_rows(scanned, rules)
            ledger = new if ledger is None else ledger.union(new.join(ledger.select("sha", "rule"), ["sha", "rule"], "left_anti"))
    return out


C.ship(__name__)
