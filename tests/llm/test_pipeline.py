"""The pipeline's stages against plain Python, on a small corpus."""

import re

import pytest

import corpus_pipeline as P
from sluice.llm import mixing, registry, toxicity

COLUMNS = list(P.COLUMNS)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Exact copies, near copies, toxic documents, a hot source and clean ones."""
    base = [" ".join(f"w{(i * 37 + j * j) % 997}" for j in range(60)) + "." for i in range(120)]
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(200 + i, base[i].upper(), "en", "s0") for i in range(20)]
    rows += [(300 + i, base[40 + i] + " tail", "en", "s0") for i in range(20)]
    rows += [(400 + i, base[60 + i % 40].replace("w1", "v1") + " you vile creature.", "en", "s0") for i in range(60)]
    rows += [(900, None, None, None), (901, "", "en", "s1")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 0, int(400 <= r[0] < 500)) for r in rows if r[0] < 900], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r[1] or "" for r in rows}


def test_stages(spark, corpus):
    path, texts = corpus
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, path)
        if name != P.STAGES[-1][0]:
            assert out.columns == COLUMNS
            out = spark.createDataFrame(out.collect(), out.schema)
            kept[name] = [r["doc_id"] for r in out.collect()]
            docs = out
    clean = {d for d in texts if not 400 <= d < 500}
    assert set(kept["toxicity"]) == clean
    groups = {}
    for d in clean:
        groups.setdefault(texts[d].lower(), []).append(d)
    assert set(kept["exact_dedup"]) == {max(g) for g in groups.values()}
    shingles = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d in kept["exact_dedup"] for w in [re.split(r"\s+", texts[d].lower())]}
    want = [d for d in kept["exact_dedup"] if not any(e < d and shingles[d] and 5 * len(shingles[d] & shingles[e]) >= 4 * len(shingles[d] | shingles[e]) for e in kept["exact_dedup"])]
    assert sorted(kept["near_dedup"]) == sorted(want)
    assert sorted(kept["mixing"]) == sorted(kept["near_dedup"])
    assert set(out.toPandas()["doc_id"]) == set(kept["mixing"])


def test_run_and_registry(spark, corpus):
    path, _ = corpus
    out = P.run(spark, path)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 50
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(names)


def test_keep_clean_keeps_all_columns(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert toxicity.keep_clean(docs, toxicity.Model({"vile": 30.0}, -14.0, 0.01)).columns == COLUMNS


def test_sequences_follow_the_mix_over_files(spark, tmp_path, monkeypatch):
    """The mix written to files of unequal size, which Spark reads largest first."""
    monkeypatch.setattr(P, "PART_DOCS", 700, raising=False)
    rows = [(i, f"w{i} " * (200 if i % 10 > 3 else 5), "en", "big" if i % 10 > 3 else f"s{i % 10}", 0) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    P.mix(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    got = P.pack(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").toPandas().groupby("doc_id")["sequence_id"].agg(["min", "max"])
    order = [r["doc_id"] for r in mixing.mix(docs).orderBy("_position").select("doc_id").collect()]
    first, last = got["min"].loc[order].tolist(), got["max"].loc[order].tolist()
    assert len(got) == 2400
    # a group holds 400 documents: those further apart are in sequences in the order of the mix
    assert all(max(last[: i + 1]) < min(first[i + 400 :]) for i in range(0, 2000, 50))


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, clashing columns, and no rows at all."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(None, None, None, None, None), (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, "en", None, None), (3, "x " * 20_000, None, "s", 40_000), (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (4, "", "en", "s", 0)]
    for name, data in (("odd", rows), ("empty", [])):
        path = f"{tmp_path}/{name}"
        table = spark.createDataFrame(data, schema)
        table.selectExpr("*", *[f"'clash' AS {c}" for c in ("_row", "_id", "_slot", "kept", "comp", "_gone", "sequence_id")]).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (None, None, None), (3, 1, None)] if data else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
        for stage, f in P.STAGES:
            docs = f(spark, docs, path)
            if stage != "packing":
                assert docs.columns == COLUMNS
                docs = spark.createDataFrame(docs.collect(), docs.schema)
                seen.append(sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in docs.collect()))
        if data:
            # the largest id of the empty texts stays, a repeated row and an unnamed text stay once
            assert len(seen[0]) == len(rows) and seen[1] == seen[2] == seen[3] == [("1", "a b c"), ("3", "x x x"), ("4", ""), ("None", "no id")]
            assert {str(r["doc_id"]) for r in docs.collect()} <= {"1", "3", "4", "None", "<NA>"} and docs.where("start = 0").count() == 4
        else:
            assert docs.count() == 0 and not any(seen)
