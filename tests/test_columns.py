"""The columnar compiler against the record evaluator, and what Spark sees."""

import json
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sluice import api, dynamic
from sluice.errors import EvalError
from sluice.plans.parse import parse_rule
from sluice.values import MISSING

SCHEMA = "n bigint, x double, s string, b boolean, a array<bigint>, w array<string>, o struct<p:string,q:bigint>"
EXPRS = [
    ["@input.s", "trim", "uppercase"], ["@input.s", {"concat": ["-", "@input.n", "@input.x"]}], ["@input.s", {"replace": ["a", "_"]}], ["@input.s", {"replace": ["[a-b]", "<$0>", "regex_all"]}],
    ["@input.s", {"split": ["a"]}], ["@input.s", {"pad_start": [6, "xy"]}], ["@input.s", "len"], ["@input.n", {"+": [1, "@input.x"]}], ["@input.n", {"*": [2]}], ["@input.x", {"round": [1]}], ["@input.n", {"to_base": [7]}],
    ["@input.n", {">": ["@input.x"]}], ["@input.s", {"==": ["@input.n"]}], ["@input.b", {"and": [["@input.n", {">": [0]}]]}], ["@input.b", "not"], ["@input.a", "sum"], ["@input.a", "max"], ["@input.a", "avg"],
    ["@input.a", {"take": [-2]}], ["@input.a", {"drop": [1]}], ["@input.a", {"slice": [-3, -1]}], ["@input.a", {"chunk": [2]}], ["@input.a", {"filter": [["@item", {">": [0]}]]}], ["@input.a", {"map": [{"+": [1]}]}],
    ["@input.a", {"sort_by": ["@item", "desc"]}], ["@input.w", {"sort_by": ["@item"]}], ["@input.a", "unique"], ["@input.a", {"find": [["@item", {"<": [0]}]]}], ["@input.a", {"find_index": [["@item", {"<": [0]}]]}],
    ["@input.a", {"index_of": [1]}], ["@input.w", {"contains": ["a"]}], ["@input.a", {"zip": ["@input.a"]}], ["@input.a", {"partition": [["@item", {">": [0]}]]}], ["@input.a", {"fold": [0, ["@acc", {"+": ["@item"]}]]}],
    ["@input.w", {"reduce": [["@acc", {"concat": ["@item"]}]]}], ["@input.w", {"group_by": ["@item"]}], ["@input.a", {"key_by": ["@item"]}], ["@input.w", {"distinct_by": [["@item", "len"]]}], ["@input.a", "first"], ["@input.n", {"coalesce": [0]}],
    ["@input.o", {"merge": [{"q": 5}]}], ["@input.o", {"pick": ["p"]}], ["@input.o", {"omit": ["p"]}], ["@input.o", "keys"], ["@input.o", "object_flatten"], ["@input.o", {"get": ["q"]}],
    ["@input.s", {"if": {"cond": {"match": ["$", "a"]}, "then": "yes", "else": "@input.s"}}], ["@input.n", {"let": {"d": ["$", {"*": [2]}]}}, "@d", {"if": {"cond": {"gt": ["$", 3]}, "then": "big", "else": "small"}}],
]



def some_records(seed, n=40):
    """Random records: short texts with blanks, small numbers, empty arrays."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("ab1 é") for _ in range(rnd.randint(0, 5)))
    return [
        {
            "n": rnd.randint(-50, 50), "x": rnd.randint(-400, 400) / 8, "s": word(), "b": rnd.random() < 0.5, "a": [rnd.randint(-3, 3) for _ in range(rnd.randint(0, 5))],
            "w": [word() for _ in range(rnd.randint(0, 4))], "o": {"p": word(), "q": rnd.randint(0, 9)},
        }
        for _ in range(n)
    ]


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(close, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(close(v, b[k]) for k, v in a.items())
    return a == b


@pytest.mark.parametrize("part", range(0, len(EXPRS), 6))
def test_tiers_agree(spark, part):
    exprs, rows = EXPRS[part : part + 6], some_records(part)
    rule = parse_rule({"version": 2, "input": {"format": "json"}, "mappings": [{"target": f"e{i}", "expr": e} for i, e in enumerate(exprs)]})
    df = spark.createDataFrame([(r["n"], r["x"], r["s"], r["b"], r["a"], r["w"], (r["o"]["p"], r["o"]["q"])) for r in rows], SCHEMA)
    c = api.compiled(df, rule)
    assert c.fallbacks == []
    got = [json.loads(r["value"]) for r in c.json("null").collect()]
    for i, e in enumerate(exprs):
        one = parse_rule({"version": 2, "input": {"format": "json"}, "mappings": [{"target": "v", "expr": e}]})
        for r, g in zip(rows, got, strict=True):
            try:
                want = dynamic.run(one, r)[0].get("v", MISSING)
            except dynamic.EvalError:
                continue
            assert close(g.get(f"e{i}", MISSING), want) or want is MISSING and f"e{i}" not in g, (e, r)


def test_pushdown_and_pruning(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") * 2).alias("y"), F.lit("z").alias("unused")).write.parquet(str(tmp_path / "t"))
    out = api.transform(spark.read.parquet(str(tmp_path / "t")), {"version": 2, "input": {"format": "json"}, "record_when": {"gt": ["@input.id", 50]}, "mappings": [{"target": "y", "source": "y"}]})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id" in plan and "unused" not in plan
    assert out.count() == 49


def test_modes(spark):
    df = spark.createDataFrame([(1, "4"), (2, "x")], "id bigint, s string")
    rule = {"version": 2, "input": {"format": "json"}, "mappings": [{"target": "id", "source": "id"}, {"target": "n", "source": "s", "type": "int"}]}
    with pytest.raises(PySparkException, match="TypeCastFailed"):
        api.transform(df, rule).collect()
    rows = api.transform(df, rule, mode="quarantine").orderBy("_error").collect()
    assert [(r["n"], r["_error"] is None) for r in rows] == [(4, True), (None, False)]
    assert api.preflight(df, rule) == [{"error": "TypeCastFailed: value cannot be cast to int (path: mappings[1])", "records": 1}]


def test_lookup_never_multiplies(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k bigint")
    side = [{"id": 1, "v": "a"}, {"id": 1, "v": "b"}, {"id": "2", "v": "c"}]
    rule = {"version": 2, "input": {"format": "json"}, "mappings": [{"target": "k", "source": "k"}, {"target": "one", "expr": ["@context.s", {"lookup_first": ["id", "@input.k", "v"]}]}, {"target": "all", "expr": ["@context.s", {"lookup": ["id", "@input.k", "v"]}]}]}
    rows = {r["k"]: (r["one"], r["all"]) for r in api.transform(df, rule, {"s": side}).collect()}
    assert rows == {1: ("a", ["a", "b"]), 2: (None, []), None: (None, [])}


def test_branch_return_and_drop(spark, tmp_path):
    (tmp_path / "then.yaml").write_text("version: 2\ninput: { format: json }\nrecord_when: { lt: ['@input.n', 9] }\nmappings: [ { target: big, source: n } ]\n")
    (tmp_path / "r.yaml").write_text("""
version: 2
input: { format: json }
steps:
  - mappings: [ { target: n, source: n } ]
  - branch: { when: { gt: ["@input.n", 2] }, then: then.yaml, return: true }
  - mappings: [ { target: small, value: true } ]
""")
    df = spark.createDataFrame([(1,), (5,), (9,)], "n bigint")
    rows = [json.loads(r[0]) for r in api.compiled(df, tmp_path / "r.yaml").json().collect()]
    assert rows == [{"n": 1, "small": True}, {"big": 5}]
    exact, _ = api.transform_records([{"n": 1}, {"n": 5}, {"n": 9}], tmp_path / "r.yaml")
    assert rows == exact


def test_finalize_keeps_the_order_of_reading_through_lookups(spark):
    """The join shuffles; ties, offset, limit and wrap still follow the input."""
    side = spark.range(0, 1000).selectExpr("id", "id % 3 as grp")
    df = spark.range(0, 1000, 1, 7)
    body = "version: 2\ninput: { format: parquet }\nmappings:\n  - { target: id, source: id }\n  - { target: grp, expr: ['@context.side', { lookup_first: [id, '@input.id', grp] }] }\n"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        run = lambda tail: [r["id"] for r in api.transform(df, body + tail, {"side": side}).collect()]
        assert run("finalize: { limit: 5 }\n") == [0, 1, 2, 3, 4]
        assert run("finalize: { offset: 10, limit: 3 }\n") == [10, 11, 12]
        assert run("finalize: { sort: { by: grp, order: desc }, limit: 4 }\n") == [2, 5, 8, 11]
        (row,) = api.transform(df, body + "finalize: { limit: 4, wrap: { ids: ['@out', { map: ['@item.id'] }] } }\n", {"side": side}).collect()
        assert list(row["ids"]) == [0, 1, 2, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fields_of_one_match_share_a_join(spark):
    side = spark.createDataFrame([(1, "a", 10), (1, "b", 20), (2, "c", None)], "k int, name string, n int").coalesce(1)
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    rule = "version: 2\ninput: { format: parquet }\nmappings:\n  - { target: k, source: k }\n" + "".join(f"  - {{ target: {t}, expr: ['@context.side', {{ lookup_first: [k, '@input.k', {t}] }}] }}\n" for t in ("name", "n")) + "  - { target: all, expr: ['@context.side', { lookup_first: [k, '@input.k'] }] }\n"
    out = api.transform(df, rule, {"side": side})
    assert out.drop("all")._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2
    rows = {r["k"]: (r["name"], r["n"], r["all"] and r["all"]["name"]) for r in out.collect()}
    assert rows == {1: ("a", 10, "a"), 2: ("c", None, "c"), 3: (None, None, None)}


@pytest.mark.parametrize("text", ["2024-02-29", "2024/2/9", "20240229", "2024-02-09 7:05", "2024/02/09 07:05", "2024-02-09T07:05:06", "2024-02-09 07:05:06.123456", "2024/02/09 07:05:06.5", "2024-02-09T07:05:06Z", "2024-02-09T07:05:06+0200", "2024-02-30", "2024", "2024/02/09T07:05", "07:05", "2024-02-09x", "2024022"])
def test_common_dates_as_the_record_evaluator_reads_them(spark, text):
    rule = "version: 2\ninput: { format: parquet }\nmappings:\n  - { target: t, expr: ['@input.d', { to_unixtime: [] }] }\n"
    df = spark.createDataFrame([(text,)], "d string")
    try:
        want, _ = api.transform_records([{"d": text}], rule)
        want = want[0]["t"]
    except EvalError:
        want = None
    (row,) = api.transform(df, rule, mode="quarantine").collect()
    assert row["t"] == want and (row["_error"] is None) == (want is not None)
