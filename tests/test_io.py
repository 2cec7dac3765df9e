import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from sluice import api, cli, dto
from sluice.errors import EvalError
from sluice.operators import profile
from sluice.plans.parse import load_rule, parse_rule
from sluice.sources import readers, sinks
from sluice.streaming import stream

CSV = "version: 2\ninput: { format: csv, csv: {} }\nmappings:\n  - { target: id, source: id }\n  - { target: price, source: price, type: float }\n"


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,price\n001,"a,""b""",1.5\n002,,2\n')
    rule = parse_rule(CSV)
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), rule)
    assert [tuple(r) for r in df.collect()] == [("001", 'a,"b"', "1.5"), ("002", "", "2")]
    out = api.transform_json(readers.read_records(spark, str(tmp_path / "a.csv"), rule), rule)
    assert [json.loads(r["value"]) for r in out.collect()] == [{"id": "001", "price": 1.5}, {"id": "002", "price": 2.0}]


def test_json_records_path(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"items": [{"v": 1}, {"v": 1.0}, {"v": [1, "x"]}]}')
    rule = parse_rule("version: 2\ninput: { format: json, json: { records_path: items } }\nmappings: [ { target: v, source: v } ]\n")
    out = api.transform_json(readers.read_json(spark, str(tmp_path / "a.json"), rule), rule)
    assert [r["value"] for r in out.collect()] == ['{"v":1}', '{"v":1.0}', '{"v":[1,"x"]}']
    assert sinks.write_json_array(out, tmp_path / "out" / "a.json") == 3
    assert json.loads((tmp_path / "out" / "a.json").read_text())[0] == {"v": 1}
    assert sinks.preview(out, 2) == ('[{"v":1},{"v":1.0}]', False)
    typed = readers.read_json_typed(spark, str(tmp_path / "a.json"), rule, spark.createDataFrame([], "v string").schema)
    assert typed.count() == 3


def test_records_errors():
    for document, path, kind in (({"a": 1}, "b", "InvalidRecordsPath"), (5, None, "InvalidInput")):
        with pytest.raises(EvalError) as x:
            readers.records_of(document, path)
        assert x.value.kind == kind


def test_stream(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    src = stream.read_stream(spark, str(tmp_path / "in"), spark.range(0).schema)
    rule = {"version": 2, "input": {"format": "json"}, "record_when": {"gte": ["@input.id", 5]}, "mappings": [{"target": "id", "source": "id"}]}
    q = stream.run_available(stream.transform_stream(src, rule), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).where("_error is null").count() == 5
    with pytest.raises(EvalError, match="finalize"):
        stream.transform_stream(src, rule | {"finalize": {"limit": 1}})


def test_json_finalize(spark):
    df = spark.createDataFrame([(i, json.dumps({"s": i % 4, "i": i})) for i in range(8)], "o bigint, value string")
    rule = {"version": 2, "input": {"format": "json"}, "mappings": [{"target": "s", "source": "s"}, {"target": "i", "source": "i"}], "finalize": {"filter": {"lt": ["@item.index", 6]}, "sort": {"by": "s", "order": "desc"}, "offset": 1, "limit": 3}}
    got = [json.loads(r["value"]) for r in api.transform_json(df, rule, order_by=[df["o"]]).collect()]
    want, _ = api.transform_records([{"s": i % 4, "i": i} for i in range(8)], rule)
    assert got == want


def test_dto():
    rule = parse_rule("version: 2\ninput: { format: json }\nmappings:\n  - { target: user.id, source: id, type: int, required: true }\n  - { target: user.full-name, source: n, type: string }\n  - { target: type, source: t }\n")
    s = dto.schema_of(rule)
    assert s["user"].nullable is False and s["user"].dataType["id"].nullable is False and s["type"].nullable
    for lang in dto.LANGUAGES:
        text = dto.generate(rule, lang, "order line")
        assert "OrderLineUser" in text
    assert "type_: Option<serde_json::Value>" in dto.generate(rule, "rust")
    assert '"full-name"?: string' in dto.generate(rule, "typescript")


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "r.yaml").write_text(CSV)
    (tmp_path / "bad.yaml").write_text("version: 9\ninput: { format: csv, csv: {} }\nmappings: []\n")
    (tmp_path / "a.csv").write_text("id,price\n1,2\n")
    (tmp_path / "b.csv").write_text("id,price\n1,x\n")
    run = lambda *a: cli.main([str(x) for x in a])
    assert run("validate", "-r", tmp_path / "r.yaml") == 0
    assert run("validate", "-r", tmp_path / "bad.yaml") == 2
    capsys.readouterr()
    assert run("transform", "-r", tmp_path / "r.yaml", "-i", tmp_path / "a.csv") == 0
    assert json.loads(capsys.readouterr().out) == [{"id": "1", "price": 2.0}]
    assert run("transform", "-r", tmp_path / "r.yaml", "-i", tmp_path / "b.csv") == 3
    assert run("preflight", "-r", tmp_path / "r.yaml", "-i", tmp_path / "none.csv") == 1
    assert run("generate", "-r", tmp_path / "r.yaml", "-l", "python") == 0


def test_profile(spark):
    df = spark.createDataFrame([("1", None), ("x", 2.5)], "a string, b double")
    rows = {r["path"]: (r["count"], r["types"]) for r in profile.analyse(df, cells=True).collect()}
    assert rows == {"a": (2, {"int": 1, "string": 1}), "b": (2, {"float": 1, "null": 1})}


def test_workers_need_no_repository(tmp_path):
    """Workers that cannot import this package run records, documents and fallbacks."""
    (tmp_path / "in.json").write_text('[{"n": 1, "s": "x"}, {"n": 2.5, "s": "y"}]')
    root = str(Path(__file__).resolve().parents[1])
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
from sluice import api
from sluice.sources import readers
body = 'version: 2\\ninput: {{ format: json, json: {{}} }}\\nmappings: [ {{ target: n, source: n }}, {{ target: m, expr: ["@input.s", {{ from_entries: ["@input.n"] }}, entries, first, {{ merge: [{{ z: [x] }}] }}, values] }} ]\\n'
rule = api.as_rule(body)
rows = readers.read_records(spark, {str(tmp_path / "in.json")!r}, rule)
print('JSON', [r['value'] for r in api.transform_json(rows, rule).collect()])
print('FALLBACK', api.transform(spark.createDataFrame([(1, 'x')], 'n int, s string'), rule).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "JSON ['{\"m\":" in done.stdout and "FALLBACK 1" in done.stdout, done.stdout + done.stderr[-2000:]


def test_command_line_by_columns(spark, tmp_path, monkeypatch, capsys):
    """CSV goes through columns where it can, with what the record evaluator gives."""
    (tmp_path / "a.csv").write_text('id,name,price,day\n001,"a,""b""",1.50,2024/02/09\n002,,2,2024-02-10\n003,"\u00e9\t\u2028",-0.0,20240211\n')
    (tmp_path / "r.yaml").write_text("""
version: 2
input: { format: csv, csv: {} }
record_when: { ne: ["@input.id", "009"] }
mappings:
  - { target: id, source: id }
  - { target: p.price, source: price, type: float }
  - { target: p.twice, expr: ["@out.p.price", { "*": [2] }] }
  - { target: name, expr: ["@input.name", uppercase], when: { ne: ["@input.name", ""] } }
  - { target: day, expr: ["@input.day", { date_format: ["%d.%m.%Y"] }] }
""")
    call = lambda: (cli.main(["transform", "-r", f"{tmp_path}/r.yaml", "-i", f"{tmp_path}/a.csv"]), capsys.readouterr().out)
    columns = call()
    (tmp_path / "typed.yaml").write_text((tmp_path / "r.yaml").read_text())
    rule = load_rule(tmp_path / "typed.yaml")
    args = cli.parser().parse_args(["transform", "-r", "x", "-i", f"{tmp_path}/a.csv"])
    assert cli._columns(spark, args, rule, None) is not None
    monkeypatch.setattr(cli, "_columns", lambda *a: None)
    records = call()
    assert columns[0] == records[0] == 0 and columns[1] == records[1] and len(json.loads(columns[1])) == 3
