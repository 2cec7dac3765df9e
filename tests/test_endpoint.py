import io
import json

import pytest

from sluice import mcp
from sluice.errors import EvalError
from sluice.operators import endpoint as E
from sluice.operators import synthesis as S
from sluice.plans.parse import parse_rule

FILES = {
    "api.yaml": """
type: endpoint
endpoints:
  - path: /users/{id}
    method: GET
    steps:
      - { rule: fetch.yaml, with: { who: "@input.path.id" }, catch: { 404: none.yaml } }
      - { rule: shape.yaml, when: { ne: ["@input.name", null] } }
    catch: { default: sorry.yaml }
    reply: { status: 200, body: "@input", headers: { x-a: b } }
""",
    "fetch.yaml": 'type: network\nrequest: { method: GET, url: ["http://h/", { concat: ["@context.params.who"] }] }\ntimeout: 500ms\nretry: { max: 2, initial_delay: 10ms, backoff: exponential }\nselect: data.user\n',
    "shape.yaml": "version: 2\ninput: { format: json }\nmappings: [ { target: hello, source: name } ]\n",
    "none.yaml": "version: 2\ninput: { format: json }\nmappings: [ { target: missing, expr: '@context.error.status' } ]\n",
    "sorry.yaml": "version: 2\ninput: { format: json }\nmappings: [ { target: sorry, expr: '@context.error.kind' } ]\n",
}


@pytest.fixture
def root(tmp_path):
    for k, v in FILES.items():
        (tmp_path / k).write_text(v)
    return tmp_path


def engine(root, answers):
    slept = []

    def send(method, url, headers, body, timeout):
        a = answers.pop(0)
        if isinstance(a, E.StepError):
            raise a
        return {"data": {"user": {"name": f"{a}@{url}"}}}

    return E.Engine(root, send=send, sleep=slept.append), slept


def test_steps_retry_catch_reply(root, tmp_path):
    e, slept = engine(root, [E.StepError("Network", "x"), E.StepError("Timeout", "x"), "bob"])
    out = e.serve("get", "/users/7", [], [], traces=tmp_path / "tr")
    assert out == {"status": 200, "headers": {"content-type": "application/json", "x-a": "b"}, "body": {"hello": "bob@http://h/7"}}
    assert slept == [0.01, 0.02]
    (f,) = (tmp_path / "tr").rglob("*.json")
    assert [n["status"] for n in json.loads(f.read_text())["nodes"]] == ["ok", "ok"]
    assert engine(root, [E.StepError("Http", "x", 404)])[0].serve("GET", "/users/7", [], [])["body"] == {"missing": 404}
    assert engine(root, [E.StepError("Http", "x", 500)])[0].serve("GET", "/users/7", [], [])["body"] == {"sorry": "Http"}
    assert e.serve("POST", "/users/7", [], [])["status"] == 404


def test_requests_on_executors(spark, root):
    (root / "echo.yaml").write_text("type: endpoint\nendpoint: { path: '/e/{x}', method: POST, steps: [ { rule: up.yaml } ], reply: { status: 201 } }\n")
    (root / "up.yaml").write_text("version: 2\ninput: { format: json }\nmappings: [ { target: v, expr: ['@input.body.v', { '+': [1] }] } ]\n")
    df = spark.createDataFrame([(json.dumps({"method": "POST", "path": f"/e/{i}", "body": {"v": i}}),) for i in range(5)], "value string")
    got = [json.loads(r["value"]) for r in E.handle_requests(df, str(root)).collect()]
    assert [g["body"] for g in got] == [{"v": i + 1.0} for i in range(5)] and {g["status"] for g in got} == {201}


def test_request_input_and_durations():
    with pytest.raises(EvalError):
        E.request_input("GET", {}, [("a", "1"), ("a", "2")], [])
    with pytest.raises(ValueError):
        E.duration("0ms")
    assert E.request_input("GET", {}, [], [("X", "1"), ("x", "2")])["headers"] == {"x": "1,2"}
    assert (E.duration("250ms"), E.duration("2s")) == (0.25, 2)
    with pytest.raises(ValueError):
        E.duration("1m")


def test_graph_and_traces(spark, root, tmp_path):
    nodes, edges = E.api_graph(root)
    assert {"from": "api.yaml", "to": "fetch.yaml", "kind": "step"} in edges and {n["type"] for n in nodes} == {"endpoint", "network", "normal"}
    (root / "broken.yaml").write_text("version: 2\ninput: { format: json }\nsteps: [ { branch: { when: { eq: [1, 1] }, then: gone.yaml } } ]\n")
    assert any("gone.yaml" in x for x in E.validate_dir(root))
    E.write_trace(tmp_path / "t", {"path": "/a"})
    E.write_trace(tmp_path / "t", {"path": "/b"})
    assert [r["path"] for r in E.list_traces(spark, str(tmp_path / "t")).collect()] == ["/b", "/a"]


def test_trace_nodes_of_a_rule(root):
    (root / "deep.yaml").write_text("""
version: 2
input: { format: json }
steps:
  - record_when: { ne: ["@input.name", null] }
  - mappings: [ { target: a, source: name }, { target: b, value: 1, when: { eq: ["@input.name", x] } } ]
  - asserts: [ { when: { ne: ["@out.a", bad] }, error: { code: bad, message: no } } ]
  - branch: { when: { eq: ["@out.a", y] }, then: inner.yaml }
""")
    (root / "inner.yaml").write_text("version: 2\ninput: { format: json }\nmappings: [ { target: c, source: a } ]\n")
    nodes = []
    assert E.Engine(root).rule("deep.yaml", {"name": "y"}, {}, root, nodes) == {"a": "y", "c": "y"}
    assert [(n["kind"], n["status"]) for n in nodes] == [("record_when", "ok"), ("mapping", "ok"), ("mapping", "skipped"), ("assert", "ok"), ("branch", "ok")]
    assert nodes[1]["output"] == "y" and nodes[4]["nodes"][0]["target"] == "c"
    nodes.clear()
    with pytest.raises(E.StepError):
        E.Engine(root).rule("deep.yaml", {"name": "bad"}, {}, root, nodes)
    assert nodes[-1] == {"kind": "assert", "path": nodes[-1]["path"], "status": "error"}


def test_traces_get_and_import(tmp_path):
    file = E.write_trace(tmp_path / "b" / "traces", {"path": "/a"})
    (tmp_path / "b" / "rules").mkdir()
    (tmp_path / "b" / "rules" / "r.yaml").write_text("x")
    got = E.import_bundle(tmp_path / "d", tmp_path / "b")
    assert got == {"imported": 1, "trace_ids": [file.stem], "rules_imported": 1} and (tmp_path / "d/rules/r.yaml").read_text() == "x"
    assert E.get_trace(tmp_path / "d" / "traces", file.stem)["path"] == "/a" and E.get_trace(tmp_path / "d", "../x") is None
    assert E.import_bundle(tmp_path / "d", tmp_path / "b")["imported"] == 0
    with pytest.raises(EvalError):
        (tmp_path / "no.json").write_text("[1]")
        E.import_traces(tmp_path / "d", tmp_path / "no.json")


def test_kinds_of_referenced_files(root):
    assert E.validate_dir(root) == []
    (root / "second.yaml").write_text("type: endpoint\nendpoint: { path: /x, steps: [ { rule: api.yaml, catch: { default: fetch.yaml } } ] }\n")
    (root / "net.yaml").write_text("type: network\nrequest: { method: GET, url: 'lit:u' }\nretry: { initial_delay: 0s, backoff: never }\n")
    faults = "\n".join(E.validate_dir(root))
    for part in ("api.yaml is of type endpoint", "fetch.yaml is of type network, a catch takes normal", "net.yaml: timeout is missing", "retry.initial_delay", "retry.backoff"):
        assert part in faults


def test_prompts_and_paths(tmp_path):
    ask = lambda method, **params: mcp.respond({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    assert [p["name"] for p in ask("prompts/list")["result"]["prompts"]] == ["rule_from_input_base", "rule_from_dto", "explain_errors"]
    got = ask("prompts/get", name="explain_errors", arguments={"errors_json": "[1]"})["result"]["messages"][0]["content"]["text"]
    assert "[1]" in got
    assert ask("prompts/get", name="explain_errors", arguments={})["error"]["code"] == -32602 == ask("prompts/get", name="nope")["error"]["code"]
    assert len(ask("resources/list")["result"]["resources"]) == 3
    (tmp_path / "r.yaml").write_text("version: 2\ninput: { format: json, json: {} }\nmappings: [ { target: k, expr: '@context.k' } ]\n")
    (tmp_path / "c.json").write_text('{"k": 5}')
    call = lambda **a: ask("tools/call", name="transform", arguments=a)["result"]
    out = call(rules_path=f"{tmp_path}/r.yaml", context_path=f"{tmp_path}/c.json", input_json=[{}], validate=True)
    assert json.loads(out["content"][0]["text"])["output"] == '[{"k":5}]'
    assert call(rules_path=f"{tmp_path}/r.yaml", context_path=f"{tmp_path}/c.json", context_json={}, input_json=[{}])["isError"]


def test_synthesis():
    profile = {"user.fullName": {"string"}, "user.id": {"int"}, "price": {"string"}}
    assert S.rank("full_name", profile, "string")[0] == S.Candidate("user.fullName", 0.85)
    assert S.rank("id", profile, "int")[0].confidence == "high"
    rule = S.draft({"id": "int", "zip": None}, profile)
    assert [m.get("source") for m in rule["mappings"]] == ["input.user.id", None]
    assert S.lint(parse_rule({"version": 2, "input": {"format": "json"}, "mappings": [{"target": "a", "expr": ["@input.d", {"date_format": ["%Y"]}]}]})) == ["mappings[0].expr: date_format without an input format"]


def test_mcp():
    rule = "version: 2\ninput: { format: csv, csv: {} }\nmappings: [ { target: n, source: n, type: int } ]\n"
    calls = [{"method": "initialize"}, {"method": "tools/call", "params": {"name": "transform", "arguments": {"rules_text": rule, "input_text": "n\n1\n2\n", "preview_rows": 1}}}, {"method": "tools/call", "params": {"name": "analyze_input", "arguments": {"input_json": [{"a": {"b": 1}}, {"a": {"b": "x"}}]}}}, {"method": "nope"}]
    raw = b"".join(json.dumps({"jsonrpc": "2.0", "id": i, **c}).encode() + b"\n" for i, c in enumerate(calls))
    out = io.BytesIO()
    mcp.serve(io.BytesIO(raw), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert json.loads(got[1]["result"]["content"][0]["text"])["output"] == '[{"n":1}]'
    assert json.loads(got[2]["result"]["content"][0]["text"])[0]["types"] == {"int": 1, "string": 1}
    assert got[3]["error"]["code"] == -32601
    framed = io.BytesIO()
    body = b'{"jsonrpc":"2.0","id":1,"method":"ping"}'
    mcp.serve(io.BytesIO(b"Content-Length: %d\r\n\r\n%s" % (len(body), body)), framed)
    assert framed.getvalue().startswith(b"Content-Length:")
