"""The record evaluator: every operation, exactly."""

import pytest

from sluice import api
from sluice.errors import EvalError
from sluice.plans.parse import parse_rule
from sluice.values import MISSING, dumps


def ev(expr, record=None, context=None, version=2):
    r = parse_rule({"version": version, "input": {"format": "json"}, "mappings": [{"target": "x", "expr": expr}]})
    out = api.transform_record(record or {}, r, context)
    return out.get("x", MISSING)


def v1(op, *args):
    return ev({"op": op, "args": list(args)}, {}, None, 1)


CASES = [
    (["@input.a", "trim"], {"a": "　 x\t"}, "x"),
    (["@input.a", "lowercase"], {"a": "ÀB"}, "àb"),
    (["@input.a", {"concat": ["-", 1, 2.5, True]}], {"a": "s"}, "s-12.5true"),
    (["@input.a", "to_string"], {"a": {"b": 1.0, "a": None}}, '{"a":null,"b":1.0}'),
    (["@input.a", {"replace": ["a", "b"]}], {"a": "aa"}, "ba"),
    (["@input.a", {"replace": ["a", "b", "all"]}], {"a": "aa"}, "bb"),
    (["@input.a", {"replace": ["(\\w)(\\d)", "$2$1", "regex_all"]}], {"a": "a1b2"}, "1a2b"),
    (["@input.a", {"split": [","]}], {"a": "a,,b,"}, ["a", "", "b", ""]),
    (["@input.a", {"pad_start": [5, "ab"]}], {"a": "xy"}, "abaxy"),
    (["@input.a", {"pad_end": [1]}], {"a": "xy"}, "xy"),
    (["@input.a", {"add": [1]}], {"a": 1}, 2.0),
    (["@input.a", {"divide": [4]}], {"a": "10"}, 2.5),
    (["@input.a", {"round": [1]}], {"a": -2.25}, -2.3),
    (["@input.a", {"round": [2]}], {"a": 1.005}, 1),
    (["@input.a", {"to_base": [16]}], {"a": -255}, "-ff"),
    (["@input.a", {"date_format": ["%Y/%m/%d"]}], {"a": "2024-01-02T03:04:05+09:00"}, "2024/01/02"),
    (["@input.a", {"date_format": ["%H:%M %:z", "UTC"]}], {"a": "2024-01-02T03:04:05+09:00"}, "18:04 +00:00"),
    (["@input.a", {"date_format": ["%d %b", "%Y%m%d"]}], {"a": "20240102"}, "02 Jan"),
    (["@input.a", {"to_unixtime": ["ms"]}], {"a": "1970-01-01T00:00:00.123Z"}, 123),
    (["@input.a", {"to_unixtime": ["+01:00"]}], {"a": "1970-01-01 01:00:01"}, 1),
    (["@input.a", {"merge": [{"b": 2}]}], {"a": {"a": 1, "b": 1}}, {"a": 1, "b": 2}),
    (["@input.a", {"deep_merge": [{"n": {"y": 2}}]}], {"a": {"n": {"x": 1}}}, {"n": {"x": 1, "y": 2}}),
    (["@input.a", {"get": ["b[1].c"]}], {"a": {"b": [0, {"c": 7}]}}, 7),
    (["@input.a", {"pick": ["b[1]", "c"]}], {"a": {"b": [1, 2], "c": 3, "d": 4}}, {"b": [None, 2], "c": 3}),
    (["@input.a", {"omit": ["b.c"]}], {"a": {"b": {"c": 1, "d": 2}}}, {"b": {"d": 2}}),
    (["@input.a", "keys"], {"a": {"b": 1, "a": 2}}, ["a", "b"]),
    (["@input.a", "values"], {"a": {"b": 1, "a": 2}}, [2, 1]),
    (["@input.a", "entries"], {"a": {"b": 1}}, [{"key": "b", "value": 1}]),
    (["@input.a", "len"], {"a": "añ😀"}, 3),
    (["@input.a", {"from_entries": [5]}], {"a": "k"}, {"k": 5}),
    (["@input.a", "from_entries"], {"a": [["k", 1], {"key": "k", "value": 2}]}, {"k": 2}),
    (["@input.a", "object_flatten"], {"a": {"b": {"c": 1}, "d.e": {"f": 2}, "g": {}}}, {"b.c": 1, '["d.e"].f': 2, "g": {}}),
    (["@input.a", "object_unflatten"], {"a": {"b.c": 1, "b.d": 2}}, {"b": {"c": 1, "d": 2}}),
    (["@input.a", {"map": ["@item.v"]}], {"a": [{"v": 1}, {}, {"v": None}]}, [1, None]),
    (["@input.a", {"filter": [["@item", {">": [1]}]]}], {"a": [1, 2, 3]}, [2, 3]),
    (["@input.a", {"flat_map": ["@item"]}], {"a": [[1, 2], 3]}, [1, 2, 3]),
    (["@input.a", {"flatten": [2]}], {"a": [1, [2, [3, [4]]]]}, [1, 2, 3, [4]]),
    (["@input.a", {"take": [-2]}], {"a": [1, 2, 3]}, [2, 3]),
    (["@input.a", {"drop": [-1]}], {"a": [1, 2, 3]}, [1, 2]),
    (["@input.a", {"slice": [-2, -1]}], {"a": [1, 2, 3]}, [2]),
    (["@input.a", {"chunk": [2]}], {"a": [1, 2, 3]}, [[1, 2], [3]]),
    (["@input.a", {"zip": [["@input.b"]]}], {"a": [1, 2, 3], "b": ["x", "y"]}, [[1, "x"], [2, "y"]]),
    (["@input.a", {"zip_with": ["@input.b", ["@item.value[0]", {"+": ["@item.value[1]"]}]]}], {"a": [1, 2], "b": [3, 4]}, [4.0, 6.0]),
    (["@input.a", "unzip"], {"a": [[1, "a"], [2, "b"]]}, [[1, 2], ["a", "b"]]),
    (["@input.a", {"group_by": ["@item.k"]}], {"a": [{"k": 2}, {"k": 1}, {"k": 2, "x": 0}]}, {"1": [{"k": 1}], "2": [{"k": 2}, {"k": 2, "x": 0}]}),
    (["@input.a", {"key_by": ["@item.k"]}], {"a": [{"k": 1, "v": 1}, {"k": 1, "v": 2}]}, {"1": {"k": 1, "v": 2}}),
    (["@input.a", {"partition": [["@item", {">": [1]}]]}], {"a": [1, 2]}, [[2], [1]]),
    (["@input.a", "unique"], {"a": [1, "1", 2, None, None]}, [1, 2, None]),
    (["@input.a", {"distinct_by": ["@item.k"]}], {"a": [{"k": 1, "v": 1}, {"k": 1, "v": 2}]}, [{"k": 1, "v": 1}]),
    (["@input.a", {"sort_by": ["@item", "desc"]}], {"a": ["b", "a", "c"]}, ["c", "b", "a"]),
    (["@input.a", {"find": [["@item", {">": [5]}]]}], {"a": [1]}, None),
    (["@input.a", {"find_index": [["@item", {">": [1]}]]}], {"a": [1, 2]}, 1),
    (["@input.a", {"index_of": ["2"]}], {"a": [1, 2]}, 1),
    (["@input.a", {"contains": [None]}], {"a": [1, None]}, True),
    (["@input.a", "sum"], {"a": [1, "2.5"]}, 3.5),
    (["@input.a", "avg"], {"a": [1, 3]}, 2),
    (["@input.a", "max"], {"a": ["10", "9"]}, 10),
    (["@input.a", "min"], {"a": []}, None),
    (["@input.a", {"reduce": [["@acc", {"concat": ["@item"]}]]}], {"a": ["a", "b"]}, "ab"),
    (["@input.a", {"fold": [10, ["@acc", {"-": ["@item"]}]]}], {"a": [1, 2]}, 7.0),
    (["@input.a", "first"], {"a": []}, MISSING),
    (["@input.a", "last"], {"a": [1, 2]}, 2),
    (["@input.a", {"and": [True]}], {}, MISSING),
    (["@input.a", {"or": [True]}], {}, True),
    (["@input.a", "not"], {"a": False}, True),
    (["@input.a", {"==": ["1"]}], {"a": 1}, True),
    (["@input.a", {"!=": [None]}], {"a": 1}, True),
    (["@input.a", {"<=": ["2"]}], {"a": 2}, True),
    (["@input.a", {"~=": ["^b+$"]}], {"a": "bb"}, True),
    (["@input.a", {"coalesce": ["@input.b", 3]}], {"a": None}, 3),
    (["@input.a", "int"], {"a": "+7"}, 7),
    (["@input.a", "bool"], {"a": "TRUE"}, True),
    (["@input.a", {"if": {"cond": {"eq": ["$", 1]}, "then": "one"}}], {"a": 1.0}, 1.0),
    (["@input.a", {"let": {"b": ["$", {"+": [1]}]}}, "@b"], {"a": 1}, 2.0),
]


@pytest.mark.parametrize(("expr", "record", "want"), CASES, ids=[dumps(c[0])[:60] for c in CASES])
def test_operations(expr, record, want):
    got = ev(expr, record)
    assert (got is want) if want is MISSING else dumps(got) == dumps(want)


def test_version_1_numbers_and_lookup():
    assert v1("+", 1, "2") == 3 and isinstance(v1("+", 1, "2"), int)
    assert v1("concat", 10.0, "x") == "10x"
    users = {"users": [{"id": 1, "n": None}, {"id": "2", "n": "b"}, {"id": 2, "n": "c"}]}
    assert ev({"op": "lookup_first", "args": [{"ref": "context.users"}, "id", 2, "n"]}, {}, users, 1) == "b"
    assert ev({"op": "lookup", "args": [{"ref": "context.users"}, "id", "2", "n"]}, {}, users, 1) == ["b", "c"]
    assert ev({"op": "lookup", "args": [{"ref": "context.users"}, "id", "9"]}, {}, users, 1) is MISSING


def test_version_2_lookup():
    users = {"users": [{"id": 1}, {"id": 1, "n": "a"}, {"id": "1", "n": "s"}]}
    assert ev(["@context.users", {"lookup": ["id", 1, "n"]}], {}, users) == ["a"]
    assert ev(["@context.users", {"lookup": ["id", 9]}], {}, users) == []
    assert ev(["@context.users", {"lookup_first": ["id", 1, "n"]}], {}, users) is MISSING
    assert ev([{"lookup_first": ["@context.users", "id", "1", "n"]}], {}, users) == "s"


@pytest.mark.parametrize("expr", [["@input.a", "trim"], ["@input.a", {"+": [1]}], ["@input.a", {"map": ["@item"]}], ["@input.b", {"/": [0]}], ["@input.b", {"split": [""]}], ["@input.b", {"sort_by": ["@item.k"]}]])
def test_errors(expr):
    with pytest.raises(EvalError) as x:
        ev(expr, {"a": None, "b": 1})
    assert x.value.kind == "ExprError"


RULE = {
    "version": 2, "input": {"format": "json"}, "record_when": {"gt": ["@input.n", 0]},
    "mappings": [
        {"target": "u.id", "source": "n", "type": "string", "required": True},
        {"target": "u.d", "source": "nope", "default": "5", "type": "int"},
        {"target": "skip", "source": "n", "when": {"gt": ["@input.s", 1]}},
        {"target": "null", "source": "z"},
        {"target": "again", "expr": ["@out.u.id", {"concat": ["!"]}]},
    ],
}


def test_mapping_semantics():
    out, warnings = api.transform_records([{"n": 1, "s": [], "z": None}, {"n": -1}, {"s": "x"}], RULE)
    assert out == [{"u": {"id": "1", "d": 5}, "null": None, "again": "1!"}]
    assert [w["path"] for w in warnings] == ["mappings[2].when", "record_when"]


@pytest.mark.parametrize(
    ("mapping", "kind"),
    [
        ({"target": "a", "source": "x", "required": True}, "MissingRequired"), ({"target": "a", "source": "z", "required": True}, "MissingRequired"),
        ({"target": "a", "source": "n", "type": "bool"}, "TypeCastFailed"), ({"target": "b.c", "source": "n"}, "InvalidTarget"),
    ],
)
def test_mapping_errors(mapping, kind):
    r = {"version": 2, "input": {"format": "json"}, "mappings": [{"target": "b", "value": 1}, mapping]}
    with pytest.raises(EvalError) as x:
        api.transform_records([{"n": 1, "z": None}], r)
    assert x.value.kind == kind


def test_steps_branch_finalize(tmp_path):
    (tmp_path / "high.yaml").write_text("version: 2\ninput: { format: json }\nmappings: [ { target: tier, value: high }, { target: u.b, value: 2 } ]\n")
    (tmp_path / "low.yaml").write_text("version: 2\ninput: { format: json }\nrecord_when: { gt: ['@input.s', 0] }\nmappings: [ { target: tier, value: low } ]\n")
    r = tmp_path / "r.yaml"
    r.write_text("""
version: 2
input: { format: json }
steps:
  - mappings: [ { target: s, source: s }, { target: u.a, value: 1 } ]
  - asserts: [ { when: { gte: ["@out.s", 0] }, error: { code: neg, message: below zero } } ]
  - branch: { when: { gte: ["@input.s", 50] }, then: high.yaml, else: low.yaml }
  - mappings: [ { target: label, expr: ["@out.tier", { concat: ["-x"] }] } ]
finalize: { sort: { by: s, order: desc }, limit: 2, wrap: { rows: "@out", n: ["@out", len] } }
""")
    out, _ = api.transform_records([{"s": 1}, {"s": 0}, {"s": 60}, {"s": 60}], r)
    assert out["n"] == 2 and out["rows"][0] == {"s": 60, "u": {"a": 1, "b": 2}, "tier": "high", "label": "high-x"}
    with pytest.raises(EvalError, match="neg: below zero"):
        api.transform_records([{"s": -1}], r)
