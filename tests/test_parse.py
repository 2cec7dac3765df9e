import pytest

from sluice.errors import InvalidRule
from sluice.plans.ast import Call, Lit, Pipe, Ref
from sluice.plans.parse import Fault, at_ref, expr_v2, load_rule, parse_rule, path_tokens, validate_rule


def rule(mappings="  - { target: a, source: a }", head="version: 2\ninput: { format: json, json: {} }\n"):
    return f"{head}mappings:\n{mappings}\n"


@pytest.mark.parametrize(("text", "want"), [("a", ("a",)), ("a.b[0]", ("a", "b", 0)), ('u["x.y"].z', ("u", "x.y", "z")), ("m[1][0]", ("m", 1, 0)), ('a.["k.k"]', ("a", "k.k"))])
def test_paths(text, want):
    assert path_tokens(text) == want


@pytest.mark.parametrize("text", ["", "a.", "a..b", "a[", "a[x]", "[0]"])
def test_odd_paths(text):
    with pytest.raises(Fault):
        path_tokens(text)


def test_references():
    assert at_ref("@input.a.b") == Ref("input", ("a", "b"))
    assert at_ref("@item.value.x") == Ref("item", ("x",))
    assert at_ref("@item.index") == Ref("index")
    assert at_ref("@total") == Ref("local", (), "total")
    assert expr_v2("lit:@x") == Lit("@x")
    assert expr_v2(["@input.a", "trim"]) == Pipe(Ref("input", ("a",)), (Call("trim", None, (), 2),))


def codes(text):
    return [(e.code, e.path) for e in validate_rule(text)]


@pytest.mark.parametrize(
    ("text", "code"),
    [
        (rule(head="version: 3\ninput: { format: json, json: {} }\n"), ("InvalidVersion", "version")),
        (rule(head="version: 2\ninput: {}\n"), ("MissingInputFormat", "input.format")),
        (rule(head="version: 2\ninput: { format: xml }\n"), ("InvalidInputFormat", "input.format")),
        (rule(head="version: 2\ninput: { format: csv }\n"), ("MissingCsvSection", "input.csv")),
        (rule(head="version: 2\ninput: { format: json }\n"), ("MissingJsonSection", "input.json")),
        (rule(head="version: 2\ninput: { format: csv, csv: { delimiter: ';;' } }\n"), ("InvalidDelimiterLength", "input.csv.delimiter")),
        (rule(head="version: 2\ninput: { format: csv, csv: { has_header: false } }\n"), ("MissingCsvColumns", "input.csv.columns")),
        (rule("  - { source: a }"), ("MissingTarget", "mappings[0].target")),
        (rule("  - { target: a, source: a }\n  - { target: a, source: b }"), ("DuplicateTarget", "mappings[1].target")),
        (rule("  - { target: a, source: a, value: 1 }"), ("SourceValueExprExclusive", "mappings[0]")),
        (rule("  - { target: a }"), ("MissingMappingValue", "mappings[0]")),
        (rule("  - { target: a, source: a, type: date }"), ("InvalidTypeName", "mappings[0].type")),
        (rule('  - { target: a, expr: ["@input.a", nope] }'), ("UnknownOp", "mappings[0].expr[1]")),
        (rule('  - { target: a, expr: ["@input.a", { replace: [x] }] }'), ("InvalidArgs", "mappings[0].expr[1]")),
        (rule('  - { target: a, expr: "@out.b" }\n  - { target: b, value: 1 }'), ("ForwardOutReference", "mappings[0].expr")),
        (rule('  - { target: a, expr: "@x" }'), ("UndefinedVariable", "mappings[0].expr")),
        (rule('  - { target: a, expr: "@item.x" }'), ("InvalidItemRef", "mappings[0].expr")),
        (rule('  - { target: a, expr: "@acc" }'), ("InvalidAccRef", "mappings[0].expr")),
        (rule('  - { target: a, expr: ["@input.a", 5] }'), ("InvalidPipeStep", "mappings[0].expr[1]")),
        (rule("  - { target: a, expr: [] }"), ("EmptyPipe", "mappings[0].expr")),
        (rule("  - { target: 'a[0]', source: a }"), ("InvalidPath", "mappings[0].target")),
        (rule("  - { target: a, source: other.a.b }"), ("InvalidRefNamespace", "mappings[0].source")),
        ("version: 2\ninput: { format: json, json: {} }\n", ("MissingMappings", "mappings")),
        (rule() + "steps: []\n", ("StepsMappingExclusive", "steps")),
        ("version: 2\ninput: { format: json, json: {} }\nsteps: [ {} ]\n", ("InvalidStep", "steps[0]")),
        (rule() + "finalize: { limit: -1 }\n", ("InvalidFinalize", "finalize.limit")),
        ("version: 1\ninput: { format: json, json: {} }\nrecord_when: { op: trim, args: [ x ] }\nmappings: [ { target: a, source: a } ]\n", ("InvalidWhenType", "record_when")),
    ],
)
def test_codes(text, code):
    assert code in codes(text)


def test_valid_rule_and_lines():
    assert codes(rule()) == []
    (e,) = [e for e in validate_rule(rule("  - { target: a, source: a }\n  - { target: b, source: b, type: date }")) if e.code == "InvalidTypeName"]
    assert (e.line, e.column) == (5, 35)


def test_branch_cycle(tmp_path):
    f = tmp_path / "a.yaml"
    f.write_text("version: 2\ninput: { format: json, json: {} }\nsteps:\n  - branch: { when: { eq: [1, 1] }, then: a.yaml }\n")
    with pytest.raises(InvalidRule) as x:
        load_rule(f)
    assert x.value.errors[0].code == "CyclicDependency"


def test_dict_rules():
    assert parse_rule({"version": 2, "input": {"format": "json"}, "mappings": [{"target": "a", "value": None}]}).steps
