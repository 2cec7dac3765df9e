"""Tools over JSON-RPC 2.0 on standard streams, one message a line or framed by
Content-Length, as the caller does it. Small inputs run on the driver."""

from __future__ import annotations

import csv
import io
import json
import sys
from pathlib import Path
from typing import Any, BinaryIO, NamedTuple

from . import api, dto
from .errors import EvalError, InvalidRule
from .operators import synthesis
from .plans import ops
from .plans.parse import load_rule, parse_rule, validate_rule
from .sources.readers import load_context, records_of
from .values import INT, MISSING, dumps, parse_number

EXAMPLES = 3


def records(args: dict, rule=None) -> list:
    """The records of ``input_json`` or ``input_text`` (with ``format``)."""
    given = [k for k in ("input_json", "input_text", "input_path") if args.get(k) is not None]
    if len(given) != 1:
        raise EvalError("InvalidInput", "exactly one of input_json, input_text and input_path")
    fmt = args.get("format") or (rule.format if rule else "json")
    if given == ["input_json"]:
        if fmt == "csv":
            raise EvalError("InvalidInput", "input_json is not csv")
        return records_of(args["input_json"], args.get("records_path") or (rule.records_path if rule else None))
    text = args["input_text"] if given == ["input_text"] else open(args["input_path"]).read()
    if fmt == "csv":
        return list(csv.DictReader(io.StringIO(text), delimiter=rule.delimiter if rule else ",", fieldnames=list(rule.columns) if rule and not rule.has_header else None))
    return records_of(json.loads(text), args.get("records_path") or (rule.records_path if rule else None))


def cell(x: Any) -> Any:
    """A CSV cell as the value that it looks like."""
    if not isinstance(x, str):
        return x
    s = x.strip()
    if not s:
        return None
    if s.lower() in ("true", "false"):
        return s.lower() == "true"
    return int(s) if INT.fullmatch(s) else parse_number(s) if parse_number(s) is not None else x


def profile(rows: list, cells: bool = False, max_paths: int = 200) -> list[dict]:
    """Leaf paths with counts, types and at most three distinct examples; arrays are leaves."""
    found: dict[str, dict] = {}

    def visit(x: Any, path: str) -> None:
        if isinstance(x, dict) and x:
            for k, v in x.items():
                visit(v, f"{path}.{k}" if path else k)
            return
        x = cell(x) if cells else x
        kind = "null" if x is None else "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "float" if isinstance(x, float) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"
        p = found.setdefault(path, {"path": path, "count": 0, "types": {}, "examples": []})
        p["count"] += 1
        p["types"][kind] = p["types"].get(kind, 0) + 1
        if kind not in ("null", "array", "object") and x not in p["examples"] and len(p["examples"]) < EXAMPLES:
            p["examples"].append(x)

    for r in rows:
        visit(r, "")
    return [found[p] for p in sorted(found)][:max_paths]


def _types(args: dict) -> dict[str, set[str]]:
    return {p["path"]: set(p["types"]) for p in profile(records(args), args.get("format") == "csv")}


def _rules(a: dict) -> str:
    return a["rules_text"] if "rules_text" in a else Path(a["rules_path"]).read_text()


def _base(a: dict) -> Path | None:
    return Path(a["rules_path"]).parent if "rules_path" in a else None


def transform(a: dict) -> Any:
    if ("rules_text" in a) == ("rules_path" in a):
        raise EvalError("InvalidInput", "exactly one of rules_text and rules_path")
    if "context_json" in a and "context_path" in a:
        raise EvalError("InvalidInput", "context_json and context_path exclude each other")
    if a.get("validate") and (errors := validate_rule(_rules(a), base=_base(a))):
        raise InvalidRule(errors)
    rule = api.as_rule(a["rules_text"]) if "rules_text" in a else load_rule(a["rules_path"])
    context = load_context(a["context_path"]) if "context_path" in a else a.get("context_json", MISSING)
    out, warnings = api.transform_records(records(a, rule), rule, None if context is MISSING else context)
    rows = out[: a["preview_rows"]] if isinstance(out, list) and a.get("preview_rows") else out
    text = "\n".join(map(dumps, rows)) if a.get("ndjson") else dumps(rows)
    raw, most = text.encode(), a.get("max_output_bytes")
    cut = most is not None and len(raw) > most
    return {"output": raw[:most].decode(errors="ignore") if cut else text, "truncated": cut, "warnings": warnings}


TOOLS = {
    "transform": transform,
    "validate_rules": lambda a: [e.__dict__ for e in validate_rule(_rules(a), base=_base(a))],
    "generate_dto": lambda a: dto.generate(api.as_rule(a["rules_text"]) if "rules_text" in a else load_rule(a["rules_path"]), a["language"], a.get("name")),
    "list_ops": lambda a: [{"op": k, "min_args": lo, "max_args": hi} for k, (lo, hi) in sorted(ops.ARITY.items())],
    "analyze_input": lambda a: profile(records(a), a.get("format") == "csv", a.get("max_paths", 200)),
    "generate_rules_from_base": lambda a: {".".join(map(str, m.target)): [c._asdict() | {"confidence": c.confidence} for c in synthesis.rank(".".join(map(str, m.target)), _types(a), m.type)] for s in parse_rule(a["rules_text"]).steps if hasattr(s, "items") for m in s.items},
    "generate_rules_from_dto": lambda a: synthesis.draft(a["fields"], _types(a)),
}
README = Path(__file__).resolve().parents[1] / "README.md"
RESOURCES = {
    "sluice://ops": lambda: dumps(sorted(ops.ARITY)),
    "sluice://types": lambda: dumps(sorted(dto.LANGUAGES)),
    "sluice://readme": lambda: README.read_text() if README.exists() else "",
}


class Prompt(NamedTuple):
    """A text with places for arguments; those of ``optional`` may be left out."""

    description: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    text: str


#: Names of prompts and of their arguments.
PROMPTS = {
    "rule_from_input_base": Prompt("Complete the sources of a rule from a sample of the input.", ("rules_text", "input_sample"), ("format", "records_path"), "Fill in the sources of this rule so that it reads the sample. Call generate_rules_from_base, then validate_rules."),
    "rule_from_dto": Prompt("Write a rule that gives records of a type from a sample of the input.", ("dto_text", "dto_language", "input_sample"), ("format", "records_path"), "Write a rule whose output has this type, reading the sample. Call generate_rules_from_dto, then validate_rules."),
    "explain_errors": Prompt("Explain errors of a rule or of a run, and how to mend them.", ("errors_json",), ("rules_text",), "Say for each error what it means, where in the rule it comes from and what would mend it."),
}


def prompt(name: str, arguments: dict) -> dict:
    p = PROMPTS[name]
    if lacking := [k for k in p.required if arguments.get(k) is None]:
        raise ValueError(f"arguments are missing: {', '.join(lacking)}")
    given = [f"{k}:\n{arguments[k]}" for k in (*p.required, *p.optional) if arguments.get(k) is not None]
    return {"description": p.description, "messages": [{"role": "user", "content": {"type": "text", "text": "\n\n".join([p.text, *given])}}]}


def respond(message: dict) -> dict | None:
    """The answer to one message; None for notifications."""
    method, params, id_ = message.get("method"), message.get("params") or {}, message.get("id")
    ok = lambda r: {"jsonrpc": "2.0", "id": id_, "result": r}
    if id_ is None:
        return None
    if method == "initialize":
        return ok({"protocolVersion": params.get("protocolVersion", "2024-11-05"), "serverInfo": {"name": "sluice", "version": "1"}, "capabilities": {"tools": {}, "resources": {}, "prompts": {}}})
    if method in ("ping", "shutdown"):
        return ok({})
    if method == "tools/list":
        return ok({"tools": [{"name": n, "inputSchema": {"type": "object"}} for n in TOOLS]})
    if method == "resources/list":
        return ok({"resources": [{"uri": u, "name": u} for u in RESOURCES]})
    if method == "resources/read" and params.get("uri") in RESOURCES:
        return ok({"contents": [{"uri": params["uri"], "text": RESOURCES[params["uri"]]()}]})
    if method == "prompts/list":
        return ok({"prompts": [{"name": n, "description": p.description, "arguments": [{"name": k, "required": k in p.required} for k in (*p.required, *p.optional)]} for n, p in PROMPTS.items()]})
    if method == "prompts/get":
        try:
            return ok(prompt(params["name"], params.get("arguments") or {}))
        except (KeyError, ValueError) as x:
            return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32602, "message": f"{x}" if isinstance(x, ValueError) else "no such prompt"}}
    if method == "tools/call" and params.get("name") in TOOLS:
        try:
            got = TOOLS[params["name"]](params.get("arguments") or {})
            return ok({"content": [{"type": "text", "text": got if isinstance(got, str) else json.dumps(got, default=list)}], "isError": False})
        except (EvalError, InvalidRule, KeyError, ValueError, OSError) as x:
            return ok({"content": [{"type": "text", "text": f"{type(x).__name__}: {x}"}], "isError": True})
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32601, "message": f"no such method: {method}"}}


def serve(source: BinaryIO, sink: BinaryIO) -> None:
    while line := source.readline():
        framed = line.lower().startswith(b"content-length:")
        if framed:
            n = int(line.split(b":")[1])
            while source.readline().strip():
                pass
            line = source.read(n)
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            answer: dict | None = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        else:
            answer = respond(message)
        if answer is not None:
            raw = json.dumps(answer).encode()
            sink.write(b"Content-Length: %d\r\n\r\n%s" % (len(raw), raw) if framed else raw + b"\n")
            sink.flush()
        if isinstance(answer, dict) and not line.strip().startswith(b"[") and json.loads(line).get("method") == "shutdown":
            return


if __name__ == "__main__":
    serve(sys.stdin.buffer, sys.stdout.buffer)
