"""Types of a rule's output: a Spark schema, and record types in seven languages.

A field is optional if its mapping is conditional, or if it is neither required
nor has a value or a default.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .plans.ast import Branch, Lit, Mapping, Mappings, Rule


@dataclass
class Field:
    name: str
    type: str | None = None  # string, int, float, bool; None: any JSON value
    optional: bool = True
    fields: dict[str, Field] = field(default_factory=dict)


def optional(m: Mapping) -> bool:
    return m.when is not None or not (m.required or m.has_default or isinstance(m.expr, Lit))


def fields_of(rule: Rule, into: Field | None = None) -> Field:
    """The tree of output fields, in the order of writing."""
    root = into or Field("Record", None, False)
    for s in rule.steps:
        if isinstance(s, Mappings):
            for m in s.items:
                node = root
                for k in m.target:
                    node = node.fields.setdefault(str(k), Field(str(k)))
                node.type, node.optional = m.type, optional(m)
        elif isinstance(s, Branch):
            for sub in (s.then, s.other):
                if sub is not None:
                    fields_of(sub, root)
    return _settle(root)


def _settle(f: Field) -> Field:
    for x in f.fields.values():
        if x.fields:
            _settle(x)
            x.optional = not any(not y.optional for y in x.fields.values())
    return f


SPARK = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), None: T.StringType()}


def schema_of(rule: Rule) -> T.StructType:
    """The output schema; untyped fields are JSON text."""
    def of(f: Field) -> T.StructType:
        return T.StructType([T.StructField(k, of(x) if x.fields else SPARK[x.type], x.optional) for k, x in f.fields.items()])

    return of(fields_of(rule))


def words(name: str) -> list[str]:
    return [w for w in re.split(r"[^A-Za-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)) if w]


def pascal(name: str) -> str:
    out = "".join(w[:1].upper() + w[1:] for w in words(name)) or "Field"
    return out if not out[0].isdigit() else f"N{out}"


def camel(name: str) -> str:
    p = pascal(name)
    return p[:1].lower() + p[1:]


def snake(name: str) -> str:
    out = "_".join(w.lower() for w in words(name)) or "field"
    return out if not out[0].isdigit() else f"n_{out}"


#: Reserved words that field names avoid, by language.
RESERVED = {
    "rust": "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct super trait true type unsafe use where while async await dyn",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "typescript": "", "go": "",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static super switch synchronized this throw throws transient try void volatile while",
    "kotlin": "as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while",
    "swift": "as associatedtype break case catch class continue default defer do else enum extension fallthrough false for func guard if import in init inout internal is let nil operator private protocol public repeat return self static struct subscript super switch throw throws true try typealias var where while",
}
#: Types of string, int, float, bool and any JSON value.
TYPES = {
    "rust": ("String", "i64", "f64", "bool", "serde_json::Value"),
    "typescript": ("string", "number", "number", "boolean", "unknown"),
    "python": ("str", "int", "float", "bool", "Any"),
    "go": ("string", "int64", "float64", "bool", "json.RawMessage"),
    "java": ("String", "Long", "Double", "Boolean", "JsonNode"),
    "kotlin": ("String", "Long", "Double", "Boolean", "JsonElement"),
    "swift": ("String", "Int64", "Double", "Bool", "JSONValue"),
}
LANGUAGES = tuple(TYPES)


def identifiers(names: list[str], language: str) -> dict[str, str]:
    """Field names in the language's case, without reserved words and collisions."""
    case = {"rust": snake, "python": snake, "go": pascal, "typescript": lambda n: n}.get(language, camel)
    taken: set[str] = set()
    out = {}
    for n in names:
        base = case(n)
        if base in RESERVED[language].split():
            base += "_"
        name, i = base, 2
        while name in taken:
            name, i = f"{base}{i}", i + 1
        taken.add(name)
        out[n] = name
    return out


def generate(rule: Rule, language: str, name: str | None = None) -> str:
    """Type definitions, inner types first."""
    if language not in TYPES:
        raise ValueError(f"one of {', '.join(LANGUAGES)}")
    blocks: list[str] = []

    def visit(f: Field, type_name: str) -> None:
        rows = []
        ids = identifiers(list(f.fields), language)
        for key, x in f.fields.items():
            if x.fields:
                inner = type_name + pascal(key)
                visit(x, inner)
                t = inner
            else:
                t = TYPES[language][("string", "int", "float", "bool", None).index(x.type)]
            rows.append((key, ids[key], t, x.optional))
        blocks.append(RENDER[language](type_name, rows))

    visit(fields_of(rule), pascal(name or rule.name or "Record"))
    return HEADER.get(language, "") + "\n\n".join(blocks) + "\n"


Row = tuple[str, str, str, bool]


def _rust(name: str, rows: list[Row]) -> str:
    body = []
    for key, ident, t, opt in rows:
        attrs = ([f'rename = "{key}"'] if key != ident else []) + (['default, skip_serializing_if = "Option::is_none"'] if opt else [])
        body += ([f"    #[serde({', '.join(attrs)})]"] if attrs else []) + [f"    pub {ident}: {f'Option<{t}>' if opt else t},"]
    return "\n".join(["#[derive(Debug, Clone, Serialize, Deserialize)]", f"pub struct {name} {{", *body, "}"])


def _typescript(name: str, rows: list[Row]) -> str:
    key = lambda k: k if re.fullmatch(r"[A-Za-z_$][\w$]*", k) else f'"{k}"'
    return "\n".join([f"export interface {name} {{", *[f"  {key(k)}{'?' if o else ''}: {t};" for k, _, t, o in rows], "}"])


def _python(name: str, rows: list[Row]) -> str:
    ordered = sorted(rows, key=lambda r: r[3])
    body = [f"    {i}: {f'{t} | None = None' if o else t}" + (f"  # {k}" if k != i else "") for k, i, t, o in ordered]
    return "\n".join(["@dataclass", f"class {name}:", *(body or ["    pass"])])


def _go(name: str, rows: list[Row]) -> str:
    return "\n".join([f"type {name} struct {{", *[f'\t{i} {"*" * o}{t} `json:"{k}{",omitempty" * o}"`' for k, i, t, o in rows], "}"])


def _java(name: str, rows: list[Row]) -> str:
    body = [line for k, i, t, _ in rows for line in (f'    @JsonProperty("{k}")', f"    public {t} {i};")]
    return "\n".join([f"public class {name} {{", *body, "}"])


def _kotlin(name: str, rows: list[Row]) -> str:
    body = [(f'    @SerialName("{k}") ' if k != i else "    ") + f"val {i}: {t}{'? = null' if o else ''}," for k, i, t, o in rows]
    return "\n".join(["@Serializable", f"data class {name}(", *body, ")"])


def _swift(name: str, rows: list[Row]) -> str:
    body = [f"    let {i}: {t}{'?' * o}" for _, i, t, o in rows]
    keys = ["", "    enum CodingKeys: String, CodingKey {", *[f'        case {i} = "{k}"' for k, i, _, _ in rows], "    }"] if any(k != i for k, i, _, _ in rows) else []
    return "\n".join([f"struct {name}: Codable {{", *body, *keys, "}"])


RENDER = {"rust": _rust, "typescript": _typescript, "python": _python, "go": _go, "java": _java, "kotlin": _kotlin, "swift": _swift}
HEADER = {
    "rust": "use serde::{Deserialize, Serialize};\n\n", "python": "from dataclasses import dataclass\nfrom typing import Any\n\n\n", "go": "package dto\n\nimport \"encoding/json\"\n\n",
    "java": "import com.fasterxml.jackson.annotation.JsonProperty;\nimport com.fasterxml.jackson.databind.JsonNode;\n\n", "kotlin": "import kotlinx.serialization.*\nimport kotlinx.serialization.json.JsonElement\n\n", "swift": "import Foundation\n\n",
}
