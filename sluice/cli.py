"""Command line: validate, preflight, transform and generate.

Exit codes: 0 fine, 1 files, 2 a faulty rule, 3 a failing record.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, dto
from .api import NotTyped
from .errors import EvalError, InvalidRule
from .plans.parse import load_rule, validate_rule
from .sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sluice", description="Rules on records, on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "preflight", "transform", "generate"):
        c = sub.add_parser(name)
        c.add_argument("-r", "--rules", required=True)
        if name in ("preflight", "transform"):
            c.add_argument("-i", "--input", required=True)
            c.add_argument("-f", "--format", choices=("csv", "json", "ndjson", "parquet"))
            c.add_argument("-c", "--context")
        if name == "transform":
            c.add_argument("-o", "--output")
            c.add_argument("--ndjson", action="store_true")
            c.add_argument("-v", "--validate", action="store_true")
        if name == "generate":
            c.add_argument("-l", "--lang", choices=dto.LANGUAGES, required=True)
            c.add_argument("-n", "--name")
            c.add_argument("-o", "--output")
    return p


def _validate(rules: str) -> int:
    errors = validate_rule(Path(rules).read_text(), Path(rules).parent)
    for e in errors:
        print(json.dumps({"code": e.code, "message": e.message, "path": e.path, "line": e.line, "column": e.column}), file=sys.stderr)
    return 2 if errors else 0


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("sluice").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _write(text: str, output: str | None) -> None:
    if output:
        Path(output).parent.mkdir(parents=True, exist_ok=True)
        Path(output).write_text(text)
    else:
        sys.stdout.write(text)


def _columns(spark, args: argparse.Namespace, rule, context) -> DataFrame | None:
    """(value, warnings) by columns, for CSV and Parquet: None if a mapping has no static
    type, or where the record evaluator's warnings or its order are wanted."""
    fmt = args.format or rule.format
    if fmt not in ("csv", "parquet") or rule.finalize is not None:
        return None
    try:
        c = api.compiled(readers.read_csv(spark, args.input, rule) if fmt == "csv" else spark.read.parquet(args.input), rule, context)
        if c.fallbacks or c.warnings or c.joined:
            return None
        return c.json().withColumn("warnings", F.lit("[]"))
    except NotTyped:
        return None


def _run(args: argparse.Namespace) -> int:
    rule = load_rule(args.rules)
    if args.command == "transform" and args.ndjson and rule.finalize:
        raise EvalError("InvalidInput", "finalize needs all records, newline-delimited output has none")
    context = readers.load_context(args.context) if args.context else None
    spark = _spark()
    out = _columns(spark, args, rule, context)
    if out is None:
        records = readers.read_records(spark, args.input, rule, args.format)
        out = api.transform_json(records, rule, context, order_by=[records[readers.ORDINAL]] if rule.finalize else None)
    if args.command == "preflight":
        api.write_noop(out)
        return 0
    for w in out.where("warnings <> '[]'").select("warnings").toLocalIterator():
        print(w[0], file=sys.stderr)
    kept = out.where("value is not null")
    if args.ndjson and args.output:
        sinks.write_ndjson(kept, args.output)
    elif args.ndjson:
        for r in kept.toLocalIterator():
            print(r["value"])
    elif rule.finalize and rule.finalize.has_wrap:
        _write(kept.first()["value"] + "\n", args.output)
    elif args.output:
        sinks.write_json_array(kept, args.output)
    else:
        print("[" + ",".join(r["value"] for r in kept.toLocalIterator()) + "]")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "validate" or getattr(args, "validate", False):
            code = _validate(args.rules)
            if code or args.command == "validate":
                return code
        if args.command == "generate":
            _write(dto.generate(load_rule(args.rules), args.lang, args.name), args.output)
            return 0
        return _run(args)
    except InvalidRule as x:
        print(x, file=sys.stderr)
        return 2
    except OSError as x:
        print(x, file=sys.stderr)
        return 1
    except EvalError as x:
        print(x, file=sys.stderr)
        return 1 if x.kind == "InvalidInput" and "cannot read" in x.message else 3
    except (PySparkException, Py4JJavaError) as x:
        print(str(x)[:2000], file=sys.stderr)
        return 1 if "PATH_NOT_FOUND" in str(x) else 3


if __name__ == "__main__":
    sys.exit(main())
