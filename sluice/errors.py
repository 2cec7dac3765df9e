"""Errors and warnings of rules and of their evaluation."""

from __future__ import annotations

from dataclasses import dataclass

#: The codes of rule validation.
RULE_CODES = (
    "InvalidVersion", "MissingInputFormat", "InvalidInputFormat", "MissingCsvSection", "MissingJsonSection", "InvalidDelimiterLength", "MissingCsvColumns",
    "MissingTarget", "DuplicateTarget", "SourceValueExprExclusive", "MissingMappingValue", "InvalidWhenType",
    "InvalidRefNamespace", "ForwardOutReference", "UnknownOp", "InvalidArgs", "InvalidExprShape", "InvalidPath", "InvalidTypeName",
    "UndefinedVariable", "InvalidItemRef", "InvalidAccRef", "CyclicDependency", "EmptyPipe", "InvalidPipeStep",
    "MissingMappings", "StepsMappingExclusive", "InvalidStep", "InvalidFinalize",
)
#: The kinds of evaluation errors.
KINDS = ("InvalidInput", "InvalidRecordsPath", "InvalidRef", "InvalidTarget", "MissingRequired", "TypeCastFailed", "ExprError", "AssertionFailed")


class EvalError(Exception):
    """A record cannot be transformed."""

    def __init__(self, kind: str, message: str, path: str = "") -> None:
        super().__init__(f"{kind}: {message}" + (f" (path: {path})" if path else ""))
        self.kind, self.message, self.path = kind, message, path

    def __reduce__(self):
        return EvalError, (self.kind, self.message, self.path)


@dataclass(frozen=True)
class RuleError:
    """A fault of a rule file."""

    code: str
    message: str
    path: str = ""
    line: int = 0
    column: int = 0


class InvalidRule(ValueError):
    def __init__(self, errors: list[RuleError]) -> None:
        super().__init__("; ".join(f"{e.code} at {e.path or '.'}: {e.message}" for e in errors))
        self.errors = errors

    def __reduce__(self):
        return InvalidRule, (self.errors,)
