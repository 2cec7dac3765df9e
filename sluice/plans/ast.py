"""The logical plan of a rule: plain values, one form for both syntax versions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, NamedTuple

Path = tuple  # of str (a key) and int (an index)


class Lit(NamedTuple):
    value: Any


class Ref(NamedTuple):
    """ns: input, context, out, item, index, acc, local or pipe."""

    ns: str
    path: Path = ()
    name: str = ""  # of a local


class Call(NamedTuple):
    """An operation; ``subject`` is None for the pipe value."""

    op: str
    subject: Any
    args: tuple
    version: int


class Let(NamedTuple):
    bindings: tuple  # of (name, expression), by name


class If(NamedTuple):
    cond: Any
    then: Any
    other: Any  # None: the pipe value


class MapStep(NamedTuple):
    steps: tuple


class Pipe(NamedTuple):
    start: Any
    steps: tuple


class All(NamedTuple):
    conds: tuple


class AnyOf(NamedTuple):
    conds: tuple


class Compare(NamedTuple):
    op: str  # eq ne gt gte lt lte match
    left: Any
    right: Any


class Truth(NamedTuple):
    """A condition that is an expression; ``version`` 1 makes a missing value an error."""

    expr: Any
    version: int


@dataclass(frozen=True)
class Mapping:
    target: Path
    expr: Any
    path: str
    when: Any = None
    type: str | None = None
    required: bool = False
    default: Any = None
    has_default: bool = False


@dataclass(frozen=True)
class Mappings:
    items: tuple[Mapping, ...]


@dataclass(frozen=True)
class RecordWhen:
    cond: Any
    path: str
    strict: bool  # an error aborts; else it drops the record with a warning


@dataclass(frozen=True)
class Assert:
    cond: Any
    code: str
    message: str
    path: str


@dataclass(frozen=True)
class Branch:
    cond: Any
    then: Rule
    other: Rule | None
    returns: bool
    path: str


@dataclass(frozen=True)
class Finalize:
    filter: Any = None
    sort: tuple[Path, bool] | None = None  # path, descending
    offset: int | None = None
    limit: int | None = None
    wrap: Any = None  # nested dict and list with expressions as leaves
    has_wrap: bool = False


@dataclass(frozen=True)
class Rule:
    version: int
    format: str
    steps: tuple = ()
    finalize: Finalize | None = None
    records_path: str | None = None
    has_header: bool = True
    delimiter: str = ","
    columns: tuple[str, ...] = ()
    name: str | None = None
    raw: dict = field(default_factory=dict, compare=False)
