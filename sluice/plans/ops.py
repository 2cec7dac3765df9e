"""The operations: names, aliases and argument counts after the subject."""

from __future__ import annotations

#: Spelled-out names of operators.
ALIASES = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/", "eq": "==", "ne": "!=", "lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "match": "~="}

NONE = (0, 0)
#: Least and most arguments (None: any number) beside the subject, by name.
ARITY: dict[str, tuple[int, int | None]] = {
    **dict.fromkeys("trim lowercase uppercase to_string keys values entries unique unzip first last len sum avg min max not string int float bool".split(), NONE),
    **dict.fromkeys("round flatten".split(), (0, 1)),
    # a flatten takes nothing beside its subject; one argument is tolerated where rules give it
    **dict.fromkeys("object_flatten object_unflatten".split(), (0, 1)),
    **dict.fromkeys("take drop get chunk map filter flat_map group_by key_by distinct_by find find_index index_of contains partition split reduce to_base".split(), (1, 1)),
    **dict.fromkeys("sort_by pad_start pad_end slice".split(), (1, 2)),
    "fold": (2, 2), "replace": (2, 3), "date_format": (1, 3), "to_unixtime": (0, 2), "zip_with": (2, None), "lookup": (2, 4), "lookup_first": (2, 4),
    "from_entries": (0, None),
    **dict.fromkeys("concat coalesce merge deep_merge and or pick omit zip + - * /".split(), (1, None)),
    **dict.fromkeys("== != < <= > >= ~=".split(), (1, 1)),
}

#: Not in the version 1 syntax.
V2_ONLY = frozenset(("first", "last"))
#: Arguments that are evaluated per element, by operation: their positions after the subject (-1: the last).
LAMBDAS = {**dict.fromkeys("map filter flat_map group_by key_by partition distinct_by sort_by find find_index reduce".split(), 0), "fold": 1, "zip_with": -1}
#: Operations whose lambda sees an accumulator.
FOLDS = frozenset(("reduce", "fold"))

#: What an operation gives, for the static check of conditions.
BOOLEAN = frozenset("and or not == != < <= > >= ~= contains bool".split())
MAYBE_BOOLEAN = frozenset("coalesce get find reduce fold first last lookup_first".split())


def known(op: str) -> bool:
    return canonical(op) in ARITY


def canonical(op: str) -> str:
    return ALIASES.get(op, op)
