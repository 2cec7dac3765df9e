"""Rule drafts from a profile of the input: for each target the likeliest paths."""

from __future__ import annotations

import re
from typing import Any, NamedTuple

from ..plans.ast import Call, Mappings, Pipe, Rule

TOP = 3


class Candidate(NamedTuple):
    path: str
    score: float

    @property
    def confidence(self) -> str:
        return "high" if self.score >= 0.9 else "medium" if self.score >= 0.7 else "low"


def tokens(name: str) -> set[str]:
    return {t.lower() for t in re.split(r"[^A-Za-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)) if t}


def fits(kind: str | None, types: set[str]) -> bool:
    """Whether values of these types can be cast to a declared type."""
    allowed = {"string": {"string", "int", "float", "bool"}, "int": {"int"}, "float": {"int", "float"}, "bool": {"bool"}}
    return kind is None or types - {"null"} <= allowed[kind]


def score(target: str, source: str | None, path: str) -> float:
    """1.0 for the named source, 0.8 for an equal last key (0.75 whatever its case
    and separators), else 0.6 times the share of common words."""
    if source == path:
        return 1.0
    a, b = target.rsplit(".", 1)[-1], path.rsplit(".", 1)[-1]
    if a == b:
        return 0.8
    x, y = tokens(a), tokens(b)
    if x == y:
        return 0.75
    return 0.6 * len(x & y) / max(1, len(x | y))


def rank(target: str, profile: dict[str, set[str]], kind: str | None = None, source: str | None = None, top: int = TOP) -> list[Candidate]:
    """The best paths of a profile (path to its types); a fitting type adds 0.1; ties by path."""
    out = []
    for path, types in profile.items():
        s = score(target, source, path)
        if s > 0:
            out.append(Candidate(path, round(min(1.0, s + (0.1 if fits(kind, types) else 0.0)), 4)))
    return sorted(out, key=lambda c: (-c.score, c.path))[:top]


def draft(targets: dict[str, str | None], profile: dict[str, set[str]], fmt: str = "json") -> dict[str, Any]:
    """A rule that maps each target (name to type) from its best path; targets
    without a candidate get a null."""
    mappings = []
    for t, kind in targets.items():
        best = rank(t, profile, kind, top=1)
        m: dict[str, Any] = {"target": t}
        m |= {"source": f"input.{best[0].path}"} if best else {"value": None}
        mappings.append(m | ({"type": kind} if kind else {}))
    return {"version": 2, "input": {"format": fmt, fmt: {}}, "mappings": mappings}


def lint(rule: Rule) -> list[str]:
    """Warnings: a date_format without an input format guesses."""
    out = []

    def visit(e: Any, path: str) -> None:
        if isinstance(e, Call):
            if e.op == "date_format" and len(e.args) < 2:
                out.append(f"{path}: date_format without an input format")
            for a in (e.subject, *e.args):
                visit(a, path)
        elif isinstance(e, Pipe):
            visit(e.start, path)
            for s in e.steps:
                visit(s, path)

    for s in rule.steps:
        if isinstance(s, Mappings):
            for m in s.items:
                visit(m.expr, f"{m.path}.expr")
    return out
