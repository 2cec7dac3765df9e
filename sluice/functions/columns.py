"""Column forms of the scalar, array and object operations, where Spark's own
function of that name does something else."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer and number texts as rules accept them: no blanks, no type suffixes.
INT_TEXT = r"^[+-]?[0-9]+$"
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def trim(c: Column) -> Column:
    """Unicode white space on both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_int(c: Column) -> Column:
    return F.when(c.rlike(INT_TEXT), c.try_cast("bigint"))


def parse_float(c: Column) -> Column:
    """A finite number, or null."""
    x = c.try_cast("double")
    return F.when(c.rlike(NUMBER_TEXT) & (F.abs(x) < float("inf")), x)


def parse_bool(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


def float_text(c: Column, version: int) -> Column:
    """The shortest digits: 12.5, 100000.25, 1e21; an integral float as 10.0,
    or as 10 in version 1. Spark's own text has 1.0E7 from ten million on, its
    decimal of a float has the same digits without an exponent."""
    size = F.abs(c)
    digits = c.cast("bigint").cast("string")
    long = F.regexp_replace(c.try_cast("decimal(38,16)").cast("string"), "0+$", "")
    power = F.regexp_replace(F.lower(c.cast("string")), r"\.0e", "e")
    return (
        F.when((size < 1e16) & (c == F.floor(c)), digits if version == 1 else F.when((c == 0) & (c.cast("string") == "-0.0"), "-0.0").otherwise(F.concat(digits, F.lit(".0"))))
        .when((size < 1e7) & (size >= 1e-3), c.cast("string")).when((size < 1e16) & (size >= 1e-4), long).otherwise(power)
    )


def half_away(c: Column, scale: int) -> Column:
    """Half away from zero of the binary product, unlike F.round of the decimal text."""
    f = F.lit(10.0**scale)
    y = c * f
    return F.signum(y) * F.floor(F.abs(y) + 0.5).cast("double") / f


def literal_regex(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|#&~/" else c for c in s)


def java_replacement(s: str) -> str:
    """``$name``, ``${1}`` and ``$$`` for Java; numbered groups only take all digits."""
    out = s.replace("\\", "\\\\")

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return "\\$"
        name = m[1] or m[2]
        return f"${name}" if name.isdigit() else "${" + name + "}"

    return re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)", one, out)


def replace_first(c: Column, old: str, new: str) -> Column:
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(c.substr(F.lit(1), at - 1), F.lit(new), c.substr(at + len(old), F.length(c)))).otherwise(c)


def replace_regex_first(c: Column, pattern: str, new: str) -> Column:
    """The first match only: what is behind it is kept apart."""
    hit = F.regexp_extract(c, f"({pattern})", 1)
    at = F.length(F.get(F.split(c, pattern, 2), F.lit(0))) + 1
    done = F.concat(c.substr(F.lit(1), at - 1), F.regexp_replace(hit, pattern, java_replacement(new)), c.substr(at + F.length(hit), F.length(c)))
    return F.when(c.rlike(pattern) & (F.length(hit) > 0), done).otherwise(c)


def pad(c: Column, n: int, fill: str, left: bool) -> Column:
    """Never truncates."""
    if not fill:
        return c
    return F.when(F.length(c) >= n, c).otherwise((F.lpad if left else F.rpad)(c, n, fill))


def slice_range(arr: Column, start: int, end: int | None) -> Column:
    """Python-like: negatives from the end, clamped."""
    n = F.size(arr)
    s = F.greatest(n + start, F.lit(0)) if start < 0 else F.least(F.lit(start), n)
    e = n if end is None else F.greatest(n + end, F.lit(0)) if end < 0 else F.least(F.lit(end), n)
    return F.slice(arr, s + 1, F.greatest(e - s, F.lit(0)))


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and inside of
    whatever loop ``body`` reads it. Catalyst puts what a loop reads once back
    into the loop, where it is computed for every element."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def chunk(arr: Column, size: int) -> Column:
    def parts(a: Column) -> Column:
        count = F.ceil(F.size(a) / F.lit(size)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(a, i * size + 1, size))

    return let(arr, lambda a: F.when(F.size(a) > 0, parts(a)).otherwise(F.slice(parts(a), 1, 0)))


def placed(keys: Column) -> Column:
    """Keys with their places, sorted by both: equal keys are side by side."""
    return F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))


def opens(rows: Column, r: Column, j: Column) -> Column:
    """Whether row ``j`` of ``placed`` is the first with its key (null-safe)."""
    return (j == 0) | ~F.get(rows, j - 1)["k"].eqNullSafe(r["k"])


def distinct(items: Column, keys: Column) -> Column:
    """The items that are the first with their key (null-safe), in their order."""
    firsts = lambda rows: F.sort_array(F.transform(F.filter(rows, lambda r, j: opens(rows, r, j)), lambda r: r["i"]))
    some = lambda k: let(items, lambda v: F.transform(let(placed(k), firsts), lambda i: F.get(v, i)))
    return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), items).otherwise(some(k)))


def sort_by(items: Column, keys: Column, descending: bool) -> Column:
    """Stable sort by keys of one type."""
    rows = F.transform(keys, lambda k, i: F.struct(k.alias("k"), (-i if descending else i).alias("i")))
    return let(items, lambda v: F.transform(F.sort_array(rows, not descending), lambda r: F.get(v, -r["i"] if descending else r["i"])))


def last_wins(keys: Column, items: Column) -> Column:
    """Map of key to the last item, keys in order."""
    lasts = lambda rows: F.filter(rows, lambda r, j: ~F.get(rows, j + 1)["k"].eqNullSafe(r["k"]))
    return let(items, lambda v: F.map_from_entries(F.transform(let(placed(keys), lasts), lambda r: F.struct(r["k"].alias("k"), F.get(v, r["i"]).alias("v")))))


def grouped(keys: Column, items: Column) -> Column:
    """Map of key to its items in order, keys in order."""
    starts = lambda rows: F.filter(F.transform(rows, lambda r, j: F.when(opens(rows, r, j), j)), lambda j: j.isNotNull())
    group = lambda rows, at, v: lambda j, n: F.transform(F.slice(rows, j + 1, F.coalesce(F.get(at, n + 1), F.size(rows)) - j), lambda r: F.get(v, r["i"]))
    whole = lambda rows, at: let(items, lambda v: F.map_from_arrays(F.transform(at, lambda j: F.get(rows, j)["k"]), F.transform(at, group(rows, at, v))))
    return let(placed(keys), lambda rows: let(starts(rows), lambda at: whole(rows, at)))


def by_key(m: Column, show: Callable[[Column, Column], Column]) -> Column:
    """``show`` of each key of a map and its value, keys in order."""
    return let(F.map_values(m), lambda v: F.transform(placed(F.map_keys(m)), lambda r: show(r["k"], F.get(v, r["i"]))))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


#: Strftime codes and the pattern letters of Spark.
STRFTIME = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "h": "MMM", "B": "MMMM",
    "a": "EEE", "A": "EEEE", "p": "a", "z": "xx", ":z": "xxx", "f": "SSSSSSSSS", ".3f": ".SSS", ".6f": ".SSSSSS", ".9f": ".SSSSSSSSS",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy",
}


def spark_pattern(fmt: str) -> str | None:
    """A strftime format as a pattern of Spark; None where it has no such code."""
    out = ""
    for m in re.finditer(r"%(\.?[0-9]?f|:?z|[A-Za-z%])|([^%]+)|%", fmt):
        if m[2]:
            out += re.sub(r"[A-Za-z]+", lambda w: f"'{w[0]}'", m[2].replace("'", "''"))
        elif m[1] == "%":
            out += "%"
        elif m[1] in STRFTIME:
            out += STRFTIME[m[1]]
        else:
            return None
    return out
