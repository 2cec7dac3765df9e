"""Array operations compute each step once, and no step again for every element."""

import pytest

from sluice import api

SCHEMA = "id bigint, nums array<bigint>, qtys array<double>, items array<struct<line:bigint,part:bigint,qty:double>>"


def made(spark, exprs, rows, mode="strict"):
    maps = [{"target": f"e{i}", "expr": e} for i, e in enumerate(exprs)]
    return api.transform(spark.createDataFrame(rows, SCHEMA), {"version": 2, "input": {"format": "parquet"}, "mappings": maps}, mode=mode)


def planned(df):
    """The plan after Catalyst has merged what it merges."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def order(n, keys):
    return (1, [i % keys for i in range(n)], [float(i) for i in range(n)], [(i % keys, i, float(i % 7)) for i in range(n)])


OBJECTS = [
    ["@input.items", {"group_by": ["@item.line"]}, "keys", "len"],
    ["@input.items", {"group_by": ["@item.line"]}, {"get": ["3"]}, {"map": ["@item.part"]}],
    ["@input.items", {"key_by": ["@item.line"]}, {"get": ["3"]}, {"get": ["part"]}],
    ["@input.items", {"distinct_by": ["@item.line"]}, {"map": ["@item.part"]}],
    ["@input.items", {"sort_by": ["@item.qty", "desc"]}, {"map": ["@item.part"]}],
    ["@input.items", {"key_by": ["@item.line"]}, "entries", "len"],
]


def test_objects_long_orders(spark):
    n, keys = 5000, 1000
    got = made(spark, OBJECTS, [order(n, keys), (2, [], [], [])]).collect()
    parts = list(range(n))
    assert list(got[0]) == [keys, parts[3::keys], n - keys + 3, parts[:keys], sorted(parts, key=lambda i: -(i % 7)), keys]
    assert list(got[1])[0] == 0 and list(got[1])[3:5] == [[], []]


@pytest.mark.parametrize(("expr", "step"), [(OBJECTS[0], "map_from_arrays("), (OBJECTS[2], "map_from_entries("), (OBJECTS[3], "array_distinct("), (OBJECTS[4], "sort_array("), (["@input.items", {"lookup_first": ["line", 2, "part"]}], "filter(")])
def test_objects_once(spark, expr, step):
    assert planned(made(spark, [expr], [order(4, 4)])).count(step) == 1


JOIN = [{"map": ["to_string"]}, {"reduce": [["@acc", {"concat": [",", "@item"]}]]}]


@pytest.mark.parametrize(("first", "step"), [({"sort_by": ["@item", "desc"]}, "sort_array("), ({"filter": [["@item", {">": [2]}]]}, "filter("), ("unique", "array_distinct(")])
def test_slices_once(spark, first, step):
    assert planned(made(spark, [["@input.nums", first, *JOIN]], [order(4, 4)])).count(step) == 1


def test_slices_failures(spark):
    rows = [(1, [1, 2], [], []), (2, [1, None], [], []), (3, [], [], []), (4, [None], [], [])]
    text = ["@input.nums", {"reduce": [["@acc", {"+": ["@item"]}]]}]
    got = made(spark, [text], rows, "quarantine").collect()
    bad = "ExprError: operand is not valid in reduce or fold (path: mappings[0])"
    # with one element, or none, no step is done
    assert [r["_error"] for r in got] == [None, bad, None, None]
    indexed = made(spark, [["@input.nums", {"fold": [0, ["@acc", {"+": ["@item.index"]}]]}], ["@input.nums", {"map": ["@item.index"]}]], [(1, [5, 5, 5], [], [])]).collect()
    assert list(indexed[0]) == [3.0, [0, 1, 2]]


AGGREGATES = [
    ["@input.nums", {"chunk": [2]}, "flatten", "sum"],
    ["@input.nums", {"zip_with": [["@input.qtys", {"map": [{"+": [1]}]}], ["@item.value[0]", {"*": ["@item.value[1]"]}]]}, "sum"],
    ["@input.nums", {"zip": ["@input.nums"]}, "unzip", {"map": ["len"]}],
]


def test_aggregates_long_orders(spark):
    n = 5000
    got = made(spark, AGGREGATES, [order(n, n)]).collect()[0]
    assert list(got) == [n * (n - 1) // 2, sum(i * (i + 1.0) for i in range(n)), [n, n]]


def test_aggregates_once(spark):
    # both branches of a chunk name it: with and without elements
    assert planned(made(spark, AGGREGATES[:1], [order(4, 4)])).count("sequence(") == 2
