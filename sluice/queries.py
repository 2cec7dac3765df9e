"""The registered queries: rules over the test tables, and equivalent SQL.

Outputs are flat and typed, so both sides hash alike. Every query reads its
whole tables.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import api
from .operators import arrays as A
from .operators import profile
from .sources import readers, sinks
from .streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rule(body: str) -> str:
    return "version: 2\ninput: { format: parquet }\n" + body


def register(name: str, source: str, body: str, sql: str | None, sides: tuple[str, ...] = (), prepare: Callable[[SparkSession, str, DataFrame], DataFrame] | None = None, **options) -> None:
    """A query of one rule over one table; ``sides`` are tables of the context."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        if prepare:
            df = prepare(spark, sf_dir, df)
        context = {s: table(spark, sf_dir, s) for s in sides} or None
        return api.transform(df, rule(body), context, **options)

    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


FLAGSHIP = rule(r"""
record_when:
  all: [ { gt: ["@input.l_quantity", 10] }, { match: ["@input.l_returnflag", "^[AR]$"] } ]
mappings:
  - { target: order_key, source: l_orderkey }
  - { target: part_key, source: l_partkey }
  - target: net
    expr: ["@input.l_extendedprice", { multiply: [[1, { subtract: ["@input.l_discount"] }]] }, { round: [2] }]
  - { target: flag, expr: ["@input.l_returnflag", { concat: ["-", "@input.l_linestatus"] }] }
  - target: tier
    expr: ["@input.l_quantity", { if: { cond: { gte: ["$", 25] }, then: "bulk", else: "unit" } }]
""")


@query("flagship_lineitem", """
SELECT l_orderkey AS order_key, l_partkey AS part_key, round(l_extendedprice * (1 - l_discount) * 100) / 100 AS net,
       l_returnflag || '-' || l_linestatus AS flag, CASE WHEN l_quantity >= 25 THEN 'bulk' ELSE 'unit' END AS tier
FROM lineitem WHERE l_quantity > 10 AND regexp_matches(l_returnflag, '^[AR]$')""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.transform(table(spark, sf_dir, "lineitem"), FLAGSHIP)


register("project_cast", "orders", """
mappings:
  - { target: key, source: o_orderkey, type: string, required: true }
  - { target: price_text, source: o_totalprice, type: string }
  - { target: cust, source: input.o_custkey, type: float }
  - { target: price, expr: ["@out.price_text", float] }
  - { target: whole, expr: ["@out.key", int] }
  - { target: origin, value: api }
  - { target: absent, source: nothing, default: none }
  - { target: flag, expr: ["TRUE", bool] }
""", """
SELECT CAST(o_orderkey AS VARCHAR) AS "key", CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END AS price_text,
       CAST(o_custkey AS DOUBLE) AS cust, o_totalprice AS price, o_orderkey AS whole, 'api' AS origin, 'none' AS absent, true AS flag FROM orders""")

register("nested_targets", "customer", """
mappings:
  - { target: user.id, source: c_custkey }
  - { target: user.name, source: c_name }
  - { target: user.address.nation, source: c_nationkey }
  - { target: id, source: out.user.id }
  - { target: name, expr: ["@out.user", { get: [name] }] }
  - { target: nation, expr: "@out.user.address.nation" }
  - { target: n_keys, expr: ["@out.user", keys, len] }
""", None)


@query("nested_flat", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, CAST(3 AS BIGINT) AS n_keys FROM customer")
def nested_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["nested_targets"](spark, sf_dir).drop("user")


@query("nested_struct", """
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, CAST(3 AS BIGINT) AS n_keys,
       '{"address":{"nation":' || c_nationkey || '},"id":' || c_custkey || ',"name":"' || c_name || '"}' AS user FROM customer""")
def nested_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested target as text, which SQL can compare."""
    u = F.col("user")
    shown = F.to_json(F.struct(F.struct(u["address"]["nation"].alias("nation")).alias("address"), u["id"].alias("id"), u["name"].alias("name")))
    return QUERIES["nested_targets"](spark, sf_dir).withColumn("user", shown)


register("filter_all_any", "customer", r"""
record_when:
  any:
    - all: [ { gte: ["@input.c_acctbal", 5000] }, { eq: ["@input.c_mktsegment", BUILDING] } ]
    - { lt: ["@input.c_acctbal", 0] }
    - { match: ["@input.c_name", "7$"] }
mappings:
  - { target: id, source: c_custkey }
  - { target: balance, source: c_acctbal }
  - { target: segment, source: c_mktsegment, when: { ne: ["@input.c_mktsegment", MACHINERY] } }
""", """
SELECT c_custkey AS id, c_acctbal AS balance, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment FROM customer
WHERE (c_acctbal >= 5000 AND c_mktsegment = 'BUILDING') OR c_acctbal < 0 OR regexp_matches(c_name, '7$')""")

register("string_mix", "part", r"""
mappings:
  - { target: id, source: p_partkey }
  - { target: low, expr: ["@input.p_name", trim, lowercase] }
  - { target: up, expr: ["@input.p_type", uppercase] }
  - { target: both, expr: ["@input.p_brand", { concat: ["/", "@input.p_size"] }] }
  - { target: size3, expr: ["@input.p_size", to_string, { pad_start: [5, "0"] }] }
  - { target: tail, expr: ["@input.p_brand", { pad_end: [12, "._"] }] }
  - { target: one, expr: ["@input.p_name", { replace: ["a", "A"] }] }
  - { target: every, expr: ["@input.p_name", { replace: ["a", "A", all] }] }
  - { target: digits, expr: ["@input.p_brand", { replace: ["[0-9]", "#", regex_all] }] }
  - { target: first_digit, expr: ["@input.p_brand", { replace: ["([0-9])", "<$1>", regex] }] }
  - { target: parts, expr: ["@input.p_brand", { split: ["#"] }, len] }
  - { target: chars, expr: ["@input.p_name", len] }
  - { target: has5, expr: ["@input.p_brand", { "~=": ["5"] }] }
""", """
SELECT p_partkey AS id, lower(trim(p_name)) AS low, upper(p_type) AS up, p_brand || '/' || p_size AS both,
       CASE WHEN length(CAST(p_size AS VARCHAR)) >= 5 THEN CAST(p_size AS VARCHAR) ELSE lpad(CAST(p_size AS VARCHAR), 5, '0') END AS size3,
       CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE rpad(p_brand, 12, '._') END AS tail,
       regexp_replace(p_name, 'a', 'A') AS one, replace(p_name, 'a', 'A') AS every, regexp_replace(p_brand, '[0-9]', '#', 'g') AS digits,
       regexp_replace(p_brand, '([0-9])', '<\\1>') AS first_digit, CAST(len(string_split(p_brand, '#')) AS BIGINT) AS parts, CAST(length(p_name) AS BIGINT) AS chars, regexp_matches(p_brand, '5') AS has5 FROM part""")

register("numeric_mix", "lineitem", """
mappings:
  - { target: ord, source: l_orderkey }
  - { target: line, source: l_linenumber }
  - { target: qty, source: l_quantity }
  - { target: added, expr: ["@input.l_quantity", { "+": [1, "2.5"] }, { round: [2] }] }
  - { target: taken, expr: ["@input.l_quantity", { subtract: [3, 1] }] }
  - { target: unit, expr: ["@input.l_extendedprice", { "/": ["@input.l_quantity"] }, { round: [3] }] }
  - { target: gross, expr: ["@input.l_extendedprice", { "*": [[1, { "+": ["@input.l_tax"] }]] }, { round: [2] }] }
  - { target: whole, expr: ["@input.l_extendedprice", round] }
  - { target: hex, expr: ["@input.l_partkey", { to_base: [16] }] }
  - { target: base36, expr: ["@input.l_suppkey", { to_base: [36] }] }
""", """
SELECT l_orderkey AS ord, CAST(l_linenumber AS BIGINT) AS line, l_quantity AS qty, round((l_quantity + 1 + 2.5) * 100) / 100 AS added, l_quantity - 3 - 1 AS taken,
       round(l_extendedprice / l_quantity * 1000) / 1000 AS unit, round(l_extendedprice * (1 + l_tax) * 100) / 100 AS gross, CAST(round(l_extendedprice) AS BIGINT) AS whole,
       lower(to_base(l_partkey, 16)) AS hex, lower(to_base(l_suppkey, 36)) AS base36 FROM lineitem""")

register("date_mix", "orders", r"""
mappings:
  - { target: id, source: o_orderkey }
  - { target: day, expr: ["@input.o_orderdate", { date_format: ["%Y/%m/%d"] }] }
  - { target: tokyo, expr: ["@input.o_orderdate", { date_format: ["%Y-%m-%d %H:%M", "+09:00"] }] }
  - { target: secs, expr: ["@input.o_orderdate", to_unixtime] }
  - { target: millis, expr: ["@input.o_orderdate", { to_unixtime: [ms] }] }
  - { target: again, expr: ["@out.day", { date_format: ["%d.%m.%Y"] }] }
  - { target: explicit, expr: ["@out.again", { date_format: ["%j %b", "%d.%m.%Y"] }] }
""", """
SELECT o_orderkey AS id, strftime(o_orderdate, '%Y/%m/%d') AS day, strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS tokyo,
       CAST(epoch(o_orderdate) AS BIGINT) AS secs, epoch_ms(o_orderdate) AS millis, strftime(o_orderdate, '%d.%m.%Y') AS again, strftime(o_orderdate, '%j %b') AS explicit FROM orders""")

register("if_let", "orders", """
mappings:
  - { target: id, source: o_orderkey }
  - target: band
    expr:
      - "@input.o_totalprice"
      - let: { half: ["$", { "/": [2] }], limit: 50000 }
      - if: { gt: ["@half", "@limit"] }
        then: high
        else: ["@half", { if: { cond: { lt: ["$", 10000] }, then: low, else: middle } }]
  - { target: status, expr: ["@input.o_totalprice", "@input.o_orderstatus", lowercase] }
  - { target: kept, expr: ["@input.o_orderstatus", { if: { cond: { eq: ["$", F] }, then: final } }] }
""", """
SELECT o_orderkey AS id, CASE WHEN o_totalprice / 2 > 50000 THEN 'high' WHEN o_totalprice / 2 < 10000 THEN 'low' ELSE 'middle' END AS band,
       lower(o_orderstatus) AS status, CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE o_orderstatus END AS kept FROM orders""")

register("logic_ops", "lineitem", """
mappings:
  - { target: ord, source: l_orderkey }
  - { target: price, source: l_extendedprice }
  - { target: big, expr: ["@input.l_quantity", { ">": [30] }] }
  - { target: both, expr: ["@out.big", { and: [["@input.l_discount", { "<": [0.05] }]] }] }
  - { target: any, expr: ["@out.big", { or: [["@input.l_tax", { ">=": [0.04] }]] }] }
  - { target: negated, expr: ["@out.big", not] }
  - { target: same, expr: ["@input.l_linenumber", { "==": ["1"] }] }
  - { target: other, expr: ["@input.l_returnflag", { "!=": ["N"] }] }
""", """
SELECT l_orderkey AS ord, l_extendedprice AS price, l_quantity > 30 AS big, l_quantity > 30 AND l_discount < 0.05 AS both, l_quantity > 30 OR l_tax >= 0.04 AS any,
       NOT l_quantity > 30 AS negated, l_linenumber = 1 AS same, l_returnflag <> 'N' AS other FROM lineitem""")

register("lookup_first_nation", "customer", """
mappings:
  - { target: id, source: c_custkey }
  - target: nation
    expr: ["@context.nation", { lookup_first: [n_nationkey, "@input.c_nationkey", n_name] }]
  - target: region
    expr:
      - "@context.nation"
      - { lookup_first: [n_nationkey, "@input.c_nationkey"] }
      - { get: [n_regionkey] }
      - { coalesce: [-1] }
""", """
SELECT c_custkey AS id, n_name AS nation, coalesce(n_regionkey, -1) AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""", sides=("nation",))

register("lookup_all_orders", "customer", """
mappings:
  - { target: id, source: c_custkey }
  - target: prices
    expr:
      - "@context.orders"
      - { lookup: [o_custkey, "@input.c_custkey", o_totalprice] }
  - { target: n, expr: ["@out.prices", len] }
  - { target: total, expr: ["@out.prices", sum, { coalesce: [0] }, { round: [2] }] }
  - { target: most, expr: ["@out.prices", max] }
""", None, sides=("orders",))


@query("lookup_all_totals", """
SELECT c_custkey AS id, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0) * 100) / 100 AS total, max(o_totalprice) AS most
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def lookup_all_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["lookup_all_orders"](spark, sf_dir).drop("prices")


@query("lookup_all_prices", """
SELECT c_custkey AS id, count(o_orderkey) AS n, coalesce(string_agg(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY o_totalprice), '') AS prices
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def lookup_all_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches themselves, in cents and in order, as text."""
    cents = F.transform(F.array_sort("prices"), lambda p: F.round(p * 100).cast("bigint").cast("string"))
    return QUERIES["lookup_all_orders"](spark, sf_dir).select("id", "n", F.array_join(cents, ",").alias("prices"))


register("lookup_part_lineitem", "lineitem", """
mappings:
  - { target: ord, source: l_orderkey }
  - { target: part, source: l_partkey }
  - { target: price, source: l_extendedprice }
  - { target: brand, expr: ["@context.part", { lookup_first: [p_partkey, "@input.l_partkey", p_brand] }] }
  - { target: kind, expr: ["@context.part", { lookup_first: [p_partkey, "@input.l_partkey", p_type] }] }
""", "SELECT l_orderkey AS ord, l_partkey AS part, l_extendedprice AS price, p_brand AS brand, p_type AS kind FROM lineitem LEFT JOIN part ON p_partkey = l_partkey", sides=("part",))


@query("lookup_list_v1", """
SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'soon' ELSE 'later' END AS due FROM orders""")
def lookup_list_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = """
version: 1
input: { format: parquet }
mappings:
  - { target: id, source: o_orderkey }
  - target: due
    expr:
      op: coalesce
      args:
        - { op: lookup_first, args: [ { ref: context.due }, p, { ref: input.o_orderpriority }, d ] }
        - later
"""
    return api.transform(table(spark, sf_dir, "orders"), body, {"due": [{"p": "1-URGENT", "d": "now"}, {"p": "2-HIGH", "d": "soon"}, {"p": "1-URGENT", "d": "never"}]})


@query("group_by_aggregate", """
SELECT l_returnflag AS key, count(*) AS len, round(sum(l_quantity) * 100) / 100 AS sum, round(avg(l_quantity) * 1000000) / 1000000 AS avg, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 1""")
def group_by_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.summarise(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_quantity"))
    return api.transform(df, rule("""
mappings:
  - { target: key, source: key }
  - { target: len, source: len }
  - { target: sum, expr: ["@input.sum", { round: [2] }] }
  - { target: avg, expr: ["@input.avg", { round: [6] }] }
  - { target: min, source: min }
  - { target: max, source: max }
"""))


@query("group_by_items", "SELECT CAST(o_custkey AS VARCHAR) AS key, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS items FROM orders GROUP BY 1")
def group_by_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.group_by(table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderkey").cast("string"), ["o_orderdate", "o_orderkey"])
    return rows.select("key", F.array_join("items", ",").alias("items"))


@query("key_by_last", "SELECT CAST(o_custkey AS VARCHAR) AS key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS item FROM orders GROUP BY 1")
def key_by_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.key_by(table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderkey"), ["o_orderdate", "o_orderkey"])


@query("distinct_by_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def distinct_by_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return A.distinct_by(df, F.col("o_custkey"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("partition_flag", "SELECT CASE WHEN l_discount > 0.05 THEN 'matched' ELSE 'unmatched' END AS side, count(*) AS n, round(sum(l_extendedprice)) AS total FROM lineitem GROUP BY 1")
def partition_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides in one scan: the flag is a column, a side is a filter on it."""
    flagged = A.flag_partition(table(spark, sf_dir, "lineitem"), F.col("l_discount") > 0.05, "yes")
    side = F.when(F.col("yes"), "matched").otherwise("unmatched").alias("side")
    return flagged.groupBy(side).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice")).alias("total"))


@query("contains_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def contains_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 200000)
    return A.contains(table(spark, sf_dir, "customer"), F.col("c_custkey"), rich, "o_custkey").select("c_custkey", "c_name")


def per_order(spark: SparkSession, sf_dir: str, _: DataFrame) -> DataFrame:
    """Orders with their line numbers and prices as arrays, in a total order."""
    df = table(spark, sf_dir, "lineitem")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = df.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("r"))
    return rows.select("l_orderkey", F.transform("r", lambda x: x["l_linenumber"].cast("bigint")).alias("nums"), F.transform("r", lambda x: x["l_quantity"]).alias("qtys"), F.transform("r", lambda x: F.struct(x["l_partkey"].alias("part"), x["l_linenumber"].cast("bigint").alias("line"), x["l_quantity"].alias("qty"))).alias("items"))


PER_ORDER = """
WITH o AS (SELECT l_orderkey, list(CAST(l_linenumber AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS nums,
                  list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS qtys,
                  list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS parts FROM lineitem GROUP BY l_orderkey)
"""
CSV = lambda name, pipe: f"  - {{ target: {name}, expr: {pipe} }}\n"
JOIN = '{ map: [to_string] }, { reduce: [["@acc", { concat: [",", "@item"] }]] }'

register("array_slices", "lineitem", "mappings:\n  - { target: id, source: l_orderkey }\n" + "".join(
    CSV(n, f'["@input.nums", {s}, {JOIN}]') for n, s in (
        ("plus", '{ map: [{ "+": [1] }, int] }'), ("odd", '{ filter: [["@item", { ">": [2] }]] }'), ("doubled", '{ map: ["@item.index"] }'), ("head", "{ take: [2] }"), ("tail", "{ take: [-2] }"),
        ("rest", "{ drop: [1] }"), ("front", "{ drop: [-1] }"), ("mid", "{ slice: [1, -1] }"), ("uniq", "unique"), ("down", '{ sort_by: ["@item", desc] }'), ("once", '{ distinct_by: [["@item", to_string]] }'),
    )), PER_ORDER + """
SELECT l_orderkey AS id, nullif(array_to_string(list_transform(nums, lambda x: x + 1), ','), '') AS plus, nullif(array_to_string(list_filter(nums, lambda x: x > 2), ','), '') AS odd,
       array_to_string(range(0, len(nums)), ',') AS doubled, array_to_string(nums[1:2], ',') AS head, array_to_string(nums[greatest(len(nums) - 1, 1):], ',') AS tail,
       nullif(array_to_string(nums[2:], ','), '') AS rest, nullif(array_to_string(nums[1:len(nums) - 1], ','), '') AS front, nullif(array_to_string(nums[2:len(nums) - 1], ','), '') AS mid,
       (SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT unnest(nums) AS x)) AS uniq, array_to_string(list_reverse_sort(nums), ',') AS down,
       (SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT unnest(nums) AS x)) AS once FROM o""", prepare=per_order)

register("array_aggregates", "lineitem", """
mappings:
  - { target: id, source: l_orderkey }
  - { target: n, expr: ["@input.nums", len] }
  - { target: s, expr: ["@input.nums", sum] }
  - { target: a, expr: ["@input.qtys", avg, { round: [4] }] }
  - { target: lo, expr: ["@input.qtys", min] }
  - { target: hi, expr: ["@input.qtys", max] }
  - { target: reduced, expr: ["@input.nums", { reduce: [["@acc", { "+": ["@item"] }]] }] }
  - { target: folded, expr: ["@input.nums", { fold: [100, ["@acc", { "+": ["@item"] }]] }] }
  - { target: first, expr: ["@input.nums", first] }
  - { target: last, expr: ["@input.nums", last] }
  - { target: found, expr: ["@input.nums", { find: [["@item", { ">": [2] }]] }] }
  - { target: at, expr: ["@input.nums", { find_index: [["@item", { ">": [2] }]] }] }
  - { target: pos, expr: ["@input.nums", { index_of: [3] }] }
  - { target: has, expr: ["@input.nums", { contains: ["3"] }] }
  - { target: chunks, expr: ["@input.nums", { chunk: [2] }, len] }
  - { target: flat, expr: ["@input.nums", { chunk: [2] }, flatten, sum] }
  - { target: dots, expr: ["@input.nums", { zip_with: ["@input.qtys", ["@item.value[0]", { "*": ["@item.value[1]"] }]] }, sum, { round: [2] }] }
  - { target: unzipped, expr: ["@input.nums", { zip: ["@input.nums"] }, unzip, len] }
  - { target: parts, expr: ["@input.nums", { partition: [["@item", { ">": [2] }]] }, { map: [len] }, first] }
""", PER_ORDER + """
SELECT l_orderkey AS id, CAST(len(nums) AS BIGINT) AS n, CAST(list_sum(nums) AS BIGINT) AS s, round(list_avg(qtys) * 10000) / 10000 AS a, list_min(qtys) AS lo, list_max(qtys) AS hi,
       CAST(list_sum(nums) AS DOUBLE) AS reduced, CAST(100 + list_sum(nums) AS DOUBLE) AS folded, nums[1] AS first, nums[-1] AS last,
       list_filter(nums, lambda x: x > 2)[1] AS found, CASE WHEN len(list_filter(nums, lambda x: x > 2)) = 0 THEN -1 ELSE list_position(nums, list_filter(nums, lambda x: x > 2)[1]) - 1 END AS at,
       coalesce(list_position(nums, 3), 0) - 1 AS pos, list_contains(nums, 3) AS has, CAST(ceil(len(nums) / 2) AS BIGINT) AS chunks, CAST(list_sum(nums) AS BIGINT) AS flat,
       round(list_sum(list_transform(range(1, len(nums) + 1), lambda i: nums[i] * qtys[i])) * 100) / 100 AS dots, CAST(2 AS BIGINT) AS unzipped, CAST(len(list_filter(nums, lambda x: x > 2)) AS BIGINT) AS parts FROM o""", prepare=per_order)

register("array_objects", "lineitem", """
mappings:
  - { target: id, source: l_orderkey }
  - { target: groups, expr: ["@input.items", { group_by: ["@item.line"] }, keys, len] }
  - { target: last_part, expr: ["@input.items", { key_by: ["@item.line"] }, { get: ["1"] }, { get: [part] }] }
  - { target: firsts, expr: ["@input.items", { distinct_by: ["@item.line"] }, { map: ["@item.qty"] }, sum] }
  - { target: best, expr: ["@input.items", { sort_by: ["@item.qty", desc] }, first, { get: [qty] }] }
  - { target: flat, expr: ["@input.items", { flat_map: [["@item.line"]] }, len] }
  - { target: entries, expr: ["@input.items", { key_by: ["@item.line"] }, entries, len] }
  - { target: looked, expr: ["@input.items", { lookup_first: [line, 2, part] }] }
""", PER_ORDER + """
SELECT l_orderkey AS id, CAST(len(list_distinct(nums)) AS BIGINT) AS groups, (list_filter(list_transform(range(1, len(nums) + 1), lambda i: {'n': nums[i], 'p': parts[i]}), lambda x: x.n = 1)[-1]).p AS last_part,
       list_sum(list_transform(list_filter(range(1, len(nums) + 1), lambda i: i = list_position(nums, nums[i])), lambda i: qtys[i])) AS firsts, list_max(qtys) AS best,
       CAST(len(nums) AS BIGINT) AS flat, CAST(len(list_distinct(nums)) AS BIGINT) AS entries,
       (list_filter(list_transform(range(1, len(nums) + 1), lambda i: {'n': nums[i], 'p': parts[i]}), lambda x: x.n = 2)[1]).p AS looked FROM o""", prepare=per_order)

register("object_mix", "nation", """
mappings:
  - { target: id, source: n_nationkey }
  - { target: n, expr: ["@input", { pick: [n_name, n_regionkey] }, keys, len] }
  - { target: kept, expr: ["@input", { omit: [n_name] }, keys, { reduce: [["@acc", { concat: [",", "@item"] }]] }] }
  - { target: obj.a.b, source: n_name }
  - { target: obj.a.c, source: n_name }
  - { target: flat, expr: ["@out.obj", object_flatten, keys, { reduce: [["@acc", { concat: [",", "@item"] }]] }] }
  - { target: back, expr: ["@out.obj", object_flatten, object_unflatten, { get: [a.b] }] }
  - { target: merged, expr: ["@input", { merge: ["@out.obj"] }, len] }
  - { target: deep, expr: ["@out.obj", { deep_merge: ["@out.obj"] }, { get: [a.c] }] }
  - { target: vals, expr: ["@out.obj.a", values, len] }
  - { target: ents, expr: ["@out.obj.a", entries, from_entries, { get: [c] }] }
  - { target: one, expr: ["@input.n_name", { from_entries: ["@input.n_regionkey"] }, keys, first] }
""", None)


@query("object_flat", """
SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(2 AS BIGINT) AS n, 'n_nationkey,n_regionkey' AS kept, 'a.b,a.c' AS flat, n_name AS back, CAST(4 AS BIGINT) AS merged, n_name AS deep, CAST(2 AS BIGINT) AS vals, n_name AS ents, n_name AS one FROM nation""")
def object_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["object_mix"](spark, sf_dir).drop("obj")


@query("object_struct", """SELECT CAST(n_nationkey AS BIGINT) AS id, '{"a":{"b":"' || n_name || '","c":"' || n_name || '"}}' AS obj FROM nation""")
def object_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object of dotted targets as text."""
    return QUERIES["object_mix"](spark, sf_dir).select("id", F.to_json("obj").alias("obj"))


register("coalesce_null", "lineitem", """
mappings:
  - { target: ord, source: l_orderkey }
  - { target: price, source: l_extendedprice }
  - { target: a, expr: [null, { coalesce: ["@input.nothing", "@input.l_returnflag"] }] }
  - { target: b, expr: ["@input.nothing", { coalesce: [null] }], default: 7 }
  - { target: flag, expr: ["@input.l_returnflag", { if: { cond: { eq: ["@input.nothing", null] }, then: "$", else: x } }] }
""", "SELECT l_orderkey AS ord, l_extendedprice AS price, l_returnflag AS a, CAST(7 AS BIGINT) AS b, l_returnflag AS flag FROM lineitem")

register("sort_topk", "orders", """
mappings:
  - { target: id, source: o_orderkey }
  - { target: price, source: o_totalprice }
  - { target: status, source: o_orderstatus }
finalize:
  filter: { eq: ["@item.status", F] }
  sort: { by: price, order: desc }
  offset: 5
  limit: 20
""", "SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY price DESC, id LIMIT 20 OFFSET 5")

register("wrap_total", "orders", """
mappings:
  - { target: price, source: o_totalprice }
  - { target: status, source: o_orderstatus }
finalize:
  filter: { ne: ["@item.status", P] }
  wrap:
    total: ["@out", len]
    sum: ["@out", { map: ["@item.price"] }, sum, { round: [0] }]
    most: ["@out", { map: ["@item.price"] }, max]
    least: ["@out", { map: ["@item.price"] }, min]
    kind: "lit:orders"
""", "SELECT count(*) AS total, CAST(round(sum(o_totalprice)) AS BIGINT) AS sum, max(o_totalprice) AS most, min(o_totalprice) AS least, 'orders' AS kind FROM orders WHERE o_orderstatus <> 'P'")


register("lookup_then_finalize", "lineitem", """
record_when: { gte: ["@input.l_quantity", 45] }
mappings:
  - { target: ord, source: l_orderkey }
  - { target: line, source: l_linenumber }
  - { target: size, expr: ["@context.part", { lookup_first: [p_partkey, "@input.l_partkey", p_size] }] }
finalize:
  filter: { ne: ["@item.size", null] }
  sort: { by: size, order: desc }
  offset: 7
  limit: 50
""", "SELECT l_orderkey AS ord, l_linenumber AS line, p_size AS size FROM (SELECT *, row_number() OVER () AS place FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 45 ORDER BY p_size DESC, place LIMIT 50 OFFSET 7", sides=("part",))


@query("branch_tier", """
SELECT l_orderkey AS ord, l_extendedprice AS price, CASE WHEN l_quantity >= 25 THEN 'bulk' ELSE 'unit' END AS tier, CASE WHEN l_quantity >= 25 THEN l_discount END AS rebate, (CASE WHEN l_quantity >= 25 THEN 'bulk' ELSE 'unit' END) || '-tier' AS label
FROM lineitem WHERE l_quantity >= 5""")
def branch_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.ast import Branch
    from .plans.parse import condition, parse_rule

    high = parse_rule(rule('mappings:\n  - { target: tier, value: bulk }\n  - { target: rebate, source: discount }\n'))
    low = parse_rule(rule("mappings:\n  - { target: tier, value: unit }\n"))
    before = parse_rule(rule("""
steps:
  - record_when: { gte: ["@input.l_quantity", 5] }
  - mappings:
      - { target: ord, source: l_orderkey }
      - { target: price, source: l_extendedprice }
      - { target: discount, source: l_discount }
  - asserts:
      - when: { gte: ["@out.price", 0] }
        error: { code: negative, message: price is negative }
"""))
    after = parse_rule(rule('mappings:\n  - { target: label, expr: ["@input.l_quantity", { if: { cond: { gte: ["$", 25] }, then: bulk, else: unit } }, { concat: ["-tier"] }] }\n'))
    steps = (*before.steps, Branch(condition({"gte": ["@input.l_quantity", 25]}, 2), high, low, False, "steps[3].branch"), *after.steps)
    whole = type(before)(2, "parquet", steps)
    return api.transform(table(spark, sf_dir, "lineitem"), whole).drop("discount")


@query("v1_rule", """
SELECT o_orderkey AS id, 'u-' || o_custkey AS label, lower(o_orderpriority) AS priority, o_custkey + 5 AS added, CASE WHEN o_totalprice > 100000 THEN o_orderstatus END AS big
FROM orders WHERE o_orderstatus <> 'P'""")
def v1_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.transform(table(spark, sf_dir, "orders"), """
version: 1
input: { format: parquet }
record_when: { op: "!=", args: [ { ref: input.o_orderstatus }, P ] }
mappings:
  - { target: id, source: o_orderkey }
  - { target: label, expr: { op: concat, args: [ "u-", { op: to_string, args: [ { ref: input.o_custkey } ] } ] } }
  - { target: priority, expr: { chain: [ { ref: input.o_orderpriority }, { op: trim }, { op: lowercase } ] } }
  - { target: added, expr: { op: "+", args: [ { ref: input.o_custkey }, 5 ] } }
  - { target: big, source: o_orderstatus, when: { op: ">", args: [ { ref: input.o_totalprice }, 100000 ] } }
""")


@query("json_records", """
SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type || '!' AS kind FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 5""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record evaluator, on records held as JSON."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"type":"'), F.col("event_type"), F.lit('","props":'), F.col("props"), F.lit("}")).alias("value"))
    out = api.transform_json(rows, """
version: 2
input: { format: json, json: {} }
record_when: { gte: ["@input.props.k", 5] }
mappings:
  - { target: id, source: id }
  - { target: k, expr: "@input.props.k" }
  - { target: kind, expr: ["@input.type", { concat: ["!"] }] }
""")
    return out.select(F.from_json("value", "id bigint, k bigint, kind string").alias("r")).select("r.*")


@query("json_output", """
SELECT '{"id":' || c_custkey || ',"segment":"' || c_mktsegment || '"' || CASE WHEN c_acctbal < 0 THEN ',"user":{"debt":true,"name":"' ELSE ',"user":{"name":"' END || c_name || '"}}' AS value FROM customer""")
def json_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON: sorted keys, a missing field left out."""
    return api.compiled(table(spark, sf_dir, "customer"), rule("""
mappings:
  - { target: id, source: c_custkey }
  - { target: segment, source: c_mktsegment }
  - { target: user.name, source: c_name }
  - { target: user.debt, value: true, when: { lt: ["@input.c_acctbal", 0] } }
""")).json()


@query("quarantine", """
SELECT CASE WHEN l_tax <> 0 THEN l_orderkey END AS ord, CASE WHEN l_tax <> 0 THEN l_extendedprice END AS price, CASE WHEN l_tax <> 0 THEN round(l_discount / l_tax * 1000) / 1000 END AS ratio, CASE WHEN l_tax = 0 THEN 'ExprError: division by zero (path: mappings[2])' END AS _error FROM lineitem""")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failing record is marked and kept out of the job's way."""
    out = api.transform(table(spark, sf_dir, "lineitem"), rule("""
mappings:
  - { target: ord, source: l_orderkey }
  - { target: price, source: l_extendedprice }
  - { target: ratio, expr: ["@input.l_discount", { "/": ["@input.l_tax"] }, { round: [3] }] }
"""), mode="quarantine")
    return out


@query("warnings_when", """
SELECT p_partkey AS id, CAST(0 AS BIGINT) AS kept, CAST(1 AS BIGINT) AS warned FROM part""")
def warnings_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error in ``when`` skips the mapping and becomes a warning."""
    out = api.transform(table(spark, sf_dir, "part"), rule("""
mappings:
  - { target: id, source: p_partkey }
  - { target: x, source: p_name, when: { gt: ["@input.p_name", 5] } }
"""), warnings=True)
    return out.select("id", F.col("x").isNotNull().cast("bigint").alias("kept"), F.size("_warnings").cast("bigint").alias("warned"))


@query("dynamic_fallback", """
SELECT n_nationkey AS id, '["' || n_name || '",' || n_regionkey || ',["x"]]' AS mixed, length(n_name) + 2 AS size FROM nation""")
def dynamic_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapping without a static type goes to the record evaluator, the rest stays columns."""
    return api.transform(table(spark, sf_dir, "nation"), rule("""
mappings:
  - { target: id, source: n_nationkey }
  - { target: mixed, expr: ["@input.n_name", { from_entries: ["@input.n_regionkey"] }, entries, { map: ["@item", { merge: [{ z: [x] }] }, values] }, first] }
  - { target: size, expr: ["@input.n_name", len, { "+": [2] }], type: int }
"""))


@query("profile_input", """
SELECT path, type, count(*) AS n FROM (SELECT unnest([{'path': 'o_orderkey', 'type': 'int'}, {'path': 'o_custkey', 'type': 'int'}, {'path': 'o_orderstatus', 'type': 'string'}, {'path': 'o_totalprice', 'type': 'float'}, {'path': 'o_orderdate', 'type': 'string'}, {'path': 'o_orderpriority', 'type': 'string'}], recursive := true) FROM orders) GROUP BY ALL""")
def profile_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.analyse(table(spark, sf_dir, "orders")).select("path", F.explode("types").alias("type", "n"))


@query("lacks_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def lacks_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 200000)
    return A.lacks(table(spark, sf_dir, "customer"), F.col("c_custkey"), rich, "o_custkey").select("c_custkey", "c_name")


@query("lookup_v1_all", """
SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def lookup_v1_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches in the older syntax: a record without any has no value."""
    out = api.transform(table(spark, sf_dir, "customer"), """
version: 1
input: { format: parquet }
mappings:
  - { target: id, source: c_custkey }
  - target: keys
    expr: { op: lookup, args: [ { ref: context.orders }, o_custkey, { ref: input.c_custkey }, o_orderkey ] }
""", {"orders": table(spark, sf_dir, "orders")})
    return out.where("keys is not null").select("id", F.size("keys").cast("bigint").alias("n"))


register("lookup_explicit", "nation", """
mappings:
  - { target: id, source: n_nationkey }
  - { target: region, expr: ["lit:x", { lookup_first: ["@context.region", r_regionkey, "@input.n_regionkey", r_name] }] }
  - { target: whole, expr: ["lit:x", { lookup_first: ["@context.region", r_regionkey, "@input.n_regionkey"] }, { get: [r_name] }] }
  - { target: names, expr: ["lit:x", { lookup: ["@context.region", r_regionkey, "@input.n_regionkey", r_name] }, len] }
""", "SELECT n_nationkey AS id, r_name AS region, r_name AS whole, CAST(1 AS BIGINT) AS names FROM nation JOIN region ON r_regionkey = n_regionkey", sides=("region",))


@query("required_and_asserts", """
SELECT CASE WHEN l_tax <> 0 AND l_returnflag <> 'R' THEN l_orderkey END AS ord, CASE WHEN l_tax <> 0 AND l_returnflag <> 'R' THEN l_extendedprice END AS price, CASE WHEN l_tax <> 0 AND l_returnflag <> 'R' THEN l_returnflag END AS flag,
       CASE WHEN l_returnflag = 'R' THEN 'MissingRequired: required value is missing or null (path: steps[0].mappings[2])' WHEN l_tax = 0 THEN 'AssertionFailed: untaxed: a line is taxed (path: steps[1].asserts[0])' END AS _error FROM lineitem""")
def required_and_asserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that lack a required value or fail an assert, marked."""
    return api.transform(table(spark, sf_dir, "lineitem"), rule("""
steps:
  - mappings:
      - { target: ord, source: l_orderkey }
      - { target: price, source: l_extendedprice }
      - { target: flag, expr: ["@input.l_returnflag", { if: { cond: { ne: ["$", R] }, then: "$", else: null } }], required: true }
  - asserts:
      - when: { ne: ["@input.l_tax", 0] }
        error: { code: untaxed, message: a line is taxed }
"""), mode="quarantine")


@query("branch_return", """
SELECT CASE WHEN o_totalprice >= 150000 THEN o_orderkey END AS big, CASE WHEN o_totalprice < 150000 THEN o_orderkey END AS id, CASE WHEN o_totalprice < 150000 THEN o_orderstatus END AS status FROM orders""")
def branch_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch that returns ends its records there; the others go on."""
    from .plans.ast import Branch
    from .plans.parse import condition, parse_rule

    big = parse_rule(rule("mappings:\n  - { target: big, source: key }\n"))
    before = parse_rule(rule("mappings:\n  - { target: key, source: o_orderkey }\n"))
    after = parse_rule(rule("mappings:\n  - { target: id, source: o_orderkey }\n  - { target: status, source: o_orderstatus }\n"))
    steps = (*before.steps, Branch(condition({"gte": ["@input.o_totalprice", 150000]}, 2), big, None, True, "steps[1].branch"), *after.steps)
    return api.transform(table(spark, sf_dir, "orders"), type(before)(2, "parquet", steps)).select("big", "id", "status")


def exchanged(spark: SparkSession, name: str) -> str:
    """A folder for files that a query writes and reads again: below the shared one, where the session names it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or 'file://' + tempfile.gettempdir()}/sluice-files/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


CSV_RULE = """
version: 2
input: { format: csv, csv: { has_header: %s, delimiter: "%s"%s } }
mappings:
  - { target: id, source: c_custkey, type: int }
  - { target: name, source: c_name }
  - { target: balance, source: c_acctbal, type: float }
"""


def csv_query(header: bool, delimiter: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = exchanged(spark, "csv")
        names = ["c_custkey", "c_name", "c_acctbal"]
        table(spark, sf_dir, "customer").select(*names).write.option("header", header).option("sep", delimiter).csv(path)
        r = api.as_rule(CSV_RULE % (str(header).lower(), delimiter, "" if header else ", columns: [" + ", ".join(f"{{ name: {n} }}" for n in names) + "]"))
        return api.transform(readers.read_csv(spark, path, r), r)

    return run


for _name, _header, _sep in (("csv_header", True, ","), ("csv_no_header", False, ","), ("csv_delimiter", True, "|")):
    query(_name, "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")(csv_query(_header, _sep))


@query("json_records_path", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def json_records_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document, its records below a path; the typed reader makes them columns."""
    path = exchanged(spark, "json")
    row = F.struct("n_nationkey", "n_name")
    table(spark, sf_dir, "nation").groupBy().agg(F.collect_list(row).alias("items")).select(F.struct("items").alias("data")).coalesce(1).write.json(path)
    r = api.as_rule("version: 2\ninput: { format: json, json: { records_path: data.items } }\nmappings:\n  - { target: id, source: n_nationkey }\n  - { target: name, source: n_name }\n")
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())])
    return api.transform(readers.read_json_typed(spark, path, r, schema), r)


@query("ndjson_source", "SELECT p_partkey AS id, p_name || '!' AS name FROM part WHERE p_size >= 10")
def ndjson_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records one to a line, read in splits and taken as they are by the record evaluator."""
    path = exchanged(spark, "lines")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").write.json(path)
    r = api.as_rule("version: 2\ninput: { format: json, json: {} }\nrecord_when: { gte: ['@input.p_size', 10] }\nmappings:\n  - { target: id, source: p_partkey }\n  - { target: name, expr: ['@input.p_name', { concat: ['!'] }] }\n")
    out = api.transform_json(readers.read_records(spark, path, r, "ndjson"), r)
    return out.where("value is not null").select(F.from_json("value", "id bigint, name string").alias("r")).select("r.*")


@query("ndjson_sink", """SELECT '{"id":' || p_partkey || ',"name":"' || p_name || '"}' AS value FROM part""")
def ndjson_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written one to a line by the executors, and the lines read back."""
    path = exchanged(spark, "ndjson")
    r = rule("mappings:\n  - { target: id, source: p_partkey }\n  - { target: name, source: p_name }\n")
    sinks.write_ndjson(api.compiled(table(spark, sf_dir, "part"), r).json(), path)
    return spark.read.text(path)


@query("stream_events", "SELECT event_id AS id, event_type || '!' AS kind, value * 2 AS twice FROM events WHERE value > 20")
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule over a file stream, run until all files are read."""
    source, path = exchanged(spark, "events"), exchanged(spark, "stream")
    table(spark, sf_dir, "events").write.parquet(source)
    rows = stream.read_stream(spark, source, spark.read.parquet(source).schema)
    out = stream.transform_stream(rows, rule("""
record_when: { gt: ["@input.value", 20] }
mappings:
  - { target: id, source: event_id }
  - { target: kind, expr: ["@input.event_type", { concat: ["!"] }] }
  - { target: twice, expr: ["@input.value", { "*": [2] }] }
"""), mode="strict", warnings=False)
    stream.run_available(out, path, f"{path}-checkpoint").awaitTermination()
    return spark.read.parquet(path)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
