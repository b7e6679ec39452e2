"""Queries along one sorted key that holds all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scan as S
from ..sources.tables import table

HOUR_US = 3_600_000_000


def cooldown_hot(spark, d):
    """All events as one actor's: greedy cooldown of three hours."""
    e = table(spark, d, "events").select(F.lit(0).cast("long").alias("actor"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return S.cooldown(e, "actor", "event_id", 3 * HOUR_US)


def permuted_lineitem(spark, d):
    """Every line with its place in a seeded permutation."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return S.permuted(rows, "s11", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def union_ordered(spark, d):
    """Customers by balance, then suppliers by name, with places in the whole list."""
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    none = F.lit(None).cast("string")
    return S.ordered_union([(c, [none, -F.col("bal"), F.col("key")]), (s, [F.col("name"), F.lit(None).cast("double"), F.col("key")])])


def line_neighbours(spark, d):
    """Lines as one list by ship date: place, the part before (the first stays on itself) and after (the last wraps)."""
    rows = table(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = S.scanned(rows, [], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_partkey")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "place", F.coalesce("previous", "l_partkey").alias("previous"), F.coalesce("following", "first").alias("following"))


def customer_orders(spark, d):
    """Orders of each customer in a list that may span tasks: place, price before and after, no wrap."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return S.scanned(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").drop("o_orderdate")


QUERIES = {f.__name__: f for f in (cooldown_hot, permuted_lineitem, union_ordered, line_neighbours, customer_orders)}

_W = "OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_C = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
SQL = {
    "cooldown_hot": f"""WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) AS us FROM events),
f AS (SELECT event_id, us FROM (SELECT *, row_number() OVER (ORDER BY us, event_id) AS r FROM e) WHERE r = 1
 UNION ALL SELECT n.event_id, n.us FROM f, LATERAL (SELECT arg_min(event_id, (us, event_id)) AS event_id, min(us) AS us FROM e WHERE e.us - f.us >= {3 * HOUR_US}) n WHERE n.us IS NOT NULL)
SELECT 0::BIGINT AS actor, event_id, us FROM f""",
    "permuted_lineitem": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY md5('s11|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem""",
    "union_ordered": """SELECT kind, key, name, bal, row_number() OVER (ORDER BY kind, CASE WHEN kind = 'customer' THEN -bal END, CASE WHEN kind = 'supplier' THEN name END, key) - 1 AS ord
FROM (SELECT 'customer' AS kind, c_custkey AS key, c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier)""",
    "line_neighbours": f"""SELECT l_orderkey, l_linenumber, l_partkey, row_number() {_W} AS place, coalesce(lag(l_partkey) {_W}, l_partkey) AS previous, coalesce(lead(l_partkey) {_W}, first_value(l_partkey) {_W}) AS following FROM lineitem""",
    "customer_orders": f"""SELECT o_custkey, o_orderkey, o_totalprice, row_number() {_C} AS place, first_value(o_totalprice) {_C} AS first, lag(o_totalprice) {_C} AS previous, lead(o_totalprice) {_C} AS following FROM orders""",
}
