"""Queries for window-like, order-dependent operators, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.functions.numeric import key_hash_sql, normal_quantile_sql
from grainwise.operators import ordering as o
from grainwise.operators import setops
from grainwise.plans.registry import query
from grainwise.sources import views
from grainwise.sources.tables import table

hash_sql = key_hash_sql


@query(
    "previous_visit",
    """SELECT event_id, lag(value) OVER w AS prev_value, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400000000) AS DOUBLE) AS gap_days
       FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""",
)
def previous_visit(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return o.previous_visit(ev, ["user_id", "event_type"], "ts", "event_id", "value").select("event_id", "prev_value", F.col("gap_days").cast("double"))


@query(
    "gap_stats",
    """SELECT event_type, count(*) AS n, median(gap) AS median_gap, quantile_cont(gap, 0.9) AS p90_gap FROM (
       SELECT event_type, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id))) / 86400000000) AS DOUBLE) AS gap
       FROM events) WHERE gap IS NOT NULL GROUP BY 1""",
)
def gap_stats(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", "value")
    gaps = o.previous_visit(ev, ["user_id", "event_type"], "ts", "event_id", "value")
    return o.exact_quantiles(gaps, "gap_days", {"median_gap": 0.5, "p90_gap": 0.9}, ["event_type"])


@query(
    "first_per_key",
    """SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
         ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def first_per_key(spark, sf):
    newest = -F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    return o.first_per_key(table(spark, sf, "orders"), ["o_custkey"], [urgent, newest, F.col("o_orderkey")], ["o_orderkey", "o_orderpriority"])


_LAST = ["click_value", "error_value", "purchase_value", "signup_value", "view_value"]
_GAPPY = ", ".join(f"CASE WHEN event_type = '{p}' AND event_id % 7 <> 0 THEN value END AS {p}_value" for p in views.PARAMETERS)


@query(
    "last_non_null",
    "SELECT user_id, " + ", ".join(f"arg_max({x}, (ts, event_id)) FILTER (WHERE {x} IS NOT NULL) AS {x}" for x in _LAST)
    + f" FROM (SELECT user_id, ts, event_id, {_GAPPY} FROM events) GROUP BY 1",
)
def last_non_null(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", *[F.expr(x) for x in _GAPPY.split(", ")])
    return o.last_non_null(ev, ["user_id"], ["ts", "event_id"], _LAST)


@query(
    "rank_average",
    """SELECT l_orderkey, l_linenumber, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
         + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS avg_rank,
         round((rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE)
           / count(*) OVER (PARTITION BY l_returnflag), 6) AS rank_pct FROM lineitem""",
)
def rank_average(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    out = o.rank_average(li, "l_quantity", ["l_returnflag"])
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "avg_rank", F.round("avg_rank_pct", 6).alias("rank_pct"))


@query(
    "normal_scores",
    "SELECT event_id, round(" + normal_quantile_sql("p") + """, 6) AS z FROM (SELECT event_id, ((rank() OVER (PARTITION BY event_type ORDER BY value)
         + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE) - 0.5) / count(*) OVER (PARTITION BY event_type) AS p FROM events)""",
)
def normal_scores(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    return o.normal_scores(ev, "value", ["event_type"]).select("event_id", F.round("z", 6).alias("z"))


@query(
    "top_k_per_group",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
         ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 4""",
)
def top_k_per_group(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return o.top_k_per_group(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 4)


@query(
    "group_split",
    f"""SELECT o_orderkey, o_custkey, g.rn <= ceil(g.n * 0.2) AS is_test FROM orders JOIN (SELECT k, row_number() OVER (ORDER BY {hash_sql('k', 42)}) AS rn,
         count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey AS k FROM orders)) g ON o_custkey = g.k""",
)
def group_split(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return o.group_split(orders, "o_custkey", 0.2, seed=42)


@query(
    "group_kfold",
    f"""SELECT o_orderkey, (g.rn - 1) % 5 AS fold FROM orders JOIN (SELECT k, row_number() OVER (ORDER BY {hash_sql('k', 7)}) AS rn
         FROM (SELECT DISTINCT o_custkey AS k FROM orders)) g ON o_custkey = g.k""",
)
def group_kfold(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return o.group_kfold(orders, "o_custkey", 5, seed=7).select("o_orderkey", "fold")


@query(
    "group_kfold_balanced",
    f"""SELECT o_orderkey, CASE WHEN ((g.rn - 1) // 5) % 2 = 0 THEN (g.rn - 1) % 5 ELSE 4 - (g.rn - 1) % 5 END AS fold FROM orders JOIN
         (SELECT k, row_number() OVER (ORDER BY c DESC, {hash_sql('k', 7)}) AS rn FROM (SELECT o_custkey AS k, count(*) AS c FROM orders GROUP BY 1)) g
       ON o_custkey = g.k""",
)
def group_kfold_balanced(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return o.group_kfold(orders, "o_custkey", 5, seed=7, balanced=True).select("o_orderkey", "fold")


@query(
    "cap_sample",
    f"""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY {hash_sql('event_id', 11)}, event_id) AS rn
         FROM events) WHERE rn <= 20""",
)
def cap_sample(spark, sf):
    return o.cap_sample(table(spark, sf, "events").select("user_id", "event_id"), 20, ["user_id"], "event_id", seed=11)


@query(
    "bh_fdr",
    """WITH t AS (SELECT l_partkey, (count(*) FILTER (WHERE l_returnflag = 'R') + 1.0::DOUBLE) / (count(*) + 1) AS p FROM lineitem GROUP BY 1),
       r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, l_partkey) AS raw FROM t)
       SELECT l_partkey, round(p, 6) AS p, round(least(min(raw) OVER (ORDER BY p, l_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) AS q FROM r""",
)
def bh_fdr(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        ((F.count_if(F.col("l_returnflag") == "R") + 1.0) / (F.count("*") + 1)).alias("p")
    )
    out = o.bh_fdr(t, "p", "q")
    return out.select("l_partkey", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query("sort_topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def sort_topn(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


PRIORITY_ORDER = ["3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH", "4-NOT SPECIFIED"]


@query(
    "sort_custom_order",
    """SELECT o_orderpriority, count(*) AS n, CAST(list_position(['3-MEDIUM','1-URGENT','5-LOW','2-HIGH','4-NOT SPECIFIED'], o_orderpriority) AS BIGINT) AS position
       FROM orders GROUP BY 1 ORDER BY 3""",
)
def sort_custom_order(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return setops.sort_custom_order(counts, "o_orderpriority", PRIORITY_ORDER)


@query(
    "union_dedupe_priority",
    """WITH u AS (SELECT o_custkey, o_orderdate, o_totalprice, 'new' AS vintage FROM orders WHERE o_orderstatus <> 'F' UNION ALL
         SELECT o_custkey, o_orderdate, o_totalprice, 'old' FROM orders WHERE o_orderstatus <> 'O')
       SELECT o_custkey, max_price, vintage FROM (SELECT o_custkey, vintage, max(o_totalprice) AS max_price,
         row_number() OVER (PARTITION BY o_custkey ORDER BY CASE vintage WHEN 'new' THEN 0 ELSE 1 END) AS rn FROM u GROUP BY 1, 2) WHERE rn = 1""",
)
def union_dedupe_priority(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderstatus")
    vint = lambda bad: orders.where(F.col("o_orderstatus") != bad).groupBy("o_custkey").agg(F.max("o_totalprice").alias("max_price"))
    stacked = setops.union_tagged({"new": vint("F"), "old": vint("O")}, "vintage")
    return setops.dedupe_priority(stacked, ["o_custkey"], "vintage", ["new", "old"])


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount, l_tax FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_discount", "l_tax").distinct()


@query(
    "set_ops",
    """SELECT 'left only' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL
       SELECT 'right only', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) UNION ALL
       SELECT 'both', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)""",
)
def set_ops(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return setops.key_overlap(a, b)
