"""Queries for joins between grains and for reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.functions import cleaning as c
from grainwise.operators import contracts, joins, reshape
from grainwise.operators.ordering import first_per_key
from grainwise.plans.registry import query
from grainwise.sources import views
from grainwise.sources.tables import table


def r6(expr, name):
    return F.round(expr, 6).alias(name)


@query(
    "grain_safe_join",
    """SELECT event_id, e.station, station_name, site_type, s.region FROM v_measure e LEFT JOIN v_station s ON e.station = s.station""",
)
def grain_safe_join(spark, sf):
    stations = views.station(spark, sf).select("station", "station_name", "site_type", "region")
    return contracts.grain_safe_join(views.measure(spark, sf).select("event_id", "station"), stations, ["station"])


@query(
    "join_key_date",
    """SELECT e.event_id, CAST(d.n_orders AS DOUBLE) AS n_orders, round(d.spend, 2) AS spend FROM events e LEFT JOIN
       (SELECT o_custkey, CAST(o_orderdate AS DATE) + INTERVAL 9000 DAY AS day, count(*) AS n_orders, sum(o_totalprice) AS spend
        FROM orders GROUP BY 1, 2) d
       ON e.user_id = d.o_custkey AND CAST(e.ts AS DATE) = CAST(d.day AS DATE)""",
)
def join_key_date(spark, sf):
    daily = (
        table(spark, sf, "orders").select("o_custkey", F.date_add(F.to_date("o_orderdate"), 9000).alias("day"), "o_totalprice")
        .groupBy("o_custkey", "day").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spend"))
    )
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return joins.join_on_key_date(ev, daily, ("user_id", "ts"), ("o_custkey", "day")).select("event_id", F.col("n_orders").cast("double"), "spend")


@query(
    "join_drop_overlap",
    """SELECT s.station, s.region, s.balance, g.gauge_name FROM v_station s LEFT JOIN v_gauge g ON s.station = g.gauge""",
)
def join_drop_overlap(spark, sf):
    left = views.station(spark, sf).select("station", "region", "balance")
    right = views.gauge(spark, sf).select(F.col("gauge").alias("station"), "region", "gauge_name")
    return contracts.join_drop_overlap(left, right, ["station"])


def _commodity_panels(spark, sf):
    panel = views.panel(spark, sf).where("NOT (commodity = 'A' AND year = 1996) AND NOT (commodity = 'N' AND region = 3)")
    return [
        panel.where(F.col("commodity") == x).groupBy("region", "year").agg(F.sum("value").alias(f"kg_{x.lower()}"))
        for x in "ANR"
    ]


@query(
    "outer_merge",
    """SELECT region, year, sum(value) FILTER (WHERE commodity = 'A') AS kg_a,
         sum(value) FILTER (WHERE commodity = 'N') AS kg_n, sum(value) FILTER (WHERE commodity = 'R') AS kg_r
       FROM v_panel WHERE NOT (commodity = 'A' AND year = 1996) AND NOT (commodity = 'N' AND region = 3) GROUP BY 1, 2""",
)
def outer_merge(spark, sf):
    return joins.outer_merge(_commodity_panels(spark, sf), ["region", "year"])


@query(
    "grid_scaffold",
    """SELECT g.station, g.year, p.kg_a FROM
         (SELECT station, region, y.year FROM v_station, (SELECT unnest(range(1994, 2003)) AS year) y) g
       LEFT JOIN v_panel_year p ON g.region = p.region AND g.year = p.year""",
)
def grid_scaffold(spark, sf):
    grid = joins.grid_scaffold(views.station(spark, sf), ["station", "region"], "year", 1994, 2002)
    panel = views.panel_year(spark, sf).select("region", "year", "kg_a")
    return contracts.grain_safe_join(grid, panel, ["region", "year"], check=False).select("station", "year", "kg_a")


@query(
    "prefix_rollup_join",
    """SELECT station, substr(code12, 1, 8) AS code8, n_sites, round(mean_balance, 4) AS mean_balance FROM v_station JOIN
       (SELECT substr(code12, 1, 8) AS p, count(*) AS n_sites, avg(balance) AS mean_balance FROM v_station GROUP BY 1)
       ON substr(code12, 1, 8) = p""",
)
def prefix_rollup_join(spark, sf):
    st = views.station(spark, sf).select("station", "code12", "balance")
    parents = st.groupBy(F.substring("code12", 1, 8).alias("code8")).agg(
        F.count("*").alias("n_sites"), F.round(F.avg("balance"), 4).alias("mean_balance")
    )
    return joins.rollup_broadcast_join(st, parents, "code12", "code8", 8).select("station", "code8", "n_sites", "mean_balance")


@query(
    "join_year_only",
    """SELECT o_orderkey, year(o_orderdate) AS year, t.qty FROM orders LEFT JOIN
       (SELECT year, sum(value) AS qty FROM v_panel WHERE year < 2001 GROUP BY 1) t ON year(o_orderdate) = t.year""",
)
def join_year_only(spark, sf):
    by_year = views.panel(spark, sf).where("year < 2001").groupBy("year").agg(F.sum("value").alias("qty"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return joins.join_year_only(orders, by_year, "o_orderdate").select("o_orderkey", "year", "qty")


@query(
    "asof_backward",
    """WITH base AS (SELECT region, year AS base_t, kg_a AS kg FROM v_panel_year WHERE year IN (1995, 1997, 2000)),
       grid AS (SELECT DISTINCT region, y.year, least(y.year, 1999) AS at FROM v_panel, (SELECT unnest(range(1994, 2003)) AS year) y)
       SELECT g.region, g.year, CAST(b.base_t AS DOUBLE) AS base_t, b.kg, CAST(g.year - b.base_t AS DOUBLE) AS staleness FROM grid g ASOF LEFT JOIN base b
       ON g.region = b.region AND g.at >= b.base_t""",
)
def asof_backward(spark, sf):
    base = views.panel_year(spark, sf).where(F.col("year").isin(views.BASE_YEARS)).select("region", "year", F.col("kg_a").alias("kg"))
    grid = joins.grid_scaffold(views.panel(spark, sf), ["region"], "year", 1994, 2002)
    out = joins.asof_backward(grid, base, ["region"], "year", ["kg"], cap=1999)
    return out.select("region", "year", F.col("base_t").cast("double").alias("base_t"), "kg", F.col("staleness").cast("double").alias("staleness"))


@query(
    "asof_events",
    """SELECT e.event_id, CAST(o.event_id AS DOUBLE) AS last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') e
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') o ON e.user_id = o.user_id AND e.ts >= o.ts""",
)
def asof_events(spark, sf):
    """Fact-sized as-of: every event with its user's latest purchase so far."""
    ev = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type")
    left = ev.where("event_type <> 'purchase'").select("event_id", "user_id", "t")
    right = ev.where("event_type = 'purchase'").select("user_id", "t", F.col("event_id").alias("last_purchase"))
    day = F.floor(F.col("_at") / F.lit(86400000000))
    return joins.asof_backward(left, right, ["user_id"], "t", ["last_purchase"], chunk=day).select("event_id", F.col("last_purchase").cast("double"))


@query(
    "ratio_refresh",
    """WITH base AS (SELECT region, year AS base_t, kg_a AS kg FROM v_panel_year WHERE year IN (1995, 1997, 2000)),
       head AS (SELECT region, year, kg_n AS head FROM v_panel_year WHERE NOT (region = 4 AND year = 1997)),
       grid AS (SELECT DISTINCT region, y.year FROM v_panel, (SELECT unnest(range(1995, 2002)) AS year) y),
       carried AS (SELECT g.region, g.year, b.base_t, b.kg FROM grid g ASOF LEFT JOIN base b ON g.region = b.region AND g.year >= b.base_t),
       r AS (SELECT c.*, n.head / t.head AS q FROM carried c LEFT JOIN head n ON c.region = n.region AND c.year = n.year
             LEFT JOIN head t ON c.region = t.region AND c.base_t = t.year)
       SELECT region, year, CAST(base_t AS DOUBLE) AS base_t, coalesce(q IS NOT NULL AND base_t <> year, false) AS refreshed,
         round(CASE WHEN q IS NOT NULL AND base_t <> year THEN q ELSE 1.0 END, 6) AS ratio,
         round(kg * CASE WHEN q IS NOT NULL AND base_t <> year THEN q ELSE 1.0 END, 4) AS kg_refreshed FROM r""",
)
def ratio_refresh(spark, sf):
    py = views.panel_year(spark, sf)
    base = py.where(F.col("year").isin(views.BASE_YEARS)).select("region", "year", F.col("kg_a").alias("kg"))
    head = py.where("NOT (region = 4 AND year = 1997)").select("region", "year", F.col("kg_n").alias("head"))
    grid = joins.grid_scaffold(views.panel(spark, sf), ["region"], "year", 1995, 2001)
    carried = joins.asof_backward(grid, base, ["region"], "year", ["kg"])
    out = joins.ratio_refresh(carried, head, ["region"], "year", "base_t", "kg", "head")
    return out.select(
        "region", "year", F.col("base_t").cast("double").alias("base_t"), F.coalesce("refreshed", F.lit(False)).alias("refreshed"),
        r6(F.col("ratio"), "ratio"), F.round("kg_refreshed", 4).alias("kg_refreshed"),
    )


@query(
    "crosswalk_reconcile",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE a IS NOT DISTINCT FROM b) AS n_match, count(*) FILTER (WHERE a IS DISTINCT FROM b) AS n_mismatch,
         count(*) FILTER (WHERE a IS NULL) AS n_underived FROM
       (SELECT s.region AS b, g.region AS a FROM v_station s LEFT JOIN v_gauge g ON s.station = g.gauge)""",
)
def crosswalk_reconcile(spark, sf):
    left = views.station(spark, sf).select("station", F.col("region").alias("recorded"))
    right = views.gauge(spark, sf).select(F.col("gauge").alias("station"), F.col("region").alias("derived"))
    return contracts.reconcile(contracts.grain_safe_join(left, right, ["station"]), "derived", "recorded")


@query(
    "pairs_within_group",
    """SELECT a.station, count(DISTINCT a.event_id) + 1 AS n_visits, count(*) AS n_pairs, round(sum(a.value * b.value), 4) AS sum_product,
         round(sum(a.value + b.value), 4) AS sum_both, CAST(sum((a.h - b.h) * (a.h - b.h)) AS BIGINT) AS sum_sq_gap
       FROM (SELECT user_id AS station, event_id, value, floor(epoch(ts) / 3600) - 473000 AS h FROM events) a
       JOIN (SELECT user_id AS station, event_id, value, floor(epoch(ts) / 3600) - 473000 AS h FROM events) b
       ON a.station = b.station AND a.event_id < b.event_id GROUP BY 1""",
)
def pairs_within_group(spark, sf):
    """All visit pairs of a station, as exact totals; the oracle forms every pair."""
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("station"), "value",
        (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) - 473000).alias("h"),
    )
    out = joins.pair_totals_by_group(ev, ["station"], "h", "value")
    return out.select(
        "station", "n_visits", "n_pairs", F.round("sum_product", 4).alias("sum_product"), F.round("sum_both", 4).alias("sum_both"),
        F.round("sum_sq_gap").cast("long").alias("sum_sq_gap"),
    )


@query(
    "pairs_same_day",
    """WITH d AS (SELECT user_id AS station, event_type AS parameter, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, max(value) AS v FROM events GROUP BY 1, 2, 3)
       SELECT a.parameter, a.day, count(*) AS n_pairs, round(sum(a.v * b.v), 4) AS sum_product, round(sum(a.v + b.v), 4) AS sum_both
       FROM d a JOIN d b ON a.parameter = b.parameter AND a.day = b.day AND a.station < b.station GROUP BY 1, 2""",
)
def pairs_same_day(spark, sf):
    """All station pairs measured on the same day, as exact totals per parameter and day."""
    daily = (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("station"), F.col("event_type").alias("parameter"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
        .agg(F.max("value").alias("v")).withColumn("zero", F.lit(0))
    )
    out = joins.pair_totals_by_group(daily, ["parameter", "day"], "zero", "v")
    return out.select("parameter", "day", "n_pairs", F.round("sum_product", 4).alias("sum_product"), F.round("sum_both", 4).alias("sum_both"))


@query(
    "replicate_median",
    "SELECT station, parameter, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, round(median(val), 6) AS val FROM v_measure WHERE val IS NOT NULL GROUP BY 1, 2, 3",
)
def replicate_median(spark, sf):
    m = views.measure(spark, sf).select("station", "parameter", F.date_format("ts", "yyyy-MM-dd").alias("day"), "val")
    return reshape.replicate_median(m, ["station", "parameter", "day"], "val").withColumn("val", F.round("val", 6))


@query(
    "collapse_mean",
    """SELECT l_orderkey, l_linenumber, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice
       FROM lineitem GROUP BY 1, 2""",
)
def collapse_mean(spark, sf):
    out = reshape.collapse_mean(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])
    return out.withColumns({k: F.round(k, 6) for k in ("l_quantity", "l_extendedprice")})


@query(
    "collapse_max_first",
    """SELECT zone, year, max(value) AS value, min(label) AS label FROM (SELECT DISTINCT CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS zone,
         year(l_shipdate) AS year, l_quantity AS value, l_returnflag AS label FROM lineitem) GROUP BY 1, 2""",
)
def collapse_max_first(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS zone", "CAST(year(l_shipdate) AS BIGINT) AS year",
        "l_quantity AS value", "l_returnflag AS label",
    )
    return reshape.collapse_max_first(df, ["zone", "year"], "value", "label")


@query(
    "compliance_rollup",
    """SELECT permit, fiscal_year, count(*) AS n_reports, count(DISTINCT outfall) AS n_outfalls, count(DISTINCT parameter) AS n_parameters,
         count(*) FILTER (WHERE violation = 'R') AS n_violations, count(exceed_pct) AS n_exceed, round(avg(exceed_pct), 6) AS mean_exceed,
         max(exceed_pct) AS max_exceed, count(*) FILTER (WHERE days_late > 0) AS n_late, round(avg(days_late), 6) AS mean_late, max(days_late) AS max_late
       FROM v_reports GROUP BY 1, 2""",
)
def compliance_rollup(spark, sf):
    df = views.discharge_reports(spark, sf)
    return df.groupBy("permit", "fiscal_year").agg(
        F.count("*").alias("n_reports"), F.count_distinct("outfall").alias("n_outfalls"), F.count_distinct("parameter").alias("n_parameters"),
        F.count_if(F.col("violation") == "R").alias("n_violations"), F.count("exceed_pct").alias("n_exceed"),
        r6(F.avg("exceed_pct"), "mean_exceed"), F.max("exceed_pct").alias("max_exceed"), F.count_if(F.col("days_late") > 0).alias("n_late"),
        r6(F.avg("days_late"), "mean_late"), F.max("days_late").alias("max_late"),
    )


@query(
    "regional_rollup",
    """WITH p AS (SELECT permit, fiscal_year, count(*) AS n, count(exceed_pct) AS n_exceed, avg(exceed_pct) AS mean_exceed FROM v_reports GROUP BY 1, 2)
       SELECT g.region, p.fiscal_year, count(DISTINCT p.permit) AS n_permits, CAST(sum(n) AS BIGINT) AS n_reports, CAST(sum(n_exceed) AS BIGINT) AS n_exceed,
         max(CASE WHEN n_exceed > 40 THEN 1 ELSE 0 END) AS any_heavy, round(avg(mean_exceed), 6) AS mean_of_means
       FROM p JOIN v_gauge g ON p.permit = g.gauge WHERE g.region <> 5 GROUP BY 1, 2""",
)
def regional_rollup(spark, sf):
    """Pre-aggregate to (permit, year), attach the region, drop permits without one, roll up."""
    per = views.discharge_reports(spark, sf).groupBy("permit", "fiscal_year").agg(
        F.count("*").alias("n"), F.count("exceed_pct").alias("n_exceed"), F.avg("exceed_pct").alias("mean_exceed")
    )
    region = views.gauge(spark, sf).select(F.col("gauge").alias("permit"), F.expr("CASE WHEN region <> 5 THEN region END").alias("region"))
    return (
        contracts.grain_safe_join(per, region, ["permit"]).dropna(subset=["region"]).groupBy("region", "fiscal_year").agg(
            F.count_distinct("permit").alias("n_permits"), F.sum("n").alias("n_reports"), F.sum("n_exceed").alias("n_exceed"),
            F.max((F.col("n_exceed") > 40).cast("int")).alias("any_heavy"), r6(F.avg("mean_exceed"), "mean_of_means"),
        )
    )


@query(
    "status_rollup",
    """SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_units, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_impaired,
         bool_or(o_orderstatus = 'F') AS any_impaired FROM orders GROUP BY 1""",
)
def status_rollup(spark, sf):
    bad = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count_distinct("o_orderpriority").alias("n_units"), F.count_if(bad).alias("n_impaired"), F.bool_or(bad).alias("any_impaired")
    )


_WIDE = ", ".join(
    f"max(value) FILTER (WHERE commodity = '{a}' AND statistic = '{b}') AS crop__{a.lower()}__{b.lower()}_kg" for a in "ANR" for b in "FO"
)


@query("pivot_wide", f"SELECT region, year, {_WIDE} FROM v_panel WHERE NOT (commodity = 'N' AND region = 3) GROUP BY 1, 2")
def pivot_wide(spark, sf):
    panel = views.panel(spark, sf).where("NOT (commodity = 'N' AND region = 3)")
    return reshape.pivot_wide(panel, ["region", "year"], {"commodity": list("ANR"), "statistic": list("FO")}, "value", "crop", "_kg")


WIDE_UNITS = {"click": "mg/L", "error": "ug/L", "purchase": "deg C", "signup": "g/m2", "view": "NTU"}
_WIDE_SQL = ", ".join(
    f"round(max(v) FILTER (WHERE parameter = '{p}'), 6) AS {p}_value, CASE WHEN max(v) FILTER (WHERE parameter = '{p}') IS NOT NULL THEN '{u}' END AS {p}_unit"
    for p, u in WIDE_UNITS.items()
)


@query(
    "pivot_with_units",
    f"""SELECT station, day, {_WIDE_SQL} FROM (SELECT station, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, parameter, median(val) AS v
        FROM v_measure WHERE val IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def pivot_with_units(spark, sf):
    m = views.measure(spark, sf).select("station", "parameter", F.date_format("ts", "yyyy-MM-dd").alias("day"), "val")
    med = reshape.replicate_median(m, ["station", "day", "parameter"], "val")
    wide = reshape.pivot_with_units(med, ["station", "day"], "parameter", "val", WIDE_UNITS)
    return wide.withColumns({f"{p}_value": F.round(f"{p}_value", 6) for p in WIDE_UNITS})


def _census_wide(spark, sf):
    """Region table with yearly columns such as farmfertN-kg-1995 / farmfertP-kg-1995."""
    py = views.panel_year(spark, sf)
    cells = []
    for y in views.PANEL_YEARS:
        cells += [F.sum(F.when(F.col("year") == y, F.col("kg_n"))).alias(f"farmfertN-kg-{y}"), F.sum(F.when(F.col("year") == y, F.col("kg_r"))).alias(f"farmfertP-kg-{y}")]
    return py.groupBy("region").agg(*cells)


@query(
    "unpivot_regex_header",
    """SELECT region, 'N' AS nutrient, year, CAST(kg_n AS BIGINT) AS kg FROM v_panel_year UNION ALL
       SELECT region, 'P', year, CAST(kg_r AS BIGINT) FROM v_panel_year""",
)
def unpivot_regex_header(spark, sf):
    long = reshape.unpivot_regex(_census_wide(spark, sf), ["region"], r"farmfert([NP])-kg-(\d{4})$", {"nutrient": "string", "year": "long"}, "kg")
    return long.withColumn("kg", F.col("kg").cast("long"))


@query(
    "null_aware_total",
    """SELECT station, count(*) AS n, count(t) AS n_total, round(sum(t), 4) AS total FROM (SELECT station,
         CASE WHEN coalesce(nitrate, nitrite, kjeldahl) IS NOT NULL THEN coalesce(nitrate, 0) + coalesce(nitrite, 0) + coalesce(kjeldahl, 0) END AS t
       FROM v_chemistry) GROUP BY 1""",
)
def null_aware_total(spark, sf):
    total = reshape.null_aware_total(["nitrate", "nitrite", "kjeldahl"])
    return views.chemistry(spark, sf).select("station", total.alias("t")).groupBy("station").agg(
        F.count("*").alias("n"), F.count("t").alias("n_total"), F.round(F.sum("t"), 4).alias("total")
    )


@query(
    "add_total_rows",
    """WITH p AS (SELECT region, year, commodity, CAST(sum(value) AS BIGINT) AS value FROM v_panel GROUP BY 1, 2, 3)
       SELECT * FROM p UNION ALL SELECT region, year, 'Total', CAST(sum(value) AS BIGINT) FROM p GROUP BY 1, 2""",
)
def add_total_rows(spark, sf):
    p = views.panel(spark, sf).groupBy("region", "year", "commodity").agg(F.sum("value").cast("long").alias("value"))
    return reshape.add_total_rows(p, ["region", "year"], "commodity", "value")


@query(
    "stack_pairs",
    """SELECT region, year, 'nitrogen' AS nutrient, CAST(kg_a AS BIGINT) AS kg, CAST(kg_n AS BIGINT) AS weight FROM v_panel_year
       UNION ALL SELECT region, year, 'phosphorus', CAST(kg_r AS BIGINT), CAST(kg_a AS BIGINT) FROM v_panel_year""",
)
def stack_pairs(spark, sf):
    py = views.panel_year(spark, sf).select("region", "year", *[F.col(x).cast("long").alias(x) for x in ("kg_a", "kg_n", "kg_r")])
    return reshape.stack_pairs(py, ["region", "year"], {"nitrogen": ("kg_a", "kg_n"), "phosphorus": ("kg_r", "kg_a")}, "nutrient", ("kg", "weight"))
