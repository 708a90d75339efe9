"""Queries for projection, predicates and cleaning contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.functions import cleaning as c
from grainwise.functions import text
from grainwise.operators import cleaning as ops
from grainwise.operators import contracts
from grainwise.plans.registry import query
from grainwise.sources import scans, views
from grainwise.sources.tables import table


def r6(expr, name):
    return F.round(expr, 6).alias(name)


@query("select_rename", "SELECT c_name AS station_name, c_custkey AS station, c_acctbal AS balance FROM customer")
def select_rename(spark, sf):
    return scans.select_rename(
        table(spark, sf, "customer"),
        {"c_name": "station_name", "c_custkey": "station", "absent": "absent", "c_acctbal": "balance"},
        optional=["absent"],
    )


AUDIT_STEPS = [
    ("numeric value", "try_cast(trim(raw) AS double) IS NOT NULL"),
    ("known unit", "unit <> ''"),
    ("not null after gaps", "val IS NOT NULL"),
    ("in range", "val BETWEEN 1 AND 300"),
]


@query(
    "filter_audit",
    """SELECT CAST(step AS BIGINT) AS step, label, rows_in, rows_out, rows_in - rows_out AS rows_dropped FROM (
       SELECT 1 AS step, 'numeric value' AS label, count(*) AS rows_in, count(*) FILTER (WHERE a) AS rows_out FROM t
       UNION ALL SELECT 2, 'known unit', count(*) FILTER (WHERE a), count(*) FILTER (WHERE a AND b) FROM t
       UNION ALL SELECT 3, 'not null after gaps', count(*) FILTER (WHERE a AND b), count(*) FILTER (WHERE a AND b AND c) FROM t
       UNION ALL SELECT 4, 'in range', count(*) FILTER (WHERE a AND b AND c), count(*) FILTER (WHERE a AND b AND c AND d) FROM t)
    """.replace(
        "FROM t", "FROM (SELECT TRY_CAST(trim(raw) AS DOUBLE) IS NOT NULL AS a, unit <> '' AS b, val IS NOT NULL AS c, "
        "coalesce(val BETWEEN 1 AND 300, false) AS d FROM v_measure)"
    ),
)
def filter_audit(spark, sf):
    _, audit = contracts.filter_audit(views.measure(spark, sf), [(n, F.expr(e)) for n, e in AUDIT_STEPS])
    return audit


@query(
    "filter_predicates",
    """SELECT event_id, parameter FROM v_measure WHERE parameter IN ('click', 'view') AND coalesce(starts_with(unit, 'm'), false)
       AND val IS NOT NULL""",
)
def filter_predicates(spark, sf):
    return (
        views.measure(spark, sf)
        .where(F.col("parameter").isin("click", "view") & F.coalesce(F.col("unit").startswith("m"), F.lit(False)) & F.col("val").isNotNull())
        .select("event_id", "parameter")
    )


@query("coerce_numeric", "SELECT event_id, TRY_CAST(trim(raw) AS DOUBLE) AS number FROM v_measure")
def coerce_numeric(spark, sf):
    return views.measure(spark, sf).select("event_id", c.to_number("raw").alias("number"))


COMMA_TEXT = "CASE WHEN event_id % 17 = 0 THEN '(D)' WHEN event_id % 19 = 0 THEN ' (NA) ' ELSE concat(CAST(event_id % 9 + 1 AS STRING), ',', lpad(CAST(event_id % 1000 AS STRING), 3, '0')) END"


@query(
    "parse_suppressed",
    """SELECT event_id, TRY_CAST(replace(cell, ',', '') AS DOUBLE) AS value,
         trim(cell) IN ('(D)','(Z)','(X)','(NA)','(H)','(L)','(S)') AS suppressed FROM
       (SELECT event_id, """ + COMMA_TEXT.replace("STRING", "VARCHAR") + " AS cell FROM events)",
)
def parse_suppressed(spark, sf):
    value, flag = c.parse_suppressed(F.expr(COMMA_TEXT))
    return table(spark, sf, "events").select("event_id", value.alias("value"), flag.alias("suppressed"))


@query(
    "nondetect_report",
    """SELECT parameter, count(*) AS n, count(*) FILTER (WHERE TRY_CAST(trim(raw) AS DOUBLE) IS NULL) AS n_text,
         count(*) FILTER (WHERE TRY_CAST(trim(raw) AS DOUBLE) IS NULL AND raw = '(D)') AS n_text_flagged
       FROM v_measure GROUP BY 1""",
)
def nondetect_report(spark, sf):
    return ops.nondetect_report(views.measure(spark, sf), "raw", F.col("raw") == "(D)", ["parameter"])


# (parameter, unit) -> factor to the parameter's standard unit; anything else is incompatible.
UNIT_FACTORS = {(p, u): f for p in views.PARAMETERS for u, f in (("mg/L", 1.0), ("ug/L", 0.001), ("g/m2", 0.5))}


@query(
    "standardize_units",
    """SELECT event_id, parameter, round(val * CASE unit WHEN 'mg/L' THEN 1.0 WHEN 'ug/L' THEN 0.001 ELSE 0.5 END, 6) AS std_value
       FROM v_measure WHERE unit IN ('mg/L', 'ug/L', 'g/m2')""",
)
def standardize_units(spark, sf):
    df = ops.standardize_units(views.measure(spark, sf), UNIT_FACTORS, value="val")
    return df.select("event_id", "parameter", r6(F.col("val"), "std_value"))


@query(
    "affine_convert",
    """SELECT event_id, round(CASE WHEN unit = 'deg F' THEN (value - 32) * 5 / 9 ELSE value END, 6) AS value_c
       FROM (SELECT event_id, unit, val AS value FROM v_measure)""",
)
def affine_convert(spark, sf):
    return views.measure(spark, sf).select(
        "event_id", r6(c.fahrenheit_to_celsius("val", where=F.col("unit") == "deg F"), "value_c")
    )


BOUNDS = {"click": (1.0, 150.0), "error": (0.5, 200.0), "purchase": (2.0, 90.0), "signup": (None, 120.0), "view": (5.0, None)}


@query(
    "range_drop",
    """SELECT parameter, count(*) AS n_kept, round(sum(val), 4) AS total FROM v_measure WHERE
         (parameter = 'click' AND val BETWEEN 1 AND 150) OR (parameter = 'error' AND val BETWEEN 0.5 AND 200) OR
         (parameter = 'purchase' AND val BETWEEN 2 AND 90) OR (parameter = 'signup' AND val <= 120) OR (parameter = 'view' AND val >= 5)
       GROUP BY 1""",
)
def range_drop(spark, sf):
    kept = ops.range_drop(views.measure(spark, sf), BOUNDS, "parameter", "val")
    return kept.groupBy("parameter").agg(F.count("*").alias("n_kept"), F.round(F.sum("val"), 4).alias("total"))


@query(
    "range_null",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS qty,
         CASE WHEN l_discount BETWEEN 0.01 AND 0.09 THEN l_discount END AS disc FROM lineitem""",
)
def range_null(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"))
    return ops.range_null(df, {"qty": (5, 45), "disc": (0.01, 0.09)})


@query(
    "consistency_null",
    """SELECT l_orderkey, l_linenumber, CASE WHEN NOT l_tax > l_discount THEN l_tax END AS lo,
         CASE WHEN NOT l_tax > l_discount THEN l_discount END AS hi FROM lineitem""",
)
def consistency_null(spark, sf):
    lo, hi = c.consistent_pair("l_tax", "l_discount")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", lo.alias("lo"), hi.alias("hi"))


@query(
    "sentinel_null",
    """SELECT event_id, CASE WHEN event_id % 13 = 0 OR event_id % 29 = 0 THEN NULL ELSE value END AS flow FROM events""",
)
def sentinel_null(spark, sf):
    coded = F.expr("CASE WHEN event_id % 13 = 0 THEN -999999D WHEN event_id % 29 = 0 THEN -9999D ELSE value END")
    return table(spark, sf, "events").select("event_id", c.null_sentinels(coded, [-999999.0, -9999.0]).alias("flow"))


@query(
    "clamp_floor",
    """SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0.0::DOUBLE END AS discharge, -abs(s_acctbal) AS lon FROM supplier""",
)
def clamp_floor(spark, sf):
    return table(spark, sf, "supplier").select(
        "s_suppkey", c.floor_at_zero("s_acctbal").alias("discharge"), c.west_longitude("s_acctbal").alias("lon")
    )


SMALL_BOX = {"lat": (41.0, 43.0), "lon": (-96.0, -91.0)}


@query(
    "bbox_null",
    """SELECT station, CASE WHEN lat BETWEEN 41 AND 43 AND lon BETWEEN -96 AND -91 THEN lat END AS lat,
         CASE WHEN lat BETWEEN 41 AND 43 AND lon BETWEEN -96 AND -91 THEN lon END AS lon FROM v_station""",
)
def bbox_null(spark, sf):
    return ops.bbox_null(views.station(spark, sf), "lat", "lon", SMALL_BOX).select("station", "lat", "lon")


@query(
    "censor_substitute",
    """SELECT l_linenumber, count(*) AS n, count(*) FILTER (WHERE l_discount = 0) AS n_disc_censored,
         count(*) FILTER (WHERE l_tax = 0) AS n_tax_censored,
         round(sum(CASE WHEN l_discount = 0 THEN 0.0005 ELSE l_discount END), 6) AS disc_total,
         round(sum(CASE WHEN l_tax = 0 THEN 0.0005 ELSE l_tax END), 6) AS tax_total FROM lineitem GROUP BY 1""",
)
def censor_substitute(spark, sf):
    df = table(spark, sf, "lineitem").select("l_linenumber", F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"))
    out = ops.censor_substitute(df, ["disc", "tax"], lod=0.001)
    return out.groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.count_if("disc_censored").alias("n_disc_censored"), F.count_if("tax_censored").alias("n_tax_censored"),
        r6(F.sum("disc"), "disc_total"), r6(F.sum("tax"), "tax_total"),
    )


@query(
    "blank_to_null",
    """SELECT event_id, nullif(trim(unit), '') AS unit, nullif(trim(CASE WHEN event_id % 3 = 0 THEN '  ' ELSE ' ' || event_type || ' ' END), '') AS label FROM
       (SELECT m.event_id, m.unit, e.event_type FROM v_measure m JOIN events e ON m.event_id = e.event_id)""",
)
def blank_to_null(spark, sf):
    df = views.measure(spark, sf).select(
        "event_id", "unit", F.expr("CASE WHEN event_id % 3 = 0 THEN '  ' ELSE concat(' ', parameter, ' ') END").alias("label")
    )
    return c.strip_all(df)


def _gappy_sql(col):
    return f"""SELECT '{col}' AS column_name, count(*) AS n_rows, count({col}) AS n_present,
      round(1 - count({col}) / count(*), 6) AS null_share, count({col}) = 0 AS all_null, count(DISTINCT {col}) = 1 AS constant FROM v_chemistry"""


SPARSE_COLUMNS = ["station", "dissolved_oxygen", "nitrite", "microcystin", "phosphate", "ph"]


@query("drop_sparse_profile", " UNION ALL ".join(_gappy_sql(x) for x in SPARSE_COLUMNS))
def drop_sparse_profile(spark, sf):
    out = contracts.sparse_columns(views.chemistry(spark, sf), SPARSE_COLUMNS)
    return out.withColumn("null_share", F.round("null_share", 6))


@query(
    "round_cast",
    """SELECT o_orderkey, round(o_totalprice / 7, 3) AS ksat, CAST(trunc(o_totalprice / 100) AS INTEGER) AS pct FROM orders""",
)
def round_cast(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.round(F.col("o_totalprice") / 7, 3).alias("ksat"), (F.col("o_totalprice") / 100).cast("int").alias("pct")
    )


@query(
    "parse_timestamp",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL
         WHEN event_id % 4 = 0 THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')
         ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS stamp FROM events""",
)
def parse_timestamp(spark, sf):
    """Date text with a time that is sometimes absent, and dates that cannot be parsed."""
    df = table(spark, sf, "events").select(
        "event_id",
        F.expr("CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE date_format(ts, 'yyyy-MM-dd') END").alias("d"),
        F.expr("CASE WHEN event_id % 4 <> 0 THEN date_format(ts, 'HH:mm:ss') END").alias("t"),
    )
    stamp = c.parse_timestamp(F.col("d"), F.col("t"), ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"])
    return df.select("event_id", F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query(
    "parse_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS day FROM orders""",
)
def parse_date(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.expr("CASE WHEN o_orderkey % 9 = 0 THEN '13/45/x' ELSE date_format(o_orderdate, 'MM/dd/yyyy') END").alias("d")
    )
    return df.select("o_orderkey", F.date_format(F.to_date(F.try_to_timestamp("d", F.lit("MM/dd/yyyy"))), "yyyy-MM-dd").alias("day"))


@query(
    "pad_code",
    """SELECT station, CASE WHEN length(CAST(station * 10007 AS VARCHAR)) < 12 THEN lpad(CAST(station * 10007 AS VARCHAR), 12, '0')
         ELSE CAST(station * 10007 AS VARCHAR) END AS code FROM v_station""",
)
def pad_code(spark, sf):
    raw = F.expr("CASE WHEN station % 2 = 0 THEN CAST(station * 10007 AS STRING) ELSE concat(CAST(station * 10007 AS STRING), '.0') END")
    return views.station(spark, sf).select("station", c.pad_code(raw, 12).alias("code"))


@query(
    "normalize_hier_code",
    """SELECT station, substr(CASE WHEN length(code) % 2 = 1 THEN '0' || code ELSE code END, 1, 8) AS parent
       FROM (SELECT station, CAST(7000000001 + station * 10000019 AS VARCHAR) AS code FROM v_station)""",
)
def normalize_hier_code(spark, sf):
    return views.station(spark, sf).select(
        "station", c.parent_code(F.expr("CAST(7000000001 + station * 10000019 AS STRING)")).alias("parent")
    )


@query(
    "derive_composite_code",
    """SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 200 AS VARCHAR), 3, '0') AS county,
         CASE c_mktsegment WHEN 'BUILDING' THEN '19' WHEN 'MACHINERY' THEN '27' WHEN 'FURNITURE' THEN '29' END AS state_fips
       FROM customer WHERE c_custkey % 10 <> 0
       UNION ALL SELECT c_custkey, NULL,
         CASE c_mktsegment WHEN 'BUILDING' THEN '19' WHEN 'MACHINERY' THEN '27' WHEN 'FURNITURE' THEN '29' END
       FROM customer WHERE c_custkey % 10 = 0""",
)
def derive_composite_code(spark, sf):
    county = F.expr("CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 200 END")
    return table(spark, sf, "customer").select(
        "c_custkey", c.county_code("c_nationkey", county).alias("county"),
        c.map_values("c_mktsegment", {"BUILDING": "19", "MACHINERY": "27", "FURNITURE": "29"}).alias("state_fips"),
    )


@query("null_if_matches", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 8, '0') END AS code FROM orders")
def null_if_matches(spark, sf):
    mangled = F.expr("CASE WHEN o_orderkey % 6 = 0 THEN '7.02E+10' ELSE lpad(CAST(o_orderkey AS STRING), 8, '0') END")
    return table(spark, sf, "orders").select("o_orderkey", c.null_if_matches(mangled, "[eE]").alias("code"))


@query(
    "collapse_spaces",
    r"""SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS text_md5,
          length(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS n,
          substr(replace(lpad(CAST(doc_id AS VARCHAR), 5, '5') || '-1234', '-', ''), 1, 5) AS zip FROM documents""",
)
def collapse_spaces(spark, sf):
    docs = table(spark, sf, "documents")
    flat = c.collapse_spaces("text")
    return docs.select(
        "doc_id", F.md5(flat).alias("text_md5"), F.length(flat).cast("long").alias("n"),
        c.clean_zip(F.expr("concat(lpad(CAST(doc_id AS STRING), 5, '5'), '-1234')")).alias("zip"),
    )


ITEM_TEXT = "concat(upper(p_type), ', ', upper(p_name), ' - PRODUCTION', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ', MEASURED IN BU' END)"


@query(
    "parse_label",
    """SELECT p_partkey, upper(p_type) || ', ' || upper(p_name) AS detail, 'PRODUCTION' AS statistic,
         CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'BU' END AS unit FROM part""",
)
def parse_label(spark, sf):
    parts = text.parse_item(F.expr(ITEM_TEXT))
    return table(spark, sf, "part").select("p_partkey", *[v.alias(k) for k, v in parts.items()])


@query(
    "extract_parens",
    """SELECT p_partkey, p_name || ' = ' || CAST(p_partkey AS VARCHAR) AS inside, p_name AS ingredient, CAST(p_partkey AS VARCHAR) AS code FROM part""",
)
def extract_parens(spark, sf):
    cell = F.expr("concat('CHEMICAL, ', p_type, ': (', p_name, ' = ', CAST(p_partkey AS STRING), ')')")
    inside = text.inside_parens(cell)
    name, code = text.split_pair(inside)
    return table(spark, sf, "part").select("p_partkey", inside.alias("inside"), name.alias("ingredient"), code.alias("code"))


@query(
    "parse_place",
    """SELECT p_partkey, p_name AS place, lower(p_type) AS place_type, 'Iowa' AS state FROM part""",
)
def parse_place(spark, sf):
    parts = text.parse_place(F.expr("concat(p_name, ' ', lower(p_type), ', Iowa')"))
    return table(spark, sf, "part").select("p_partkey", *[v.alias(k) for k, v in parts.items()])


@query(
    "normalize_list_cell",
    """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand || ' | ' || p_type END AS cell FROM part""",
)
def normalize_list_cell(spark, sf):
    messy = F.expr("CASE WHEN p_partkey % 7 = 0 THEN ' |  | ' ELSE concat('|  ', p_brand, '| |', p_type, ' ') END")
    return table(spark, sf, "part").select("p_partkey", c.normalize_list(messy, "|", " | ").alias("cell"))


@query(
    "token_vocab_check",
    """SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part)
       WHERE token <> '' AND token NOT IN ('red', 'blue', 'small', 'hot', 'gear', 'bolt') GROUP BY 1""",
)
def token_vocab_check(spark, sf):
    return contracts.token_vocab_check(table(spark, sf, "part"), "p_name", ["red", "blue", "small", "hot", "gear", "bolt"], sep=" ")


@query("duplicate_report", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_report(spark, sf):
    return contracts.duplicate_report(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "match_rate",
    """SELECT source, n_rows, n_matched, round(n_matched / n_rows, 6) AS match_rate FROM (
       SELECT 'segment' AS source, count(*) AS n_rows, count(c_mktsegment) AS n_matched FROM orders LEFT JOIN
         (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
       UNION ALL SELECT 'supplier', count(*), count(s_name) FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey)""",
)
def match_rate(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("o_custkey"), "s_name")
    joined = table(spark, sf, "orders").select("o_custkey").join(rich, "o_custkey", "left").join(sup, "o_custkey", "left")
    out = contracts.match_rate(joined, {"segment": "c_mktsegment", "supplier": "s_name"})
    return out.withColumn("match_rate", F.round("match_rate", 6))


@query(
    "rowwise_presence",
    """WITH t AS (SELECT station, (nitrate IS NOT NULL)::BIGINT + (nitrate_nitrite IS NOT NULL)::BIGINT + (nitrite IS NOT NULL)::BIGINT AS n,
         (turbidity IS NOT NULL OR tss IS NOT NULL) AS clear_any FROM v_chemistry)
       SELECT station, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_cells, count(*) FILTER (WHERE n > 0) AS rows_nitrogen,
         count(*) FILTER (WHERE n > 0 AND clear_any) AS rows_both FROM t GROUP BY 1""",
)
def rowwise_presence(spark, sf):
    df = views.chemistry(spark, sf).select("station", "nitrate", "nitrate_nitrite", "nitrite", "turbidity", "tss")
    df = df.select(
        "station", ops.count_present(["nitrate", "nitrate_nitrite", "nitrite"]).alias("n"), ops.any_present(["turbidity", "tss"]).alias("clear_any")
    )
    return df.groupBy("station").agg(
        F.count("*").alias("n_rows"), F.sum("n").alias("n_cells"), F.count_if(F.col("n") > 0).alias("rows_nitrogen"),
        F.count_if((F.col("n") > 0) & F.col("clear_any")).alias("rows_both"),
    )


PRACTICES = {"ECONOMY": "tile", "SMALL": "cover crop", "MEDIUM": "terrace", "PROMO": "wetland"}


@query(
    "map_values",
    """SELECT CASE p_type WHEN 'ECONOMY' THEN 'tile' WHEN 'SMALL' THEN 'cover crop' WHEN 'MEDIUM' THEN 'terrace' WHEN 'PROMO' THEN 'wetland' ELSE 'UNMAPPED ' || p_type END AS practice,
         count(*) AS n FROM part GROUP BY 1""",
)
def map_values(spark, sf):
    part = table(spark, sf, "part")
    mapped = (
        part.select(c.map_values("p_type", PRACTICES).alias("practice")).where("practice IS NOT NULL")
        .groupBy("practice").agg(F.count("*").alias("n"))
    )
    missed = contracts.unmapped(part, "p_type", PRACTICES).select(F.concat(F.lit("UNMAPPED "), "p_type").alias("practice"), "n")
    return mapped.unionByName(missed)


@query(
    "slug",
    """SELECT o_orderpriority, count(*) AS n, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM orders GROUP BY 1""",
)
def slug(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("name", c.slug("o_orderpriority"))


@query(
    "flag_columns",
    """SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 250000) AS n_big, count(*) FILTER (WHERE o_totalprice <= 250000) AS n_small,
         count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS n_present FROM orders GROUP BY 1""",
)
def flag_columns(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderstatus", c.yes_no(F.when(F.col("o_totalprice") > 250000, "Y").otherwise("N")).alias("big"),
        F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN 'x' END").isNotNull().alias("present"),
    )
    return df.groupBy("o_orderstatus").agg(
        F.count_if("big").alias("n_big"), F.count_if(~F.col("big")).alias("n_small"), F.count_if("present").alias("n_present")
    )


@query(
    "closure_check",
    """SELECT count(*) AS n_rows, CAST(max(abs(total - (a + n + r))) AS BIGINT) AS max_residual, CAST(min(a + n + r) AS BIGINT) AS min_sum,
         CAST(max(a + n + r) AS BIGINT) AS max_sum, round(avg(a + n + r), 6) AS mean_sum FROM (
       SELECT l_orderkey, sum(l_quantity) AS total, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS a,
         coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS n, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS r
       FROM lineitem GROUP BY 1)""",
)
def closure_check(spark, sf):
    q = F.col("l_quantity")
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(q).alias("total"), *[F.sum(F.when(F.col("l_returnflag") == x, q).otherwise(0.0)).alias(x) for x in "ANR"]
    )
    out = contracts.closure_check(per_order, F.col("total"), [F.col(x) for x in "ANR"])
    return out.select(
        "n_rows", *[F.col(x).cast("long").alias(x) for x in ("max_residual", "min_sum", "max_sum")], r6(F.col("mean_sum"), "mean_sum")
    )


@query(
    "presence_iff",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE exceed_pct IS NOT NULL AND NOT violation = 'R') AS present_without_flag,
         count(*) FILTER (WHERE exceed_pct IS NULL AND violation = 'R') AS flag_without_value FROM v_reports""",
)
def presence_iff(spark, sf):
    return contracts.presence_iff(views.discharge_reports(spark, sf), "exceed_pct", F.col("violation") == "R")


@query("functional_dependency", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def functional_dependency(spark, sf):
    return contracts.functional_dependency(table(spark, sf, "orders"), "o_custkey", "o_orderstatus")
