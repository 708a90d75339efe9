"""SQL twins of sources/views.py, used as common table expressions by the oracle queries."""

from grainwise.sources.views import CHEMISTRY, FEATURES, TARGETS


def _site(key: str, lat_mul: int, lon_mul: int) -> str:
    return f"""
  CAST(40.4 AS DOUBLE) + CAST({key} * {lat_mul} % 3300 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat,
  CAST(-96.6 AS DOUBLE) + CAST({key} * {lon_mul} % 6400 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon"""


_PAIRS = " UNION ALL ".join(
    f"SELECT cluster, '{t}' AS target, '{f}' AS feature, {t} AS y, {f} AS x FROM v_features"
    for t in TARGETS
    for f in FEATURES
)

SQL_VIEWS: dict[str, str] = {
    "v_measure": """
SELECT event_id, user_id AS station, ts, event_type AS parameter,
  CASE event_id % 5 WHEN 0 THEN 'mg/L' WHEN 1 THEN 'ug/L' WHEN 2 THEN 'deg F' WHEN 3 THEN '' ELSE 'g/m2' END AS unit,
  CASE WHEN event_id % 23 = 0 THEN 'sunny' WHEN event_id % 17 = 0 THEN '(D)' ELSE CAST(value AS VARCHAR) END AS raw,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS val
FROM events""",
    "v_station": f"""
SELECT c_custkey AS station, c_name AS station_name, c_mktsegment AS site_type,
  CAST(c_nationkey AS BIGINT) AS region, c_acctbal AS balance, {_site('c_custkey', 7919, 104729)},
  lpad(CAST(c_custkey * 10007 AS VARCHAR), 12, '0') AS code12
FROM customer""",
    "v_gauge": f"""
SELECT s_suppkey AS gauge, s_name AS gauge_name, CAST(s_nationkey AS BIGINT) AS region,
{_site('s_suppkey', 6007, 15013)}
FROM supplier""",
    "v_panel": """
SELECT CAST(s_nationkey AS BIGINT) AS region, year(l_shipdate) AS year, l_returnflag AS commodity,
  l_linestatus AS statistic, sum(l_quantity) AS value, count(*) AS n
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
GROUP BY 1, 2, 3, 4""",
    "v_panel_year": """
SELECT region, year, sum(value) FILTER (WHERE commodity = 'A') AS kg_a,
  sum(value) FILTER (WHERE commodity = 'N') AS kg_n, sum(value) FILTER (WHERE commodity = 'R') AS kg_r
FROM v_panel GROUP BY region, year""",
    "v_reports": """
SELECT l_suppkey AS permit, year(l_shipdate) AS fiscal_year, CAST(l_linenumber AS BIGINT) AS outfall,
  l_partkey AS parameter, CASE WHEN l_discount > 0.05 THEN l_discount END AS exceed_pct,
  CASE WHEN l_tax > 0 THEN l_tax * 100 END AS days_late, l_returnflag AS violation, l_shipdate AS period_end
FROM lineitem""",
    "v_pixels": """
SELECT l_suppkey AS zone, l_partkey % 20 AS code, year(l_shipdate) AS year FROM lineitem""",
    "v_chemistry": "SELECT l_suppkey AS station, l_orderkey AS sample_id, CAST(l_linenumber AS BIGINT) AS replicate, "
    "l_shipdate AS ts, l_extendedprice AS covariate,\n  "
    + ",\n  ".join(f"CASE WHEN {present} THEN {expr} END AS {name}" for name, (expr, present) in CHEMISTRY.items())
    + "\nFROM lineitem",
    "v_features": """
SELECT o_custkey AS cluster, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_shipdate AS ts,
  l_extendedprice AS price, l_discount AS disc, l_quantity AS qty, CAST(p_size AS DOUBLE) AS psize,
  p_retailprice AS retail, o_totalprice AS total, CAST(dayofyear(l_shipdate) AS DOUBLE) AS doy, p_type, o_orderpriority
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "v_pairs": _PAIRS,
    "v_zones": """
SELECT CAST(n_nationkey AS BIGINT) AS zone,
  CAST(-96.6 AS DOUBLE) + (n_nationkey % 5) * CAST(1.28 AS DOUBLE) AS x0,
  CAST(40.4 AS DOUBLE) + (n_nationkey // 5) * CAST(0.66 AS DOUBLE) AS y0
FROM nation""",
    "v_zone_edges": """
SELECT zone, x0 AS x1, y0 AS y1, x0 + CAST(1.28 AS DOUBLE) AS x2, y0 + CAST(0 AS DOUBLE) AS y2 FROM v_zones
UNION ALL SELECT zone, x0 + CAST(1.28 AS DOUBLE), y0, x0 + CAST(1.28 AS DOUBLE), y0 + CAST(0.66 AS DOUBLE) FROM v_zones WHERE zone % 2 = 0
UNION ALL SELECT zone, x0 + CAST(1.28 AS DOUBLE), y0 + CAST(0.66 AS DOUBLE), x0, y0 + CAST(0.66 AS DOUBLE) FROM v_zones WHERE zone % 2 = 0
UNION ALL SELECT zone, x0 + CAST(1.28 AS DOUBLE), y0, x0, y0 + CAST(0.66 AS DOUBLE) FROM v_zones WHERE zone % 2 = 1
UNION ALL SELECT zone, x0, y0 + CAST(0.66 AS DOUBLE), x0, y0 FROM v_zones""",
}


# --- composite index -------------------------------------------------------------------------
import math  # noqa: E402

from grainwise.operators import composite  # noqa: E402


def interpolate_sql(x: str, scale: str, anchors) -> str:
    """The piecewise-linear curve as a CASE expression."""
    xs, ys = [a for a, _ in anchors], [float(q) for _, q in anchors]
    if scale == "log":
        x, xs = f"log10(greatest({x}, 1e-6))", [math.log10(a) for a in xs]
    out = f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {float(xs[0])!r}::DOUBLE THEN {ys[0]!r}::DOUBLE"
    for (x0, y0), (x1, y1) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        out += f" WHEN {x} < {float(x1)!r}::DOUBLE THEN ({(y1 - y0) / (x1 - x0)!r}::DOUBLE) * ({x} - {float(x0)!r}::DOUBLE) + {y0!r}::DOUBLE"
    return out + f" ELSE {ys[-1]!r}::DOUBLE END"


def case_null(p: str, body: str) -> str:
    return f"CASE WHEN {p} IS NOT NULL THEN {body} END"


def weighted_mean_sql(weights) -> str:
    num = " + ".join(f"coalesce(g_{g}, 0) * {w!r}::DOUBLE" for g, w in weights.items())
    den = " + ".join(f"CASE WHEN g_{g} IS NOT NULL THEN {w!r}::DOUBLE ELSE 0 END" for g, w in weights.items())
    return f"(({num}) / nullif({den}, 0))"


def harmonic_sql(weights) -> str:
    num = " + ".join(f"CASE WHEN g_{g} IS NOT NULL THEN {w!r}::DOUBLE ELSE 0 END" for g, w in weights.items())
    den = " + ".join(
        f"CASE WHEN g_{g} IS NOT NULL THEN {w!r}::DOUBLE / (greatest(100 - g_{g}, 1) * greatest(100 - g_{g}, 1)) ELSE 0 END" for g, w in weights.items()
    )
    return f"(100 - sqrt(({num}) / nullif({den}, 0)))"


_ALL = ", ".join(f"g_{g}" for g in composite.GROUPS)

SQL_VIEWS.update(
    {
        "v_subindex": "SELECT station, sample_id, replicate, ts, covariate, water_temp,\n  "
        + ",\n  ".join(f"{case_null(p, interpolate_sql(p, *c))} AS q_{p}" for p, c in composite.CURVES.items())
        + "\nFROM v_chemistry",
        "v_groups": "SELECT station, sample_id, replicate, ts, covariate, water_temp, "
        + ", ".join(f"greatest({', '.join('q_' + p for p in m)}) AS g_{g}" if len(m) > 1 else f"q_{m[0]} AS g_{g}" for g, m in composite.GROUPS.items())
        + " FROM v_subindex",
        "v_eligible": "SELECT *, "
        + " + ".join(f"(g_{g} IS NOT NULL)::BIGINT" for g in composite.GROUPS)
        + " AS n_groups, ("
        + " + ".join(f"CASE WHEN g_{g} IS NOT NULL THEN {round(w * 10000)} ELSE 0 END" for g, w in composite.WEIGHTS.items())
        + f")::DOUBLE / 10000 AS weight_coverage, greatest({_ALL}) AS worst_all FROM v_groups",
        "v_index": f"""SELECT *, CASE WHEN eligible THEN wm END AS weighted_mean, CASE WHEN eligible THEN 0.6 * wm + 0.4 * worst_all END AS mean_max_blend,
  CASE WHEN eligible THEN {harmonic_sql(dict.fromkeys(composite.WEIGHTS, 1.0))} END AS harmonic, CASE WHEN eligible THEN {harmonic_sql(composite.WEIGHTS)} END AS weighted_harmonic,
  CASE WHEN eligible THEN worst_all END AS worst FROM (SELECT *, n_groups >= 3 AND weight_coverage >= 0.5 AS eligible, {weighted_mean_sql(composite.WEIGHTS)} AS wm FROM v_eligible)""",
    }
)
