"""The k nearest sites against all pairs, and how many sites a point meets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from grainwise.operators import nearest


def distance(metric, a, b):
    dlat, dlon = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    if metric == "planar":
        return math.hypot(b[0] - a[0], b[1] - a[1])
    if metric == "radian_euclidean":
        return 2 * 6371.0 * math.asin(min(math.hypot(dlat, dlon) / 2, 1))
    h = math.sin(dlat / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(dlon / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(h, 1)))


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, lat double, lon double")


def scattered(n, seed):
    """Places all over the globe, at its poles and seam, in a tight cluster, and repeated ones."""
    r = random.Random(seed)
    places = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(n)]
    places += [(r.uniform(88, 90), r.uniform(-180, 180)) for _ in range(n // 4)]
    places += [(r.uniform(-20, 20), 180 - r.random() if r.random() < 0.5 else -180 + r.random()) for _ in range(n // 4)]
    places += [(47 + r.random() / 500, 8 + r.random() / 500) for _ in range(n)]
    places += places[:: 5]
    return [(i, *p) for i, p in enumerate(places)]


@pytest.mark.parametrize(("metric", "k"), [("haversine", 1), ("haversine", 3), ("planar", 3), ("radian_euclidean", 1)])
def test_equals_all_pairs(spark, metric, k):
    sites, points = scattered(60, 1), scattered(40, 2) + [(900, 47.001, 8.001), (901, None, 3.0), (902, float("nan"), 3.0)]
    got = {}
    for row in nearest.k_nearest(frame(spark, points, "p"), frame(spark, sites + [(990, None, 1.0)], "s"), "p", "s", k, metric, leaf=4).collect():
        got.setdefault(row.p, []).append((row["rank"], row.s, row.distance))
    for p, lat, lon in points:
        if lat is None or math.isnan(lat):
            assert got[p] == [(None, None, None)]
            continue
        want = sorted((round(distance(metric, (lat, lon), s[1:]), 6), s[0]) for s in sites)
        mine = sorted(got[p])
        assert [r for r, _, _ in mine] == list(range(1, k + 1))
        assert [round(d, 5) for _, _, d in mine] == pytest.approx([d for d, _ in want[:k]], abs=2e-5)
        assert len({s for _, s, _ in mine}) == k
        of = dict((s, d) for d, s in want)
        assert all(of[s] == pytest.approx(d, abs=2e-5) for _, s, d in mine)


def test_own_id_ties_and_few_targets(spark):
    rows = [(1, 10.0, 20.0), (2, 10.0, 20.0), (3, 10.0, 20.0), (4, 11.0, 20.0)]
    src, tgt = frame(spark, rows, "p"), frame(spark, rows, "s")
    got = {(r.p, r["rank"]): r.s for r in nearest.k_nearest(src, tgt, "p", "s", 2, exclude_self=True).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 1, (3, 2): 2, (4, 1): 1, (4, 2): 2}
    few = nearest.k_nearest(src, tgt.where("s < 3"), "p", "s", 5).groupBy("p").count().collect()
    assert {r["count"] for r in few} == {2}
    none = nearest.k_nearest(src, tgt.where("false"), "p", "s", 2).collect()
    assert sorted(r.p for r in none) == [1, 2, 3, 4] and all(r.s is None and r["rank"] is None for r in none)
    alone = nearest.k_nearest(src.where("p = 4"), tgt.where("s = 4"), "p", "s", 1, exclude_self=True).collect()
    assert [(r.p, r.s) for r in alone] == [(4, None)]
    assert nearest.k_nearest(src.where("false"), tgt, "p", "s", 2).count() == 0


def test_few_candidates_in_a_cluster(spark):
    r = random.Random(3)
    sites = [(i, 47 + r.gauss(0, 0.001), 8 + r.gauss(0, 0.001)) for i in range(6000)] + [(9000 + i, r.uniform(-60, 60), r.uniform(-170, 170)) for i in range(200)]
    sites = frame(spark, sites, "t").select("t", F.col("lat").alias("ta"), F.col("lon").alias("to"))
    points = spark.createDataFrame([(47 + r.gauss(0, 0.002), 8 + r.gauss(0, 0.002)) for _ in range(200)] + [(r.uniform(-60, 60), r.uniform(-170, 170)) for _ in range(50)], "la double, lo double")
    met = nearest.candidates(points, sites, 3, "haversine").groupBy("la", "lo").count()
    worst = met.agg(F.max("count"), F.count("*")).first()
    assert worst[1] == 250 and worst[0] <= 30 * nearest.LEAF
    levels, placed = nearest.cell_tree(sites)
    assert placed.count() == sites.count()
    assert all(level.where(f"NOT split AND n > {nearest.LEAF}").count() == 0 for level in levels)
