"""Permutations, dependent columns, slices behind a manifest, bucketed state, pair sums, presence masks."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainwise.operators import multivariate as mv
from grainwise.operators import permutation, profile, spatial_corr
from grainwise.sources import files, sinks
from grainwise.streaming import events


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1013])
def test_keyed_permutations_are_permutations(spark, n):
    images = [[r[0] for r in spark.range(n).select(permutation.permuted_number(F.col("id"), n, seed)).collect()] for seed in (1, 2)]
    assert [sorted(i) for i in images] == [list(range(n))] * 2
    assert n < 10 or (images[0] != images[1] and images[0] != list(range(n)))


def test_planted_sum_is_named_with_its_members(spark):
    rng = random.Random(1)
    rows = [(a, b, c, 2 * a - b, 5.0) for a, b, c in ((rng.gauss(0, 1), rng.gauss(3, 2), rng.gauss(0, 1)) for _ in range(300))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = {(r.feature, r.member): r.weight for r in mv.null_space(df, list("abcd")).collect()}
    m = np.array(rows)
    sd = m.std(axis=0)
    assert set(got) == {("d", "a"), ("d", "b")}
    assert got["d", "a"] == pytest.approx(2 * sd[0] / sd[3]) and got["d", "b"] == pytest.approx(-sd[1] / sd[3])
    assert {r.feature for r in mv.null_space(df, list("abcde")).collect()} == {"d", "e"}
    weakest = mv.weakest_directions(df, list("abcd"), k=1).collect()
    assert {r.feature for r in weakest} == {"a", "b", "d"} and abs(weakest[0].eigenvalue) < 1e-9
    assert math.isinf(mv.vif(df, list("abcd")).first()["condition_number"])


def test_pca_loadings(spark):
    rng = random.Random(2)
    rows = [(x, x + rng.gauss(0, 0.1), rng.gauss(0, 1)) for x in (rng.gauss(0, 1) for _ in range(400))]
    got = mv.pca_summary(spark.createDataFrame(rows, "a double, b double, c double"), list("abc")).orderBy("component").collect()
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(np.array(rows).T)))[::-1]
    assert [r.explained for r in got] == pytest.approx(list(values / 3)) and got[-1].cumulative == pytest.approx(1)
    assert got[0].main_feature in "ab" and got[1].main_feature == "c"


def test_slices_are_replaced_and_dropped_with_another_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "model string, x long")
    read = lambda: sorted(map(str, map(tuple, sinks.read_slices(spark, path).collect())))
    sinks.replace_slice(frame([("a", 1), ("b", 2), (None, 3)]), path, "model")
    sinks.replace_slice(frame([("b", 20), ("b", 21)]), path, "model")
    assert read() == sorted(["('a', 1)", "('b', 20)", "('b', 21)", "(None, 3)"])
    for x in range(3):
        sinks.replace_slice(frame([("a", x)]), path, "model")
    assert read() == sorted(["('a', 2)", "('b', 20)", "('b', 21)", "(None, 3)"])
    assert len(files.children(spark, f"{path}/manifest")) == 2 and len(files.children(spark, f"{path}/data")) <= 4
    # A publication that failed before its manifest leaves the table as it was.
    frame([("a", 99)]).write.parquet(f"{path}/data/half")
    assert read() == sorted(["('a', 2)", "('b', 20)", "('b', 21)", "(None, 3)"])
    sinks.replace_slice(spark.createDataFrame([("c", 1, 0.5)], "model string, x long, r2 double"), path, "model")
    assert read() == ["('c', 1, 0.5)"]


def test_latest_state_touches_only_its_buckets(spark, tmp_path):
    path, source = str(tmp_path / "state"), str(tmp_path / "in")
    schema = "k long, at long, v string"
    want = {}

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for k, at, v in rows:
            if k not in want or at >= want[k][0]:
                want[k] = (at, v)
        stream = spark.readStream.schema(schema).parquet(source)
        events.latest_state(stream, ["k"], ["at"], ["v"], path, str(tmp_path / "ck"), buckets=8)

    def state():
        return {r.k: (r["at"], r.v) for r in events.read_state(spark, path).collect()}

    arrive([(k, 1, "a") for k in range(100)])
    arrive([(7, 2, "b")])
    assert state() == want
    written = files.children(spark, f"{path}/data/{events.VERSION}=1")
    assert len([c for c in written if c.startswith(events.BUCKET)]) == 1
    # A batch that failed before its manifest: data of a version that no manifest names, and then again.
    spark.createDataFrame([(7, 9, "x", 0)], f"{schema}, {events.BUCKET} int").write.partitionBy(events.BUCKET).parquet(f"{path}/data/{events.VERSION}=2")
    assert state() == want
    arrive([(7, 3, "c"), (8, 0, "late"), (200, 1, "new")])
    assert state() == want and len(files.children(spark, f"{path}/manifest")) == 2


def test_pair_sums_by_distance_equal_all_pairs(spark):
    rng = random.Random(3)
    edges = [0, 5, 10, 20, 40, 80, 160, 320, 640]
    sites = [(40.4 + rng.random() * 3.3, -96.6 + rng.random() * 6.4) for _ in range(40)] + [(41 + rng.random() / 50, -95.0) for _ in range(20)] + [(-80.0, 179.9), (-80.0, -179.9)]
    rows = [(d, i, *sites[i], rng.gauss(0, 1)) for d in (1, 2) for i in range(len(sites)) for _ in range(rng.randint(0, 2))]
    df = spark.createDataFrame([*rows, (1, 5, *sites[5], None), (1, 6, None, 1.0, 0.5)], "day int, station int, lat double, lon double, v double")

    def km(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(x)))

    pairs = {}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[0] == b[0]:
                k = -1 if a[1] == b[1] else sum(km(a[2:4], b[2:4]) >= e for e in edges[1:-1])
                pairs.setdefault(k, []).extend([(a[4], b[4]), (b[4], a[4])])
    got = {r.bin: r for r in spatial_corr.spatial_autocorr(df, [], "day", "station", "v", edges, min_pairs=2).collect()}
    assert {k: r.n_pairs for k, r in got.items()} == {k: len(p) // 2 for k, p in pairs.items() if len(p) >= 4}
    for k, r in got.items():
        assert r.correlation == pytest.approx(np.corrcoef(np.array(pairs[k]).T)[0, 1], abs=1e-9)


def test_presence_masks_of_many_columns(spark):
    rng = random.Random(5)
    names = [f"c{k}" for k in range(70)]
    rows = [tuple(1 if rng.random() < 0.3 else None for _ in names) for _ in range(50)] + [tuple([None] * 70)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names))
    got = {(r.a, r.b): (r.n_both, r.jaccard) for r in profile.co_measurement(df, names).collect()}
    assert len(got) == 70 * 69 // 2
    for (a, b), (n, share) in got.items():
        i, j = names.index(a), names.index(b)
        both, any_ = sum(r[i] is not None and r[j] is not None for r in rows), sum(r[i] is not None or r[j] is not None for r in rows)
        assert n == both and share == (pytest.approx(both / any_) if any_ else None)


def test_units_beyond_the_listing_are_counted(spark):
    counts = Counter({f"u{k:02d}": k + 1 for k in range(25)})
    df = spark.createDataFrame([("p", u, 1.0) for u, n in counts.items() for _ in range(n)] + [("p", " ", 1.0)], "p string, u string, v double")
    row = profile.unit_consistency(df, "p", "u", "v").collect()[0]
    assert (row.n, row.n_units, row.n_without_unit) == (sum(counts.values()) + 1, 25, 1)
    assert row.units == "; ".join([f"u{k:02d} ({k + 1})" for k in range(5, 25)] + ["+5 more"])
