import math
import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from grainwise.functions.numeric import EARTH_KM
from grainwise.operators import spatial_corr
from grainwise.session import shared_dir

EDGES = [0, 5, 20, 80, 160, 640]


def sums_by_bin(lat, lon, v):
    lat, lon = np.radians(lat), np.radians(lon)
    i, j = np.triu_indices(len(v), 1)
    a = np.sin((lat[j] - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[j]) * np.sin((lon[j] - lon[i]) / 2) ** 2
    d = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(a, 1)))
    bins = sum((~(d < e)).astype(int) for e in EDGES[1:-1])
    found = {}
    for k in np.unique(bins):
        x, y = np.append(v[i[bins == k]], v[j[bins == k]]), np.append(v[j[bins == k]], v[i[bins == k]])
        found[int(k)] = (len(x) // 2, np.corrcoef(x, y)[0, 1])
    return found


@pytest.mark.parametrize("tile", [spatial_corr.TILE, 250])
def test_a_day_of_many_stations_stores_only_its_stations(spark, tile):
    rng = np.random.default_rng(4)
    n = 1500
    lat, lon, v = 41 + rng.random(n) * 3, -96 + rng.random(n) * 6, rng.normal(size=n)
    lat[:300], lon[:300] = 42 + rng.random(300) / 100, -93 + rng.random(300) / 100  # a town
    lat[-1] = math.nan  # no distance: the last bin
    df = spark.createDataFrame([("p", 1, i, float(lat[i]), float(lon[i]), float(v[i])) for i in range(n)], "target string, day int, station int, lat double, lon double, v double")
    before = set(os.listdir(shared_dir(spark)))
    got = {r.bin: (r.n_pairs, r.correlation) for r in spatial_corr.spatial_autocorr(df, ["target"], "day", "station", "v", EDGES, 2, tile=tile).collect()}
    want = sums_by_bin(lat, lon, v)
    assert {k: p[0] for k, p in got.items()} == {k: p[0] for k, p in want.items()}
    for k, (_, c) in got.items():
        assert c == pytest.approx(want[k][1], abs=1e-9)
    new = [os.path.join(shared_dir(spark), f) for f in set(os.listdir(shared_dir(spark))) - before]
    assert sum(pq.read_table(f).num_rows for f in new) == n


def test_distances_on_an_edge_belong_to_the_bin_above(spark):
    step = math.degrees(5 / EARTH_KM)
    places = [(0.0, 0.0), (0.0, step * (1 - 1e-9)), (0.0, -step * (1 + 1e-9))]
    df = spark.createDataFrame([(1, i, *p, float(i)) for i, p in enumerate(places)], "day int, station int, lat double, lon double, v double")
    got = {r.bin: r.n_pairs for r in spatial_corr.spatial_autocorr(df, [], "day", "station", "v", EDGES, 1).collect()}
    assert got == {0: 1, 1: 2}
