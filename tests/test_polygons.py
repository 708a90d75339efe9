"""Containment and nearest outlines against every edge of every ring."""

import math
import random

import pytest

from grainwise.operators import polygons

RING = "array<struct<lon:double,lat:double>>"


def star(rng, x, y, size, corners):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(x + rng.uniform(0.1, 1) * size * math.cos(t), y + rng.uniform(0.1, 1) * size * math.sin(t)) for t in turns]


def edges(ring):
    return [(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a != b]


def inside(x, y, ring):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges(ring)) % 2 == 1


def metres(x, y, a, b):
    east = math.cos(math.radians(y)) * polygons.METRES
    ax, ay, bx, by = (a[0] - x) * east, (a[1] - y) * polygons.METRES, (b[0] - x) * east, (b[1] - y) * polygons.METRES
    dx, dy = bx - ax, by - ay
    t = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
    return round(math.hypot(ax + t * dx, ay + t * dy), 6)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    rings = {z: star(rng, rng.uniform(-3, 3), rng.uniform(-2, 2) + 55, rng.choice([0.02, 0.3, 2]), rng.randint(3, 40)) for z in range(25)}
    rings[25] = [(0.0, 55.0), (1.0, 55.0), (1.0, 56.0), (0.0, 56.0), (0.0, 55.0)]  # closed, with corners on round numbers
    points = [(i, rng.uniform(53, 58), rng.uniform(-4, 4)) for i in range(1500)]
    points += [(2000 + k, y, x) for k, (x, y) in enumerate((x / 4, 55 + y / 4) for x in range(5) for y in range(5))]
    points += [(3000, None, 1.0), (3001, 55.0, None)]
    for z, ring in rings.items():  # close to a corner, on both sides of the limit
        x, y = ring[0]
        points += [(4000 + 2 * z, y + 480 / polygons.METRES, x), (4001 + 2 * z, y - 520 / polygons.METRES, x)]
    zones = spark.createDataFrame([(z, [{"lon": x, "lat": y} for x, y in r]) for z, r in rings.items()], f"zone long, ring {RING}")
    return rings, points, spark.createDataFrame(points, "pid long, lat double, lon double"), zones


@pytest.mark.parametrize("cell", [0.25, 0.01, 7.0])
def test_containment(world, cell):
    rings, points, df, zones = world
    got = {r.pid: r.zone for r in polygons.point_in_polygon(df, zones, "pid", "zone", cell).collect()}
    want = {i: min((z for z, r in rings.items() if y is not None and x is not None and inside(x, y, r)), default=None) for i, y, x in points}
    assert got == want


def test_nearest_outline_within_the_limit(world):
    rings, points, df, zones = world
    rows = polygons.nearest_polygon_fallback(df, zones, "pid", "zone", 500.0).collect()
    assert len(rows) == len(points)
    got = {r.pid: (r.match_method, r.zone, r.dist_m) for r in rows}
    for i, y, x in points:
        if y is None or x is None:
            assert got[i] == ("none", None, None)
            continue
        within = min((z for z, r in rings.items() if inside(x, y, r)), default=None)
        near = min((metres(x, y, a, b), z) for z, r in rings.items() for a, b in edges(r))
        if within is not None:
            assert got[i] == ("within", within, 0.0)
        elif near[0] <= 500:
            assert got[i][:2] == ("nearest", near[1]) and got[i][2] == pytest.approx(near[0], abs=1e-5)
        else:
            assert got[i] == ("none", None, None)
    assert sum(m == "nearest" for m, _, _ in got.values()) > 10


def test_an_edge_is_listed_where_it_runs(world):
    _, _, _, zones = world
    inner, listed = polygons.covering(zones.where("zone = 25"), "zone", 0.25)
    assert listed.count() <= 4 * 7 and inner.count() == 16
    assert "ring" not in listed.columns
