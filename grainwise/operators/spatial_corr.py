"""Correlation of same-day values by station distance, exact over all pairs, from sums per pair of blocks.

Stations of a day are dealt into tiles of bounded size, and Spark groups them by pair of tiles: a task holds two tiles. There
both are cut into compact blocks. Two blocks whose least and largest distance fall into one distance bin add all their pairs
at once, by count, sum and squares of each side; the others are opened into a matrix of angles and summed under the bin edges.
No pair of rows is formed or stored, and a day of any size is spread over the pairs of its tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions.numeric import EARTH_KM
from grainwise.session import stored

#: About the stations of a day in one tile; the rows that are shuffled grow with a day's tiles.
TILE = 50_000
#: Stations of a block, at most.
BLOCK = 256
COLOCATED = -1
SUMS = ("n", "s", "q", "x")


def _tile_sums(by: Sequence[str], edges: Sequence[float]) -> Callable[[pa.Table], pa.Table]:
    """The function of one pair of tiles. All it needs is nested here, as executors may not have this package."""
    by, inner, width, radius = list(by), [float(e) for e in edges[1:-1]], BLOCK, EARTH_KM
    half_turn = math.pi * radius
    # A distance is below an edge where the cosine of its angle is above that of the edge, or its chord below the edge's.
    cosines = [2.0 if e <= 0 else -2.0 if e >= half_turn else 1 - 2 * math.sin(e / (2 * radius)) ** 2 for e in inner]
    chords = np.array([0.0 if e <= 0 else 3.0 if e >= half_turn else 2 * math.sin(e / (2 * radius)) for e in inner])
    names = SUMS
    # Cosines this near to an edge's are settled by the distance itself; bounds of blocks have a slack.
    near, slack = 4e-15, 1e-9

    def haversine(lat1, lon1, lat2, lon2):
        a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
        return 2 * radius * np.arcsin(np.sqrt(np.minimum(a, 1.0)))

    class Block:
        def __init__(self, at, rad, points, w):
            self.rad, self.p, self.w = rad[at], points[at], w[at]
            low, high = self.p.min(axis=0), self.p.max(axis=0)
            self.centre = (low + high) / 2
            self.r = np.sqrt(((self.p - self.centre) ** 2).sum(axis=1)).max()
            self.all = self.w.sum(axis=0)
            n, s, q = self.w.T
            self.own = np.array([n @ n, s @ n, q @ n, s @ s])

    def blocks(t: pa.Table) -> list:
        rad = np.radians(np.column_stack([t.column(c).to_numpy() for c in ("lat", "lon")]).astype(np.float64))
        w = np.column_stack([t.column(c).to_numpy() for c in ("n", "s", "q")]).astype(np.float64)
        lat, lon = rad.T
        points = np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
        sound = np.isfinite(points).all(axis=1)
        todo, out = [np.flatnonzero(sound)], []
        while todo:
            at = todo.pop()
            if len(at) <= width:
                out += [at] if len(at) else []
                continue
            x = points[at]
            x = x[:, np.argmax(np.ptp(x, axis=0))]
            order, half = np.argpartition(x, len(at) // 2), len(at) // 2
            todo += [at[order[:half]], at[order[half:]]]
        if not sound.all():  # no distance: never below an edge, so in the last bin
            out.append(np.flatnonzero(~sound))
        return [Block(at, rad, points, w) for at in out]

    def crossed(a, b):
        """Count, a + b, a * a + b * b, a * b over the pairs of two sides' moments."""
        (n, s, q), (m, t, r) = a.T, b.T
        return np.array([n @ m, s @ m + n @ t, q @ m + n @ r, s @ t])

    def below(a, b, cosine: np.ndarray, k: int) -> np.ndarray:
        """The sums over the pairs of two blocks nearer than an edge; a block's own pairs come twice."""
        hit = cosine > cosines[k] + near
        maybe = cosine > cosines[k] - near
        if np.count_nonzero(hit) != np.count_nonzero(maybe):
            i, j = np.nonzero(maybe & ~hit)
            hit[i, j] = haversine(*a.rad[i].T, *b.rad[j].T) < inner[k]
        if a is b:
            np.fill_diagonal(hit, False)
        return crossed(a.w, hit.astype(np.float64) @ b.w)

    def sums(table: pa.Table) -> pa.Table:
        side = table.column("_side").to_numpy()
        one = table.column("_a")[0].as_py() == table.column("_b")[0].as_py()
        left = blocks(table.filter(pa.array(~side)))
        right = left if one else blocks(table.filter(pa.array(side)))
        total = np.zeros((len(inner) + 1, 4))
        if left and right:
            centres, radii, moments = (np.array([getattr(b, c) for b in right]) for c in ("centre", "r", "all"))
        for i, a in enumerate(left if right else []):
            first = i if one else 0
            apart = np.sqrt(((centres[first:] - a.centre) ** 2).sum(axis=1))
            reach = radii[first:] + a.r + slack
            least = (~((apart - reach)[:, None] < chords)).sum(axis=1)
            most = (~((apart + reach)[:, None] < chords)).sum(axis=1)
            m, (n, s, q) = moments[first:].T, a.all
            every = np.column_stack([n * m[0], s * m[0] + n * m[1], q * m[0] + n * m[2], s * m[1]])
            if one:
                every[0] = (every[0] - [a.own[0], 2 * a.own[1], 2 * a.own[2], a.own[3]]) / 2
            whole = least == most
            np.add.at(total, least[whole], every[whole])
            for j in np.flatnonzero(~whole):
                b = right[first + j]
                cosine, done = a.p @ b.p.T, np.zeros(4)
                for k in range(least[j], most[j]):
                    upto = below(a, b, cosine, k) / (2 if a is b else 1)
                    total[k] += upto - done
                    done = upto
                total[most[j]] += every[j] - done
        bins = np.flatnonzero(total[:, 0] > 0)
        keys = [table.column(c).take(pa.array(np.zeros(len(bins), np.int64))) for c in by]
        out = [pa.array(bins, pa.int32()), pa.array(np.rint(total[bins, 0]).astype(np.int64)), *[pa.array(total[bins, c]) for c in (1, 2, 3)]]
        return pa.table([*keys, *out], names=[*by, "bin", *names])

    return sums


def spatial_autocorr(
    df: DataFrame, by: Sequence[str], day: str, station: str, value: str, edges: Sequence[float], min_pairs: int = 150, tile: int = TILE
) -> DataFrame:
    """(by, bin, n_pairs, correlation) over all pairs of rows of one day; ``df`` has lat and lon.

    Bin -1 holds the pairs within one station, the others those of different stations; a distance on an edge belongs to the
    bin above, one beyond the last edge to the last bin. The correlation counts each pair in both orders. Rows without value
    or coordinates take no part; bins with fewer than ``min_pairs`` pairs are left out.
    """
    key = [*by, day]
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    units = rows.groupBy(*key, station).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    units = stored(units, "units")
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    own = units.select(*by, F.lit(COLOCATED).alias("bin"), (n * (n - 1) / 2).cast("long").alias("n"), (s * (n - 1)).alias("s"), (q * (n - 1)).alias("q"), ((s * s - q) / 2).alias("x"))
    known = units.dropna(subset=key)
    tiles = known.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("_tiles"))
    dealt = known.join(tiles, key).withColumn("_t", F.pmod(F.xxhash64(station), "_tiles").cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_u"))
    met = met.select(*key, F.least("_t", "_u").alias("_a"), F.greatest("_t", "_u").alias("_b"), (F.col("_t") > F.col("_u")).alias("_side"), "lat", "lon", "n", "s", "q")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in units.select(*by).schema], "bin int", "n long", "s double", "q double", "x double"])
    crossed = met.groupBy(*key, "_a", "_b").applyInArrow(_tile_sums(by, edges), schema)
    every = own.where("n > 0").unionByName(crossed)
    total = every.groupBy(*by, "bin").agg(*[F.sum(c).alias(c) for c in SUMS]).where(F.col("n") >= min_pairs)
    mean = F.col("s") / (2 * F.col("n"))
    spread = F.nullif(F.col("q") / (2 * F.col("n")) - mean * mean, F.lit(0.0))
    return total.select(*by, "bin", F.col("n").alias("n_pairs"), ((F.col("x") / F.col("n") - mean * mean) / spread).alias("correlation"))
