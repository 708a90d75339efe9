"""The composite index on constructed group vectors: expected values follow from the blend formula."""

import random

import pytest
from pyspark.sql import functions as F

from grainwise.operators import composite as ci


def expected(values):
    """Blend of the weighted mean of the groups present and the worst one; None below either eligibility limit."""
    present = {g: v for g, v in values.items() if v is not None}
    weight = sum(ci.WEIGHTS[g] for g in present)
    if len(present) < 3 or weight < 0.5 - 1e-9:
        return None
    mean = sum(ci.WEIGHTS[g] * v for g, v in present.items()) / weight
    return (1 - ci.BLEND) * mean + ci.BLEND * max(present.values())


def vectors():
    """Random vectors with gaps, each group alone at 62 over a floor of 11, and runs of the first k groups."""
    rng = random.Random(17)
    out = [{g: rng.choice([None, round(rng.uniform(1, 99), 2)]) for g in ci.WEIGHTS} for _ in range(40)]
    out += [{g: 62.0 if g == top else 11.0 for g in ci.WEIGHTS} for top in ci.WEIGHTS]
    out += [{g: 7.5 * (i + 1) if i < k else None for i, g in enumerate(ci.WEIGHTS)} for k in range(len(ci.WEIGHTS) + 1)]
    return out


def test_index_follows_the_formula(spark):
    schema = "id INT, " + ", ".join(f"g_{g} DOUBLE" for g in ci.WEIGHTS)
    df = spark.createDataFrame([(i, *v.values()) for i, v in enumerate(vectors())], schema)
    got = {r.id: r for r in ci.aggregate_index(ci.eligibility(df)).collect()}
    for i, v in enumerate(vectors()):
        want = expected(v)
        assert got[i].mean_max_blend == (None if want is None else pytest.approx(want)), v
        assert got[i].eligible == (want is not None)
        if want is not None:
            assert got[i].worst == max(x for x in v.values() if x is not None)


def test_harmonic_of_equal_groups_is_their_value(spark):
    df = spark.createDataFrame([tuple([37.0] * 8)], ", ".join(f"g_{g} DOUBLE" for g in ci.WEIGHTS))
    assert ci.aggregate_index(ci.eligibility(df)).first().harmonic == pytest.approx(37.0)


def test_weights_sum_to_one():
    assert abs(sum(ci.WEIGHTS.values()) - 1) < 1e-9
    assert sorted(p for m in ci.GROUPS.values() for p in m) == sorted(ci.CURVES)


def test_driver_first_wins_tie(spark):
    df = spark.createDataFrame([tuple([5.0] * 8)], ", ".join(f"g_{g} DOUBLE" for g in ci.WEIGHTS))
    assert df.select(ci.worst_group_name()).first()[0] == "pathogen"
    assert df.select(F.lit(1)).count() == 1
