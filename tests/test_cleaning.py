import pytest
from pyspark.sql import functions as F

from grainwise.functions import cleaning as c
from grainwise.functions import numeric as num
from grainwise.operators import contracts


def test_numbers_and_suppression(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["1,970.00", "(D)", "(Z)", "", " 7 ", "sunny", None])], "i INT, t STRING")
    value, flag = c.parse_suppressed("t")
    rows = df.select("i", value.alias("v"), flag.alias("f")).orderBy("i").collect()
    assert [r.v for r in rows] == [1970.0, None, None, None, 7.0, None, None]
    assert [r.f for r in rows] == [False, True, True, False, False, False, False]


def test_codes_and_signs(spark):
    df = spark.createDataFrame([("70200090101", -0.0), ("123456789012345", -3.0)], "code STRING, x DOUBLE")
    rows = df.select(c.pad_code("code", 12).alias("p"), c.floor_at_zero("x").alias("x")).collect()
    assert [r.p for r in rows] == ["070200090101", "123456789012345"]
    assert [str(r.x) for r in rows] == ["0.0", "0.0"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (None,)], "x DOUBLE")
    assert [r[0] for r in df.select(c.nan_to_null("x")).collect()] == [None, 2.0, None]


def test_curve_clamps_and_hits_anchors(spark):
    anchors = [(5.0, 100), (6.5, 50), (7.0, 0), (8.5, 0), (9.0, 50)]
    df = spark.createDataFrame([(4.0,), (6.5,), (6.75,), (8.0,), (9.0,), (20.0,), (None,)], "x DOUBLE")
    got = [r[0] for r in df.select(num.interpolate("x", anchors)).collect()]
    assert got == [100.0, 50.0, 25.0, 0.0, 50.0, 50.0, None]


def test_grain_contract(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k INT, v STRING")
    good = spark.createDataFrame([(1, 10), (None, 30)], "k INT, w INT")
    assert contracts.grain_safe_join(left, good, ["k"]).count() == 3
    safe = contracts.grain_safe_join(left, good, ["k"], null_safe=True)
    assert safe.where("w = 30").count() == 1
    with pytest.raises(contracts.ContractError):
        contracts.grain_safe_join(left, good.unionByName(good), ["k"])


def test_audit_conserves_rows(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    kept, audit = contracts.filter_audit(df, [("a", F.col("x") > 1), ("b", F.col("id") < 50)])
    rows = audit.orderBy("step").collect()
    assert rows[0].rows_in == 100 and rows[-1].rows_out == kept.count()
    assert all(r.rows_in == r.rows_out + r.rows_dropped for r in rows)
