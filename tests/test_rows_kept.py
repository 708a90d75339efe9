"""No operator loses or multiplies rows: text keys, large keys, missing features and coordinates."""

from pyspark.sql import functions as F

from grainwise.operators import modelling, ordering, permutation, spatial


def test_groups_with_text_keys(spark):
    df = spark.createDataFrame([(f"site-{i % 9}", i) for i in range(90)], "g string, v int")
    split = ordering.group_split(df, "g", 0.3, seed=1)
    assert split.count() == 90
    assert split.where("is_test").select("g").distinct().count() == 3
    folds = ordering.group_kfold(df, "g", 3, seed=1, balanced=True)
    assert folds.groupBy("fold").agg(F.count_distinct("g").alias("n")).where("n <> 3").isEmpty()
    assert ordering.cap_sample(df, 4, ["g"], "g").count() == 36


def test_ranks_are_unique_beyond_32_bits(spark):
    df = spark.createDataFrame([(k + (j << 31), k) for k in range(4) for j in range(3)], "row long, x int")
    mixed = permutation.permuted(df, "row", ["x"], seed=5)
    assert mixed.count() == 12
    assert sorted(r.x for r in mixed.collect()) == sorted(r.x for r in df.collect())
    ranks = ordering.group_ranks(df, "row").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(12))


def test_equal_order_is_broken_by_the_key(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "k string, o long")
    got = {r.k: r["rank"] for r in ordering.unique_ranks(df, "k", "o").collect()}
    assert got == {"c": 0, "a": 1, "b": 2}


def test_missing_features_are_scored(spark):
    rows = [(float(i), None if i % 4 == 0 else float(i % 7), float(3 * i + i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    fitted = modelling.fit(df, "y", ["a", "b"], "linear")
    assert fitted.transform(df).where("predicted IS NOT NULL").count() == 60
    forest = modelling.fit(df, "y", ["a", "b"], "forest", numTrees=3, maxDepth=3)
    assert abs(sum(v for _, v in forest.importances()) - 1) < 1e-9


def test_nearest_wraps_and_keeps_points(spark):
    points = spark.createDataFrame([(1, 0.0, 179.99), (2, None, 10.0), (3, 89.5, 0.0), (4, 10.0, 10.0)], "p int, lat double, lon double")
    sites = spark.createDataFrame([(7, 0.0, -179.99), (8, 0.0, 179.5), (9, 89.6, 179.0), (10, 12.0, 10.0)], "s int, lat double, lon double")
    got = {r.p: r for r in spatial.nearest_neighbor(points, sites, "p", "s").collect()}
    assert {p: r.s for p, r in got.items()} == {1: 7, 2: None, 3: 9, 4: 10}
    assert got[1].distance < 3


def test_surface_covers_the_grid(spark):
    sites = spark.createDataFrame([(0.0, 0.0, 5.0)], "lat double, lon double, v double")
    got = spatial.idw_grid(sites, "v", (0.0, 0.0), 1.0, (6, 5), 1)
    assert got.count() == 30 and got.where("value IS NOT NULL").count() == 4
