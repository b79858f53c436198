"""Rows are cut down before a join by a Bloom filter of the other side."""

from pyspark.sql import functions as F

from histloom.operators import lookups as L


def test_nothing_with_a_partner_is_lost(spark):
    rows = spark.range(20_000).selectExpr("id as a", "cast(id % 7 as string) as b", "id as x")
    keys = spark.range(0, 20_000, 200).selectExpr("id as a", "cast(id % 7 as string) as b").union(spark.range(3).selectExpr("id", "'none'"))
    left = L.reduced(rows, keys, ["a", "b"])
    assert left.join(keys, ["a", "b"], "left_semi").count() == 100
    assert left.count() < 110
    assert L.reduced(rows, keys.limit(0), ["a", "b"]).count() == 0


def test_the_filter_is_below_the_exchange(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(20_000).withColumn("v", F.col("id") * 2)
        keys = spark.range(50)
        joined = L.reduced(rows, keys, ["id"]).join(keys, ["id"], "left_semi")
        assert joined.count() == 50
        lines = joined._jdf.queryExecution().executedPlan().toString().splitlines()
        exchanges = [i for i, line in enumerate(lines) if "Exchange" in line]
        filters = [i for i, line in enumerate(lines) if "Filter" in line and "get" in line]
        assert filters and min(exchanges) < max(filters)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_keys_of_another_type(spark):
    rows = spark.range(100).selectExpr("cast(id as int) as id")
    assert L.of_targets(rows, spark.range(7), ["id"], ["id"]).count() == 7
    assert L.needed(rows, spark.range(7).union(spark.range(7)), ["id"]).count() == 7


def test_null_keys(spark):
    rows = spark.createDataFrame([(1,), (None,), (3,)], "id long")
    assert [r.id for r in L.needed(rows, spark.createDataFrame([(None,), (3,)], "id long"), ["id"]).collect()] == [3]
