"""Salted joins give what plain joins give, and hot keys are bounded by rows of a task."""

from pyspark.sql import functions as F

from remitloom.operators import skew


def test_hot_keys_and_salted_joins(spark, rows):
    left = spark.range(2000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("k"), F.lit(1).alias("__n0"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k7", 3), (None, 4)], "k string, v int")
    hot = skew.hot_keys(left, ["k"], 100)
    assert rows(hot) == [("hot", 7)]
    salted, repeated = skew.salted(left, hot, ["k"], "row"), skew.repeated(right, hot, ["k"])
    assert salted.count() == 2000 and salted.filter("k = 'hot'").select(skew.SALT).distinct().count() == 7
    assert repeated.count() == 2 * 7 + 2
    joined = salted.join(repeated, ["k", skew.SALT]).select("row", "v")
    assert rows(joined) == rows(left.join(right, "k").select("row", "v"))
    none = skew.hot_keys(left.limit(0), ["k"])
    assert none is None and skew.salted(left, none, ["k"], "row").filter(f"{skew.SALT} <> 0").count() == 0


def test_a_key_with_a_65th_of_the_rows_is_cut_to_the_rows_of_a_task(spark):
    df = spark.range(65_000).select("id", F.when(F.col("id") % 65 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    hot = skew.hot_keys(df, ["k"], 100)
    most = skew.salted(df, hot, ["k"], "id").groupBy("k", skew.SALT).count().agg(F.max("count")).first()[0]
    assert hot.count() == 1 and most < 200  # 1 000 rows of the key in ten parts, by a hash


def test_several_sets_in_one_pass(spark, rows):
    df = spark.createDataFrame([(1, "a", None)] * 90 + [(1, "b", 5)] * 60 + [(None, "a", 5)] * 9, "x int, y string, z int")
    found = skew.hot_keys_at_once(df, {"xy": ["x", "y"], "z": ["z"], "y": ["y"], "none": ["x", "z"]}, 62)
    assert rows(found["xy"]) == [(1, "a", 2)] and rows(found["y"]) == [("a", 2)] and rows(found["z"]) == [(5, 2)]
    assert "none" not in found
    spread = spark.range(5000).select(F.col("id").alias("x"), F.lit("z").alias("y"))
    assert skew.hot_keys(spread, ["x", "y"]) is None and skew.repeated(spread, None, ["x", "y"]).filter(f"{skew.SALT} = 0").count() == 5000
