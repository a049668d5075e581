"""Hot keys and running totals, against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from remitloom.operators import hotkeys, prefix

def test_running_total(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.randrange(5)) for i in range(800)]
    df = spark.createDataFrame(data, "g string, o bigint, w bigint").repartition(6)
    out = prefix.running_total(df, ["g"], [F.col("o")], "w", "upto").collect()
    sums: Counter = Counter()
    wanted = {}
    for g, o, w in data:
        sums[g] += w
        wanted[o] = sums[g]
    assert {r["o"]: r["upto"] for r in out} == wanted
    everything = prefix.running_total(df, [], [F.col("o")], "w", "upto")
    assert everything.agg(F.max("upto")).first()[0] == sum(w for _, _, w in data)
    assert [r["upto"] for r in everything.orderBy("o").collect()][:3] == [data[0][2], data[0][2] + data[1][2], sum(w for _, _, w in data[:3])]
    assert prefix.running_total(df.limit(0), ["g"], [F.col("o")], "w", "upto").count() == 0
    with pytest.raises(ValueError):
        prefix.running_total(df.withColumn("upto", F.lit(1)), ["g"], [F.col("o")], "w", "upto")


def test_weighted_results(spark):
    rng = random.Random(2)
    data = [(1 if rng.random() < 0.6 else rng.randrange(2, 7), rng.choice([None, *map(float, range(9))])) for _ in range(700)] + [(9, None), (None, 1.0)]
    weighted = hotkeys.weighted_values(spark.createDataFrame(data, "k bigint, v double"), F.col("k"), F.col("v"))
    shape = middle = {r["key"]: r for r in hotkeys.profile(weighted, {"p50": 0.5, "p0": 0.0, "p100": 1.0}).collect()}
    for key in {k for k, _ in data if k is not None}:
        values = sorted(v for k, v in data if k == key and v is not None)
        assert shape[key]["n_rows"] == sum(k == key for k, _ in data) and shape[key]["n_distinct"] == len(set(values))
        if values:
            n, v = max((n, -v) for v, n in Counter(values).items())
            assert (shape[key]["mode"], shape[key]["mode_rows"]) == (-v, n)
            assert middle[key]["p50"] == values[math.ceil(len(values) / 2) - 1] and middle[key]["p0"] == values[0] and middle[key]["p100"] == values[-1]
    assert shape[9]["mode"] is None and shape[9]["p50"] is None and shape[9]["n_rows"] == 1 and None not in shape
    assert hotkeys.profile(weighted.limit(0), {"p50": 0.5}).count() == 0


def test_shares_in_whole_numbers(spark):
    df = spark.createDataFrame([(k,) for k in [1] * 2 + [2] * 1 + [None] * 97], "k bigint")
    weighted = hotkeys.weighted_values(df, F.col("k"), F.lit("x"))
    assert [r["key"] for r in hotkeys.keys_with_share(weighted, df.agg(F.count(F.lit(1))), 2).collect()] == [1]
    empty = hotkeys.weighted_values(df.limit(0), F.col("k"), F.lit("x"))
    assert hotkeys.keys_with_share(empty, df.limit(0).agg(F.count(F.lit(1))), 2).count() == 0
