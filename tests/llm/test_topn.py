"""The best items of groups, against brute force."""

import math
import random
import time
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from remitloom.llm import topn

ITEMS = "grp bigint, score double, tie string, item bigint"


def best(rows, n):
    groups = defaultdict(dict)
    for g, s, t, i in rows:
        order = (-s, t.encode(), i)
        groups[g][i] = min(order, groups[g].get(i, order))
    return sorted((g, k + 1, i) for g, items in groups.items() for k, (i, _) in enumerate(sorted(items.items(), key=lambda x: x[1])[:n]))


@pytest.mark.parametrize("n", [1, 3, 5])
def test_top_n_with_ties_and_repeats(spark, rows, n):
    rng = random.Random(n)
    data = [(0 if rng.random() < 0.5 else rng.randrange(1, 9), float(rng.randrange(6)), rng.choice(["a", "b", "Z", "ñ", "￿", "𝒜"]), rng.randrange(60)) for _ in range(900)]
    df = spark.createDataFrame(data, ITEMS).repartition(5).withColumn("bound", F.lit(1)).withColumn("rank", F.lit(2))
    assert rows(topn.top_n_per_group(df, n)) == sorted(best(data, n), key=repr)


def test_top_n_over_many_batches(spark, rows, monkeypatch):
    monkeypatch.setattr(topn, "FOLD_ROWS", 50)
    data = [(i % 3, float(i * 7919 % 101), "t", i) for i in range(500)]
    assert rows(topn.top_n_per_group(spark.createDataFrame(data, ITEMS).coalesce(1), 4)) == sorted(best(data, 4), key=repr)


def test_top_n_small_cases(spark, rows):
    assert rows(topn.top_n_per_group(spark.createDataFrame([], ITEMS), 5)) == []
    assert rows(topn.top_n_per_group(spark.createDataFrame([(1, -0.0, "b", 2), (1, 0.0, "a", 3), (1, math.inf, "z", 4), (1, -math.inf, "z", 5)], ITEMS), 9)) == [(1, 1, 4), (1, 2, 3), (1, 3, 2), (1, 4, 5)]
    with pytest.raises(ValueError):
        topn.top_n_per_group(spark.createDataFrame([], ITEMS), 0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3).map(float), st.sampled_from("abB"), st.integers(0, 6)), min_size=1, max_size=40), st.integers(1, 4))
def test_local_best_equals_brute_force(data, n):
    import pyarrow as pa

    table = pa.table(list(map(list, zip(*data))), names=["grp", "score", "tie", "item"])
    out = topn._best(table, n)
    assert sorted(zip(out["grp"], out["rank"], out["item"])) == best(data, n)


def test_more_groups_than_a_fold_holds(spark, rows, monkeypatch):
    monkeypatch.setattr(topn, "FOLD_ROWS", 60)
    rng = random.Random(8)
    data = [(rng.choice([0, 0, 0, *range(200)]), float(rng.randrange(50)), rng.choice("ab"), rng.randrange(300)) for _ in range(1500)]
    assert rows(topn.top_n_per_group(spark.createDataFrame(data, ITEMS).repartition(3), 4)) == sorted(best(data, 4), key=repr)


def test_the_local_step_is_linear_in_rows():
    """800 000 rows in 200 000 groups, in one task."""
    import numpy as np
    import pyarrow as pa

    size, out = 800_000, 0
    rng = np.random.default_rng(1)
    table = pa.table({"grp": rng.integers(0, 200_000, size), "score": rng.random(size), "tie": pa.array(["t"] * size), "item": np.arange(size)})
    began = time.process_time()
    for batch in topn._candidates(5)(iter(table.to_batches(10_000))):
        out += batch.num_rows
    assert out <= size and time.process_time() - began < 20
