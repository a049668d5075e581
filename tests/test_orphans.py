"""Orphan references under the three match rules, against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from remitloom.operators import orphans

T0 = datetime(2022, 9, 1)
REFS, TARGETS = "row_key bigint, at timestamp, a string, b string", "a string, b string, valid_from timestamp, valid_to timestamp"


def brute(refs, targets, match):
    out = []
    for key, at, a, b in refs:
        stated = [i for i, v in enumerate((a, b)) if v is not None]
        if not stated or match == "simple" and len(stated) < 2:
            continue
        if match == "full" and len(stated) < 2:
            out.append((key, "missing"))
            continue
        same = [t for t in targets if all(t[i] == (a, b)[i] for i in stated)]
        if any(at is not None and f <= at and (u is None or u > at) for _, _, f, u in same):
            continue
        out.append((key, "missing" if not same else "deleted" if at is not None and min(f for _, _, f, _ in same) <= at else "late"))
    return sorted(out)


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_masks(spark, match):
    rng = random.Random(7)
    pick = lambda: rng.choice([None, "x", "y", "z"])
    day = lambda: T0 + timedelta(days=rng.randrange(10))
    refs = [(i, rng.choice([None, day(), day(), day()]), pick(), pick()) for i in range(200)]
    targets = [(pick() or "x", pick() or "y", day(), rng.choice([None, day()])) for _ in range(9)]
    out = orphans.find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS), ["a", "b"], match)
    assert sorted((r["row_key"], r["orphan_kind"]) for r in out.collect()) == brute(refs, targets, match)


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_hot_keys_of_several_fields(spark, match):
    rng = random.Random(9)
    pick = lambda: rng.choice([None, *"xxxxxxyz"])
    day = lambda: T0 + timedelta(days=rng.randrange(10))
    refs = [(i, rng.choice([None, day(), day()]), pick(), pick()) for i in range(300)]
    targets = [(pick() or "x", pick() or "y", day(), rng.choice([None, day()])) for _ in range(6)] * 2
    to = spark.createDataFrame(targets, TARGETS).withColumnsRenamed({"a": "ta", "b": "tb"})
    both = orphans.find_all_orphans(spark.createDataFrame(refs, REFS), {"two": orphans.Reference(["a", "b"], to, match, ["ta", "tb"]), "one": orphans.Reference(["a"], to, match, ["ta"])}, task_rows=10)
    found = both.collect()
    assert sorted((r["row_key"], r["orphan_kind"]) for r in found if r["ref_field"] == "two") == brute(refs, targets, match)
    single = [(k, at, a, a) for k, at, a, _ in refs]
    assert sorted((r["row_key"], r["orphan_kind"]) for r in found if r["ref_field"] == "one") == brute(single, [(a, a, f, u) for a, _, f, u in targets], match)


def test_edges_of_validity_and_clashing_columns(spark):
    refs = [(1, T0, "k", None), (2, T0 + timedelta(days=1), "k", None), (3, T0 - timedelta(days=1), "k", None), (4, T0, None, None)]
    target = spark.createDataFrame([("k", None, T0, T0 + timedelta(days=1))] * 2, TARGETS).withColumn("row_key", F.lit(5)).withColumn("there", F.lit(1))
    frame = spark.createDataFrame(refs, REFS).withColumn("valid_from", F.lit(0)).withColumn("first", F.lit(0))
    out = {r["row_key"]: r["orphan_kind"] for r in orphans.find_orphans(frame, target, ["a"]).collect()}
    assert out == {2: "deleted", 3: "late"}


def test_empty_sides(spark):
    refs, targets = spark.createDataFrame([(1, T0, "k", None)], REFS), spark.createDataFrame([], TARGETS)
    assert orphans.find_orphans(refs, targets, ["a"]).first()["orphan_kind"] == "missing"
    assert orphans.find_orphans(refs.limit(0), targets, ["a"]).count() == 0
    with pytest.raises(ValueError):
        orphans.find_orphans(refs, targets, ["a"], "loose")
