"""Mixtures: shares, repeats, budget, and the order against brute force."""

import math
import random

import pytest

from remitloom.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


@pytest.fixture
def sized(spark):
    rng = random.Random(2)
    rows = [(i, "big" if i % 3 else "small", rng.randrange(1, 40)) for i in range(900)] + [(1000 + i, "tiny", 5) for i in range(10)] + [(2000, "other", 50)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def targets(spark, *rows):
    return spark.createDataFrame(rows, TARGETS)


def test_shares_and_repeats(spark, sized):
    plan = targets(spark, ("big", 0.6, 1), ("Small ", 0.3, 2), ("tiny", 0.1, 9), ("absent", 0.2, 5), ("never", 0.0, 3))
    mixture = mixing.mix_sources(sized, plan)
    report = {r["source"]: r for r in mixing.shares(mixture, plan).collect()}
    for source, share in (("big", 0.6), ("small", 0.3), ("tiny", 0.1)):
        assert report[source]["actual_share"] == pytest.approx(share, abs=0.03)
    assert report["absent"]["tokens"] == 0 and report["tiny"]["most_repeats"] <= 9 and report["big"]["most_repeats"] == 1
    assert "other" not in {r["source"] for r in mixture.select("source").distinct().collect()}
    copies = {}
    for r in mixture.collect():
        copies.setdefault(r["doc_id"], []).append(r["copy_no"])
    assert all(sorted(c) == list(range(len(c))) for c in copies.values())
    total = sum(r["n_tokens"] for r in mixture.collect())
    assert total <= 10 * 5 * 9 / 0.1 and total > 10 * 5 * 9 / 0.1 - 100


@pytest.mark.parametrize("budget", [0, 1, 500, 5000, 10**9])
def test_the_cut_is_where_brute_force_cuts(spark, sized, budget):
    plan = targets(spark, ("big", 0.5, 1), ("small", 0.4, 2), ("tiny", 0.1, 3))
    out = mixing.mix_sources(sized, plan, total_tokens=budget).collect()
    assert sum(r["n_tokens"] for r in out) <= budget
    whole = mixing.mix_sources(sized, plan, total_tokens=10**9).collect()
    assert len(whole) == sum(1 for r in sized.collect() if r["source"] == "big") + 2 * 300 + 3 * 10
    order, total, wanted = sorted(whole, key=lambda r: (r["finish"], r["source"], r["copy_no"], r["doc_id"])), 0, set()
    for r in order:
        total += r["n_tokens"]
        if total > budget:
            break
        wanted.add((r["doc_id"], r["copy_no"]))
    assert {(r["doc_id"], r["copy_no"]) for r in out} == wanted
    for source, share in (("big", 0.5), ("small", 0.4), ("tiny", 0.1)):
        served = 0
        for r in [r for r in order if r["source"] == source]:
            served += r["n_tokens"]
            assert r["finish"] == pytest.approx(served / share)


def test_same_seed_same_mixture(spark, sized, rows):
    plan = targets(spark, ("big", 0.5, 1), ("small", 0.5, 1))
    a, b = (rows(mixing.mix_sources(sized.repartition(n), plan, 900, seed=4)) for n in (2, 7))
    assert a == b and a != rows(mixing.mix_sources(sized, plan, 900, seed=5))


def test_virtual_time():
    assert mixing.virtual_time(10, [(0.5, 100), (0.5, 100)]) == 10
    assert mixing.virtual_time(20, [(0.5, 5), (0.5, 100)]) == pytest.approx(30)
    assert mixing.virtual_time(20, [(0.5, 5), (0.5, 10)]) == math.inf


def test_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", " Case-Notes"), (2, None, "case_notes"), (3, "", "case_notes"), (4, "x", None), (5, "c d", "CASE NOTES")], "doc_id bigint, text string, source string").selectExpr("*", "1 as n_tokens", "2 as finish")
    sized = mixing.sized_documents(docs)
    assert sorted((r["doc_id"], r["source"]) for r in sized.collect()) == [(1, "case_notes"), (5, "case_notes")]
    plan = targets(spark, ("case_notes", 1.0, 1))
    assert mixing.mix_sources(sized, plan).count() == 2
    assert mixing.mix_sources(sized.limit(0), plan).count() == 0
    assert mixing.mix_sources(sized, plan.limit(0)).count() == 0
    assert mixing.shares(mixing.mix_sources(sized.limit(0), plan), plan).first()["actual_share"] == 0
