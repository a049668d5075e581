"""Containers: constraints, whole items, and room left unused."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from remitloom.llm import packing, tokens


def check(sizes, numbers, cap, docs, attention):
    for b in set(numbers):
        own = [s for s, n in zip(sizes, numbers) if n == b]
        assert len(own) == 1 or sum(own) <= cap and len(own) <= docs and sum(s * s for s in own) <= attention


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=60), st.integers(1, 8), st.sampled_from([1.0, 0.5, 0.2]))
def test_every_constraint_holds(sizes, docs, share):
    numbers = packing.best_fit(np.array(sizes), 100, docs, 100 * 100 * share)
    check(sizes, numbers, 100, docs, 100 * 100 * share)
    assert sorted(set(numbers)) == list(range(max(numbers) + 1))


def brute(sizes, cap):
    """Fewest bins for a few items, by trying all placements."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                rooms[k] -= sizes[i]
                place(i + 1, rooms)
                rooms[k] += sizes[i]
        place(i + 1, [*rooms, cap - sizes[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_close_to_the_best_packing(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(1, 70) for _ in range(9)), reverse=True)
    used = len(set(packing.best_fit(np.array(sizes), 100, 99, 1e9)))
    assert used <= brute(sizes, 100) * 11 / 9 + 1


def test_best_fit_prefers_the_fuller_container():
    assert list(packing.best_fit(np.array([60, 70, 30]), 100, 9, 1e9)) == [1, 0, 0]


@pytest.fixture
def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 90)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "word " * 1000), (203, "x" * 5000), (204, "same"), (205, "same")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_tokens", "2 as shard", "3 as container_id")


def test_all_documents_once_and_whole(spark, docs):
    specs = spark.createDataFrame([("small", 64), ("large", 256), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    out = packing.fill_containers(docs, specs, shard_items=60).collect()
    sizes = {r["doc_id"]: tokens.count(r["text"]) for r in docs.collect()}
    for kind, cap in (("small", 64), ("large", 256)):
        own = [r for r in out if r["container_kind"] == kind]
        pieces: dict = {}
        for r in own:
            pieces.setdefault(r["doc_id"], []).append((r["piece_no"], r["token_start"], r["n_tokens"]))
        assert set(pieces) == set(sizes)
        for doc, parts in pieces.items():
            parts.sort()
            assert sum(p[2] for p in parts) == sizes[doc] and len(parts) == max(1, -(-sizes[doc] // cap))
            assert [p[1] for p in parts] == [cap * k for k in range(len(parts))]
        rooms: dict = {}
        for r in own:
            rooms.setdefault(r["container_id"], []).append(r["n_tokens"])
        assert all(sum(v) <= cap and len(v) <= max(1, cap // 8) for v in rooms.values())
        filled = sum(map(sum, rooms.values())) / (cap * len(rooms))
        assert filled > 0.8
    assert {r["container_kind"] for r in out} == {"small", "large"}
    report = {r["container_kind"]: r for r in packing.fill_report(packing.fill_containers(docs, specs), specs).collect()}
    assert report["small"]["tokens"] == sum(sizes.values()) and report["small"]["fewest"] <= report["small"]["containers"]


def test_empty_tables(spark, docs):
    specs = spark.createDataFrame([("small", 64)], "container_kind string, capacity_tokens int")
    assert packing.fill_containers(docs.limit(0), specs).count() == 0
    assert packing.fill_containers(docs, specs.limit(0)).count() == 0


def test_counts(spark):
    assert tokens.count(None) == tokens.count("") == 0
    assert tokens.count("<|endoftext|>") > 1
    df = spark.createDataFrame([(1, "hello world", 5)], "doc_id bigint, text string, n_tokens int")
    assert tokens.with_token_counts(df, ["doc_id"]).first()["n_tokens"] == 2


def test_a_binding_attention_capacity(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 23)) for i in range(300)], "doc_id bigint, text string")
    specs = spark.createDataFrame([("k", 64)], "container_kind string, capacity_tokens int")
    loose = packing.constraint_report(packing.fill_containers(docs, specs), specs).first()
    tight = packing.constraint_report(packing.fill_containers(docs, specs, attention_share=0.2), specs, attention_share=0.2).first()
    assert tight["containers"] > loose["containers"] and tight["bound_by_attention"] > 0
    assert [r[c] for r in (loose, tight) for c in ("over_tokens", "over_documents", "over_attention")] == [0] * 6
