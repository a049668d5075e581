"""Repeated messages: identities, the seen store, and fault injection."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from remitloom.functions import scalars as X
from remitloom.operators import dedup

DAY = datetime(2022, 9, 1)
SCHEMA = "row_id bigint, ident string, at timestamp"


def store(spark, tmp_path, shards=3):
    return dedup.SeenStore(spark, f"file://{tmp_path}/seen", shards)


def ids(df):
    return sorted(r["row_id"] for r in df.collect())


def test_identities(spark):
    rows = [("C1", 0, "007", None), ("c1", 0, " 7 ", "x"), ("c1", 0, "+7", None), ("c1", 1, "7", None), ("c1", 0, None, "7"), ("c1", 0, "7:ACH", None), ("c1", 0, "7:ach", None), ("c1", 0, None, None), (None, 0, "7", None), ("c1", 0, "-0", None), ("c1", 0, "0", None), ("c1", 0, "", "9"), ("c1", 0, "9" * 40, None), ("c1", 0, "0" + "9" * 40, None)]
    out = [r[0] for r in spark.createDataFrame(rows, "c string, t int, m string, d string").select(dedup.message_identity(*map(F.col, "ctmd"))).collect()]
    assert out[0] == out[1] == out[2] and out[9] == out[10] and out[12] == out[13]
    assert out[7] is None and out[8] is None
    assert len({x for x in out if x}) == 8


def test_winners_by_time_then_id(spark, tmp_path):
    rows = [(3, "a", DAY), (1, "a", DAY), (2, "a", DAY - timedelta(hours=1)), (5, "b", None), (4, "b", DAY), (6, None, DAY), (7, None, DAY), (9, "c", DAY), (8, "c", DAY)]
    arrivals = spark.createDataFrame(rows, SCHEMA)
    kept = store(spark, tmp_path).ingest(arrivals)
    assert ids(kept) == [2, 4, 8]
    assert ids(dedup.surplus(arrivals, kept)) == [1, 3, 5, 9]


def test_batches_bits_and_codes(spark, tmp_path):
    rng, s = random.Random(1), store(spark, tmp_path)
    seen: set[str] = set()
    for batch in range(3):
        rows = [(batch * 1000 + i, f"m{rng.randrange(300)}", DAY) for i in range(200)]
        kept = ids(s.ingest(spark.createDataFrame(rows, SCHEMA)))
        first: dict[str, int] = {}
        for i, m, _ in rows:
            first[m] = min(i, first.get(m, i))
        assert kept == sorted(i for m, i in first.items() if m not in seen)
        seen |= set(first)
    words = s.dictionary()
    assert words.count() == len(seen) == words.select("ident").distinct().count() == words.select("shard", "code").distinct().count()
    assert s.bitmaps().selectExpr("sum(bitmap_count(bits))").first()[0] == len(seen)
    assert ids(s.ingest(spark.createDataFrame([(1, "m0", DAY)] * 0, SCHEMA))) == []


def test_a_named_batch_again_and_a_lost_race(spark, tmp_path):
    s, rows = store(spark, tmp_path), [(1, "a", DAY), (2, "a", DAY)]
    arrivals = spark.createDataFrame(rows, SCHEMA)
    assert ids(s.ingest(arrivals, "b1")) == [1]
    before = list(s.commits())
    assert ids(s.ingest(arrivals, "b1")) == [1] and list(s.commits()) == before
    assert ids(s.ingest(arrivals, "b2")) == []
    with pytest.raises(RuntimeError):
        s._commit(1, {}, "other")
    assert list(s.commits()) == [0, 1, 2]


def test_the_bits_decide_and_not_the_dictionary(spark, tmp_path):
    s, rng = store(spark, tmp_path), random.Random(3)
    early = [(i, f"m{i}", DAY) for i in range(40)]
    s.encode(spark.createDataFrame(early, SCHEMA))  # known, but no copy kept yet: as after a job that died in between
    assert s.dictionary().count() == 40 and s.bitmaps().count() == 0
    kept = ids(s.ingest(spark.createDataFrame([(100 + i, f"m{i % 20}", DAY) for i in range(60)], SCHEMA)))
    assert kept == list(range(100, 120))
    again = [(200 + i, f"m{i}", DAY) for i in rng.sample(range(50), 50)]
    assert ids(s.ingest(spark.createDataFrame(again, SCHEMA))) == list(range(220, 250))
    assert s.bitmaps().selectExpr("sum(bitmap_count(bits))").first()[0] == 50 == s.dictionary().count()
    far = spark.createDataFrame([(7, 0, 70_000)], "row_id bigint, shard int, code bigint")
    assert ids(s.unseen(far)) == [7]


def test_only_the_shards_of_a_batch_are_written(spark, tmp_path):
    s = store(spark, tmp_path, shards=8)
    s.ingest(spark.createDataFrame([(i, f"m{i}", DAY) for i in range(100)], SCHEMA))
    before = s._last()[1]
    s.ingest(spark.createDataFrame([(1000, "new", DAY)], SCHEMA))
    after = s._last()[1]
    assert sum(after["bits"][k] != v for k, v in before["bits"].items()) <= 1 and sum(after["codes"].values()) == 101


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_slices_in_order_of_time_keep_the_earliest(spark, tmp_path, kind):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "hot", *[f"m{k}" for k in range(60)]]), rng.choice([None, *[DAY + timedelta(minutes=m) for m in range(30)]])) for i in range(-100, 400)]
    arrivals = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.col("at").cast(kind))
    kept = ids(dedup.ingest_in_order(store(spark, tmp_path), arrivals, 4))
    first: dict[str, tuple] = {}
    for i, m, at in rows:
        if m is not None:
            key = (at is None, at or DAY, i)
            first[m] = min(first.get(m, key), key)
    assert kept == sorted(k[2] for k in first.values())
    assert dedup.ingest_in_order(store(spark, tmp_path / "empty"), arrivals.limit(0)).count() == 0


def test_drop_repeats_and_injection(spark, rows):
    df = spark.createDataFrame([("c", "1", 5), ("c", "1", 5), ("d", "1", 5), ("c", None, 6), ("c", None, 6)], "client string, id string, v int")
    assert rows(dedup.drop_repeats(df, "id", "client")) == sorted([("c", "1", 5), ("d", "1", 5), ("c", None, 6), ("c", None, 6)], key=repr)
    sent = dedup.with_injected_copies(df.filter("id is not null").distinct(), F.col("client") == "c", 4)
    assert sent.count() == 5 and dedup.drop_repeats(sent, "id", "client").count() == 2
    assert dedup.drop_repeats(df.limit(0), "id", "client").count() == 0


def test_shards_and_numbers(spark):
    df = spark.createDataFrame([("007",), (" 7\t",), ("-7",), ("7.0",), ("",), ("x",), (None,), ("9" * 30,)], "b string")
    assert [r[0] for r in df.select(X.bank_number(F.col("b"))).collect()] == [7, 7, -7, None, None, None, None, None]
    assert {r[0] for r in df.select(X.stable_shard(X.bank_number(F.col("b")), 4)).collect()} <= {0, 1, 2, 3, None}


def test_digest_shards(spark):
    import hashlib

    texts = ["", "EUR|USD|2022-09-01", "ñandú", "x" * 1000]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(X.digest_shard(F.col("t"), 13)).collect()
    assert [r[0] for r in out] == [int(hashlib.sha256(t.encode()).hexdigest(), 16) % 13 for t in texts]
