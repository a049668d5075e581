"""CSV, rates, results, streams, and the plans that reach the scan."""

import json

import pytest

from remitloom.operators import dedup
from remitloom.plans import questions as Q
from remitloom.sources import shared, sinks, tables
from remitloom.streaming import flows

HEAD = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"


def test_csv_with_mark_quotes_and_bad_numbers(spark, tmp_path):
    path = tmp_path / "tx.csv"
    path.write_text("﻿" + HEAD + '2022/09/01 00:00,001,"A, b",002,B,10.5,US Dollar,x,US Dollar,ACH,0\n', encoding="utf-8")
    row = tables.transactions_csv(spark, str(path)).first()
    assert (row["account_origin"], row["amount_received"], row["amount_paid"], len(row)) == ("A, b", 10.5, None, 10)
    accounts = tmp_path / "a.csv"
    accounts.write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nBánk,001,N1,E1,One\nX,y,N2,E2,Two\n", encoding="utf-8")
    assert [tuple(r)[:2] for r in tables.accounts_csv(spark, str(accounts)).collect()] == [("Bánk", 1), ("X", None)]


def test_rates_file(spark, tmp_path):
    path = tmp_path / "rates.json"
    path.write_text(json.dumps({"Ruble|USD|2022-09-01": "0.01659"}))
    assert [str(r["rate"]) for r in tables.rates_json(spark, str(path), builtin=False).collect()] == ["0.016590"]


def test_results_and_summary(spark, tmp_path):
    pairs = spark.createDataFrame([("S", "D")], "account_origin string, account_destination string")
    count = spark.createDataFrame([(7,)], "cantTrx bigint")
    summary = sinks.write_results({"query_4": pairs, "query_5": count}, str(tmp_path), "run")
    assert summary["result_counts_by_type"] == {"query_4": 2, "query_5": 1} and summary["result_count"] == 3
    written = spark.read.option("header", True).csv(f"{tmp_path}/client-run/query_4.csv")
    assert sorted(r["account"] for r in written.collect()) == ["D", "S"]
    assert json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/client-run/summary.json").collect()))["run_id"] == "run"
    with pytest.raises(ValueError):
        sinks.write_results({}, str(tmp_path))


def test_client_results(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "client_id string, n int")
    assert [tuple(r) for r in sinks.client_results(rows, "b").collect()] == [(2,)]


def test_shared_folder_is_the_sessions(spark):
    assert shared.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    again = shared.written(spark.range(3), "x")
    assert again.count() == 3
    assert shared.clean(spark) >= 1 and shared.clean(spark) == 0


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.range(40).selectExpr("id row_id", "'US Dollar' payment_currency", "'US Dollar' receiving_currency", "'ACH' payment_format", "cast(id as double) amount_received", "'o' account_origin", "'d' account_destination", "'2022/09/01 00:00' ts")
    rows.repartition(4).write.parquet(f"{tmp_path}/t.parquet")
    return str(tmp_path)


def test_stream_equals_batch(spark, folder, rows):
    streamed = flows.run_available(flows.small_transfers(flows.table_stream(spark, folder, "t", files_per_batch=1)))
    assert rows(streamed) == rows(Q.q1(tables.table(spark, folder, "t")))
    averages = flows.run_available(flows.format_averages(flows.table_stream(spark, folder, "t", files_per_batch=1)), mode="complete")
    assert [tuple(r) for r in averages.select("payment_format", "n").collect()] == [("ACH", 40)]


def test_stream_once_with_null_ids(spark, tmp_path):
    spark.sql("select * from values ('c', '1', timestamp'2022-09-01 00:00:00'), ('c', '1', timestamp'2022-09-01 00:01:00'), ('d', '1', timestamp'2022-09-01 00:00:00'), ('c', null, timestamp'2022-09-01 00:00:00'), ('c', null, timestamp'2022-09-01 00:00:00') as t(client, id, at)").write.parquet(f"{tmp_path}/e.parquet")
    out = flows.run_available(flows.exactly_once(flows.table_stream(spark, str(tmp_path), "e"), "at", "1 hour", "client", "id"))
    assert sorted((r["client"], r["id"] or "") for r in out.collect()) == [("c", ""), ("c", ""), ("c", "1"), ("d", "1")]


def test_stream_into_a_seen_store(spark, tmp_path):
    for k, values in enumerate(("(1, 'a', timestamp'2022-09-01 00:00:00'), (2, 'a', timestamp'2022-08-31 00:00:00'), (3, 'b', timestamp'2022-09-01 00:00:00')", "(4, 'b', timestamp'2022-09-01 00:00:00'), (5, 'c', timestamp'2022-09-01 00:00:00'), (6, null, null)")):
        spark.sql(f"select cast(row_id as bigint) row_id, ident, at from values {values} as t(row_id, ident, at)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/m.parquet")
    store = dedup.SeenStore(spark, f"file://{tmp_path}/seen", shards=2)
    flows.ingest_batches(flows.table_stream(spark, str(tmp_path), "m", files_per_batch=1), store, f"{tmp_path}/log", f"{tmp_path}/kept").awaitTermination()
    kept = sorted(r["row_id"] for r in spark.read.parquet(f"{tmp_path}/kept").collect())
    assert len(kept) == 3 and len([c for c in store.commits().values() if c["batch"]]) == 2 and len({3, 4} & set(kept)) == 1 and 5 in kept


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = Q.q1(tables.table(spark, folder, "t"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(payment_currency,US Dollar)" in plan and "LessThan(amount_received,50.0)" in plan
    assert "row_id" not in plan.split("ReadSchema")[1]
