"""The five questions: boundary values, dirty rows, and the 20 000-row fixture."""

import pytest

from remitloom import params
from remitloom.operators import aggregates, filters, graph, joins
from remitloom.plans import questions as Q
from remitloom.sources import tables

TX = "ts string, from_bank string, account_origin string, to_bank string, account_destination string, amount_received double, receiving_currency string, amount_paid double, payment_currency string, payment_format string"
USD = "US Dollar"


def tx(spark, *changes):
    base = {"ts": "2022/09/02 00:00", "from_bank": "001", "account_origin": "A", "to_bank": "002", "account_destination": "B", "amount_received": 10.0, "receiving_currency": USD, "amount_paid": 10.0, "payment_currency": USD, "payment_format": "ACH"}
    return spark.createDataFrame([tuple({**base, **c}.values()) for c in changes], TX)


def rates(spark, *rows):
    return spark.createDataFrame([(c, d, r) for c, d, r in rows], "currency string, rate_day string, rate string").selectExpr("currency", "rate_day", "cast(rate as decimal(18,6)) rate")


def amounts(df):
    return sorted(r["amount_received"] for r in df.collect())


def test_q1_open_range_and_currencies(spark):
    values = [0.0, 0.01, 49.99, 50.0, float("nan"), None, -1.0]
    assert amounts(Q.q1(tx(spark, *[{"amount_received": v} for v in values]))) == [0.01, 49.99]
    one_sided = tx(spark, {"payment_currency": "Euro"}, {"receiving_currency": " US Dollar"}, {"payment_currency": None}, {"payment_format": "REINVESTMENT"}, {"payment_format": None}, {})
    assert Q.q1(one_sided).count() == 2  # the row without a format, and the plain one
    assert Q.q1(tx(spark, {}, {})).count() == 2  # repeated rows stay


def test_q2_ties_names_and_keys(spark):
    rows = tx(spark, {"from_bank": "007", "account_origin": "Z", "amount_received": 5.0}, {"from_bank": " 7", "account_origin": "M", "amount_received": 5.0}, {"from_bank": "8"}, {"from_bank": "9"}, {"from_bank": "x"}, {"from_bank": None}, {"from_bank": "10"}, {"from_bank": "7", "amount_received": float("nan")}, {"from_bank": "7", "amount_received": None})
    accounts = spark.createDataFrame([(1, "Seven", 7), (2, "Other", 7), (3, "", 8), (4, "Unknown", 9), (5, None, 10)], "account_row_id bigint, bank_name string, bank_id bigint")
    assert [tuple(r) for r in Q.q2(rows, accounts).collect()] == [("Seven", "M", 5.0)]
    assert Q.bank_names(accounts.drop("account_row_id").filter("bank_id = 7")).first()["bank_name"] == "Other"  # the smallest without an arrival order


def test_q3_threshold(spark):
    reference = [{"amount_received": 100.0}, {"amount_received": 300.0}, {"amount_received": float("nan")}, {"amount_received": 1e9, "ts": "2022/09/06 00:00"}]
    late = [{"ts": "2022/09/06 00:00", "amount_received": a} for a in (0.0, 1.99, 2.0)]
    late += [{"ts": "2022/09/15 23:59", "amount_received": 1.5}, {"ts": "2022/09/16 00:00", "amount_received": 1.0}, {"ts": "2022/09/07 00:00", "payment_format": "Wire", "amount_received": 1.0}, {"ts": "2022-09-07 00:00", "amount_received": 1.0}, {"ts": None, "amount_received": 1.0}]
    assert amounts(Q.q3(tx(spark, *reference, *late))) == [1.5, 1.99]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "o string, x string")


@pytest.mark.parametrize(("middles", "found"), [(4, 0), (5, 1)])
def test_q4_middles(spark, middles, found):
    rows = tx(spark, *[{"account_origin": "S", "account_destination": f"m{i}"} for i in range(middles)] * 2, *[{"account_origin": f"m{i}", "account_destination": "D"} for i in range(middles)])
    pairs = Q.q4(rows)
    assert [tuple(r) for r in pairs.collect()] == [("S", "D")] * found
    assert graph.flatten_pairs(pairs).count() == 2 * found


def test_q4_self_transfers_and_cycles(spark, rows):
    around = [("S", f"m{i}") for i in range(5)] + [(f"m{i}", "S") for i in range(5)]
    assert graph.scatter_gather_pairs(edges(spark, around)).count() == 0  # origin = destination
    own_middle = [("S", "S"), ("S", "D")] + [("S", f"m{i}") for i in range(4)] + [(f"m{i}", "D") for i in range(4)]
    assert rows(graph.scatter_gather_pairs(edges(spark, own_middle))) == [("S", "D", 5)]
    assert graph.scatter_gather_pairs(edges(spark, [])).count() == 0


def test_q4_against_brute_force(spark, rows):
    import random

    rng = random.Random(3)
    pairs = {(f"a{rng.randrange(30)}", f"a{rng.randrange(30)}") for _ in range(260)}
    wanted = []
    for a in {o for o, _ in pairs}:
        for b in {x for _, x in pairs}:
            middles = {m for o, m in pairs if o == a} & {m for m, x in pairs if x == b}
            if a != b and len(middles) >= 5:
                wanted.append((a, b, len(middles)))
    assert rows(graph.scatter_gather_pairs(edges(spark, sorted(pairs)))) == sorted(wanted, key=repr)


def test_q5_conversion(spark):
    table = rates(spark, ("Bitcoin", "2022-09-02", "20000"), ("Euro", None, "1.1"))
    hits = [{"amount_paid": 0.5}, {"amount_paid": 0.5, "payment_currency": " US Dollar "}, {"amount_paid": 0.5, "payment_currency": "USD"}, {"amount_paid": 0.00004, "payment_currency": "Bitcoin"}, {"amount_paid": 0.9, "payment_currency": "Euro", "payment_format": "Wire"}]
    misses = [{"amount_paid": 0.5, "payment_currency": "Yen"}, {"amount_paid": 1.0}, {"amount_paid": 0.0}, {"amount_paid": None}, {"amount_paid": float("nan")}, {"amount_paid": 0.95, "payment_currency": "Euro"}]
    misses += [{"amount_paid": 0.5, "payment_format": "Cash"}, {"amount_paid": 0.5, "payment_format": "ach"}, {"amount_paid": 0.5, "ts": "2022/09/06 00:00"}, {"amount_paid": 0.5, "ts": "bad"}, {"amount_paid": 0.5, "payment_currency": ""}]
    misses += [{"amount_paid": 0.00004, "payment_currency": "Bitcoin", "ts": "2022/09/03 00:00"}]
    rows = tx(spark, *hits, *misses)
    assert Q.q5(rows, table).first()["cantTrx"] == len(hits)
    assert Q.q5(rows.limit(0), table).first()["cantTrx"] == 0
    assert {r["payment_currency"]: r["n"] for r in Q.rejected_conversions(rows, table).collect()}["Yen"] == 1


def test_rates_keep_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = tx(spark, {"amount_paid": 2.0, "payment_currency": "Euro"}).withColumn("rate", F.lit(7)).withColumn("code", F.lit("c"))
    out = joins.to_usd(rows, rates(spark, ("Euro", "2022-09-02", "1.5"), ("EUR", "2022-09-02", "1.4"))).first()
    assert (out["usd_amt"], out["rate"], out["code"]) == (3.0, 7, "c")


def test_rate_keys_by_length(spark):
    table = tables.rates_from_mapping(spark, {"Euro": "1", "Euro|2022-09-02": "2", "Euro|USD|2022-09-02": "3", "Bitcoin|USD|2022-09-02": "5"})
    found = {(r["currency"], r["rate_day"]): float(r["rate"]) for r in table.collect()}
    assert found["Euro", "2022-09-02"] == 3 and found["Euro", None] == 1 and found["Bitcoin", "2022-09-02"] == 5 and found["Bitcoin", "2022-09-01"] == 19793.1


def test_day_branches(spark):
    days = ["2022/08/31", "2022/09/01", "2022/09/05", "2022/09/06", "2022/09/15", "2022/09/16"]
    rows = tx(spark, *[{"ts": f"{d} 10:00"} for d in days], {"ts": "2022/9/5 10:00"}, {"ts": None}, {"ts": "2022/09/05 10:00:30"})
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(filters.day_branch(F.col("ts"))).collect()] == ["out", "ref", "ref", "cand", "cand", "out", "out", "out", "ref"]
    assert filters.in_days(rows, "2022/09/01", "2022/09/05").count() == 3


def test_empty_tables(spark):
    empty, none = tx(spark), rates(spark)
    accounts = spark.createDataFrame([], "bank_name string, bank_id bigint")
    counts = {k: v.count() for k, v in Q.all_results(empty, accounts, none).items()}
    assert counts == {"query_1": 0, "query_2": 0, "query_3": 0, "query_4": 0, "query_5": 1}
    assert aggregates.count_rows(empty).first()["n"] == 0


def fixture_rows():
    """20 000 transfers: a scatter-gather pattern, seven tiny ones, eleven far below average, and filler."""
    out = []
    for i in range(1, 6):
        out.append(("2022/09/01 00:00", "SG_SOURCE", f"SG_MID_{i}", 100.0, 100.0, "ACH"))
        out.append(("2022/09/01 00:01", f"SG_MID_{i}", "SG_DEST", 100.0, 100.0, "ACH"))
    out += [("2022/09/02 00:00", f"Q5_LOW_{i:02}O", f"Q5_LOW_{i:02}D", 100.0, 0.5, "ACH" if i % 2 else "Wire") for i in range(1, 8)]
    out += [("2022/09/06 00:00", f"Q3_LOW_{i:02}O", f"Q3_LOW_{i:02}D", 0.5, 0.5, "ACH") for i in range(1, 12)]
    out += [(f"2022/10/{i % 28 + 1:02} 00:00", f"DEDUP{i:05}O", f"DEDUP{i:05}D", 1.0, 1.0, "ACH") for i in range(1, 20_000 - len(out) + 1)]
    return [(t, "001", o, "002", d, r, USD, p, USD, f) for t, o, d, r, p, f in out]


def test_the_large_fixture(spark):
    rows = spark.createDataFrame(fixture_rows(), TX)
    accounts = spark.createDataFrame([("Bank Alpha", 1), ("Bank Beta", 2)], "bank_name string, bank_id bigint")
    results = Q.all_results(rows, accounts, tables.rates_from_mapping(spark, {}))
    assert rows.count() == 20_000
    assert {k: v.count() for k, v in results.items()} == {"query_1": 19_983, "query_2": 1, "query_3": 11, "query_4": 1, "query_5": 1}
    assert results["query_5"].first()[0] == 7
    assert [tuple(r) for r in results["query_4"].collect()] == [("SG_SOURCE", "SG_DEST")]
    assert results["query_1"].distinct().count() == 19_983


def test_hubs_are_cut_into_blocks(spark, rows, monkeypatch):
    pairs = [(f"a{i}", "hub") for i in range(30)] + [("hub", f"b{i}") for i in range(25)] + [(f"a{i}", f"m{j}") for i in range(30) for j in range(4)] + [(f"m{j}", f"b{i}") for i in range(25) for j in range(4)]
    wanted = rows(graph.scatter_gather_pairs(edges(spark, pairs)))
    assert len(wanted) == 30 * 25 and {w[2] for w in wanted} == {5}
    monkeypatch.setattr(graph, "BLOCK_EDGES", 7)
    monkeypatch.setattr(graph, "TASK_PATHS", 100)
    assert rows(graph.scatter_gather_pairs(edges(spark, pairs))) == wanted
    first, second = (spark.createDataFrame(p, s) for p, s in (([(a, b) for a, b in pairs], "a string, middle string"), ([(a, b) for a, b in pairs], "middle string, b string")))
    assert graph.two_hop_paths(first, second).count() == graph.two_hop_paths(first, second).distinct().count() == 30 * 25 * 5


def test_clients_are_apart_and_absent_ids_stay(spark, rows):
    from remitloom.sources import envelopes

    schema = "delivery_id bigint, source_client_uuid string, message_type int, message_id string, payload string, delivered_at timestamp"
    at = [f"2022-09-01 00:0{i}:00" for i in range(6)]
    data = [(1, "A", 0, "7", '{"amount": 1.5}', at[2]), (2, "a", 0, "7", "{}", at[1]), (3, "b", 0, "7", None, at[0]), (4, "a", 1, "7", "[", at[0]), (5, "a", 0, None, "{}", at[0]), (6, "a", 0, None, "{}", at[0]), (7, "a", 0, "x:ACH", "{}", at[0]), (8, "a", 0, "x:ACH", "{}", at[0])]
    df = spark.createDataFrame([(*r[:5], None) for r in data], schema).drop("delivered_at").join(spark.createDataFrame([(r[0], r[5]) for r in data], "delivery_id bigint, t string").selectExpr("delivery_id", "cast(t as timestamp) as delivered_at"), "delivery_id")
    assert sorted(r["delivery_id"] for r in envelopes.once_per_client(df).collect()) == [2, 3, 4, 5, 6, 7]
    read = {r["delivery_id"]: r["data"]["amount"] if r["data"] else None for r in envelopes.with_payload(df).collect()}
    assert read[1] == 1.5 and {read[k] for k in (2, 3, 4)} == {None}
    back = envelopes.unpacked(envelopes.packed(df, "delivery_id", "payload"), "delivery_id bigint, payload string")
    assert rows(back) == rows(df.select("delivery_id", "payload"))
    assert envelopes.once_per_client(df.limit(0)).count() == 0


def test_rate_providers(spark, rows):
    quoted = spark.createDataFrame([("Euro", "2022-09-01", "1.1"), ("Bitcoin", "2022-09-01", "5")], "currency string, rate_day string, rate string").selectExpr("currency", "rate_day", "cast(rate as decimal(18,6)) rate")
    static = tables.rates_from_mapping(spark, {"Bitcoin|USD|2022-09-01": "7", "Euro": "2"}, builtin=False)
    assert [r[0] for r in rows(tables.provided_rates(quoted, static))] == ["Bitcoin", "Euro"]
    assert float(tables.provided_rates(quoted, static).filter("currency = 'Bitcoin'").first()["rate"]) == 7
    assert rows(tables.provided_rates(quoted, static, "static")) == rows(static)
    with pytest.raises(ValueError):
        tables.provided_rates(quoted, static, "other")


def test_other_parameters(spark):
    p = params.QueryParams(small_below=5.0, min_peers=1)
    assert Q.q1(tx(spark, {"amount_received": 4.0}, {"amount_received": 6.0}), p).count() == 1
    assert Q.q4(tx(spark, {"account_origin": "a", "account_destination": "b"}, {"account_origin": "b", "account_destination": "c"}), p).count() == 1
