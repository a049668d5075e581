"""Every registered query of the core, each with its SQL twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitloom.functions import scalars as X
from remitloom.operators import aggregates, dedup, filters, graph, hotkeys, joins, orphans, units
from remitloom.params import DEFAULTS as P
from remitloom.plans import questions as Q
from remitloom.sources import derived, envelopes, sinks
from remitloom.sources import tables as S
from remitloom.sources.shared import fresh_path, written
from remitloom.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def tx(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "bank_transactions")


def accounts(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "bank_accounts")


def rates(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "conversion_rates")


# ---- the SQL twins' shared parts -------------------------------------------------------------------------------------

_BANK = "CASE WHEN regexp_matches(trim(from_bank), '^[+-]?[0-9]+$') THEN try_cast(trim(from_bank) AS BIGINT) END"
_CODE = "CASE trim({c}) " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in X.CURRENCY_CODES.items()) + " WHEN '' THEN NULL ELSE trim({c}) END"
_BASE = "base AS (SELECT * FROM bank_transactions WHERE coalesce(lower(payment_format), '') <> 'reinvestment')"
_USD = _BASE + ", usd AS (SELECT * FROM base WHERE payment_currency = 'US Dollar' AND receiving_currency = 'US Dollar')"
_STAMP = "regexp_matches(substr(ts, 1, 16), '^[0-9]{4}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}$')"
_WIN = _USD + f", win AS (SELECT *, substr(ts, 1, 10) AS d FROM base WHERE {_STAMP}), usd_win AS (SELECT *, substr(ts, 1, 10) AS d FROM usd WHERE {_STAMP})"
_REF = "d BETWEEN '2022/09/01' AND '2022/09/05'"
_NAMES = "names AS (SELECT bank_id, arg_min(coalesce(bank_name, ''), account_row_id) AS bank_name FROM bank_accounts WHERE bank_id IS NOT NULL GROUP BY bank_id)"
_BEST = f"""best AS (SELECT from_bank, account_origin, amount_received FROM (
  SELECT *, row_number() OVER (PARTITION BY from_bank ORDER BY amount_received DESC, account_origin ASC NULLS FIRST) AS rn
  FROM (SELECT {_BANK} AS from_bank, account_origin, amount_received FROM usd)
  WHERE from_bank IS NOT NULL AND amount_received IS NOT NULL AND NOT isnan(amount_received)) WHERE rn = 1)"""
_AVGS = f"""avgs AS (SELECT payment_format, count(*) AS n, avg(amount_received) AS average FROM usd_win
  WHERE {_REF} AND payment_format <> '' AND amount_received IS NOT NULL AND NOT isnan(amount_received) GROUP BY payment_format)"""
_EDGES = f"edges AS (SELECT DISTINCT account_origin AS o, account_destination AS x FROM usd_win WHERE {_REF} AND account_origin IS NOT NULL AND account_destination IS NOT NULL)"
_FANS = "fo AS (SELECT o FROM edges GROUP BY o HAVING count(*) >= 5), fi AS (SELECT x FROM edges GROUP BY x HAVING count(*) >= 5)"
_PAIRS = _FANS + """, pairs AS (SELECT a.o AS account_origin, b.x AS account_destination, count(DISTINCT a.x) AS middles
  FROM edges a JOIN edges b ON a.x = b.o WHERE a.o IN (SELECT o FROM fo) AND b.x IN (SELECT x FROM fi) AND a.o <> b.x
  GROUP BY a.o, b.x HAVING count(DISTINCT a.x) >= 5)"""
_CONVERTED = f"""rates AS (SELECT {_CODE.format(c="currency")} AS code, rate_day, max(rate) AS rate FROM conversion_rates GROUP BY 1, 2),
  routed AS (SELECT *, {_CODE.format(c="payment_currency")} AS code FROM win WHERE {_REF} AND payment_format IN ('ACH', 'Wire')),
  converted AS (SELECT ts, account_origin, payment_format, r.code, CASE WHEN r.code = 'USD' THEN CASE WHEN NOT isnan(amount_paid) THEN amount_paid END
    WHEN isnan(amount_paid) THEN NULL ELSE CAST(CAST(amount_paid AS DECIMAL(20, 10)) * q.rate AS DOUBLE) END AS usd_amt
    FROM routed r LEFT JOIN rates q ON q.code = r.code AND q.rate_day = replace(d, '/', '-') WHERE r.code IS NOT NULL)"""
_Q1 = f"WITH {_USD} SELECT account_origin, account_destination, amount_received FROM usd WHERE amount_received > 0 AND amount_received < 50"
_Q3 = f"""WITH {_WIN}, {_AVGS} SELECT u.account_origin, u.amount_received FROM usd_win u JOIN avgs a USING (payment_format)
  WHERE d BETWEEN '2022/09/06' AND '2022/09/15' AND u.amount_received > 0 AND u.amount_received < a.average * 0.01"""

# ---- filters and routers ---------------------------------------------------------------------------------------------


@query("f1_not_reinvestment", f"WITH {_BASE} SELECT payment_format, count(*) AS n FROM base GROUP BY payment_format")
def _(spark, d):
    return aggregates.counts_by(filters.without_format(tx(spark, d)), "payment_format")


_P1 = ["from_bank", "account_origin", "account_destination", "amount_received", "receiving_currency", "payment_currency"]


_AMOUNT = "CASE WHEN NOT isnan(amount_received) THEN amount_received END"


@query("f2_usd_filter", f"WITH {_USD} SELECT {', '.join(_P1).replace('amount_received', _AMOUNT + ' AS amount_received')} FROM usd")
def _(spark, d):
    """All rows stay; an amount that is no number is NULL."""
    return Q.usd_rows(tx(spark, d)).select(*_P1).withColumn("amount_received", X.number(F.col("amount_received")))


@query("f5_date_split", f"""WITH {_BASE} SELECT CASE WHEN ts IS NULL OR NOT {_STAMP} THEN 'out' WHEN substr(ts, 1, 10) BETWEEN '2022/09/01' AND '2022/09/05' THEN 'ref'
  WHEN substr(ts, 1, 10) BETWEEN '2022/09/06' AND '2022/09/15' THEN 'cand' ELSE 'out' END AS label, count(*) AS n FROM base GROUP BY 1""")
def _(spark, d):
    return aggregates.counts_by(filters.without_format(tx(spark, d)), filters.day_branch(F.col("ts")).alias("label"))


@query("f6_amount_range", f"WITH {_USD} SELECT payment_format, count(*) AS n FROM usd WHERE amount_received > 0 AND amount_received < 50 GROUP BY payment_format")
def _(spark, d):
    return aggregates.counts_by(filters.open_range(Q.usd_rows(tx(spark, d)), "amount_received", P.small_above, P.small_below), "payment_format")


@query("f7_pay_format_route", f"""WITH {_WIN} SELECT payment_format, CASE WHEN {_CODE.format(c="payment_currency")} = 'USD' THEN 'direct' ELSE 'convert' END AS route, count(*) AS n
  FROM win WHERE {_REF} AND payment_format IN ('ACH', 'Wire') AND {_CODE.format(c="payment_currency")} IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    rows = filters.in_days(filters.without_format(tx(spark, d)), P.reference_from, P.reference_to)
    return aggregates.counts_by(filters.route_formats(rows), "payment_format", "route")


@query("f8_tiny_amounts", f"WITH {_WIN}, {_CONVERTED} SELECT payment_format, count(*) AS n FROM converted WHERE usd_amt > 0 AND usd_amt < 1 GROUP BY payment_format")
def _(spark, d):
    return aggregates.counts_by(filters.open_range(Q.converted(tx(spark, d), rates(spark, d)), "usd_amt", P.tiny_above, P.tiny_below), "payment_format")


@query("f10_self_pairs", f"""WITH {_WIN}, {_EDGES} SELECT count(*) FILTER (o <> x) AS between_accounts, count(*) FILTER (o = x) AS to_itself FROM edges""")
def _(spark, d):
    edges = graph.distinct_edges(Q.reference_usd(tx(spark, d)))
    return edges.agg(F.count(F.when(F.col("o") != F.col("x"), 1)).alias("between_accounts"), F.count(F.when(F.col("o") == F.col("x"), 1)).alias("to_itself"))


# ---- scalar functions ------------------------------------------------------------------------------------------------


@query("x7_currency_code", f"SELECT DISTINCT {_CODE.format(c='payment_currency')} AS code FROM bank_transactions")
def _(spark, d):
    return tx(spark, d).select(X.currency_code(F.col("payment_currency")).alias("code")).distinct()


@query("x8_static_only", "SELECT trim(payment_currency) IN ('Bitcoin', 'Ruble', 'Saudi Riyal') AS static_only, count(*) AS n FROM bank_transactions GROUP BY 1")
def _(spark, d):
    return aggregates.counts_by(tx(spark, d), X.is_static_only(F.col("payment_currency")).alias("static_only"))


@query("x9_conversion_key", f"""SELECT DISTINCT CASE WHEN {_CODE.format(c='payment_currency')} IS NOT NULL AND trim(ts) <> '' THEN
  {_CODE.format(c='payment_currency')} || '|USD|' || replace(substr(trim(ts), 1, 10), '/', '-') END AS conversion_key FROM bank_transactions""")
def _(spark, d):
    return tx(spark, d).select(X.conversion_key(F.col("payment_currency"), F.col("ts")).alias("conversion_key")).distinct()


@query("x10_to_usd", f"WITH {_WIN}, {_CONVERTED} SELECT ts, account_origin, round(usd_amt, 4) AS usd_amt FROM converted")
def _(spark, d):
    return Q.converted(tx(spark, d), rates(spark, d)).select("ts", "account_origin", F.round("usd_amt", 4).alias("usd_amt"))


# ---- aggregations ----------------------------------------------------------------------------------------------------


@query("a1_max_by_bank", f"WITH {_USD}, {_BEST} SELECT * FROM best")
def _(spark, d):
    return Q.largest_per_bank(tx(spark, d)).select("from_bank", "account_origin", "amount_received")


@query("a3_avg_by_format", f"WITH {_WIN}, {_AVGS} SELECT payment_format, n, round(average, 4) AS avg_amount FROM avgs")
def _(spark, d):
    return Q.format_averages(tx(spark, d)).select("payment_format", "n", F.round("average", 4).alias("avg_amount"))


@query("a4_fan_out", f"WITH {_WIN}, {_EDGES} SELECT o AS account, count(*) AS peers FROM edges GROUP BY o HAVING count(*) >= 5")
def _(spark, d):
    return aggregates.peers(graph.distinct_edges(Q.reference_usd(tx(spark, d))), "o", P.min_peers)


@query("a4_fan_in", f"WITH {_WIN}, {_EDGES} SELECT x AS account, count(*) AS peers FROM edges GROUP BY x HAVING count(*) >= 5")
def _(spark, d):
    return aggregates.peers(graph.distinct_edges(Q.reference_usd(tx(spark, d))), "x", P.min_peers)


@query("a5_pair_middles", f"WITH {_WIN}, {_EDGES}, {_PAIRS} SELECT * FROM pairs")
def _(spark, d):
    return Q.q4_pairs(tx(spark, d))


@query("a6_distinct_bank", "SELECT bank_id, nullif(arg_min(coalesce(bank_name, '~null~'), account_row_id), '~null~') AS bank_name FROM bank_accounts WHERE bank_id IS NOT NULL GROUP BY bank_id")
def _(spark, d):
    return Q.bank_names(accounts(spark, d))


@query("a7_global_count", f"WITH {_WIN}, {_CONVERTED} SELECT count(*) AS n FROM converted WHERE usd_amt > 0 AND usd_amt < 1")
def _(spark, d):
    return Q.q5(tx(spark, d), rates(spark, d)).withColumnRenamed("cantTrx", "n")


@query("a7_global_count_empty", "SELECT count(*) AS n FROM bank_transactions WHERE payment_format = 'no such format'")
def _(spark, d):
    return aggregates.count_rows(tx(spark, d).filter(F.col("payment_format") == "no such format"))


@query("a8_result_counts", f"""WITH {_WIN}, {_AVGS}, {_NAMES}, {_BEST}, {_EDGES}, {_PAIRS}
  SELECT 'query_1' AS query, count(*) AS n FROM usd WHERE amount_received > 0 AND amount_received < 50
  UNION ALL SELECT 'query_2', count(*) FROM best JOIN names ON from_bank = bank_id WHERE bank_name NOT IN ('', 'Unknown')
  UNION ALL SELECT 'query_3', count(*) FROM usd_win u JOIN avgs a USING (payment_format) WHERE d BETWEEN '2022/09/06' AND '2022/09/15' AND u.amount_received > 0 AND u.amount_received < a.average * 0.01
  UNION ALL SELECT 'query_4', 2 * count(*) FROM pairs UNION ALL SELECT 'query_5', 1""")
def _(spark, d):
    results = Q.all_results(tx(spark, d), accounts(spark, d), rates(spark, d))
    results["query_4"] = graph.flatten_pairs(results["query_4"])
    counted = [df.agg(F.lit(name).alias("query"), F.count(F.lit(1)).alias("n")) for name, df in results.items()]
    out = counted[0]
    for one in counted[1:]:
        out = out.unionByName(one)
    return out


# ---- joins -----------------------------------------------------------------------------------------------------------


@query("j1_bank_name_join", f"WITH {_USD}, {_BEST}, {_NAMES} SELECT from_bank, bank_name, account_origin, amount_received FROM best JOIN names ON from_bank = bank_id WHERE bank_name NOT IN ('', 'Unknown')")
def _(spark, d):
    named = joins.named_banks(Q.largest_per_bank(tx(spark, d)), Q.bank_names(accounts(spark, d)), "from_bank", P.unnamed_bank)
    return named.select("from_bank", "bank_name", "account_origin", "amount_received")


@query("j2_threshold_join", _Q3.replace("SELECT u.account_origin, u.amount_received", "SELECT payment_format, u.account_origin, u.amount_received"))
def _(spark, d):
    return Q.far_below_average(tx(spark, d)).select("payment_format", "account_origin", "amount_received")


@query("j3_two_hop", f"""WITH {_WIN}, {_EDGES}, {_FANS} SELECT a.x AS middle, count(*) AS paths FROM edges a JOIN edges b ON a.x = b.o
  WHERE a.o IN (SELECT o FROM fo) AND b.x IN (SELECT x FROM fi) GROUP BY a.x""")
def _(spark, d):
    edges = written(graph.distinct_edges(Q.reference_usd(tx(spark, d))), "edges")
    first = graph.qualified_edges(edges, "o", P.min_peers).select(F.col("o").alias("a"), F.col("x").alias("middle"))
    second = graph.qualified_edges(edges, "x", P.min_peers).select(F.col("o").alias("middle"), F.col("x").alias("b"))
    return graph.two_hop_paths(first, second).groupBy("middle").agg(F.count(F.lit(1)).alias("paths"))


@query("j4_semi", f"WITH {_WIN}, {_EDGES}, {_FANS} SELECT o, x FROM edges WHERE o IN (SELECT o FROM fo)")
def _(spark, d):
    return graph.qualified_edges(graph.distinct_edges(Q.reference_usd(tx(spark, d))), "o", P.min_peers)


@query("j5_rate_lookup", f"WITH {_WIN}, {_CONVERTED} SELECT code, usd_amt IS NOT NULL AS converted, count(*) AS n FROM converted GROUP BY 1, 2")
def _(spark, d):
    rows = Q.converted(tx(spark, d), rates(spark, d))
    return aggregates.counts_by(rows, X.currency_code(F.col("payment_currency")).alias("code"), F.col("usd_amt").isNotNull().alias("converted"))


# ---- sets, projections, streams --------------------------------------------------------------------------------------


@query("u1_union_all", f"""WITH {_WIN}, {_CONVERTED} SELECT CASE WHEN code = 'USD' THEN 'direct' ELSE 'convert' END AS branch, count(*) AS n FROM converted GROUP BY 1""")
def _(spark, d):
    rows = Q.converted(tx(spark, d), rates(spark, d))
    direct = rows.filter("route = 'direct'").select(F.lit("direct").alias("branch"))
    return aggregates.counts_by(direct.unionByName(rows.filter("route = 'convert'").select(F.lit("convert").alias("branch"))), "branch")


@query("g_final_types", f"WITH {_USD} SELECT account_origin, coalesce({_AMOUNT}, 0) AS amount_received FROM usd")
def _(spark, d):
    """Final amounts: what is no number counts as 0, and no row is lost."""
    return Q.usd_rows(tx(spark, d)).select("account_origin", F.coalesce(X.number(F.col("amount_received")), F.lit(0.0)).alias("amount_received"))


@query("t3_dedup", "SELECT row_id, transfer_id FROM bank_transactions")
def _(spark, d):
    rows = tx(spark, d).select("row_id", "transfer_id")
    sent = dedup.with_injected_copies(rows, F.col("row_id") % 3 == 0, 4)
    return dedup.drop_repeats(sent, "row_id", "transfer_id")


@query("q1", _Q1)
def _(spark, d):
    return Q.q1(tx(spark, d))


@query("q2", f"WITH {_USD}, {_BEST}, {_NAMES} SELECT bank_name, account_origin, amount_received FROM best JOIN names ON from_bank = bank_id WHERE bank_name NOT IN ('', 'Unknown')")
def _(spark, d):
    return Q.q2(tx(spark, d), accounts(spark, d))


@query("q3", _Q3)
def _(spark, d):
    return Q.q3(tx(spark, d))


@query("q4", f"WITH {_WIN}, {_EDGES}, {_PAIRS} SELECT account_origin, account_destination FROM pairs")
def _(spark, d):
    return Q.q4(tx(spark, d))


@query("q4_accounts", f"WITH {_WIN}, {_EDGES}, {_PAIRS} SELECT account_origin AS account FROM pairs UNION ALL SELECT account_destination FROM pairs")
def _(spark, d):
    return graph.flatten_pairs(Q.q4(tx(spark, d)))


@query("q5", f'WITH {_WIN}, {_CONVERTED} SELECT count(*) AS "cantTrx" FROM converted WHERE usd_amt > 0 AND usd_amt < 1')
def _(spark, d):
    return Q.q5(tx(spark, d), rates(spark, d))


@query("s_csv_roundtrip", _Q1)
def _(spark, d):
    path = fresh_path(spark, "csv")
    tx(spark, d).select(*[F.col(c) for c in S.schemas.TRANSACTION_COLUMNS], "is_laundering").write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return Q.q1(S.transactions_csv(spark, path))


@query("s_summary", SQL["a8_result_counts"])
def _(spark, d):
    results = Q.all_results(tx(spark, d), accounts(spark, d), rates(spark, d))
    summary = sinks.write_results(results, fresh_path(spark, "results"))
    return spark.createDataFrame(list(summary["result_counts_by_type"].items()), "query string, n bigint")


@query("t_stream_q1", _Q1)
def _(spark, d):
    return flows.run_available(flows.small_transfers(flows.table_stream(spark, d, "bank_transactions")))


@query("t_stream_averages", SQL["a3_avg_by_format"])
def _(spark, d):
    out = flows.run_available(flows.format_averages(flows.table_stream(spark, d, "bank_transactions")), mode="complete")
    return out.select("payment_format", "n", F.round("average", 4).alias("avg_amount"))


@query("t_stream_count", f"WITH {_USD} SELECT count(*) AS n FROM usd")
def _(spark, d):
    return flows.run_available(aggregates.count_rows(Q.usd_rows(flows.table_stream(spark, d, "bank_transactions"))), mode="complete")


# ---- the five questions over transactions derived from the order tables -------------------------------------------------

_PRICE = "CAST(l_extendedprice AS DOUBLE) / CASE l_linenumber " + " ".join(f"WHEN {i} THEN 1e{i - 1}" for i in range(1, 7)) + " ELSE 1e6 END"
_PAID = "CASE WHEN l_suppkey % 5 = 3 THEN 'Bitcoin' WHEN l_suppkey % 5 = 4 THEN 'Saudi Riyal' ELSE 'US Dollar' END"
_VIEW = f"""k AS (SELECT greatest(count(*) // 125, 1) AS k FROM orders),
  derived AS (SELECT '2022/09/' || lpad(CAST(1 + l_orderkey % 20 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(l_partkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS ts,
  lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS from_bank, 'A' || lpad(CAST(o_custkey % (SELECT k FROM k) AS VARCHAR), 5, '0') AS account_origin,
  'A' || lpad(CAST((l_partkey * 7 + l_suppkey) % (SELECT k FROM k) AS VARCHAR), 5, '0') AS account_destination, {_PRICE} AS amount_received, {_PRICE} AS amount_paid,
  CASE WHEN l_partkey % 10 = 0 THEN 'Euro' ELSE {_PAID} END AS receiving_currency, {_PAID} AS payment_currency,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Wire' WHEN '2' THEN 'ACH' WHEN '3' THEN 'Cheque' WHEN '4' THEN 'Credit Card' ELSE 'Reinvestment' END AS payment_format
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
_STATIC = "conversion_rates_static AS (SELECT * FROM (VALUES " + ", ".join(f"('{k.split('|')[0]}', '{k.split('|')[2]}', CAST('{v}' AS DECIMAL(18, 6)))" for k, v in derived.STATIC_RATES.items()) + ") AS t(currency, rate_day, rate))"
_NATIONS = "names AS (SELECT n_nationkey AS bank_id, n_name AS bank_name FROM nation WHERE n_nationkey <> 24)"


def _over_view(sql: str) -> str:
    """The SQL of a question with the derived tables in place of the transactions, names and rates."""
    sql = sql.replace("WITH ", f"WITH {_VIEW}, {_STATIC}, ", 1).replace("FROM bank_transactions", "FROM derived")
    return sql.replace("FROM conversion_rates ", "FROM conversion_rates_static ").replace(_NAMES, _NATIONS)


def _derived(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return derived.transactions(spark, d), derived.accounts(spark, d), S.rates_from_mapping(spark, derived.STATIC_RATES)


@query("v_q1", _over_view(SQL["q1"]))
def _(spark, d):
    return Q.q1(_derived(spark, d)[0])


@query("v_q2", _over_view(SQL["q2"]))
def _(spark, d):
    return Q.q2(*_derived(spark, d)[:2])


@query("v_q3", _over_view(SQL["q3"]))
def _(spark, d):
    return Q.q3(_derived(spark, d)[0])


@query("v_q4", _over_view(SQL["q4"]))
def _(spark, d):
    return Q.q4(_derived(spark, d)[0])


@query("v_pair_middles", _over_view(SQL["a5_pair_middles"]))
def _(spark, d):
    return Q.q4_pairs(_derived(spark, d)[0])


@query("v_q4_accounts", _over_view(SQL["q4_accounts"]))
def _(spark, d):
    return graph.flatten_pairs(Q.q4(_derived(spark, d)[0]))


@query("v_q5", _over_view(SQL["q5"]))
def _(spark, d):
    rows, _, static = _derived(spark, d)
    return Q.q5(rows, static)


# ---- data processing -------------------------------------------------------------------------------------------------


@query("p1_found")
def _(spark, d):
    out = units.to_common_units(S.table(spark, d, "raw_transfers"), S.table(spark, d, "feed_profiles"), rates(spark, d))
    return out.select("raw_id", "usd_cents")


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "message_deliveries")
    ident = dedup.message_identity(F.col("source_client_uuid"), F.col("message_type"), F.col("message_id"), F.col("data_id"))
    return rows.select(F.col("delivery_id").alias("row_id"), ident.alias("ident"), F.col("delivered_at").alias("at"))


_IDENT = """CASE WHEN {i} IS NULL THEN NULL WHEN regexp_matches({i}, '^\\s*[+-]?[0-9]+\\s*$') THEN
  CAST(CAST(trim({i}) AS HUGEINT) AS VARCHAR) ELSE {i} END"""


@query("p2_found", f"""SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY lower(source_client_uuid), message_type, message_id IS NULL,
  coalesce({_IDENT.format(i="message_id")}, {_IDENT.format(i="data_id")}) ORDER BY delivered_at, delivery_id) AS rn FROM message_deliveries
  WHERE message_id IS NOT NULL OR data_id IS NOT NULL) WHERE rn > 1""")
def _(spark, d):
    rows = arrivals(spark, d)
    seen = dedup.SeenStore(spark, fresh_path(spark, "seen"), dedup.shards_for(rows.count()))
    return dedup.surplus(rows, dedup.ingest_in_order(seen, rows)).select(F.col("row_id").alias("delivery_id"))


def _by_bank(spark: SparkSession, d: str, value) -> DataFrame:
    return hotkeys.weighted_values(tx(spark, d), X.bank_number(F.col("from_bank")), value)


@query("p3_found", f"SELECT bank_id FROM (SELECT {_BANK} AS bank_id, count(*) AS n FROM bank_transactions GROUP BY 1) WHERE bank_id IS NOT NULL AND n * 100 >= 2 * (SELECT count(*) FROM bank_transactions)")
def _(spark, d):
    total = tx(spark, d).agg(F.count(F.lit(1)).alias("n"))
    weighted = _by_bank(spark, d, F.col("payment_currency"))
    return hotkeys.keys_with_share(weighted, total, 2).select(F.col("key").alias("bank_id"))


@query("p3_bank_profile", f"""WITH t AS (SELECT {_BANK} AS bank_id, CASE WHEN NOT isnan(amount_received) THEN amount_received END AS v FROM bank_transactions),
  c AS (SELECT bank_id, v, count(*) AS n FROM t WHERE bank_id IS NOT NULL GROUP BY 1, 2),
  m AS (SELECT bank_id, v AS mode_amount, n AS mode_rows, row_number() OVER (PARTITION BY bank_id ORDER BY n DESC, v) AS rn FROM c WHERE v IS NOT NULL),
  r AS (SELECT bank_id, v, sum(n) OVER (PARTITION BY bank_id ORDER BY v) AS upto, sum(n) OVER (PARTITION BY bank_id) AS total FROM c WHERE v IS NOT NULL),
  p AS (SELECT bank_id, min(v) FILTER (upto >= greatest(ceil(total * 0.5), 1)) AS p50, min(v) FILTER (upto >= greatest(ceil(total * 0.95), 1)) AS p95 FROM r GROUP BY 1)
  SELECT b.bank_id, n_rows, n_amounts, mode_amount, mode_rows, p50, p95 FROM (SELECT bank_id, CAST(sum(n) AS BIGINT) AS n_rows, count(v) AS n_amounts FROM c GROUP BY 1) b
  LEFT JOIN m ON m.bank_id = b.bank_id AND rn = 1 LEFT JOIN p ON p.bank_id = b.bank_id""")
def _(spark, d):
    out = hotkeys.profile(_by_bank(spark, d, X.number(F.col("amount_received"))), {"p50": 0.5, "p95": 0.95})
    return out.select(F.col("key").alias("bank_id"), "n_rows", F.col("n_distinct").alias("n_amounts"), F.col("mode").alias("mode_amount"), "mode_rows", "p50", "p95")


def all_orphans(spark: SparkSession, d: str) -> DataFrame:
    """References of transactions and accounts that find no valid target, with table, field and day."""
    t, a, b = tx(spark, d), accounts(spark, d), S.table(spark, d, "bank_directory")
    bank = F.col("from_bank")
    stated = F.when(X.strip(bank) != "", F.coalesce(X.bank_number(bank).cast("string"), F.concat(F.lit("text "), bank)))
    name = X.plain_name(F.col("bank_name"))
    valid = [F.col("loaded_at").alias("valid_from")]
    banks = b.select(F.col("bank_id").cast("string").alias("k"), X.plain_name(F.col("bank_name")).alias("nm"), *valid, F.col("withdrawn_at").alias("valid_to"))
    numbers = a.select(F.col("account_number").alias("k"), *valid, F.col("closed_at").alias("valid_to"))
    account = F.col("account_origin")
    sent = t.select(F.col("row_id").alias("row_key"), F.col("loaded_at").alias("at"), stated.alias("bank"), F.when(X.strip(account) != "", account).alias("account"))
    held = a.select(F.col("account_row_id").alias("row_key"), F.col("loaded_at").alias("at"), F.when(~name.isin("", "unknown"), name).alias("name"))
    found = {
        "bank_transactions": orphans.find_all_orphans(sent, {"from_bank": orphans.Reference(["bank"], banks, target_keys=["k"]), "account_origin": orphans.Reference(["account"], numbers, target_keys=["k"])}),
        "bank_accounts": orphans.find_all_orphans(held, {"bank_name": orphans.Reference(["name"], banks, target_keys=["nm"])}),
    }
    named = [one.select(F.lit(table).alias("ref_table"), "ref_field", "row_key", "orphan_kind", F.date_format("at", "yyyy-MM-dd").alias("ref_period")) for table, one in found.items()]
    return named[0].unionByName(named[1])


_ORPHANS = f"""WITH refs AS (
  SELECT 'bank_transactions' AS ref_table, 'from_bank' AS ref_field, row_id AS row_key, loaded_at AS t, coalesce(CAST({_BANK} AS VARCHAR), 'text ' || from_bank) AS k FROM bank_transactions WHERE trim(from_bank) <> ''
  UNION ALL SELECT 'bank_transactions', 'account_origin', row_id, loaded_at, account_origin FROM bank_transactions WHERE trim(account_origin) <> ''
  UNION ALL SELECT 'bank_accounts', 'bank_name', account_row_id, loaded_at, k FROM (SELECT *, lower(trim(regexp_replace(bank_name, '\\s+', ' ', 'g'))) AS k FROM bank_accounts) WHERE k NOT IN ('', 'unknown')),
  targets AS (SELECT 'from_bank' AS ref_field, CAST(bank_id AS VARCHAR) AS k, loaded_at AS f, withdrawn_at AS u FROM bank_directory
  UNION ALL SELECT 'account_origin', account_number, loaded_at, closed_at FROM bank_accounts
  UNION ALL SELECT 'bank_name', lower(trim(regexp_replace(bank_name, '\\s+', ' ', 'g'))), loaded_at, withdrawn_at FROM bank_directory),
  j AS (SELECT r.ref_table, r.ref_field, r.row_key, r.t, count(g.k) AS n, count(*) FILTER (g.f <= r.t) AS came, count(*) FILTER (g.f <= r.t AND (g.u IS NULL OR g.u > r.t)) AS ok
  FROM refs r LEFT JOIN targets g ON g.ref_field = r.ref_field AND g.k = r.k GROUP BY 1, 2, 3, 4),
  o AS (SELECT ref_table, ref_field, row_key, CASE WHEN n = 0 THEN 'missing' WHEN came > 0 THEN 'deleted' ELSE 'late' END AS orphan_kind, strftime(t, '%Y-%m-%d') AS ref_period FROM j WHERE ok = 0)"""


@query("p5_found", _ORPHANS + " SELECT * FROM o")
def _(spark, d):
    return all_orphans(spark, d)


@query("p5_orphan_report", _ORPHANS + " SELECT ref_table, ref_field, orphan_kind, ref_period, count(*) AS n_orphans FROM o GROUP BY ALL")
def _(spark, d):
    return orphans.by_period(all_orphans(spark, d))


# ---- composite references with partial nulls ---------------------------------------------------------------------------


def composite_orphans(spark: SparkSession, d: str, match: str) -> DataFrame:
    """References (from_bank, account_origin) of transactions to accounts (bank_id, account_number), either part maybe absent."""
    rows = tx(spark, d).select(F.col("row_id").alias("row_key"), F.col("loaded_at").alias("at"), X.bank_number(F.col("from_bank")).alias("bank"), F.when(X.strip(F.col("account_origin")) != "", F.col("account_origin")).alias("account"))
    targets = accounts(spark, d).select("bank_id", "account_number", F.col("loaded_at").alias("valid_from"), F.col("closed_at").alias("valid_to"))
    out = orphans.find_all_orphans(rows, {"bank and account": orphans.Reference(["bank", "account"], targets, match, ["bank_id", "account_number"])})
    return out.select("row_key", "orphan_kind")


def _composite_sql(match: str) -> str:
    partly = "" if match == "partial" else " AND b IS NOT NULL AND c IS NOT NULL"
    some = "UNION ALL SELECT row_key, 'missing' FROM r WHERE (b IS NULL) <> (c IS NULL)" if match == "full" else ""
    return f"""WITH r AS (SELECT row_id AS row_key, loaded_at AS t, {_BANK} AS b, CASE WHEN trim(account_origin) <> '' THEN account_origin END AS c FROM bank_transactions),
  both_stated AS (SELECT row_key, count(g.account_row_id) AS n, count(*) FILTER (g.loaded_at <= t) AS came, count(*) FILTER (g.loaded_at <= t AND (g.closed_at IS NULL OR g.closed_at > t)) AS ok
    FROM r LEFT JOIN bank_accounts g ON g.bank_id = b AND g.account_number = c WHERE b IS NOT NULL AND c IS NOT NULL GROUP BY row_key),
  only_bank AS (SELECT row_key, t, b FROM r WHERE b IS NOT NULL AND c IS NULL{partly}), only_account AS (SELECT row_key, t, c FROM r WHERE c IS NOT NULL AND b IS NULL{partly}),
  one_stated AS (SELECT row_key, count(g.account_row_id) AS n, count(*) FILTER (g.loaded_at <= t) AS came, count(*) FILTER (g.loaded_at <= t AND (g.closed_at IS NULL OR g.closed_at > t)) AS ok
    FROM only_bank LEFT JOIN bank_accounts g ON g.bank_id = b GROUP BY row_key
    UNION ALL SELECT row_key, count(g.account_row_id), count(*) FILTER (g.loaded_at <= t), count(*) FILTER (g.loaded_at <= t AND (g.closed_at IS NULL OR g.closed_at > t))
    FROM only_account LEFT JOIN bank_accounts g ON g.account_number = c GROUP BY row_key)
  SELECT row_key, CASE WHEN n = 0 THEN 'missing' WHEN came > 0 THEN 'deleted' ELSE 'late' END AS orphan_kind FROM (SELECT * FROM both_stated UNION ALL SELECT * FROM one_stated) WHERE ok = 0 {some}"""


@query("p5_composite_partial", _composite_sql("partial"))
def _(spark, d):
    return composite_orphans(spark, d, "partial")


@query("p5_composite_full", _composite_sql("full"))
def _(spark, d):
    return composite_orphans(spark, d, "full")


# ---- clients, envelopes, rate sources, shards ----------------------------------------------------------------------------


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "message_deliveries")


_ONCE = """once AS (SELECT *, lower(source_client_uuid) AS client FROM message_deliveries WHERE message_id IS NULL OR delivery_id IN (SELECT delivery_id FROM
  (SELECT delivery_id, row_number() OVER (PARTITION BY lower(source_client_uuid), message_type, message_id ORDER BY delivered_at, delivery_id) AS rn FROM message_deliveries WHERE message_id IS NOT NULL) WHERE rn = 1))"""


@query("t3_envelopes", f"WITH {_ONCE} SELECT client, message_type, message_id IS NULL AS without_id, count(*) AS n FROM once GROUP BY 1, 2, 3")
def _(spark, d):
    return aggregates.counts_by(envelopes.once_per_client(deliveries(spark, d)), "client", "message_type", F.col("message_id").isNull().alias("without_id"))


@query("t3_stream_envelopes", SQL["t3_envelopes"])
def _(spark, d):
    """The same from a stream: copies within the watermark, which here spans the whole table, come once."""
    stream = flows.table_stream(spark, d, "message_deliveries").selectExpr("lower(source_client_uuid) AS client", "message_type", "message_id", "CAST(delivered_at AS TIMESTAMP) AS at")
    out = flows.run_available(flows.exactly_once(stream, "at", "3650 days", "client", "message_type", "message_id"))
    return aggregates.counts_by(out, "client", "message_type", F.col("message_id").isNull().alias("without_id"))


@query("t13_clients", f"""WITH {_ONCE}, p AS (SELECT client, CAST(json_extract(payload, '$.amount') AS DOUBLE) AS amount, json_extract_string(payload, '$.payment_currency') AS c FROM once)
  SELECT client, count(*) AS messages, count(*) FILTER (c = 'US Dollar' AND amount > 0 AND amount < 50) AS small_transfers, max(amount) AS largest FROM p GROUP BY client""")
def _(spark, d):
    """Every client's own results: all grouping keys, and the repeats, are the client's."""
    rows = envelopes.with_payload(envelopes.once_per_client(deliveries(spark, d)))
    small = (F.col("data.payment_currency") == P.usd_name) & (F.col("data.amount") > P.small_above) & (F.col("data.amount") < P.small_below)
    return rows.groupBy("client").agg(F.count(F.lit(1)).alias("messages"), F.count(F.when(small, 1)).alias("small_transfers"), F.max("data.amount").alias("largest"))


@query("x15_envelopes", """SELECT delivery_id, message_type, message_id, json_extract_string(payload, '$.account_origin') AS account_origin, CAST(json_extract(payload, '$.amount') AS DOUBLE) AS amount FROM message_deliveries""")
def _(spark, d):
    """Envelopes to JSON in base64 and back, and their payloads read."""
    columns = ["delivery_id", "message_type", "message_id", "payload"]
    back = envelopes.unpacked(envelopes.packed(deliveries(spark, d), *columns), "delivery_id bigint, message_type int, message_id string, payload string")
    return envelopes.with_payload(back).select("delivery_id", "message_type", "message_id", "data.account_origin", "data.amount")


@query("s2_accounts_csv", "SELECT bank_id, bank_name, account_number FROM bank_accounts")
def _(spark, d):
    path = fresh_path(spark, "csv")
    rows = accounts(spark, d).select(*[f.name for f in S.schemas.ACCOUNTS_CSV])
    rows.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"').csv(path)
    return S.accounts_csv(spark, path).select("bank_id", "bank_name", "account_number")


_STATIC_ROWS = "SELECT currency, rate_day, rate FROM conversion_rates_static"


@query("s9_rates_json", f"WITH {_STATIC} {_STATIC_ROWS}")
def _(spark, d):
    import json

    path = fresh_path(spark, "rates")
    spark.createDataFrame([(json.dumps(derived.STATIC_RATES),)], "value string").coalesce(1).write.text(path)
    return S.rates_json(spark, path)


_LEVELS = {"Euro|USD|2022-09-01": "1.01", "Euro|2022-09-02": "1.02", "Euro": "1.03", "Yen": "0.007", "UK Pound|2022-09-01": "1.2"}


@query("j5_rate_levels", """WITH r AS (SELECT trim(payment_currency) AS currency, replace(substr(ts, 1, 10), '/', '-') AS d FROM bank_transactions WHERE trim(payment_currency) IN ('Euro', 'Yen', 'UK Pound', 'US Dollar') AND ts IS NOT NULL)
  SELECT currency, CASE currency WHEN 'US Dollar' THEN 1 WHEN 'Euro' THEN CASE d WHEN '2022-09-01' THEN 1.01 WHEN '2022-09-02' THEN 1.02 ELSE 1.03 END WHEN 'Yen' THEN 0.007
    WHEN 'UK Pound' THEN CASE d WHEN '2022-09-01' THEN 1.2 END END::DOUBLE AS rate, count(*) AS n FROM r GROUP BY 1, 2""")
def _(spark, d):
    """All levels of the lookup: a rate of the day under either key, one for every day, and none."""
    rows = tx(spark, d).filter("ts IS NOT NULL").select(X.strip(F.col("payment_currency")).alias("currency"), "ts").filter(F.col("currency").isin("Euro", "Yen", "UK Pound", "US Dollar"))
    rated = joins.with_rate(rows, S.rates_from_mapping(spark, _LEVELS, builtin=False), "currency")
    return aggregates.counts_by(rated, "currency", F.col("rate").cast("double").alias("rate"))


@query("x11_quoted_rates", f"WITH {_STATIC} SELECT currency, rate_day, rate FROM conversion_rates WHERE trim(currency) NOT IN ('Bitcoin', 'Ruble', 'Saudi Riyal') UNION ALL {_STATIC_ROWS} WHERE currency IN ('Bitcoin', 'Ruble', 'Saudi Riyal')")
def _(spark, d):
    return S.provided_rates(rates(spark, d), S.rates_from_mapping(spark, derived.STATIC_RATES), "quoted")


@query("x11_static_rates", SQL["s9_rates_json"])
def _(spark, d):
    return S.provided_rates(rates(spark, d), S.rates_from_mapping(spark, derived.STATIC_RATES), "static")


@query("x13_stable_shard")
def _(spark, d):
    bank = X.bank_number(F.col("from_bank"))
    return tx(spark, d).select(bank.alias("bank_id"), X.stable_shard(bank, 7).alias("shard")).distinct()


@query("x14_digest_shard", "SELECT DISTINCT account_origin, CAST('0x' || substr(sha256(account_origin), 64, 1) AS INTEGER) AS shard FROM bank_transactions WHERE account_origin IS NOT NULL")
def _(spark, d):
    rows = tx(spark, d).select("account_origin").filter("account_origin IS NOT NULL").distinct()
    return rows.select("account_origin", X.digest_shard(F.col("account_origin"), 16).cast("int").alias("shard"))


@query("fa_result_counts", "SELECT * FROM (VALUES ('query_1', 19983), ('query_2', 1), ('query_3', 11), ('query_4', 2), ('query_5', 7)) AS t(query, n)")
def _(spark, d):
    """The five questions over a pattern with known answers; of the last its answer instead of its one row."""
    results = Q.all_results(derived.pattern_transactions(spark), derived.pattern_accounts(spark), S.rates_from_mapping(spark, derived.STATIC_RATES))
    results["query_4"] = graph.flatten_pairs(results["query_4"])
    counted = [df.agg(F.lit(name).alias("query"), (F.sum("cantTrx") if name == "query_5" else F.count(F.lit(1))).alias("n")) for name, df in results.items()]
    out = counted[0]
    for one in counted[1:]:
        out = out.unionByName(one)
    return out


@query("fa_pair_middles", "SELECT 'SG_SOURCE' AS account_origin, 'SG_DEST' AS account_destination, 5 AS middles")
def _(spark, d):
    return Q.q4_pairs(derived.pattern_transactions(spark))
