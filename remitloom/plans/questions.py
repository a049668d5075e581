"""The five questions over transactions, accounts and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitloom.functions import scalars as X
from remitloom.operators import aggregates, filters, graph, joins
from remitloom.params import DEFAULTS, QueryParams
from remitloom.sources.shared import written


def usd_rows(tx: DataFrame, p: QueryParams = DEFAULTS) -> DataFrame:
    return filters.both_currencies(filters.without_format(tx, p.excluded_format), p.usd_name)


def reference_usd(tx: DataFrame, p: QueryParams = DEFAULTS) -> DataFrame:
    return filters.in_days(usd_rows(tx, p), p.reference_from, p.reference_to)


def q1(tx: DataFrame, p: QueryParams = DEFAULTS) -> DataFrame:
    """Dollar-to-dollar transfers with ``0 < amount_received < 50``; a multiset, repeated rows stay."""
    return filters.open_range(usd_rows(tx, p), "amount_received", p.small_above, p.small_below).select("account_origin", "account_destination", "amount_received")


def bank_names(accounts: DataFrame) -> DataFrame:
    """(bank_id, bank_name): the name that arrived first; by ``account_row_id`` where there is one."""
    return aggregates.first_per_key(accounts, "bank_id", "bank_name", "account_row_id" if "account_row_id" in accounts.columns else None)


def largest_per_bank(tx: DataFrame, p: QueryParams = DEFAULTS) -> DataFrame:
    return aggregates.max_by_key(usd_rows(tx, p), X.bank_number(F.col("from_bank")), "amount_received", "account_origin", "from_bank")


def q2(tx: DataFrame, accounts: DataFrame, p: QueryParams = DEFAULTS) -> DataFrame:
    """Per origin bank the largest dollar-to-dollar transfer, with the bank's name; unnamed banks drop out."""
    named = joins.named_banks(largest_per_bank(tx, p), bank_names(accounts), "from_bank", p.unnamed_bank)
    return named.select("bank_name", "account_origin", "amount_received")


def format_averages(tx: DataFrame, p: QueryParams = DEFAULTS) -> DataFrame:
    return aggregates.average_by_key(reference_usd(tx, p), "payment_format", "amount_received")


def far_below_average(tx: DataFrame, p: QueryParams = DEFAULTS) -> DataFrame:
    # one row per format, written so that its size is known before the join is planned
    thresholds = written(format_averages(tx, p).select("payment_format", (F.col("average") * p.average_factor).alias("_thr")), "thresholds")
    candidates = filters.in_days(usd_rows(tx, p), p.candidate_from, p.candidate_to)
    return joins.below_threshold(candidates, thresholds, "payment_format", "amount_received", "_thr")


def q3(tx: DataFrame, p: QueryParams = DEFAULTS) -> DataFrame:
    """Transfers of the candidate days below 1 % of their format's average in the reference days."""
    return far_below_average(tx, p).select("account_origin", "amount_received")


def q4_pairs(tx: DataFrame, p: QueryParams = DEFAULTS) -> DataFrame:
    return graph.scatter_gather_pairs(graph.distinct_edges(reference_usd(tx, p)), p.min_peers)


def q4(tx: DataFrame, p: QueryParams = DEFAULTS) -> DataFrame:
    """Scatter-gather pairs (origin, destination)."""
    return q4_pairs(tx, p).select("account_origin", "account_destination")


def converted(tx: DataFrame, rates: DataFrame, p: QueryParams = DEFAULTS) -> DataFrame:
    rows = filters.route_formats(filters.in_days(tx, p.reference_from, p.reference_to), p.converted_formats)
    return joins.to_usd(filters.without_format(rows, p.excluded_format), rates)


def q5(tx: DataFrame, rates: DataFrame, p: QueryParams = DEFAULTS) -> DataFrame:
    """Number of ACH and Wire transfers of the reference days worth between 0 and 1 dollar; 0 over no rows."""
    tiny = filters.open_range(converted(tx, rates, p), "usd_amt", p.tiny_above, p.tiny_below)
    return aggregates.count_rows(tiny, "cantTrx")


def rejected_conversions(tx: DataFrame, rates: DataFrame, p: QueryParams = DEFAULTS) -> DataFrame:
    """(payment_currency, n): rows of Q5's formats and days that couldn't be converted."""
    return aggregates.counts_by(converted(tx, rates, p).filter(F.col("usd_amt").isNull()), "payment_currency")


def all_results(tx: DataFrame, accounts: DataFrame, rates: DataFrame, p: QueryParams = DEFAULTS) -> dict[str, DataFrame]:
    return {"query_1": q1(tx, p), "query_2": q2(tx, accounts, p), "query_3": q3(tx, p), "query_4": q4(tx, p), "query_5": q5(tx, rates, p)}
