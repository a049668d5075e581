"""Registered queries of the text subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitloom.functions import scalars as X
from remitloom.llm import mixing, packing, pii, surrogates, topn
from remitloom.params import DEFAULTS as P
from remitloom.plans.catalog import _BANK as BANK_SQL
from remitloom.plans.catalog import tx
from remitloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Key of the registered redaction query. Set one of your own for real data.
EXAMPLE_KEY = "remitloom example key"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p4_found", f"""WITH t AS (SELECT {BANK_SQL} AS bank_id, transfer_id, account_origin, amount_received FROM bank_transactions
  WHERE account_origin IS NOT NULL AND amount_received IS NOT NULL AND NOT isnan(amount_received) AND receiving_currency = 'US Dollar' AND transfer_id IS NOT NULL),
  once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bank_id, transfer_id ORDER BY amount_received DESC, account_origin) AS c FROM t WHERE bank_id IS NOT NULL) WHERE c = 1)
  SELECT bank_id, CAST(rn AS INTEGER) AS item_rank, transfer_id FROM (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY amount_received DESC, account_origin, transfer_id) AS rn FROM once) WHERE rn <= 5""")
def _(spark, d):
    rows = tx(spark, d).filter(F.col("receiving_currency") == P.usd_name)
    items = rows.select(X.bank_number(F.col("from_bank")).alias("grp"), X.number(F.col("amount_received")).alias("score"), F.col("account_origin").alias("tie"), F.col("transfer_id").alias("item"))
    best = topn.top_n_per_group(items.dropna(), 5)
    return best.select(F.col("grp").alias("bank_id"), "item_rank", F.col("item").alias("transfer_id"))


@query("p6_containers")
def _(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(table(spark, d, "documents"), table(spark, d, "container_specs"))


@query("p6_fill_report")
def _(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "container_specs")
    return packing.fill_report(packing.fill_containers(table(spark, d, "documents"), specs), specs)


@query("p6_attention")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: how full containers are where half of the greatest attention cost is allowed, and how many break a capacity: none
    but those with a single item that is too costly on its own."""
    specs = table(spark, d, "container_specs")
    filled = packing.fill_containers(table(spark, d, "documents"), specs, attention_share=0.5)
    return packing.constraint_report(filled, specs, attention_share=0.5)


@query("p7_mixture")
def _(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))


@query("p7_shares")
def _(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix_sources(mixing.sized_documents(table(spark, d, "documents")), targets), targets)


@query("p8_found")
def _(spark: SparkSession, d: str) -> DataFrame:
    return surrogates.replaced_mentions(table(spark, d, "documents"), EXAMPLE_KEY).select("doc_id", "span_start", "pii_kind")


@query("p8_redacted")
def _(spark: SparkSession, d: str) -> DataFrame:
    return surrogates.without_personal_information(table(spark, d, "documents"), EXAMPLE_KEY)


@query("p8_entities")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: mentions, documents, different values and different surrogates."""
    spans = surrogates.replaced_mentions(table(spark, d, "documents"), EXAMPLE_KEY)
    per_value = spans.groupBy("pii_kind", "value", "surrogate").agg(F.count(F.lit(1)).alias("n"))
    counted = per_value.groupBy("pii_kind").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("spellings"), F.countDistinct("surrogate").alias("surrogates"))
    return counted


@query("p8_counts")
def _(spark: SparkSession, d: str) -> DataFrame:
    return pii.mentions(table(spark, d, "documents")).groupBy("pii_kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


@query("p8_round_trip", "SELECT CAST(NULL AS BIGINT) AS doc_id WHERE false")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose redacted text and found spans disagree: there must be none."""
    docs = table(spark, d, "documents")
    spans = pii.mentions(docs).select("doc_id", "span_start", "span_end", "pii_kind")
    return surrogates.round_trip(docs, surrogates.without_personal_information(docs, EXAMPLE_KEY), spans)
