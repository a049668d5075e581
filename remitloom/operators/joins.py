"""Joins of facts with small or keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitloom.functions import scalars as X

#: Largest side, in bytes as the optimizer knows them, that :func:`broadcast_if_small` broadcasts.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the optimizer's estimate of its size is at most ``most`` bytes; else as it is.

    The estimate comes from file sizes and row widths, so it grows with the data; beyond the bound the planner uses
    a shuffle join, and adaptive execution splits hot keys.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def named_banks(best: DataFrame, names: DataFrame, key: str, unnamed: str = "Unknown") -> DataFrame:
    """Inner join on the bank number; NULL, blank and ``unnamed`` names drop the row."""
    usable = names.filter(F.col("bank_name").isNotNull() & (F.col("bank_name") != "") & (F.col("bank_name") != unnamed))
    return best.join(usable.withColumnRenamed("bank_id", key), key, "inner")


def below_threshold(rows: DataFrame, thresholds: DataFrame, key: str, value: str, threshold: str) -> DataFrame:
    """Rows with ``0 < value < threshold`` of their key. Keys without a threshold, NULLs and NaNs give nothing.

    The thresholds are broadcast if their size is known to be small, else the join shuffles.
    """
    joined = rows.join(broadcast_if_small(thresholds.select(key, threshold)), key, "inner")
    return joined.filter((F.col(value) > 0) & (F.col(value) < F.col(threshold))).drop(threshold)


def with_rate(rows: DataFrame, rates: DataFrame, currency: str = "payment_currency", ts: str = "ts", out: str = "rate", code: str | None = None) -> DataFrame:
    """``rows`` with ``out``: the rate of the currency's code on the day of ``ts``, else of the code on any day, else NULL.

    ``rates`` is (currency, rate_day, rate); its names are turned into codes too. A currency with two spellings for
    one day takes the larger rate, so the join never multiplies rows. US dollars have rate 1. Columns of ``rows`` stay,
    but for one named ``out``; names that begin with ``__`` are reserved. ``code`` keeps the code under that name.
    """
    keyed = rates.groupBy(X.currency_code(F.col("currency")).alias("__code"), F.col("rate_day").alias("__day")).agg(F.max("rate").alias("__rate"))
    dated = keyed.filter(F.col("__day").isNotNull())
    always = keyed.filter(F.col("__day").isNull()).select("__code", F.col("__rate").alias("__default"))
    found = rows.withColumn("__code", X.currency_code(F.col(currency))).withColumn("__day", X.day_dash(F.col(ts)))
    found = found.join(broadcast_if_small(dated), ["__code", "__day"], "left").join(broadcast_if_small(always), "__code", "left")
    rate = F.when(F.col("__code") == "USD", F.lit(1).cast("decimal(18,6)")).otherwise(F.coalesce("__rate", "__default"))
    found = found.withColumn(out, rate)
    return (found.withColumn(code, F.col("__code")) if code else found).drop("__code", "__day", "__rate", "__default")


def to_usd(rows: DataFrame, rates: DataFrame, amount: str = "amount_paid", currency: str = "payment_currency", out: str = "usd_amt") -> DataFrame:
    """``rows`` with the amount in US dollars as a double; NULL without a rate or with a NULL or NaN amount.

    Dollars pass as they are; other amounts are multiplied as decimals with all digits of the rate, and only the product,
    with 15 decimals (7 for amounts from 10^10 on), becomes a double.
    """
    plain = X.number(F.col(amount))
    rated = with_rate(rows, rates, currency, out="__usd_rate", code="__usd_code")
    rate = F.col("__usd_rate").cast("decimal(18,6)")
    product = F.coalesce(F.try_multiply(plain.try_cast("decimal(20,10)"), rate), F.try_multiply(plain.try_cast("decimal(28,10)"), rate).cast("decimal(38,7)"))
    usd = F.when(F.col("__usd_code") == "USD", plain).otherwise(product.cast("double"))
    return rated.withColumn(out, usd).drop("__usd_rate", "__usd_code")
