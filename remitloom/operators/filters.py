"""Row filters and routers. Each returns a DataFrame; nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitloom.functions import scalars as X
from remitloom.params import DEFAULTS, QueryParams


def without_format(df: DataFrame, excluded: str = DEFAULTS.excluded_format) -> DataFrame:
    """Rows whose ``payment_format`` isn't ``excluded`` in any letter case. A NULL format is another format, so it stays."""
    return df.filter(F.coalesce(F.lower("payment_format"), F.lit("")) != excluded.lower())


def both_currencies(df: DataFrame, name: str = DEFAULTS.usd_name) -> DataFrame:
    """Rows with exactly ``name`` (case and blanks count) as payment and as receiving currency."""
    return df.filter((F.col("payment_currency") == name) & (F.col("receiving_currency") == name))


def open_range(df: DataFrame, column: str, above: float, below: float) -> DataFrame:
    """Rows with ``above < column < below``, both ends open. NULL and NaN never pass."""
    value = F.col(column)
    return df.filter((value > above) & (value < below))


def in_days(df: DataFrame, first: str, last: str) -> DataFrame:
    """Rows whose ``ts`` is a well-formed stamp on a day from ``first`` to ``last``. Other stamps match nothing.

    The plain text range stands first: as a comparison of the column itself it reaches the parquet scan.
    """
    after = last + "￿"
    return df.filter((F.col("ts") >= first) & (F.col("ts") <= after) & X.has_stamp(F.col("ts")) & X.day_slash(F.col("ts")).between(first, last))


def day_branch(ts: Column, p: QueryParams = DEFAULTS) -> Column:
    """``ref`` (reference days), ``cand`` (candidate days) or ``out`` (other days and malformed stamps)."""
    day = X.day_slash(ts)
    return F.when(X.has_stamp(ts) & day.between(p.reference_from, p.reference_to), "ref").when(X.has_stamp(ts) & day.between(p.candidate_from, p.candidate_to), "cand").otherwise("out")


def route_formats(df: DataFrame, formats: tuple[str, ...] = DEFAULTS.converted_formats) -> DataFrame:
    """Rows of the given formats (case counts) with ``route``: ``direct`` for US dollars, ``convert`` for the rest.

    Rows with a blank currency, and rows to convert with a blank ``ts``, have no route and are dropped.
    """
    code = X.currency_code(F.col("payment_currency"))
    kept = df.filter(F.col("payment_format").isin(*formats))
    # the cheap test comes first and decides nearly always
    kept = kept.filter((X.strip(F.col("payment_currency")) != "") & ((X.strip(F.col("ts")) != "") | (code == "USD")))
    return kept.withColumn("route", F.when(code == "USD", "direct").otherwise("convert"))
