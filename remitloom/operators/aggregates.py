"""Keyed aggregations. All combine on the map side before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of every key. Spark limits each task's rows to one per key before they shuffle, so no key is hot."""
    first = F.expr(f"row_number() OVER (PARTITION BY {key} ORDER BY {', '.join(order)})")
    return rows.withColumn("_rank", first).filter("_rank = 1").drop("_rank")


def max_by_key(df: DataFrame, key: str | Column, value: str, carry: str, key_name: str) -> DataFrame:
    """Per key the largest ``value`` with its ``carry``; of equal values the smallest ``carry`` wins.

    Rows with a NULL key, NULL or NaN value don't take part. A NULL ``carry`` sorts before all others, as in ascending order.
    """
    rows = df.select((F.col(key) if isinstance(key, str) else key).alias(key_name), F.col(carry).alias("_c"), F.col(value).cast("double").alias("_v"))
    rows = rows.filter(f"{key_name} IS NOT NULL AND _v IS NOT NULL AND NOT isnan(_v)")
    return first_rows(rows, key_name, "_v DESC", "_c").withColumnsRenamed({"_c": carry, "_v": value})


def average_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total, average) over numeric values. NULL or empty keys and NULL or NaN values are skipped."""
    v = F.col(value)
    kept = df.filter(F.col(key).isNotNull() & (F.col(key) != "") & v.isNotNull() & ~F.isnan(v))
    return kept.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("average"))


def first_per_key(df: DataFrame, key: str, value: str, arrival: str | None = None) -> DataFrame:
    """One ``value`` per key: of the earliest ``arrival``, or the smallest where no arrival column is given.

    NULL keys are dropped. With an arrival column a NULL first value stays NULL; equal arrivals give the smallest value.
    """
    rows = df.filter(F.col(key).isNotNull())
    if arrival is None:
        return rows.groupBy(key).agg(F.min(value).alias(value))
    return first_rows(rows.select(F.col(key), F.col(value), F.col(arrival).alias("_at")), key, "_at", value).select(key, value)


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    """One row with the number of rows; 0 over an empty input."""
    return df.agg(F.count(F.lit(1)).alias(name))


def peers(edges: DataFrame, of: str, least: int) -> DataFrame:
    """(account, peers): accounts on side ``of`` of distinct edges that have at least ``least`` edges."""
    return edges.groupBy(F.col(of).alias("account")).agg(F.count(F.lit(1)).alias("peers")).filter(F.col("peers") >= least)


def counts_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
