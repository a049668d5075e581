"""Per-key results where a few keys hold most rows: value-frequency compression.

Rows are grouped by (key, value) first. That grouping has no hot key: its partial aggregate folds repeated values
before anything is shuffled, and different values of one key go to different tasks. All that follows - counts, exact
distinct counts, modes, percentiles - works on the weighted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitloom.operators.prefix import running_total
from remitloom.sources.shared import written


def weighted_values(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value, n): how often each value occurs with each key. NULL keys and values are groups of their own.

    NaN is one value; -0.0 counts as 0.0 (Spark normalises both when it groups).
    """
    return df.select(key.alias("key"), value.alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def rows_per_key(weighted: DataFrame) -> DataFrame:
    """(key, n_rows) with the NULL key left out; the second grouping adds weights on the map side too."""
    return weighted.filter(F.col("key").isNotNull()).groupBy("key").agg(F.sum("n").alias("n_rows"))


def profile(weighted: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(key, n_rows, n_distinct, mode, mode_rows, one column per share): all from one pass over the weighted values.

    NULL values count in ``n_rows`` only, and keys that are NULL are left out. The mode is the most frequent value, of
    several the smallest. A share gives the exact discrete percentile: the smallest value whose share of the values reaches
    it (NaN sorts last: filter it before if it shall not count). Without values mode and percentiles are NULL.

    Weights are added up in value order by :func:`running_total`, which also attaches each key's totals: so even a key with a
    third of all values is spread over tasks, and every grouping is a hash aggregate that combines on the map side.
    ``weighted`` is written once, as range partitioning reads it twice.
    """
    known = F.col("value").isNotNull()
    kept = written(weighted.filter(F.col("key").isNotNull()).withColumn("_w", F.when(known, F.col("n")).otherwise(F.lit(0))), "weighted")
    whole = {
        "n_rows": ("sum", F.col("n")),
        "n_distinct": ("sum", F.when(known, F.lit(1)).otherwise(F.lit(0)).cast("bigint")),
        "_total": ("sum", F.col("_w")),
        "mode_rows": ("max", F.when(known, F.col("n"))),
    }
    rows = running_total(kept, ["key"], [F.col("value")], "_w", "upto", "profile", whole)
    columns = [F.min(F.when(known & (F.col("n") == F.col("mode_rows")), F.col("value"))).alias("mode")]
    for name, share in (shares or {}).items():
        wanted = F.greatest(F.ceil(F.col("_total") * F.lit(float(share))), F.lit(1))
        columns.append(F.min(F.when(known & (F.col("upto") >= wanted), F.col("value"))).alias(name))
    same = [F.max(c).alias(c) for c in ("n_rows", "n_distinct", "mode_rows")]  # alike in all rows of a key
    return rows.groupBy("key").agg(*same, *columns).select("key", "n_rows", "n_distinct", "mode", "mode_rows", *(shares or {}))


def keys_with_share(weighted: DataFrame, total: DataFrame, per_cent: int) -> DataFrame:
    """(key): keys with at least ``per_cent`` % of all rows, compared in whole numbers.

    ``total`` is a one-row, one-column DataFrame, read as a scalar subquery.
    """
    counts = rows_per_key(weighted)
    return counts.filter(F.col("n_rows") * 100 >= total.scalar() * per_cent).select("key")
