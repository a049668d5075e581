"""Joins in which one key may hold a third of all rows.

Adaptive execution splits hot partitions only where no later step needs the partitioning that a split destroys. These
helpers don't depend on that: rows of a hot key get one of as many salts as its rows need tasks, and what they are joined to
is repeated once per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitloom.sources.shared import written

#: Rows of one key that one task takes. A key with more is hot.
TASK_ROWS = 1_000_000
#: There are never more hot keys than this: beyond MOST_HOT times TASK_ROWS rows a task takes more of them.
MOST_HOT = 65_536
BUCKETS = 4096
SALT = "__salt"
SALTS = "__salts"


def hot_keys_at_once(df: DataFrame, sets: dict[str, list[str]], task_rows: int = TASK_ROWS) -> dict[str, DataFrame]:
    """Label -> (keys, salts) for every set of key columns that has hot keys; sets without any are absent.

    ``salts`` is the number of tasks a key's rows need. Rows with a NULL in a set's columns don't count in that set. All
    sets are counted in one pass, by a hash of the key in BUCKETS buckets, which shuffles one row per set, bucket and task;
    a hot key's bucket is at least as full as the key, so only the keys of full buckets are counted themselves - all sets in
    one further pass - and mostly there are none.
    """
    labels = list(sets)

    def stated(columns: list[str]) -> Column:
        out = F.lit(True)
        for c in columns:
            out = out & F.col(c).isNotNull()
        return out

    bucket = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")
    each = [F.when(stated(cols), F.struct(F.lit(i).alias("s"), bucket(cols).alias("b"))) for i, cols in enumerate(sets.values())]
    rows = df.select(F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.s", "x.b")
    filled = [(r["s"], r["b"], r["n"]) for r in rows.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n")).collect()]  # BUCKETS rows a set
    found: dict[str, DataFrame] = {}
    for i, label in enumerate(labels):
        least = max(task_rows, -(-sum(n for s, _, n in filled if s == i) // MOST_HOT))
        full = [b for s, b, n in filled if s == i and n > least]
        if full:
            columns = sets[label]
            counted = df.filter(stated(columns) & bucket(columns).isin(*full)).groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
            hot = counted.filter(F.col("__n") > least).select(*columns, F.ceil(F.col("__n") / F.lit(least)).cast("int").alias(SALTS))
            found[label] = written(hot, "hot")
    return found


def hot_keys(df: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> DataFrame | None:
    """(keys, salts) of one set of key columns, or None if no key is hot."""
    return hot_keys_at_once(df, {"": keys}, task_rows).get("")


def _marked(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    names = [c for c in hot.columns if c != SALTS]
    named = hot.select(*[F.col(c).alias(f"__h{i}") for i, c in enumerate(names)], SALTS)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"__h{i}"))
    return df.join(F.broadcast(named), same, "left").drop(*[f"__h{i}" for i in range(len(keys))])  # at most MOST_HOT rows


def salted(df: DataFrame, hot: DataFrame | None, keys: list[str], spread_by: str, salt: str = SALT) -> DataFrame:
    """``df`` with a salt: by ``spread_by`` for rows of hot keys, 0 for all others."""
    if hot is None:
        return df.withColumn(salt, F.lit(0))
    marked = _marked(df, hot, keys)
    return marked.withColumn(salt, F.coalesce(F.pmod(F.xxhash64(spread_by), F.col(SALTS)).cast("int"), F.lit(0))).drop(SALTS)


def repeated(df: DataFrame, hot: DataFrame | None, keys: list[str], salt: str = SALT) -> DataFrame:
    """``df`` once with salt 0, or once per salt for rows of hot keys: the other side of a salted join."""
    if hot is None:
        return df.withColumn(salt, F.lit(0))
    return _marked(df, hot, keys).withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(SALTS), F.lit(1)) - 1))).drop(SALTS)
