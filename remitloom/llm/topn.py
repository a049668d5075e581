"""Top N items within every group, by partition lower bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from remitloom.sources.shared import written

_SCHEMA = "grp bigint, score double, tie string, item bigint, bound double"
_NAMES = ["grp", "score", "tie", "item", "bound"]
#: A task folds its rows into the best so far whenever it has gathered this many; it holds no more than about that.
FOLD_ROWS = 200_000


def _best(table: pa.Table, n: int) -> pd.DataFrame:
    """The best ``n`` distinct items of each group of ``table``, in order, with ``rank`` from 1."""
    grp, score, item = (table[c].to_numpy() for c in ("grp", "score", "item"))
    # each item once, at its best score; then the n-th best score of each group, or none if it has fewer items
    order = np.lexsort((-score, item, grp))
    g, i, s = grp[order], item[order], score[order]
    once = np.ones(len(g), bool)
    once[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1])
    g, s = g[once], s[once]
    order = np.lexsort((-s, g))
    g, s = g[order], s[order]
    names, starts, sizes = np.unique(g, return_index=True, return_counts=True)
    cut = np.where(sizes >= n, s[np.minimum(starts + n - 1, len(s) - 1)], -np.inf)
    # only what reaches the cut is sorted with its text
    near = table.filter(pa.array(score >= cut[np.searchsorted(names, grp)]))
    near = near.sort_by([("grp", "ascending"), ("score", "descending"), ("tie", "ascending"), ("item", "ascending")])
    rows = near.to_pandas().drop_duplicates(["grp", "item"])
    rows["rank"] = rows.groupby("grp").cumcount() + 1
    return rows[rows["rank"] <= n]


def _candidates(n: int):
    """The best items of each group within a task's rows, with the ``n``-th best score there as ``bound``.

    Rows gather until there are FOLD_ROWS of them and are then reduced to the best. Where that leaves more than half of
    them - most groups have few items - they are given out as they are, with the bounds they have, and gathering begins
    anew: so each fold takes in at least half a fold of new rows, and time and memory don't depend on the number of groups.
    """

    def given(rows: pd.DataFrame, schema: pa.Schema) -> list[pa.RecordBatch]:
        bound = rows.loc[rows["rank"] == n].set_index("grp")["score"]
        rows = rows.assign(bound=rows["grp"].map(bound).astype("float64"))
        return pa.Table.from_pandas(rows[_NAMES], pa.schema([*schema, ("bound", pa.float64())]), preserve_index=False).to_batches(50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        count = 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(pa.Table.from_batches([batch]).select(_NAMES[:4]))
                count += batch.num_rows
            if count >= FOLD_ROWS:
                schema, rows = waiting[0].schema, _best(pa.concat_tables(waiting), n)
                if len(rows) * 2 > count:
                    yield from given(rows, schema)
                    waiting, count = [], 0
                else:
                    waiting, count = [pa.Table.from_pandas(rows[_NAMES[:4]], schema, preserve_index=False)], len(rows)
        if waiting:
            yield from given(_best(pa.concat_tables(waiting), n), waiting[0].schema)

    return run


def top_n_per_group(df: DataFrame, n: int) -> DataFrame:
    """(grp, item_rank, item): the first ``n`` items of every group, by score descending, tie ascending, item ascending.

    Input (grp bigint, score double, tie string, item bigint) without NULLs and NaNs; other columns are ignored. Rows
    of one item in a group are one item, at its best row. ``tie`` is compared by code points (UTF-8 bytes).

    Every input partition keeps its own ``n`` best items per group; the ``n``-th best score there is a lower bound for
    the whole group, and the largest of these bounds is joined to the candidates. What stays of a hot group is little
    more than its ``n`` best, whatever the number of partitions, and only that is ranked. A task holds about FOLD_ROWS
    rows, however many groups it meets. Groups with fewer items give all; an empty input gives none.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    local = written(df.select("grp", "score", "tie", "item").mapInArrow(_candidates(n), _SCHEMA), "candidates")
    bounds = local.filter(F.col("bound").isNotNull()).groupBy("grp").agg(F.max("bound").alias("least"))
    near = local.join(bounds, "grp", "left").filter(F.col("least").isNull() | (F.col("score") >= F.col("least")))
    order = [F.col("score").desc(), F.col("tie").asc(), F.col("item").asc()]
    once = near.withColumn("_copy", F.row_number().over(Window.partitionBy("grp", "item").orderBy(*order[:2]))).filter("_copy = 1")
    ranked = once.withColumn("item_rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)))
    return ranked.filter(F.col("item_rank") <= n).select("grp", F.col("item_rank").cast("int").alias("item_rank"), "item")
