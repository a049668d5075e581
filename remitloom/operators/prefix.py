"""Distributed running totals: no group, however large, has to fit one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitloom.sources.shared import written


def _local_totals(groups: list[str], weight: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            w = np.asarray(batch.column(batch.schema.get_field_index(weight)).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            change = np.zeros(n, bool)
            first = []
            for g in groups:
                col = batch.column(batch.schema.get_field_index(g))
                codes = col.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
                first.append((col[0].as_py(), col[n - 1].as_py()))
            total = np.cumsum(w)
            starts = np.flatnonzero(change)
            # at each start the running total of the group begins anew; the first group may go on from the last batch
            base = np.zeros(n, np.int64)
            if starts.size:
                marks = np.zeros(n, np.int64)
                marks[starts] = total[starts - 1]
                base = np.maximum.accumulate(marks)
            local = total - base
            if last is not None and last == [f[0] for f in first]:
                local[: starts[0] if starts.size else n] += carried
            carried, last = int(local[-1]), [f[1] for f in first]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(np.full(n, pid, np.int32))], names=[*batch.schema.names, out, "_pid"])

    return run


def running_total(df: DataFrame, groups: list[str], order: list[Column], weight: str, out: str, label: str = "totals", whole: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """``df`` with ``out``: the total of ``weight`` up to and with each row, per group in the given order.

    ``weight`` is a non-negative bigint (NULL counts as 0), ``order`` should be total, or rows that tie get their
    totals in any order. Rows are range-partitioned by (groups, order), so a hot group spreads over many tasks; each
    task adds up its own run of rows in order, and the totals of earlier tasks - one row per group and task - are
    added afterwards. The middle step is written to the shared folder, which fixes the partitioning. An empty
    ``groups`` gives one running total over everything. Extra columns pass through; ``out`` and ``_pid`` are reserved.

    ``whole`` names further columns with a ``sum`` or ``max`` of an expression over each row's whole group: they come with
    the totals of earlier tasks, by the same join on task and group, in which no group is hot.
    """
    whole = whole or {}
    clash = {out, "_pid", "_before", *whole} & set(df.columns)
    if clash:
        raise ValueError(f"reserved columns in the input: {sorted(clash)}")
    keys = [F.col(g) for g in groups] + order
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([*spread.schema.fields, T.StructField(out, T.LongType()), T.StructField("_pid", T.IntegerType())])
    local = written(spread.mapInArrow(_local_totals(groups, weight, out), schema), label)
    of = {"sum": F.sum, "max": F.max}
    parts = local.groupBy("_pid", *groups).agg(F.max(out).alias("_sum"), *[of[how](column).alias(name) for name, (how, column) in whole.items()])
    before = F.sum("_sum").over(Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    if not groups:  # one row per task: the only unpartitioned window, bounded by the number of tasks
        parts = parts.coalesce(1)
    names = {g: f"_of_{i}" for i, g in enumerate(groups)}
    offsets = parts.select(F.col("_pid").alias("_of_pid"), *[F.col(g).alias(n) for g, n in names.items()], F.coalesce(before, F.lit(0)).alias("_before"), *[of[how](name).over(Window.partitionBy(*groups)).alias(name) for name, (how, _) in whole.items()])
    match = F.col("_pid") == F.col("_of_pid")
    for g, n in names.items():
        match = match & F.col(g).eqNullSafe(F.col(n))
    joined = local.join(offsets if whole else offsets.filter("_before > 0"), match, "left")
    return joined.select(*df.columns, (F.col(out) + F.coalesce("_before", F.lit(0))).alias(out), *whole)
