"""Sinks: the five result files of a run and its summary."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitloom import schemas


def write_results(results: dict[str, DataFrame], base: str, run_id: str | None = None) -> dict:
    """Each result as CSV with a heading under ``base/client-<run id>``, and ``summary.json`` beside them.

    Every result is counted while it is written (``Observation``), so no query runs twice. A Q4 result may be
    given in pair form (account_origin, account_destination); it is flattened to one account per row.
    """
    from pyspark.sql import Observation

    if not results:
        raise ValueError("no results to write")
    run_id = run_id or str(uuid.uuid4())
    folder, counts = f"{base.rstrip('/')}/client-{run_id}", {}
    for name, df in results.items():
        file_name, header = schemas.RESULTS[name]
        if name == "query_4" and "account" not in df.columns:
            df = df.select(F.explode(F.array("account_origin", "account_destination")).alias("account"))
        seen = Observation(name)
        df.select(*header).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{folder}/{file_name}")
        counts[name] = seen.get["n"]
    summary = {
        "run_id": run_id,
        "timestamp": datetime.now().strftime("%H:%M:%S.%f")[:-3],
        "eof_count": len(results),
        "result_count": sum(counts.values()),
        "result_counts_by_type": counts,
        "files": {name: schemas.RESULTS[name][0] for name in results},
    }
    spark = next(iter(results.values())).sparkSession
    spark.createDataFrame([(json.dumps(summary, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary.json")
    return summary | {"folder": folder}


def client_results(df: DataFrame, client_id: str) -> DataFrame:
    """The rows of one client out of results of many (column ``client_id``)."""
    return df.filter(F.col("client_id") == client_id).drop("client_id")
