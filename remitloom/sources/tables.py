"""Sources: parquet tables, CSV files, rate files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitloom import schemas
from remitloom.functions import scalars as X
from remitloom.sources.shared import literal


#: In place of fields that are absent, so that a quoted empty text stays one.
_NO_FIELD = "\x01absent"
_SCHEMAS: dict[tuple, T.StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table (a file or a folder of files). Its schema is read once for each state of the file or folder."""
    path = f"{folder}/{name}.parquet"
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(found)
    state = (path, status.getModificationTime(), status.getLen())
    if state not in _SCHEMAS:
        _SCHEMAS[state] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[state]).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan that has fewer tasks than there are cores, as of one file with one row group, shuffled by ``key``; others stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores else df


def transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Transactions from CSV with a heading: columns by position, amounts as doubles, the last column dropped.

    A byte-order mark belongs to the heading, which is skipped. Text that is no number gives a NULL amount;
    rows that are too short give NULLs at their end.
    """
    raw = spark.read.schema(schemas.TRANSACTIONS_CSV).option("header", True).option("enforceSchema", True).option("nullValue", _NO_FIELD).csv(path)
    return raw.select(*[X.number(F.col(c)).alias(c) if c.startswith("amount_") else F.col(c) for c in schemas.TRANSACTION_COLUMNS])


def accounts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Accounts from CSV with a heading; ``bank_id`` as bigint, NULL if it is no integer."""
    raw = spark.read.schema(schemas.ACCOUNTS_CSV).option("header", True).option("enforceSchema", True).option("nullValue", _NO_FIELD).csv(path)
    return raw.withColumn("bank_id", X.bank_number(F.col("bank_id")))


#: Bitcoin in US dollars on the days that are known without any file.
BUILTIN_RATES = {
    "Bitcoin|USD|2022-09-01": "19793.1",
    "Bitcoin|USD|2022-09-02": "199999.0",
    "Bitcoin|USD|2022-09-03": "19831.4",
    "Bitcoin|USD|2022-09-04": "19952.7",
    "Bitcoin|USD|2022-09-05": "20126.1",
}


def rates_from_mapping(spark: SparkSession, rates: dict[str, str], builtin: bool = True) -> DataFrame:
    """Rates from ``currency|USD|day``, ``currency|day`` or ``currency`` keys, as (currency, rate_day, rate).

    ``rate_day`` is NULL for a rate that holds on every day. Of two keys for one day the longer form wins; given
    rates win over the built-in ones. A mapping is configuration, a few kilobytes at most.
    """
    merged = {**(BUILTIN_RATES if builtin else {}), **{str(k): str(v) for k, v in rates.items()}}
    chosen: dict[tuple[str, str | None], str] = {}
    for key in sorted(merged, key=lambda k: k.count("|")):
        parts = key.split("|")
        chosen[parts[0].strip(), parts[-1] if len(parts) > 1 else None] = merged[key]
    rows = [(c, d, r) for (c, d), r in chosen.items()]
    return literal(spark, rows, "currency string, rate_day string, rate string").withColumn("rate", F.col("rate").cast("decimal(18,6)"))


def rates_json(spark: SparkSession, path: str, builtin: bool = True) -> DataFrame:
    """Rates from a JSON object file with the keys of :func:`rates_from_mapping`."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small configuration file
    return rates_from_mapping(spark, json.loads(text), builtin)


def provided_rates(quoted: DataFrame, static: DataFrame, provider: str = "quoted") -> DataFrame:
    """(currency, rate_day, rate) of the chosen provider.

    ``static`` takes the static table alone. ``quoted`` takes the quotes, and the static table for the currencies that no
    quotes exist for; quotes for those are left out. Another name is an error.
    """
    if provider not in ("quoted", "static"):
        raise ValueError(f"unknown provider: {provider}")
    columns = ["currency", "rate_day", "rate"]
    if provider == "static":
        return static.select(*columns)
    return quoted.filter(~X.is_static_only(F.col("currency"))).select(*columns).unionByName(static.filter(X.is_static_only(F.col("currency"))).select(*columns))
