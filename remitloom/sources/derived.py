"""Transactions and accounts derived from the order tables: a larger, regular input with many scatter-gather pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitloom.sources.tables import BUILTIN_RATES, spread, table

#: US dollars for one unit on five days, for the currencies that only a static table knows; Bitcoin is built in.
STATIC_RATES = BUILTIN_RATES | {
    "Saudi Riyal|USD|2022-09-01": "0.2661",
    "Saudi Riyal|USD|2022-09-02": "0.2660",
    "Saudi Riyal|USD|2022-09-03": "0.2660",
    "Saudi Riyal|USD|2022-09-04": "0.2661",
    "Saudi Riyal|USD|2022-09-05": "0.2661",
    "Ruble|USD|2022-09-01": "0.01659",
    "Ruble|USD|2022-09-02": "0.01661",
    "Ruble|USD|2022-09-03": "0.01663",
    "Ruble|USD|2022-09-04": "0.01653",
    "Ruble|USD|2022-09-05": "0.01652",
}
#: Orders to one account name: the number of accounts grows with the data, and so each has about as many transfers at any size.
ORDERS_PER_ACCOUNT = 125


def transactions(spark: SparkSession, folder: str, accounts: int | None = None) -> DataFrame:
    """One transaction per order line; ``accounts`` is the number of account names in use, else one for ORDERS_PER_ACCOUNT orders."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    # a subquery of the plan, so nothing is counted beforehand
    k = F.lit(accounts) if accounts else orders.agg(F.expr(f"greatest(floor(count(1) / {ORDERS_PER_ACCOUNT}), 1)")).scalar()
    lines = spread(table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"), "l_orderkey")
    rows = lines.join(orders, F.expr("l_orderkey = o_orderkey"))
    rows = rows.join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
    rows = rows.join(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), F.expr("l_suppkey = s_suppkey"))
    tens = " ".join(f"WHEN {i} THEN 1e{i - 1}D" for i in range(1, 7))
    amount = f"CAST(l_extendedprice AS DOUBLE) / CASE l_linenumber {tens} ELSE 1e6D END"
    paid = "CASE l_suppkey % 5 WHEN 3 THEN 'Bitcoin' WHEN 4 THEN 'Saudi Riyal' ELSE 'US Dollar' END"
    # few texts in place of many columns: each call to build one is a round trip to the JVM
    return rows.withColumn("_k", k).selectExpr(
        "concat('2022/09/', lpad(1 + l_orderkey % 20, 2, '0'), ' ', lpad(l_partkey % 24, 2, '0'), ':', lpad(l_linenumber, 2, '0')) AS ts",
        "lpad(c_nationkey, 3, '0') AS from_bank",
        "concat('A', lpad(o_custkey % _k, 5, '0')) AS account_origin",
        "lpad(s_nationkey, 3, '0') AS to_bank",
        "concat('A', lpad((l_partkey * 7 + l_suppkey) % _k, 5, '0')) AS account_destination",
        f"{amount} AS amount_received",
        f"CASE WHEN l_partkey % 10 = 0 THEN 'Euro' ELSE {paid} END AS receiving_currency",
        f"{amount} AS amount_paid",
        f"{paid} AS payment_currency",
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Wire' WHEN '2' THEN 'ACH' WHEN '3' THEN 'Cheque' WHEN '4' THEN 'Credit Card' ELSE 'Reinvestment' END AS payment_format",
    )


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """One account per nation, without a name for the last one."""
    nations = table(spark, folder, "nation").filter(F.col("n_nationkey") != 24)
    return nations.selectExpr("n_name AS bank_name", "CAST(n_nationkey AS BIGINT) AS bank_id")


def pattern_transactions(spark: SparkSession) -> DataFrame:
    """20 000 transfers with a known answer to every question: five middles between SG_SOURCE and SG_DEST, seven tiny amounts,
    eleven far below average, and filler in another month."""
    kind = "CASE WHEN id < 10 THEN IF(id % 2 = 0, 'scatter', 'gather') WHEN id < 17 THEN 'tiny' WHEN id < 28 THEN 'low' ELSE 'filler' END"
    number = "CASE WHEN id < 10 THEN id div 2 + 1 WHEN id < 17 THEN id - 9 WHEN id < 28 THEN id - 16 ELSE id - 27 END"
    name = "CASE kind WHEN 'tiny' THEN concat('Q5_LOW_', lpad(n, 2, '0')) WHEN 'low' THEN concat('Q3_LOW_', lpad(n, 2, '0')) ELSE concat('DEDUP', lpad(n, 5, '0')) END"
    amount = "CASE WHEN kind IN ('scatter', 'gather') THEN 100D WHEN kind = 'filler' THEN 1D"
    return spark.range(20_000).selectExpr(f"{kind} AS kind", f"{number} AS n").selectExpr(
        "CASE kind WHEN 'scatter' THEN '2022/09/01 00:00' WHEN 'gather' THEN '2022/09/01 00:01' WHEN 'tiny' THEN '2022/09/02 00:00' WHEN 'low' THEN '2022/09/06 00:00' ELSE concat('2022/10/', lpad(n % 28 + 1, 2, '0'), ' 00:00') END AS ts",
        "'001' AS from_bank",
        f"CASE kind WHEN 'scatter' THEN 'SG_SOURCE' WHEN 'gather' THEN concat('SG_MID_', n) ELSE concat({name}, 'O') END AS account_origin",
        "'002' AS to_bank",
        f"CASE kind WHEN 'scatter' THEN concat('SG_MID_', n) WHEN 'gather' THEN 'SG_DEST' ELSE concat({name}, 'D') END AS account_destination",
        f"{amount} WHEN kind = 'tiny' THEN 100D ELSE 0.5D END AS amount_received",
        "'US Dollar' AS receiving_currency",
        f"{amount} ELSE 0.5D END AS amount_paid",
        "'US Dollar' AS payment_currency",
        "IF(kind = 'tiny' AND n % 2 = 0, 'Wire', 'ACH') AS payment_format",
    )


def pattern_accounts(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('Bank Alpha', 1L), ('Bank Beta', 2L) AS t(bank_name, bank_id)")
