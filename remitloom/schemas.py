"""Column schemas of the inputs and of the result files."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


#: Columns of the input files in their order, and names and headings of the result files.
#: The CSV repeats the heading "Account", so columns go by position.
TRANSACTIONS_CSV = _schema(
    ("ts", T.StringType()),
    ("from_bank", T.StringType()),
    ("account_origin", T.StringType()),
    ("to_bank", T.StringType()),
    ("account_destination", T.StringType()),
    ("amount_received", T.StringType()),
    ("receiving_currency", T.StringType()),
    ("amount_paid", T.StringType()),
    ("payment_currency", T.StringType()),
    ("payment_format", T.StringType()),
    ("is_laundering", T.StringType()),
)

ACCOUNTS_CSV = _schema(
    ("bank_name", T.StringType()),
    ("bank_id", T.StringType()),
    ("account_number", T.StringType()),
    ("entity_id", T.StringType()),
    ("entity_name", T.StringType()),
)

TRANSACTION_COLUMNS = [f.name for f in TRANSACTIONS_CSV][:10]

RATES = _schema(("currency", T.StringType()), ("rate_day", T.StringType()), ("rate", T.DecimalType(18, 6)))

ENVELOPE = _schema(
    ("client_id", T.StringType()),
    ("message_type", T.IntegerType()),
    ("message_id", T.StringType()),
    ("data_id", T.StringType()),
    ("payload", T.StringType()),
)

#: Result name -> (file name, header).
RESULTS = {
    "query_1": ("query_1.csv", ["account_origin", "account_destination", "amount_received"]),
    "query_2": ("query_2.csv", ["bank_name", "account_origin", "amount_received"]),
    "query_3": ("query_3.csv", ["account_origin", "amount_received"]),
    "query_4": ("query_4.csv", ["account"]),
    "query_5": ("query_5.csv", ["cantTrx"]),
}
