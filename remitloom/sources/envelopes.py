"""Message envelopes: payloads from and to JSON, and the messages of each client."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitloom.operators.aggregates import first_rows

#: Fields of any payload; those a message lacks are NULL.
PAYLOAD = "account_origin string, account_destination string, amount double, payment_currency string, payment_format string, sum_total double, count bigint"


def with_payload(envelopes: DataFrame, payload: str = "payload") -> DataFrame:
    """``envelopes`` with the payload's fields as the struct ``data``; all NULL in it where the text is no JSON object."""
    return envelopes.withColumn("data", F.from_json(payload, PAYLOAD))


def packed(envelopes: DataFrame, *columns: str) -> DataFrame:
    """(message): each envelope as JSON in base64, as batches carry it; NULL fields are left out."""
    return envelopes.select(F.base64(F.to_json(F.struct(*columns)).cast("binary")).alias("message"))


def unpacked(messages: DataFrame, schema: str) -> DataFrame:
    """The envelopes of :func:`packed` messages."""
    return messages.select(F.from_json(F.unbase64("message").cast("string"), schema).alias("e")).select("e.*")


def once_per_client(envelopes: DataFrame) -> DataFrame:
    """Envelopes with each (client, type, message id) once: the earliest, then the one with the smallest ``delivery_id``.

    Clients are told apart in everything, in any letter case, so one id with two clients is two messages. Envelopes without a
    message id are never repeats. Adds ``client``.
    """
    named = envelopes.withColumn("client", F.lower("source_client_uuid"))
    stated = first_rows(named.filter("message_id IS NOT NULL"), "client, message_type, message_id", "delivered_at", "delivery_id")
    return stated.unionByName(named.filter("message_id IS NULL"))
