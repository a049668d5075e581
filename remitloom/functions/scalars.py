"""Scalar expressions. All are built-in Spark expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The codes by which rates are looked up. Names not listed pass through unchanged.
CURRENCY_CODES = {
    "Australian Dollar": "AUD",
    "Brazil Real": "BRL",
    "Canadian Dollar": "CAD",
    "Euro": "EUR",
    "Mexican Peso": "MXN",
    "Rupee": "INR",
    "Shekel": "ILS",
    "Swiss Franc": "CHF",
    "UK Pound": "GBP",
    "US Dollar": "USD",
    "Yen": "JPY",
    "Yuan": "CNY",
}

#: Currencies that only a static table of rates knows.
STATIC_ONLY_CURRENCIES = ("Bitcoin", "Ruble", "Saudi Riyal")

STAMP_PATTERN = r"^[0-9]{4}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}$"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
_BLANKS = " \t\n\r\x0b\f\u00a0\u2002\u2003\u2009\u202f\u3000\ufeff"


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.trim(text, F.lit(_BLANKS))


def bank_number(text: Column) -> Column:
    """A bank written as text ("007", " 7 ") as a bigint; NULL if it is not an integer or doesn't fit."""
    plain = strip(text)
    return F.when(plain.rlike(INTEGER_PATTERN), plain.try_cast("bigint"))


def integer_text(text: Column) -> Column:
    """Integers of any length in one spelling (blanks, plus sign and leading zeros removed); other text as it is."""
    plain = strip(text)
    digits = F.regexp_replace(plain, r"^[+-]?0*(?=[0-9])", "")
    signed = F.when(plain.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    return F.when(plain.rlike(INTEGER_PATTERN), signed).otherwise(text)


def plain_name(text: Column) -> Column:
    """A name without regard to letter case, outer white space and the length of inner white space."""
    return F.lower(strip(F.regexp_replace(text, r"[\s\u00a0\u2002\u2003\u2009\u202f\u3000]+", " ")))


def has_stamp(ts: Column) -> Column:
    return F.substring(ts, 1, 16).rlike(STAMP_PATTERN)


def day_slash(ts: Column) -> Column:
    return F.substring(ts, 1, 10)


def day_dash(ts: Column) -> Column:
    """First ten characters with ``/`` turned into ``-``: the day part of a rate key."""
    return F.replace(F.substring(ts, 1, 10), F.lit("/"), F.lit("-"))


def number(value: Column) -> Column:
    """``value`` as a double; text that isn't a number, and NaN, become NULL."""
    as_double = value.try_cast("double")
    return F.when(~F.isnan(as_double), as_double)


def currency_code(name: Column) -> Column:
    """Code of a currency name; unknown names pass through trimmed, blank ones become NULL."""
    plain = F.nullif(strip(name), F.lit(""))
    pairs = [F.lit(x) for pair in CURRENCY_CODES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[plain], plain)


def is_static_only(name: Column) -> Column:
    return strip(name).isin(*STATIC_ONLY_CURRENCIES)


def conversion_key(currency: Column, ts: Column, target: str = "USD") -> Column:
    """``currency|target|YYYY-MM-DD``; NULL where currency or time is blank."""
    code, day = currency_code(currency), day_dash(strip(ts))
    return F.when(code.isNotNull() & (day != ""), F.concat_ws("|", code, F.lit(target), day))


def stable_shard(value: Column, shards: int) -> Column:
    """crc32 shard of an integer's plain text: for layouts that must agree with other systems."""
    return F.pmod(F.crc32(value.cast("string").cast("binary")), F.lit(shards))


def digest_shard(text: Column, shards: int) -> Column:
    """The SHA-256 digest of a text, as one large number, modulo ``shards`` (below 2**31)."""
    digest = F.sha2(text, 256)
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, part: (total * F.lit(1 << 32) + part) % F.lit(shards))
