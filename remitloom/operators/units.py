"""Quantities recorded in different units: amounts of any currency and scale to US cents.

Units are read from text. All distinct spellings of the unit-bearing fields are cut into phrases, the distinct phrases
are matched against a lexicon of unit names - candidates from an inverted index of character n-grams, verified by a
weighted edit distance - and the alias dictionary that results, one row per spelling, is joined to all rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitloom.functions import scalars as X
from remitloom.operators.joins import broadcast_if_small
from remitloom.sources.shared import literal, written

#: Currency -> code, symbols, usual names.
CURRENCIES = {
    "US Dollar": ("USD", ["US$", "U$S", "$", "USD$"], ["us dollar", "u.s. dollar", "american dollar", "united states dollar", "dollar", "dolar", "dólar", "dolar estadounidense", "dólar americano", "greenback"]),
    "Euro": ("EUR", ["€"], ["euro"]),
    "UK Pound": ("GBP", ["£"], ["uk pound", "pound", "pound sterling", "british pound", "sterling", "libra esterlina", "quid"]),
    "Yen": ("JPY", ["¥", "JP¥", "円"], ["yen", "japanese yen", "iene"]),
    "Yuan": ("CNY", ["RMB", "CN¥", "元", "CNH"], ["yuan", "renminbi", "chinese yuan", "yuan renminbi"]),
    "Rupee": ("INR", ["₹", "Rs", "Rs."], ["rupee", "indian rupee", "rupia"]),
    "Brazil Real": ("BRL", ["R$"], ["brazil real", "brazilian real", "real", "reais", "real brasileiro"]),
    "Mexican Peso": ("MXN", ["Mex$", "MX$"], ["mexican peso", "peso", "peso mexicano"]),
    "Canadian Dollar": ("CAD", ["C$", "CA$", "Can$"], ["canadian dollar", "canada dollar", "dolar canadiense"]),
    "Australian Dollar": ("AUD", ["A$", "AU$"], ["australian dollar", "australia dollar", "aussie dollar"]),
    "Swiss Franc": ("CHF", ["SFr.", "SFr", "Fr."], ["swiss franc", "franc", "franco suizo", "swiss frank"]),
    "Saudi Riyal": ("SAR", ["﷼", "SR"], ["saudi riyal", "riyal", "saudi rial"]),
    "Ruble": ("RUB", ["₽", "RUR"], ["ruble", "rouble", "russian ruble", "rublo"]),
    "Shekel": ("ILS", ["₪", "NIS"], ["shekel", "new shekel", "israeli shekel", "sheqel"]),
    "Bitcoin": ("BTC", ["₿", "XBT"], ["bitcoin"]),
}
#: Power of ten -> words and marks for it. A mark of one letter counts beside a figure only.
SCALES = {
    -2: ["cent", "cents", "hundredth", "hundredths", "minor unit", "minor units", "centavo", "centavos", "centimo", "céntimo", "céntimos", "centesimo", "pence", "penny", "x0.01"],
    0: ["whole unit", "whole units", "unit", "units"],
    3: ["thousand", "thousands", "k", "mil", "miles", "milhares", "'000", "(000s)", "x1000", "tsd"],
    5: ["lakh", "lakhs", "lac", "lacs"],
    6: ["million", "millions", "m", "mm", "mn", "mio", "mln", "mill", "millon", "millón", "millones", "milhao", "milhão", "milhoes", "milhões"],
    7: ["crore", "crores"],
    9: ["billion", "billions", "bn", "bln", "mrd", "milliard"],
}
#: Units that state the currency and the scale at once.
COMPOUND = {
    ("Bitcoin", -8): ["sat", "sats", "satoshi", "satoshis"],
    ("Bitcoin", -6): ["bit", "bits", "ubtc", "µbtc", "microbitcoin", "microbitcoins"],
    ("Bitcoin", -3): ["mbtc", "millibitcoin", "millibitcoins"],
    ("UK Pound", -2): ["pence sterling"],
}
#: In a note a unit right behind one of these, within NEAR_WORDS words of the same part, or right before one of the latter, is a
#: unit of something else.
_MENTION_BEFORE = re.compile(r"counter ?value|contravalor|equivalent|equivalente|receipt|recibo|also in|también en|instead of|rather than|en lugar de|not in|no en|\bex\b", re.I)
_MENTION_AFTER = re.compile(r"^\W*(?:as well\b(?! as)|too\b|equivalent|equivalente|también|también)", re.I)
_TURNS = re.compile(r"\b(?:but|sino|mas sim|pero)\b", re.I)
NEAR_WORDS = 4
#: A feed's own description states units in sentences about its figures, or right after a word like "in"; parts about
#: separators and legends, which explain several units, state none.
PROFILE_LEADS = {"in", "in whole", "en", "em"}
_ABOUT_FIGURES = re.compile(r"\b(?:figures?|amounts?|values?|numbers?|sums?|totals?|importes?|montos?|valor(?:es)?|cifras?|quantias?|números?)\b", re.I)
_ABOUT_STYLE = re.compile(r"\b(?:commas?|dots?|points?|separators?|decimals?|digits?|coma|punto|ponto|vírgula|decimales|decimais)\b", re.I)
_DECIMAL_COMMA = re.compile(r"comma\s+(?:before|as|for|marks?)\s+(?:the\s+)?decimal|decimal\s+comma|coma\s+decimal", re.I)

GRAM = 2
#: Most edit cost, as a share of the alias's length, at which a phrase still is that alias; aliases shorter than
#: FUZZY_FROM must be met exactly (after folding letter case and accents), and in running text so must phrases shorter than
#: FUZZY_TEXT_FROM.
FUZZY_SHARE, FUZZY_FROM, FUZZY_TEXT_FROM = 0.18, 4, 6
#: Digits in groups of three set off by blanks or apostrophes, or with any separators; then perhaps a power of ten.
_FIGURE = r"(?:[0-9]{1,3}(?:[ \u00a0\u2009\u202f'’][0-9]{3})+(?![0-9])(?:[.,][0-9]+)?|[0-9]+(?:[.,'’][0-9]+)*|[.,][0-9]+)"
_EXPONENT = r"(?:[eE][+-]?[0-9]{1,2}(?![0-9]))?"
_KILO_MARK = "kilomark"
_THOUSANDS_MARK = r"(?i)['’]\s?000s?\b|\(\s?000s?\s?\)|\b[x×]\s?1[.,]?000\b"


def fold(text: str) -> str:
    """Letter case, accents and width folded; the micro sign becomes ``u``."""
    plain = unicodedata.normalize("NFKD", text.replace("µ", "u").replace("μ", "u")).casefold()
    return "".join(c for c in plain if not unicodedata.combining(c))


def lexicon() -> list[tuple[str, str | None, int | None]]:
    """(alias, currency, power of ten) in folded form, built from the fixed values by rule; about 400 rows."""
    out: dict[str, tuple[str | None, int | None]] = {}
    for name, (code, symbols, names) in CURRENCIES.items():
        for alias in [name, code, *symbols, *names]:
            out.setdefault(fold(alias), (name, None))
        for alias in [name, *names]:
            out.setdefault(fold(alias) + "s", (name, None))
        for prefix, power in (("k", 3), ("m", 6), ("mm", 6), ("mn", 6), ("bn", 9)):
            if prefix + code.lower() != "mbtc":
                out.setdefault(prefix + code.lower(), (name, power))
    for power, words in SCALES.items():
        for word in words:
            out.setdefault(fold(word), (None, power))
    for (name, power), words in COMPOUND.items():
        for word in words:
            out[fold(word)] = (name, power)
    out[_KILO_MARK] = (None, 3)
    return [(alias, *meaning) for alias, meaning in out.items() if alias not in ("'000", "(000s)", "x1000")]


@lru_cache(maxsize=1)
def longest_phrase() -> int:
    """Words of the longest alias, and one more for a word that was torn apart."""
    return max(len(alias.split()) for alias, *_ in lexicon()) + 1


def spelled(text: Column) -> Column:
    """The text with its figures replaced by `` # ``, except figures that mark thousands; outer blanks off."""
    marked = F.when(F.contains(text, F.lit("000")), F.regexp_replace(text, _THOUSANDS_MARK, f" {_KILO_MARK} ")).otherwise(text)
    return X.strip(F.regexp_replace(marked, _FIGURE + _EXPONENT, " # "))


_CLOSE = ".,;:()[]{}\"'!?-/"
#: Costs of the weighted edit distance: letters that scans and fingers confuse are cheap to swap, as are doubled
#: letters, blanks and punctuation to add or drop.
_CONFUSED = {frozenset(p) for p in ("0o", "1l", "1i", "il", "5s", "8b", "2z", "sz", "ck", "vb", "nm", "uv", "yi", "ea", "eo", "qg", "ei")}


def edit_cost(a: str, b: str, most: float) -> float:
    """Weighted edit distance with neighbour swaps; anything above ``most`` may come out as infinity."""
    if abs(len(a) - len(b)) * 0.4 > most:
        return float("inf")
    loose = lambda s, i: s[i] in " -'." or (i and s[i] == s[i - 1])
    before: list[float] = []
    row = [0.0]
    for j in range(len(b)):
        row.append(row[-1] + (0.4 if loose(b, j) else 1.0))
    for i in range(len(a)):
        gap = 0.4 if loose(a, i) else 1.0
        new = [row[0] + gap]
        for j in range(len(b)):
            swap = 0.0 if a[i] == b[j] else 0.5 if frozenset((a[i], b[j])) in _CONFUSED else 1.0
            best = min(row[j] + swap, row[j + 1] + gap, new[j] + (0.4 if loose(b, j) else 1.0))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j] and a[i] != b[j]:
                best = min(best, before[j - 1] + 0.7)
            new.append(best)
        if min(new) > most and min(row) + 0.7 > most:  # a swap goes past one row
            return float("inf")
        before, row = row, new
    return row[-1]


def _needed(alias: str) -> int:
    """Least number of distinct n-grams of the alias that every phrase within its distance shares; below 1 it may be none.

    A letter dropped or changed destroys at most GRAM n-grams, a swap of neighbours one more, a letter added or one of two
    equal ones dropped one less.
    """
    most, padded, destroyed = FUZZY_SHARE * len(alias) + 1e-9, f"^{alias}$", 0
    for swaps, drops in product(range(int(most / 0.7) + 1), range(sum(c in " -'." for c in alias) + 1)):
        left = most - 0.7 * swaps - 0.4 * drops
        for changes in range(int(left / 0.5) + 1 if left >= 0 else 0):
            destroyed = max(destroyed, (GRAM + 1) * swaps + GRAM * (drops + changes) + (GRAM - 1) * int((left - 0.5 * changes) / 0.4))
    return len({padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)}) - destroyed


def _grams(text: Column) -> Column:
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (GRAM - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(GRAM))))


def _split(spelling: str) -> list[str]:
    """Words of a spelling; a comma or semicolon between letters ends one as well."""
    return re.sub(r"(?<=[^\W\d_])([;,])(?=[^\W\d_])", r"\1 ", spelling).split()


def _cut(spelling: str) -> list[tuple[int, int, str, str]]:
    """(position, words, folded phrase, words before) of all phrases of up to :func:`longest_phrase` words."""
    words: list[str] = []
    for part in _split(spelling):
        bare = part.strip(_CLOSE)
        whole = part.strip("()[],;:\"'!?-/")  # keeps the full stop of "Rs."
        words.append(fold(whole if whole.endswith(".") and len(whole) <= 5 else bare))
    out = []
    for i, size in product(range(len(words)), range(1, longest_phrase() + 1)):
        run = words[i : i + size]
        if len(run) == size and all(run) and "#" not in run:
            out.append((i, size, " ".join(run), " ".join(words[max(0, i - 2) : i])))
    return out


def _phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(f, s, *x) for f, s in zip(batch["field"], batch["spelling"]) for x in _cut(s)]
        yield pd.DataFrame(rows, columns=["field", "spelling", "at", "words", "phrase", "lead"])


@F.pandas_udf(T.DoubleType())
def _edit_cost(phrase: pd.Series, alias: pd.Series) -> pd.Series:
    return pd.Series([edit_cost(p, a, FUZZY_SHARE * len(a)) for p, a in zip(phrase, alias)], dtype="float64")


def phrase_aliases(phrases: DataFrame) -> DataFrame:
    """(phrase, currency, power, exact, like) of the distinct phrases that are an alias, exactly or nearly; ``like`` is the
    number of words of an alias that is met nearly.

    Candidates are all that can be within the distance: they share as many n-grams with the alias as that leaves, or, where
    it may leave none, are about as long. The verification takes the alias with
    the least cost, of several the shortest, then the first by name.
    """
    spark = phrases.sparkSession
    words = literal(spark, [(*entry, _needed(entry[0])) for entry in lexicon()], "alias string, currency string, power int, needed int").withColumn("fuzzy", F.length("alias") >= FUZZY_FROM)
    exact = phrases.join(F.broadcast(words), phrases["phrase"] == words["alias"]).select("phrase", "currency", "power", F.lit(True).alias("exact"), F.lit(0).alias("like"))  # the lexicon has a fixed size
    fuzzy = words.filter("fuzzy").select("alias", "currency", "power", "needed")
    index = fuzzy.filter("needed > 0").withColumn("gram", F.explode(_grams(F.col("alias"))))
    others = phrases.filter(F.length("phrase") >= FUZZY_FROM - 1).join(exact.select("phrase"), "phrase", "left_anti")
    edits = F.floor(F.length("alias") * FUZZY_SHARE / 0.4 + 1e-9)
    of_length = F.abs(F.length("phrase") - F.length("alias")) <= edits
    grams = others.select("phrase", F.explode(_grams(F.col("phrase"))).alias("gram"))
    shared = grams.join(F.broadcast(index), "gram").filter(of_length).groupBy("phrase", "alias", "currency", "power", "needed").agg(F.count(F.lit(1)).alias("shared"))
    near = shared.filter("shared >= needed").select("phrase", "alias", "currency", "power")
    if any(len(alias) >= FUZZY_FROM and _needed(alias) < 1 for alias, _, _ in lexicon()):
        near = near.unionByName(others.join(F.broadcast(fuzzy.filter("needed < 1")), of_length).select("phrase", "alias", "currency", "power"))
    costed = near.withColumn("cost", _edit_cost("phrase", "alias")).filter(F.col("cost") <= F.length("alias") * FUZZY_SHARE)
    best = costed.groupBy("phrase").agg(F.min(F.struct("cost", F.length("alias").alias("n"), "alias", "currency", "power")).alias("b"))
    return exact.unionByName(best.select("phrase", "b.currency", "b.power", F.lit(False).alias("exact"), F.size(F.split("b.alias", " ")).alias("like")))


def _mentioned_only(words: list[str], units: list[tuple[int, int]]) -> set[int]:
    """Places of the words in the parts of a note, cut at ``;`` and ``,``, that only mention a unit.

    What decides is where the unit (place, words) stands: near behind "receipt", "not in" and the like, or right before "as
    well". A part that is nothing but units and figures goes with the part before it.
    """
    out: set[int] = set()
    stating = {i for at, size in units for i in range(at, at + size)}
    start, dropped = 0, False
    for i, word in enumerate(words):
        if i + 1 < len(words) and not word.endswith((";", ",")):
            continue
        part = range(start, i + 1)
        bare = all(j in stating or "#" in words[j] for j in part)
        own = [(at, size) for at, size in units if start <= at <= i]
        mentioned = False
        for at, size in own:
            before = _TURNS.split(" ".join(words[max(start, at - NEAR_WORDS) : at]))[-1]
            mentioned |= bool(_MENTION_BEFORE.search(before) or _MENTION_AFTER.search(" ".join(words[at + size : i + 1])))
        if not own:
            mentioned = bool(_MENTION_BEFORE.search(" ".join(words[start : i + 1])))
        if own and mentioned and any(not _near(words, start, at, size, i) for at, size in own):
            # a part that turns: "not in dollars but in euros" drops the one and keeps the other
            out |= {j for at, size in own if _near(words, start, at, size, i) for j in range(at, at + size)}
            dropped = False
        else:
            dropped = mentioned or dropped and bare
            out |= set(part) if dropped else set()
        start = i + 1
    return out


def _near(words: list[str], start: int, at: int, size: int, end: int) -> bool:
    """Whether the unit at a place only is mentioned."""
    before = _TURNS.split(" ".join(words[max(start, at - NEAR_WORDS) : at]))[-1]
    return bool(_MENTION_BEFORE.search(before) or _MENTION_AFTER.search(" ".join(words[at + size : end + 1])))


def _profile_parts(words: list[str]) -> tuple[list[int], set[int], set[int]]:
    """For the words of a description: their sentence, the sentences about figures, and the words in parts about separators."""
    sentence, number, style, start = [], 0, set(), 0
    texts: dict[int, list[str]] = {}
    for i, word in enumerate(words):
        sentence.append(number)
        texts.setdefault(number, []).append(word)
        if word.endswith((",", ";", ":", ".", "!", "?")) or i + 1 == len(words):
            if _ABOUT_STYLE.search(" ".join(words[start : i + 1])):
                style |= set(range(start, i + 1))
            start = i + 1
        if word.endswith((";", ".", "!", "?")):
            number += 1
    return sentence, {n for n, own in texts.items() if _ABOUT_FIGURES.search(" ".join(own))}, style


def _resolve(field: str, spelling: str, mentions: list[tuple]) -> tuple[str | None, int | None]:
    """Currency and power of ten that one spelling states: the first of each kind.

    Exact phrases claim their words before near ones do, longer ones before shorter ones: "k us dollar" is not a
    misspelt "us dollar". A near phrase with as many words as its alias, at least two, counts like an exact one: "canadain
    dollar" is no plain "dollar".
    """
    words = _split(spelling)
    rank = lambda m: (not m[6] and not (m[1] >= 2 and m[7] == m[1]), -m[1], not m[6], m[0])
    claimed: set[int] = set()
    kept = []
    sentence, about, style = _profile_parts(words) if field == "profile" else ([], set(), set())
    for at, size, phrase, lead, currency, power, exact, _ in sorted(mentions, key=rank):
        if claimed & set(range(at, at + size)) or not exact and field in ("note", "profile") and len(phrase) < FUZZY_TEXT_FROM:
            continue
        if len(phrase) <= 2 and phrase in ("k", "m", "mm", "sr", "rs", "fr"):
            beside = at > 0 and words[at - 1].endswith("#") or at + size < len(words) and words[at + size].startswith("#")
            if not beside:
                continue
        if field == "profile" and (at in style or sentence[at] not in about and lead.split(" ")[-1] not in PROFILE_LEADS and lead not in PROFILE_LEADS):
            continue
        if currency is None and power == 0 and field != "profile":
            continue
        claimed |= set(range(at, at + size))
        kept.append((at, size, currency, power))
    kept.sort()
    if field == "note" and kept:
        only = _mentioned_only(words, [(at, size) for at, size, *_ in kept])
        kept = [k for k in kept if k[0] not in only]
    if field == "profile":  # a sentence that names several units of one kind explains them
        several = lambda i, n: len({k[i] for k in kept if k[i] is not None and sentence[k[0]] == n}) > 1
        kept = [(at, size, None if several(2, sentence[at]) else c, None if several(3, sentence[at]) else p) for at, size, c, p in kept]
    return next((c for _, _, c, _ in kept if c is not None), None), next((p for *_, p in kept if p is not None), None)


def _resolve_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for field, spelling, mentions in zip(batch["field"], batch["spelling"], batch["mentions"]):
            found = [(m["at"], m["words"], m["phrase"], m["lead"], m["currency"], None if pd.isna(m["power"]) else int(m["power"]), m["exact"], m["like"]) for m in mentions]
            rows.append((field, spelling, *_resolve(field, spelling, found)))
        out = pd.DataFrame(rows, columns=["field", "spelling", "currency", "power"])
        out["power"] = out["power"].astype("Int32")
        yield out


def alias_dictionary(spellings: DataFrame) -> DataFrame:
    """(field, spelling, currency, power) for distinct (field, spelling); spellings that state nothing are absent."""
    cut = spellings.mapInPandas(_phrases, "field string, spelling string, at int, words int, phrase string, lead string")
    aliases = phrase_aliases(cut.select("phrase").distinct())
    mentions = cut.join(aliases, "phrase").groupBy("field", "spelling").agg(F.collect_list(F.struct("at", "words", "phrase", "lead", "currency", "power", "exact", "like")).alias("mentions"))
    stated = mentions.mapInPandas(_resolve_groups, "field string, spelling string, currency string, power int")
    return stated.filter(F.col("currency").isNotNull() | F.col("power").isNotNull())


_NEGATIVE = r"[-−–]\s*(?:[^\s0-9]{1,4}\s?)?[0-9.,]*[0-9]|[0-9]\s?[-−–]\s*(?:\D*)$|^\s*\(\D*[0-9][0-9.,'’    ]*\D*\)\s*$"


def with_figure(df: DataFrame, text: str, decimal_comma: str, out: str) -> DataFrame:
    """``df`` with ``out``: the figure of ``text`` in plain form ("1234.5", ``-`` in front if marked negative), else NULL, and
    ``out`` + ``_exponent``: the power of ten that it is given with, mostly 0.

    Digits may be grouped by blanks, thin blanks, apostrophes, dots or commas. With both separators the last one starts the
    decimals. A separator that occurs once starts the decimals, unless it is the grouping sign of the feed's style
    (``decimal_comma``) and sets off groups of three digits. A text with digits beside its figure, marks for thousands apart,
    has no figure: which one counts can't be told. Negative: a minus before the figure or right behind it, or round brackets
    about all of it. The steps are columns of their own, so each is computed once.
    """
    bare = F.when(F.contains(text, F.lit("000")), F.regexp_replace(text, _THOUSANDS_MARK, " ")).otherwise(F.col(text))
    df = df.withColumn("_bare", bare).withColumn("_found", F.regexp_extract("_bare", _FIGURE + _EXPONENT, 0))
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    figure = F.translate(F.upper("_found"), "'’ \u00a0\u2009\u202f", "")
    df = df.withColumns({"_alone": digits(F.col("_bare")) == digits(F.col("_found")), "_figure": figure, "_ten": F.contains(figure, F.lit("E"))})
    power = F.when(F.col("_ten"), F.substring_index("_figure", "E", -1).try_cast("int")).otherwise(F.lit(0))
    mantissa = F.when(F.col("_ten"), F.substring_index("_figure", "E", 1)).otherwise(F.col("_figure"))
    df = df.withColumns({out + "_exponent": F.coalesce(power, F.lit(0)), "_raw": F.when(F.col("_alone"), mantissa).otherwise("")})
    raw = F.col("_raw")
    df = df.withColumns({"_no_commas": F.replace(raw, F.lit(","), F.lit("")), "_no_dots": F.replace(raw, F.lit("."), F.lit(""))})
    no_commas, no_dots = F.col("_no_commas"), F.col("_no_dots")
    dots, commas = F.length(raw) - F.length(no_dots), F.length(raw) - F.length(no_commas)
    comma_decimal = F.replace(no_dots, F.lit(","), F.lit("."))
    plain = (
        F.when((dots > 0) & (commas > 0), F.when(raw.rlike(r",[^.]*$"), comma_decimal).otherwise(no_commas))
        .when(commas > 1, no_commas)
        .when(dots > 1, no_dots)
        .when(commas == 1, F.when(~F.col(decimal_comma) & raw.rlike(r"^[0-9]{1,3},[0-9]{3}$"), no_commas).otherwise(comma_decimal))
        .when(dots == 1, F.when(F.col(decimal_comma) & raw.rlike(r"^[0-9]{1,3}[.][0-9]{3}$"), no_dots).otherwise(raw))
        .otherwise(raw)
    )
    df = df.withColumn("_plain", plain)
    signed = F.when(F.col(text).rlike(_NEGATIVE), F.concat(F.lit("-"), F.col("_plain"))).otherwise(F.col("_plain"))
    return df.withColumn(out, F.when(raw != "", signed)).drop("_bare", "_found", "_alone", "_figure", "_ten", "_raw", "_no_commas", "_no_dots", "_plain")


def utc_day(ts: Column) -> Column:
    """The UTC day of a time in any of the feeds' forms, as a date; NULL if it is none or doesn't exist.

    Year first with ``/`` or ``-``, day.month.year, month-day-year with a twelve-hour clock, day/month/year, ISO with
    offset, Unix seconds (10 digits) and milliseconds (13 digits).
    """
    t = X.strip(ts)
    of = lambda pattern: F.try_to_timestamp(t, F.lit(pattern)).cast("date")
    day_of = lambda seconds: F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    return (
        F.when(t.rlike(r"^[0-9]{13}$"), day_of(t.try_cast("bigint") / 1000))
        .when(t.rlike(r"^[0-9]{10}$"), day_of(t.try_cast("bigint")))
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+\s?(Z|[+-][0-9]{2}:?[0-9]{2})$"), day_of(F.unix_seconds(t.try_cast("timestamp"))))
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+$"), t.try_cast("timestamp_ntz").cast("date"))
        .when(t.rlike(r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}( [0-9]{1,2}:[0-9]{2})"), of("yyyy/M/d H:mm[:ss]"))
        .when(t.rlike(r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), of("yyyy/M/d"))
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), of("yyyy-MM-dd"))
        .when(t.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"), of("d.M.yyyy[ H:mm[:ss]]"))
        .when(t.rlike(r"(?i)^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4} [0-9]{1,2}:[0-9]{2}\s?[ap]m$"), F.try_to_timestamp(F.upper(t), F.lit("M-d-yyyy h:mm a")).cast("date"))
        .when(t.rlike(r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"), of("M-d-yyyy[ H:mm[:ss]]"))
        .when(t.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"), of("d/M/yyyy[ H:mm[:ss]]"))
    )


FIELDS = {"amount": "amount_paid", "currency": "payment_currency", "note": "note", "profile": "profile_note"}


def unit_spellings(raw: DataFrame, profiles: DataFrame) -> DataFrame:
    """Distinct (field, spelling) of all unit-bearing fields; grouped on the map side before anything moves."""
    fields = [F.struct(F.lit(f).alias("field"), spelled(F.col(FIELDS[f])).alias("spelling")) for f in ("amount", "currency", "note")]
    rows = raw.select(F.explode(F.array(*fields)).alias("x")).select("x.*")
    own = profiles.select(F.lit("profile").alias("field"), spelled(F.col("profile_note")).alias("spelling"))
    return rows.unionByName(own).filter((F.col("spelling") != "") & (F.col("spelling") != "#")).distinct()


def to_common_units(raw: DataFrame, profiles: DataFrame, rates: DataFrame) -> DataFrame:
    """(raw_id, usd_cents, currency, power, figure) of every row that can be converted.

    ``raw`` has raw_id, feed, ts, amount_paid, payment_currency, note; extra columns are ignored. Currency and scale
    are each taken from the first of amount, currency field, note and feed description that states one; without a
    scale the figure counts whole units. Rows without a figure, without a known currency, or - but for US dollars -
    without a rate on the UTC day of ``ts`` are left out, as are results beyond a bigint. Amounts count with up to 12 decimals
    of a cent, rates with all of their digits. Halves round away from zero.
    Feeds that have no description or several use none or the first by text.
    """
    words = written(alias_dictionary(unit_spellings(raw, profiles)), "aliases")
    described = profiles.groupBy("feed").agg(F.min("profile_note").alias("profile_note"))
    stated = described.select("feed", F.lit("profile").alias("field"), spelled(F.col("profile_note")).alias("spelling"), F.coalesce(F.col("profile_note").rlike("(?i)" + _DECIMAL_COMMA.pattern), F.lit(False)).alias("comma"))
    feeds = stated.join(words, ["field", "spelling"], "left").select("feed", "comma", F.col("currency").alias("profile_currency"), F.col("power").alias("profile_power"))
    rows = raw.select("raw_id", "feed", "ts", "amount_paid", *[spelled(F.col(FIELDS[f])).alias(f) for f in ("amount", "currency", "note")]).filter(F.col("amount_paid").rlike("[0-9]"))
    for f in ("amount", "currency", "note"):
        own = words.filter(F.col("field") == f).select(F.col("spelling").alias(f), F.col("currency").alias(f"{f}_currency"), F.col("power").alias(f"{f}_power"))
        rows = rows.join(broadcast_if_small(own), f, "left")
    rows = rows.join(broadcast_if_small(feeds), "feed", "left").withColumn("comma", F.coalesce("comma", F.lit(False)))
    order = ("amount", "currency", "note", "profile")
    rows = with_figure(rows, "amount_paid", "comma", "figure").select(
        "raw_id",
        utc_day(F.col("ts")).alias("day"),
        "figure",
        F.coalesce(*[f"{f}_currency" for f in order]).alias("currency"),
        F.coalesce(*[F.col(f"{f}_power") for f in order], F.lit(0)).alias("power"),
        "figure_exponent",
    )
    dated = rates.groupBy(F.col("currency").alias("currency"), F.col("rate_day").try_cast("date").alias("day")).agg(F.max("rate").alias("rate"))
    rows = rows.join(broadcast_if_small(dated), ["currency", "day"], "left")
    rate = F.when(F.col("currency") == "US Dollar", F.lit(1).cast("decimal(18,6)")).otherwise(F.col("rate").cast("decimal(18,6)"))
    # the whole and the broken part are multiplied apart, as one product of these would not keep all of its digits
    rows = rows.withColumns({"_rate": rate, "_cents": F.concat("figure", F.lit("E"), (F.col("power") + F.col("figure_exponent") + 2).cast("string")).try_cast("decimal(38,12)")})
    rows = rows.withColumn("_whole", F.expr("CAST(_cents - _cents % 1 AS DECIMAL(26,0))"))
    product = F.try_add(F.try_multiply("_whole", "_rate").try_cast("decimal(25,6)"), F.expr("CAST(_cents % 1 AS DECIMAL(12,12)) * _rate"))
    cents = F.round(product).try_cast("bigint")
    return rows.select("raw_id", cents.alias("usd_cents"), "currency", (F.col("power") + F.col("figure_exponent")).alias("power"), "figure").filter(F.col("usd_cents").isNotNull())


def unresolved(raw: DataFrame, converted: DataFrame) -> DataFrame:
    """(feed, n): rows that could not be converted, counted per feed."""
    return raw.join(converted.select("raw_id"), "raw_id", "left_anti").groupBy("feed").agg(F.count(F.lit(1)).alias("n"))
