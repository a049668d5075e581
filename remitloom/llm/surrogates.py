"""Replacements for personal information: keyed, of the same type, script and format, and distinct.

What a mention stands for has one plain form, however it is spelled. The plain form is replaced, and the replacement is
then spelled as the mention is: the same blanks, signs and letter case. Names are replaced word by word, so shorter and
longer forms of one name still belong together.
"""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitloom.llm import lexicon as L
from remitloom.llm.pii import KINDS, mentions
from remitloom.operators.joins import broadcast_if_small
from remitloom.sources.shared import written

PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
#: Rounds in which parts that drew the same replacement draw again; after them the rest take one that carries all of their keyed hash.
ROUNDS = 3
_WORD = re.compile(r"[^\W\d_]+")
_WORD_OR_NUMBER = re.compile(r"[^\W\d_]+|\d+")
_DOT_WORD = re.compile(r"\s?[\[({]\s?(?:dot|punto|ponto|\.)\s?[\])}]\s?|\s(?:dot|punto|ponto)\s", re.I)
_AT_WORD = re.compile(r"\s?(?:@|[\[({]\s?(?:at|arroba)\s?[\])}]|\s(?:at|arroba)\s)\s?", re.I)
_TRUNK = re.compile(r"\(0\)")
_KEPT_WORDS = set(L.STREETS_AFTER) | set(L.STREETS_BEFORE) | set("apt unit suite floor piso andar dpto depto apto nro n no st nd rd th esq dto de del la las los el da do das dos san santa".split())
#: Consonants and vowels of the scripts in which words are made up; other scripts take letters from their own block.
_LETTERS = {
    "LATIN": ("bcdfglmnprstvz", "aeiou"),
    "CYRILLIC": ("бвгдзклмнпрст", "аеиоу"),
    "GREEK": ("βγδκλμνπρστ", "αειου"),
    "ARABIC": ("بتدرزسفقكلمن", "اوي"),
    "HEBREW": ("בגדזטלמנספקר", "אוי"),
}


def _plain(text: str) -> str:
    folded = unicodedata.normalize("NFKD", text.casefold())
    return unicodedata.normalize("NFC", "".join(c for c in folded if not unicodedata.combining(c)))


def entity_key(kind: str, value: str) -> str:
    """What a mention stands for: mentions with one key are one entity, however they are written.

    International numbers, with ``+`` or ``00`` in front, begin with ``+``; a trunk zero in brackets is no part of them.
    """
    plain = re.sub(r"[\s_]+", " ", _plain(value)).strip()
    if kind == "email":
        return _AT_WORD.sub("@", _DOT_WORD.sub(".", plain)).replace(" ", "")
    if kind == "phone":
        digits = re.sub(r"[^\dx+]", "", re.sub(r"(?:ext|int)\.?(?=\s?\d)", "x", _TRUNK.sub("", plain)))
        return re.sub(r"^00", "+", digits)
    if kind == "identity_number":
        return re.sub(r"[^a-z0-9]", "", plain)
    if kind == "person_name":
        turned = re.match(r"([^,]+), ?(.+)$", plain)
        return f"{turned[2]} {turned[1]}" if turned else plain
    return " ".join(_WORD_OR_NUMBER.findall(plain))


def parts(kind: str, value: str) -> list[str]:
    """What is replaced on its own: the words of a name but for particles, of other kinds the entity."""
    entity = entity_key(kind, value)
    return sorted({w for w in _WORD.findall(entity) if w not in L.PARTICLES}) if kind == "person_name" else [entity]


@lru_cache(maxsize=8)
def _secret(key: str) -> bytes:
    """A key of any length as one of 32 bytes; all of it counts."""
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


class _Stream:
    """Endless keyed choices, the same for the same key and label."""

    def __init__(self, key: str, *label: object):
        self.seed, self.n, self.bytes = "\x00".join(map(str, label)).encode(), 0, b""
        self.key = _secret(key)

    def below(self, n: int) -> int:
        if len(self.bytes) < 4:
            self.bytes += hashlib.blake2b(self.seed + self.n.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
            self.n += 1
        value, self.bytes = int.from_bytes(self.bytes[:4], "big"), self.bytes[4:]
        return value % n


@lru_cache(maxsize=16)
def _turned(key: str, which: str) -> dict[str, str]:
    """A keyed one-to-one mapping onto itself of the given names of one gender, or of the letters for initials."""
    names = sorted({_plain(n) for n, g in _genders().items() if g == which}) if which in "fm" else list("abcdefghijklmnopqrstuvwxyz")
    other = list(names)
    random.Random(hashlib.blake2b(which.encode(), key=_secret(key)).digest()).shuffle(other)
    return dict(zip(names, other))


@lru_cache(maxsize=1)
def _genders() -> dict[str, str]:
    found: dict[str, str] = {}
    for name, gender in L.given_names().items():
        found.setdefault(_plain(name), gender)
    return found


def _invented(draw: _Stream, like: str) -> str:
    """A speakable word as long as ``like``, in its script.

    A Latin word keeps the vowel it ends in, which in many languages tells the gender.
    """
    script = unicodedata.name(like[0], "LATIN").split()[0].split("-")[0]
    if script not in _LETTERS:
        # scripts without an entry: letters of the same block of 256
        block = [chr(c) for c in range(ord(like[0]) & ~0xFF, (ord(like[0]) | 0xFF) + 1) if chr(c).isalpha()] or [like[0]]
        return "".join(block[draw.below(len(block))] for _ in like)
    consonants, vowels = _LETTERS[script]
    made = "".join((consonants, vowels)[i % 2][draw.below(len((consonants, vowels)[i % 2]))] for i in range(max(3, len(like))))
    return made[:-1] + like[-1] if script == "LATIN" and like[-1] in "ao" else made


def _cased(word: str, like: str) -> str:
    if like.isupper() and len(like) > 1:
        return word.upper()
    return word.capitalize() if like[:1].isupper() else word


def _country_code(digits: str) -> int:
    """Length of the country code in front of an international number."""
    return 1 if digits[:1] in ("1", "7") else 2 if digits[:2] in L.COUNTRY_CODES_2 else 3


def made_up(kind: str, part: str, key: str, attempt: int = 0) -> str:
    """The replacement of one part in plain form.

    Digits become digits and letters letters at the same places; a phone keeps its country code or leading zero, an
    address its words for streets and floors. Given names become given names of the same gender, other words of names
    inventions of the same script and length. E-mail addresses end in a domain reserved for examples.
    """
    draw = _Stream(key, kind, part, attempt)
    if kind == "phone":
        kept = 1 + _country_code(part[1:]) if part.startswith("+") else len(part) - len(part.lstrip("0"))
        made = part[:kept] + "".join(str(draw.below(10)) if c.isdigit() else c for c in part[kept:])
    elif kind == "identity_number":
        made = "".join(str(draw.below(10)) if c.isdigit() else chr(97 + draw.below(26)) for c in part)
    elif kind == "street_address":
        words = [w if w in _KEPT_WORDS or len(w) == 1 and w.isalpha() else "".join(str(draw.below(9) + 1) for _ in w) if w.isdigit() else _invented(draw, w) for w in part.split(" ")]
        made = " ".join(words)
    elif kind == "email":
        local, _, domain = part.partition("@")
        local = "".join(chr(97 + draw.below(26)) if c.isalpha() else str(draw.below(10)) if c.isdigit() else c for c in local)
        made = f"{local}@{_invented(_Stream(key, 'domain', domain), 'mailbox')}.example"
    else:
        gender = _genders().get(part)
        if len(part) == 1:
            made = _turned(key, "initials").get(part, part) if not attempt else _invented(draw, part)
        elif gender and not attempt:
            made = _turned(key, gender)[part]
        else:
            made = _invented(draw, part)
    if attempt > ROUNDS:
        made += "-" + hashlib.blake2b(f"{kind}\x00{part}".encode(), key=_secret(key), digest_size=16).hexdigest()
    return made


def replacement(kind: str, value: str, key: str, attempts: dict[str, int] | None = None) -> str:
    """A made-up value of the same kind, spelled as ``value`` is. ``attempts`` says which draw of a part holds, 0 if none."""
    attempts = attempts or {}

    def fill(pattern: str, text: str, made: str) -> str:
        rest = iter(made)
        return re.sub(pattern, lambda m: _cased(next(rest, m.group()), m.group()) if m.group().isalpha() else next(rest, m.group()), text)

    if kind == "person_name":

        def name(m: re.Match) -> str:
            word = _plain(m.group())
            return m.group() if word in L.PARTICLES or not word else _cased(made_up(kind, word, key, attempts.get(word, 0)), m.group())

        return _WORD.sub(name, unicodedata.normalize("NFC", value))
    part = entity_key(kind, value)
    made, _, mark = made_up(kind, part, key, attempts.get(part, 0)).partition("-") if attempts.get(part, 0) > ROUNDS and kind != "email" else (made_up(kind, part, key, attempts.get(part, 0)), "", "")
    tail = "-" + mark if mark else ""
    if kind == "email":
        sign, dot = _AT_WORD.search(value), _DOT_WORD.search(value)
        local, _, domain = made.partition("@")
        spelled = f"{local}{sign.group() if sign else '@'}{domain.replace('.', dot.group(), 1) if dot else domain}"
        return spelled.upper() if value.isupper() else spelled
    if kind == "phone":
        lead = re.match(r"\+|00", value)
        head = lead.group() if lead and part.startswith("+") else ""
        pieces = _TRUNK.split(value[len(head) :])
        digits, out = re.sub(r"\D", "", made), []
        for piece in pieces:
            n = sum(c.isdigit() for c in piece)
            out.append(fill(r"\d", piece, digits[:n]))
            digits = digits[n:]
        return head + "(0)".join(out) + tail
    if kind == "identity_number":
        return fill(r"[^\W_]", unicodedata.normalize("NFC", value), made) + tail
    words = iter(made.split(" "))
    return _WORD_OR_NUMBER.sub(lambda m: _cased(w, m.group()) if (w := next(words, m.group())) != _plain(m.group()) else m.group(), unicodedata.normalize("NFC", value)) + tail


def _with_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(parts=[parts(k, v) for k, v in zip(batch["pii_kind"], batch["value"])])


def _drawn(key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(drawn=[made_up(k, p, key, int(a)) for k, p, a in zip(batch["pii_kind"], batch["part"], batch["attempt"])])

    return run


def surrogate_dictionary(found: DataFrame, key: str) -> DataFrame:
    """(pii_kind, part, attempt, drawn): one distinct replacement per part, written.

    ``found`` has pii_kind and the array ``parts``. Of parts that drew the same replacement the first by text keeps it and
    the others draw again, for a bounded number of rounds; each round works on the distinct parts only and groups by
    replacement, so no group is large. Names then differ where their words do.
    """
    columns = "pii_kind string, part string, attempt int, drawn string"
    entries = found.select("pii_kind", F.explode("parts").alias("part")).distinct().withColumn("attempt", F.lit(0))
    for attempt in range(ROUNDS + 2):
        rank = F.row_number().over(Window.partitionBy("pii_kind", "drawn").orderBy("attempt", "part"))
        entries = written(entries.mapInPandas(_drawn(key), columns).withColumn("_rank", rank), "surrogates")
        if entries.filter("_rank > 1").isEmpty():
            break
        entries = entries.select("pii_kind", "part", F.when(F.col("_rank") > 1, F.lit(attempt + 1)).otherwise(F.col("attempt")).alias("attempt"))
    return entries.select("pii_kind", "part", "attempt", "drawn")


def _replaced(key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for kind, value, redrawn in zip(batch["pii_kind"], batch["value"], batch["redrawn"]):
                made.append(replacement(kind, value, key, dict(redrawn) if redrawn is not None else None))
            yield batch.drop(columns="redrawn").assign(surrogate=made)

    return run


def replaced_mentions(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, span_start, span_end, pii_kind, value, surrogate): every mention with what replaces it.

    One entity has one surrogate in all texts, spelled as each mention is, and different entities have different ones.
    Only parts that had to draw again are joined to the mentions, mostly none. Repeated documents repeat their mentions.
    """
    if not key:
        raise ValueError("a key is needed")
    found = mentions(docs)
    schema = T.StructType([*found.schema.fields, T.StructField("parts", T.ArrayType(T.StringType()))])
    found = written(found.mapInPandas(_with_parts, schema), "mentions")
    again = surrogate_dictionary(found, key).filter("attempt > 0").select("pii_kind", "part", "attempt")
    spans = found.drop("parts")
    none = F.lit(None).cast("map<string,int>").alias("redrawn")
    if again.isEmpty():
        spans = spans.select("*", none)
    else:
        hit = found.select("doc_id", "span_start", "pii_kind", F.explode("parts").alias("part")).distinct().join(broadcast_if_small(again), ["pii_kind", "part"])
        hit = hit.groupBy(F.col("doc_id").alias("_doc"), F.col("span_start").alias("_at")).agg(F.map_from_entries(F.collect_list(F.struct("part", "attempt"))).alias("redrawn"))
        spans = spans.join(hit, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("span_start") == F.col("_at")), "left").drop("_doc", "_at")
    return spans.mapInPandas(_replaced(key), "doc_id bigint, span_start int, span_end int, pii_kind string, value string, surrogate string")


def _rewritten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        marked, replaced = [], []
        for text, spans in zip(batch["text"], batch["spans"]):
            if spans is None or text is None or not len(spans):
                marked.append(text)
                replaced.append(text)
                continue
            a, b, at = [], [], 0
            for s in sorted(spans, key=lambda s: s["span_start"]):
                before = text[at : s["span_start"]]
                a += [before, PLACEHOLDERS[s["pii_kind"]]]
                b += [before, s["surrogate"]]
                at = s["span_end"]
            marked.append("".join(a) + text[at:])
            replaced.append("".join(b) + text[at:])
        yield pd.DataFrame({"doc_id": batch["doc_id"], "text_placeholders": marked, "text_surrogates": replaced})


def without_personal_information(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text_placeholders, text_surrogates) of every document; all else in the texts stays as it is.

    ``text_placeholders`` has ``[EMAIL]``, ``[PHONE]``, ``[IDENTITY_NUMBER]``, ``[STREET_ADDRESS]`` and
    ``[PERSON_NAME]`` where something was found, ``text_surrogates`` made-up values, the same for the same entity in
    the whole corpus. NULL texts stay NULL. ``doc_id`` must be unique and not NULL. Without the key the replacements
    can't be worked out again.
    """
    spans = replaced_mentions(docs, key)
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("span_start", "span_end", "pii_kind", "surrogate")).alias("spans"))
    joined = docs.select("doc_id", "text").join(per_doc, "doc_id", "left")
    return joined.mapInPandas(_rewritten, "doc_id bigint, text_placeholders string, text_surrogates string")


def round_trip(docs: DataFrame, redacted: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id): documents whose placeholder text is not the text with exactly its spans cut out; none if all is well.

    The text outside the spans, in order, must be what stands between the placeholders, and each placeholder must be of
    its span's kind.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = []
            for doc, text, marked, own in zip(batch["doc_id"], batch["text"], batch["text_placeholders"], batch["spans"]):
                at, made = 0, []
                for s in sorted(own if own is not None else [], key=lambda s: s["span_start"]):
                    made += [text[at : s["span_start"]], PLACEHOLDERS[s["pii_kind"]]]
                    at = s["span_end"]
                if text is not None and "".join(made) + text[at:] != marked or text is None and marked is not None:
                    bad.append(doc)
            yield pd.DataFrame({"doc_id": pd.Series(bad, dtype="int64")})

    own = spans.groupBy("doc_id").agg(F.collect_list(F.struct("span_start", "span_end", "pii_kind")).alias("spans"))
    joined = docs.select("doc_id", "text").join(redacted.select("doc_id", "text_placeholders"), "doc_id").join(own, "doc_id", "left")
    return joined.mapInPandas(run, "doc_id bigint")
