"""Personal information in free text: where it is, and texts with it replaced.

One pass of an Aho-Corasick automaton over the folded text finds all anchors - signs of e-mail addresses, labels of
identity numbers, words for streets, names and titles - and rules look only around anchors; telephone numbers are
found by their shapes, names of persons as :mod:`remitloom.llm.names` says. A text costs time in proportion to its
length, and is never cut; where a rule looks back, it goes word by word, however long the words are.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from remitloom.llm import lexicon as L
from remitloom.llm.names import Names

KINDS = ("email", "phone", "identity_number", "street_address", "person_name")


def fold(text: str) -> str:
    """Lower case, of exactly the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def compose(text: str) -> tuple[str, list[int]]:
    """``text`` with letters and their combining marks composed, and the place in ``text`` of each character and of the end."""
    out, places, i = [], [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        whole = unicodedata.normalize("NFC", text[i:j])
        if len(whole) == 1:
            out.append(whole)
            places.append(i)
        else:
            out.extend(text[i:j])
            places.extend(range(i, j))
        i = j
    return "".join(out), [*places, len(text)]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    words: dict[str, set[str]] = {}
    for kind, entries in (
        ("at", ["@", "(at)", "[at]", "{at}", "( at )", "[ at ]", " at ", " arroba ", "(arroba)", "[arroba]"]),
        ("id", L.ID_LABELS),
        ("after", L.STREETS_AFTER),
        ("before", L.STREETS_BEFORE),
        ("family", L.family_names()),
        ("given", L.given_names()),
        ("title", L.TITLES),
        ("cue", L.NAME_CUES),
        ("follow", L.NAME_FOLLOWS),
        ("tel", L.PHONE_LABELS),
        ("home", L.ADDRESS_CUES),
        ("end", L.STREETS_END),
    ):
        for entry in entries:
            words.setdefault(entry, set()).add(kind)
    machine = ahocorasick.Automaton()
    for word, kinds in words.items():
        machine.add_word(word, (word, kinds))
    machine.make_automaton()
    return machine


def _anchors(low: str) -> dict[str, list[tuple[int, int, str]]]:
    """Kind -> (start, end, word) of whole words, in order; an underscore is no part of a word (scans put it for blanks)."""
    found: dict[str, list[tuple[int, int, str]]] = {k: [] for k in ("at", "id", "after", "before", "family", "given", "title", "cue", "follow", "tel", "home", "end")}
    size = len(low)
    for last, (word, kinds) in _automaton().iter(low):
        end = last + 1
        start = end - len(word)
        if "at" in kinds:
            found["at"].append((start, end, word))
            continue
        if "end" in kinds and start and low[start - 1].isalpha() and not low[end : end + 1].isalnum():
            found["end"].append((start, end, word))
        if start and low[start - 1].isalnum() or end < size and low[end].isalnum() and word[-1].isalnum():
            continue
        for kind in kinds:
            found[kind].append((start, end, word))
    return found


# ---- e-mail ----------------------------------------------------------------------------------------------------------

_LOCAL_SIGNS = frozenset(".+%'-_")
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punto|ponto|\.)\s?[\])}]\s?|\s(?:dot|punto|ponto)\s)"
_DOMAIN = re.compile(rf"[^\W_](?:[\w-]*[^\W_])?(?:{_DOT}[^\W_](?:[\w-]*[^\W_])?)*{_DOT}[^\W\d_]{{2,24}}(?![\w-])", re.I)
_SPOKEN_DOT = re.compile(r"\W(?:dot|punto|ponto)\W", re.I)


def _local_part(text: str, end: int) -> int | None:
    """Start of the local part that ends at ``end``: letters, digits and signs, a letter or digit first."""
    at = end
    while at and (text[at - 1].isalnum() or text[at - 1] in _LOCAL_SIGNS):
        at -= 1
    while at < end and not text[at].isalnum():
        at += 1
    return at if at < end and text[end - 1] != "." else None


def _emails(text: str, anchors: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    last = -1
    for start, end, word in anchors:
        if start < last:
            continue
        left = start
        while left and text[left - 1] in " \u00a0\t":
            left -= 1
        right = end
        while right < len(text) and text[right] in " \u00a0\t":
            right += 1
        if start - left > 1 or right - end > 1:
            continue
        domain = _DOMAIN.match(text, right)
        begin = _local_part(text, left) if domain else None
        if begin is None:
            continue
        local, name = text[begin:left], domain.group()
        if word == " at " and not _SPOKEN_DOT.search(name) and not re.search(r"[\d._+-]", local):
            # "look at this.example"
            if local.lower() in L.BEFORE_AT or name.lower().rpartition(".")[2] not in L.TOP_DOMAINS or name[-1].islower() and name.rpartition(".")[2][:1].isupper():
                continue
        last = domain.end()
        yield begin, last


# ---- identity numbers ------------------------------------------------------------------------------------------------

_ID_LEAD = r"(?:\s|[.:=,#-]|n[°ºo]\.?|n\.\s?[°º]|nr[o.]?\.?|no\.?|num\.?|number|número|numero|is|es|é|was|era){0,8}?"
_ID_NUMBER = re.compile(
    _ID_LEAD + r"(?<![^\W\d_])(?P<n>(?:(?!(?:is|es|was|era|no|nr|num|nro)\b)[a-z]{1,3}[ -]?)?\d{1,12}(?:[ ./-]?\d{1,9}){0,6}(?:[ -]?[a-z]{1,2}\d(?![^\W_])|[ -]?[a-z](?![^\W_]))?)(?![^\W_])",
    re.I,
)
#: Numbers that begin with letters of the name: CURP, RFC, driving licences.
_ID_OF_NAME = re.compile(_ID_LEAD + r"(?P<n>[a-zñ&][a-zñ&9]{2,4}[ -]?\d{6}(?:[^\W_]{1,10}|[ -](?=[^\W_]*\d)[^\W_]{2,10})?(?:[ -]\d{1,2}(?![^\W_]))?)(?![^\W_])", re.I)


def _identity_numbers(text: str, anchors: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    for _, end, word in anchors:
        m = word in L.ID_OF_NAME and _ID_OF_NAME.match(text, end) or _ID_NUMBER.match(text, end)
        if m and sum(c.isdigit() for c in m["n"]) >= 5 and not re.match(r"(?:tr|l)-?\d", m["n"], re.I):
            yield m.start("n"), m.end("n")


# ---- telephone numbers -----------------------------------------------------------------------------------------------

_PHONE = re.compile(
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,13}(?!\d)(?:[ ]?(?:x|ext\.?|int\.?)[ ]?\d{1,6}(?!\d))?"
    r"|\(\d{2,4}\)[ ]?\d{2,5}[ .-]\d{3,6}(?!\d)(?:[ ]?(?:x|ext\.?)[ ]?\d{1,6}(?!\d))?"
    r"|(?<![\w.,/:+(-])(?:(?:1[ .-])?\d{3}([.-])\d{3}\1\d{4}(?:[ ]?(?:x|ext\.?)[ ]?\d{1,6}(?!\d))?"
    r"|00[1-9](?:[ .-]?\d){9,13}|1[2-9]\d{2}[2-9]\d{6}|0\d{3,4} \d{3} \d{3}|0\d{4} \d{6}|0\d{2} \d{4} \d{4}|0\d{2,3} \d{3,4}-\d{4}|0\d(?: \d{2}){4})(?![\w]|[./-]\d)"
)
_AFTER_LABEL = re.compile(r"(?:\s|[.:#-]|al?\b|para\b|on\b|to\b|no\.?|number\b|número\b|back\b|of\b){0,6}?(?P<n>[+(]?\d(?:[ ()./-]{0,2}\d){6,14})(?![\w])", re.I)


def _label_before(low: str, at: int) -> str:
    """The word before a place, signs of labels between them aside."""
    while at and low[at - 1] in " .:#=º°":
        at -= 1
    end = at
    while at and (low[at - 1].isalnum() or low[at - 1] == "_"):
        at -= 1
    return low[at:end]


def _overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether ``spans``, in order and apart, have something between two places."""
    i = bisect_left(spans, (end,))
    return i > 0 and spans[i - 1][1] > start


def _phones(text: str, low: str, anchors: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    spans = []
    for m in _PHONE.finditer(text):
        if text[m.start()] not in "+(" and _label_before(low, m.start()) in L.NUMBER_LABELS:
            continue
        spans.append((m.start(), m.end()))
        yield spans[-1]
    for _, end, _ in anchors:
        m = _AFTER_LABEL.match(text, end)
        if m and not _overlaps(spans, m.start("n"), m.end("n")):
            digits = sum(c.isdigit() for c in m["n"])
            if 7 <= digits <= 15 and not re.match(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?!\d)|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}(?!\d)", m["n"]):
                yield m.start("n"), m.end("n")


# ---- street addresses ------------------------------------------------------------------------------------------------

_NUMBER_AND_NAME = re.compile(r"(?<![\w.,/:#-])(\d{1,5}[a-z]?(?:\s?[-–/]\s?\d{1,5}[a-z]?)?),?[ _\u00a0]((?:[^\W\d_][\w'’.]*[ _\u00a0]){1,3})$", re.I)
#: Longer names, as long as their words have capitals.
_NUMBER_AND_LONG_NAME = re.compile(r"(?<![\w.,/:#-])(\d{1,5}[A-Za-z]?(?:\s?[-–/]\s?\d{1,5}[A-Za-z]?)?),?[ _\u00a0]([A-ZÀ-Þ][\w'’.]*[ _\u00a0](?:(?:[A-ZÀ-Þ][\w'’.]*|del?|las?|los|da|dos?|v[ao]n)[ _\u00a0]){3,8})$")
_UNIT_AFTER = re.compile(r"(?:,?[ ](?:apt|unit|suite|ste|flat|apartment|room|rm)\.?[ ]?#?\w+|,?[ ]\d{1,3}(?:st|nd|rd|th)[ ]floor|,?[ ]floor[ ]\d+|,?[ ]?#[ ]?\w+)*", re.I)
_STREET_WORD = r"(?:[^\W\d_][\w'’ªº]{0,3}\.|[^\W\d_][\w'’ªº]*)"
_NAME_AND_NUMBER = re.compile(
    r"\.?[ _\u00a0]*(?P<name>[^\W\d_][\w'’.ªº]*(?:[ _\u00a0][^\W\d_][\w'’.ªº]*){0,5}?)[ _\u00a0]*,?[ _\u00a0]*(?:n[°º]\.?|nro\.?|n\.[ ]?[°º]|nr\.?|no\.|núm\.?|num\.?|número|#)?[ _\u00a0]*(?:\d{1,5}[a-z]?(?![\w]|[.,]\d{3})|s/n(?!\w))"
    r"(?:,?[ ]?(?:(?:piso|andar)[ ]?\d+|(?:dpto|depto|apto|apt|of|bloco|esc|pta|puerta)\.?[ ]?\w+|\d{1,2}\.?[º°ª](?:[ ](?:esq|dto|dir|fte)\b\.?|[ ][a-z]\b)?))*".replace("_W_", _STREET_WORD),
    re.I,
)
_NO_STREET = {"of", "the", "to", "and", "in", "on", "from", "with", "for", "times", "days", "items", "rows", "messages", "accounts", "credits", "payments", "por", "que", "con", "com"}


def _words_back(text: str, at: int, words: int) -> int:
    """Where the last ``words`` words before a place begin, however long they are."""
    for _ in range(words):
        while at and text[at - 1] in " _\u00a0":
            at -= 1
        while at and text[at - 1] not in " _\u00a0\n":
            at -= 1
    return at


_HOUSE_NUMBER = re.compile(r",?[ _\u00a0](?:nr\.?[ ]?)?\d{1,5}[a-z]?(?![\w]|[.,]\d{3})", re.I)
_NUMBER_BEFORE = re.compile(r"(?<![\w.,/:#-])\d{1,5}[a-z]?,?[ _\u00a0]$", re.I)
_AT_HOME = re.compile(r"(?::|[ ]is|[ ]es|[ ]é|[ ]en|[ ]em|[ ]at)?[ \u00a0]+(?P<a>\d{1,5}[A-Za-z]?,?(?:[ ][A-ZÀ-Þ][\w'’]+){1,4}|[A-ZÀ-Þ][\w'’]+(?:[ ](?:[A-ZÀ-Þ][\w'’]+|de|del|la|los|das?|dos?)){0,4},?[ ]\d{1,5}[A-Za-z]?)(?![\w]|[.,:/-]\d)")


def _addresses(text: str, low: str, found: dict) -> Iterator[tuple[int, int]]:
    for start, end, word in found["after"]:
        m = _NUMBER_AND_NAME.search(text, _words_back(text, start, 5), start)
        if not m:
            m = _NUMBER_AND_LONG_NAME.search(text, _words_back(text, start, 13), start)
            if m and m.group(2).isupper() and word in L.STREETS_EVERYDAY:
                continue
        if m and not _NO_STREET & set(m.group(2).lower().split()):
            yield m.start(), _UNIT_AFTER.match(text, end + (word in L.STREETS_SHORT and text[end : end + 1] == ".")).end()
    for start, end, word in found["before"]:
        m = _NAME_AND_NUMBER.match(text, end)
        if m and not ({"por", "que", "con", "com", "the", "y"} & set(m["name"].lower().split())) and (low[end : end + 1] == "." != low[start - 1 : start] if word in L.STREETS_WITH_DOT else word == "c/" or low[end : end + 1] in ". _\u00a0"):
            yield start, m.end()
    for start, end, _ in found["end"]:  # one-word names: the number stands behind or before
        while start and text[start - 1].isalpha():
            start -= 1
        after, before = _HOUSE_NUMBER.match(text, end), _NUMBER_BEFORE.search(text, _words_back(text, start, 2), start)
        if after and low[start:end] not in L.STREETS_END:
            yield start, after.end()
        elif before and text[start].isupper():
            yield before.start(), end
    for _, end, _ in found["home"]:  # no word for a street at all, but a phrase before an address
        m = _AT_HOME.match(text, end)
        if m and not {w.lower() for w in re.findall(r"[^\W\d_]+", m["a"])} & (L.ORGANISATION | L.MONTHS_AND_CURRENCIES):
            yield m.start("a"), m.end("a")


# ---- all kinds -------------------------------------------------------------------------------------------------------


def find_mentions(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all mentions in code points, in order and without overlaps.

    Where kinds overlap, e-mail goes before identity number, address, phone and name, in this order. NULL and empty
    texts have none.
    """
    if not text:
        return []
    if not unicodedata.is_normalized("NFC", text):
        text, places = compose(text)
        return [(places[a], places[b], kind) for a, b, kind in _find(text)]
    return _find(text)


def _find(text: str) -> list[tuple[int, int, str]]:
    low = fold(text)
    found = _anchors(low)
    taken: list[tuple[int, int]] = []
    kinds: dict[tuple[int, int], str] = {}

    def add(kind: str, spans: Iterator[tuple[int, int]]) -> None:
        for span in list(spans):
            if not _overlaps(taken, *span):
                insort(taken, span)
                kinds[span] = kind

    add("email", _emails(text, found["at"]))
    add("identity_number", _identity_numbers(text, found["id"]))
    add("street_address", _addresses(text, low, found))
    add("phone", _phones(text, low, found["tel"]))
    add("person_name", Names(text, low, found, list(taken)).spans())
    return [(a, b, kinds[a, b]) for a, b in taken]


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_end, pii_kind, value) of every mention in ``docs`` (doc_id, text).

    Spans are in code points, the end exclusive. One pass over whole texts without a shuffle; extra columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for start, end, kind in find_mentions(text):
                    for column, value in zip(rows, (doc, start, end, kind, text[start:end])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["doc_id", "span_start", "span_end", "pii_kind", "value"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, span_start int, span_end int, pii_kind string, value string")
