"""Names of persons in free text, by the class of words, their shape and what stands around them.

Every word has a class: given name, family name, title, part of a firm's name, never a name, ordinary (the public
tokenizer's vocabulary has it in lower case), proper (it has it with a capital only) or unknown. Where letter case tells
something, runs of capitalised words are judged by their classes; elsewhere names are looked for beside given names, titles,
phrases for persons and other mentions. No list has to know both words of a name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import regex

from remitloom.llm import lexicon as L

GIVEN, FAMILY, TITLE, FIRM, NEVER, ORDINARY, PROPER, UNKNOWN, INITIAL, PARTICLE = "GFTONCPUIp"
_VOWELS = regex.compile(r"[aeiouyáéíóúàèìòùâêîôûãõäöüåæøёаеиоуыэюяαεηιουω]")
_BLANK = " \u00a0_"
_PARTICLES = "|".join(sorted(L.PARTICLES, key=len, reverse=True))
_CAPITAL_WORD = r"\p{Lu}[\p{L}\p{M}]*(?:['’](?!s\b)\p{L}+)*(?![\p{L}\p{N}@])"
_INITIALS = r"(?:\p{Lu}\.){1,3}(?![\p{L}\p{N}])"
#: A run of capitalised words, with particles between them; a hyphen or one blank joins.
_RUN = regex.compile(rf"(?<![^\W_]|[@+]|\w\.)(?:{_INITIALS}|{_CAPITAL_WORD})(?:[{_BLANK}-](?:(?:{_PARTICLES})[{_BLANK}-]){{0,3}}(?:{_INITIALS}|{_CAPITAL_WORD}))*")
_TOKEN = regex.compile(rf"{_INITIALS}|[\p{{L}}\p{{M}}]+(?:['’]\p{{L}}+)*")
_NEXT = regex.compile(rf"([{_BLANK}-])({_INITIALS}|\p{{L}}\.|[\p{{L}}\p{{M}}]+(?:['’]\p{{L}}+)*)(?![^\W_]|@)")
_SENTENCE_END = regex.compile(r"[.!?;\n]")
_LETTER = regex.compile(r"\p{L}\.")
_COMMA_NEXT = regex.compile(r",[ \u00a0](\p{L}\.|[\p{L}\p{M}]+(?:['’](?!s\b)\p{L}+)*)(?![^\W_]|@)")
#: Ends of words of running Spanish and Portuguese: such a word is no name where letter case tells nothing.
_RUNNING = regex.compile(r"(?:ó|aron|ieron|aban?|ção|ções|ción|ciones|sión|mente|[ai]d[oa]s?|ando|[ie]ndo|aram|eram|avam?|i?dades?|ou|eu|iu|emos|amos|imos)$")
_FIRM_SHORT = {"s.a.", "s.r.l.", "s.l.", "n.v.", "b.v.", "s.c.", "l.l.c.", "p.l.c."}
#: What joins a name to the one before it.
_JOINING = {" and ", " y ", " e ", " nor ", " ni ", " or ", " & ", " und ", " et "}
#: Titles after which even an ordinary word with a capital is a name.
_STRONG_TITLES = {"mr", "mrs", "ms", "dr", "dra", "sr", "sra", "srta", "herr", "frau", "prof"}
_BEFORE_MENTION = regex.compile(r"(?<![^\W_])([\p{L}\p{M}]+|\p{L}\.)[ \u00a0_-]([\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)?)[ \u00a0]?[,(/|:][ \u00a0<(]*(?:(?:tel|phone|teléfono|telefone|mailto)[.: ]*)?$", regex.I)


class _Cases(dict):
    """Characters to ``U``, ``l`` or a blank, for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "U" if c.isupper() else "l" if c.islower() else " "
        return self[code]


_CASES = _Cases()
#: Whole words of one case, and from how many letters on they are a section of their own.
_CAPITALS_FROM, _SMALL_FROM = 40, 200
_ONE_CASE = re.compile(rf"(?<![Ul])(?:U[U ]{{{_CAPITALS_FROM - 1},}}|l[l ]{{{_SMALL_FROM - 1},}})(?![Ul])")


def sections(text: str) -> tuple[list[int], list[bool]]:
    """Starts of the sections of the whole text, and whether each is in mixed case, so that capitals tell something.

    Long stretches of one case are sections of their own, as is what stands between them; a single capital between
    them makes no mixed case.
    """
    cases = text.translate(_CASES)
    cuts = {0}
    for m in _ONE_CASE.finditer(cases):
        if len(m.group()) - m.group().count(" ") >= (_CAPITALS_FROM if cases[m.start()] == "U" else _SMALL_FROM):
            cuts |= {m.start(), m.end()}
    starts, mixed = sorted(cuts), []
    for start, end in zip(starts, [*starts[1:], len(text)]):
        upper, lower = cases.count("U", start, end), cases.count("l", start, end)
        mixed.append(0.005 < upper / max(upper + lower, 1) < 0.6 and (upper > 1 or len(starts) == 1))
    return starts, mixed


@lru_cache(maxsize=200_000)
def word_class(low: str) -> str:
    """Class of a word in lower case; one letter, or letters with full stops, are initials."""
    if low in _FIRM_SHORT:
        return FIRM
    if "." in low:
        return INITIAL
    if low in L.TITLES:
        return TITLE
    if low in L.ORGANISATION:
        return FIRM
    if low in L.NO_NAME:
        return NEVER
    if low in L.given_names():
        return GIVEN
    if low in L.family_names():
        return FAMILY
    if len(low) == 1:
        return NEVER
    if low in L.PARTICLES:
        return PARTICLE
    small, proper = L.vocabulary()
    return ORDINARY if low in small else PROPER if low in proper else UNKNOWN


class Names:
    """Finds names in one text. ``anchors`` has (start, end, word) of given and family names, titles, phrases before a name
    (``cue``) and after one (``follow``); ``taken`` holds the starts and ends of other mentions, in order."""

    def __init__(self, text: str, low: str, anchors: dict[str, list[tuple[int, int, str]]], taken: list[tuple[int, int]]):
        self.text, self.low, self.anchors, self.taken = text, low, anchors, taken
        self.title_at = {e: w for _, e, w in anchors["title"]}
        self.cue_ends = {e for _, e, _ in anchors["cue"]}
        self.starts, self.in_mixed = sections(text)
        self.sentence = (0, 0, False)

    def mixed(self, at: int) -> bool:
        return self.in_mixed[bisect_right(self.starts, at) - 1]

    def spans(self) -> Iterator[tuple[int, int]]:
        for start, end, mixed in zip(self.starts, [*self.starts[1:], len(self.text)], self.in_mixed):
            if mixed:
                yield from self.by_capitals(start, end)
        yield from self.by_anchors()

    # ---- where capitals tell something ----

    def before(self, start: int) -> tuple[str, bool]:
        """The title right before a place, if any, and whether a phrase for persons (and a title) stands before it."""
        gap = start
        while gap and self.text[gap - 1] in " :.\u00a0_\n\r\t":
            gap -= 1
        title = ""
        for end in (gap, gap + 1):
            if end in self.title_at and end <= start:
                title = self.title_at[end]
                gap = end - len(title)
                while gap and self.text[gap - 1] in " :.\u00a0_\n\r\t":
                    gap -= 1
                break
        return title, gap in self.cue_ends or gap + 1 in self.cue_ends

    def begins(self, at: int) -> bool:
        """Whether a sentence, a line or a field begins here."""
        while at and self.text[at - 1] in " \u00a0":
            at -= 1
        return at == 0 or self.text[at - 1] in ".!?:;\n\r\t\"“«•|>"

    def firm_after(self, end: int) -> bool:
        if self.text[end : end + 2] == " &":
            return True
        m = _NEXT.match(self.text, end)
        if not m:
            return False
        word = self.low[m.start(2) : m.end(2)]
        return word.rstrip(".") in L.ORGANISATION or word in _FIRM_SHORT

    def tokens(self, start: int, end: int) -> list[tuple[int, int, str]]:
        out = []
        for m in _TOKEN.finditer(self.text, start, end):
            low = self.low[m.start() : m.end()]
            cls = word_class(low)
            if cls == NEVER and len(low) == 1 and low not in "aeioyéà":
                cls = INITIAL
            if low in L.PARTICLES and (out or self.text[m.start()].islower()):
                cls = PARTICLE
            out.append((m.start(), m.end(), cls))
        return out

    def segments(self, start: int, end: int) -> Iterator[tuple[list[tuple[int, int, str]], bool]]:
        """Pieces of a run between words that are in no name, and whether each belongs to a firm."""
        piece: list[tuple[int, int, str]] = []
        firm = False
        for token in self.tokens(start, end):
            if token[2] in (TITLE, FIRM, NEVER):
                if piece:
                    yield piece, firm or token[2] == FIRM
                piece, firm = [], token[2] == FIRM and self.low[token[0] : token[1]] in L.ORGANISATION_FIRST
            else:
                piece.append(token)
        if piece:
            yield piece, firm or self.firm_after(piece[-1][1])

    def trimmed(self, piece: list[tuple[int, int, str]], title: str) -> list[tuple[int, int, str]]:
        while piece and piece[0][2] == PARTICLE:
            piece = piece[1:]
        at_start = bool(piece) and self.begins(piece[0][0])
        while len(piece) > 1 and piece[0][2] in (ORDINARY, PROPER) and not title and (at_start or piece[1][2] not in (UNKNOWN, FAMILY)) and not (piece[0][2] == PROPER and piece[1][2] in (UNKNOWN, FAMILY)):
            piece = piece[1:]
        if len(piece) > 2 and at_start and not title and piece[0][2] == UNKNOWN and piece[1][2] == GIVEN and self.text[piece[0][1]] != "-":
            piece = piece[1:]  # a sentence that begins with an unknown word
        while piece and (piece[-1][2] == PARTICLE or piece[-1][2] == ORDINARY and len(piece) > 1 and not (len(piece) == 2 and piece[0][2] == GIVEN)):
            piece = piece[:-1]
        return piece

    def accepted(self, piece: list[tuple[int, int, str]], title: str, cue: bool) -> bool:
        kinds = "".join(c for _, _, c in piece if c != PARTICLE)
        shouted = [self.text[a:b] for a, b, c in piece if c in (UNKNOWN, PROPER) and b - a > 1 and self.text[a:b].isupper()]
        if shouted and (any(len(w) < 3 or not _VOWELS.search(w.lower()) for w in shouted) or max(map(len, shouted)) < 4):
            return False
        if len(kinds) == 1:
            if title:
                return kinds in "GFUP" or kinds == ORDINARY and title in _STRONG_TITLES
            return cue and kinds in "GF" and self.low[piece[0][0] : piece[0][1]] not in L.vocabulary()[0]
        if GIVEN in kinds:
            first = self.low[piece[0][0] : piece[0][1]]
            return kinds not in ("GC", "CG") or title != "" or cue or first not in L.vocabulary()[0]
        strong = bool(title) or cue
        if kinds.strip("I") != kinds and kinds.count("I") < len(kinds):
            rest = kinds.strip("I")
            return (kinds[0] == INITIAL and any(c in "UF" for c in rest)) or strong and any(c in "UFP" for c in rest)
        known = kinds.count(UNKNOWN) + kinds.count(FAMILY)
        return known >= 2 or known == 1 and len(kinds) >= 2 or strong and kinds.count(PROPER) >= 2

    def turned(self, piece: list[tuple[int, int, str]], strong: bool) -> int | None:
        """End of ``Family, Given`` that begins with ``piece``, if it is one."""
        if len(piece) > 3 or not {c for _, _, c in piece} <= {UNKNOWN, FAMILY, PROPER, PARTICLE} or self.text[piece[-1][1] : piece[-1][1] + 1] != ",":
            return None
        at = piece[-1][1] + 1
        if self.text[at : at + 1] not in (" ", "\u00a0"):
            return None
        m = _RUN.match(self.text, at + 1)
        if not m:
            return None
        given, firm = next(self.segments(m.start(), m.end()), ([], True))
        if firm or not given or given[0][0] != m.start():
            return None
        while len(given) > 1 and given[-1][2] == ORDINARY:
            given = given[:-1]
        kinds = "".join(c for _, _, c in given)
        if kinds in ("G", "GI", "GG", "I", "II"):
            return given[-1][1]
        if kinds[0] == GIVEN and len(piece) == 1 and self.text[piece[0][0] - 1 : piece[0][0]] in ("", "\n"):
            return given[0][1]  # alone at the start of a line; a sentence begins behind it
        if kinds == UNKNOWN and (strong or self.begins(piece[0][0])):
            return given[-1][1]
        return None

    def by_capitals(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        done = start
        for run in _RUN.finditer(self.text, start, end):
            a, b = run.span()
            low = self.low[a:b]
            if low.isalpha() and len(low) > 1:  # one word: it needs a title, a phrase or a comma
                cls = word_class(low)
                titled = a - 1 in self.title_at or a - 2 in self.title_at or a - 3 in self.title_at
                if cls in (NEVER, FIRM, TITLE, PARTICLE) or cls not in (GIVEN, FAMILY) and not titled and self.text[b : b + 1] != ",":
                    continue
            for piece, firm in self.segments(a, b):
                if firm and len(piece) > 2 and piece[0][2] == GIVEN and piece[1][2] in (UNKNOWN, FAMILY):
                    piece, firm = piece[:2], False  # a name, and a firm's name right behind it
                if piece[0][0] < done or firm:
                    continue
                title, cue = self.before(piece[0][0])
                cue = cue or self.text[done : piece[0][0]] in _JOINING
                last = piece[-1][1]
                piece = self.trimmed(piece, title)
                if not piece:
                    continue
                if piece[-1][1] == last:
                    stop = self.turned(piece, bool(title) or cue)
                    if stop:
                        yield piece[0][0], stop
                        done = stop
                        continue
                before = self.word_before(piece[0][0])
                if before and self.low[before[0] : before[1]] in L.STREET_HONOURS - L.TITLES:
                    continue
                if self.accepted(piece, title, cue):
                    yield piece[0][0], piece[-1][1]
                    done = piece[-1][1]

    # ---- where they tell nothing ----

    def word_before(self, start: int) -> tuple[int, int] | None:
        """The word before a place, with one blank or hyphen between."""
        if start < 2 or self.text[start - 1] not in " \u00a0_-":
            return None
        end = at = start - 1
        if self.text[at - 1] == ".":
            at -= 1
        while at and (self.text[at - 1].isalpha() or self.text[at - 1] in "'’"):
            at -= 1
        if at == end or at and (self.text[at - 1].isalnum() or self.text[at - 1] in "@.+"):
            return None
        return at, end

    def small_class(self, start: int, end: int) -> str:
        """Class of a word where letter case tells nothing."""
        low = self.low[start:end]
        if low in L.PARTICLES:
            return PARTICLE
        cls = INITIAL if low.endswith(".") and len(low) == 2 else word_class(low.rstrip("."))
        if cls == UNKNOWN and (len(low) < 3 or _RUNNING.search(low) or not _VOWELS.search(low)):
            return ORDINARY
        return cls

    def go_right(self, end: int, most: int = 3) -> int:
        """End of the words of a name that follow."""
        at, count = end, 0
        while count < most:
            m = _NEXT.match(self.text, at)
            if not m:
                break
            cls = self.small_class(m.start(2), m.end(2))
            if cls == PARTICLE:
                n = _NEXT.match(self.text, m.end())
                if n and self.small_class(n.start(2), n.end(2)) == PARTICLE:
                    m, n = n, _NEXT.match(self.text, n.end())
                if not n or self.small_class(n.start(2), n.end(2)) not in (UNKNOWN, FAMILY, PROPER):
                    break
                m, cls = n, UNKNOWN
            if cls not in (UNKNOWN, FAMILY, GIVEN, PROPER, INITIAL):
                break
            at, end, count = m.end(), m.end(), count + (cls != INITIAL)
        return end

    def by_anchors(self) -> Iterator[tuple[int, int]]:
        done = -1
        places = [(s, e, "G") for s, e, _ in self.anchors["given"]] + [(s, e, "F") for s, e, _ in self.anchors["family"]]
        places += [(e, e, "T") for _, e, _ in self.anchors["title"]] + [(e, e, "Q") for _, e, _ in self.anchors["cue"]]
        places += [(s, s, "A") for s, _ in self.taken] + [(s, s, "R") for s, _, _ in self.anchors["follow"]]
        if all(self.in_mixed):
            places = [p for p in places if p[2] == "G"]
        for start, end, kind in sorted(places):
            if start < done or self.mixed(max(start - 1, 0)) and not (kind == "G" and self.text[start].islower() and self.without_capitals(start)):
                continue
            found = self.at_name(start, end, kind) if kind in "GF" else self.after(start, kind == "T") if kind in "TQ" else self.ahead_of(start, kind == "A")
            if found and not self.firm_after(found[1]):
                yield found
                done = found[1]

    def without_capitals(self, at: int) -> bool:
        """Whether the sentence or line around a place has none, although the text has some."""
        if self.sentence[0] <= at < self.sentence[1]:  # each sentence is looked at once
            return self.sentence[2]
        end = _SENTENCE_END.search(self.text, at)
        begin = max(self.text.rfind(c, 0, at) for c in ".!?;\n") + 1
        stop = end.start() if end else len(self.text)
        self.sentence = (begin, stop, self.text[begin:stop] == self.low[begin:stop])
        return self.sentence[2]

    def at_name(self, start: int, end: int, kind: str) -> tuple[int, int] | None:
        if start and self.text[start - 1] in "@+." or self.text[end : end + 1] in ("@", "+"):
            return None
        if word_class(self.low[start:end]) not in (GIVEN, FAMILY):
            return None
        stop, begin = self.go_right(end), start
        before = self.word_before(start)
        if before and self.small_class(*before) in ((UNKNOWN, INITIAL, GIVEN, PROPER) if kind == "F" else (INITIAL,)):
            begin = before[0]
        elif before and kind == "F" and self.low[before[0] : before[1]] in L.PARTICLES:
            further = self.word_before(before[0])
            if further and self.small_class(*further) in (UNKNOWN, GIVEN):
                begin = further[0]
        if kind == "G" and stop == end and begin == start and start > 2 and self.text[start - 1] in " \u00a0" and self.text[start - 2] == ",":
            at = start - 2
            while at and (self.text[at - 1].isalpha() or self.text[at - 1] in "'’-"):
                at -= 1
            if at < start - 4 and self.small_class(at, start - 2) in (UNKNOWN, FAMILY, PROPER):
                return at, end
        if kind == "F" and begin == start:
            m = _COMMA_NEXT.match(self.text, stop)
            if m and self.small_class(m.start(1), m.end(1)) in (GIVEN, INITIAL) and self.go_right(m.end()) == m.end():
                return start, m.end()
        if stop > end and (kind == "G" and self.low[start:end] not in L.vocabulary()[0] or kind == "F") or begin < start:
            return begin, stop
        title, cue = self.before(start)
        return (start, stop) if title or cue else None

    def after(self, at: int, title: bool) -> tuple[int, int] | None:
        """A name after a title or a phrase for persons."""
        while at < len(self.text) and self.text[at] in ".: \u00a0_\n\r":
            at += 1
        m = _TOKEN.match(self.text, at)
        while m and self.low[m.start() : m.end()] in L.TITLES and self.text[m.end() : m.end() + 1] in (".", " ", "\u00a0"):
            at, title = m.end(), True
            while at < len(self.text) and self.text[at] in ". \u00a0_":
                at += 1
            m = _TOKEN.match(self.text, at)
        if self.text[at + 1 : at + 2] == ".":
            m = _LETTER.match(self.text, at)
        if not m:
            return None
        cls = self.small_class(m.start(), m.end())
        if cls not in (UNKNOWN, GIVEN, FAMILY, PROPER, INITIAL):
            return None
        stop = self.go_right(m.end())
        if stop == m.end() and cls in (UNKNOWN, FAMILY, PROPER):
            n = _COMMA_NEXT.match(self.text, stop)
            if n and self.small_class(n.start(1), n.end(1)) in (UNKNOWN, GIVEN, INITIAL):
                return m.start(), n.end()
        if cls == PROPER and not title and stop == m.end():
            return None
        return (m.start(), stop) if stop > m.end() or cls in (GIVEN, FAMILY) or title and cls == UNKNOWN else None

    def ahead_of(self, at: int, mention: bool) -> tuple[int, int] | None:
        """A name right before another mention, or before a phrase that follows names."""
        if mention:
            # the two words and the sign between: what stands before the last six blanks or line ends doesn't matter
            left = at
            for _ in range(6):
                left = max(self.text.rfind(" ", 0, left), self.text.rfind("\n", 0, left), 0)
                if not left:
                    break
            m = _BEFORE_MENTION.search(self.text, left, at)
            words = [m.span(1), m.span(2)] if m else []
        else:
            last = self.word_before(at)
            first = self.word_before(last[0]) if last else None
            words = [first, last] if last and first else []
        if not words or self.small_class(*words[0]) not in (UNKNOWN, GIVEN, FAMILY, INITIAL) or self.small_class(*words[1]) not in (UNKNOWN, GIVEN, FAMILY):
            return None
        return words[0][0], words[1][1]
