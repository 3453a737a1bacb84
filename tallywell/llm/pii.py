"""Personal data with offset-preserving deobfuscation.

The plain patterns give the base spans. A transducer then rewrites disguises to plain characters: homoglyphs and other
compatibility forms (also those of several letters), zero-width characters, digits spelled out in English, French, German or
Spanish, and at/dot written in words of these languages, brackets or entities. It keeps for each piece of the rewritten text where
it came from, so what the same patterns find there is mapped back to code points of the source. A mapped span is added unless a
base span of its kind covers it; base spans always stay. A bare "at" in plain words is prose far more often than an address:
it counts before a dot in disguise, or where the word before it has a figure, dot or underscore and a host name follows.

Every finder takes time linear in the text: no pattern begins with white space. Defined results: a null or empty text has no spans; repeated rows are searched
each for itself; an empty table gives an empty table; only the id and the text are read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import mapped
from tallywell.llm.spans import SPANS, counted, in_order, joined

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin inside a run of digits if it could also begin at the run's start, so the look-behind changes nothing but the time.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = str.maketrans("", "", " -().+")

Found = list[tuple[int, int]]


def emails(text: str) -> Found:
    """As the pattern would match, leftmost and non-overlapping, but found from each @ outwards."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> Found:
    return [m.span() for m in IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]


def luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def cards(text: str) -> Found:
    return [m.span() for m in CARD.finditer(text) if m.end() - m.start() <= 37 and 12 <= len(d := m[0].translate(DIGITS)) <= 19 and luhn(d)]


def phones(text: str) -> Found:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(m[0].translate(DIGITS)) <= 15]


FINDERS: tuple[Callable[[str], Found], ...] = (emails, ips, cards, phones)

#: Letters of other scripts that look like Latin ones (compatibility forms such as full-width need no list: NFKC gives them).
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһԛԝвкмтнзАВЕКМНОРСТУХІЅЈοαερνικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧı", "aeopcyxijsdhqwbkmth3ABEKMHOPCTYXISJoaepviktuxABEZHIKMNOPTYXi")
HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
NUMBERS = (
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
SPELLED = {w: str(i) for words in NUMBERS for i, w in enumerate(words.split())} | {"oh": "0", "zwo": "2"}
DIGIT = rf"(?:{'|'.join(sorted(SPELLED, key=len, reverse=True))}|[0-9])"
PLUS = "plus|más"
#: Digits spelled out, one after another; at least three words.
RUN = rf"\b(?:(?:{PLUS})[ ,-]{{1,2}})?{DIGIT}(?:[ ,-]{{1,2}}{DIGIT}){{2,}}\b"
#: Words for @ and for a dot; the first at is prose too, the others are not.
AT_WORDS = "at|arobase|arroba|klammeraffe"
DOT_WORDS = "dot|punkt|point|punto"
# White space before a disguise is taken up afterwards, so that runs of it are looked at once.
AT = rf"[\[({{<]\s*(?:{AT_WORDS}|@)\s*[\])}}>]\s*|&#(?:64|x40);|&commat;|%40"
DOT = rf"[\[({{<]\s*(?:{DOT_WORDS}|\.)\s*[\])}}>]\s*|&#(?:46|x2e);|&period;"
BARE_AT = rf"(?<=\s)(?:{AT_WORDS})\s+(?=[a-z0-9])"
BARE_DOT = rf"(?<=\s)(?:{DOT_WORDS})\s+(?=[a-z0-9])"
#: A host's first label, and a dot in disguise after it.
DISGUISED = re.compile(rf"(?i:[a-z0-9-]{{1,63}}(?:\s{{1,4}}(?:{DOT_WORDS})\s|\s{{0,4}}(?:{DOT})))")
HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z0-9-])")
ODD = rf"[^\x00-\x7f\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6\u00b7\u00bb\u00bf-\u0130\u0132-\u024f\u2018-\u201f\u2026\u20ac]|[{HIDDEN}]"
#: Whether the transducer has anything to do; most texts end here.
TRIGGER = re.compile(
    rf"(?i:\b(?:{DOT_WORDS}|arobase|arroba|klammeraffe)\b|\bat\s+[a-z0-9-]{{1,63}}\.[a-z]|[\[({{<]\s*(?:{AT_WORDS}|@|{DOT_WORDS}|\.)\s*[\])}}>]|&#(?:64|46|x40|x2e);|&commat;|&period;|%40|\b{DIGIT}[ ,-]{{1,2}}{DIGIT}[ ,-]{{1,2}}{DIGIT}\b)|{ODD}"
)
REWRITE = re.compile(rf"(?P<run>(?i:{RUN}))|(?P<at>(?i:{AT}))|(?P<dot>(?i:{DOT}))|(?P<bare_at>(?i:{BARE_AT}))|(?P<bare_dot>(?i:{BARE_DOT}))|(?P<odd>{ODD})")


def plain_char(c: str) -> str | None:
    """What one unusual character stands for; None: itself."""
    if c in HIDDEN:
        return ""
    if c in DASHES:
        return "-"
    got = c.translate(HOMOGLYPHS)
    if got == c:
        got = unicodedata.normalize("NFKC", c)
        if got in ("。", "․"):
            got = "."
        if len(got) == 1 and not got.isascii() and (d := unicodedata.digit(got, None)) is not None:
            got = str(d)
    return got if got and got.isascii() else None


class Transduced:
    """A rewritten text and, for each piece of it, its place in the source."""

    def __init__(self, text: str) -> None:
        self.parts: list[str] = []
        self.at: list[int] = []  # where each piece begins in the rewritten text
        self.source: list[tuple[int, int, bool]] = []  # its source span, and whether it is copied as it stands
        self.length, done = 0, 0
        for m in REWRITE.finditer(text):
            pieces = self.rewritten(m, done)
            if pieces is None:
                continue
            if pieces and pieces[0][1] > done:
                self.add(text[done : pieces[0][1]], done, pieces[0][1], True)
            for to, start, end in pieces:
                self.add(to, start, end, False)
            done = m.end()
        self.changed = bool(self.at)
        if done < len(text):
            self.add(text[done:], done, len(text), True)
        self.text = "".join(self.parts)

    def add(self, to: str, start: int, end: int, copied: bool) -> None:
        if to:
            self.parts.append(to)
            self.at.append(self.length)
            self.source.append((start, end, copied))
            self.length += len(to)

    def rewritten(self, m: re.Match, done: int) -> list[tuple[str, int, int]] | None:
        """The pieces that stand for a match, with their source spans; None if it stays as it is. `done`: where the last one ended."""
        kind = m.lastgroup
        if kind == "odd":
            to = plain_char(m[0])
            return None if to is None else [(to, *m.span())]
        if kind == "run":
            words = [(w, m.start() + a.start(), m.start() + a.end()) for a in re.finditer(r"[^\W\d_]+|[0-9]", m[0]) if (w := a[0].lower())]
            if not any(w in SPELLED for w, _, _ in words):
                return None  # figures with spaces are for the plain patterns
            return [(SPELLED.get(w, "+" if w in PLUS.split("|") else w), a, b) for w, a, b in words]
        text, start = m.string, m.start()
        while start > done and text[start - 1].isspace():
            start -= 1
        if kind.startswith("bare") and not (self.bare_at if kind == "bare_at" else self.bare_dot)(m, start, done):
            return None
        return [("@" if kind.endswith("at") else ".", start, m.end())]

    def bare_at(self, m: re.Match, start: int, done: int) -> bool:
        before = re.search(r"[A-Za-z0-9._%+-]*$", m.string[max(done, start - 64) : start])[0]
        if not before and not (done == start and self.source):
            return False
        if DISGUISED.match(m.string, m.end()):
            return True
        return bool((m[0].split()[0].lower() != "at" or re.search(r"[0-9._]", before)) and HOST.match(m.string, m.end()))

    def bare_dot(self, m: re.Match, start: int, done: int) -> bool:
        """English "dot" after any word; the others, which are words of prose too, only within an address: after an @ or what stands for one."""
        before = re.search(r"\S*$", m.string[max(done, start - 64) : start])[0]
        if m[0].split()[0].lower() == "dot":
            return bool(before) and (before[-1].isascii() and before[-1].isalnum())
        return ("@" in before and "." not in before.rpartition("@")[2]) or (bool(before) and len(before) == start - done and bool(self.parts) and self.parts[-1] in "@.")

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of a span of the rewritten text, and whether any rewritten piece is in it."""
        a, b = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        (s, _, s_copied), (e, e_end, e_copied) = self.source[a], self.source[b]
        first = s + (start - self.at[a] if s_copied else 0)
        last = e + (end - self.at[b]) if e_copied else e_end
        # A piece that became nothing (a zero-width character) lies between two copied ones.
        changed = any(not x[2] for x in self.source[a : b + 1]) or last - first != end - start
        return first, last, changed


def find(text: str) -> list[tuple[str, int, int, bool]]:
    found = [(kind, a, b, True) for kind, finder in zip(KINDS, FINDERS) for a, b in finder(text)]
    if TRIGGER.search(text):
        made = Transduced(text)
        if made.changed:
            base = {kind: [(a, b) for k, a, b, _ in found if k == kind] for kind in KINDS}
            for kind, finder in zip(KINDS, FINDERS):
                starts = [a for a, _ in base[kind]]
                for a, b in finder(made.text):
                    start, end, changed = made.back(a, b)
                    i = bisect_right(starts, start) - 1
                    if changed and not (i >= 0 and base[kind][i][1] >= end):
                        found.append((kind, start, end, False))
    return in_order(found, KINDS)


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named by the first."""
    out, done = [], 0
    for kind, a, b, _ in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `spans`, in order of their start, then of KINDS. One narrow pass."""
    return mapped(docs, lambda: lambda t: ([dict(zip(("kind", "start", "end", "base"), s)) for s in find(t)],), f"spans {SPANS}", key, text)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `redacted`, the text with each span replaced by its kind. One narrow pass."""
    return mapped(docs, lambda: lambda t: (masked(t, find(t)),), "redacted string", key, text)


def redact_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with the text redacted (null: empty). One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text)
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                made = pa.array([masked(t, find(t)) if t else "" for t in part.column(i).to_pylist()], part.schema.field(i).type)
                yield pa.RecordBatch.from_arrays([made if j == i else part.column(j) for j in range(part.num_columns)], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    s = F.col("spans")
    return found.select("doc_id", *(counted(s, k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(s, True), 256).alias("base_sha256"), joined(s).alias("spans"))
