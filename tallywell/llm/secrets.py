"""Secrets by plain patterns and by sliding-window Shannon entropy.

The plain patterns give the base spans. Besides, each candidate string (a run of key-like characters) gets a character
class; a window slides over it while the counts of its characters, and so its entropy, are kept up to date by adding one
character and taking away another. Windows at or over the class's threshold are joined to a span of kind `entropy`.
An allow-list suppresses what looks random but is none: words, identifiers, paths, UUIDs, dates and counters, data URIs'
padding; and whatever a base span already covers.

Linear in the text. Defined results: a null or empty text has no spans; repeated rows are searched each for itself; an empty
table gives an empty table; only the id and the text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import mapped
from tallywell.llm.spans import SPANS, counted, in_order, joined

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: What a text must hold, in lower case, to have any assignment.
NAMES = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

WINDOW = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
#: Least entropy, in bits a character, of a window of 20 in each character class; a random one has about 3.3, 3.6 and 4.0.
THRESHOLDS = {"hex": 3.0, "alnum": 3.4, "mixed": 3.6}
#: Suppressed although they may reach a threshold.
ALLOWED = tuple(
    re.compile(p)
    for p in (
        r"[A-Za-z]+$",  # one word, also in camel case
        r"(?:[A-Za-z]+[_/+=-]+)*[A-Za-z]*\d{0,4}$",  # words joined to an identifier or path, perhaps numbered
        r"[0-9_/+=-]+$",  # dates, counters, rulers
        r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",  # UUID
    )
)
C_LOG_C = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def char_class(s: str) -> str | None:
    """hex: figures and a to f of one case; alnum: figures and letters of one case; mixed: figures and both; else None."""
    figures, lower, upper = (any(a <= c <= b for c in s) for a, b in ("09", "az", "AZ"))
    if not figures or not (lower or upper):
        return None
    if not (lower and upper):
        return "hex" if all(c in "0123456789abcdefABCDEF" for c in s) else "alnum"
    return "mixed"


def dense(s: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined spans of the windows whose entropy is at least the threshold."""
    counts = Counter(s[:window])
    total = sum(C_LOG_C[c] for c in counts.values())
    most = (log2(window) - threshold) * window  # entropy is log2(window) - total / window
    out: list[list[int]] = []
    for start in range(len(s) - window + 1):
        if start:
            gone, new = s[start - 1], s[start + window - 1]
            if gone != new:
                for c, by in ((gone, -1), (new, 1)):
                    n = counts[c]
                    total += C_LOG_C[n + by] - C_LOG_C[n]
                    counts[c] = n + by
        if total <= most + 1e-9:
            if out and start <= out[-1][1]:
                out[-1][1] = start + window
            else:
                out.append([start, start + window])
    return [(a, b) for a, b in out]


def find(text: str) -> list[tuple[str, int, int, bool]]:
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [("assign", *m.span(), True) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [("access", *m.span(), True) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span(), True) for m in HEX.finditer(text)]
    added = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        kind = char_class(s)
        if kind and not any(p.match(s) for p in ALLOWED):
            added += [("entropy", m.start() + a, m.start() + b, False) for a, b in dense(s, THRESHOLDS[kind])]
    if added:
        base = sorted((a, b) for _, a, b, _ in found)
        ends = list(accumulate((b for _, b in base), max))
        for x in added:
            i = bisect_right(base, (x[1], len(text) + 1))
            if not i or ends[i - 1] < x[2]:
                found.append(x)
    return in_order(found, KINDS)


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `spans`, in order of their start, then of KINDS. One narrow pass."""
    return mapped(docs, lambda: lambda t: ([dict(zip(("kind", "start", "end", "base"), s)) for s in find(t)],), f"spans {SPANS}", key, text)


def digests(found: DataFrame) -> DataFrame:
    s = F.col("spans")
    return found.select("doc_id", *(counted(s, k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(s, True), 256).alias("base_sha256"), joined(s).alias("spans"))
