"""Personal data: base spans against the plain patterns, disguises, and time on odd texts."""

from __future__ import annotations

import re
import time

import numpy as np
import pyarrow.dataset as ds
import pytest

from tallywell.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def kept(kind: str, text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text: str) -> list[tuple[str, int, int]]:
    return sorted((kind, *m.span()) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if kept(kind, m[0]))


def base(text: str) -> list[tuple[str, int, int]]:
    return sorted((k, a, b) for k, a, b, is_base in pii.find(text) if is_base)


def test_base_spans_are_the_patterns(data):
    texts = ds.dataset(f"{data}/documents.parquet").to_table(columns=["text"]).to_pydict()["text"]
    texts += ["a@b.c@d.ef", "x" * 3000 + "@", "+1 (234) 567-8901 and 4111 1111 1111 1111, 4111 1111 1111 1112, 1.2.3.4.5 999.1.1.1 001.02.3.4", "4012-8888-8888-1881 5500000000000004 +49 (0)30 1234-5678. +12 3", ""]
    rng = np.random.default_rng(0)
    texts += ["".join(rng.choice(list("0123456789 .-+()@ab"), 60)) for _ in range(3000)]
    cards = 0
    for t in texts:
        assert base(t) == plain(t)
        cards += sum(k == "card" for k, _, _ in plain(t))
    assert cards > 10 and {k for t in texts for k, _, _ in plain(t)} == set(PATTERNS)


FOUND = [
    ("email", "write to ", "john [at] example [dot] com", " now"),
    ("email", "mail ", "john at example dot com", " now"),
    ("email", "mail ", "john.doe at example.com", " now"),
    ("email", "mail ", "j.d  (at)\n mail (dot) example (dot) org", ", please"),
    ("email", "courriel ", "jean arobase exemple point fr", " merci"),
    ("email", "courriel ", "jean@exemple point fr", " merci"),
    ("email", "correo ", "juan arroba ejemplo punto es", " hoy"),
    ("email", "correo ", "juan arroba ejemplo.es", " hoy"),
    ("email", "per Mail ", "hans (at) beispiel punkt de", " heute"),
    ("email", "per Mail ", "hans klammeraffe beispiel punkt de", " heute"),
    ("email", "see ", "jo\ufb01@example.com", " there"),
    ("email", "see ", "adm\u0131n@ex\u0430mple.com", " there"),
    ("email", "see ", "j\u200bohn%40example&#46;com", " there"),
    ("phone", "call ", "plus one two three four five six seven eight nine", " now"),
    ("phone", "appelez ", "plus trois trois un quatre deux deux sept huit neuf", " vite"),
    ("phone", "ruf ", "plus vier neun drei null eins zwei zwo sieben acht", " an"),
    ("phone", "llama ", "m\u00e1s tres cuatro nueve uno dos tres cuatro cinco seis", " ya"),
    ("ip", "host ", "10 dot 0 dot 0 dot 1", " up"),
    ("card", "pay ", "\uff14111 1111 1111 1111", " soon"),
]


@pytest.mark.parametrize("kind, before, hidden, after", FOUND)
def test_disguises_are_found_in_place(kind, before, hidden, after):
    text = before + hidden + after
    assert [(k, text[a:b]) for k, a, b, _ in pii.find(text)] == [(kind, hidden)]


@pytest.mark.parametrize("text", ["look at example.com now", "we met at noon, dot by dot", "un point de vue, deux points de repos", "punto de encuentro at the end", "am Punkt de eins zwei", "one two, three at four.five"])
def test_prose_stays(text):
    assert pii.find(text) == []


@pytest.mark.parametrize("fill", [" ", "\n", "[ ", "at ", "x at ", "dot ", "a dot ", "(at", "1 ", "one ", "%40 ", "a@", "1.", "+1", "+1 ", "\ufb01", "point ", "at a.", "&#64;", "-"])
def test_time_is_linear(fill):
    text = "john%40" + fill * (200_000 // len(fill)) + "%40 dot com"
    start = time.perf_counter()
    pii.find(text)
    assert time.perf_counter() - start < 2.5


def test_masked_and_odd_rows(spark):
    rows = [(1, None), (None, "a@b.co"), (2, ""), (3, "x a@b.co y"), (3, "x a@b.co y")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, spans string")
    got = sorted(((r.doc_id, r.n_email, r.spans) for r in pii.digests(pii.detect(docs)).collect()), key=str)
    assert got == sorted([(1, 0, ""), (None, 1, "email:0:6"), (2, 0, ""), (3, 1, "email:2:8"), (3, 1, "email:2:8")], key=str)
    assert sorted(r.text for r in pii.redact_rows(docs).collect()) == ["", "", "<EMAIL>", "x <EMAIL> y", "x <EMAIL> y"]
    assert pii.detect(docs.where("false")).collect() == []
