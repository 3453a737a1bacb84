"""Periodic runs against a plain search over all stretches."""

from __future__ import annotations

import hashlib
import re
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import connection, same
from tallywell.llm import periodic, queries


def plain_runs(w: list[str]) -> list[tuple[int, int, int]]:
    """start, length, period by the definition: word by word, each stretch's smaller periods tried out."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_tail(key: int, w: list[str]) -> list[str]:
    h = crc32(str(key).encode())
    if h % 10 or not w:
        return w
    a = h // 10 % len(w)
    p = 1 + (len(w) - a) // (3 + h // 10 % 8)
    return [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]


def plain_row(key: int, text: str | None) -> tuple:
    w = plain_tail(key, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(found), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def rows(frame) -> list[tuple]:
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted(tuple(r[c] for c in names) for r in frame.collect())


def test_query_equals_the_plain_search(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    short = [(k, t) for k, t in docs if len((t or "").split()) < 700]
    assert len(short) > 100
    found = {r[0]: r for r in rows(queries.op13_periodic_runs(spark, data))}
    assert len(found) == len(docs)
    for k, t in short:
        assert found[k] == plain_row(k, t)
    assert sum(found[k][1] > 0 for k, _ in docs if crc32(str(k).encode()) % 10 == 0) > 5


def test_query_equals_its_sql(spark, data):
    assert same(queries.op13_periodic_runs(spark, data), connection(data), queries.OP13_SQL) == 200


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 12), st.integers(0, 60))
def test_scan_finds_what_the_definition_says(noise, period, length):
    w = noise + [noise[i % period] if i % period < len(noise) else 7 + i % period for i in range(length)] + noise[::-1]
    ids = np.array(w, np.int32)
    assert sorted((s, e - s, q) for s, e, q in periodic.scan(ids)) == sorted(plain_runs(w))


def test_scan_keeps_long_periods_and_blocks_of_lags(monkeypatch):
    monkeypatch.setattr(periodic, "CELLS", 64)
    rng = np.random.default_rng(5)
    block = rng.integers(0, 1000, 331)
    ids = np.concatenate([rng.integers(0, 1000, 57), np.tile(block, 5)[:1500], rng.integers(0, 1000, 90), np.full(40, 3)]).astype(np.int32)
    found = {(s, e - s, q) for s, e, q in periodic.scan(ids)}
    assert found == set(plain_runs(ids.tolist())) and any(q == 331 for _, _, q in found)


@pytest.mark.parametrize("comparisons,most", [(50, 16), (5000, 3), (1 << 24, 16)])
def test_ranges_of_lags_find_the_same(spark, data, comparisons, most):
    docs = periodic.repeated_tails(spark.read.parquet(f"{data}/documents.parquet").where("n_chars < 4000"))
    one = periodic.digests(periodic.runs(docs))
    dealt = periodic.digests(periodic.runs(docs, long=200, comparisons=comparisons, most=most))
    assert rows(one) == rows(dealt)


def test_long_document_of_one_word_is_one_run(spark):
    docs = spark.createDataFrame([(7, "a " * 30_000)], "doc_id bigint, text string")
    r = periodic.runs(docs).first()
    assert [tuple(x) for x in r.runs] == [(0, 30_000, 1)] and r.collapsed == "a" and r.n_words == 30_000


def test_odd_rows(spark):
    text = "x\u00a0y z " * 6 + "\u2028 end"
    given = [(None, "a a a a a a"), (1, None), (2, ""), (3, " \t\n "), (4, text), (4, text), (5, "b b b b b"), (6, "a b a b a b a b")]
    docs = spark.createDataFrame([(k, t, None, 3) for k, t in given], "doc_id bigint, text string, runs string, row int")
    for long in (0, 1 << 15):
        found = periodic.runs(docs, long=long).collect()
        assert len(found) == len(given)
        by = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in found}
        assert by == {(None, "a"): [(0, 6, 1)], (1, ""): [], (2, ""): [], (3, ""): [], (4, "x\u00a0y z \u2028 end"): [(0, 12, 2)], (5, "b b b b b"): [], (6, "a b"): [(0, 8, 2)]}
    none = docs.where("false")
    assert periodic.digests(periodic.runs(none)).collect() == []
    odd = {r[0]: r for r in rows(periodic.digests(periodic.runs(docs.where("doc_id < 3"))))}
    empty = hashlib.sha256(b"").hexdigest()
    assert odd[1] == (1, 0, None, None, None, None, empty, empty) and odd[2][1:] == odd[1][1:]
