"""SimHash: fingerprints, links, components and kept rows against plain versions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow.dataset as ds
import xxhash

from tallywell.llm import simhash


def plain_fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def test_fingerprints(data):
    texts = ds.dataset(f"{data}/documents.parquet").to_table(columns=["text"]).to_pydict()["text"]
    for t in [*texts, "", " \t\n", "One", "one TWO", "a a a a a a", "\u0130stanbul \u00a0 x", "x" * 5000]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def near(a: int, b: int) -> bool:
    return ((a ^ b) & (2**64 - 1)).bit_count() <= 3


def roots_of(fps: list[int]) -> dict[int, int]:
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if near(a, b):
                u, v = sorted((top(a), top(b)))
                root[v] = u
    return {f: top(f) for f in fps}


def test_links_are_exact(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 40)
    fps = sorted({int(b) ^ sum(1 << int(p) for p in rng.choice(62, int(rng.integers(0, 6)), replace=False)) for b in base for _ in range(12)})
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()}
    assert got == {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if near(a, b)}


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = rng.integers(-(2**63), 2**63, 5)
        fps = list({int(b) ^ sum(1 << int(p) for p in rng.choice(60, int(rng.integers(0, 7)), replace=False)) for b in base for _ in range(30)})
        pick = rng.random(len(fps)) < 0.5
        a, b = (np.array([f for f, p in zip(fps, pick) if p == own or rng.random() < 0.2], np.int64) for own in (True, False))
        u, v = simhash.forest(a, b)
        assert all(near(x, y) for x, y in zip(u.tolist(), v.tolist())) and len(u) < len(a) + len(b)
        both = [f for f in fps if f in set(a.tolist()) | set(b.tolist())]
        root = {f: f for f in both}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        pairs = [(x, y) for x in a.tolist() for y in b.tolist() if near(x, y)]
        for some in (list(zip(u.tolist(), v.tolist())), pairs):
            before = {f: top(f) for f in both}
            for x, y in some:
                s, t = sorted((top(x), top(y)))
                root[t] = s
        assert before == {f: top(f) for f in both}  # the pairs connect nothing more


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """10,000 different fingerprints around one: links in proportion, and the same components as by all pairs for a part of them."""
    rng = np.random.default_rng(6)
    center = int(rng.integers(-(2**63), 2**63))
    fps = {center}
    while len(fps) < 10_000:
        fps.add(center ^ sum(1 << int(p) for p in rng.choice(62, 3, replace=False)))
    some = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    found = simhash.links(some)
    n = found.count()
    assert n < 40 * len(fps)
    roots = simhash.connected_components(found)
    assert roots.count() == len(fps) and roots.select("root").distinct().count() == 1
    monkeypatch.setattr(simhash, "DENSE", 8)
    monkeypatch.setattr(simhash, "BLOCK", 32)
    part = sorted({f ^ (int(rng.integers(0, 40)) << 40) for f in list(fps)[:700]})
    want = roots_of(part)
    got = {r.node: r.root for r in simhash.connected_components(simhash.links(spark.createDataFrame([(f,) for f in part], "fp bigint"))).collect()}
    assert {f: got.get(f, f) for f in part} == want


def test_values_on_odd_rows(spark):
    """Nulls, empty and repeated texts are linked; a null id names no component that has another id."""
    rows = [(None, "a b c"), (1, "A b  c"), (2, None), (3, ""), (None, " "), (4, "a b c"), (4, "other words stand here"), (None, "all alone in this row")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.digests(simhash.near_duplicates(docs)).collect()), key=str)
    fp = lambda t: f"{plain_fingerprint(t):016x}"
    assert got == sorted([(None, fp("a b c"), 1), (1, fp("a b c"), 1), (2, "0" * 16, 2), (3, "0" * 16, 2), (None, "0" * 16, 2), (4, fp("a b c"), 1), (4, fp("other words stand here"), 4), (None, fp("all alone in this row"), None)], key=str)
    assert simhash.near_duplicates(docs.where("false")).collect() == []


def test_kept_rows_keep_their_columns(spark):
    """Columns named as the operator's own, and an input that isn't read from files."""
    rows = [(i, "same text here" if i < 3 else f"text number {i} stands alone", 70 + i, i, "x") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row bigint, fp bigint, _row string").repartition(4)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = {tuple(r) for r in kept.collect()}
    assert got <= set(rows) and len(got) == 4 and len({r[1] for r in got}) == 4
