"""Substring dedup: windows, comparison, links and recall against plain versions."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from tallywell.llm import decontam, queries, windows

T = windows.TOKENS


def texts_of(data: str) -> dict[int, str]:
    t = ds.dataset(f"{data}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


def some_words(rng, n: int) -> list[str]:
    return [f"q{i}" for i in rng.integers(0, 100_000, n)]


def found_in(spark, rows, parts=3) -> dict[int, list]:
    got: dict[int, list] = {}
    for r in windows.passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)).collect():
        got.setdefault(r.doc_id, []).append(r)
    return got


def plain_windows(x, t):
    out = set()
    for c in range(len(x)):
        left, right = c, c
        while left > 0 and x[left - 1] > x[c]:
            left -= 1
        while right + 1 < len(x) and x[right + 1] >= x[c]:
            right += 1
        if right - left + 1 >= t:
            out.add((left, c, right))
    return out


def test_compact_windows():
    rng = np.random.default_rng(0)
    for _ in range(300):
        t, sizes = int(rng.integers(2, 12)), rng.integers(0, 60, 4)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        x = rng.integers(0, rng.integers(2, 50), offsets[-1]).astype(np.uint64) << np.uint64(40)
        got = windows.compact_windows(x, offsets, windows.starts_of(offsets, t), t)
        want = {(a + o, b + o, c + o) for o, n in zip(offsets.tolist(), sizes.tolist()) for a, b, c in plain_windows(x[o : o + n], t)}
        assert sorted(zip(*(v.tolist() for v in got))) == sorted(want)


def test_tokens_are_of_one_text_each():
    texts = ["", "A b c d e f", "one two", "a b C d e", "\u00e4 b c d e", "a,b;c d\ne"]
    x, offsets = windows.tokens_of(texts)
    assert np.diff(offsets).tolist() == [0, 2, 0, 1, 1, 1]
    assert x[0] == x[2] == x[4] != x[3]
    for t, a, b in zip(texts, offsets, offsets[1:]):
        assert windows.tokens_of([t])[0].tolist() == x[a:b].tolist()


def test_joint_windows_hold_for_every_stretch():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = windows.mixed(rng.integers(0, rng.integers(2, 400), int(rng.integers(T, 300))).astype(np.uint64))
        for (f, g), (keys, places) in zip(windows.PAIRS, windows.joint_windows(x, np.array([0, len(x)]))):
            a, b = windows.mixed(x * windows.MULTIPLIERS[f]), windows.mixed(x * windows.MULTIPLIERS[g])
            least = [(s + int(a[s : s + T].argmin()), s + int(b[s : s + T].argmin())) for s in range(len(x) - T + 1)]
            own = list(dict.fromkeys(least))
            assert places.tolist() == [c for c, _ in own]
            # keys are equal just where both tokens and their distance are
            assert len({(k, a[c], b[d], d - c) for k, (c, d) in zip(keys.tolist(), own)}) == len(set(keys.tolist()))


def test_comparison_is_multiset_jaccard():
    """All stretches with the shared token, against counting; texts with few different words have many repeated tokens."""
    rng = np.random.default_rng(9)
    for _ in range(60):
        x = rng.integers(0, rng.choice([8, 40, 10**6]), 150).astype(np.uint64)
        y = np.insert(np.delete(x, rng.integers(30, 120, rng.integers(0, 4))), rng.integers(30, 100, rng.integers(0, 4)), np.uint64(5))
        i, j = rng.integers(0, len(x), 8), rng.integers(0, len(y), 8)
        j[:4] = np.clip(i[:4] + rng.integers(-2, 3, 4), 0, len(y) - 1)
        bounds = np.array([[0] * 8, [len(x)] * 8]), np.array([[0] * 8, [len(y)] * 8])
        first, end, same, same_end = windows.compared(x, y, i, j, *bounds)
        for n in range(8):
            starts = [s for s in range(1 - T, 1) if i[n] + s >= 0 and j[n] + s >= 0 and i[n] + s + T <= len(x) and j[n] + s + T <= len(y)]
            part = {s: (x[i[n] + s : i[n] + s + T], y[j[n] + s : j[n] + s + T]) for s in starts}
            like = [s for s, (u, v) in part.items() if (both := (Counter(u.tolist()) & Counter(v.tolist())).total()) >= 0.8 * (2 * T - both) - 1e-9]
            equal = [s for s, (u, v) in part.items() if (u == v).all()]
            # in place: what is found where any is; else all
            place = [s for s, (u, v) in part.items() if (u == v).sum() >= windows.COMMON]
            want = place or like
            assert (first[n], end[n]) == ((want[0], want[-1] + 1) if want else (0, 0)) and set(place) <= set(like)
            assert (same[n], same_end[n]) == ((equal[0], equal[-1] + 1) if equal else (0, 0))


EDITS = {
    "substituted": lambda w, p: [*w[:p], "new", *w[p + 1 :]],
    "inserted": lambda w, p: [*w[:p], "new", *w[p:]],
    "deleted": lambda w, p: [*w[:p], *w[p + 1 :]],
}


@pytest.mark.parametrize("kind", EDITS)
def test_recall_of_near_copies(spark, kind):
    """Passages of 50 to 100 words with one word changed, in unlike texts: by length, 0.9 or more share a class."""
    rng = np.random.default_rng(11)
    rows, lengths = [], {}
    for n in range(400):
        size = (50, 55, 60, 100)[n % 4]
        passage = some_words(rng, size)
        changed = EDITS[kind](passage, int(rng.integers(1, size - 1)))
        rows += [(2 * n, " ".join([*some_words(rng, 60), *passage, *some_words(rng, 60)])), (2 * n + 1, " ".join([*some_words(rng, 60), *changed, *some_words(rng, 60)]))]
        lengths[n] = size
    got = found_in(spark, rows)
    hit: Counter[int] = Counter()
    for n, size in lengths.items():
        hit[size] += bool({r.class_id for r in got.get(2 * n, [])} & {r.class_id for r in got.get(2 * n + 1, [])})
    assert all(hit[size] >= 90 for size in (50, 55, 60, 100)), hit
    assert all(len(v) == 1 for v in got.values())


def test_near_copies_meet_past_other_texts(spark):
    """Pairs that differ in one word, all around the same 44 words, which 60 further texts hold too: one key is full of unlike texts."""
    rng = np.random.default_rng(13)
    form = some_words(rng, 25)
    rows = [(10_000 + n, " ".join([*some_words(rng, 70), *form, *some_words(rng, 70)])) for n in range(60)]
    for n in range(100):
        passage = [*some_words(rng, 25), *form, *some_words(rng, 25)]
        changed = EDITS["substituted"](passage, int(rng.integers(1, 20)))
        rows += [(n, " ".join([*some_words(rng, 60), *passage, *some_words(rng, 60)])), (5000 + n, " ".join([*some_words(rng, 60), *changed, *some_words(rng, 60)]))]
    got = found_in(spark, rows)
    assert sum(bool({r.class_id for r in got.get(n, [])} & {r.class_id for r in got.get(5000 + n, [])}) for n in range(100)) >= 95
    assert not any(k >= 10_000 for k in got)


@pytest.mark.parametrize(("pairs", "unlike", "block"), [(150, 20, windows.BLOCK), (6, 150, 40)])
def test_no_unlike_text_parts_near_copies_that_share_a_key(spark, monkeypatch, pairs, unlike, block):
    """Pairs that differ in one word of 54, with unlike texts between in the order of ids that share the first 30; also with keys dealt out in blocks."""
    monkeypatch.setattr(windows, "BLOCK", block)
    rng = np.random.default_rng(21)
    keys = lambda text: {int(k) for own, _ in windows.joint_windows(*windows.tokens_of([text])) for k in own}
    rows, meet = [], []
    for n in range(0, 1000 * pairs, 1000):
        passage = some_words(rng, 54)
        changed = EDITS["substituted"](passage, int(rng.integers(31, 53)))
        rows += [(n, " ".join(passage)), (n + unlike + 1, " ".join(changed))]
        rows += [(n + 1 + i, " ".join([*passage[:30], *some_words(rng, 24)])) for i in range(unlike)]
        meet += [n] if keys(" ".join(passage)) & keys(" ".join(changed)) else []
    got = found_in(spark, rows, 1)
    assert len(meet) >= 0.9 * pairs and [n for n in meet if not {r.class_id for r in got.get(n, [])} & {r.class_id for r in got.get(n + unlike + 1, [])}] == []
    assert all(i % 1000 in (0, unlike + 1) for i in got)


def test_all_windows_of_a_key_are_connected_as_all_pairs_say():
    """Against all pairs: what is alike is connected, in groups of copies with some words changed and unlike texts around a common form."""
    rng = np.random.default_rng(3)
    for _ in range(10):
        base = windows.mixed(rng.integers(0, 10**6, 2 * T - 1).astype(np.uint64))
        made = []
        for n in range(40):
            own = base.copy()
            places = rng.permutation(2 * T - 1)[: (2, 5, 12, 40)[n % 4]]
            own[places] = windows.mixed(rng.integers(0, 40 if n % 2 else 10**6, len(places)).astype(np.uint64) + np.uint64(1 << 40))
            own[T - 1] = base[T - 1]
            made.append(own)
        x, begin = np.concatenate(made), np.arange(40) * (2 * T - 1)
        end, i = begin + 2 * T - 1, begin + T - 1

        def alike_pairs(p, q):
            first, stop, _, _ = windows.compared(x, x, i[p], i[q], np.stack([begin[p], end[p]]), np.stack([begin[q], end[q]]))
            return stop > first

        def classes(p, q):
            of = list(range(40))
            for u, v in zip(p.tolist(), q.tolist()):
                of = [of[u] if k == of[v] else k for k in of]
            return {frozenset(k for k in range(40) if of[k] == c) for c in of}

        p, q = np.triu_indices(40, 1)
        good = alike_pairs(p, q)
        found = windows.many_windows(x, begin, end, 0, alike_pairs)
        assert 0 < good.sum() < len(p) and classes(*np.concatenate(found, axis=1)) == classes(p[good], q[good])


def test_rows_of_one_id_are_each_searched(spark):
    rng = np.random.default_rng(14)
    passage, other = " ".join(some_words(rng, 60)), " ".join(some_words(rng, 55))
    alone = " ".join(some_words(rng, 80))
    got = found_in(spark, [(1, f"{alone} {passage}"), (1, other), (2, passage), (None, other), (3, None), (4, alone + " x"), (5, "short")])
    assert {k: len(v) for k, v in got.items()} == {1: 3, 2: 1, None: 1, 4: 1}
    assert all(r.documents == 2 or r.doc_id in (1, 2, 4) for v in got.values() for r in v)


def test_a_common_line_hides_no_passage(spark):
    """Passages of 55 words around a line that hundreds of other texts hold too, each passage in two texts far apart."""
    rng = np.random.default_rng(2)
    words = lambda n: some_words(rng, n)
    line = words(18)
    passages = [[*words(18), *line, *words(19)] for _ in range(150)]
    texts = [" ".join([*words(60), *p, *words(60)]) for p in [*passages, *passages]]
    texts[150:150] = [" ".join([*words(60), *line, *words(60)]) for _ in range(400)]
    order = rng.permutation(len(texts))
    docs = spark.createDataFrame([(int(i), t) for i, t in zip(order, texts)], "doc_id bigint, text string").repartition(3)
    of = {r.doc_id: r.class_id for r in windows.passages(docs).collect()}
    assert all(of[int(order[i])] == of[int(order[550 + i])] for i in range(150))
    assert len(of) == 300 and len(set(of.values())) == 150


def test_forms_between_two_copies_hide_neither(spark):
    """Texts with the same 50 words; texts of a form with 44 of them stand between in the chain of every key that both hold."""
    rng = np.random.default_rng(7)
    words = lambda n: some_words(rng, n)
    keys = lambda text: {int(k) for own, _ in windows.joint_windows(*windows.tokens_of([text])) for k in own}
    form = words(44)
    forms = [" ".join([*words(70), *form, *words(70)]) for _ in range(60)]
    common, rows = set.union(*map(keys, forms)), [(1000 + n, t) for n, t in enumerate(forms)]
    pairs = 0
    for _ in range(200):
        passage = [*words(3), *form, *words(3)]
        text, text2 = (" ".join([*words(60), *passage, *words(60)]) for _ in range(2))
        if pairs < 10 and keys(text) & keys(text2) <= common:
            rows += [(pairs, text), (2000 + pairs, text2)]
            pairs += 1
    assert pairs == 10
    got: dict[int, list] = {}
    for r in windows.passages(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for n in range(pairs):
        own = [[r.class_id for r in got.get(i, []) if r.first_word <= 60 and r.last_word >= 110] for i in (n, 2000 + n)]
        assert own[0] and own[0] == own[1], n


def test_every_copy_within_a_document_is_found(spark):
    """Passages that one text holds 3 to 50 times and another one once."""
    rng = np.random.default_rng(6)
    words = lambda n: some_words(rng, n)
    rows, want = [], {}
    for n, times in enumerate((3, 7, 50)):
        passage, text = words(60), words(70)
        for _ in range(times):
            want.setdefault(n, []).append(len(text))
            text += [*passage, *words(70)]
        rows += [(n, " ".join(text)), (100 + n, " ".join([*words(70), *passage, *words(70)]))]
    got: dict[int, list] = {}
    for r in windows.passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for n, places in want.items():
        own = sorted((r.first_word, r.last_word) for r in got[n])
        assert len(own) == len(places) and all(a <= p and p + 60 <= b for (a, b), p in zip(own, places))
        assert len({r.class_id for r in got[n] + got[100 + n]}) == 1 and len(got[100 + n]) == 1


def test_every_repeated_passage_is_found(spark, data):
    texts = texts_of(data)
    words = {i: decontam.words_of(t) for i, t in texts.items()}
    where: dict[tuple, set[int]] = {}
    for i, w in words.items():
        for k in range(len(w) - windows.WORDS + 1):
            where.setdefault(tuple(w[k : k + windows.WORDS]), set()).add(i)
    rows = queries.op4_substring_dedup(spark, data).collect()
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r.doc_id, []).append(r)
    for passage, docs in where.items():
        if len(docs) > 1:
            for i in docs:
                assert any(passage in set(zip(*(words[i][r.first_word + k : r.last_word] for k in range(windows.WORDS)))) for r in held.get(i, [])), i
    # and nothing is reported that shares no five words in a row with another document
    shingle = Counter(s for w in words.values() for s in set(zip(*(w[k:] for k in range(5)))))
    for r in rows:
        own = list(zip(*(words[r.doc_id][r.first_word + k : r.last_word] for k in range(5))))
        assert np.mean([shingle[s] > 1 for s in own]) > 0.5


def test_a_long_text_of_many_passages_costs_as_its_parts_do(spark):
    """One text that holds n passages against n short texts of one each: every passage is found, in a time near that of the short texts alone."""
    from time import perf_counter

    rng = np.random.default_rng(17)
    words = [f"w{i}" for i in range(30_000)]

    def seconds(n: int, long: bool) -> float:
        parts = [" ".join(words[i] for i in rng.integers(0, len(words), 60)) for _ in range(n)]
        rows = [(i + 1, p + f" tail{i}") for i, p in enumerate(parts)]
        rows += [(0, " ".join(p + " " + " ".join(f"gap{i}x{j}" for j in range(60)) for i, p in enumerate(parts)))] if long else [(n + i + 1, f"head{i} " + p) for i, p in enumerate(parts)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
        start = perf_counter()
        found = windows.passages(docs).collect()
        took = perf_counter() - start
        assert len({r.doc_id for r in found} - {0}) == (n if long else 2 * n)
        assert not long or len([r for r in found if r.doc_id == 0]) == n
        return took

    seconds(200, True)  # compiled, and workers started
    assert seconds(4000, True) < 3 * seconds(4000, False)


@pytest.mark.parametrize("block", [windows.BLOCK, 60])
def test_links_of_a_key_grow_as_its_windows_do(spark, monkeypatch, block):
    """Near copies of one text, with unlike texts between: a key has about as many links as windows, also dealt out in blocks, and all copies one class."""
    monkeypatch.setattr(windows, "BLOCK", block)
    rng = np.random.default_rng(23)
    base = some_words(rng, 60)
    rows = [(2 * n, " ".join(EDITS["substituted"](base, int(p)))) for n, p in enumerate(rng.integers(0, 60, 300))]
    rows = [(i, t.replace("new", f"new{i}")) for i, t in rows] + [(2 * n + 1, " ".join([*base[:30], *some_words(rng, 30)])) for n in range(100)]
    docs = spark.createDataFrame(rows, "doc bigint, text string").repartition(3).persist()
    made = windows.shared_checkpoint(windows.verified(windows.shared_checkpoint(windows.window_links(docs)), docs))
    held = windows.held_windows(made).groupBy("k").agg(F.count_distinct("content").alias("n"), F.max("apart").alias("apart")).where("apart and n > 1")
    links = windows.parted_links(made).selectExpr("sum(length(at)) div 8 as n").first().n
    assert 0 < links < 1.2 * held.selectExpr("sum(n) as n").first().n
    got = found_in(spark, rows)
    assert len({r.class_id for i in range(0, 600, 2) for r in got.get(i, [])}) == 1
