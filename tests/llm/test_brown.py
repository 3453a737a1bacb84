"""Brown class scoring: counts, exchange, probabilities and scores against plain versions."""

from __future__ import annotations

from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from tallywell.llm import brown, queries
from tallywell.llm.common import keyed_text, remainder


def texts_of(data: str) -> dict[int, str]:
    t = ds.dataset(f"{data}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


@pytest.fixture(scope="module")
def modelled(spark, data):
    return brown.modelled(keyed_text(spark.read.parquet(f"{data}/documents.parquet")), remainder(F.col("doc_id")) != 1)


def class_table(model) -> dict[bytes, tuple[int, int]]:
    """Count and class of every training word."""
    out = {w: (n, model.classes.known[w]) for w, n in zip(model.known, model.counts)}
    return out | {bytes(r.word): (r.n, r.g) for r in model.placed.collect()}


def test_base_columns_by_recount(spark, data):
    texts = texts_of(data)
    rows = {r.doc_id: r for r in queries.op9_brown(spark, data).collect()}
    tokens = {i: [*brown.words_of(t), brown.END] for i, t in texts.items()}
    learn = [i for i in texts if crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in learn for w in tokens[i])
    n, v = sum(c.values()), len(c)
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        assert (r.n_tokens, r.train_tokens, r.held_out) == (len(tokens[i]), n, crc32(str(i).encode()) % 5 == 1)
        assert r.n_known == sum(c[w] > 0 for w in tokens[i])
        assert r.base_score == pytest.approx(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i]), rel=1e-9)


@pytest.mark.parametrize("known", [brown.KNOWN, 400])
def test_scores_by_recomputation(spark, data, known, monkeypatch):
    """Transitions and emissions counted anew from the classes; also with few known words, so that most go the way of the rest."""
    monkeypatch.setattr(brown, "KNOWN", known)
    monkeypatch.setattr(brown, "CORE", min(known, 300))
    monkeypatch.setattr(brown, "CHUNK", 30_000)
    texts = texts_of(data)
    model, rows = brown.modelled(keyed_text(spark.read.parquet(f"{data}/documents.parquet")), remainder(F.col("doc_id")) != 1)
    words, c = class_table(model), model.classes.c
    tokens = {i: [*brown.words_of(t), brown.END] for i, t in texts.items()}
    learn = [i for i in texts if crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for i in learn for w in tokens[i])
    assert {w: n for w, (n, _) in words.items()} == counts and words[brown.END][1] == c
    of = lambda w: words[w][1] if w in words else model.classes.ending(w)
    pairs, total, own, size = Counter(), Counter(), Counter(), Counter()
    for i in learn:
        g = [c, *map(of, tokens[i])]
        pairs.update(zip(g, g[1:]))
        total.update(g[:-1])
    for w, (n, g) in words.items():
        own[g] += n
        size[g] += 1
    assert (10**model.transition).sum(1) == pytest.approx(1)
    for g in size:  # all words of a class and one that is new
        assert sum((n + 0.5) / (own[g] + 0.5 * (size[g] + 1)) for n, h in words.values() if h == g) + 0.5 / (own[g] + 0.5 * (size[g] + 1)) == pytest.approx(1)
    for r in brown.scored(rows, model).collect():
        g = [c, *map(of, tokens[r.doc_id])]
        want = sum(log10((pairs[a, b] + 0.5) / (total[a] + 0.5 * (c + 1))) for a, b in zip(g, g[1:]))
        want += sum(log10((counts[w] + 0.5) / (own[h] + 0.5 * (size[h] + 1))) for w, h in zip(tokens[r.doc_id], g[1:]))
        assert r.score == pytest.approx(want, rel=1e-9)


def test_nearly_all_tokens_are_placed_by_exchange(modelled):
    assert modelled[0].exchanged >= 0.95


def test_gains_are_those_of_the_likelihood():
    rng = np.random.default_rng(2)
    for _ in range(20):
        c = 5
        table = rng.integers(20, 90, (c + 1, c + 1)).astype(float)
        counts = rng.integers(0, 4, (8, 2 * (c + 1))).astype(float) * (rng.random((8, 2 * (c + 1))) < 0.5)
        own = np.array([-1] * 5 + [0, 2, 4])
        got = brown.gains(counts, table, own)

        def likelihood(w: int, h: int, sign: int) -> float:
            """With a word added to class h (or taken away); what stands beside it precedes and follows some word anyhow."""
            t, to, fro = table.copy(), table.sum(1), table.sum(0)
            t[:, h] += sign * counts[w, : c + 1]
            t[h] += sign * counts[w, c + 1 :]
            to[h] += sign * counts[w, c + 1 :].sum()
            fro[h] += sign * counts[w, : c + 1].sum()
            return float(brown.phi(t).sum() - brown.phi(to).sum() - brown.phi(fro).sum())

        for w in range(8):
            for h in range(c) if own[w] < 0 else [own[w]]:
                change = likelihood(w, h, 1) - likelihood(w, h, 0) if own[w] < 0 else likelihood(w, h, 0) - likelihood(w, h, -1)
                assert got[w, h] == pytest.approx(change, abs=1e-6)


def test_contexts_and_classes_of_the_rest(spark, monkeypatch):
    """Rare words between the same frequent ones get their class, as do words of any count."""
    monkeypatch.setattr(brown, "KNOWN", 12)
    monkeypatch.setattr(brown, "CORE", 12)
    monkeypatch.setattr(brown, "CLASSES", 3)
    rng = np.random.default_rng(3)
    pick = lambda k: f"{k}{rng.integers(0, 3)}"
    texts = [" ".join(x for _ in range(10) for x in (pick("a"), pick("b"), pick("c"))) for _ in range(200)]
    texts += [f"a0 {'zq' if i % 2 else 'wq'}{i // 2} c1" for i in range(60)] + [f"b1 {'kx'}{i} a2" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    model, _ = brown.modelled(docs, F.lit(True))
    words = class_table(model)
    assert model.exchanged == 1.0
    of = lambda w: words[w.encode()][1]
    assert len({of(f"zq{i}") for i in range(30)} | {of("b0"), of("b1"), of("b2")}) == 1
    assert len({of(f"kx{i}") for i in range(60)} | {of("c0"), of("c1"), of("c2")}) == 1
    assert of("b0") != of("c0") != of("a0")


def test_packed_counts_come_back():
    rng = np.random.default_rng(4)
    row, code = np.divmod(rng.choice(20 * 128, 500, replace=False), 128)
    n = (2 ** (rng.random(500) * 27)).astype(np.int64)
    out, record = brown.packed(row, code, n)
    record = record.astype(np.int64)
    back: Counter = Counter()
    for r, x in zip(out.tolist(), record.tolist()):
        back[r, x & 127] += (x >> 9) << 7 * (x >> 7 & 3)
    assert back == Counter(dict(zip(zip(row.tolist(), code.tolist()), n.tolist()))) and (np.diff(out) >= 0).all()


def test_the_most_frequent_words_are_exact(spark):
    rows = [(f"w{i}".encode(), n) for i, n in enumerate([5] * 40 + [9, 8, 7, 7] + [1] * 30)]
    counts = spark.createDataFrame(rows, "word binary, n bigint")
    for most in (1, 3, 4, 20, 44, 60, 100):
        got = [(bytes(r.word), r.n) for r in brown.most_frequent(counts, most)]
        assert len(got) == min(most, 74) and sorted((n for _, n in got), reverse=True) == sorted((n for _, n in rows), reverse=True)[:most] and len(set(got)) == len(got)
    assert brown.most_frequent(counts.where("false"), 5) == []


def test_held_out_texts_are_likelier_than_by_the_base(spark, data):
    held = [r for r in queries.op9_brown(spark, data.replace("sf0.001", "sf0.01")).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_separates_what_alternates():
    n = np.zeros((9, 9))
    for a in range(1, 5):
        for b in range(5, 9):
            n[a, b] = n[b, a] = 50
    of = brown.exchange(n, 2)
    assert len(set(of[1:5])) == 1 and len(set(of[5:9])) == 1 and of[1] != of[5]


def likelihood(pairs: np.ndarray, of: np.ndarray, c: int) -> float:
    """Of the class bigrams, without what all classings share."""
    hot = np.eye(c + 1)[of]
    table = hot.T @ pairs @ hot
    return float(brown.phi(table).sum() - brown.phi(table.sum(1)).sum() - brown.phi(table.sum(0)).sum())


def test_exchange_never_loses_likelihood():
    rng = np.random.default_rng(8)
    n = rng.poisson(rng.gamma(0.3, 4.0, (40, 40)))
    by_round = [likelihood(n, brown.exchange(n, 5, rounds), 5) for rounds in range(6)]
    assert all(a <= b + 1e-6 for a, b in zip(by_round, by_round[1:])) and by_round[-1] > by_round[0]


def test_parallel_rounds_gain_likelihood(spark, data, monkeypatch):
    """Words are moved against a table that stands still for a round; still the second round's classes are the likelier ones."""
    monkeypatch.setattr(brown, "CORE", 200)
    seen, plain = [], brown.classes_of
    monkeypatch.setattr(brown, "classes_of", lambda known, counts, of, c: (seen.append((known, of.copy(), c)), plain(known, counts, of, c))[1])
    model, _ = brown.modelled(keyed_text(spark.read.parquet(f"{data}/documents.parquet")), remainder(F.col("doc_id")) != 1)
    (known, _, c), (_, first, _) = seen
    last = np.array([model.classes.known[w] for w in known])
    place = {w: i for i, w in enumerate(known)}
    pairs = Counter()
    for i, t in texts_of(data).items():
        if crc32(str(i).encode()) % 5 != 1:
            ids = [0, *(place[w] for w in brown.words_of(t)), 0]
            pairs.update(zip(ids, ids[1:]))
    assert (first >= 0).all() and (last >= 0).all() and len(known) > 2000
    a, b = (np.array(x) for x in zip(*pairs))
    n = np.array(list(pairs.values()), float)

    def total(of: np.ndarray) -> float:
        table = np.zeros((c + 1, c + 1))
        np.add.at(table, (of[a], of[b]), n)
        return float(brown.phi(table).sum() - brown.phi(table.sum(1)).sum() - brown.phi(table.sum(0)).sum())

    spread = np.append(c, np.arange(len(known) - 1) % c)
    assert total(spread) < total(first) <= total(last)


def test_odd_texts(spark):
    """Nulls, empty texts, repeated and unknown rows: one end each, what is new has no count; an empty table gives none."""
    docs = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (3, "a b a"), (3, "a b a"), (4, " \t")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in brown.perplexity(docs).collect()), key=str)
    learn = [i for i in (1, 2, 3, 3, 4) if crc32(str(i).encode()) % 5 != 1]
    n = sum({1: 1, 2: 1, 3: 4, 4: 1}[i] for i in learn)
    known = 3 if 3 in learn else 1
    rows = [(None, None, 3, known, n)] + [(i, i not in learn, k, k if known == 3 or k == 1 else 1, n) for i, k in ((1, 1), (2, 1), (3, 4), (3, 4), (4, 1))]
    assert got == sorted(rows, key=str)
    assert brown.perplexity(docs.where("false")).collect() == []
    alone = brown.perplexity(docs.where("doc_id is null")).collect()
    assert [(r.train_tokens, r.n_known, r.n_tokens) for r in alone] == [(0, 0, 3)]


def test_the_class_table_of_the_core_comes_from_its_bigrams():
    """Against counting each bigram by the classes of its words."""
    rng = np.random.default_rng(4)
    pairs, of = rng.integers(0, 9, (30, 30)), np.append(5, rng.integers(0, 5, 29))
    want = np.zeros((6, 6))
    for v in range(30):
        for w in range(30):
            want[of[v], of[w]] += pairs[v, w]
    assert (brown.class_table(pairs, of, 5) == want).all()
