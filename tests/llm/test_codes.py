"""Vector codes against plain Lloyd rounds over all pairs, in whole numbers."""

from __future__ import annotations

from collections import defaultdict
from math import floor, isfinite

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import connection, same
from tallywell.llm import codes, queries


def plain(rows: list[tuple], parts: int, entries: int, rounds: int = 2) -> list[tuple]:
    """vec_id, code, error, label_error, digest by the definition; rows: vec_id, label, vector."""
    kept = [(i, lab, [floor(256 * x) for x in v]) for i, lab, v in rows if v and all(x is not None and isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    if not kept:
        return []
    d = len(kept[0][2])
    cut = [(i * d // parts, (i + 1) * d // parts) for i in range(parts)]
    books = [[r[2][a:b] for r in kept[:entries]] for a, b in cut]

    def nearest(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for i, (a, b) in enumerate(cut):
            own = defaultdict(list)
            for r in kept:
                own[nearest(r[2][a:b], books[i])[1]].append(r[2][a:b])
            for e, xs in own.items():
                books[i][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by_label = [], defaultdict(int)
    for i, lab, v in kept:
        best = [nearest(v[a:b], book) for (a, b), book in zip(cut, books)]
        error = sum(x for x, _ in best)
        by_label[lab] += error
        out.append((i, lab, "".join(f"{e:02x}" for _, e in best), error))
    digest = codes.digest_of([np.array(b, np.int64).reshape(len(b), -1) for b in books])
    return sorted(((i, c, e, by_label[lab], digest) for i, lab, c, e in out), key=str)


def rows_of(found, books):
    return sorted((tuple(r) for r in codes.digests(found, books).collect()), key=str)


def test_query_equals_its_sql(spark, data):
    assert same(queries.op12_vector_codes(spark, data), connection(data), queries.oracle_sql()["op12_vector_codes"]) == 500


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 300), st.integers(1, 20), st.integers(1, 5), st.sampled_from([1, 3, 50, 10_000]))
def test_tree_assigns_as_all_pairs_do(seed, n, k, width, spread):
    """Small spreads give many ties and repeated entries."""
    rng = np.random.default_rng(seed)
    p, e = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (k, width))
    want = ((p[:, None] - e[None]) ** 2).sum(axis=2).argmin(axis=1)
    tree = codes.Tree(p)
    assert (tree.assigned(e, n) == want).all()
    sums, counts = tree.totals(e)
    assert (counts == np.bincount(want, minlength=k)).all()
    assert all((sums[j] == p[want == j].sum(axis=0)).all() for j in range(k))


def test_whole_subtrees_are_assigned_at_once():
    """Of points in tight clusters, few are compared with any entry."""
    rng = np.random.default_rng(0)
    centres = rng.integers(-20_000, 20_000, (16, 4))
    p = (centres[:, None] + rng.integers(-5, 6, (16, 512, 4))).reshape(-1, 4)
    tree, compared = codes.Tree(p), []
    tree.split(centres, lambda *a: None, lambda leaves, own: compared.append(own.size))
    assert sum(compared) < len(p) / 10


def test_blocks_and_partitions_change_nothing(spark, data, monkeypatch):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    want = rows_of(*codes.coded(vectors))
    assert rows_of(*codes.coded(vectors.repartition(7))) == want
    assert want == plain([(r.vec_id, r.label, r.embedding) for r in vectors.collect()], 16, 64)


@pytest.mark.parametrize("parts,entries", [(2, 3), (3, 64)])
def test_odd_rows(spark, parts, entries):
    nan, inf = float("nan"), float("inf")
    given = [(0, 1, [1.0, -0.001, 2.5, 0.3]), (0, 1, [0.5, -0.001, 2.5, 0.3]), (1, None, [0.1, 0.2, 0.3, 0.4]), (2, None, None), (3, 1, []), (4, 1, [1.0, None, 1.0, 1.0]), (5, 1, [nan, 1.0, 1.0, 1.0]), (6, 2, [inf, 1.0, 1.0, 1.0]), (7, 2, [0.0] * 4), (None, 2, [9.0, 9.0, 9.0, -9.0]), (8, 3, [1.0, 2.0]), (9, 3, [0.0] * 4), (9, 3, [0.0] * 4)]
    docs = spark.createDataFrame([(*g, "x", 1) for g in given], "vec_id bigint, label int, embedding array<double>, code string, of int")
    found, books = codes.coded(docs, parts=parts, entries=entries)
    assert rows_of(found, books) == plain(given, parts, entries)
    few, one = codes.coded(docs.where("vec_id = 1"), parts=parts, entries=entries)
    assert [r.code for r in few.collect()] == ["00" * parts]
    nothing, none = codes.coded(docs.where("vec_id = 2"), parts=parts, entries=entries)
    assert nothing.collect() == [] and none == []
    assert codes.digests(*codes.coded(docs.where("false"))).collect() == []


def test_many_labels_are_joined_by_a_shuffle(spark, data, monkeypatch):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    want = rows_of(*codes.coded(vectors))
    monkeypatch.setattr(codes, "LABELS", 2)
    assert rows_of(*codes.coded(vectors)) == want
