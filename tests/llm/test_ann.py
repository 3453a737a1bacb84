"""Nearest neighbours against all pairs, also at the ends of the range of doubles."""

from __future__ import annotations

import numpy as np
import pytest

from oracle import connection, same
from tallywell.llm import ann, queries


def plain(rows, queries, k):
    """Ranks by the same sums of doubles, added in order; what is no number comes last."""
    rows = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    with np.errstate(all="ignore"):
        for q, x in rows:
            if q in queries:
                scores = [(float(ann.exact(x[None], v[None])[0]), i) for i, v in rows if i != q and len(v) == len(x)]
                best = sorted(scores, key=lambda s: (s[0] != s[0], -s[0] if s[0] == s[0] else 0, s[1]))[:k]
                out += [(q, n, i, repr(s)) for n, (s, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def found(spark, rows, queries, k):
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    return sorted(((r.query_id, r.rank, r.vec_id, repr(r.score)) for r in ann.nearest(v, v.where(v.vec_id.isin(*queries)), k).collect()), key=str)


def test_query_is_its_sql(spark, data):
    assert same(queries.op3_ann(spark, data), connection(data), queries.OP3_SQL)


def test_ties_repeated_ids_and_odd_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, float(-(i % 10))]) for i in range(100)] + [(5, [9.0, 9.0, 9.0]), (20, [1.0, 2.0, 3.0]), (20, [1.0, 2.0, 3.0])]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (203, []), (204, [1.0, None, 1.0]), (205, [1.0, float("inf"), 0.0]), (206, [1.0, 2.0])]
    assert found(spark, rows, {20, 40, 206}, 12) == plain(rows, {20, 40, 206}, 12)


@pytest.mark.parametrize("size", [1e160, 1e300, 1e-170, 1e-310, None])
def test_components_of_any_size(spark, size):
    rng = np.random.default_rng(8)
    scale = (lambda: size) if size else (lambda: float(10.0 ** rng.integers(-300, 300)))
    rows = [(i, [float(x) for x in rng.normal(size=6) * scale()]) for i in range(60)]
    assert found(spark, rows, {0, 20, 40}, 5) == plain(rows, {0, 20, 40}, 5)


def test_many_tiles(spark, monkeypatch):
    for name, n in (("QUERY_BLOCK", 16), ("CANDIDATE_BLOCK", 64), ("QUERY_STEP", 8), ("CANDIDATE_STEP", 32)):
        monkeypatch.setattr(ann, name, n)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=24), 1)]) for i in range(500)]
    asked = set(range(0, 500, 10))
    got, want = found(spark, rows, asked, 20), plain(rows, asked, 20)
    assert got == want


def test_tiles_keep_what_their_bounds_allow():
    rng = np.random.default_rng(10)
    for _ in range(20):
        c, q = rng.normal(size=(300, 8)) * 10.0 ** rng.integers(-3, 3, (300, 1)), rng.normal(size=(9, 8))
        parts = list(ann.tile(np.arange(9), np.full(9, -1), q, np.arange(300), c, 7))
        number, _, ids, scores = (np.concatenate(x) for x in zip(*parts))
        for n in range(9):
            exact = ann.exact(np.repeat(q[n : n + 1], 300, 0), c)
            assert ids[number == n].tolist() == np.lexsort((np.arange(300), -exact))[:7].tolist()


def test_empty_and_other_columns(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)], i, "x") for i in range(4)], "vec_id bigint, embedding array<double>, number bigint, v string")
    assert [(r.vec_id, r.score) for r in ann.nearest(v, v.where("vec_id = 0"), 2).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]
    assert ann.nearest(v.where("false"), v.where("false"), 2).collect() == [] == ann.nearest(v, v.where("false"), 2).collect()
