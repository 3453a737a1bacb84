from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest

from oracle import connection, same
from tallywell.llm import queries, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 17, 100, 1009, 4096, 10_001])
def test_permutation_hits_every_place_once_and_goes_back(n):
    x = np.arange(n)
    y = sharding.permuted(x, n, 7)
    assert sorted(y) == list(range(n)) and (sharding.permuted(y, n, 7, backwards=True) == x).all()
    a, b = sharding.sides(n)
    assert a * b >= n and a * b - n < a


def test_permutation_of_huge_tables_goes_back():
    n = 10**14 + 37
    x = np.random.default_rng(1).integers(0, n, 10_000)
    y = sharding.permuted(x, n, 3)
    assert (y < n).all() and (y >= 0).all() and (sharding.permuted(y, n, 3, backwards=True) == x).all()


def test_permutation_mixes_and_depends_on_the_seed():
    n = 80_000
    a, b = sharding.permuted(np.arange(n), n, 1), sharding.permuted(np.arange(n), n, 2)
    assert (a == b).mean() < 0.001 and (a == np.arange(n)).mean() < 0.001
    # a run of neighbours falls evenly into the shards, and in no order
    assert all(abs((a[:8000] % 8 == s).sum() - 1000) < 150 for s in range(8))
    assert abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.02


def plain(rows: list[tuple], shards: int, seed: int) -> list[tuple]:
    """The rows sorted in one place, each number walked by itself with whole numbers of any size."""
    full = sorted(((i is not None, i or 0), len(b) + 1, crc32(b), i) for i, t in rows for b in [(t or "").encode()])
    n, keys = len(full), sharding.round_keys(seed)
    a = next(a for a in range(1, n + 2) if a * a >= n)
    b = -(-n // a)

    def f(v, k):
        z = (v + k) * sharding.MIX_1 % 2**64
        return ((z ^ (z >> 32)) * sharding.MIX_2 % 2**64) >> 32

    out = []
    for number, (_, size, crc, i) in enumerate(full):
        x = number
        while True:
            left, right = divmod(x, b)
            for r, k in enumerate(keys):
                if r % 2:
                    right = (right + f(left, k)) % b
                else:
                    left = (left + f(right, k)) % a
            x = left * b + right
            if x < n:
                break
        out.append((i, size, crc, x % shards, x // shards))
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in found.collect()), key=str)


def test_shards_equal_the_plain_version_however_the_rows_lie(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], 8, sharding.SEED)
    assert rows_of(sharding.sharded(docs)) == want
    assert rows_of(sharding.sharded(docs.repartition(13, "source").orderBy("text"))) == want
    slots = sorted((s, t) for *_, s, t in want)
    sizes = [sum(s == k for s, _ in slots) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1 and slots == [(k, i) for k in range(8) for i in range(sizes[k])]


def test_query_equals_its_sql(spark, data):
    assert same(queries.op11_feistel_shards(spark, data), connection(data), queries.oracle_sql()["op11_feistel_shards"]) == 200


def test_rows_of_shard_and_slot_are_computable(spark, data):
    found = sharding.sharded(spark.read.parquet(f"{data}/documents.parquet"), 3, 5).toPandas()
    assert (sharding.numbers_at(found["shard"].to_numpy(), found["slot"].to_numpy(), len(found), 3, 5) == found["number"].to_numpy()).all()


def test_odd_rows(spark):
    given = [(None, "x"), (None, None), (1, None), (1, ""), (1, ""), (2, "é" * 5), (2, "b"), *[(3, "same")] * 50]
    docs = spark.createDataFrame([(i, t, 1, 2, "f") for i, t in given], "doc_id bigint, text string, shard int, number int, file string")
    found = rows_of(sharding.sharded(docs, 4))
    assert [r[:3] for r in found] == sorted([(i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in given], key=str)
    assert found == plain(given, 4, sharding.SEED)
    wide, shard, slot = sharding.shuffled(docs, 4)
    assert wide.columns == [*docs.columns, "shard_", "slot"] and (shard, slot) == ("shard_", "slot")
    assert wide.select(shard, slot).distinct().count() == len(given)
    assert sharding.digests(sharding.sharded(docs.where("false"))).collect() == []


def test_written_shards_hold_their_slots_in_order(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), 4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    places = back.selectExpr("_metadata.file_path AS f", "_metadata.row_index AS i", "slot", "shard").orderBy("f", "i").collect()
    for a, b in zip(places, places[1:]):
        assert a.f != b.f or a.slot + 1 == b.slot
    assert len({p.f for p in places}) >= 4
