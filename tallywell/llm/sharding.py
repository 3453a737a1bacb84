"""Sharding by a Feistel permutation of global row numbers.

Every row gets a number: its place in the order of id, size, checksum and a hash of its text. A Feistel network with a key from the seed
permutes the numbers, walking its cycles until it is back among them, and the place it gives says where the row goes: shard = place mod
shards, slot = place div shards. So a row's shard and slot follow from its number, and the row of any shard and slot from these
(`numbers_at`), with no table of the shuffle; the shards' row counts are at most one apart (the law is "rows").

The order doesn't depend on files, partitions or machines, so neither does the result. Rows are sorted by ranges, where rows that
are equal in everything are told apart by where they were read, so that also a group of equal rows of any size is split. The sorted rows are
written to the shared folder; a row's number is its place in its file plus the rows of the files before, of which there is one for each partition
of the sort. Equal texts are no group that stays together: a group may hold a third of all rows, and the law wants equal counts.

Defined results: a null text has size 1 and checksum 0, like an empty one; null ids come first; rows that are equal in all of the above
get neighbouring numbers, whichever is which; an empty table gives an empty table; other columns are only carried by `shuffled`.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import written

SHARDS, SEED, ROUNDS = 8, 2024, 6
# Odd multipliers that mix bits well.
STEP, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
WORD = (1 << 64) - 1


def round_keys(seed: int) -> list[int]:
    """A key of 64 bits for each round, spread from the seed."""
    keys, state = [], seed & WORD
    for _ in range(ROUNDS):
        state = (state + STEP) & WORD
        z = ((state ^ (state >> 30)) * MIX_1) & WORD
        z = ((z ^ (z >> 27)) * MIX_2) & WORD
        keys.append(z ^ (z >> 31))
    return keys


def sides(n: int) -> tuple[int, int]:
    """The two radices of the network: their product is the least rectangle about a square that holds n numbers, so few walks are longer than one step."""
    a = max(1, isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def mixed(half: np.ndarray, key: int) -> np.ndarray:
    """32 bits of a half and a round's key."""
    z = (half + np.uint64(key)) * np.uint64(MIX_1)
    return ((z ^ (z >> np.uint64(32))) * np.uint64(MIX_2)) >> np.uint64(32)


def network(x: np.ndarray, a: int, b: int, keys: list[int], backwards: bool = False) -> np.ndarray:
    """One pass of the network over numbers below a * b; backwards it undoes itself."""
    left, right = x // np.uint64(b), x % np.uint64(b)
    for i in reversed(range(len(keys))) if backwards else range(len(keys)):
        if i % 2:
            f = mixed(left, keys[i]) % np.uint64(b)
            right = (right + (np.uint64(b) - f if backwards else f)) % np.uint64(b)
        else:
            f = mixed(right, keys[i]) % np.uint64(a)
            left = (left + (np.uint64(a) - f if backwards else f)) % np.uint64(a)
    return left * np.uint64(b) + right


def permuted(numbers: np.ndarray, n: int, seed: int = SEED, backwards: bool = False) -> np.ndarray:
    """Where the permutation of 0 to n - 1 takes each number: cycles are walked until they are below n again."""
    (a, b), keys = sides(n), round_keys(seed)
    x = network(numbers.astype(np.uint64), a, b, keys, backwards)
    while len(beyond := np.flatnonzero(x >= n)):
        x[beyond] = network(x[beyond], a, b, keys, backwards)
    return x.astype(np.int64)


def place_of(number: Column, n: int, seed: int = SEED) -> Column:
    @F.pandas_udf("bigint")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(), n, seed))

    return of(number)


def numbers_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The numbers of the rows at these shards and slots of a table of n rows."""
    return permuted(np.asarray(slot) * shards + np.asarray(shard), n, seed, backwards=True)


def free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def numbered(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """The rows with their place in the order, from 0, as a column of this name; and how many there are."""
    names = rows.columns
    keys = [free(f"key{i}", names) for i in range(len(order) + 1)]
    keyed = rows.select("*", *(c.alias(k) for c, k in zip([*order, F.monotonically_increasing_id()], keys)))
    in_order = written(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys), "in-order")
    file, index = free("file", names), free("index", names)
    placed = in_order.select(*names, F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(index))
    counts = placed.groupBy(file).agg(F.count("*").alias("n")).collect()  # one row for each partition of the sort
    starts, n = [], 0
    for row in sorted(counts, key=lambda r: [int(x) for x in (r[0].split("-")[1], r[0].split("-c")[-1].split(".")[0])]):
        starts.append((row[0], n))
        n += row[1]
    start = free("start", [*names, file, index])
    first = rows.sparkSession.createDataFrame(starts, f"{file} string, {start} bigint")
    return placed.join(F.broadcast(first), file).select(*names, (F.col(start) + F.col(index)).alias(name)), n


def content(docs: DataFrame, key: str, text: str) -> list[Column]:
    """Id, size, checksum and hash of the text: what the order goes by."""
    as_bytes = F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")
    return [docs[key].cast("long"), (F.octet_length(as_bytes) + 1).cast("long"), F.crc32(as_bytes), F.xxhash64(as_bytes)]


def dealt(rows: DataFrame, n: int, number: str, shards: int, seed: int, shard: str, slot: str) -> DataFrame:
    place = free("place", rows.columns)
    with_place = rows.withColumn(place, place_of(F.col(number), n, seed))
    return with_place.withColumns({shard: (F.col(place) % shards).cast("int"), slot: F.floor(F.col(place) / shards).cast("long")}).drop(place)


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, number, shard and slot of each row. Only these columns are shuffled."""
    names = ["doc_id", "size", "text_crc32", "text_hash"]
    own = docs.select(*(c.alias(n) for c, n in zip(content(docs, key, text), names)))
    rows, n = numbered(own, [F.col(c) for c in names], "number")
    return dealt(rows, n, "number", shards, seed, "shard", "slot").drop("text_hash")


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str, str]:
    """All columns of the rows with their shard and slot, and the names of these two columns (with _ behind, where a name is taken)."""
    number = free("number", docs.columns)
    rows, n = numbered(docs, content(docs, key, text), number)
    shard, slot = free("shard", rows.columns), free("slot", rows.columns)
    return dealt(rows, n, number, shards, seed, shard, slot).drop(number), shard, slot


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED, files: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """The documents as Parquet in folders by shard, in order of their slots; each shard in so many files, each with a stretch of slots."""
    rows, shard, slot = shuffled(docs, shards, seed, key, text)
    stretch = free("stretch", rows.columns)
    longest = -(-max(1, docs.count()) // (shards * files))
    cut = rows.withColumn(stretch, F.floor(F.col(slot) / longest).cast("int"))
    cut.repartition(shards * files, shard, stretch).sortWithinPartitions(shard, slot).drop(stretch).write.partitionBy(shard).parquet(folder)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
