"""Near-duplicates by SimHash and Golay-code fuzzy hashing.

Two fingerprints of 64 bits that differ in at most three bits are found by pigeonhole over four segments of 16 bits: three
errors leave one segment i without any and another segment j with at most one. For each ordered pair (i, j) the key is
segment i as it is and a codeword of the perfect binary Golay code [23, 12, 7] near segment j (padded with zeros). A
fingerprint has its home key at the nearest codeword and probe keys at all codewords within distance 4 (one, or six where
the nearest is 3 away). If segments x and y differ in one bit, y's nearest codeword is within 3 of y, so within 4 of x:
the home key of one is a probe key of the other. Joined pairs are verified by their exact distance, so the links are exact.

Equal fingerprints are one node, so copies are never paired. A key that many fingerprints have as their home is dense: its homes
and its probes are dealt into blocks, and each pair of blocks gives only a forest of its links, which connects what all links
connect. So a large group of near copies gives links in proportion to its blocks, not all its pairs. Defined results: a null or empty text has fingerprint zero and
is linked like any other; of repeated ids each row keeps its own fingerprint; null ids get a fingerprint but never name a
component unless it has no other id (then null); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import mapped, shared_checkpoint, written
from tallywell.llm.graph import connected_components

SHINGLE, SEED = 3, 42
MOST_BITS = 3
SEGMENTS, SEGMENT_BITS = 4, 16
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the Golay code of length 23.
GENERATOR = 0b110001110101
PAIRS = [(i, j) for i in range(SEGMENTS) for j in range(SEGMENTS) if i != j]


def fingerprint(text: str, hashed: Callable[[bytes, int], int] = xxhash.xxh64_intdigest) -> int:
    """Unsigned. Words are split at ASCII white space; only A-Z are lower-cased."""
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(s) for s in zip(*(words[k:] for k in range(SHINGLE)))] or [b" ".join(words)]
    h = np.fromiter((hashed(s, SEED) for s in shingles), "<u8", len(shingles))
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `fp`, the fingerprint as a signed long. One narrow pass."""
    return mapped(docs, lambda: lambda t: ((f := fingerprint(t)) - (f >> 63 << 64),), "fp bigint", key, text)


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word modulo the generator."""
    w = words.astype(np.int64)
    for bit in range(22, 10, -1):
        w = np.where(w >> bit & 1, w ^ (GENERATOR << (bit - 11)), w)
    return w


@lru_cache(1)
def codewords() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit segment the nearest codeword's index, and all indices within distance 4, padded with -1."""
    bits = 1 << np.arange(23)
    patterns = [np.zeros(1, np.int64)]
    for weight in range(1, 5):
        last = patterns[-1]
        grown = (last[:, None] | bits[None, :]).ravel()
        patterns.append(np.unique(grown[np.bitwise_count(grown) == weight]))
    errors: list[list[int]] = [[] for _ in range(2048)]
    for p in patterns:  # by weight, so the first error of a syndrome is the lightest
        for e, s in zip(p.tolist(), syndrome(p).tolist()):
            errors[s].append(e)
    most = max(map(len, errors))
    table = np.array([e + [-1] * (most - len(e)) for e in errors])
    segment = np.arange(1 << SEGMENT_BITS)
    near = table[syndrome(segment)]
    words = np.where(near >= 0, segment[:, None] ^ near, -1)
    index = np.where(words >= 0, words >> 11, -1)  # the code is systematic in its upper 12 bits
    return index[:, 0].astype(np.int64), index.astype(np.int64)


def keys_of(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Keys, the fingerprints they belong to, and whether they are home keys."""
    home, probes = codewords()
    segments = [(fps.view(np.uint64) >> np.uint64(SEGMENT_BITS * k) & np.uint64(0xFFFF)).astype(np.int64) for k in range(SEGMENTS)]
    for t, (i, j) in enumerate(PAIRS):
        exact = (t << SEGMENT_BITS | segments[i]) << 12
        yield exact | home[segments[j]], fps, True
        near = probes[segments[j]]
        row, col = np.nonzero(near >= 0)
        yield exact[row] | near[row, col], fps[row], False


def keyed(nodes: DataFrame, home: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy()
            for at in range(0, len(fps), 4096):
                for k, f, is_home in keys_of(fps[at : at + 4096]):
                    if is_home == home:
                        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f)], names=["k", "fp"])

    return nodes.select("fp").mapInArrow(run, "k bigint, fp bigint")


#: A key with more homes than this is dense; rows of a block of a dense key.
DENSE, BLOCK = 256, 4096


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a and b (both distinct) within MOST_BITS bits that connect all that such pairs connect; fewer than len(a) + len(b)."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    label = np.empty(len(both), np.int64)  # equal fingerprints have a label from the start
    label[order] = np.cumsum(np.concatenate([[True], np.diff(both[order]) != 0])) - 1
    left, right = [], []
    for at in range(0, len(a), 256):
        near = np.bitwise_count((a[at : at + 256, None] ^ b[None, :]).view(np.uint64)) <= MOST_BITS
        for i in np.flatnonzero(near.any(1)):
            own = label[at + i]
            cols = np.flatnonzero(near[i])
            cols = cols[label[len(a) + cols] != own]
            if len(cols):
                others, first = np.unique(label[len(a) + cols], return_index=True)
                left.append(np.full(len(first), a[at + i]))
                right.append(b[cols[first]])
                label[np.isin(label, others)] = own
    return (np.concatenate(left), np.concatenate(right)) if left else (a[:0], a[:0])


def dense_links(home: DataFrame, probe: DataFrame, homes: DataFrame) -> DataFrame:
    """a and b: forests of the links of each pair of blocks. homes: k and n, the dense keys' number of homes."""
    probes = probe.join(homes.select("k"), "k", "left_semi").groupBy("k").agg(F.count("*").alias("m"))
    blocks = homes.join(probes, "k").select("k", F.ceil(F.col("n") / BLOCK).alias("hs"), F.ceil(F.col("m") / BLOCK).alias("ps"))
    blocks = shared_checkpoint(blocks)

    def dealt(rows: DataFrame, own: str, other: str, name: str, other_name: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(other_name)
        return rows.join(blocks, "k").select("k", F.pmod(F.xxhash64("fp"), F.col(own)).alias(name), "fp", every)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = (np.array(t.column("fp"), np.int64) for t in (left, right))
        return pa.table(dict(zip(("a", "b"), forest(x, y))))

    by = ["k", "i", "j"]
    return dealt(home, "hs", "ps", "i", "j").groupBy(*by).cogroup(dealt(probe, "ps", "hs", "j", "i").groupBy(*by)).applyInArrow(run, "a bigint, b bigint")


def links(nodes: DataFrame) -> DataFrame:
    """Pairs of the distinct fingerprints `fp` that differ in at most MOST_BITS bits, a < b, each once: all but for dense keys, and what connects all."""
    # The few bytes of each node become many rows, so they are dealt out first.
    nodes = nodes.select("fp").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    home, probe = keyed(nodes, True), keyed(nodes, False)
    homes = shared_checkpoint(home.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > DENSE))
    dense = not homes.isEmpty()
    few = home.join(homes, "k", "left_anti") if dense else home
    left, right = few.withColumnRenamed("fp", "a"), probe.withColumnRenamed("fp", "b")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # Both fingerprints have probes at each other's home, so one order of the pair is enough.
    pairs = left.join(right.hint("merge"), (left["k"] == right["k"]) & (F.col("a") < F.col("b")) & (differ <= MOST_BITS)).select("a", "b")
    if dense:
        more = dense_links(home, probe, homes)
        pairs = pairs.union(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return pairs.distinct()


def components(prints: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of a table with doc_id and fp."""
    prints = shared_checkpoint(prints)
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(links(nodes)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = shared_checkpoint(rooted.join(named, "root").select("fp", "component_id"))
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id: the smallest id that is reachable over links."""
    return components(fingerprints(docs, key, text))


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The first row of each group of near duplicates, all columns; every row belongs to one group, also those without an id.

    The rows are numbered in a table in the shared folder, so that each has the same number whenever it is read.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    first = near_duplicates(numbered, row, text).where("doc_id = component_id").select(F.col("doc_id").alias(row))
    return numbered.join(first, row, "left_semi").select(*docs.columns)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
