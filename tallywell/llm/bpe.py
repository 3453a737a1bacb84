"""Byte-level BPE encoding and decoding.

Each pre-token is merged with a rank queue: a hierarchical bitmap says which merge ranks have a bucket,
find-first-set picks the lowest rank, and its bucket gives the leftmost position in a linked list of symbols. An entry whose position has
meanwhile merged or changed its pair is stale and skipped. The cost is near linear in the length of the pre-token, so a
word of a hundred thousand bytes is no special case.

Defined results: a null text counts as empty; an empty text has no ids and decodes to empty bytes; repeated ids (rows) are
encoded each for itself; an empty table gives an empty table; columns besides the id and the text are not read.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import keyed_text, text_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of a worker's cache of short pre-tokens; it is emptied when full, so a worker's memory stays bounded.
CACHE_ENTRIES, CACHE_PIECE = 800_000, 48


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions by merge rank; a bitmap in two levels of wide words says which ranks have a bucket."""

    def __init__(self, ranks: int) -> None:
        self.leaf = [0] * ((ranks >> 8) + 1)  # words of 256 ranks
        self.top = 0  # a bit for each word that isn't zero
        self.buckets: dict[int, list[int]] = {}


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Ids of one pre-token. The queue must be empty and is left empty.

    Pushes and pops are written out in place, as this is the hot loop.
    """
    get = ranks.get
    if (whole := get(piece)) is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))  # start of the next symbol
    before = list(range(-1, n))
    pair = [get(piece[i : i + 2], -1) for i in range(n)]  # rank of the pair that starts here; -1: none, or merged away
    pair[-1] = -1  # a single byte is no pair
    leaf, buckets = queue.leaf, queue.buckets
    top = 0
    for i, r in enumerate(pair):
        if r >= 0:
            if r in buckets:
                buckets[r].append(i)  # ascending, so a heap
            else:
                buckets[r] = [i]
                leaf[r >> 8] |= 1 << (r & 255)
                top |= 1 << (r >> 8)
    while top:
        word = (top & -top).bit_length() - 1
        bits = leaf[word]
        low = bits & -bits
        r = word << 8 | low.bit_length() - 1
        bucket = buckets[r]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[r]
            leaf[word] = bits ^ low
            if bits == low:
                top &= top - 1
        if pair[i] != r:
            continue  # stale
        j = after[i]
        k = after[j]
        after[i] = k
        pair[j] = pair[i] = -1
        if k < n:
            before[k] = i
            s = get(piece[i : after[k]], -1)
            if s >= 0:
                pair[i] = s
                if s in buckets:
                    heappush(buckets[s], i)
                else:
                    buckets[s] = [i]
                    leaf[s >> 8] |= 1 << (s & 255)
                    top |= 1 << (s >> 8)
        if i:
            h = before[i]
            s = get(piece[h:k], -1)
            pair[h] = s
            if s >= 0:
                if s in buckets:
                    heappush(buckets[s], h)
                else:
                    buckets[s] = [h]
                    leaf[s >> 8] |= 1 << (s & 255)
                    top |= 1 << (s >> 8)
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Packed(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers, worked out when first met."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.queue = ranks, RankQueue(max(ranks.values(), default=0) + 1)

    def __missing__(self, token: str) -> bytes:
        piece = token.encode()
        ids = merge(piece, self.ranks, self.queue)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_PIECE:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[token] = packed
        return packed


@lru_cache(1)
def packed_by(path: str) -> Packed:
    """Kept by a worker from task to task."""
    return Packed(read_ranks(path))


#: For texts of these characters only, the standard library's engine splits as the usual pattern does, in half the time:
#: here `[L]` is \p{L} and `[0-9]` is \p{N}.
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NOT_PLAIN = re.compile("[^\t-\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    split = regex.compile(pattern).findall
    if pattern != default_pattern():
        return split
    odd, plain = NOT_PLAIN.search, PLAIN.findall
    return lambda text: split(text) if odd(text) else plain(text)


def encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    packed, split = packed_by(path), splitter(pattern)
    return lambda text: b"".join([packed[t] for t in split(text)])


def decoder(path: str) -> Callable[[bytes], bytes]:
    ranks = read_ranks(path)
    of = {i: piece for piece, i in ranks.items()}
    table = [of.get(i) for i in range(max(of, default=-1) + 1)]
    return lambda packed: b"".join([table[i] for i in np.frombuffer(packed, "<u4").tolist()])


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and `ids` (binary: little-endian unsigned 32-bit integers); with `decoded`, also the bytes those ids decode to.

    One narrow pass without a shuffle; the vocabulary is read once per worker from `path`, a file on every machine.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = encoder(path, pattern), decoder(path) if decoded else None
        names = ["doc_id", "ids", "decoded"][: 3 if decoded else 2]
        for ids, texts in text_batches(batches):
            for at in range(0, len(texts), 256):
                packed = [enc(t) for t in texts[at : at + 256]]
                cols = [packed, [dec(p) for p in packed]] if decoded else [packed]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), *(pa.array(c, pa.binary()) for c in cols)], names=names)

    return keyed_text(docs, key, text).mapInArrow(run, "doc_id long, ids binary" + ", decoded binary" * decoded)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and `decoded` (binary) of a table with doc_id and `ids` as `encode` gives them; null ids decode to null."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = decoder(path)
        for b in batches:
            made = [None if x is None else dec(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "decoded"])

    return tokens.select(tokens["doc_id"].cast("long").alias("doc_id"), tokens["ids"]).mapInArrow(run, "doc_id long, decoded binary")


def digests(tokens: DataFrame) -> DataFrame:
    """The columns by which an encoded and decoded table is compared with another."""
    return tokens.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
