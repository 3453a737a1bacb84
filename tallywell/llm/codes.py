"""Product codes of vectors, with codebooks from filtering Lloyd iterations.

Components become whole numbers, floor(scale * x). Vectors are cut into parts of consecutive components, and each part's place has a
codebook of its own, which starts from the vectors of the smallest ids. A round assigns every part to its nearest entry and moves each
entry to the floor of its parts' mean. Every task takes its rows in blocks of bounded size and builds a kd-tree over each part's place: boxes split in halves at
the median of their widest side, each with its bounds and its cached sum and count. The codebook's entries go down the tree together, a level at a
time. At a box, the entry nearest to its middle beats every entry that is no nearer in the corner that suits that one best; where one is left,
the whole subtree is its own, by the cached sum and count. Only leaves where several are left compare their points. Everything is whole numbers, so the
result is exact, and the same however rows are dealt out. Tasks send one row for each entry and component; the driver holds the codebooks.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are left out, and so are those of another length than the
first by id; a length that the parts don't divide gives parts whose lengths are one apart; products beyond +-2^24 count as that; ids that repeat
count each, and among the first ones go by their components; null ids come last; with fewer rows than entries there are as many entries as rows; errors
are summed over equal labels, null ones together; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallywell.llm.common import shared_checkpoint

PARTS, ENTRIES, ROUNDS, SCALE, BOUND = 16, 64, 2, 256, 1 << 24
#: Components of a block at most (but for a single Arrow batch), points of a leaf at most, and labels whose sums may be broadcast.
BLOCK, LEAF, LABELS = 1 << 22, 32, 1 << 16

Codebooks = list[np.ndarray]  # for each part, its entries in rows


def whole_numbers(column: pa.Array, scale: int, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their components as whole numbers (of one length: that given, or all rows' if they agree; else of the first)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become no number
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    size = np.diff(offsets)
    good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (size > 0)
    if length is None:
        length = int(size[good][0]) if good.any() else 0
    good &= size == length
    rows = np.flatnonzero(good)
    with np.errstate(over="ignore"):
        q = np.clip(np.floor(x[offsets[rows][:, None] + np.arange(length)] * scale), -BOUND, BOUND)
    return rows, q.astype(np.int64)


class Tree:
    """A balanced kd-tree as arrays: at level l the points lie in 2^l boxes of equal numbers. Points that fill up the last boxes repeat one and weigh nothing."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        self.depth = max(0, ceil(log2(n / LEAF))) if n else 0
        leaf = -(-n // (1 << self.depth))
        filled = np.minimum(np.arange(leaf << self.depth), n - 1)
        weight = (np.arange(len(filled)) < n).astype(np.int64)
        p = points[filled]
        for level in range(self.depth):
            boxes = p.reshape(1 << level, -1, p.shape[1])
            widest = np.ptp(boxes, axis=1).argmax(axis=1)
            side = np.take_along_axis(boxes, widest[:, None, None], axis=2)[:, :, 0]
            order = np.argpartition(side, side.shape[1] // 2, axis=1) + (np.arange(1 << level) * side.shape[1])[:, None]
            order = order.ravel()
            p, filled, weight = p[order], filled[order], weight[order]
        self.points, self.place, self.weight = p, filled, weight
        self.bounds, self.sums, self.counts = [], [], []
        for level in range(self.depth + 1):
            boxes = p.reshape(1 << level, -1, p.shape[1])
            self.bounds.append((boxes.min(axis=1), boxes.max(axis=1)))
            self.sums.append((boxes * weight.reshape(1 << level, -1, 1)).sum(axis=1))
            self.counts.append(weight.reshape(1 << level, -1).sum(axis=1))

    def split(self, entries: np.ndarray, whole: Callable[[int, np.ndarray, np.ndarray], None], points: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Tells `whole` (level, boxes, entries) which boxes belong to an entry, and `points` (leaves, entry of each of their points) of the rest."""
        k = len(entries)
        boxes, left = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level in range(self.depth + 1):
            low, high = (x[boxes] for x in self.bounds[level])
            middle = np.where(left, ((2 * entries - (low + high)[:, None]) ** 2).sum(axis=2), np.iinfo(np.int64).max)
            best = middle.argmin(axis=1)
            own = entries[best][:, None]
            apart = entries - own
            corner = np.where(apart > 0, high[:, None], low[:, None])
            farther = (apart * (entries + own - 2 * corner)).sum(axis=2)  # than the best one, in the corner that suits the entry best
            left &= (farther < 0) | ((farther == 0) & (np.arange(k) <= best[:, None]))
            single = left.sum(axis=1) == 1
            if single.any():
                whole(level, boxes[single], best[single])
            boxes, left = boxes[~single], left[~single]
            if not len(boxes):
                return
            if level < self.depth:
                boxes, left = (2 * boxes[:, None] + [0, 1]).ravel(), np.repeat(left, 2, axis=0)
        most = left.sum(axis=1).max()
        chosen = np.argsort(~left, axis=1, kind="stable")[:, :most]  # entries that are left, ascending, then others
        there = np.take_along_axis(left, chosen, axis=1)
        p = self.points.reshape(1 << self.depth, -1, entries.shape[1])[boxes]
        e = entries[chosen]
        distance = np.zeros((len(boxes), p.shape[1], most), np.int64)
        for d in range(entries.shape[1]):
            distance += (p[:, :, d][:, :, None] - e[:, :, d][:, None, :]) ** 2
        distance[np.broadcast_to(~there[:, None, :], distance.shape)] = np.iinfo(np.int64).max
        points(boxes, np.take_along_axis(chosen, distance.argmin(axis=2), axis=1))

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the points of each entry."""
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)

        def whole(level: int, boxes: np.ndarray, own: np.ndarray) -> None:
            np.add.at(sums, own, self.sums[level][boxes])
            np.add.at(counts, own, self.counts[level][boxes])

        def points(leaves: np.ndarray, own: np.ndarray) -> None:
            weight = self.weight.reshape(1 << self.depth, -1)[leaves]
            np.add.at(sums, own.ravel(), (self.points.reshape(1 << self.depth, -1, entries.shape[1])[leaves] * weight[:, :, None]).reshape(-1, entries.shape[1]))
            np.add.at(counts, own.ravel(), weight.ravel())

        self.split(entries, whole, points)
        return sums, counts

    def assigned(self, entries: np.ndarray, n: int) -> np.ndarray:
        """The entry of each of the n points, in their own order."""
        codes = np.empty(len(self.place), np.int64)

        def whole(level: int, boxes: np.ndarray, own: np.ndarray) -> None:
            codes.reshape(1 << level, -1)[boxes] = own[:, None]

        def points(leaves: np.ndarray, own: np.ndarray) -> None:
            codes.reshape(1 << self.depth, -1)[leaves] = own

        self.split(entries, whole, points)
        out = np.empty(n, np.int64)
        out[self.place] = codes
        return out


def cuts(length: int, parts: int) -> list[slice]:
    return [slice(i * length // parts, (i + 1) * length // parts) for i in range(parts)]


def blocks(batches: Iterator[pa.RecordBatch], scale: int, length: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray]]:
    """The rows that take part, in blocks: what stands beside their vectors, and their components."""
    beside, held, n = [], [], 0
    for b in batches:
        rows, q = whole_numbers(b.column("v"), scale, length)
        beside.append(b.take(pa.array(rows)).drop_columns(["v"]))
        held.append(q)
        n += len(rows)
        if n * length >= BLOCK:
            yield beside, np.concatenate(held)
            beside, held, n = [], [], 0
    if n:
        yield beside, np.concatenate(held)


def first_rows(vectors: DataFrame, entries: int, scale: int) -> np.ndarray:
    """The components of the rows of the smallest ids. Each batch offers as many as there are entries; vectors of another length than the first's don't count."""

    def offered(length: int | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for size in [length] if length else np.unique(np.diff(b.column("v").offsets.to_numpy())).tolist():
                    rows, q = whole_numbers(b.column("v"), scale, size)
                    if not len(rows):
                        continue
                    ids = b.column("vec_id").take(pa.array(rows))
                    known, value = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                    order = np.lexsort([*q.T[::-1], value, ~known])[:entries]
                    out = q[order]
                    lists = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * size, out.ravel())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(order)), lists], names=["vec_id", "q"])

        return vectors.select("vec_id", "v").mapInArrow(run, "vec_id bigint, q array<bigint>").orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries)

    found = offered(None).collect()
    if len({len(r.q) for r in found}) > 1:
        found = offered(len(found[0].q)).collect()
    return np.array([r.q for r in found], np.int64)


def moved(vectors: DataFrame, books: Codebooks, scale: int, length: int) -> Codebooks:
    """The codebooks after one round."""
    places = cuts(length, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for _, q in blocks(batches, scale, length):
            for i, cut in enumerate(places):
                s, c = Tree(q[:, cut]).totals(books[i])
                sums[i] += s
                counts[i] += c
        for i, (s, c) in enumerate(zip(sums, counts)):
            entry, at = (x.ravel() for x in np.indices(s.shape))
            used = c[entry] > 0
            cols = [np.full(used.sum(), i), entry[used], at[used], s.ravel()[used], c[entry][used]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["part", "entry", "at", "sum", "n"])

    found = vectors.select("v").mapInArrow(run, "part bigint, entry bigint, at bigint, sum bigint, n bigint").groupBy("part", "entry", "at").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    out = [b.copy() for b in books]
    for part, entry, at, total, n in found.collect():  # one row for each component of the codebooks
        out[part][entry, at] = total // n
    return out


def digest_of(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def codebooks(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    """`vectors` has vec_id and v (array<double>)."""
    first = first_rows(vectors, entries, scale)
    if not len(first):
        return []
    books = [first[:, cut] for cut in cuts(first.shape[1], parts)]
    for _ in range(rounds):
        books = moved(vectors, books, scale, first.shape[1])
    return books


def coded(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code, error and label_error of each row that takes part, and the codebooks."""
    own = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[label].alias("label"), vectors[vector].cast("array<double>").alias("v"))
    books = codebooks(own, parts, entries, rounds, scale)
    length = sum(b.shape[1] for b in books)
    kind = own.schema["label"].dataType
    schema = StructType([StructField("vec_id", LongType()), StructField("label", kind), StructField("code", StringType()), StructField("error", LongType())])
    places = cuts(length, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for beside, q in blocks(batches, scale, length) if books else ():
            codes, error = np.empty((len(q), parts), np.uint8), np.zeros(len(q), np.int64)
            for i, cut in enumerate(places):
                p = q[:, cut]
                c = Tree(p).assigned(books[i], len(p))
                error += ((p - books[i][c]) ** 2).sum(axis=1)
                codes[:, i] = c
            text = codes.tobytes().hex()
            at = 0
            for b in beside:
                end = at + b.num_rows
                yield b.append_column("code", pa.array([text[2 * parts * j : 2 * parts * (j + 1)] for j in range(at, end)], pa.string())).append_column("error", pa.array(error[at:end]))
                at = end

    if entries > 256:
        raise ValueError("a code has two hexadecimal digits for each part")
    found = shared_checkpoint(own.mapInArrow(run, schema))
    sums = shared_checkpoint(found.groupBy("label").agg(F.sum("error").alias("label_error")))
    few = sums.limit(LABELS + 1).count() <= LABELS
    # many labels are joined by a shuffle, where the engine splits the partitions of a label with many rows
    total = (F.broadcast(sums) if few else sums).withColumnRenamed("label", "of")
    joined = found.join(total, found["label"].eqNullSafe(total["of"]), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error"), books


def digests(found: DataFrame, books: Codebooks) -> DataFrame:
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))
