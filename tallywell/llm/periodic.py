"""Periodic runs of words, found by comparing each document with itself at every lag.

A run is a stretch of consecutive words whose smallest period is q (words q apart are identical), at least MIN_LENGTH words and
MIN_EXPONENT periods long, that no neighbouring word extends. Words become ids, and the array of ids is compared with itself shifted by each lag up to
n / MIN_EXPONENT. Shifts are taken in blocks as one matrix, first at every t-th word only: with t a quarter of the
shortest stretch that counts, each such stretch shows four equal words in a row, so no lag is lost. The lags that show some are compared in full, and their
true stretches are run-length coded. Multiples of a period find the same stretch again; the smallest lag keeps it.

Most documents are one narrow pass. The lags of a document with more than LONG characters are dealt out in ranges over the machines,
as rows of (document, range) that carry the ids, and what they find is put together by document; a range holds at least RANGE
comparisons, and a document has MOST_RANGES at most, which bounds what is sent. Memory holds an Arrow batch, and CELLS cells of a matrix.

Defined results: a null text has no words, and no runs, like an empty one; words are parted by ASCII white space only; repeated rows and
ids, and null ids, are each scanned for themselves; an empty table gives an empty table; columns besides the id and the text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import keyed_text, shared_checkpoint

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Characters beyond which a document's lags are dealt out, comparisons of a range at least, and ranges of a document at most.
LONG, RANGE, MOST_RANGES = 1 << 15, 1 << 24, 16
#: Cells of a block of lags.
CELLS = 1 << 20
SEPARATORS = r"[\x20\x09-\x0D]+"

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_ids(words: list[bytes]) -> np.ndarray:
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def least_stretch(lag: int) -> int:
    """Equal words in a row, at this lag, of the shortest run."""
    return max(MIN_LENGTH, MIN_EXPONENT * lag) - lag


def lags_with_stretches(ids: np.ndarray, first: int, last: int) -> Iterator[int]:
    """The lags, ascending, that may have a stretch that is long enough; all that have one are among them."""
    n = len(ids)
    padded = np.concatenate([ids, np.full(last + 1, -1, np.int32)])
    size = padded.itemsize
    while first <= last:
        t = max(1, least_stretch(first) // 4)
        at = np.arange(0, n - first, t)
        if len(at) < 4:
            return
        end = min(last, 2 * first - 1, first + CELLS // len(at))
        shifted = np.lib.stride_tricks.as_strided(padded[first:], (end - first + 1, len(at)), (size, t * size), writeable=False)
        equal = shifted == ids[at]
        two = equal[:, 1:] & equal[:, :-1]
        yield from (first + np.flatnonzero((two[:, 2:] & two[:, :-2]).any(axis=1))).tolist()
        first = end + 1


def stretches(ids: np.ndarray, lag: int) -> list[tuple[int, int, int]]:
    """start, end (exclusive) and the lag, of each maximal stretch that has this period and is long enough."""
    equal = ids[lag:] == ids[:-lag]
    bounds = np.concatenate([[0], np.flatnonzero(equal[1:] != equal[:-1]) + 1, [len(equal)]])
    kept = (np.diff(bounds) >= least_stretch(lag)) & equal[bounds[:-1]]
    return [(s, e + lag, lag) for s, e in zip(bounds[:-1][kept].tolist(), bounds[1:][kept].tolist())]


def scan(ids: np.ndarray, first: int = 1, last: int | None = None) -> list[tuple[int, int, int]]:
    """start, end and smallest lag of the stretches that the lags of this range find."""
    last = len(ids) // MIN_EXPONENT if last is None else last
    found: dict[tuple[int, int], int] = {}
    for lag in lags_with_stretches(ids, first, last):
        for s, e, q in stretches(ids, lag):
            found.setdefault((s, e), q)
    return [(s, e, q) for (s, e), q in found.items()]


def described(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple[list[dict], bytes]:
    """The runs in order of start and period, and the words without what any run repeats."""
    found = sorted((s, q, e) for s, e, q in found)
    if found:
        kept = np.ones(len(words), bool)
        for s, q, e in found:
            kept[s + q : e] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return [{"start": s, "length": e - s, "period": q} for s, q, e in found], b" ".join(words)


OUT = f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed binary"


def arrow_schema(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def as_batches(rows: Iterator[tuple], schema: pa.Schema, at_once: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def in_one_pass(docs: DataFrame) -> DataFrame:
    out = arrow_schema(docs, OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for key, text in rows_of(batches, "doc_id", "text"):
                words = (text or b"").split()  # of bytes: parted by ASCII white space
                yield key, len(words), *described(words, scan(word_ids(words)))

        yield from as_batches(made(), out, 512)

    return docs.mapInArrow(run, OUT)


def by_ranges(docs: DataFrame, comparisons: int, most: int) -> DataFrame:
    """The same, with the lags of each document dealt out. The rows get numbers and are checkpointed, so that both passes see the same."""
    docs = shared_checkpoint(docs.withColumn("row", F.monotonically_increasing_id()))
    coded, ranges = "row bigint, n bigint, ids binary", "row bigint, start bigint, stop bigint, period bigint"
    coded_schema, ranges_schema, out = arrow_schema(docs, coded), arrow_schema(docs, ranges), arrow_schema(docs, OUT)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((row, len(ids), ids.tobytes()) for row, text in rows_of(batches, "row", "text") for ids in [word_ids((text or b"").split())])
        yield from as_batches(made, coded_schema, 32)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((row, *run) for row, ids, first, last in rows_of(batches, "row", "ids", "first", "last") for run in scan(np.frombuffer(ids, np.int32), first, last))
        yield from as_batches(made, ranges_schema, 8192)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for key, text, found in rows_of(batches, "doc_id", "text", "found"):
                words = (text or b"").split()
                yield key, len(words), *described(words, [(r["start"], r["stop"], r["period"]) for r in found or []])

        yield from as_batches(made(), out, 32)

    lags = F.floor(F.col("n") / MIN_EXPONENT)
    parts = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.col("n") * lags / comparisons)))
    ids = docs.select("row", "text").mapInArrow(encode, coded).withColumn("parts", parts.cast("int"))
    part = ids.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    bounds = part.select("row", "part", "ids", (F.floor(lags * F.col("part") / F.col("parts")) + 1).alias("first"), F.floor(lags * (F.col("part") + 1) / F.col("parts")).alias("last"))
    found = bounds.repartition("row", "part").select("row", "ids", "first", "last").mapInArrow(find, ranges)
    least = found.groupBy("row", "start", "stop").agg(F.min("period").alias("period"))  # ranges of multiples find a stretch again
    by_document = least.groupBy("row").agg(F.collect_list(F.struct("start", "stop", "period")).alias("found"))
    return docs.join(by_document, "row", "left").select("doc_id", "text", "found").mapInArrow(finish, OUT)


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", long: int = LONG, comparisons: int = RANGE, most: int = MOST_RANGES) -> DataFrame:
    """doc_id, n_words, `runs` (start, length, period; by start, then period) and `collapsed`: the words that no run repeats, joined by one space."""
    own = keyed_text(docs, key, text)
    size = F.coalesce(F.length("text"), F.lit(0))
    as_bytes = F.col("text").cast("binary").alias("text")
    found = in_one_pass(own.where(size <= long).select("doc_id", as_bytes)).unionByName(by_ranges(own.where(size > long).select("doc_id", as_bytes), comparisons, most))
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def repeated_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, the tails of a tenth of the documents made periodic by a rule of their ids (which plants runs of known place and period)."""
    own = keyed_text(docs, key, text)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", SEPARATORS), lambda w: w != "")
    chosen = own.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    a = F.when(n > 0, (g % n).cast("int"))
    spread = chosen.select("doc_id", "text", "w", n.alias("n"), g.alias("g"), a.alias("a"))
    p = (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int")
    planned = spread.select("doc_id", "text", "w", "n", "a", p.alias("p"))
    rest = F.col("n") - F.col("a")
    block = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return planned.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def strongest(found: Column) -> Column:
    """The run of greatest length over period, of these of the smallest start, then period. Quotients of whole numbers below 2^26 differ as doubles wherever they differ."""
    return F.array_min(F.transform(found, lambda r: F.struct((-(r["length"] / r["period"])).alias("order"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))


def digests(found: DataFrame) -> DataFrame:
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = found.select("*", strongest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
