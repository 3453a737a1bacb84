"""Language-model scoring by Brown class bigrams.

The tokens of a text are its words and one end. Every training word gets its class by exchange clustering: the class that most
raises the likelihood of the class bigrams. The CORE most frequent words are exchanged one after another, until few move, from
their table of bigrams. All other words are exchanged in parallel, against the table of class bigrams as it stands: for each word
the classes before and after it are counted over all training documents, summed in Spark, and the gain of each class is worked out
where the word's counts meet. This is done in two rounds: first the KNOWN most frequent words are placed by the CORE around them;
then these are exchanged again, and all the rest of the vocabulary, however large, is placed, by the KNOWN words around them. A word
that has no such word beside it, and a word that no training text holds, takes the class most tokens of KNOWN words with its
ending belong to. The end is a class of its own. A token's probability is that of its class after the class before it, times
that of the word in its class, both smoothed by adding SMOOTHING.

Every count covers all training documents. Texts are split once and kept as numbers, in chunks: KNOWN words by their rank, others
by their place in the chunk's list of words, which is joined with the table of all words. Only tables bounded by the parameters
come to the driver or to all tasks: the KNOWN words with counts and classes, the bigrams of the CORE, and class counts.

Defined results: a null or empty text has one token, its end; rows without an id teach nothing and have a null `held_out`;
repeated rows are learned from and scored each for itself; with no training text, N is 0 and all tokens are unknown; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import keyed_text, remainder, removed, shared_checkpoint, written

#: Words that every task can look up at most, words that are exchanged one by one, and classes besides the end's.
KNOWN, CORE, CLASSES = 1 << 17, 2048, 48
#: Rounds of exchange of the core at most; it also ends when fewer than 1 % of the words move.
ROUNDS = 4
SMOOTHING = 0.5
ENDINGS = (3, 2, 1)
#: The end token's word: no word holds a line feed.
END = b"\n"
#: Different words that a task counts before it hands their counts on.
WORDS_AT_ONCE = 300_000
#: Characters of a chunk of texts.
CHUNK = 2_000_000


def words_of(text: str | None) -> list[bytes]:
    """Only A-Z are lower-cased, and only ASCII white space splits: bytes do both so."""
    return text.encode().lower().split() if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """word (UTF-8) and n over all rows of `text`, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                counts.update(words_of(t))
                counts[END] += 1
                if len(counts) > WORDS_AT_ONCE:
                    yield made(counts)
                    counts.clear()
        if counts:
            yield made(counts)

    def made(counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> list:
    """The `most` most frequent words, by falling count, then by word, but of equally frequent ones at the limit those of the least hash.

    Counts are put into steps of an eighth of an octave; of the step that passes the limit single counts are taken, and of the
    count that passes it a share by hash. So no task sends more rows than belong to the result, or a few more.
    """
    step = F.floor(F.log2("n") * 8)
    left, low = most, counts
    levels = ((step, True), (F.col("n"), True), (F.pmod(F.xxhash64("word"), F.lit(1 << 20)), False))
    kept = []
    for level, falling in levels:  # each has few different values within the one before
        for r in sorted(low.groupBy(level.alias("level")).count().collect(), key=lambda r: r["level"], reverse=falling):
            if r["count"] > left:
                break
            left -= r["count"]
        else:
            kept.append(low)
            break
        kept.append(low.where(level > r["level"] if falling else level < r["level"]))
        low = low.where(level == r["level"])
    rows = [r for k in kept for r in k.collect()]
    return sorted(rows, key=lambda r: (-r["n"], bytes(r["word"])))


class Rare(dict):
    """A chunk's other words, numbered -1, -2, ... as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = -1 - len(self)
        return n


ENCODED = "chunk bigint, doc_ids array<bigint>, learn binary, sizes binary, ids binary, rare array<binary>"


def encoded(docs: DataFrame, known: list[bytes]) -> DataFrame:
    """Chunks of documents as numbers. ids: ranks of known words (the end is 0), or -1 - place in `rare`; sizes: tokens of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {w: i for i, w in enumerate(sent.value)}.get
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            keys, texts, learn = (b.column(c).to_pylist() for c in ("doc_id", "text", "learn"))
            at = 0
            while at < len(texts):
                rare, ids, sizes, size, begin = Rare(), [], [], 0, at
                number = rare.__getitem__
                while at < len(texts) and (at == begin or size < CHUNK):
                    own = [i if (i := get(w)) is not None else number(w) for w in words_of(texts[at])]
                    own.append(0)
                    ids.append(np.array(own, "<i4"))
                    sizes.append(len(own))
                    size += len(texts[at] or "")
                    at += 1
                flags = np.array([bool(x) for x in learn[begin:at]]).tobytes()
                row = ([chunk], [keys[begin:at]], [flags], [np.array(sizes, "<u4").tobytes()], [np.concatenate(ids).tobytes()], [list(rare)])
                types = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=[x.split()[0] for x in ENCODED.split(", ")])
                chunk += 1

    return docs.select("doc_id", "text", "learn").mapInArrow(run, ENCODED)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """ids of the tokens before and of the tokens that are learned from (a text begins after an end), and the other words."""
    for b in batches:
        for learn, sizes, ids, rare in zip(*(b.column(c) for c in ("learn", "sizes", "ids", "rare"))):
            ids = np.frombuffer(ids.as_buffer(), "<i4")
            kept = np.repeat(np.frombuffer(learn.as_buffer(), bool), np.frombuffer(sizes.as_buffer(), "<u4"))
            yield np.append(np.int32(0), ids)[kept.nonzero()[0]], ids[kept], rare


def core_bigrams(texts: DataFrame, k: int) -> np.ndarray:
    """How often each of the first k known words follows each other one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for before, ids, _ in chunks(batches):
            both = (before >= 0) & (ids >= 0) & (before < k) & (ids < k)
            total += np.bincount(before[both].astype(np.int64) * k + ids[both], minlength=k * k)
        code = np.nonzero(total)[0]
        if not len(code):
            return
        # rows by diagonals: each has frequent and rare words, so they are of like size
        diagonal = (code // k + code % k) % k
        order = np.argsort(diagonal, kind="stable")
        code, diagonal = code[order], diagonal[order]
        rows, at = np.unique(diagonal, return_index=True)
        ends = np.append(at[1:], len(code))
        blobs = [((code[a:e] // k).astype("<u4").tobytes(), total[code[a:e]].astype("<i8").tobytes()) for a, e in zip(at, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([x for x, _ in blobs], pa.binary()), pa.array([x for _, x in blobs], pa.binary())], names=["d", "v", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = -1, np.zeros(k, np.int64)
        for b in batches:
            for d, v, n in zip(*(b.column(c).to_pylist() for c in ("d", "v", "n"))):
                if d != now:
                    if now >= 0:
                        yield row(now, total)
                    now, total = d, np.zeros(k, np.int64)
                total[np.frombuffer(v, "<u4")] += np.frombuffer(n, "<i8")
        if now >= 0:
            yield row(now, total)

    def row(d: int, total: np.ndarray) -> pa.RecordBatch:
        v = np.nonzero(total)[0]
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([v.astype("<u4").tobytes()], pa.binary()), pa.array([total[v].astype("<i8").tobytes()], pa.binary())], names=["d", "v", "n"])

    schema = "d bigint, v binary, n binary"
    sums = texts.mapInArrow(count, schema).repartition("d").sortWithinPartitions("d").mapInArrow(add, schema)
    out = np.zeros((k, k), np.int64)
    for r in sums.toLocalIterator():  # k rows of k numbers at most
        v = np.frombuffer(r["v"], "<u4").astype(np.int64)
        out[v, (r["d"] - v) % k] = np.frombuffer(r["n"], "<i8")
    return out


def phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(n: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each word but the first (the end), which keeps class `classes`; n: bigram counts, words by falling frequency."""
    k, c = len(n), classes + 1
    of = np.append(classes, np.arange(k - 1) % classes)
    n = n.astype(np.float64)
    hot = np.eye(c)[of]
    right, left = n @ hot, n.T @ hot  # of each word, to and from each class
    table = hot.T @ right
    after, before = n.sum(1), n.sum(0)
    to, fro = table.sum(1), table.sum(0)
    for _ in range(rounds):
        moved = 0
        for w in range(1, k):
            g, own = of[w], n[w, w]
            r, le = right[w].copy(), left[w].copy()
            r[g] -= own
            le[g] -= own  # now without the word itself
            table[g] -= r
            table[:, g] -= le
            table[g, g] -= own
            to[g] -= after[w]
            fro[g] -= before[w]
            gain = (phi(table + r) - phi(table)).sum(1) + (phi(table.T + le) - phi(table.T)).sum(1)
            d = np.diag(table)
            gain += phi(d + r + le + own) + phi(d) - phi(d + r) - phi(d + le)
            gain -= phi(to + after[w]) - phi(to) + phi(fro + before[w]) - phi(fro)
            gain[classes] = -np.inf
            best = int(np.argmax(gain))
            h = best if gain[best] > gain[g] + 1e-9 else g
            table[h] += r
            table[:, h] += le
            table[h, h] += own
            to[h] += after[w]
            fro[h] += before[w]
            if h != g:
                moved += 1
                of[w] = h
                right[:, g] -= n[:, w]
                right[:, h] += n[:, w]
                left[:, g] -= n[w]
                left[:, h] += n[w]
        if moved < 0.01 * k:
            break
    return of


#: A word's counts are packed as 16-bit numbers: 7 bits say what is counted (left classes, then right ones; COUNT: the word itself),
#: 7 bits are a digit of the count to the base of 128, 2 bits say which digit.
COUNT = 127


def packed(row: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (sorted) and records of counts."""
    parts = [(row[d > 0], (code[d > 0] | e << 7 | d[d > 0] << 9).astype("<u2")) for e in range(4) if (d := n >> 7 * e & 127).any()]
    if not parts:
        return row[:0], np.empty(0, "<u2")
    row, record = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(row, kind="stable")
    return row[order], record[order]


def contexts(texts: DataFrame, known: list[bytes], of: np.ndarray, c: int, others: bool) -> DataFrame:
    """word and `at`, packed counts of the classes beside it: of known words but the end and, if wanted, of all others.

    of: class of each known word, -1 where it has none yet. A task sums its own counts first.
    """
    sent = texts.sparkSession.sparkContext.broadcast((known, of))
    wide = 2 * (c + 1)

    def batch(words: list[bytes], blobs: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(blobs, pa.binary())], names=["word", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = sent.value
        k = len(known)
        of = np.append(of, -1)  # the last is for the words that aren't known
        total, own = np.zeros(k * wide, np.int32), np.zeros(k, np.int64)
        waiting: list[np.ndarray] = []
        held: dict[bytes, bytes] = {}

        def add() -> None:
            if waiting:
                code, n = np.unique(np.concatenate(waiting), return_counts=True)
                total[code] += n.astype(np.int32)
                waiting.clear()

        for before, ids, rare in chunks(batches):
            after = np.append(ids[1:], np.int32(0))  # what follows an end is never looked at
            left, right = of[np.maximum(before, -1)], of[np.maximum(after, -1)]
            at = ids > 0
            own += np.bincount(ids[at], minlength=k)
            for side, base in ((left, 0), (right, c + 1)):
                good = at & (side >= 0)
                waiting.append(ids[good].astype(np.int64) * wide + base + side[good])
            if sum(map(len, waiting)) > 4_000_000:
                add()
            if not others or not len(rare):
                continue
            at = np.flatnonzero(ids < 0)
            word = -1 - ids[at].astype(np.int64)
            rows, codes = [word], [np.full(len(word), COUNT)]
            for side, base in ((left[at], 0), (right[at], c + 1)):
                rows.append(word[side >= 0])
                codes.append(base + side[side >= 0])
            code, n = np.unique(np.concatenate(rows) * 128 + np.concatenate(codes), return_counts=True)
            row, record = packed(code >> 7, code & 127, n)
            cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else []
            data, words = record.tobytes(), rare.as_py()
            ends = [*(2 * cut[1:]).tolist(), len(data)] if len(cut) else []
            for j, u, v in zip(row[cut].tolist(), (2 * cut).tolist() if len(cut) else [], ends):
                w = words[j]
                held[w] = held.get(w, b"") + data[u:v]
            if len(held) > WORDS_AT_ONCE:
                yield batch(list(held), list(held.values()))
                held.clear()
        add()
        if held:
            yield batch(list(held), list(held.values()))
        for first in range(1, k, 16384):
            ids = np.arange(first, min(k, first + 16384))
            row, code = np.nonzero(total.reshape(k, wide)[ids])
            n = total.reshape(k, wide)[ids[row], code].astype(np.int64)
            some = np.flatnonzero(own[ids])
            row, record = packed(np.concatenate([row, some]), np.concatenate([code, np.full(len(some), COUNT)]), np.concatenate([n, own[ids[some]]]))
            cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
            data = record.tobytes()
            if len(cut):
                yield batch([known[i] for i in ids[row[cut]].tolist()], [data[u:v] for u, v in zip((2 * cut).tolist(), [*(2 * cut[1:]).tolist(), len(data)])])

    return texts.select("learn", "sizes", "ids", "rare").mapInArrow(run, "word binary, at binary")


def gains(counts: np.ndarray, table: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What each class but the end's would gain with each word, given the word's counts of classes before and after it.

    table: class bigrams, the end last; own: the word's class, whose counts hold those of the word, or -1.
    """
    c = len(table) - 1
    to, fro = table.sum(1), table.sum(0)
    around = np.concatenate([table[:, :c], table[:c].T])  # for each code: the count that grows if the word joins h
    plain = phi(around)
    out = np.zeros((len(counts), c))
    row, code = np.nonzero(counts)
    for at in range(0, len(row), 1 << 16):
        part = slice(at, at + (1 << 16))
        first, begin = np.unique(row[part], return_index=True)
        out[first] += np.add.reduceat(phi(around[code[part]] + counts[row[part], code[part], None]) - plain[code[part]], begin, axis=0)
    before, after = counts[:, : c + 1].sum(1), counts[:, c + 1 :].sum(1)
    left, right = counts[:, :c], counts[:, c + 1 : 2 * c + 1]
    d = np.diag(table)[:c]
    out += phi(d + right + left) + phi(d) - phi(d + right) - phi(d + left)
    # most words have one of few numbers of neighbours
    (some, i), (other, j) = (np.unique(v, return_inverse=True) for v in (after, before))
    out -= (phi(to[:c] + some[:, None]) - phi(to[:c]))[i] + phi(fro[:c] + other[:, None])[j] - phi(fro[:c])
    # a word's own class: without the word itself
    w = np.flatnonzero(own >= 0)
    g = own[w]
    le, r = left[w, g], right[w, g]
    less = np.maximum(d[g] - le - r, 0)
    held = np.flatnonzero(own[row] >= 0)
    row, code = row[held], code[held]
    n, h = counts[row, code], own[row]
    place = np.searchsorted(w, row)
    base = np.where((code == h) | (code == c + 1 + h), less[place], np.maximum(around[code, h] - n, 0)) if len(w) else n
    gain = np.bincount(place, phi(base + n) - phi(base), minlength=len(w)).astype(np.float64)
    gain += phi(less + le + r) + phi(less) - phi(less + r) - phi(less + le)
    gain -= phi(to[g]) - phi(np.maximum(to[g] - after[w], 0)) + phi(fro[g]) - phi(np.maximum(fro[g] - before[w], 0))
    out[w, g] = gain
    return out


@dataclass
class Classes:
    """Classes of known words (the end's is c), and the class of most of their tokens for each ending."""

    c: int
    known: dict[bytes, int]
    endings: dict[str, int]

    def ending(self, word: bytes) -> int:
        w = word[-16:].decode(errors="replace")
        return next((g for e in ENDINGS if (g := self.endings.get(w[-e:])) is not None), 0)


def classes_of(known: list[bytes], counts: list[int], of: np.ndarray, c: int) -> Classes:
    by_ending: dict[str, Counter[int]] = {}
    for w, n, g in list(zip(known, counts, of.tolist()))[1:]:
        text = w[-16:].decode(errors="replace")
        for e in ENDINGS:
            if g >= 0 and len(text) >= e:
                by_ending.setdefault(text[-e:], Counter())[g] += n
    return Classes(c, dict(zip(known, of.tolist())), {e: min(x, key=lambda g: (-x[g], g)) for e, x in by_ending.items()})


PLACED = "word binary, n bigint, g int, exchanged boolean, id int"


def exchanged(found: DataFrame, known: list[bytes], of: np.ndarray, core: int, table: np.ndarray, classes: Classes) -> DataFrame:
    """Each word of `contexts` with its count and the class of most gain; core words keep theirs. id: rank of a known word."""
    sent = found.sparkSession.sparkContext.broadcast((known, of, table, classes))
    c = len(table) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of, table, classes = sent.value
        get = {w: i for i, w in enumerate(known)}.get
        last: tuple[bytes, np.ndarray] | None = None  # of the word whose rows may go on

        def placed(words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
            ids = np.array([get(w, -1) for w in words], np.int64)
            own = np.where(ids >= 0, of[np.maximum(ids, 0)], -1)
            beside = counts[:, : 2 * (c + 1)].astype(np.float64)
            fixed = (ids >= 0) & (ids < core)
            some = beside.any(1) & ~fixed
            g = own.copy()
            if some.any():
                gain = gains(beside[some], table, own[some])
                best = gain.argmax(1)
                stay = own[some]
                keep = (stay >= 0) & (gain[np.arange(len(best)), best] <= gain[np.arange(len(best)), np.maximum(stay, 0)] + 1e-9)
                g[some] = np.where(keep, stay, best)
            for i in np.flatnonzero(g < 0):
                g[i] = classes.ending(words[i])
            columns = ((words, pa.binary()), (counts[:, COUNT], pa.int64()), (g, pa.int32()), (some | fixed, pa.bool_()), (ids, pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=[x.split()[0] for x in PLACED.split(", ")])

        for b in batches:
            words = b.column("word").to_pylist()
            if not words:
                continue
            blobs = b.column("at").to_pylist()
            record = np.frombuffer(b"".join(blobs), "<u2").astype(np.int64)
            new = [i == 0 or w != words[i - 1] for i, w in enumerate(words)]
            group = np.cumsum(new) - 1
            at = np.repeat(group, [len(x) // 2 for x in blobs])
            g = int(group[-1]) + 1
            counts = np.bincount(at * 128 + (record & 127), weights=(record >> 9) << 7 * (record >> 7 & 3), minlength=g * 128).reshape(g, 128).astype(np.int64)
            words = [w for w, x in zip(words, new) if x]
            if last and last[0] == words[0]:
                counts[0] += last[1]
            elif last:
                yield placed([last[0]], last[1][None])
            last = (words[-1], counts[-1])
            if g > 1:
                yield placed(words[:-1], counts[:-1])
        if last:
            yield placed([last[0]], last[1][None])

    return found.repartition("word").sortWithinPartitions("word").mapInArrow(run, PLACED)


def class_table(pairs: np.ndarray, of: np.ndarray, c: int) -> np.ndarray:
    """Class bigrams of words, from their bigram counts and classes."""
    hot = np.eye(c + 1)[of]
    return hot.T @ (pairs.astype(np.float64) @ hot)


def known_table(texts: DataFrame, of: np.ndarray, c: int) -> np.ndarray:
    """Class bigrams of neighbours that are both known and have a class."""
    sent = texts.sparkSession.sparkContext.broadcast(of)
    k = c + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = np.append(sent.value, -1), np.zeros(k * k, np.int64)
        for before, ids, _ in chunks(batches):
            g, h = of[np.maximum(before, -1)], of[np.maximum(ids, -1)]
            both = (g >= 0) & (h >= 0)
            total += np.bincount(g[both] * k + h[both], minlength=k * k)
        code = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    return summed(texts.mapInArrow(run, "code bigint, n bigint"), k)


def summed(parts: DataFrame, k: int) -> np.ndarray:
    out = np.zeros(k * k)
    for r in parts.groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r["code"]] = r["n"]
    return out.reshape(k, k)


@dataclass
class Model:
    known: list[bytes]  # by falling count; the first is the end
    counts: list[int]
    tokens: int  # N
    words: int  # V
    classes: Classes
    below: np.ndarray  # log10 of the denominator of a word's probability in its class
    placed: DataFrame  # all other words too, with their counts and classes
    exchanged: float  # share of the training tokens, ends left out, whose class is by exchange
    transition: np.ndarray | None = None  # log10 of a class after a class

    @property
    def base_below(self) -> float:
        return float(np.log10(self.tokens + SMOOTHING * (self.words + 1)))


def clustered(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model but for its transitions, from the rows of doc_id, text and learn; and all rows, encoded."""
    counts = shared_checkpoint(word_counts(docs.where("learn")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = most_frequent(counts.where(F.col("word") != END), KNOWN - 1)
    ends = sum(r["n"] for r in counts.where(F.col("word") == END).collect())
    known, n = [END, *(bytes(r["word"]) for r in top)], [ends, *(r["n"] for r in top)]
    texts = written(encoded(docs, known), "encoded")
    core = min(CORE, len(known))
    c = max(1, min(CLASSES, core - 1))
    of = np.full(len(known), -1, np.int64)
    pairs = core_bigrams(texts, core)
    of[:core] = exchange(pairs, c)
    placed = None
    for others in (False, True):
        # as long as only the core has classes, its bigrams say all
        classes, table = classes_of(known, n, of, c), known_table(texts, of, c) if others else class_table(pairs, of[:core], c)
        last, placed = placed, written(exchanged(contexts(texts, known, of, c, others), known, of, core, table, classes), "placed")
        if last is not None:
            removed(docs.sparkSession, last)
        of = of.copy()
        for r in placed.where("id >= 0").select("id", "g").collect():  # KNOWN rows at most
            of[r["id"]] = r["g"]
    classes = Classes(c, dict(zip(known, of.tolist())), classes.endings)
    tokens, words, by_exchange = np.zeros(c + 1), np.zeros(c + 1), 0
    tokens[c], words[c] = ends, 1
    for r in placed.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("exchanged"), F.col("n"))).alias("e")).collect():
        tokens[r["g"]], words[r["g"]], by_exchange = r["n"], r["v"], by_exchange + (r["e"] or 0)
    below = np.log10(tokens + SMOOTHING * (words + 1))
    share = by_exchange / max(1, int(total["n"]) - ends)
    return Model(known, n, int(total["n"]), int(total["v"]), classes, below, placed.where("id < 0").select("word", "n", "g"), share), texts


SEQUENCE = "doc_id bigint, learn boolean, n_tokens bigint, n_known bigint, base double, emission double, g binary"


def sequences(texts: DataFrame, model: Model) -> DataFrame:
    """One row for each document: its tokens' classes, and the sums that need no transitions."""
    small = (model.known, model.counts, model.classes, model.below, model.base_below)
    sent = texts.sparkSession.sparkContext.broadcast(small)
    asked = texts.select(F.col("chunk").alias("of"), F.posexplode("rare").alias("j", "word"))
    looked = asked.join(model.placed, "word").select("of", "j", "n", "g")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known, counts, classes, below, base_below = sent.value
        of = np.array([classes.known[w] for w in known], np.int64)
        parts = []
        for i in range(left.num_rows):
            doc_ids, learn, sizes, ids, rare = (left.column(c)[i].as_py() for c in ("doc_ids", "learn", "sizes", "ids", "rare"))
            ids, sizes = np.frombuffer(ids, "<i4").astype(np.int64), np.frombuffer(sizes, "<u4").astype(np.int64)
            n, g = np.zeros(len(rare)), np.full(len(rare), -1)
            j = right.column("j").to_numpy()
            n[j], g[j] = right.column("n").to_numpy(), right.column("g").to_numpy()
            for k in np.flatnonzero(g < 0):
                g[k] = classes.ending(rare[k])
            # known words first, then the other ones from the end on, as their numbers say
            n, g = np.concatenate([counts, n[::-1]]), np.concatenate([of, g[::-1]])
            logs, begin = np.log10(n + SMOOTHING), np.cumsum(sizes) - sizes
            each = lambda x: np.add.reduceat(x[ids], begin)
            codes = g[ids].astype(np.uint8).tobytes()
            blobs = [codes[a : a + s] for a, s in zip(begin.tolist(), sizes.tolist())]
            columns = (doc_ids, np.frombuffer(learn, bool), sizes, each((n > 0).astype(np.int64)), each(logs - base_below), each(logs - below[g]), blobs)
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
            parts.append(pa.table([pa.array(v, t) for v, t in zip(columns, types)], names=[x.split()[0] for x in SEQUENCE.split(", ")]))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())], names=[x.split()[0] for x in SEQUENCE.split(", ")])

    return texts.groupBy("chunk").cogroup(looked.groupBy("of")).applyInArrow(run, SEQUENCE)


def transitions(rows: DataFrame, c: int) -> np.ndarray:
    """log10 of the probability of each class after each class, from the rows of `sequences` that are learned from."""
    k = c + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for b in batches:
            g = np.frombuffer(bytes([c]) + b"".join(b.column("g").to_pylist()), np.uint8).astype(np.int64)
            total += np.bincount(g[:-1] * k + g[1:], minlength=k * k)
        code = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    pairs = summed(rows.where("learn").select("g").mapInArrow(run, "code bigint, n bigint"), k)
    return np.log10((pairs + SMOOTHING) / (pairs.sum(1, keepdims=True) + SMOOTHING * k))


SCORED = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of each row of `sequences`."""
    sent = rows.sparkSession.sparkContext.broadcast((model.transition, model.classes.c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, c = sent.value
        for b in batches:
            if b.num_rows:
                g = np.frombuffer(bytes([c]) + b"".join(b.column("g").to_pylist()), np.uint8)
                sizes = b.column("n_tokens").to_numpy()
                steps = np.add.reduceat(transition[g[:-1], g[1:]], np.cumsum(sizes) - sizes)
                own = [b.column(x) for x in ("doc_id", "n_tokens", "n_known", "base")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(b.column("emission").to_numpy() + steps)], names=[x.split()[0] for x in SCORED.split(", ")])

    return rows.mapInArrow(run, SCORED).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def modelled(docs: DataFrame, learn: Column) -> tuple[Model, DataFrame]:
    """The model learned from the rows of doc_id and text where `learn` holds, and `sequences` of all rows."""
    model, texts = clustered(docs.withColumn("learn", F.coalesce(learn, F.lit(False))))
    rows = written(sequences(texts, model), "sequences")
    removed(docs.sparkSession, texts)
    model.transition = transitions(rows, model.classes.c)
    return model, rows


def perplexity(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Trains on the documents whose crc32 of the id, modulo 5, isn't 1, and scores all of them.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.
    """
    model, rows = modelled(keyed_text(docs, key, text), remainder(F.col("doc_id")) != 1)
    found = scored(rows, model)
    return found.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
