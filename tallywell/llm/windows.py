"""Near-duplicate passages by compact windows.

A token is the 32-bit hash of five words in a row (words are runs of ASCII letters and figures and of non-ASCII characters; only
A-Z are lower-cased). Each of HASHES functions orders the tokens. In the Cartesian tree of a text by one of them, a node at c with
the span [l, r] says that every stretch with l <= start <= c <= end <= r has its min-hash at c: a compact window. Windows
narrower than TOKENS hold no passage that is long enough and are left out, which leaves some 2 n / TOKENS of them. They are
found for a batch of texts at once: only tokens that are the least of some TOKENS in a row can have a wide span, and the tree of
these alone has the same spans.

One function's windows meet too often: a common line holds the min-hash of many unlike passages. So the windows of two functions
that overlap in TOKENS tokens or more are joined inside their document: a joint window has both min-hashes and their distance
as its key, which only passages with both tokens in the same places share. All joint windows of a key, sorted by document
and place, are linked in a chain (first those of a batch, then the first of each batch), so g of them give g - 1 links, also
where one document holds many. Links are gathered by pair of documents, and the tokens around them are fetched and compared: of
all stretches of TOKENS tokens that hold the shared token, those count whose counterpart at the same shift has a similarity of
at least SIMILARITY (multiset Jaccard); where some have it by tokens that are equal in place, these. Stretches that overlap in a
document become one passage, and passages connected by links make a class.

A chain may put unlike texts between two copies. So wherever a link's sides aren't the same word for word, the stretches of TOKENS
tokens there are loose and are linked again, in two ways. By a hash of all their tokens: of the windows of a key that hold the
same stretch, each is linked with another one at it or is loose, so word-for-word repeats always meet, whatever stands between
them. And, where the two sides aren't alike either, by the min-hashes of three functions, and within the key: if any link of a key
parted unlike windows, all windows of it that aren't the same are held against each other, so near copies that share a key meet,
whatever stands between them. What is linked so is compared like the first. A near copy is found with a probability: at a similarity of s, a stretch shares one of the three joint keys with 1 - (1 - s^2)^3.

Defined results: texts that are null, empty or of fewer than WORDS words have no passages; each row is a document of its own,
also where ids repeat or are null; a passage that repeats within one document only is not reported; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.common import keyed_text, shared_checkpoint, written
from tallywell.llm.graph import connected_components

SHINGLE = 5
#: Least length of a passage in words, and so in tokens.
WORDS = 50
TOKENS = WORDS - SHINGLE + 1
SIMILARITY = 0.8
#: Common tokens of two stretches of TOKENS tokens with that similarity.
COMMON = int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * TOKENS - 1e-9))
HASHES = 6
#: Functions whose windows are joined, and those that link loose stretches of near copies.
PAIRS = ((0, 1), (2, 3), (4, 5))
TRIPLE = (1, 3, 5)
#: Characters of the texts that are worked on at once.
AT_ONCE = 4_000_000

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MULTIPLIERS = np.array([0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xC6A4A7935BD1E995, 0x9FB21C651E98DF25, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def range_hashes(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of each x[start:end], by prefix sums: their difference, divided by the power of its start."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(BASE, len(x)), dtype=np.uint64)])
    return mixed((sums[end] - sums[start]) * powers(INVERSE, len(x) + 1)[start] + (end - start).astype(np.uint64))


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, one after another, and where each text's begin (and the last one's end)."""
    coded = [t.encode() for t in texts]
    size = np.array([len(t) + 1 for t in coded], np.int64)
    begin = np.cumsum(size) - size
    raw = np.frombuffer(b"\n".join(coded).lower(), np.uint8)
    edge = np.flatnonzero(np.diff(WORD_BYTE[raw].view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    first = np.searchsorted(start, np.append(begin, len(raw) + 1))  # the first word of each text
    n = np.maximum(np.diff(first) - SHINGLE + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(n)])
    if not offsets[-1]:
        return np.empty(0, np.uint64), offsets
    words = range_hashes(raw.astype(np.uint64) + np.uint64(1), start, end)
    out = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x100000001B3) + words[k : k + len(out)]
    place = np.repeat(first[:-1] - offsets[:-1], n) + np.arange(offsets[-1])
    return mixed(out[place]) >> np.uint64(32), offsets


def sliding_least(x: np.ndarray, t: int) -> np.ndarray:
    """The least of each t in a row, from those of 2, 4, 8, ... in a row."""
    n, width = len(x) - t + 1, 1
    while 2 * width <= t:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[t - width :][:n])


def starts_of(offsets: np.ndarray, t: int = TOKENS) -> np.ndarray:
    """Where a stretch of t tokens within one text can begin."""
    n = np.maximum(np.diff(offsets) - t + 1, 0)
    return np.repeat(offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def least_places(ordered: np.ndarray, starts: np.ndarray, t: int = TOKENS) -> np.ndarray:
    """For each start the place of the least of the t values from there on, the first one of equals.

    The lowest bits of the hashes give way to their places.
    """
    if not len(starts):
        return starts
    bits = np.uint64(len(ordered).bit_length())
    own = ordered >> bits << bits | np.arange(len(ordered), dtype=np.uint64)
    return (sliding_least(own, t)[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def compact_windows(ordered: np.ndarray, offsets: np.ndarray, starts: np.ndarray, t: int = TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r (inclusive), by c, of the nodes of each text's Cartesian tree whose span has t tokens or more; of equal tokens the first is the least."""
    place = least_places(ordered, starts, t)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
    value, text = ordered[place], np.searchsorted(offsets, place, "right") - 1
    i = np.arange(len(place))
    first, end = np.searchsorted(text, text), np.searchsorted(text, text, "right")
    # parents to either side, by jumping: what lies between is larger, and so is what lies between that and its own neighbour
    left, right, open_ = i - 1, i + 1, i
    while len(open_ := open_[(left[open_] >= first[open_]) & (value[left[open_]] > value[open_])]):
        left[open_] = left[left[open_]]
    open_ = i
    while len(open_ := open_[right[open_] < end[open_]]) and len(open_ := open_[value[right[open_]] >= value[open_]]):
        right[open_] = right[right[open_]]
    l, r = offsets[text].copy(), offsets[text + 1] - 1
    inner, outer = left >= first, right < end
    l[inner], r[outer] = place[left[inner]] + 1, place[right[outer]] - 1
    wide = r - l + 1 >= t
    return l[wide], place[wide], r[wide]


def joint_windows(x: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of PAIRS the keys of its joint windows, and the places of the first function's min-hash."""
    return ((k, c) for k, c, _ in joint_starts(x, offsets))


def joint_starts(x: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Joint windows, and the first start of each: its stretches begin there and up to the next one's.

    The stretches of TOKENS tokens that begin at max(l, c - TOKENS + 1) and up to the next window's such start have their
    min-hash at c. So the windows of a function deal out all starts, and those of two are joined by merging their starts.
    """
    starts, made = starts_of(offsets), []
    for f in range(HASHES):
        ordered = mixed(x * MULTIPLIERS[f])
        left, c, _ = compact_windows(ordered, offsets, starts)
        made.append((np.maximum(left, c - TOKENS + 1), c, ordered[c]))
    for f, g in PAIRS:
        (first, c, own), (first2, c2, own2) = made[f], made[g]
        at = np.union1d(first, first2)
        i, j = np.searchsorted(first, at, "right") - 1, np.searchsorted(first2, at, "right") - 1
        gap = (c2[j] - c[i]).view(np.uint64)
        yield mixed(own[i] * MULTIPLIERS[f] + mixed(own2[j] + gap)).view(np.int64), c[i], at


#: A window: its key, document and place. Links of two documents: `at` has their places, pairs of int32; k only deals
#: them to tasks, so that no task gets all links of a key.
ROW = "k bigint, doc bigint, c int, doc2 bigint, at binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]


def batches_of(texts: list[str | None], most: int = AT_ONCE) -> Iterator[slice]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= most):
            size += len(texts[end] or "")
            end += 1
        yield slice(at, end)
        at = end


def batch_windows(keys: list[int], texts: list[str]) -> np.ndarray:
    """Columns k, doc, c of all joint windows of a batch."""
    x, offsets = tokens_of(texts)
    found: list[list[np.ndarray]] = [[], [], []]
    if len(starts_of(offsets)):
        for k, c in joint_windows(x, offsets):
            text = np.searchsorted(offsets, c, "right") - 1
            for column, v in zip(found, (k, np.array(keys, np.int64)[text], c - offsets[text])):
                column.append(v)
    return np.array([np.concatenate(v) if v else np.empty(0, np.int64) for v in found])


def linked(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each key, to be handed on, and links (doc, c, doc2, c2) of those that follow each other in it."""
    w = w[:, np.lexsort((w[2], w[1], w[0]))]
    same = w[0, 1:] == w[0, :-1]
    links = np.concatenate([w[1:, :-1][:, same], w[1:, 1:][:, same]])
    links = links[:, (links[0] != links[2]) | (links[1] != links[3])]
    return w[:, np.concatenate([[True], ~same])[: w.shape[1]]], links


def as_batch(first: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    """Windows as they are, and one row for each pair of documents with links."""
    links = links[:, np.lexsort((links[1], links[2], links[0]))]
    doc, c, doc2, c2 = links
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (doc2[1:] != doc2[:-1])])) if len(doc) else np.empty(0, np.int64)
    packed = np.stack([c, c2], 1).astype("<i4").tobytes()
    at = [packed[8 * a : 8 * b] for a, b in zip(new.tolist(), [*new[1:].tolist(), len(doc)])]
    doc, doc2 = doc[new], doc2[new]
    spread = mixed(doc.view(np.uint64) * np.uint64(31) + doc2.view(np.uint64)).view(np.int64)
    n, m = first.shape[1], len(new)
    gap, is_link = np.zeros(n, np.int64), np.arange(n + m) >= n
    columns = [np.concatenate([first[0], spread]), np.concatenate([first[1], doc]), np.concatenate([first[2], np.zeros(m, np.int64)]), np.concatenate([gap, doc2])]
    masks = [None, None, is_link, ~is_link]
    return pa.RecordBatch.from_arrays([*(pa.array(x, t, mask=k) for x, t, k in zip(columns, TYPES, masks)), pa.array([None] * n + at, TYPES[4])], names=NAMES)


def window_links(docs: DataFrame) -> DataFrame:
    """doc <= doc2 and `at`, places of joint windows that share a key. `docs`: doc and text.

    A batch links its own windows first and hands on one of each key, so a key has one row for each batch at most, however many
    documents hold it.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column("doc").to_pylist(), b.column("text").to_pylist()
            for part in batches_of(texts):
                w = batch_windows(keys[part], texts[part])
                if w.shape[1]:
                    yield as_batch(*linked(w))

    return met(docs.mapInArrow(local, ROW))


def met(made: DataFrame) -> DataFrame:
    """Links of `made` (windows handed on and links, as_batch) and those between what was handed on: one row for each pair."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.empty((3, 0), np.int64)
        for b in batches:
            is_link = b.column("doc2").is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(is_link))
            rows = b.filter(pa.array(~is_link))
            w = np.concatenate([last, np.array([rows.column(i).to_numpy() for i in range(3)], np.int64)], axis=1)
            if w.shape[1]:
                yield as_batch(w[:, :0], linked(w)[1])
                last = w[:, -1:]

    dealt = made.repartition("k").sortWithinPartitions("k", "doc", "c").mapInArrow(across, ROW)
    return dealt.where("doc2 is not null").groupBy("doc", "doc2").agg(F.listagg("at").alias("at"))


AROUND = np.arange(1 - TOKENS, TOKENS)
#: Bits of a mark of all tokens around a place.
BITS = 2048


def coded(tokens: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The bit of each token; BITS for those that aren't inside."""
    return np.where(inside, tokens & np.asarray(BITS - 1, tokens.dtype), np.asarray(BITS, tokens.dtype)).astype(np.int16)


def marked(code: np.ndarray) -> np.ndarray:
    """For each row which bits its tokens have; the last column is for none."""
    out = np.zeros((len(code), BITS + 1), bool)
    out[np.arange(len(code))[:, None], code] = True
    out[:, BITS] = False
    return out


def promising(code: np.ndarray, bits: np.ndarray, row: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Rows with a stretch of which COMMON tokens may be in the marks bits[row]: no row that `alike` would take is missing."""
    runs = np.zeros((len(code), len(AROUND) + 1), np.int8)
    np.cumsum(bits[row[:, None], code], axis=1, dtype=np.int8, out=runs[:, 1:])
    return ((runs[:, TOKENS:] - runs[:, :-TOKENS] >= COMMON) & whole).any(1)


def numbered(x: np.ndarray) -> np.ndarray:
    """Each row sorted; the first, second, ... time that it has a token are different ones."""
    x, i = np.sort(x, axis=1).astype(np.uint64), np.arange(x.shape[1])
    first = np.maximum.accumulate(np.where(np.pad(x[:, 1:] != x[:, :-1], ((0, 0), (1, 0))), i, 0), axis=1)
    return x << np.uint64(8) | (i - first).astype(np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of TOKENS tokens whose multisets have COMMON in common: a Jaccard similarity of at least SIMILARITY."""
    both = np.sort(np.hstack([numbered(a), numbered(b)]), axis=1)
    return (both[:, 1:] == both[:, :-1]).sum(1) >= COMMON


def alike(a: np.ndarray, b: np.ndarray, inside: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which of the TOKENS stretches of each row's surroundings a have a like counterpart at the same place in b.

    `whole` has the stretches that are within both texts, `inside` the tokens.

    A token that is equal at p in a and at q in b is in both stretches from s where s lies between max(p, q) - TOKENS + 1 and
    min(p, q). Counted for all pairs this is the number of common tokens, or more where a token repeats: these are counted anew.
    """
    out = np.zeros((len(a), TOKENS), bool)
    a, b = a.astype(np.uint32), b.astype(np.uint32)
    for at in range(0, len(a), 256):
        part = slice(at, at + 256)
        row, p, q = np.nonzero((a[part, :, None] == b[part, None, :]) & inside[part, :, None] & inside[part, None, :])
        low, high = np.maximum(np.maximum(p, q) - TOKENS + 1, 0), np.minimum(np.minimum(p, q), TOKENS - 1)
        some, n = low <= high, len(a[part])
        marks = np.bincount(row[some] * (TOKENS + 1) + low[some], minlength=n * (TOKENS + 1)) - np.bincount(row[some] * (TOKENS + 1) + high[some] + 1, minlength=n * (TOKENS + 1))
        good = (np.cumsum(marks.reshape(n, TOKENS + 1), axis=1)[:, :TOKENS] >= COMMON) & whole[part]
        code = row * len(AROUND)
        twice = (np.bincount(code + p, minlength=n * len(AROUND)) > 1).reshape(n, -1).any(1) | (np.bincount(code + q, minlength=n * len(AROUND)) > 1).reshape(n, -1).any(1)
        r, s = np.nonzero(good & twice[:, None])
        if len(r):
            place = s[:, None] + np.arange(TOKENS)
            good[r, s] = similar(a[part][r[:, None], place], b[part][r[:, None], place])
        out[part] = good
    return out


def compared(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, bounds: np.ndarray, bounds2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For links of x[i] and y[j] (their texts within the bounds): first and last start (exclusive), relative to i, of the
    stretches of TOKENS tokens that are alike, and the same of those that are equal word for word; equal numbers for none."""
    found = [np.zeros(len(i), np.int64) for _ in range(4)]
    for at in range(0, len(i), 4096):
        part = slice(at, at + 4096)
        p, q = i[part, None] + AROUND, j[part, None] + AROUND
        inside = (p >= bounds[0, part, None]) & (p < bounds[1, part, None]) & (q >= bounds2[0, part, None]) & (q < bounds2[1, part, None])
        a, b = x[np.clip(p, 0, len(x) - 1)], y[np.clip(q, 0, len(y) - 1)]
        equal = inside & (a == b)
        stop = np.ones((len(p), 1), bool)
        left = np.argmax(np.hstack([~equal[:, TOKENS - 1 :: -1], stop]), axis=1)  # equal tokens up to i, and from i on
        right = np.argmax(np.hstack([~equal[:, TOKENS - 1 :], stop]), axis=1)
        first, end = 1 - left, right - TOKENS + 1
        exact = (left + right - 1 >= TOKENS) & (left > 0)
        found[2][part], found[3][part] = np.where(exact, first, 0), np.where(exact, end, 0)
        runs = np.cumsum(np.pad(equal, ((0, 0), (1, 0))), axis=1)
        start = AROUND[:TOKENS]
        low, high = np.maximum(bounds[0, part] - i[part], bounds2[0, part] - j[part]), np.minimum(bounds[1, part] - i[part], bounds2[1, part] - j[part])
        whole = (start >= low[:, None]) & (start + TOKENS <= high[:, None])
        good = (runs[:, TOKENS:] - runs[:, :-TOKENS] >= COMMON) & whole
        open_ = np.flatnonzero(~good.any(1))
        if len(open_):
            bits = marked(coded(b[open_], inside[open_]))
            open_ = open_[promising(coded(a[open_], inside[open_]), bits, np.arange(len(open_)), whole[open_])]
        if len(open_):
            good[open_] = alike(a[open_], b[open_], inside[open_], whole[open_])
        some = good.any(1)
        found[0][part] = np.where(some, np.argmax(good, axis=1) - TOKENS + 1, 0)
        found[1][part] = np.where(some, 1 - np.argmax(good[:, ::-1], axis=1), 0)
    return tuple(found)


def joined(row: np.ndarray, a: np.ndarray, b: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of a row at one shift that overlap, as one: row, a, b, shift."""
    if not len(row):
        return row, a, b, shift
    order = np.lexsort((a, shift, row))
    row, a, b, shift = row[order], a[order], b[order], shift[order]
    group = np.cumsum(np.concatenate([[True], (row[1:] != row[:-1]) | (shift[1:] != shift[:-1])])).astype(np.int64) << 40
    reach = np.maximum.accumulate(group + b)
    first = np.concatenate([[True], group[1:] + a[1:] > reach[:-1]])
    at = np.flatnonzero(first)
    return row[at], a[at], np.maximum.reduceat(b, at), shift[at]


PART = "doc bigint, doc2 bigint, at binary, places binary, x binary"
LINK = "doc bigint, a int, b int, doc2 bigint, a2 int, b2 int, loose binary, held binary, apart binary"
LINK_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
LINK_NAMES = [v.split()[0] for v in LINK.split(", ")]


def segments(at: np.ndarray, n: int) -> np.ndarray:
    """First token and end of the stretches around the places `at`, within n tokens, overlapping ones joined."""
    c = np.unique(at)
    a, b = np.maximum(c - TOKENS + 1, 0), np.minimum(c + TOKENS, n)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return np.stack([a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]], 1)


def links_of(b: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
    """Of the lists `links` of a batch's rows: the row of each link, and the links' columns."""
    lists = b.column("links")
    return np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().flatten()


def with_tokens(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs with the tokens around the first document's places: `places` has the first token and end of each stretch.

    A document's pairs are gathered before its text is joined, so that each text is sent and split once. Chains give a document a few links
    for each of its windows, so what is gathered grows with its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").to_pylist()
            for part in batches_of(text):
                rows = b.slice(part.start, part.stop - part.start)
                of, (doc2, at) = links_of(rows)
                x, offsets = tokens_of(text[part])
                x = x.astype("<u4")
                places, own = [], []
                for k, links in zip(of.tolist(), at.to_pylist()):
                    begin, n = int(offsets[k]), int(offsets[k + 1] - offsets[k])
                    s = segments(np.frombuffer(links, "<i4")[::2].astype(np.int64), n)
                    places.append(s.astype("<i4").tobytes())
                    own.append(b"".join([x[begin + u : begin + v].tobytes() for u, v in s.tolist()]))
                yield pa.RecordBatch.from_arrays([rows.column("doc").take(pa.array(of)), doc2, at, pa.array(places, pa.binary()), pa.array(own, pa.binary())], names=[c.split()[0] for c in PART.split(", ")])

    gathered = pairs.groupBy("doc").agg(F.collect_list(F.struct("doc2", "at")).alias("links"))
    return gathered.join(docs, "doc").mapInArrow(run, PART)


def loose_keys(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all TOKENS tokens from each start on, and those of three functions' min-hashes."""
    whole = range_hashes(x, starts, starts + TOKENS)
    some = np.zeros(len(starts), np.uint64)
    for f in TRIPLE:
        ordered = mixed(x * MULTIPLIERS[f])
        some = mixed(some * MULTIPLIERS[f] + ordered[least_places(ordered, starts)])
    return whole.view(np.int64), some.view(np.int64)


def verified(pairs: DataFrame, docs: DataFrame, again: bool = True) -> DataFrame:
    """doc, a, b, doc2, a2, b2: token stretches that are near duplicates; if they are to be linked again, also rows of doc and
    `loose`: hashes of all tokens, of min-hashes, and starts that are loose. `pairs`: links of window_links."""
    gathered = with_tokens(pairs, docs).groupBy("doc2").agg(F.collect_list(F.struct("doc", "at", "places", "x")).alias("links"))
    both = gathered.join(docs.withColumnRenamed("doc", "doc2"), "doc2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").to_pylist()
            for part in batches_of(text):
                rows = b.slice(part.start, part.stop - part.start)
                of, (doc, at, places, x) = links_of(rows)
                own = pa.RecordBatch.from_arrays([doc, rows.column("doc2").take(pa.array(of)), at, places, x], names=["doc", "doc2", "at", "places", "x"])
                texts = text[part]
                yield from checked(own, [texts[k] for k in of.tolist()], again)

    return both.mapInArrow(run, LINK)


def checked(rows: pa.RecordBatch, text: list[str], again: bool) -> Iterator[pa.RecordBatch]:
    doc, doc2 = rows.column("doc").to_numpy(), rows.column("doc2").to_numpy()
    at = [np.frombuffer(v, "<i4").reshape(-1, 2) for v in rows.column("at").to_pylist()]
    places = [np.frombuffer(v, "<i4").reshape(-1, 2) for v in rows.column("places").to_pylist()]
    _, first, of = np.unique(doc2, return_index=True, return_inverse=True)
    y, offsets = tokens_of([text[k] for k in first.tolist()])
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), "<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(at)), [len(v) for v in at])
    segment_row = np.repeat(np.arange(len(places)), [len(v) for v in places])
    c, c2 = np.concatenate(at).T.astype(np.int64)
    low, high = np.concatenate(places).T.astype(np.int64)
    begin = np.cumsum(high - low) - (high - low)  # where the segments are in x
    # segments are by row and place, so a link's is the last one that begins no later
    k = np.searchsorted((segment_row << 40) + low, (row << 40) + c, "right") - 1
    i, j = begin[k] + c - low[k], offsets[of[row]] + c2
    bounds, bounds2 = np.stack([begin[k], begin[k] + high[k] - low[k]]), np.stack([offsets[of[row]], offsets[of[row] + 1]])
    a, e, same, same_end = compared(x, y, i, j, bounds, bounds2)
    some = e > a
    r, s, t, shift = joined(row[some], (c + a)[some], (c + e)[some] + TOKENS - 1, (c2 - c)[some])
    if len(r):
        columns = (doc[r], s, t, doc2[r], s + shift, t + shift, *[[None] * len(r)] * 3)
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, LINK_TYPES)], names=LINK_NAMES)
    if not again:
        return
    # loose: starts whose first function's min-hash is at the link but which aren't equal to the other side; apart: not alike either
    ends = np.append(begin, len(x))
    for z, edges, own, to_doc, to_place in ((x, ends, i, doc[segment_row], low - begin), (y, offsets, j, doc2[first], -offsets[:-1])):
        starts = starts_of(edges)
        if not len(starts):
            continue
        none = same_end <= same
        stop, go = np.searchsorted(starts, own + same), np.searchsorted(starts, own + same_end)
        held, parted = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
        for f, _ in PAIRS:
            place = least_places(mixed(z * MULTIPLIERS[f]), starts)
            p, q = np.searchsorted(place, own), np.searchsorted(place, own, "right")
            covered = covering(len(starts), (p, np.where(none, q, np.minimum(q, stop))), (np.where(none, q, np.maximum(p, go)), q))
            apart = covering(len(starts), (p[~some], q[~some]))
            held |= covered
            parted |= apart
            if f == PAIRS[0][0] and covered.any():
                yield loose_rows(z, edges, starts[covered], apart[covered], to_doc, to_place)
        if held.any():
            yield held_rows(z, edges, starts[held], parted[held], to_doc, to_place)


def covering(n: int, *ranges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of n places are in any of the ranges (ends exclusive)."""
    marks = np.zeros(n + 1, np.int64)
    for u, v in ranges:
        open_ = u < v
        marks += np.bincount(u[open_], minlength=n + 1) - np.bincount(v[open_], minlength=n + 1)
    return np.cumsum(marks[:-1]) > 0


def loose_rows(z: np.ndarray, edges: np.ndarray, own: np.ndarray, apart: np.ndarray, to_doc: np.ndarray, to_place: np.ndarray) -> pa.RecordBatch:
    """Key 0 stands for no key: what is like the other side needs no second link by min-hashes."""
    whole, some = loose_keys(z, own)
    some = np.where(apart, some, 0)
    segment = np.searchsorted(edges, own, "right") - 1
    doc, place = to_doc[segment], own + to_place[segment]
    order = np.lexsort((place, doc))
    doc, place, whole, some = doc[order], place[order], whole[order], some[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])])
    doc, place, whole, some = doc[new], place[new], whole[new], some[new]
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    packed = np.stack([whole, some, place], 1).astype("<i8").tobytes()
    blobs = [packed[24 * u : 24 * v] for u, v in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)])]
    nothing = [None] * len(cut)
    columns = (doc[cut], *[nothing] * 5, blobs, nothing, nothing)
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, LINK_TYPES)], names=LINK_NAMES)


def held_rows(z: np.ndarray, edges: np.ndarray, own: np.ndarray, apart: np.ndarray, to_doc: np.ndarray, to_place: np.ndarray) -> pa.RecordBatch:
    """A row for each run of starts: the first one's place (a), the tokens of all their stretches, and which of them are apart."""
    segment = np.searchsorted(edges, own, "right") - 1
    cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1] + 1) | (segment[1:] != segment[:-1])]))
    end = np.append(cut[1:], len(own))
    data, flags = z.astype("<u4"), apart.astype(np.uint8).tobytes()
    tokens = [data[u:v].tobytes() for u, v in zip(own[cut].tolist(), (own[end - 1] + TOKENS).tolist())]
    nothing = [None] * len(cut)
    columns = (to_doc[segment[cut]], own[cut] + to_place[segment[cut]], *[nothing] * 5, tokens, [flags[u:v] for u, v in zip(cut.tolist(), end.tolist())])
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, LINK_TYPES)], names=LINK_NAMES)


#: A joint window that may be held against all others of its key: the run it is in, its first start and end there, a hash of all this, and whether a link parted it.
HELD = "k bigint, content bigint, doc bigint, a int, size int, at int, stop int, c int, apart boolean"
HELD_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
HELD_NAMES = [v.split()[0] for v in HELD.split(", ")]
#: Windows of a block of one key, of which a task holds two at once; up to how many all pairs are
#: compared as they are; and how many of a stretch's tokens tell which others it may be like.
BLOCK, FEW = 1024, 12
RAREST = 24


def held_windows(made: DataFrame) -> DataFrame:
    """Joint windows of the runs of held_rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc, first = b.column("doc").to_numpy(), b.column("a").to_numpy()
            blobs, flags = b.column("held").to_pylist(), b.column("apart").to_pylist()
            x = np.frombuffer(b"".join(blobs), "<u4").astype(np.uint64)
            offsets = np.concatenate([[0], np.cumsum([len(v) // 4 for v in blobs])])
            marks = np.zeros(len(x) + 1, np.int64)
            marks[starts_of(offsets) + 1] = np.frombuffer(b"".join(flags), np.uint8)
            parted = np.cumsum(marks)
            found = [np.stack([k, c, at]) for k, c, at in joint_starts(x, offsets)]
            text = [np.searchsorted(offsets, at, "right") - 1 for _, _, at in found]
            stop = np.concatenate([np.minimum(np.append(at[1:], len(x)), offsets[t + 1] - TOKENS + 1) for (_, _, at), t in zip(found, text)])
            (k, c, at), text = np.concatenate(found, axis=1), np.concatenate(text)
            apart, end = parted[stop] > parted[at], stop + TOKENS - 1
            content = range_hashes(x, at, end) + (c - at).astype(np.uint64)
            order = np.lexsort((content, k))
            new = np.concatenate([[True], (k[order][1:] != k[order][:-1]) | (content[order][1:] != content[order][:-1])])
            apart, order = np.logical_or.reduceat(apart[order], np.flatnonzero(new)), order[new]
            text, begin = text[order], offsets[text[order]]
            columns = (k[order], content[order].view(np.int64), doc[text], first[text], np.diff(offsets)[text], at[order] - begin, end[order] - begin, c[order] - begin, apart)
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, HELD_TYPES)], names=HELD_NAMES)

    return made.where("held is not null").select("doc", "a", "held", "apart").mapInArrow(run, HELD)


#: A window dealt to a block of its key, with the tokens of its stretches and where in them c is; its tree (`root`) among those of
#: the block. Links of two documents have doc, doc2 and `links` only.
BLOCKED = "k bigint, i int, blocks int, doc bigint, c int, at int, w binary, root int, doc2 bigint, links binary"
BLOCKED_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.binary())
BLOCKED_NAMES = [v.split()[0] for v in BLOCKED.split(", ")]
ASKED = BLOCKED.partition(", root")[0]


def with_stretches(windows: DataFrame, made: DataFrame) -> DataFrame:
    """Windows (k, i, blocks and what HELD has) with the tokens of their stretches, and where in them c is. A run's windows are gathered before its tokens are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, (k, i, blocks, at, stop, c) = links_of(b)
            blobs, first = b.column("held").to_pylist(), b.column("a").to_numpy()
            u, v = at.to_numpy(), stop.to_numpy()
            w = [blobs[r][4 * p : 4 * q] for r, p, q in zip(of.tolist(), u.tolist(), v.tolist())]
            columns = (k, i, blocks, b.column("doc").take(pa.array(of)), pa.array(first[of] + c.to_numpy(), pa.int32()), pa.array(c.to_numpy() - u, pa.int32()), pa.array(w, pa.binary()))
            yield pa.RecordBatch.from_arrays(list(columns), names=BLOCKED_NAMES[:7])

    own = ["doc", "a", "size"]
    gathered = windows.groupBy(*own).agg(F.collect_list(F.struct("k", "i", "blocks", "at", "stop", "c")).alias("links"))
    runs = made.where("held is not null").select("doc", "a", (F.length("held") / 4).cast("int").alias("size"), "held").dropDuplicates(own)
    return gathered.join(runs, own).select("doc", "a", "links", "held").mapInArrow(run, ASKED)


def parted_links(made: DataFrame) -> DataFrame:
    """doc, doc2 and `at`: places of windows of one key that are alike, wherever a chain put unlike ones between them.

    If all links of a key's chain are alike, all its windows are connected. Else each is held against all others of the key: of many,
    only those that have enough tokens in common, and not those that are connected already. The links are a forest, so a key has
    fewer of them than windows. A key with more than BLOCK windows is dealt out: the forests of its blocks first, then pairs of
    blocks, which give only links that join the trees of these. Of windows with the same tokens one is enough: the links of whole
    stretches connect them.
    """
    one = F.min(F.struct("doc", "a", "size", "at", "stop", "c")).alias("one")
    rows = shared_checkpoint(held_windows(made).groupBy("k", "content").agg(one, F.max("apart").alias("apart")))
    keys = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("apart").alias("apart")).where("apart and n > 1")
    keys = keys.select("k", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.drop("apart").join(keys, "k").select("k", F.pmod("content", "blocks").cast("int").alias("i"), "blocks", "one.*")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["k", "i"]):
            yield from block_forests(rows)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["k", "i", "j"]):
            yield from block_links(rows)

    own = shared_checkpoint(with_stretches(dealt, made).repartition("k", "i").sortWithinPartitions("k", "i", "doc", "c").mapInArrow(within, BLOCKED))
    pairs = own.where("w is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> i")
    pairs = pairs.select("k", F.least("i", "other").alias("i"), F.greatest("i", "other").alias("j"), (F.col("i") > F.col("other")).alias("second"), "doc", "c", "at", "w", "root")
    found = pairs.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "second", "doc", "c").mapInArrow(across, ROW)
    links = own.where("doc2 is not null").select("doc", "doc2", F.col("links").alias("at")).union(found.select("doc", "doc2", "at"))
    return links.groupBy("doc", "doc2").agg(F.listagg("at").alias("at"))


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows, sorted by some columns, in tables of whole groups."""
    held: list[pa.RecordBatch] = []  # of the last group, which may go on
    for b in batches:
        if b.num_rows:
            rows = pa.Table.from_batches([*held, b])
            key = np.stack([rows.column(c).to_numpy() for c in by])
            last = np.flatnonzero((key != key[:, -1:]).any(0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def firsts(rows: pa.Table, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where each group begins, and how many rows it has."""
    key = np.stack([rows.column(c).to_numpy() for c in by])
    first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
    return first, np.diff(np.append(first, rows.num_rows))


def comparer(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """The windows' tokens, where each one's begin and end, and a function that says which pairs of windows have alike stretches."""
    blobs, at = rows.column("w").to_pylist(), rows.column("at").to_numpy().astype(np.int64)
    x = np.frombuffer(b"".join(blobs), "<u4").astype(np.uint64)
    end = np.cumsum([len(v) // 4 for v in blobs])
    begin = np.append(0, end[:-1])
    i = begin + at
    around = i[:, None] + AROUND
    code = coded(x[np.clip(around, 0, len(x) - 1)], (around >= begin[:, None]) & (around < end[:, None]))
    bits, low, high = marked(code), begin - i, end - i

    def alike_pairs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), bool)
        for u in range(0, len(p), 4096):
            p_, q_ = p[u : u + 4096], q[u : u + 4096]
            start, last = np.maximum(low[p_], low[q_])[:, None], np.minimum(high[p_], high[q_])[:, None]
            some = np.flatnonzero(promising(code[p_], bits, q_, (AROUND[:TOKENS] >= start) & (AROUND[:TOKENS] + TOKENS <= last)))
            p_, q_ = p_[some], q_[some]
            a, e, _, _ = compared(x, x, i[p_], i[q_], np.stack([begin[p_], end[p_]]), np.stack([begin[q_], end[q_]]))
            out[u + some] = e > a
        return out

    return x, begin, end, alike_pairs


def joining(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Those of the links p, q that join two trees; `root` has each one's root, also afterwards."""
    of, new = root.tolist(), np.zeros(len(p), bool)
    for n, (u, v) in enumerate(zip(p.tolist(), q.tolist())):
        while of[u] != u:
            of[u] = u = of[of[u]]
        while of[v] != v:
            of[v] = v = of[of[v]]
        if u != v:
            of[max(u, v)] = min(u, v)
            new[n] = True
    root[:] = of
    while (root[root] != root).any():
        root[:] = root[root]
    return np.stack([p[new], q[new]])


def pair_links(rows: pa.Table, links: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Links of rows, one row for each pair of documents."""
    doc, c = (rows.column(v).to_numpy().astype(np.int64) for v in ("doc", "c"))
    p, q = np.concatenate(links, axis=1) if links else np.empty((2, 0), np.int64)
    p, q = np.where(doc[p] <= doc[q], p, q), np.where(doc[p] <= doc[q], q, p)
    if len(p):
        yield as_batch(np.empty((3, 0), np.int64), np.stack([doc[p], c[p], doc[q], c[q]]))


def block_forests(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links that connect what is alike in each block (k, i), and, of keys with several blocks, the windows with their trees."""
    x, begin, end, alike_pairs = comparer(rows)
    first, size = firsts(rows, ["k", "i"])
    group, few = np.repeat(first, size), np.repeat(size <= FEW, size)
    root, links = np.arange(rows.num_rows), []
    for d in range(1, FEW):
        p = np.flatnonzero((group[d:] == group[:-d]) & few[d:])
        if not len(p):
            break
        p = p[root[p] != root[p + d]]
        good = p[alike_pairs(p, p + d)]
        links.append(joining(root, good, good + d))
    for at, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist()):
        own = np.arange(n)
        links += many_windows(x, begin[at : at + n], end[at : at + n], at, alike_pairs, own)
        root[at : at + n] = own + at
    for b in pair_links(rows, links):
        n, none = b.num_rows, [None] * b.num_rows
        columns = (none, none, none, b.column("doc"), none, none, none, none, b.column("doc2"), b.column("at"))
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, BLOCKED_TYPES)], names=BLOCKED_NAMES)
    more = rows.column("blocks").to_numpy() > 1
    if more.any():
        kept = rows.filter(pa.array(more)).append_column("root", pa.array(root[more] - group[more], pa.int32()))
        none = pa.nulls(kept.num_rows)
        kept = kept.append_column("doc2", none.cast(pa.int64())).append_column("links", none.cast(pa.binary()))
        yield from kept.combine_chunks().select(BLOCKED_NAMES).to_batches()


def block_links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links between the two blocks of each group (k, i, j) that join trees of these."""
    x, begin, end, alike_pairs = comparer(rows)
    tree, second = rows.column("root").to_numpy().astype(np.int64), rows.column("second").to_numpy()
    links = []
    for at, n in zip(*(v.tolist() for v in firsts(rows, ["k", "i", "j"]))):
        own = slice(at, at + n)
        half = int(np.searchsorted(second[own], True))
        if 0 < half < n:
            _, one, of = np.unique(2 * tree[own] + second[own], return_index=True, return_inverse=True)
            links += many_windows(x, begin[own], end[own], at, alike_pairs, one[of], half)
    yield from pair_links(rows, links)


def products(code: np.ndarray, count: np.ndarray, n: int, half: int = 0) -> np.ndarray:
    """For each two of n rows the sum of the products of their counts, or for each of the first half and each other one; code: column * n + row, each once."""
    out = np.zeros((half, n - half) if half else (n, n), np.float32)
    _, column, holders = np.unique(code // n, return_inverse=True, return_counts=True)
    shared = holders[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    row, count = code[shared] % n, count[shared]
    order = np.argsort(column, kind="stable")
    column, row, count = column[order], row[order], count[order]
    last = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, last, 4096):
        own = slice(*np.searchsorted(column, (at, at + 4096)))
        part = np.zeros((n, min(4096, last - at)), np.float32)
        part[row[own], column[own] - at] = count[own]
        out += part[:half] @ part[half:].T if half else part @ part.T
    return out


def many_windows(x: np.ndarray, begin: np.ndarray, end: np.ndarray, offset: int, alike_pairs: Callable[[np.ndarray, np.ndarray], np.ndarray], root: np.ndarray | None = None, half: int = 0) -> list[np.ndarray]:
    """Links that connect what is alike among the windows of one group: of all pairs that share enough of the RAREST tokens of a
    stretch, those that aren't connected by then. Alike stretches have all but TOKENS - COMMON of these in common, in whatever order tokens are ranked.

    `root` has the roots of windows that are connected already, and gets those of all; of pairs, only those of one of the first `half` and another one are looked at, if it is given.
    """
    n, size = len(begin), end - begin
    row = np.repeat(np.arange(n), size)
    token = x[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    _, token = np.unique(token, return_inverse=True)
    holders = np.bincount(np.unique(token * n + row) // n)
    rank = np.empty(len(holders), np.int64)
    rank[np.argsort(holders, kind="stable")] = np.arange(len(holders))
    ranked, starts = rank[token], starts_of(np.append(0, np.cumsum(size)))
    least = [np.partition(ranked[starts[u : u + 8192, None] + np.arange(TOKENS)], RAREST - 1, axis=1)[:, :RAREST] for u in range(0, len(starts), 8192)]
    # the first, second, ... time that a stretch has a token are different ones
    least = np.sort(np.concatenate(least), axis=1)
    again = np.zeros(least.shape, np.int64)
    for j in range(1, RAREST):
        again[:, j] = np.where(least[:, j] == least[:, j - 1], again[:, j - 1] + 1, 0)
    rare = np.unique((least * RAREST + again) * n + row[starts][:, None])
    enough = products(rare, np.ones(len(rare)), n, half)
    root = np.arange(n) if root is None else root
    enough = enough if half else np.triu(enough, 1)
    p, q = np.nonzero(enough >= RAREST - TOKENS + COMMON)
    # each window's nearest one before it first: most trees are whole after that
    nearest = np.zeros(enough.shape, bool)
    nearest[np.argmax(enough, axis=0), np.arange(enough.shape[1])] = True
    order = np.lexsort((-enough[p, q], ~nearest[p, q]))
    now, links = int(nearest[p, q].sum()), []
    p, q = p[order], q[order] + half
    while len(p):
        good = alike_pairs(p[:now] + offset, q[:now] + offset)
        links.append(joining(root, p[:now][good], q[:now][good]) + offset)
        p, q, now = p[now:], q[now:], max(n // 4, 64) if len(links) == 1 else 2 * now
        open_ = root[p] != root[q]
        p, q = p[open_], q[open_]
    return links


def loose_links(loose: DataFrame, which: int) -> DataFrame:
    """doc, doc2 and `at`: starts of loose stretches with the same hash (of all tokens: 0, of min-hashes: 1)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, at = b.column("doc").to_pylist(), [np.frombuffer(v, "<i8").reshape(-1, 3) for v in b.column("loose").to_pylist()]
            if docs:
                own, doc = np.concatenate(at), np.repeat(np.array(docs, np.int64), [len(v) for v in at])
                if which:  # of starts in a row with the same key one is enough
                    own, doc = own[own[:, 1] != 0], doc[own[:, 1] != 0]
                    own, doc = (v[np.concatenate([[True], (own[1:, 1] != own[:-1, 1]) | (doc[1:] != doc[:-1])])[: len(doc)]] for v in (own, doc))
                yield as_batch(*linked(np.stack([own[:, which], doc, own[:, 2]])))

    return met(loose.select("doc", "loose").mapInArrow(local, ROW))


def exact_stretches(links: DataFrame) -> DataFrame:
    """Links of equal stretches of TOKENS tokens, joined where they follow each other at one shift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, doc2 = b.column("doc").to_numpy(), b.column("doc2").to_numpy()
            at = [np.frombuffer(v, "<i4").reshape(-1, 2) for v in b.column("at").to_pylist()]
            if at:
                row = np.repeat(np.arange(len(at)), [len(v) for v in at])
                s, s2 = np.concatenate(at).T.astype(np.int64)
                r, s, t, shift = joined(row, s, s + TOKENS, s2 - s)
                columns = (doc[r], s, t, doc2[r], s + shift, t + shift)
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, LINK_TYPES)], names=LINK_NAMES[:6])

    return links.mapInArrow(run, LINK.partition(", loose")[0])


def all_links(docs: DataFrame) -> DataFrame:
    """doc, a, b, doc2, a2, b2 of all verified links of docs (doc and text)."""
    made = shared_checkpoint(verified(shared_checkpoint(window_links(docs)), docs))
    loose, sides = made.where("loose is not null"), ["doc", "a", "b", "doc2", "a2", "b2"]
    near = shared_checkpoint(verified(shared_checkpoint(loose_links(loose, 1).union(parted_links(made))), docs, False))
    # what the second links leave loose was loose before, so the links by all tokens cover it
    links = made.where("doc2 is not null").select(*sides).union(near.select(*sides))
    return shared_checkpoint(links.union(exact_stretches(loose_links(loose, 0))))


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, first_word, last_word (exclusive), class_id and documents: each passage that other documents hold too.

    class_id is the same for passages that are connected by links (a hash, the same in every run); documents says how many
    documents hold one of the class.
    """
    rows = keyed_text(docs, key, text)
    plain = not rows.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if not plain:
        rows = written(rows.withColumn("doc", F.monotonically_increasing_id()), "rows")
        names = rows.select("doc", "doc_id")
    own = rows.select(F.col("doc_id" if plain else "doc").alias("doc"), "text").where(F.length("text") > 0)
    links = all_links(own).withColumn("link", F.monotonically_increasing_id())
    sides = links.select("link", "doc", "a", "b").union(links.select("link", F.col("doc2"), F.col("a2"), F.col("b2")))
    by = Window.partitionBy("doc").orderBy("a", "b")
    reach = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    begins = sides.withColumn("new", F.when(reach >= F.col("a"), None).otherwise(F.col("a")))
    placed = begins.select("link", "doc", "b", F.max("new").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("first"))
    placed = shared_checkpoint(placed.withColumn("node", F.xxhash64("doc", "first")))
    node = placed.groupBy("node", "doc", "first").agg(F.max("b").alias("last"))
    edges = placed.groupBy("link").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b").distinct()
    classed = node.join(connected_components(edges), "node").select("doc", "first", "last", F.col("root").alias("class_id"))
    sizes = classed.groupBy("class_id", "doc").count().groupBy("class_id").agg(F.count("*").alias("documents")).where("documents > 1")
    sizes = sizes.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # so that a large class can be split in the join
    found = classed.join(sizes, "class_id")
    found = found.withColumn("doc_id", F.col("doc")) if plain else found.join(names, "doc")
    return found.select("doc_id", F.col("first").alias("first_word"), (F.col("last") + SHINGLE - 1).alias("last_word"), "class_id", "documents")
