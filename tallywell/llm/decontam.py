"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

Words are runs of ASCII letters and figures and of all non-ASCII characters; only A-Z are lower-cased. A training passage is
a window of words of a document: twice the longest item (PASSAGE at least), moved on by half, so that every stretch as long
as an item lies within one passage. An item is found in a passage that holds at least 80 % of the distinct five-word shingles
of its question (items of fewer words: the whole question) and, where the item has an answer, of the answer's too.

Each passage is a query to an inverted index of the items. Impacts are BM25's, divided by the least score that an item can
have in a passage that passes verification: the score of all its terms without the dearest that the missing shingles can
cost. So 1 is the threshold of every item, and the retrieval loses nothing. First each passage's essential terms are summed
by item (those an item needs besides its cheapest ones); where a bound from them allows the threshold, block-max WAND over
all lists retrieves every item at or above it, and each is verified by its shingles.

The index goes to the executors in shards of bounded size; more items mean more passes over the documents, not larger
shards. Passages are as wide in each of them, so what is found doesn't depend on the shards; a score does, as terms are weighed among its shard's items. Defined results: null or empty texts match nothing; items without words match nothing; repeated items match under
each of their ids (repeated rows of an item count once); repeated documents match each for itself; empty tables give empty tables.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import keyed_text, text_batches

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SHINGLE, OVERLAP = 5, 0.8
#: Words of a passage at least.
PASSAGE = 128
K1, B = 1.2, 0.75
BLOCK = 32
#: Share of the threshold that an item's cheapest terms may hold and not be essential.
CHEAP = 0.3
#: Bytes of item texts and items of a shard at most.
SHARD_BYTES, SHARD_ITEMS = 16_000_000, 50_000

Hit = tuple[int, int, int, float, int]  # item, shingles found, passages, score, first word of the best passage


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


def shingles(words: list) -> set[tuple]:
    """Distinct; of fewer than SHINGLE words, the whole sequence."""
    return set(zip(*(words[k:] for k in range(SHINGLE)))) or ({tuple(words)} if words else set())


def needed(n: int) -> int:
    """Of n distinct shingles, how many must be found."""
    return ceil(OVERLAP * n - 1e-9)


class Index:
    """Postings by term, in order of the item: impacts, and their maxima by block."""

    def __init__(self, questions: list[str], answers: list[str | None], longest: int = 0) -> None:
        """`longest`: words of the longest question or answer of all items, also of those that other indexes hold."""
        words = [words_of(q) for q in questions]
        self.vocabulary: dict[bytes, int] = {}
        add = self.vocabulary.setdefault
        ids = [[add(w, len(self.vocabulary)) for w in ws] for ws in words]
        answer_ids = [[add(w, len(self.vocabulary)) for w in words_of(a or "")] for a in answers]
        self.shingles = [shingles(x) for x in ids]
        self.answer_shingles = [shingles(x) for x in answer_ids]
        self.passage = max(PASSAGE, 2 * longest, 2 * max(map(len, [*ids, *answer_ids]), default=0))
        n, mean = len(ids), sum(map(len, ids)) / max(1, len(ids))
        counts = [np.unique(x, return_counts=True) if x else (np.empty(0, np.int64), np.empty(0, np.int64)) for x in ids]
        df = np.bincount(np.concatenate([c[0] for c in counts]).astype(np.int64), minlength=len(self.vocabulary)) if counts else np.zeros(0)
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        essential: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        self.lacking = np.ones(n)  # what an item's essential terms must reach
        for i, (terms, tf) in enumerate(counts):
            if not len(terms):
                continue
            idf = np.log(1 + (n - df[terms] + 0.5) / (df[terms] + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids[i]) / mean))
            # K lost shingles can take K + 4 terms at most: they begin with different terms but for the last four words
            lost = len(self.shingles[i]) - needed(len(self.shingles[i]))
            dear = np.sort(impact)[::-1]
            least = dear[min(lost + 4, 5 * lost) :].sum()
            if least <= 0:  # the shingles left may hold no other term
                least = dear[-1]
            impact = impact / least
            order = np.argsort(impact, kind="stable")
            cheap = np.cumsum(impact[order]) <= CHEAP
            self.lacking[i] = 1 - impact[order][cheap].sum()
            for t, x, c in zip(terms[order].tolist(), impact[order].tolist(), cheap.tolist()):
                postings[t].append((i, x))
                if not c:
                    essential[t].append((i, x))
        self.items = [[i for i, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.block_max = [[max(p[a : a + BLOCK]) for a in range(0, len(p), BLOCK)] for p in self.impacts]
        self.most = [max(p, default=0.0) for p in self.impacts]
        sizes = np.array([len(p) for p in essential], np.int64)
        self.essential_at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.essential_items = np.array([i for p in essential for i, _ in p], np.int64)
        self.essential_impacts = np.array([x for p in essential for _, x in p], np.float64)
        self.is_essential = np.append(sizes > 0, False)  # the last stands for unknown words, whose id is -1

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """Every item whose terms among `terms` (distinct) add up to 1 or more, with its score."""
        found, bar = [], 1 - 1e-9
        lists = [[self.items[t][0], 0, t] for t in terms if self.items[t]]  # current item, place, term
        while lists:
            lists.sort()
            bound, p = 0.0, 0
            for p, (_, _, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= bar:
                    break
            else:
                break
            pivot = lists[p][0]
            while p + 1 < len(lists) and lists[p + 1][0] == pivot:
                p += 1
            # the blocks that hold the pivot, found without moving the lists
            bound, end = 0.0, None
            for item, at, t in lists[: p + 1]:
                own = self.items[t]
                block = (at if item >= pivot else bisect_left(own, pivot, at)) // BLOCK
                if block < len(self.block_max[t]):
                    bound += self.block_max[t][block]
                    last = own[min(len(own), (block + 1) * BLOCK) - 1]
                    end = last if end is None else min(end, last)
            if bound >= bar:
                if lists[0][0] == pivot:
                    score = sum(self.impacts[t][at] for _, at, t in lists[: p + 1])
                    if score >= bar:
                        found.append((pivot, score))
                to = pivot + (lists[0][0] == pivot)
            else:  # no item up to the nearest end of these blocks, or to the next list's item, can reach the threshold
                to = pivot + 1 if end is None else max(pivot, end) + 1
                if p + 1 < len(lists):
                    to = max(pivot + 1, min(to, lists[p + 1][0]))
            for x in lists[: p + 1]:
                if x[0] < to:
                    own = self.items[x[2]]
                    x[1] = bisect_left(own, to, x[1])
                    x[0] = own[x[1]] if x[1] < len(own) else -1
            lists = [x for x in lists if x[0] >= 0]
        return found

    def verified(self, item: int, ids: list[int]) -> int:
        """How many of the item's shingles the passage holds, if enough of the question's and the answer's; else 0."""
        counts = []
        for own in (self.shingles[item], self.answer_shingles[item]):
            if own:
                n = len(next(iter(own)))
                counts.append(len(own & set(zip(*(ids[k:] for k in range(n))))))
                if counts[-1] < needed(len(own)):
                    return 0
        return counts[0]

    def matches(self, texts: list[str]) -> list[list[Hit]]:
        """For each text, the items found in any of its passages."""
        get = self.vocabulary.get
        docs = [np.array([get(w, -1) for w in words_of(t)], np.int64) for t in texts]
        out: list[dict[int, Hit]] = [{} for _ in texts]
        for d, start in self.promising(docs):
            ids = docs[d][start : start + self.passage]
            known = np.unique(ids[ids >= 0]).tolist()
            for item, score in self.wand(known):
                n = self.verified(item, ids.tolist())
                if n:
                    _, most, k, best, at = out[d].get(item, (item, 0, 0, 0.0, 0))
                    out[d][item] = (item, max(most, n), k + 1, *((score, start) if score > best else (best, at)))
        return [sorted(x.values()) for x in out]

    def promising(self, docs: list[np.ndarray]) -> list[tuple[int, int]]:
        """Document and first word of each passage that an item may reach the threshold in, by its essential terms."""
        step = self.passage // 2
        sizes = np.array([len(x) for x in docs], np.int64)
        last = np.maximum(0, -(-(sizes - self.passage) // step))  # each document's last passage
        ids = np.concatenate(docs) if docs else np.empty(0, np.int64)
        hit = np.nonzero(self.is_essential[ids])[0]
        if not len(hit):
            return []
        ends = np.cumsum(sizes)
        doc = np.searchsorted(ends, hit, side="right")
        own = (hit - (ends - sizes)[doc]) // step
        # a word lies in the passage that begins in its own half and in the one before
        doc, passage, term = np.concatenate([doc, doc]), np.concatenate([own, own - 1]), np.concatenate([ids[hit], ids[hit]])
        real = (passage >= 0) & (passage <= last[doc])
        first = np.concatenate([[0], np.cumsum(last + 1)])
        code = np.unique((first[doc] + passage)[real] * len(self.is_essential) + term[real])  # a term counts once in a passage
        passage, term = code // len(self.is_essential), code % len(self.is_essential)
        n = self.essential_at[term + 1] - self.essential_at[term]
        at = np.repeat(self.essential_at[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        code, place = np.unique(np.repeat(passage, n) * len(self.lacking) + self.essential_items[at], return_inverse=True)
        total = np.bincount(place, self.essential_impacts[at], len(code))
        passage = np.unique(code[total >= self.lacking[code % len(self.lacking)] - 1e-9] // len(self.lacking))
        doc = np.searchsorted(first, passage, side="right") - 1
        return list(zip(doc.tolist(), ((passage - first[doc]) * step).tolist()))


def shards(benchmark: DataFrame, item: str, question: str, answer: str | None) -> Iterator[tuple[list[int], Index]]:
    """Item ids and index of each shard. A shard comes to the driver and goes to the executors, so its size is bounded."""
    items = benchmark.select(
        benchmark[item].cast("long").alias("item"), benchmark[question].cast("string").alias("question"), (benchmark[answer].cast("string") if answer else F.lit(None).cast("string")).alias("answer")
    )
    items = items.where("item is not null and question is not null").distinct()
    words = F.greatest(*(F.size(F.regexp_extract_all(c, F.lit(WORD.pattern.decode()), F.lit(0))) for c in ("question", "answer")))
    n, size, longest = items.agg(F.count("*"), F.sum(F.length("question") + F.coalesce(F.length("answer"), F.lit(0))), F.max(words)).first()
    parts = max(1, ceil(2 * (size or 0) / SHARD_BYTES), ceil(2 * n / SHARD_ITEMS))  # twice, as a hash deals unevenly
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item", "question"), F.lit(parts)) == k).orderBy("item", "question", "answer").collect()
        if rows:
            yield [r["item"] for r in rows], Index([r["question"] for r in rows], [r["answer"] for r in rows], longest or 0)


def by_batch(index: Index, texts: list[str]) -> Iterator[tuple[int, list[list[Hit]]]]:
    """Start and hits of runs of texts that are small enough to be searched at once."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or (chars < 1_000_000 and end - at < 512)):
            chars += len(texts[end])
            end += 1
        yield at, index.matches(texts[at:end])
        at = end


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", question: str = "text", answer: str | None = None) -> DataFrame:
    """doc_id, item_id, shingles_found, shingles, passages, score and first_word of each item found in a document.

    shingles_found is the largest number in one passage; score and first_word belong to the passage of the largest score.
    """
    schema = "doc_id bigint, item_id bigint, shingles_found int, shingles int, passages int, score double, first_word int"
    df, sc = keyed_text(docs, key, text), docs.sparkSession.sparkContext
    out = df.sparkSession.createDataFrame([], schema)
    for ids, index in shards(benchmark, item, question, answer):
        sent = sc.broadcast((ids, index))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, index = sent.value
            for keys, texts in text_batches(batches):
                keys = keys.to_pylist()
                for at, found in by_batch(index, texts):
                    rows = [(keys[at + d], items[i], n, len(index.shingles[i]), k, s, first) for d, hits in enumerate(found) for i, n, k, s, first in hits]
                    if rows:
                        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in schema.split(", ")])

        out = out.union(df.mapInArrow(run, schema))
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", question: str = "text", answer: str | None = None) -> DataFrame:
    """The rows of `docs`, all columns, in which no item is found. One narrow pass for each shard of items."""
    sc, schema = docs.sparkSession.sparkContext, docs.schema
    for _, index in shards(benchmark, item, question, answer):
        sent = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [t or "" for t in b.column(text).to_pylist()]
                clean = [not hits for _, found in by_batch(sent.value, texts) for hits in found]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def plain_matches(texts: list[str], index: Index) -> list[list[tuple[int, int, int]]]:
    """Item, shingles found and passages, by comparing every passage with every item; for tests."""
    step, out = index.passage // 2, []
    for t in texts:
        ids = [index.vocabulary.get(w, -1) for w in words_of(t)]
        found: dict[int, tuple[int, int, int]] = {}
        for start in range(0, max(1, len(ids) - index.passage + step), step):
            for i, own in enumerate(index.shingles):
                if own and (n := index.verified(i, ids[start : start + index.passage])):
                    _, most, k = found.get(i, (i, 0, 0))
                    found[i] = (i, max(most, n), k + 1)
        out.append(sorted(found.values()))
    return out
