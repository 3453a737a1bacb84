"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only the bag is labelled. A sentence's score is a logistic model of its distinct words
and their beginnings; the document's score is the noisy-or of its sentences, 1 - product(1 - p). The model is fitted to the
documents' labels by the gradient of that likelihood, so each toxic document's blame goes to the sentences that explain it,
and sentences over a threshold are reported as the offending ones.

The model is fitted on the driver from a bounded sample of labelled documents (SAMPLE_EACH of either label, chosen by a hash
of the id and weighted back to the labels' true shares); scoring covers every document in one narrow pass. Inputs are
texts only. Defined results: a null or empty text has no sentence and takes the score of one without any known word; labels
that are null or of unknown documents teach nothing, of several labels of a document the largest counts; without any toxic
label every score is near 0; repeated rows are scored each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import keyed_text, mapped, remainder

#: Labelled documents of either label that the model is fitted on at most.
SAMPLE_EACH = 2000
#: Documents of the sample that must hold a feature for it to count.
LEAST_DOCUMENTS = 4
BEGINNINGS = (4, 5, 6)
STEPS, RATE, L1, L2 = 110, 0.12, 2e-4, 1e-6
#: A sentence is offending from this score on.
OFFENDING = 0.5
#: Entries of a worker's cache of word weights; it is emptied when full.
CACHE_ENTRIES = 400_000

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word itself and its beginnings, marked as such."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Model:
    bias: float
    weights: dict[str, float]


class WordWeights(dict):
    """Word -> the sum of its features' weights, worked out when first met."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        get = self.model.weights.get
        self[word] = total = sum(get(f, 0.0) for f in features(word))
        return total


def softplus(z: float) -> float:
    return max(z, 0.0) + log1p(exp(-abs(z)))


def sentence_logits(text: str, bias: float, weight: WordWeights) -> Iterator[tuple[int, int, float]]:
    """Start, end and logit of each sentence that holds a word."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length; places must stay those of the text
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for m in SENTENCE.finditer(low):
        words = set(WORD.findall(m[0]))
        if words:
            yield m.start(), m.end(), bias + sum([weight[w] for w in words])


def scorer(model: Model) -> Callable[[str], tuple[float, list[dict]]]:
    """From a text to its score and its offending sentences."""
    weight, bias = WordWeights(model), model.bias
    plain = softplus(bias)

    def score(text: str) -> tuple[float, list[dict]]:
        clean, bad, found = 0.0, 0, []
        for start, end, z in sentence_logits(text, bias, weight):
            s = plain if z == bias else softplus(z)
            clean += s
            if z >= 0:
                bad += 1
                if 1 - exp(-s) >= OFFENDING:
                    found.append({"start": start, "end": end, "score": 1 - exp(-s)})
        return 1 - exp(-(clean or plain)), found

    return score


def bags(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and for each word of each sentence (once) its index; starts of sentences; starts of documents in sentences."""
    index: dict[str, int] = {}
    tokens: list[int] = []
    sentences: list[int] = []
    documents: list[int] = []
    for t in texts:
        documents.append(len(sentences))
        for m in SENTENCE.finditer(t.lower()):
            words = set(WORD.findall(m[0]))
            if words:
                sentences.append(len(tokens))
                tokens += sorted(index.setdefault(w, len(index)) for w in words)
        if documents[-1] == len(sentences):
            sentences.append(len(tokens))  # an empty text: one sentence without words
    return list(index), np.array(tokens, np.int64), np.array(sentences, np.int64), np.array(documents, np.int64)


def segment_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of x between starts; empty segments are 0."""
    total = np.concatenate([[0.0], np.cumsum(x)])
    return total[np.append(starts[1:], len(x))] - total[starts]


def fit(texts: list[str], toxic: np.ndarray, share: float | None = None) -> Model:
    """`share`: the true share of toxic documents, if the sample's differs."""
    y = toxic.astype(bool)
    if not y.any():
        return Model(-20.0, {})
    order = np.lexsort((np.array([len(t) for t in texts]), ~y))
    texts, y = [texts[i] for i in order], y[order]
    words, tokens, sentences, documents = bags(texts)
    share = y.mean() if share is None else share
    weight = np.where(y, share / max(1, y.sum()), (1 - share) / max(1, (~y).sum()))
    of_sentence = np.repeat(np.arange(len(documents)), np.diff(np.append(documents, len(sentences))))
    of_token = np.repeat(np.arange(len(sentences)), np.diff(np.append(sentences, len(tokens))))
    # features that enough documents hold
    held = np.unique(of_sentence[of_token] * len(words) + tokens) % max(1, len(words))
    in_documents = np.bincount(held, minlength=len(words))
    counts: Counter[str] = Counter()
    for w, n in zip(words, in_documents.tolist()):
        for f in features(w):
            counts[f] += n
    kept = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= LEAST_DOCUMENTS))}
    pairs = [(i, kept[f]) for i, w in enumerate(words) for f in features(w) if f in kept]
    word_of, feature_of = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64), np.empty(0, np.int64))
    theta, bias = np.zeros(len(kept)), np.log(max(share, 1e-6) / max(1.0, len(sentences) / len(documents)))
    m, v, mb, vb = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    for step in range(1, STEPS + 1):
        by_word = np.bincount(word_of, theta[feature_of], len(words))
        z = bias + segment_sums(by_word[tokens], sentences)
        sp = np.logaddexp(0, z)
        total = segment_sums(sp, documents)
        # d loss / d z: p for clean documents, -p / (exp(total) - 1) for toxic ones
        outer = weight * np.where(y, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-12), 1.0)
        dz = outer[of_sentence] / (1 + np.exp(-z))
        g = np.bincount(feature_of, np.bincount(tokens, dz[of_token], len(words))[word_of], len(kept)) + L2 * theta
        gb = dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        pace = fix / (np.sqrt(v) + 1e-7)
        theta = theta - pace * m
        theta = np.sign(theta) * np.maximum(np.abs(theta) - pace * L1 * 0.1, 0)
        bias -= 0.3 * fix * mb / (np.sqrt(vb) + 1e-7)
    return Model(float(bias), {f: float(theta[i]) for f, i in kept.items() if theta[i]})


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn: Callable = lambda key: remainder(key) != 0) -> Model:
    """Fits a model to the labelled documents whose id passes `learn`."""
    marked = labels.select(labels[key].cast("long").alias("doc_id"), labels[label].cast("int").alias("y")).where("y is not null and doc_id is not null")
    marked = marked.where(learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = {r["y"] > 0: r["n"] for r in marked.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit("sample"))
    chosen = [marked.where(c).orderBy(order, "doc_id").limit(SAMPLE_EACH) for c in ("y > 0", "y <= 0")]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * SAMPLE_EACH rows of two numbers
    rows = keyed_text(docs, key, text).join(ids, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * SAMPLE_EACH).collect()  # ids may repeat in documents
    total = n.get(True, 0) + n.get(False, 0)
    return fit([r["text"] for r in rows], np.array([r["y"] > 0 for r in rows], bool), n.get(True, 0) / total if total else None)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, and the offending sentences with their places (code points, end exclusive) and scores."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's features
    return mapped(docs, lambda: scorer(sent.value), "score double, sentences array<struct<start:bigint,end:bigint,score:double>>", key, text)


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores under 0.5. One narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(sent.value)
        for b in batches:
            yield b.filter(pa.array([of(t or "")[0] < 0.5 for t in b.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def digests(scored: DataFrame) -> DataFrame:
    places = F.array_join(F.transform("sentences", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), places.alias("offending"))
