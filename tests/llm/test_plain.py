"""Scores and spans worked out anew, the plain way."""

from __future__ import annotations

import re
from collections import Counter
from math import exp, log2, prod

from hypothesis import given, settings
from hypothesis import strategies as st

from tallywell.llm import queries, secrets, toxicity


def test_toxicity_is_the_noisy_or_of_sentences(spark, data):
    """From the fitted weights, with plain products of plain logistic scores."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)

    def logistic(words: set[str]) -> float:
        z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in {w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) >= n)})
        return 1 / (1 + exp(-z))

    found = {r.doc_id: r for r in queries.op2_toxicity(spark, data).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert found.keys() == texts.keys() and len({r.score for r in found.values()}) > 100
    for i, t in texts.items():
        bags = [set(re.findall(r"\w+", s)) for s in re.split(r"[.!?\n]+", t.lower())]
        want = 1 - prod(1 - logistic(b) for b in (b for b in bags if b)) if any(bags) else logistic(set())
        assert abs(found[i].score - want) < 1e-9 and found[i].predicted == (want >= 0.5)


def test_toxicity_labels_that_repeat_or_are_null(spark):
    docs = spark.createDataFrame([(i, "vile wretched scum here" if i % 2 else "a calm walk outside") for i in range(40)] + [(1, "vile wretched scum here"), (None, "x")], "doc_id bigint, text string")
    once = [(i, i % 2) for i in range(40)]
    plain = toxicity.train(docs, spark.createDataFrame(once, "doc_id bigint, toxic int"))
    odd = toxicity.train(docs, spark.createDataFrame([*once, *once, (3, 0), (3, None), (None, 1), (999, 1), (4, None)], "doc_id bigint, toxic int"))
    score = toxicity.scorer(odd)
    assert score("vile scum")[0] > 0.5 > score("a calm walk")[0]
    assert {f: w > 0 for f, w in plain.weights.items()} == {f: w > 0 for f, w in odd.weights.items()}


@settings(max_examples=200, deadline=None)
@given(st.text("abcdefgh01", max_size=90), st.floats(1.0, 4.5))
def test_entropy_of_every_window(s, threshold):
    n = secrets.WINDOW
    marked = [False] * len(s)
    for start in range(len(s) - n + 1):
        counts = Counter(s[start : start + n]).values()
        if -sum(c / n * log2(c / n) for c in counts) >= threshold - 1e-10:
            marked[start : start + n] = [True] * n
    # spans that touch are one: each marked stretch lies in a span, and spans hold nothing else
    spans = secrets.dense(s, threshold)
    assert [any(a <= i < b for a, b in spans) for i in range(len(s))] == marked
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
