"""The whole pipeline's rows from plain versions of its stages: products of logistic scores, all pairs of fingerprints, SQL, patterns, and tiktoken."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from math import exp, prod

import tiktoken

import corpus_pipeline
from oracle import connection
from tallywell.llm import bpe, pii, queries, toxicity
from test_pii import plain
from test_simhash import plain_fingerprint, roots_of


def toxic(text: str, model: toxicity.Model) -> bool:
    def logistic(words: set[str]) -> float:
        z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in {w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) >= n)})
        return 1 / (1 + exp(-z))

    bags = [b for b in (set(re.findall(r"\w+", s)) for s in re.split(r"[.!?\n]+", text.lower())) if b]
    return 1 - prod(1 - logistic(b) for b in bags or [set()]) >= 0.5


def redacted(text: str) -> str:
    """By the plain patterns, where the operator adds nothing to them."""
    spans = pii.find(text)
    if all(is_base for *_, is_base in spans):
        kinds = list(pii.KINDS)
        spans = sorted(((k, a, b, True) for k, a, b in plain(text)), key=lambda s: (s[1], kinds.index(s[0])))
    out, done = "", 0
    for kind, a, b, _ in spans:
        if a >= done:
            out += text[done:a] + f"<{kind.upper()}>"
        done = max(done, b)
    return out + text[done:]


def test_rows_equal_those_of_plain_stages(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = toxicity.train(docs, labels)
    clean = {i: t for i, t in texts.items() if not toxic(t, model)}
    assert 0 < len(texts) - len(clean) < len(texts) / 2
    fps = {i: plain_fingerprint(t) for i, t in clean.items()}
    root = roots_of(sorted(set(fps.values())))
    groups = defaultdict(set)
    for i, f in fps.items():
        groups[root[f]].add(i)
    assert len(groups) < len(clean)
    found = {r[0] for r in connection(data).sql(f"SELECT doc_id FROM ({queries.OP7_SQL})").fetchall()}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, data).collect()}
    assert not rows.keys() & found and rows.keys() <= clean.keys()
    for members in groups.values():
        kept = members & rows.keys()
        assert len(kept) <= 1 and (kept or members & found)  # one of each group, unless that one holds an item
    enc = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})
    for i, r in rows.items():
        text = redacted(texts[i])
        ids = enc.encode_ordinary(text)
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (r.n_tokens, bytes(r.ids), r.ids_sha256) == (len(ids), packed, hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
