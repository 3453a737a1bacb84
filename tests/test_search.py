from __future__ import annotations

import pytest
from tallywell.functions.english import stem_of
from tallywell.operators import search
from tallywell.operators.search import full_text, web_search, web_terms

#: Words and their stems by the published rules, some for each step.
STEMS = {
    "ss": "ss", "by": "by", "skies": "sky", "news": "news", "flies": "fli", "ties": "tie", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "bless": "bless", "agreed": "agre", "feed": "feed", "bled": "bled", "luxuriated": "luxuri", "hopping": "hop",
    "hoping": "hope", "falling": "fall", "snowed": "snow", "sing": "sing", "cries": "cri", "say": "say", "enjoyed": "enjoy", "youth": "youth", "relational": "relat", "apology": "apolog", "knightly": "knight", "happily": "happili", "conditional": "condit",
    "abilities": "abil", "communication": "communic", "generously": "generous", "triplicate": "triplic", "formative": "format", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "rate": "rate", "controlling": "control", "exceeds": "exceed", "straße": "straße",
}
TEXTS = ["The runner was running a long race", "Races: run, then rest!", "long THE race", "race long", "a long and hard race", None, ""]


def test_stems():
    assert {w: stem_of(w) for w in STEMS} == STEMS


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("runs", [0, 1]), ("racing -running", [2, 3, 4]), ('"long race"', [0]), ('"long the races"', [2]), ('-"long race" long', [2, 3, 4]), ("resting or hard", [1, 4]),
        ("the of", []), ("or", []), ("-hard", [0, 1, 2, 3, 5, 6]), ('"', []), ('"long', [0, 2, 3, 4]), 
    ],
)
def test_web_search(spark, query, ids):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string")
    assert sorted(r.id for r in web_search(docs, query).collect()) == ids


def test_index_answers_as_the_texts_do(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string")
    few = {"buckets": 5}
    search.build_index(docs.where("id < 4"), str(tmp_path / "i"), **few)
    search.build_index(docs.where("id >= 4"), str(tmp_path / "i"), mode="append", **few)
    index = search.index_at(spark, str(tmp_path / "i"))
    for query in ("runs", "racing -running", '"long race"', '"long the races"', '-"long race" long', "resting or hard", "-hard", "the of"):
        assert sorted(web_search(docs, query, index, **few).collect()) == sorted(web_search(docs, query).collect())
    for query, ids in (("THE race", [0, 2]), ("long -hard", [0, 2, 3]), ("-race", [1, 5, 6]), ("run,race", []), ("", [])):
        assert sorted(r.id for r in full_text(docs, query, index, **few).collect()) == sorted(r.id for r in full_text(docs, query).collect()) == ids


def test_a_query_reads_only_the_folders_of_its_stems(spark, tmp_path, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id AS id", "text AS content")
    search.build_index(docs, str(tmp_path / "i"))
    index = search.index_at(spark, str(tmp_path / "i"))
    rows = search.of_stems(index, ["thing", "idiot"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(stem" in plan and {r.bucket for r in rows.select("bucket").distinct().collect()} <= {search.bucket_of("thing"), search.bucket_of("idiot")}


def test_places_of_the_index(spark):
    text = "Über\u00a0uns: a_b, A-b \u0660\u0661 x" + " x" * 3
    rows = search.postings(spark.createDataFrame([(1, text), (2, None)], "id bigint, content string")).collect()
    assert {(r.doc, r.word): r.places for r in rows} == {(1, "über"): [0], (1, "uns"): [1], (1, "a"): [2, 4], (1, "b"): [3, 5], (1, "\u0660\u0661"): [6], (1, "x"): [7, 8, 9, 10]}


def test_terms():
    assert web_terms('Cats -dogs OR "The big cat"') == [[(True, [(0, "cats")]), (False, [(0, "dogs")])], [(True, [(1, "big"), (2, "cat")])]]


def test_words_begin_like_their_stems():
    ends = ("", "s", "es", "ies", "ied", "ed", "edly", "eed", "ing", "ingly", "y", "ly", "ational", "ization", "ness", "e", "ll", "ion", "'")
    begins = ("", "a", "i", "y", "t", "th", "ay", "yy", "by", "ab", "hop", "run", "tri", "gener", "über", "ß")
    for word in {a + m + b for a in begins for m in begins for b in ends} | set(STEMS) | set(search.SPECIAL):
        if word:
            begin = search.beginnings(frozenset([stem_of(word)]))
            assert word[:2] in begin or word[:1] in begin


def test_a_single_search_builds_no_index(spark, data, monkeypatch):
    from tallywell.plans import store

    monkeypatch.setattr(store, "INDEXES", {})
    with monkeypatch.context() as m:
        m.setattr(search, "build_index", lambda *a, **k: pytest.fail("an index was built for one search"))
        once = {k: sorted(store.KEYS[k][0](spark, data).collect()) for k in ("p_fts", "p_fts_stems")}
    store.index(spark, data)
    assert {k: sorted(store.KEYS[k][0](spark, data).collect()) for k in once} == once


def test_whole_words_without_an_index_need_no_shuffle(spark):
    """Each row is judged by itself, also where ids repeat; a word is parted by all that is neither letter nor figure."""
    rows = [(1, "the cat"), (1, "and dog"), (2, "THE and"), (3, "then and the_and"), (4, "the, andré and"), (5, None), (6, "the and2 éand"), (7, "and the idiot"), (8, "the and idiots")]
    docs = spark.createDataFrame(rows, "id bigint, content string")
    out = full_text(docs, "the and -idiot")
    assert sorted(r.id for r in out.collect()) == [2, 3, 4, 8]
    assert sorted(r.id for r in full_text(docs, "andré").collect()) == [4] and sorted(r.id for r in full_text(docs, "-the").collect()) == [1, 5]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
