"""Full text search from a positional index.

The index has a row for each word of a document: its stem, the word, the document and the word's places. It is written as Parquet in
folders by a hash of the stem, sorted by stem, so a query reads the folders of its stems and skips what else they hold. A folder's rows
are dealt over several files by document, some four for each of the session's shuffle partitions in all, so the build keeps all machines busy and a frequent stem is no
single task's. Building it is one pass over the texts in Arrow batches and one shuffle of the rows.

A query gathers, by document, what its words' rows say, and decides: words must be there or not, and phrases hold where the places
of their words, moved by their distance, have one in common. A table without an index is searched by the same steps over rows that are made
on the way, of the asked words only; where whole words are asked for, each text is judged by itself, and nothing is shuffled. In an index documents are told apart by their id; a null content has no words; an empty query finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tallywell.functions.english import SPECIAL, STOP_WORDS, stem_of

#: Folders by hash of the stem. A larger index has more of them, and is searched with the same number.
BUCKETS = 64

#: Alternatives, each a list of terms that must all hold: whether it is wanted, and its words with their places.
Terms = list[list[tuple[bool, list[tuple[int, str]]]]]

WORD = re.compile(r"[^\W_]+")


def beginnings(stems: frozenset[str]) -> frozenset[str]:
    """What the words of these stems begin with: two letters, or one if the stem has no more. Only words with a stem of their own differ in the second."""
    return frozenset(s[:2] for s in stems) | {w[:2] for w, s in SPECIAL.items() if s in stems}


def postings(docs: DataFrame, key: str = "id", content: str = "content", stems: frozenset[str] | None = None) -> DataFrame:
    """stem, word, doc and places (from 0) of each word of each document; of the given stems only, if they are given.

    A stem begins as its word does, so of other words than begin like a given stem neither places nor stems are made.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    begins = None if stems is None else beginnings(stems)
    texts = docs.select(docs[key].alias("doc"), F.lower(docs[content].cast("string")).alias("text"))
    schema = StructType([StructField("stem", StringType()), StructField("word", StringType()), StructField("doc", texts.schema["doc"].dataType), StructField("places", ArrayType(IntegerType()))])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                rows: list[tuple] = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    own: dict[str, list[int]] = {}
                    for at, word in enumerate(WORD.findall(text or "")):
                        if begins is None or word[:2] in begins or word[:1] in begins:
                            own.setdefault(word, []).append(at)
                    rows += [(s, w, i, at) for w, at in own.items() for s in (stem_of(w),) if stems is None or s in stems]
                if rows:
                    s, w, i, at = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(s, out.field(0).type), pa.array(w, out.field(1).type), part.column("doc").take(pa.array(i)), pa.array(at, out.field(3).type)], schema=out)

    return texts.mapInArrow(run, schema)


def bucket_of(stem: str, buckets: int = BUCKETS) -> int:
    return crc32(stem.encode()) % buckets


def build_index(docs: DataFrame, path: str, key: str = "id", content: str = "content", mode: str = "error", buckets: int = BUCKETS) -> None:
    """Writes the index of these documents; mode "append" adds further ones to it."""
    files = -(-4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    rows = postings(docs, key, content).withColumn("bucket", (F.crc32(F.col("stem").cast("binary")) % buckets).cast("int"))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(files))).sortWithinPartitions("bucket", "stem", "word", "doc")
    dealt.write.mode(mode).partitionBy("bucket").parquet(path)


def index_at(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def of_stems(index: DataFrame, stems: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The index's rows of these stems; other folders aren't read."""
    return index.where(F.col("bucket").isin(*{bucket_of(s, buckets) for s in stems}) & F.col("stem").isin(*stems))


def search_terms(query: str) -> Terms:
    """Whole words, lower-cased runs of letters and figures: those that must be there, and (after a minus) those that must not."""
    terms = [(not part.startswith("-"), [(0, word)]) for part in query.lower().split() for word in "".join(c if c.isalnum() else " " for c in part).split()]
    return [terms] if terms else []


def web_terms(query: str) -> Terms:
    """Alternatives (parted by the word or), each a list of terms that must all hold: whether the term is wanted (a minus in front: not), and its words with their places.

    What stands in quotes is one term of several words. Words are runs of letters and figures, lower-cased; stop words only keep their place.
    """
    found: Terms = [[]]
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query.lower()):
        if plain == "or" and not minus:
            found.append([])
            continue
        words = WORD.findall(quoted or plain)
        places = [(i, w) for i, w in enumerate(words) if w not in STOP_WORDS]
        if places:
            found[-1].append((not minus, places))
    return [terms for terms in found if terms]


def moved_by(places: int) -> Callable[[Column], Column]:
    return lambda at: at - places


def found(docs: DataFrame, rows: DataFrame, terms: Terms, by: str, key: str) -> DataFrame:
    """The documents for which an alternative holds; `rows` are the index's rows of all words asked for, which its column `by` has."""
    asked = sorted({w for alternative in terms for _, places in alternative for _, w in places})
    placed = {w for alternative in terms for _, places in alternative if len(places) > 1 for _, w in places}
    name = {w: f"w{i}" for i, w in enumerate(asked)}
    told = [F.flatten(F.collect_list(F.when(F.col(by) == w, F.col("places")))) if w in placed else F.max(F.col(by) == w) for w in asked]
    by_document = rows.where(F.col(by).isin(*asked)).groupBy("doc").agg(*(c.alias(name[w]) for c, w in zip(told, asked)))

    def holds(places: list[tuple[int, str]]) -> Column:
        if len(places) == 1:
            c = F.col(name[places[0][1]])
            return F.size(c) > 0 if places[0][1] in placed else c
        starts = [F.transform(F.col(name[w]), moved_by(o)) for o, w in places]
        return F.size(reduce(F.array_intersect, starts)) > 0

    whole = [reduce(lambda a, b: a & b, (holds(places) if wanted else ~holds(places) for wanted, places in alternative)) for alternative in terms]
    hit = by_document.select("doc", reduce(lambda a, b: a | b, whole).alias("hit"))
    if any(not any(wanted for wanted, _ in alternative) for alternative in terms):  # a document without any of the words is found, too
        missed = hit.where(~F.col("hit")).select(F.col("doc").alias(key))
        return docs.join(missed, key, "left_anti")
    return docs.join(hit.where("hit").select(F.col("doc").alias(key)), key, "left_semi")


def holds_word(text: Column, word: str) -> Column:
    """Whether a lower-cased text holds the word as a whole; texts without its letters are told by a plain search."""
    w = "".join(c if c.isascii() else rf"\x{{{ord(c):x}}}" for c in word)
    return text.contains(word) & text.rlike(rf"{w}(?![\p{{L}}\p{{N}}])(?<![\p{{L}}\p{{N}}]{w})")


def full_text(docs: DataFrame, query: str, index: DataFrame | None = None, key: str = "id", content: str = "content", buckets: int = BUCKETS) -> DataFrame:
    """Documents whose words include all wanted and no unwanted ones, as they are: no stems and no stop words."""
    terms = search_terms(query)
    if not terms:
        return docs.where(F.lit(False))
    if index is None:
        text = F.lower(F.coalesce(docs[content].cast("string"), F.lit("")))
        return docs.where(reduce(lambda a, b: a & b, (holds_word(text, w) if wanted else ~holds_word(text, w) for wanted, ((_, w),) in terms[0])))
    stems = sorted({stem_of(w) for alternative in terms for _, places in alternative for _, w in places})
    return found(docs, of_stems(index, stems, buckets), terms, "word", key)


def web_search(docs: DataFrame, query: str, index: DataFrame | None = None, key: str = "id", content: str = "content", buckets: int = BUCKETS) -> DataFrame:
    """Documents that hold what a web search asks for, by English stems: all words of an alternative, quoted ones in their places, none with a minus.

    A query of stop words only finds nothing.
    """
    terms = [[(wanted, [(o, stem_of(w)) for o, w in places]) for wanted, places in alternative] for alternative in web_terms(query)]
    if not terms:
        return docs.where(F.lit(False))
    stems = sorted({s for alternative in terms for _, places in alternative for _, s in places})
    rows = postings(docs, key, content, frozenset(stems)) if index is None else of_stems(index, stems, buckets)
    return found(docs, rows, terms, "stem", key)
