"""The numbered queries over whole tables, and the SQL to compare them with where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywell.llm import ann, bpe, brown, codes, decontam, periodic, pii, secrets, sharding, simhash, toxicity, urlfilter, windows
from tallywell.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), decoded=True))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digests(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.passages(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items are in which documents; the SQL finds the same without an index."""
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shingles_found", "shingles", "passages")


OP7_SQL = r"""
WITH items AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), size AS (SELECT greatest(128, 2 * max(len(w))) AS width, CAST(greatest(128, 2 * max(len(w))) // 2 AS BIGINT) AS step FROM items
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), item_shingles AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM items WHERE len(w) > 0
), needed AS (SELECT item_id, count(*) AS shingles FROM item_shingles GROUP BY item_id
), lengths AS (SELECT DISTINCT n FROM item_shingles
), doc_shingles AS (
  SELECT rid, doc_id, n, len(w) AS words, p, array_to_string(w[p + 1 : p + n], ' ') AS s
  FROM (SELECT rid, doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM docs, lengths WHERE len(w) >= n)
), hit AS (SELECT rid, doc_id, item_id, words, p, n, s FROM doc_shingles JOIN item_shingles USING (n, s)
), by_passage AS (
  SELECT rid, doc_id, item_id, k, count(DISTINCT s) AS found
  FROM (SELECT hit.*, unnest([p // step, p // step - 1]) AS k, width, step FROM hit, size)
  WHERE k >= 0 AND k * step + width >= p + n AND k <= greatest(0, ceil((words - width) / step))
  GROUP BY rid, doc_id, item_id, k
)
SELECT doc_id, item_id, CAST(max(found) AS INTEGER) AS shingles_found, CAST(any_value(shingles) AS INTEGER) AS shingles, CAST(count(*) AS INTEGER) AS passages
FROM by_passage JOIN needed USING (item_id) WHERE found >= ceil(0.8 * shingles - 1e-9) GROUP BY rid, doc_id, item_id
"""


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.detect(table(spark, sf_dir, "documents")))


def op9_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.perplexity(table(spark, sf_dir, "documents"))


#: Verdict, host and path of the rules of op10.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of op10: hosts with a page whose url carries a tracking parameter."""
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.tracking_hosts(pages), RULES)


OP10_SQL = """
WITH p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r AS (
  SELECT page_id, host, path, url,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p
), listed AS (SELECT DISTINCT host FROM p WHERE host <> '' AND regexp_matches(url, '^[^#?]*\\?[^#]*utm_'))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op11_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(sharding.sharded(table(spark, sf_dir, "documents")))


def crc_sql(h: str) -> str:
    """The CRC-32 of bytes in hexadecimal, byte by byte; `t` is CRC_TABLE's column."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({h}), 2), lambda i: ('0x' || {h}[i : i + 1])::BIGINT)), lambda c, y: xor(c >> 8, t[xor(c, y) % 256 + 1])), 4294967295)"


CRC_TABLE = "range(256)"
for _ in range(8):
    CRC_TABLE = f"list_transform({CRC_TABLE}, lambda x: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
CRC_TABLE = f"(SELECT {CRC_TABLE} AS t)"


def feistel_sql() -> str:
    """The network's rounds as columns over the sides a and b, checksums by a table of bytes, and walks as a recursion."""
    rounds, left, right = [], "x // b", "x % b"
    for i, key in enumerate(sharding.round_keys(sharding.SEED)):
        half, side = ("l", "b") if i % 2 else ("r", "a")
        z = f"(({half} + {key}::UHUGEINT) % w * {sharding.MIX_1}::UHUGEINT % w)"
        f = f"((xor({z}, {z} >> 32) * {sharding.MIX_2}::UHUGEINT % w) >> 32)"
        if i % 2:
            right = f"(r + {f}) % {side}"
            left = "l"
        elif i:
            left, right = f"(l + {f}) % {side}", "r"
        else:
            rounds.append(f"SELECT id, n, a, b, w, {left} AS l, {right} AS r FROM start")
            left, right = f"(l + {f}) % {side}", "r"
        rounds.append(f"SELECT id, n, a, b, w, {left} AS l, {right} AS r FROM ({rounds[-1]})")
    return f"""
WITH RECURSIVE size AS (
  SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM documents))
), bytes AS (SELECT doc_id, row_number() OVER () AS k, coalesce(hex(encode(text)), '') AS h FROM documents
), sums AS (
  SELECT doc_id, len(h) // 2 + 1 AS size,
    {crc_sql("h")} AS text_crc32
  FROM bytes, {CRC_TABLE}
), numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS id FROM sums
), walk AS (
  SELECT id, n, a, b, id AS x, true AS again FROM numbered, size
  UNION ALL
  SELECT id, n, a, b, y AS x, y >= n AS again FROM (
    SELECT id, n, a, b, CAST(l * b + r AS BIGINT) AS y FROM (
      WITH start AS (SELECT id, n::UHUGEINT AS n, a::UHUGEINT AS a, b::UHUGEINT AS b, x::UHUGEINT AS x, 18446744073709551616::UHUGEINT AS w FROM walk WHERE again)
      {rounds[-1]}))
), placed AS (SELECT id, x FROM walk WHERE NOT again)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {sharding.SHARDS} AS INTEGER) AS shard, x // {sharding.SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN placed USING (id)
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digests(*codes.coded(table(spark, sf_dir, "embeddings")))


def codes_sql() -> str:
    """Each round as a join of all parts with all entries; parts have four components."""
    assigned = "SELECT rid, part, min({{'d': (p.x1 - c.x1) * (p.x1 - c.x1) + (p.x2 - c.x2) * (p.x2 - c.x2) + (p.x3 - c.x3) * (p.x3 - c.x3) + (p.x4 - c.x4) * (p.x4 - c.x4), 'e': e}}) AS a FROM p JOIN {c} c USING (part) GROUP BY rid, part"
    rounds = ""
    for i in range(2):
        means = ", ".join(f"CAST(floor(sum(x{k}) / count(*)) AS BIGINT) AS x{k}" for k in (1, 2, 3, 4))
        taken = ", ".join(f"coalesce(m.x{k}, c.x{k}) AS x{k}" for k in (1, 2, 3, 4))
        rounds += f"""), a{i} AS ({assigned.format(c=f"c{i}")}
), m{i} AS (SELECT part, a.e AS e, {means} FROM a{i} JOIN p USING (rid, part) GROUP BY part, a.e
), c{i + 1} AS (SELECT part, e, {taken} FROM c{i} c LEFT JOIN m{i} m USING (part, e)
"""
    return f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS rid, list_transform(embedding::DOUBLE[], lambda x: CAST(floor(256 * x) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (SELECT rid, part, q[4 * part + 1] AS x1, q[4 * part + 2] AS x2, q[4 * part + 3] AS x3, q[4 * part + 4] AS x4 FROM v, (SELECT unnest(range(16)) AS part)
), c0 AS (SELECT part, rid AS e, x1, x2, x3, x4 FROM p WHERE rid < 64
{rounds}), last AS ({assigned.format(c="c2")}
), found AS (SELECT rid, string_agg(printf('%02x', a.e), '' ORDER BY part) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM last GROUP BY rid
), book AS (SELECT sha256(string_agg(x1 || ',' || x2 || ',' || x3 || ',' || x4, ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM found JOIN v USING (rid), book
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.runs(periodic.repeated_tails(table(spark, sf_dir, "documents"))))


OP13_SQL = rf"""
WITH given AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    CASE WHEN doc_id IS NULL THEN 1 ELSE {crc_sql("hex(encode(CAST(doc_id AS VARCHAR)))")} END AS h
  FROM documents, {CRC_TABLE}
), planned AS (SELECT *, len(w) AS n, h // 10 % greatest(len(w), 1) AS a, 3 + h // 10 % 8 AS parts FROM given
), docs AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) ELSE w END AS w FROM planned
), words AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM docs
), equal AS (SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON y.r = x.r AND y.word = x.word AND y.i > x.i AND y.i - x.i <= x.n // 4
), islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal
), stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length
), best AS (SELECT r, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1
), listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r
), gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.i) AS collapsed FROM words ANTI JOIN gone ON gone.r = words.r AND gone.i = words.i GROUP BY words.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (r) LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_toxicity, op3_ann, op4_substring_dedup, op5_pii, op6_simhash, op7_decontamination, op8_secrets, op9_brown, op10_url_filter, op11_feistel_shards, op12_vector_codes, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op3_ann": OP3_SQL, "op7_decontamination": OP7_SQL, "op10_url_filter": OP10_SQL, "op11_feistel_shards": feistel_sql(), "op12_vector_codes": codes_sql(), "op13_periodic_runs": OP13_SQL}
