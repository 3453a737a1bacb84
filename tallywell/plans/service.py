"""Query keys of lists, lifecycle rules, names, geometry and monitoring documents, each with DuckDB SQL that shares no table with the code."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywell.functions import scalars as S
from tallywell.functions.arguments import count_column
from tallywell.operators import metrics as M
from tallywell.operators import store as O
from tallywell.plans.store import D, J, TOOLS, tools
from tallywell.plans.store import M as MEMBERS
from tallywell.sources import monitoring
from tallywell.sources import store as T
from tallywell.sources.events import table

NOW = datetime(1996, 1, 1)
HOURS = {"guest": 2, "free": 24, "pro": 720}


def reset_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reset tokens: id, user_id, expires_at."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("user_id"), F.col("o_orderdate").alias("expires_at"))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as folders: id, parent_id, name, deleted_at."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("parent_id"), F.col("n_name").alias("name"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))


def quads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column], list[Column]]:
    """Parts as quadrilaterals of many shapes, and their corners' columns."""
    p = table(spark, sf_dir, "part").select("p_partkey", *(((F.col("p_partkey") * k) % 97 / 100.0).alias(f"r{k}") for k in (3, 5, 7, 11)))
    x = [F.col("r3") / 3, 1 - F.col("r5") / 3, 1 - F.col("r7"), F.col("r11") / 4]
    y = [F.col("r5") / 3, F.col("r11") / 3, 1 - F.col("r3") / 3, 1 - F.col("r7")]
    return p, x, y


Q = """WITH p AS (SELECT p_partkey, (p_partkey * 3) % 97 / 100.0::DOUBLE AS a, (p_partkey * 5) % 97 / 100.0::DOUBLE AS b, (p_partkey * 7) % 97 / 100.0::DOUBLE AS c, (p_partkey * 11) % 97 / 100.0::DOUBLE AS d FROM part
), q AS (SELECT p_partkey, a / 3 AS x0, 1 - b / 3 AS x1, 1 - c AS x2, d / 4 AS x3, b / 3 AS y0, d / 3 AS y1, 1 - a / 3 AS y2, 1 - c AS y3 FROM p
), z AS (SELECT *, (x1-x0)*(y2-y1)-(y1-y0)*(x2-x1) AS t0, (x2-x1)*(y3-y2)-(y2-y1)*(x3-x2) AS t1, (x3-x2)*(y0-y3)-(y3-y2)*(x0-x3) AS t2, (x0-x3)*(y1-y0)-(y0-y3)*(x1-x0) AS t3 FROM q)"""


def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of the text format: samples with labels (one of them twice), a comment and a broken line."""
    n = F.col("p_partkey").cast("string")
    sample = F.concat(F.lit('jobs_total{queue="q'), (F.col("p_partkey") % 3).cast("string"), F.lit('",name="old",name="p'), n, F.lit('"} '), F.col("p_size").cast("string"))
    line = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("# HELP "), n)).when(F.col("p_partkey") % 7 == 0, F.lit("broken {")).otherwise(sample)
    return table(spark, sf_dir, "part").select(line.alias("value"))


def broker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as streams of monitoring documents, a document for each ten of them (a scrape): two accounts, the queue's own streams among others, of which some have two consumers and some none."""
    k = F.col("p_partkey")
    place = k % 10
    name = F.when(place == 2, "JOBS_DISPATCH").when(place == 3, "JOBS_EVENTS").when(place == 5, "JOBS_DLQ").when(place == 6, "ANALYTICS").otherwise(F.concat(F.lit("S"), place.cast("string")))
    state = F.struct((k * 3).alias("messages"), F.col("p_size").cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("first_seq"), k.alias("last_seq"), (k % 3).alias("consumer_count"))
    consumer = lambda i: F.struct(F.concat(F.lit("c"), F.lit(str(i))).alias("name"), (k % (4 + i)).alias("num_ack_pending"), (k % 2).alias("num_redelivered"), (k % (9 + i)).alias("num_pending"), F.lit(0).cast("bigint").alias("num_waiting"))
    consumers = F.slice(F.array(consumer(0), consumer(1)), F.lit(1), (k % 3).cast("int"))
    streams = table(spark, sf_dir, "part").select(F.floor(k / 10).alias("scrape"), (k % 2).alias("account"), F.struct(name.alias("name"), state.alias("state"), consumers.alias("consumer_detail")).alias("s"))
    accounts = streams.groupBy("scrape", "account").agg(F.collect_list("s").alias("stream_detail"))
    return accounts.groupBy("scrape").agg(F.collect_list(F.struct("stream_detail")).alias("account_details"))


#: s: scrape and stream of each part; c: its consumers.
B = """WITH s AS (
  SELECT p_partkey AS k, p_partkey // 10 AS scrape, CASE p_partkey % 10 WHEN 2 THEN 'JOBS_DISPATCH' WHEN 3 THEN 'JOBS_EVENTS' WHEN 5 THEN 'JOBS_DLQ' WHEN 6 THEN 'ANALYTICS' ELSE 'S' || p_partkey % 10 END AS stream FROM part
), c AS (SELECT *, 'c' || i AS consumer, k % (4 + i) AS ack_pending, k % 2 AS redelivered, k % (9 + i) AS pending FROM s, (VALUES (0), (1)) AS n(i) WHERE i < k % 3)"""


def server_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the broker's documents of itself; some are broken, or lack a field, or have one of another type."""
    k = F.col("s_suppkey").cast("string")
    cpu = F.when(F.col("s_suppkey") % 5 == 0, '"high"').when(F.col("s_suppkey") % 3 == 0, "null").otherwise(F.concat(k, F.lit(".25")))
    text = F.concat(F.lit('{"server_id":"N'), k, F.lit('","other":[1],"version":"2.'), k, F.lit('","connections":'), k, F.lit(',"total_connections":12345678901,"cpu":'), cpu, F.lit(',"uptime":"'), k, F.lit('h"}'))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, "{broken").otherwise(text).alias("value"))


def argument() -> Column:
    """Parts as arguments of requests, most of them odd."""
    k = F.col("p_partkey").cast("string")
    return F.element_at(F.array(k, F.concat(F.lit("-"), k), F.lit(""), F.lit(None).cast("string"), F.concat(k, F.lit(" ")), F.concat(F.lit("0"), k), F.lit("0"), F.concat(k, F.lit("00000000000")), F.concat(F.lit("\u0663"), k), F.concat(k, F.lit("\n"))), (F.col("p_partkey") % 10 + 1).cast("int"))


def heads() -> Column:
    """First bytes of files of seven kinds."""
    starts = ["255044462D312E37", "504B030414", "89504E470D0A1A0A00", "FFD8FFE0", "52494646AABBCCDD5745425056503820", "25504446", ""]
    return F.unhex(F.element_at(F.array(*map(F.lit, starts)), (F.col("o_orderkey") % 7 + 1).cast("int")))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    service = F.element_at(F.array(*map(F.lit, ("convert-to-pdf", "analytics", "organize-pdf", "document"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), service.alias("service"))


def size() -> Column:
    return F.col("p_size").cast("string")


KEYS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "dml_reset_tokens": (lambda s, d: O.without_reset_tokens(reset_tokens(s, d), NOW, 7), "SELECT o_orderkey AS id, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END AS user_id, o_orderdate AS expires_at FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND NOT (o_custkey = 7)"),
    "dml_replace_output": (
        lambda s, d: O.replaced_outputs(T.files(s, d), T.jobs(s, d).where("id % 3 = 0").select(F.col("id").alias("job_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("new/"), F.col("id").cast("string"))).alias("path"))),
        f"{J}, n AS (SELECT id FROM j WHERE id % 6 = 0) SELECT job_id, kind, path FROM f WHERE kind <> 'output' OR job_id NOT IN (SELECT id FROM n) UNION ALL SELECT id, 'output', 'new/' || id FROM n",
    ),
    "dml_delete_folder": (lambda s, d: O.folders_after_delete(folders(s, d), "FRANCE", NOW), "SELECT n_nationkey AS id, n_regionkey AS parent_id, n_name AS name, CASE WHEN n_name = 'FRANCE' THEN TIMESTAMP '1996-01-01' END AS deleted_at FROM nation"),
    "list_folders": (lambda s, d: O.by_name(folders(s, d), 3).select("id", "name"), "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 3 ORDER BY name"),
    "list_tags": (
        lambda s, d: O.by_name(T.document_tags(s, d).groupBy(F.col("tag").alias("name")).agg(F.min("document_id").alias("id"))),
        f"{D} SELECT tag AS name, min(document_id) AS id FROM t GROUP BY tag ORDER BY tag",
    ),
    "list_exports": (
        lambda s, d: O.paged(T.jobs(s, d).where("user_id = 1").select("id", "status", "created_at"), O.newest(), 1, 20, 20),
        f"{J} SELECT id, status, created_at FROM j WHERE user_id = 1 ORDER BY created_at DESC, id DESC LIMIT 20",
    ),
    "page_orgs": (
        lambda s, d: O.paged(O.org_members(T.memberships(s, d).withColumn("user_id", F.col("user_id") % 10), T.organizations(s, d), 3), [F.col("organization_id"), F.col("role"), F.col("name")], 2, 25, 100),
        f"{MEMBERS} SELECT organization_id, n_name AS name, role FROM m JOIN nation ON n_nationkey = organization_id WHERE user_id % 10 = 3 ORDER BY organization_id, role, name LIMIT 25 OFFSET 25",
    ),
    "page_members": (
        lambda s, d: O.paged(T.memberships(s, d).where("organization_id = 4"), [F.col("user_id")], 1, 250, 100),
        f"{MEMBERS} SELECT * FROM m WHERE organization_id = 4 ORDER BY user_id LIMIT 100",
    ),
    "job_expiry": (
        lambda s, d: T.jobs(s, d).select("id", O.job_expiry(F.col("user_id"), F.when(F.col("user_id") % 2 == 0, "pro").when(F.col("user_id") % 3 == 0, "free"), F.col("created_at"), HOURS).alias("expires_at")),
        f"{J} SELECT id, created_at + to_hours(CASE WHEN user_id IS NULL THEN 2 WHEN user_id % 2 = 0 THEN 720 ELSE 24 END) AS expires_at FROM j",
    ),
    "dlq_redrive": (lambda s, d: O.redriven(letters(s, d), 101), "SELECT count(*) FILTER (WHERE o_orderkey % 4 IN (0, 2)) AS redriven, count(*) FILTER (WHERE o_orderkey % 4 IN (1, 3)) AS skipped FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 101)"),
    "plan_price_parse": (
        lambda s, d: table(s, d, "part").select("p_partkey", *(F.try_element_at(S.plan_prices(F.concat(F.lit("free=0, pro = "), size(), F.lit(",bad,=3,Pro=-1.5,a=1=2,free=.5,x=1d"))), F.lit(n)).alias(f"price_{i}") for i, n in enumerate(("free", "pro", "Pro", "a", "x")))),
        "SELECT p_partkey, 0.5::DOUBLE AS price_0, p_size::DOUBLE AS price_1, -1.5::DOUBLE AS price_2, NULL::DOUBLE AS price_3, NULL::DOUBLE AS price_4 FROM part",
    ),
    "validate_ext": (
        lambda s, d: tools(s, d).where("tool <> '' AND tool NOT IN ('pdf-to-docx', 'pdf-to-xlsx', 'pdf-to-ppt', 'pdf-to-pptx', 'pdf-to-img', 'pdf-to-txt')").select("o_orderkey", S.valid_file(F.col("tool"), F.col("name")).alias("valid")),
        rf"""{TOOLS}, e AS (SELECT *, lower(regexp_extract(name, '\.[^./]*$')) AS e FROM x WHERE tool <> '' AND tool NOT IN ('pdf-to-docx', 'pdf-to-xlsx', 'pdf-to-ppt', 'pdf-to-pptx', 'pdf-to-img', 'pdf-to-txt'))
SELECT o_orderkey, CASE WHEN tool LIKE 'word-to-%' THEN e IN ('.doc', '.docx') WHEN tool LIKE 'excel-to-%' THEN e IN ('.xls', '.xlsx') WHEN tool LIKE 'powerpoint-to-%' THEN e IN ('.ppt', '.pptx') WHEN tool = 'image-to-pdf' THEN e IN ('.png', '.jpg', '.jpeg', '.webp')
  WHEN tool = 'scan-to-pdf' THEN e IN ('.png', '.jpg', '.jpeg', '.webp', '.pdf') WHEN tool IN ('odt-to-pdf', 'ods-to-pdf', 'odp-to-pdf') THEN e = '.' || substr(tool, 1, 3) WHEN tool IN ('html-to-pdf', 'ppt-to-pdf', 'img-to-pdf', ' img-to-pdf ', 'other') THEN true ELSE e = '.pdf' END AS valid FROM e""",
    ),
    "doc_name": (
        lambda s, d: table(s, d, "part").select("p_partkey", S.document_name(F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("out/"), F.col("p_name"), F.lit(".PDF"))), F.when(F.col("p_partkey") % 2 == 0, "merge-pdf").otherwise("")).alias("name"), S.file_ext(F.concat(F.col("p_name"), F.lit(".PDF"))).alias("ext")),
        "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name || '.PDF' WHEN p_partkey % 2 = 0 THEN 'merge-pdf output' ELSE 'Processed document' END AS name, 'pdf' AS ext FROM part",
    ),
    "classify_error": (
        lambda s, d: table(s, d, "part").select("p_partkey", S.classify_error(F.concat(F.element_at(F.array(*map(F.lit, ("Context DEADLINE exceeded", "read Timeout", "exit status "))), (F.col("p_partkey") % 3 + 1).cast("int")), size())).alias("code")),
        "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'CONVERSION_FAILED' ELSE 'TIMEOUT' END AS code FROM part",
    ),
    "format_duration": (
        lambda s, d: table(s, d, "part").select("p_partkey", S.format_duration(F.col("p_partkey") * 613).alias("text")),
        "SELECT p_partkey, CASE WHEN s >= 86400 THEN s // 86400 || 'd ' || s % 86400 // 3600 || 'h ' || s % 3600 // 60 || 'm' WHEN s >= 3600 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm' ELSE s // 60 || 'm' END AS text FROM (SELECT p_partkey, p_partkey * 613 AS s FROM part)",
    ),
    "compression_ratio": (
        lambda s, d: table(s, d, "part").select("p_partkey", S.compression_ratio(F.col("p_partkey") % 8 * 64, F.col("p_size")).alias("text")),
        "SELECT p_partkey, printf('%.2f%%', CASE WHEN p_partkey % 8 > 0 THEN (p_partkey % 8 * 64 - p_size) * 100.0::DOUBLE / (p_partkey % 8 * 64) ELSE 0.0::DOUBLE END) AS text FROM part",
    ),
    "ocr_language": (
        lambda s, d: table(s, d, "part").select("p_partkey", S.ocr_language(F.element_at(F.array(*map(F.lit, ("de", " fra ", "zh", "xx", "eng", "jpn"))), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("language")),
        "SELECT p_partkey, (['deu', 'fra', 'chi_sim', 'eng', 'eng', 'jpn'])[p_partkey % 6 + 1] AS language FROM part",
    ),
    "part_numbers": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(F.transform(S.part_numbers(F.concat(F.lit("1, "), size(), F.when(F.col("p_partkey") % 4 == 0, ",x").otherwise("")), F.lit(30)), lambda v: v.cast("string")), " ").alias("parts")),
        "SELECT p_partkey, CASE WHEN p_size <= 30 AND p_size >= 1 AND p_partkey % 4 <> 0 THEN '1 ' || p_size END AS parts FROM part",
    ),
    "cache_conversion": (
        lambda s, d: table(s, d, "part").select("p_partkey", S.cache_key(F.col("p_brand"), F.lit("{}"), F.array(F.concat(F.lit("b"), size()), F.lit("a"))).alias("key")),
        "SELECT p_partkey, sha256(p_brand || chr(0) || '{}' || chr(0) || 'a' || chr(0) || 'b' || p_size || chr(0)) AS key FROM part",
    ),
    "quad_geometry": (
        lambda s, d: (lambda p, x, y: p.select("p_partkey", F.round(S.quad_area(x, y), 9).alias("area"), S.quad_convex(x, y).alias("convex"), F.round(S.quad_angles(x, y)[0], 6).alias("angle")))(*quads(s, d)),
        f"""{Q} SELECT p_partkey, round(abs(x0*y1-x1*y0 + x1*y2-x2*y1 + x2*y3-x3*y2 + x3*y0-x0*y3) / 2, 9) AS area, least(t0, t1, t2, t3) >= 1e-12 OR greatest(t0, t1, t2, t3) <= -1e-12 AS convex,
  round(abs(degrees(atan2((x3-x0)*(y1-y0)-(y3-y0)*(x1-x0), (x3-x0)*(x1-x0)+(y3-y0)*(y1-y0)))), 6) AS angle FROM z""",
    ),
    "ordered_corners": (
        lambda s, d: (lambda p, x, y: p.select("p_partkey", S.ordered_corners(F.array(*(F.struct(x[i].alias("x"), y[i].alias("y")) for i in (2, 0, 3, 1)))).alias("c")).select("p_partkey", F.col("c.tl.x").alias("tl"), F.col("c.tr.x").alias("tr"), F.col("c.br.x").alias("br"), F.col("c.bl.x").alias("bl")))(*quads(s, d)),
        f"""{Q} SELECT p_partkey, arg_min(x, (x + y, n)) AS tl, arg_max(x, (x - y, -n)) AS tr, arg_max(x, (x + y, -n)) AS br, arg_min(x, (x - y, n)) AS bl
FROM (SELECT p_partkey, unnest([x2, x0, x3, x1]) AS x, unnest([y2, y0, y3, y1]) AS y, unnest([1, 2, 3, 4]) AS n FROM z) GROUP BY p_partkey""",
    ),
    "src_prom_text": (
        lambda s, d: monitoring.samples(metric_lines(s, d)).select("metric", F.col("labels")["queue"].alias("queue"), F.col("labels")["name"].alias("name"), "value"),
        "SELECT 'jobs_total' AS metric, 'q' || p_partkey % 3 AS queue, 'p' || p_partkey AS name, p_size::DOUBLE AS value FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0",
    ),
    "nats_flatten": (
        lambda s, d: M.nats_consumers(broker(s, d)),
        f"{B} SELECT scrape, stream, consumer, ack_pending AS num_ack_pending, redelivered AS num_redelivered, pending AS num_pending, 0::BIGINT AS num_waiting FROM c",
    ),
    "multi_key_sort": (
        lambda s, d: M.nats_consumers(broker(s, d)).select("scrape", "stream", "consumer", F.row_number().over(Window.partitionBy("scrape").orderBy("stream", F.desc("num_pending"), "consumer")).cast("long").alias("place")),
        f"{B} SELECT scrape, stream, consumer, row_number() OVER (PARTITION BY scrape ORDER BY stream, pending DESC, consumer) AS place FROM c",
    ),
    "nats_streams": (
        lambda s, d: M.nats_streams(broker(s, d)),
        f"{B} SELECT scrape, stream, k * 3 AS messages, p_size::BIGINT AS bytes, 1::BIGINT AS first_seq, k AS last_seq, k % 3 AS consumer_count FROM s JOIN part ON p_partkey = k",
    ),
    "queue_snapshot": (
        lambda s, d: M.queue_snapshot(broker(s, d)),
        f"{B} SELECT scrape, stream, CAST(sum(pending) AS BIGINT) AS pending, CAST(sum(ack_pending) AS BIGINT) AS ack_pending, CAST(sum(redelivered) AS BIGINT) AS redelivered FROM c GROUP BY scrape, stream",
    ),
    "nats_summary": (
        lambda s, d: M.nats_summary(broker(s, d)),
        f"{B} SELECT scrape, count(*) AS total_streams, CAST(sum(k * 3) AS BIGINT) AS total_messages, CAST(coalesce(sum(k * 3) FILTER (WHERE stream = 'JOBS_DLQ'), 0) AS BIGINT) AS dlq_depth FROM s GROUP BY scrape",
    ),
    "dispatch_consumers": (lambda s, d: M.dispatch_consumers(broker(s, d)), f"{B} SELECT scrape, consumer AS name, pending, ack_pending, redelivered FROM c WHERE stream = 'JOBS_DISPATCH'"),
    "queue_health": (
        lambda s, d: M.queue_health(broker(s, d)),
        f"""{B}, l AS (SELECT scrape, CAST(sum(pending) FILTER (WHERE stream = 'ANALYTICS') AS BIGINT) AS ap, CAST(sum(ack_pending) FILTER (WHERE stream = 'ANALYTICS') AS BIGINT) AS aa, CAST(sum(pending) FILTER (WHERE stream = 'JOBS_EVENTS') AS BIGINT) AS jp,
  CAST(sum(ack_pending) FILTER (WHERE stream = 'JOBS_EVENTS') AS BIGINT) AS ja FROM c GROUP BY scrape), x AS (SELECT scrape, max(k * 3) FILTER (WHERE stream = 'JOBS_DLQ') AS dead FROM s GROUP BY scrape)
SELECT scrape, coalesce(dead, 0) AS dead_letters, coalesce(ap, 0) AS analytics_pending, coalesce(aa, 0) AS analytics_ack_pending, coalesce(jp, 0) AS job_events_pending, coalesce(ja, 0) AS job_events_ack_pending FROM x LEFT JOIN l USING (scrape)""",
    ),
    "src_nats_server": (
        lambda s, d: monitoring.documents(server_lines(s, d), monitoring.SERVER),
        """SELECT s_suppkey, CASE WHEN ok THEN 'N' || s_suppkey END AS server_id, CASE WHEN ok THEN '2.' || s_suppkey END AS version, CASE WHEN ok THEN s_suppkey::INTEGER END AS connections, CASE WHEN ok THEN 12345678901::BIGINT END AS total_connections, NULL::BIGINT AS mem,
  CASE WHEN ok AND s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0 THEN s_suppkey + 0.25::DOUBLE END AS cpu, NULL::BIGINT AS slow_consumers, CASE WHEN ok THEN s_suppkey || 'h' END AS uptime FROM (SELECT s_suppkey, s_suppkey % 7 <> 0 AS ok FROM supplier)""",
    ),
    "dlq_put_back": (
        lambda s, d: O.oldest_letters(letters(s, d), 101),
        "SELECT o_orderkey AS seq, (['convert-to-pdf', 'analytics', 'organize-pdf', 'document'])[o_orderkey % 4 + 1] AS service, o_orderkey % 2 = 0 AS again FROM orders ORDER BY o_orderkey LIMIT 101",
    ),
    "dlq_left": (
        lambda s, d: O.letters_left(letters(s, d), 501),
        "SELECT o_orderkey AS seq, (['convert-to-pdf', 'analytics', 'organize-pdf', 'document'])[o_orderkey % 4 + 1] AS service FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50))",
    ),
    "arg_parse": (
        lambda s, d: table(s, d, "part").select("p_partkey", count_column(argument(), 50, 200).alias("count")),
        "SELECT p_partkey, CAST(CASE WHEN p_partkey = 0 THEN 50 ELSE CASE p_partkey % 10 WHEN 0 THEN least(p_partkey, 200) WHEN 5 THEN least(p_partkey, 200) ELSE 50 END END AS INTEGER) AS count FROM part",
    ),
    "output_type": (
        lambda s, d: tools(s, d).select("o_orderkey", S.output_type(F.col("tool"), F.when(F.col("o_orderkey") % 2 == 0, '{"outputExt":".png"}').when(F.col("o_orderkey") % 3 == 0, '{"outputExt":".gif"}')).alias("type")),
        f"""{TOOLS} SELECT o_orderkey, CASE WHEN tool = 'pdf-to-word' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN tool = 'pdf-to-excel' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
  WHEN tool = 'pdf-to-powerpoint' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation' WHEN tool = 'pdf-to-image' AND o_orderkey % 2 = 0 THEN 'image/png' WHEN tool IN ('pdf-to-image', 'split-pdf', 'pdf-to-html') THEN 'application/zip'
  WHEN tool = 'pdf-to-text' THEN 'text/plain; charset=utf-8' WHEN tool LIKE '%-to-odt' THEN 'application/vnd.oasis.opendocument.text' WHEN tool LIKE '%-to-ods' THEN 'application/vnd.oasis.opendocument.spreadsheet'
  WHEN tool LIKE '%-to-odp' THEN 'application/vnd.oasis.opendocument.presentation' ELSE 'application/pdf' END AS type FROM x""",
    ),
    "mime_category": (
        lambda s, d: tools(s, d).select("o_orderkey", S.input_category(F.col("tool")).alias("category"), S.valid_head(F.col("tool"), heads()).alias("valid")),
        f"""{TOOLS}, y AS (SELECT o_orderkey, o_orderkey % 7 AS h, CASE WHEN tool IN ('image-to-pdf', 'scan-to-pdf') THEN 'image' WHEN tool LIKE 'word-to-%' THEN 'word' WHEN tool LIKE 'excel-to-%' THEN 'excel' WHEN tool LIKE 'powerpoint-to-%' THEN 'ppt'
  WHEN tool IN ('odt-to-pdf', 'ods-to-pdf', 'odp-to-pdf') THEN substr(tool, 1, 3) WHEN tool IN ('', 'pdf-to-docx', 'pdf-to-xlsx', 'pdf-to-ppt', 'pdf-to-pptx', 'pdf-to-img', 'pdf-to-txt', 'html-to-pdf', 'ppt-to-pdf', 'img-to-pdf', ' img-to-pdf ', 'other') THEN '' ELSE 'pdf' END AS category
FROM x)
SELECT o_orderkey, category, CASE category WHEN '' THEN true WHEN 'pdf' THEN h = 0 WHEN 'image' THEN h IN (2, 3, 4) ELSE h = 1 END AS valid FROM y""",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: run for k, (run, _) in KEYS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in KEYS.items()}
