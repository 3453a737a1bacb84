"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a word may be separated by, in every operator that works on words: ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names; other columns (also clashing ones) are left behind."""
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def remainder(key: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of each Arrow batch; a null text counts as empty."""
    for b in batches:
        yield b.column("doc_id"), [t or "" for t in b.column("text").to_pylist()]


def mapped(docs: DataFrame, rows: Callable[[], Callable[[str], tuple]], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One output row per document, in one narrow pass.

    `rows` is called once per task and gives the function from a text to the values of `schema` (a Spark DDL string
    without the id). Memory holds one Arrow batch of texts and its results.
    """
    df = keyed_text(docs, key, text)
    ddl = f"doc_id long, {schema}"
    fields = df.sparkSession.createDataFrame([], ddl).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, of = to_arrow_schema(fields), rows()
        for ids, texts in text_batches(batches):
            for at in range(0, len(texts), 512):
                made = [of(t) for t in texts[at : at + 512]]
                cols = [pa.array(c, type=f.type) for c, f in zip(zip(*made), list(out)[1:])] if made else [pa.array([], type=f.type) for f in list(out)[1:]]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 512).cast(pa.int64()), *cols], schema=out)

    return df.mapInArrow(run, ddl)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as spark.checkpoint.dir names it; a temporary one only where that is unset and all run on this machine."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where and not sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc._jsc.sc().getCheckpointDir().get()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


#: Spark's setting by which a query's shuffle files go when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries made and run within leave no shuffle files: what they wrote to the shared folder needs none."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


#: Folders that are made within a `scratch`, the innermost last.
SCRATCH: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    at = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    for made in SCRATCH:
        made.append(at)
    return at


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write to the shared folder within go at its end: write their results elsewhere before.

    Checkpoints go by themselves where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    made: list[str] = []
    SCRATCH.append(made)
    try:
        yield
    finally:
        SCRATCH[:] = [m for m in SCRATCH if m is not made]
        deleted(spark, made)


def deleted(spark: SparkSession, folders: Iterable[str]) -> None:
    jvm = spark.sparkContext._jvm
    for folder in folders:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: each reading gives the same rows in the same order."""
    at = new_folder(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.select("*").write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def removed(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    deleted(spark, {p.rpartition("/")[0] for t in tables for p in t.inputFiles()})
