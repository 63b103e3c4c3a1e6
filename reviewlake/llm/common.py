"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one on one machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of a few numbers up to which a table is broadcast to a join, after it was counted.
FEW = 300_000

_staged: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and reread it: cuts lineage, survives lost executors, is computed once.

    The files stay until drop_stages, or until the block of scratch() that they belong to ends: results read them when they are asked for.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def also_staged(path: str) -> str:
    """A folder in the shared one that an operator fills itself: it goes with the others."""
    _staged.append(path)
    return path


def drop_stages(spark: SparkSession, since: int = 0, kept: tuple[str, ...] = ()) -> int:
    """Delete what this process has staged (since a count of folders), once its results are written; returns how many folders."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = [p for p in _staged[since:] if p not in kept]
    _staged[since:] = [p for p in _staged[since:] if p in kept]
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


def drop(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        at = _staged.index(df.staged_at)
        drop_stages(df.sparkSession, at, tuple(_staged[at + 1 :]))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is staged inside is deleted at the end, but for tables that are passed to the function given."""
    since, kept = len(_staged), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.staged_at)
        return df

    yield keep
    drop_stages(spark, since, tuple(kept))


def if_few(df: DataFrame, name: str) -> DataFrame:
    """df staged, to be broadcast where it has FEW rows at most: then the other side of a join isn't shuffled."""
    df = stage(df, name)
    return F.broadcast(df) if df.count() <= FEW else df


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Fewer rows to a Python worker at once, for what runs inside: its memory is bounded by a batch of long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def utf8(col: Column | str) -> Column:
    """Text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def text_key(col: str = "text") -> Column:
    """A hash of a text by which rows that share an id are told apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit(""))).alias("text_key")


def without_rows(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id (null equals null) and text aren't those of a rejected row. rejected: id_col, text_key."""
    gone = if_few(rejected.select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key")).distinct(), "rejected")
    return docs.join(gone, F.col(id_col).eqNullSafe(gone["_id"]) & (text_key(text_col) == gone["_key"]), "left_anti")


def crc_bucket(col: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo a number."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
