"""Shared plumbing: table access, lineage cuts in the cluster's shared folder, bounded label samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a trailing slash.

    It is spark.checkpoint.dir. Only where that is unset, and the master is local, a
    temporary folder takes its place; on a cluster an unset folder is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="strataforge-")
        spark.conf.set("spark.checkpoint.dir", at)
    return (at if "://" in at or at.startswith("file:") else "file://" + at).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder; returns the table read back, and its path."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the context cleaner drop shuffle files of finished, unreferenced plans."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def crc_fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(modulus))


def binary_values(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def trim() -> None:
    """Gives freed memory back: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """mapInArrow with one result table for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out.to_batches()
                out = batch = None
        trim()

    return df.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows_per_class: int, max_doc_bytes: int) -> tuple[list[tuple[int, int, str]], dict[int, int]]:
    """A bounded training sample and the number of labelled rows of either class.

    Of each class the rows_per_class smallest ids by hash are taken; labelled texts over
    max_doc_bytes are left out of it (whole texts are learnt from, never prefixes). The
    result goes to the driver: at most 2 * rows_per_class * max_doc_bytes bytes. A doc_id
    with several labels counts with its largest one. Null labels, ids and texts are ignored.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    counts = {int(r.y): int(r.n) for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(17))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(rows_per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = (
        docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= max_doc_bytes))
        .join(F.broadcast(picked), "doc_id")
        .select("doc_id", "y", "text").collect()
    )
    rows = sorted(((r.doc_id, r.y, r.text) for r in rows), key=lambda r: (r[0], r[2]))
    return rows, counts
