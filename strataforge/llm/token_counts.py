"""Token counts kept as rollups by signed deltas.

A rollup is a folder in shared storage:

    batches/<batch id>/    the batch's signed totals by source, lang and tokenizer version
    committed/<batch id>   an empty marker, renamed into place when the totals are whole
    base-<n>/              totals of the batches folded so far, with the list of their ids

A change row carries the document's counts before and after: an insert has none before, a
delete none after, a revision (of the text, of its source or language, or of a tokenizer
version) both. Its delta is +after at the new key and -before at the old one, so totals are
sums in any order, never rescans. A batch is aggregated before it is written; writing and
marking it again is a no-op, so a batch delivered twice or retried after a crash counts once.

Defined results: null source, lang or version are keys of their own; null or empty text has
0 tokens but counts as a document; keys whose documents and tokens are all 0 are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import token_files
from .common import free_shuffles, new_path

KEYS = ["source", "lang", "version"]
SUMS = ["documents", "tokens"]
CHANGES = "change string, doc_id long, source string, lang string, version string, tokens long"


def words(text: Column) -> Column:
    """Runs of characters other than space and 09 to 0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    """Byte tokens: one for each byte of UTF-8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def of_tokenizer(path: str) -> Callable[[Column], Column]:
    """Counts by a tokenizer file of the tokenizers library, without special tokens."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = token_files.encoder_for(path)
        for texts in batches:
            raw, sizes = [(t or "").encode() for t in texts], []
            for group in token_files.groups(raw, token_files.GROUP_BYTES):
                sizes.append(np.diff(encoder.encode(group)[1], prepend=0))
            yield pd.Series(np.concatenate(sizes) if sizes else np.zeros(0), dtype="int64")

    return count


TOKENIZERS = {"words-1": words, "bytes-1": utf8_bytes}


def counted(docs: DataFrame, tokenizers: dict | None = None) -> DataFrame:
    """doc_id, source, lang, version, tokens: a row for each document and tokenizer version.

    tokenizers maps a version to a function from the text column to a column of counts; a
    pandas UDF around any tokenizer will do. Every text is read once for all versions.
    """
    counts = [F.struct(F.lit(v).alias("version"), fn(F.col("text")).cast("long").alias("tokens")) for v, fn in (tokenizers or TOKENIZERS).items()]
    return docs.select("doc_id", "source", "lang", F.explode(F.array(*counts)).alias("c")).select("doc_id", "source", "lang", "c.version", "c.tokens")


def inserts(counts: DataFrame) -> DataFrame:
    return _signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    return _signed(counts, -1)


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """The old counts leave, the new ones enter; no join is needed."""
    return _signed(before, -1).unionByName(_signed(after, 1))


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("documents"), (F.col("tokens") * sign).alias("tokens"))


def _totals(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))


class Rollup:
    """Additive totals under a folder that driver and executors share."""

    SCHEMA = "source string, lang string, version string, documents long, tokens long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "token-counts")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder)))

    def committed(self) -> list[str]:
        """Ids of the batches that count, folded ones included."""
        return sorted({*self._names("committed"), *self._folded()[1]})

    def _folded(self) -> tuple[str | None, list[str]]:
        done = [n for n in self._names("") if n.startswith("base-") and self._fs.exists(self._at(f"{n}/ids/_SUCCESS"))]
        if not done:
            return None, []
        last = max(done, key=lambda n: int(n.split("-")[1]))
        return last, [r.value for r in self.spark.read.text(f"{self.path}/{last}/ids").collect()]

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds the batch's deltas once; False if the batch counts already.

        The totals are written to a folder of this attempt's own and renamed; the marker is
        created last. A crash in between leaves no marker, and the next attempt starts anew.
        """
        if not batch_id or "/" in batch_id or batch_id.startswith(("_", ".")):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if batch_id in self.committed():
            return False
        attempt = new_path(self.spark, "batch")
        _totals(deltas).coalesce(1).write.parquet(attempt)
        target = self._at(f"batches/{batch_id}")
        self._fs.delete(target, True)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._jvm.org.apache.hadoop.fs.Path(attempt), target):
            raise RuntimeError(f"batch {batch_id} could not be moved into place")
        self._fs.mkdirs(self._at("committed"))
        self._fs.create(self._at(f"committed/{batch_id}"), True).close()
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens over all committed batches."""
        base, folded = self._folded()
        paths = [f"{self.path}/batches/{b}" for b in self._names("committed") if b not in folded]
        paths += [f"{self.path}/{base}/totals"] if base else []
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return _totals(self.spark.read.schema(self.SCHEMA).parquet(*paths)).where("documents <> 0 or tokens <> 0")

    def fold(self) -> None:
        """Rewrites all committed batches as one base, so reads stay short. Ids stay known."""
        base, _ = self._folded()
        ids, n = self.committed(), int(base.split("-")[1]) + 1 if base else 0
        self.totals().coalesce(1).write.parquet(f"{self.path}/base-{n}/totals")
        self.spark.createDataFrame([(i,) for i in ids], "value string").coalesce(1).write.text(f"{self.path}/base-{n}/ids")
        free_shuffles(self.spark)


def maintained(docs: DataFrame, tokenizers: dict | None = None, path: str | None = None) -> DataFrame:
    """Totals of a history over the whole table: every document is inserted; those of ids
    divisible by 10 are deleted; those of ids that leave 1 move to source 'revised' with
    their text doubled; the first batch is delivered a second time."""
    rollup = Rollup(docs.sparkSession, path)
    counts = counted(docs.select("doc_id", "source", "lang", "text"), tokenizers)
    rollup.commit("0-insert", inserts(counts))
    rollup.commit("1-delete", deletes(counts.where("doc_id % 10 = 0")))
    changing = docs.select("doc_id", "source", "lang", "text").where("doc_id % 10 = 1")
    after = changing.withColumn("source", F.lit("revised")).withColumn("text", F.concat("text", F.lit(" "), "text"))
    rollup.commit("2-revise", revisions(counted(changing, tokenizers), counted(after, tokenizers)))
    rollup.commit("0-insert", inserts(counts))
    return rollup.totals()


def migrated(docs: DataFrame, old: dict, new: dict, path: str | None = None) -> DataFrame:
    """Totals after a change of tokenizer version: every document is counted by the old one,
    then those of ids that leave 2 divided by 10 are revised to the new one."""
    rollup = Rollup(docs.sparkSession, path)
    docs = docs.select("doc_id", "source", "lang", "text")
    rollup.commit("0-insert", inserts(counted(docs, old)))
    moving = docs.where("doc_id % 10 = 2")
    rollup.commit("1-migrate", revisions(counted(moving, old), counted(moving, new)))
    return rollup.totals()
