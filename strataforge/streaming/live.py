"""Changes as streams: views kept fresh, expiry, deduplication and caps, retention."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import changes, views


def follow(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A folder or file of change rows as a stream; the schema is the first files'."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


SEGMENTS = 16


def fast_view(stream: DataFrame, store: views.Store, name: str, keys: list[str], order: str, checkpoint: str, segments: int = SEGMENTS):
    """Keeps the last row of each key. A batch writes only a segment of its own last rows, whose
    note carries the batch number, so a batch that is run again changes nothing. Each `segments`
    batches the segments are merged into one whole version; those that it holds go once the
    next one is there, for the sake of readers. read_fast_view gives the view."""

    def merge(batch: DataFrame, number: int) -> None:
        done = _in_order(store.versions(name))
        if any(v.get("batch", -1) >= number for v in done):
            return
        store.write(name, changes.latest(batch, keys, order), batch=number, whole=not done)
        done = _in_order(store.versions(name))
        held = _held(done)
        if len(held) > segments:
            store.write(name, read_fast_view(store, name, keys, order), batch=number, whole=True)
            first = held[0]["version"]
            for old in (v for v in done if v["version"] < first):
                store.delete(name, old["version"])

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _in_order(versions: list[dict]) -> list[dict]:
    return sorted(versions, key=lambda v: v["version"])


def _held(versions: list[dict]) -> list[dict]:
    """The last whole version and the segments after it."""
    whole = [i for i, v in enumerate(versions) if v.get("whole", True)]
    return versions[whole[-1]:] if whole else versions


def read_fast_view(store: views.Store, name: str, keys: list[str], order: str) -> DataFrame:
    """The last row of each key over the whole version and the segments after it."""
    held = _held(_in_order(store.versions(name)))
    if not held:
        raise KeyError(name)
    parts = [store.read(name, v["version"]) for v in held]
    return parts[0] if len(parts) == 1 else changes.latest(reduce(DataFrame.unionByName, parts), keys, order)


def fast_view_of_events(spark: SparkSession, path: str, store: views.Store) -> DataFrame:
    """user_id, event_type, index: the last event of each user and type, by a stream."""
    folder = path.rsplit("/", 1)[0]
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else folder + "/" + "event[s].parquet")
    rows = stream.select(F.col("event_id").alias("index"), "user_id", "event_type")
    fast_view(rows, store, "events_view", ["user_id", "event_type"], "index", f"{store.root}/checkpoint").awaitTermination()
    return read_fast_view(store, "events_view", ["user_id", "event_type"], "index").select("user_id", "event_type", "index")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def alive_stream(stream: DataFrame, ttl: str) -> DataFrame:
    """Rows whose expiry isn't over when they arrive."""
    t = F.col(ttl)
    return stream.where(t.isNull() | (t == 0) | (t >= F.unix_timestamp()))


def decide_stream(stream: DataFrame, keys: list[str], seconds: str, limit: int | None = None, window: float | None = None, ttl: float | None = None, late: str = "1 hour") -> DataFrame:
    """Frequency cap and duplicate rule over a stream, hits in order of arrival within a batch
    by time. A key's state is the allowed times of its window and its last allowed hit; it is
    dropped when the watermark tells that neither can matter any more, so a replay or a slow
    source decides as the first run did. Hits later than `late` are left out; seconds are those
    since the epoch, above 0, where watermarks begin."""
    horizon = int(max(window or 0, ttl or 0) * 1000) + 1
    at = "at" + "_" * max(map(len, stream.columns))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, last = (json.loads(x) for x in state.get) if state.exists else ([], None)
        hits = pd.concat(list(frames)).sort_values(seconds, kind="stable")
        allowed, reasons = [], []
        for now in hits[seconds].tolist():
            reason = None
            if limit is not None:
                times = [t for t in times if t > now - window]
                if len(times) >= limit:
                    reason = "freq_cap"
                else:
                    times.append(now)
            if reason is None and ttl is not None:
                if last is not None and now < last + ttl:
                    reason = "duplicate"
                else:
                    last = now
            allowed.append(reason is None)
            reasons.append(reason)
        state.update((json.dumps(times), json.dumps(last)))
        held = max([*times, *([] if last is None else [last])], default=0)
        state.setTimeoutTimestamp(max(int(held * 1000) + horizon, state.getCurrentWatermarkMs() + 1))
        yield hits.drop(columns=at).assign(allowed=allowed, reason=reasons)

    from pyspark.sql.types import BooleanType, StringType, StructType

    out = StructType([*stream.schema.fields]).add("allowed", BooleanType()).add("reason", StringType())
    timed = stream.withColumn(at, F.timestamp_millis((F.col(seconds) * 1000).cast("long"))).withWatermark(at, late)
    return timed.groupBy(*keys).applyInPandasWithState(step, out, "times string, last string", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(stream: DataFrame, ts: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts by event-time window; rows later than `late` are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"))
