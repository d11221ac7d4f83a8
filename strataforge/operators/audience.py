"""Deduplication with a time to live, sliding-window frequency caps, and reach.

Whether a hit is allowed depends on the hits allowed before it, so each (scope, key) is one
ordered fold. No state outlives a gap of the longer of both rules, so a key's time line is cut
at such gaps and its pieces are dealt to different tasks. Hits are sorted within the tasks, and
the fold runs over the sorted stream with one key's state at a time: a deque of at most `limit`
times, so memory doesn't grow with a key's hits.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import candidates


@dataclass(frozen=True)
class Rules:
    """Seconds and counts; a rule that is None doesn't apply. The cap is tried first, and its
    hit stays spent even if the duplicate rule then refuses."""

    ttl: float | None = None
    limit: int | None = None
    window: float | None = None


def _dealt(hits: DataFrame, keys: list[str], seconds: str, rules: Rules) -> DataFrame:
    """hits by key and piece of its time line. Gaps are looked for between cells as wide as the
    longer rule: hits are aggregated to one row a key and cell first, so a busy key brings no
    more rows to a task than it has cells."""
    wide = max(rules.ttl or 0, (rules.window or 0) if rules.limit is not None else 0)
    if wide <= 0:
        return hits.repartition(*keys)
    names = [f"{n}{'_' * max(map(len, hits.columns))}" for n in ("cell", "piece", *(f"key{i}" for i in range(len(keys))))]
    cell, piece, renamed = names[0], names[1], names[2:]
    placed = hits.withColumn(cell, F.floor(F.col(seconds) / F.lit(wide)))
    cells = placed.groupBy(*(F.col(k).alias(r) for k, r in zip(keys, renamed)), cell).agg(F.min(seconds).alias("first"), F.max(seconds).alias("last"))
    line = Window.partitionBy(*renamed).orderBy(cell)
    before = F.lag("last").over(line)
    cut = F.coalesce((before <= F.col("first") - F.lit(wide)) & (F.col("first") >= before + F.lit(wide)), F.lit(False))
    pieces = cells.withColumn("cut", cut.cast("int")).select(*renamed, F.col(cell).alias(f"{cell}_"), F.sum("cut").over(line).alias(piece))
    same = F.col(cell).eqNullSafe(F.col(f"{cell}_"))
    for k, r in zip(keys, renamed):
        same = same & F.col(k).eqNullSafe(F.col(r))
    return placed.join(pieces, same).repartition(*keys, piece).select(*hits.columns)


def decide(hits: DataFrame, keys: list[str], order: list[str], seconds: str, rules: Rules) -> DataFrame:
    """hits with allowed and reason (freq_cap or duplicate, else null).

    order breaks ties of time; seconds is a numeric time column. Null keys are keys.
    """
    columns = hits.columns
    n_keys, at = [columns.index(k) for k in keys], columns.index(seconds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, times = object(), None, deque()
        for batch in batches:
            allowed, reasons = [], []
            for key, now in zip(zip(*(batch.column(i).to_pylist() for i in n_keys)), batch.column(at).to_pylist()):
                if key != current:
                    current, last, times = key, None, deque()
                reason = None
                if rules.limit is not None:
                    while times and times[0] <= now - rules.window:
                        times.popleft()
                    if len(times) >= rules.limit:
                        reason = "freq_cap"
                    else:
                        times.append(now)
                if reason is None and rules.ttl is not None:
                    if last is not None and now < last + rules.ttl:
                        reason = "duplicate"
                    else:
                        last = now
                allowed.append(reason is None)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_()), pa.array(reasons, pa.string())], [*batch.schema.names, "allowed", "reason"])

    from pyspark.sql.types import BooleanType, StringType, StructType

    schema = StructType([*hits.schema.fields]).add("allowed", BooleanType()).add("reason", StringType())
    dealt = _dealt(hits, keys, seconds, rules).sortWithinPartitions(*keys, seconds, *order)
    return dealt.mapInArrow(run, schema)


def dedup(hits: DataFrame, keys: list[str], order: list[str], seconds: str, ttl: float) -> DataFrame:
    """A hit is allowed unless one was allowed less than ttl seconds before it."""
    return decide(hits, keys, order, seconds, Rules(ttl=ttl))


REQUEST_SECONDS = 60.0


def fresh_requests(requests: DataFrame, request_id: str, order: list[str], seconds: str, life: float = REQUEST_SECONDS) -> DataFrame:
    """Requests to carry out: those whose id wasn't carried out less than life seconds before.
    A null id is never a repetition."""
    named = requests.where(F.col(request_id).isNotNull())
    fresh = dedup(named, [request_id], order, seconds, life).where("allowed").select(*requests.columns)
    return fresh.unionByName(requests.where(F.col(request_id).isNull()))


def freq_cap(hits: DataFrame, keys: list[str], order: list[str], seconds: str, limit: int, window: float) -> DataFrame:
    """A hit is allowed if fewer than limit were allowed in the window before it."""
    return decide(hits, keys, order, seconds, Rules(limit=limit, window=window))


def sweep(state: DataFrame, expires: str, now: float) -> DataFrame:
    """State rows that still hold at now."""
    return state.where(F.col(expires) > now)


def select(df: DataFrame, lat: str, lon: str, centre: tuple[float, float], metres: float, **options) -> DataFrame:
    return candidates.geo_audience(df, lat, lon, centre, metres, **options)


def reach(audience: DataFrame, key: str, precision: int = 14) -> DataFrame:
    """Estimated distinct members."""
    return audience.agg(F.hll_sketch_estimate(F.hll_sketch_agg(key, precision)).alias("reach"))
