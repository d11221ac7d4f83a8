"""Writes as change rows: snapshots, prior images, conditions, counters, streams, TTL, PITR.

A changelog is a table (index, ts, op, keys, attributes); everything else is derived from
it: the current table is each key's last row, the prior image is a lag, a stream view is a
projection, point-in-time recovery is a snapshot with the changes up to a target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import expressions

PUT, DELETE = "put", "delete"


def latest(changes: DataFrame, keys: list[str], order: str | list[str] = "index") -> DataFrame:
    """The last change of each key. max_by aggregates before the shuffle, which a window
    would not, so a hot key costs a row for each task."""
    order = [order] if isinstance(order, str) else order
    rest = [c for c in changes.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return changes.groupBy(*keys).agg(best.alias("_r")).select(*(F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in changes.columns))


def snapshot(changes: DataFrame, keys: list[str], order: str | list[str] = "index") -> DataFrame:
    """The table after all changes: last write wins, deleted keys are gone."""
    return latest(changes, keys, order).where(F.col("op") == PUT)


def upsert(base: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Items replace the rows of their keys. Items must have each key once."""
    return base.join(items.select(*keys), keys, "left_anti").unionByName(items, allowMissingColumns=True)


def delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys), keys, "left_anti")


def put_if(base: DataFrame, items: DataFrame, keys: list[str], condition: str, binds: dict | None = None) -> DataFrame:
    """Items whose condition holds on the row they would replace; without such a row every
    attribute counts as missing."""
    prior = base.select(*keys, *(F.col(c).alias(c) for c in base.columns if c not in keys))
    have = items.select(*keys, F.struct(*items.columns).alias("_item"))
    joined = have.join(prior.withColumn("_found", F.lit(True)), keys, "left")
    # a key that isn't stored is missing too
    joined = joined.select("_item", *(F.when(F.col("_found"), F.col(k)).alias(k) for k in keys), *(c for c in base.columns if c not in keys))
    return joined.where(expressions.condition(condition, base.schema, binds)).select("_item.*")


def put_new(base: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """IF NOT EXISTS."""
    return items.join(base.select(*keys), keys, "left_anti")


def put_existing(base: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """IF EXISTS."""
    return items.join(base.select(*keys), keys, "left_semi")


def guard_counters(items: DataFrame, counters: list[str]) -> None:
    """Counters change by atomic updates only."""
    held = sorted(set(counters) & set(items.columns))
    if held:
        raise ValueError(f"counter columns can't be written: {', '.join(held)}")


# ---- updates of attributes

def plus(column: str, amount, sign: int = 1) -> Column:
    """SET c = c + n: a missing base is 0."""
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0)) + F.lit(float(amount) * sign)


def list_append(column: str, element) -> Column:
    """One element at the end; a missing list is empty."""
    return F.when(F.col(column).isNull(), F.array(F.lit(element))).otherwise(F.array_append(column, F.lit(element)))


def list_prepend(column: str, element) -> Column:
    return F.when(F.col(column).isNull(), F.array(F.lit(element))).otherwise(F.array_prepend(column, F.lit(element)))


def set_remove(column: str, member) -> Column:
    return F.array_remove(column, F.lit(member))


def update(base: DataFrame, where: Column, assignments: dict[str, Column | None], keys: list[str], counters: list[str] = ()) -> DataFrame:
    """Rows that match get new attributes, None removes one; keys and counters can't be set."""
    fixed = sorted((set(keys) | set(counters)) & set(assignments))
    if fixed:
        raise ValueError(f"can't be updated: {', '.join(fixed)}")
    out = {}
    for name, new in assignments.items():
        old = F.col(name) if name in base.columns else F.lit(None)
        out[name] = F.when(where, F.lit(None) if new is None else new).otherwise(old)
    return base.withColumns(out)


def atomic(base: DataFrame, actions: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """keys, before, after of a counter under many additions: one aggregate by key and one
    join, keys that don't exist are created. actions: keys, request_id, amount; a request id
    counts once."""
    once = actions.dropDuplicates(["request_id"]).groupBy(*keys).agg(F.sum("amount").alias("_add"))
    joined = once.join(base.select(*keys, F.col(counter).alias("_old")), keys, "left")
    before = F.coalesce(F.col("_old").cast("double"), F.lit(0.0))
    return joined.select(*keys, before.alias("before"), (before + F.col("_add")).alias("after"))


def apply_in_order(row: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """Ordered (attribute, expression) actions; each sees what the ones before it made."""
    return reduce(lambda df, s: df.withColumn(s[0], expressions.arithmetic(s[1], df.schema)), steps, row)


class TransactionCancelled(ValueError):
    pass


MAX_TRANSACTION = 100


def transact(base: DataFrame, keys: list[str], puts: list[DataFrame] = (), deletes: list[DataFrame] = (), checks: list[tuple[DataFrame, str]] = ()) -> DataFrame:
    """All or nothing: every check's condition must hold on its key's row, a missing row
    having no attributes. The checks are one small aggregate; a failure raises."""
    failed = []
    for n, (key, text) in enumerate(checks):
        found = key.select(*keys).join(base.withColumn("_found", F.lit(True)), keys, "left")
        seen = found.select(*(F.when(F.col("_found"), F.col(c)).alias(c) for c in base.columns))
        failed.append(seen.where(~expressions.condition(text, base.schema)).select(F.lit(n).alias("check")))
    if failed:
        bad = reduce(DataFrame.unionByName, failed).limit(MAX_TRANSACTION).collect()
        if bad:
            raise TransactionCancelled(f"checks {sorted({r.check for r in bad})} failed")
    out = base
    for p in puts:
        out = upsert(out, p, keys)
    for d in deletes:
        out = delete(out, d, keys)
    return out


# ---- streams

VIEW_TYPES = ("KEYS_ONLY", "NEW_IMAGE", "OLD_IMAGE", "NEW_AND_OLD_IMAGES", "DELTA_IMAGE")


def with_prior(changes: DataFrame, keys: list[str], order: str = "index") -> DataFrame:
    """Each change with the image before it (old) and after it (new), and its kind: INSERT,
    MODIFY or REMOVE; null for a delete of nothing, which is no stream record."""
    attributes = [c for c in changes.columns if c not in (*keys, order, "ts", "op")]
    new = F.when(F.col("op") == PUT, F.struct(*attributes))
    w = Window.partitionBy(*keys).orderBy(order)
    out = changes.withColumn("new", new)
    out = out.withColumn("old", F.lag("new").over(w))
    kind = F.when((F.col("op") == PUT) & F.col("old").isNull(), "INSERT").when(F.col("op") == PUT, "MODIFY").when(F.col("old").isNotNull(), "REMOVE")
    return out.withColumn("kind", kind)


def stream_view(changes: DataFrame, keys: list[str], view: str, order: str = "index") -> DataFrame:
    """Stream records of a view type. A delta keeps the attributes that changed, as a map of
    text; an attribute that went away is there with null."""
    if view not in VIEW_TYPES:
        raise ValueError(f"unknown view type {view!r}")
    attributes = [c for c in changes.columns if c not in (*keys, order, "ts", "op")]
    records = with_prior(changes, keys, order).where("kind is not null")
    base = [order, "kind", *keys]
    if view == "KEYS_ONLY":
        return records.select(*base)
    if view == "NEW_IMAGE":
        return records.select(*base, "new")
    if view == "OLD_IMAGE":
        return records.select(*base, "old")
    if view == "NEW_AND_OLD_IMAGES":
        return records.select(*base, "new", "old")
    changed = F.filter(F.array(*(F.when(F.col("kind").isin("INSERT", "REMOVE") | ~F.col("new")[c].eqNullSafe(F.col("old")[c]), F.struct(F.lit(c).alias("key"), F.col("new")[c].cast("string").alias("value"))) for c in attributes)), lambda e: e.isNotNull())
    return records.select(*base, F.map_from_entries(changed).alias("delta"))


class StreamTrimmed(ValueError):
    pass


def start_index(kind: str, oldest: int, newest: int, sequence: int | None = None) -> int:
    """First index that an iterator reads."""
    if kind == "TRIM_HORIZON":
        return oldest
    if kind == "LATEST":
        return newest + 1
    if kind not in ("AT_SEQUENCE_NUMBER", "AFTER_SEQUENCE_NUMBER") or sequence is None:
        raise ValueError(f"unknown iterator {kind!r}")
    at = sequence + (kind == "AFTER_SEQUENCE_NUMBER")
    if at < oldest:
        raise StreamTrimmed(f"{at} is before {oldest}")
    return at


def page(records: DataFrame, start: int, limit: int = 1000, max_bytes: int = 1 << 20, order: str = "index", size: Column | None = None) -> DataFrame:
    """A page of at most limit records and max_bytes bytes; the first record always fits.
    The window runs over the page alone."""
    rows = records.where(F.col(order) >= start).orderBy(order).limit(min(limit, 1000))
    size = size if size is not None else F.octet_length(F.to_json(F.struct(*records.columns)))
    before = F.sum("_bytes").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_bytes", size).withColumn("_sum", before).where((F.col("_sum") <= max_bytes) | (F.col("_sum") == F.col("_bytes"))).drop("_bytes", "_sum")


def retained(changes: DataFrame, now, seconds: int) -> DataFrame:
    """Records whose time plus the retention is after now."""
    return changes.where(F.col("ts") + F.expr(f"interval {int(seconds)} seconds") > now)


def scan_changes(changes: DataFrame, low: int | None = None, high: int | None = None, limit: int = 1000, condition: str | None = None, limit_first: bool = True) -> DataFrame:
    """Change rows in index order. The limit comes before the condition, as change scans are
    defined; limit_first=False puts it after."""
    rows = changes
    if low is not None:
        rows = rows.where(F.col("index") >= low)
    if high is not None:
        rows = rows.where(F.col("index") < high)
    keep = None if condition is None else expressions.condition(condition, changes.schema)
    if limit_first:
        rows = rows.orderBy("index").limit(limit)
        return rows if keep is None else rows.where(keep)
    return (rows if keep is None else rows.where(keep)).orderBy("index").limit(limit)


# ---- expiry and recovery

def alive(df: DataFrame, ttl: str, now: int) -> DataFrame:
    """Rows that a reaper at `now` (epoch seconds) leaves: no expiry, 0, or not before now."""
    t = F.col(ttl)
    return df.where(t.isNull() | (t == 0) | (t >= now))


def expired(df: DataFrame, ttl: str, now: int) -> DataFrame:
    """Rows to reap, as REMOVE records."""
    return df.where((F.col(ttl) > 0) & (F.col(ttl) < now)).withColumn("kind", F.lit("REMOVE"))


def at_point(base: DataFrame, changes: DataFrame, keys: list[str], index: int | None = None, ts=None) -> DataFrame:
    """The table at a change index or time: a snapshot and the changes since, up to the target."""
    rows = changes
    if index is not None:
        rows = rows.where(F.col("index") <= index)
    if ts is not None:
        rows = rows.where(F.col("ts") <= ts)
    last = latest(rows, keys)
    live = last.where(F.col("op") == PUT).select(*base.columns)
    return base.join(last.select(*keys), keys, "left_anti").unionByName(live)
