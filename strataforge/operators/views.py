"""Materialized views and their refresh, and backups.

A view is versioned: each refresh writes a new folder and then a small pointer file, so
readers see either version whole and a repeated refresh does no harm.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import aggregate, changes


@dataclass
class ViewDef:
    """mode: eager, fast, scheduled or on_demand. Aggregating views are grouped by their key."""

    name: str
    base: str
    pk: str
    sk: str | None = None
    projected: list[str] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    count: str | None = None
    sums: dict[str, str] = field(default_factory=dict)
    mode: str = "eager"
    every_seconds: int | None = None
    paused: bool = False

    @property
    def keys(self) -> list[str]:
        return [self.pk, *([self.sk] if self.sk else [])]

    @property
    def aggregates(self) -> bool:
        return bool(self.count or self.sums)

    def check(self) -> None:
        if self.aggregates and (self.mode != "eager" or sorted(self.group_by) != sorted(self.keys)):
            raise ValueError("an aggregating view is EAGER and grouped by its primary key")
        if self.mode in ("fast", "scheduled") and not self.every_seconds:
            raise ValueError(f"a {self.mode} view needs an interval")


def derive(base: DataFrame, view: ViewDef, order: str | None = None) -> DataFrame:
    """The view over the whole base. Rows without the view's key are left out; of several rows
    of a view key the last by `order` stays."""
    if view.aggregates:
        return aggregate.view_aggregate(base, view.keys, view.sums, view.count)
    out = base
    for k in view.keys:
        out = out.where(F.col(k).isNotNull())
    if view.projected:
        out = out.select(*dict.fromkeys([*view.keys, *view.projected, *([order] if order else [])]))
    if order:
        out = changes.latest(out, view.keys, order)
        if view.projected and order not in view.projected:
            out = out.drop(order)
    return out


def deltas(changed: DataFrame, view: ViewDef) -> DataFrame:
    """Signed group totals of change records with old and new images: -old, +new."""
    side = lambda image, sign: changed.where(F.col(image).isNotNull()).select(F.lit(sign).alias("_s"), f"{image}.*")
    rows = side("old", -1).unionByName(side("new", 1), allowMissingColumns=True)
    for k in view.keys:
        rows = rows.where(F.col(k).isNotNull())
    sums = [F.sum(F.col("_s") * F.col(c)).alias(n) for c, n in view.sums.items()]
    count = [F.sum("_s").alias(view.count)] if view.count else []
    return rows.groupBy(*view.keys).agg(*count, *sums)


def apply_deltas(current: DataFrame, signed: DataFrame, view: ViewDef) -> DataFrame:
    """Current totals plus deltas; groups whose count falls to 0 go."""
    names = [*([view.count] if view.count else []), *view.sums.values()]
    both = current.select(*view.keys, *names).unionByName(signed.select(*view.keys, *names))
    out = both.groupBy(*view.keys).agg(*(F.sum(n).alias(n) for n in names))
    return out.where(F.col(view.count) != 0) if view.count else out


def project_changes(current: DataFrame, changed: DataFrame, view: ViewDef) -> DataFrame:
    """A projecting view after changes: rows leave their old view key and enter the new one."""
    columns = current.columns
    live = changed.where(F.col("new").isNotNull()).select(*(F.col("new")[c].alias(c) for c in columns))
    for k in view.keys:
        live = live.where(F.col(k).isNotNull())
    touched = changed.where(F.col("old").isNotNull()).select(*(F.col("old")[k].alias(k) for k in view.keys)).union(live.select(*view.keys)).distinct()
    return current.join(touched, view.keys, "left_anti").unionByName(live)


def due(view: ViewDef, last_run: float | None, now: float) -> bool:
    return not view.paused and (last_run is None or now - last_run >= (view.every_seconds or 0))


class Store:
    """Versions of named tables under one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def write(self, name: str, df: DataFrame, **note) -> dict:
        version = {"name": name, "version": f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}", "at": time.time(), **note}
        df.write.parquet(f"{self.root}/{name}/{version['version']}")
        out = self._fs.create(self._at(f"{name}/{version['version']}.json"), True)
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        return version

    def versions(self, name: str) -> list[dict]:
        """Oldest first; a version counts once its note is there."""
        if not self._fs.exists(self._at(name)):
            return []
        files = [s.getPath().getName() for s in self._fs.listStatus(self._at(name))]
        notes = [f"{self.root}/{name}/{f}" for f in sorted(files) if f.endswith(".json")]
        return [json.loads(r.value) for r in self.spark.read.text(notes).collect()] if notes else []

    def read(self, name: str, version: str | None = None) -> DataFrame:
        known = sorted(self.versions(name), key=lambda v: v["version"])
        if not known:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{version or known[-1]['version']}")

    def delete(self, name: str, version: str) -> None:
        self._fs.delete(self._at(f"{name}/{version}.json"), False)
        self._fs.delete(self._at(f"{name}/{version}"), True)


def refresh(store: Store, base: DataFrame, view: ViewDef, order: str | None = None) -> dict:
    """COMPLETE refresh: a new version from the whole base; rows that vanished are gone."""
    return store.write(view.name, derive(base, view, order), view=asdict(view))


# ---- backups

def backup(store: Store, name: str, snapshot: DataFrame, change_index: int) -> dict:
    """A snapshot and the last change it holds."""
    return store.write(f"backup-{name}", snapshot, change_index=change_index, rows=snapshot.count())


def backup_due(versions: list[dict], now: float, every: float) -> bool:
    """Whether a scheduled backup is to run: there is none yet, or the last is `every` seconds old."""
    return not versions or now - max(v["at"] for v in versions) >= every


def scheduled_backup(store: Store, name: str, snapshot: DataFrame, change_index: int, every: float, now: float | None = None, keep_latest: int | None = None, max_age: float | None = None) -> dict | None:
    """One tick of a backup schedule: the new backup's note if one was due, else None. After a
    backup those that the retention policy gives up are deleted."""
    now = time.time() if now is None else now
    if not backup_due(store.versions(f"backup-{name}"), now, every):
        return None
    note = store.write(f"backup-{name}", snapshot, change_index=change_index, rows=snapshot.count(), at=now)
    for old in to_delete(store.versions(f"backup-{name}"), now, keep_latest, max_age):
        store.delete(f"backup-{name}", old["version"])
    return note


def to_delete(versions: list[dict], now: float, keep_latest: int | None = None, max_age: float | None = None) -> list[dict]:
    """Backups that violate the policy, oldest first; with both rules a backup must violate both."""
    if keep_latest is None and max_age is None:
        return []
    ordered = sorted(versions, key=lambda v: v["version"])
    surplus = {v["version"] for v in ordered[:max(0, len(ordered) - keep_latest)]} if keep_latest is not None else None
    old = {v["version"] for v in ordered if now - v["at"] > max_age} if max_age is not None else None
    gone = surplus if old is None else old if surplus is None else surplus & old
    return [v for v in ordered if v["version"] in gone]


def restore(store: Store, name: str, target: str, version: str | None = None, log: DataFrame | None = None, keys: list[str] | None = None, index: int | None = None, ts=None, dry_run: bool = False) -> DataFrame | dict:
    """A backup as a new table; with a changelog, up to a change index or time. The target
    must not exist."""
    if store.versions(target):
        raise FileExistsError(target)
    notes = sorted(store.versions(f"backup-{name}"), key=lambda v: v["version"])
    note = next(v for v in reversed(notes) if version in (None, v["version"]))
    if dry_run:
        return note
    out = store.read(f"backup-{name}", note["version"])
    if log is not None:
        out = changes.at_point(out, log.where(F.col("index") > note["change_index"]), keys, index, ts)
    store.write(target, out)
    return store.read(target)


def compact(df: DataFrame, files: int) -> DataFrame:
    """The same rows in fewer files, without a shuffle."""
    return df.coalesce(files)
