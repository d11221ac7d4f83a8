"""Sharding by balanced label propagation, in DataFrame operations only.

Documents are linked if their texts are equal; the links of a group run through the group,
so a group is one row, with its documents in at most `shards` * SLICES parts by a hash of
their ids. Every document starts in the shard its id hashes to. In each step a group looks at
what it has in each shard and its parts want to go where most of the group is, among the
shards with room left; as many bytes move as the quotas allow (the room of the target, shared
among all that want to go there), and which parts move is decided by a hash, so a step is one
pass over the groups, without a shuffle. A quota that is spent leaves the rest of the group
where it is, and it tries the next best shard in the next step. When nothing moves any more,
the documents without a partner fill the shards to equal sizes, the large ones first.

Law `bytes`: shard sizes are near equal. A document's size is the bytes of its text plus 8.

Defined results: null texts form one group, of the empty text's size; a null doc_id is an id
like another; repeated rows are members of the same group; slots number the rows of each
shard from 0 without a gap; an empty table gives no rows.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

ROW_BYTES = 8
SLOT_ROWS = 20_000
SLICES = 64


def _unit(*columns: Column | str) -> Column:
    """A hash as a number from 0 to 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _sizes(docs: DataFrame, shards: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("group_a"),
        F.xxhash64(F.lit(7), "text").alias("group_b"),
    )
    start, part = (F.pmod(F.xxhash64(F.lit(i), "doc_id", "size"), F.lit(n)).cast("int") for i, n in ((1, shards), (2, SLICES)))
    return narrow.withColumn("part", start * SLICES + part)


def _groups(base: DataFrame) -> DataFrame:
    """A row for each group of two documents at least: its key, and its parts with their number
    of documents and their shard. Parts are counted first, so no task gets all copies of a text."""
    parts = base.groupBy("group_a", "group_b", "size", "part").agg(F.count("*").alias("n"))
    part = F.struct("part", "n", F.floor(F.col("part") / SLICES).cast("int").alias("shard"), F.lit(False).alias("moved"))
    groups = parts.groupBy("group_a", "group_b", "size").agg(F.sum("n").alias("members"), F.collect_list(part).alias("parts"))
    return groups.where("members > 1").withColumn("g", F.xxhash64("group_a", "group_b", "size"))


def _by_shard(shard: Column, value: Column, shards: int) -> list[Column]:
    """Sums of value for each shard, as columns of one row."""
    return [F.coalesce(F.sum(F.when(shard == s, value)), F.lit(0)).alias(f"s{s}") for s in range(shards)]


def _wishes(groups: DataFrame, room: list[float]) -> DataFrame:
    """groups with the shard that each group in several shards wants to go to, and how many
    of its documents are there: its fullest shard that can take more."""
    rooms = F.array(*(F.lit(float(r)) for r in room))
    here = F.transform(F.array_distinct(F.transform("parts", lambda x: x["shard"])), lambda s: F.struct(
        F.aggregate(F.filter("parts", lambda x: x["shard"] == s), F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("there"),
        F.xxhash64("g", s).alias("tie"),
        s.alias("target"),
    ))
    best = F.array_max(F.filter("here", lambda c: F.get(rooms, c["target"]) > 0))
    wished = groups.withColumn("here", here).withColumn("best", F.when(F.size("here") > 1, best))
    return wished.withColumns({"target": F.col("best.target"), "there": F.col("best.there")}).drop("here", "best")


def _moves(wished: DataFrame, room: list[float], share: list[float], step: int) -> DataFrame:
    """One step: groups with the shards of their parts after it."""
    rooms, shares = (F.array(*(F.lit(float(x)) for x in values)) for values in (room, share))

    def after(x: Column) -> Column:
        # parts in a full shard stay
        go = F.coalesce((F.col("target") != x["shard"]) & (F.get(rooms, x["shard"]) > 0) & (_unit(F.lit(step), "g", x["part"]) < F.get(shares, F.col("target"))), F.lit(False))
        return F.struct(x["part"].alias("part"), x["n"].alias("n"), F.when(go, F.col("target")).otherwise(x["shard"]).alias("shard"), go.alias("moved"))

    return wished.withColumn("parts", F.transform("parts", after)).drop("target", "there")


def _running(df: DataFrame, key: list[str], order: list[Column | str], value: Column, name: str, buckets: int) -> DataFrame:
    """Exclusive running sum of value by hash bucket: sums of buckets first, then within each,
    so no task sorts more than a bucket. The table of buckets has keys * buckets rows."""
    bucketed = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sums = bucketed.groupBy(*key, "_b").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*key, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.join(F.broadcast(bases), [*key, "_b"])
        .withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_b", "_base")
    )


def _laid(deficits: list[float], weight: int) -> Column:
    """The shard of documents that lie end to end over the shards' deficits, at _at of weight."""
    at = (F.col("_at") + F.col("size") / 2) * F.lit(sum(deficits) / weight)
    shard, edge = None, 0.0
    for s, d in enumerate(deficits):
        edge += d
        shard = F.when(at < edge, s) if shard is None else shard.when(at < edge, s)
    return shard.otherwise(len(deficits) - 1).cast("int")


def balanced_shards(docs: DataFrame, shards: int = 24, steps: int = 12) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row. Labels spread until
    none moves, for as many steps at most; rows that still move then are told in a warning, as
    groups of theirs may be split."""
    spark = docs.sparkSession
    base, base_path = stored(_sizes(docs, shards), "shard-sizes")
    total = base.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.max("size"), F.lit(0)).alias("most")).first()
    capacity = total.bytes / shards
    groups, path = stored(_groups(base), "shard-groups")

    for step in range(steps + 1):
        # sums for each shard go to the driver: one row
        parts = groups.select("size", F.explode("parts").alias("p"))
        *loads, moving = parts.agg(*_by_shard(F.col("p.shard"), F.col("p.n") * F.col("size"), shards), F.coalesce(F.sum(F.when(F.col("p.moved"), F.col("p.n"))), F.lit(0))).first()
        if step == steps:
            if moving:
                warnings.warn(f"{moving} linked rows still moved between shards after {steps} steps", stacklevel=2)
            break
        if step and not moving:
            break
        room = [capacity - load for load in loads]
        wished = _wishes(groups, room)
        # parts leave a shard only for one that holds more of the group, or as much and wins the tie
        wanted = wished.agg(*_by_shard(F.col("target"), (F.col("members") - F.col("there")) * F.col("size"), shards)).first()
        if not any(wanted):
            break
        now, now_path = stored(_moves(wished, room, [min(1.0, r / max(w, 1)) for r, w in zip(room, wanted)], step), "shard-step")
        discard(spark, path)
        groups, path = now, now_path

    of_parts = groups.select("group_a", "group_b", "size", "g", F.explode("parts").alias("p")).select("group_a", "group_b", "size", "g", F.col("p.part").alias("part"), F.col("p.shard").alias("shard"))
    marked, _ = stored(base.join(of_parts, ["group_a", "group_b", "size", "part"], "left").select("doc_id", "size", "text_crc32", "g", "shard"), "shard-marked")
    discard(spark, base_path, path)

    # a shard that the linked documents overfill gives up the excess, by hash
    stay = F.array(*(F.lit(min(1.0, capacity / load) if load else 1.0) for load in loads))
    stays = F.coalesce(_unit(F.lit("stay"), "doc_id", "size", "g") < F.get(stay, F.col("shard")), F.lit(False))
    settled, free = marked.where(stays).drop("g"), marked.where(~stays).drop("g", "shard")
    if any(load > capacity for load in loads):
        loads = settled.agg(*_by_shard(F.col("shard"), F.col("size"), shards)).first()

    # size classes, the largest first: each evens out what the one before left uneven
    buckets = max(1, -(-total.n // SLOT_ROWS))
    mean = max(1, total.bytes // max(1, total.n))
    kind, edges = None, [4 * mean, mean, mean // 4, mean // 16]
    for i, low in enumerate(edges):
        kind = F.when(F.col("size") > low, i) if kind is None else kind.when(F.col("size") > low, i)
    order = [F.xxhash64(F.lit(3), "doc_id", "size"), F.col("doc_id"), F.col("text_crc32")]
    lying, _ = stored(_running(free.withColumn("_class", kind.otherwise(len(edges))), ["_class"], order, F.col("size"), "_at", buckets), "shard-fill")
    weights = lying.agg(*_by_shard(F.col("_class"), F.col("size"), len(edges) + 1)).first()
    shard = F.lit(None).cast("int")
    for i, weight in enumerate(weights):
        if not weight:
            continue
        laid = _laid(_deficits(list(loads), weight), weight)
        shard = F.when(F.col("_class") == i, laid).otherwise(shard)
        if any(weights[i + 1:]):
            more = lying.where(F.col("_class") == i).agg(*_by_shard(laid, F.col("size"), shards)).first()
            loads = [a + b for a, b in zip(loads, more)]
    placed = settled.unionByName(lying.select("doc_id", "size", "text_crc32", shard.alias("shard")))
    placed = _running(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.lit(1), "slot", max(1, buckets // shards))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _deficits(loads: list[int], more: int) -> list[float]:
    """What each shard lacks to a common level that uses up `more` bytes."""
    level, rest, order = 0.0, float(more), sorted(loads)
    for i, load in enumerate(order):
        step = (order[i + 1] if i + 1 < len(order) else float("inf")) - load
        level = load
        if rest <= step * (i + 1):
            level += rest / (i + 1)
            break
        rest -= step * (i + 1)
    return [max(0.0, level - load) for load in loads]
