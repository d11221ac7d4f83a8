"""Mergeable sketches: cardinality, frequency and membership.

Cardinality and frequency use Spark's own sketch aggregates. Membership filters are built by
partial bit sets in the tasks and merged by position, so neither a task nor the driver
holds more than the filter, whose size is a parameter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hll(column: str | Column, precision: int = 14) -> Column:
    """An aggregate sketch of distinct values; standard error 1.04 / sqrt(2 ** precision)."""
    if not 4 <= precision <= 18:
        raise ValueError("precision is 4 to 18")
    return F.hll_sketch_agg(column, precision)


def hll_estimate(sketch: str | Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def hll_merge(sketch: str | Column) -> Column:
    return F.hll_union_agg(sketch)


def cardinality(df: DataFrame, field: str, precision: int = 14) -> DataFrame:
    return df.agg(hll_estimate(hll(field, precision)).alias("estimate"))


class CountMin:
    """Counts of values: width ceil(e / eps), depth ceil(ln(1 / delta)); never too low."""

    def __init__(self, eps: float = 0.001, delta: float = 0.001):
        self.width, self.depth = math.ceil(math.e / eps), math.ceil(math.log(1 / delta))

    def rows(self, df: DataFrame, column: str) -> DataFrame:
        """depth, cell, n: the sketch as a table of at most width * depth rows. Tables add up:
        union them and sum n by depth and cell."""
        cells = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), self._cell(F.col(column), d).alias("cell")) for d in range(self.depth))))
        # equal values are counted before they are spread over the rows
        counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return counts.select("n", cells.alias("c")).groupBy("c.depth", "c.cell").agg(F.sum("n").alias("n"))

    def _cell(self, value: Column, depth: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(depth), value), F.lit(self.width)).cast("int")

    def merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).groupBy("depth", "cell").agg(F.sum("n").alias("n"))

    def total(self, sketch: DataFrame) -> DataFrame:
        """All observations: the sum of one row of the sketch."""
        return sketch.where("depth = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    def frequency(self, sketch: DataFrame, probes: DataFrame, column: str) -> DataFrame:
        """column, frequency of each probe value: the least of its cells."""
        asked = probes.select(column).distinct()
        cells = asked.select(column, F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), self._cell(F.col(column), d).alias("cell")) for d in range(self.depth)))).alias("c"))
        found = cells.select(column, "c.depth", "c.cell").join(sketch, ["depth", "cell"], "left")
        return found.groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("frequency"))


class Bloom:
    """m bits, k hashes by double hashing. No false negative; no delete."""

    def __init__(self, m: int = 1 << 20, k: int = 7):
        self.m, self.k = m, k

    def _positions(self, value: Column) -> Column:
        a, b = F.xxhash64(F.lit(1), value), F.xxhash64(F.lit(2), value).bitwiseOR(F.lit(1))
        return F.array(*(F.pmod(F.pmod(a, F.lit(self.m)) + F.pmod(b, F.lit(self.m)) * i, F.lit(self.m)) for i in range(self.k)))

    def build(self, df: DataFrame, column: str) -> DataFrame:
        """word, bits: the non-zero words of the bit set, at most m / 64 + 1 rows."""
        p = df.where(F.col(column).isNotNull()).select(F.explode(self._positions(F.col(column))).alias("p"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
        return p.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))

    def merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def probe(self, words: DataFrame, df: DataFrame, column: str) -> DataFrame:
        """Rows whose value may be a member. The filter goes to the tasks: m / 8 bytes."""
        bits = np.zeros(self.m // 64 + 1, np.int64)
        for r in words.collect():
            bits[r.word] = r.bits
        packed = bits.view(np.uint64)
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(batch.num_columns - 1)
                p = at.flatten().to_numpy().reshape(-1, k) if batch.num_rows else np.zeros((0, k), np.int64)
                hit = ((packed[p // 64] >> (p % 64).astype(np.uint64)) & np.uint64(1)).all(axis=1)
                yield batch.filter(pa.array(hit))

        with_positions = df.where(F.col(column).isNotNull()).withColumn("_positions", self._positions(F.col(column)))
        return with_positions.mapInArrow(run, with_positions.schema).drop("_positions")


class CountingBloom(Bloom):
    """Net counters in place of bits, saturating at 2 ** width - 1, so members can leave."""

    def __init__(self, m: int = 1 << 20, k: int = 7, width: int = 4):
        super().__init__(m, k)
        self.most = (1 << width) - 1

    def build(self, df: DataFrame, column: str, sign: str | None = None) -> DataFrame:
        """cell, n: counters after the additions (sign 1) and removals (sign -1) of df."""
        weight = F.lit(1) if sign is None else F.col(sign)
        p = df.where(F.col(column).isNotNull()).select(weight.alias("w"), F.explode(self._positions(F.col(column))).alias("cell"))
        return p.groupBy("cell").agg(F.least(F.lit(self.most), F.greatest(F.lit(0), F.sum("w"))).alias("n"))

    def members(self, counters: DataFrame, probes: DataFrame, column: str) -> DataFrame:
        """Probe values that may be members."""
        asked = probes.select(column).where(F.col(column).isNotNull()).distinct()
        cells = asked.select(column, F.explode(F.array_distinct(self._positions(F.col(column)))).alias("cell"))
        least = cells.join(counters, "cell", "left").groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("least"))
        return least.where("least > 0").select(column)


class FilterFull(RuntimeError):
    pass


class Cuckoo:
    """Buckets of four fingerprints; a value lives in one of two buckets, so it can leave.
    One filter has a fixed size; cuckoo_shards() builds as many as a table needs, each in a
    task of its own."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int = 1 << 12, fingerprint_bits: int = 8):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets is a power of two")
        self.buckets, self.mask = buckets, (1 << fingerprint_bits) - 1
        self.table = np.zeros((buckets, self.SLOTS), np.uint32)
        self.random = np.random.default_rng(1)

    def _places(self, value: str) -> tuple[int, int, int]:
        import xxhash

        h = xxhash.xxh3_64_intdigest(value.encode())
        mark = (h >> 32) % self.mask + 1
        first = h % self.buckets
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) % self.buckets

    def add(self, value: str) -> None:
        mark, a, b = self._places(value)
        for place in (a, b):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return
        place = a
        for _ in range(self.KICKS):
            slot = int(self.random.integers(self.SLOTS))
            mark, self.table[place, slot] = int(self.table[place, slot]), mark
            place = self._other(place, mark)
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return
        raise FilterFull("no place after 500 moves")

    def __contains__(self, value: str) -> bool:
        mark, a, b = self._places(value)
        return bool((self.table[a] == mark).any() or (self.table[b] == mark).any())

    def remove(self, value: str) -> bool:
        mark, a, b = self._places(value)
        for place in (a, b):
            at = np.flatnonzero(self.table[place] == mark)
            if len(at):
                self.table[place, at[0]] = 0
                return True
        return False


def _shard(column: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), F.col(column)), F.lit(shards)).cast("int").alias("shard")


def cuckoo_shards(df: DataFrame, column: str, shards: int, buckets: int = 1 << 12, fingerprint_bits: int = 8, sign: str | None = None) -> DataFrame:
    """shard, filter: a cuckoo filter of each shard of the distinct non-null values. With sign,
    values of a negative sum of signs aren't members and those that were added and removed
    alike have left; values that are removed more often than added never came."""
    weight = F.lit(1) if sign is None else F.col(sign)
    net = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value"), weight.alias("w"))
    net = net.groupBy("value").agg(F.sum(F.when(F.col("w") > 0, F.col("w")).otherwise(0)).alias("added"), F.sum("w").alias("left"))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        filt = Cuckoo(buckets, fingerprint_bits)
        values, left = rows.column("value").to_pylist(), rows.column("left").to_pylist()
        for v in sorted(values):
            filt.add(v)
        for v, n in zip(values, left):
            if n <= 0:
                filt.remove(v)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([filt.table.tobytes()], pa.binary())})

    return net.where("added > 0").select(_shard("value", shards), "value", "left").groupBy("shard").applyInArrow(build, "shard int, filter binary")


def cuckoo_members(filters: DataFrame, probes: DataFrame, column: str, shards: int, buckets: int = 1 << 12, fingerprint_bits: int = 8) -> DataFrame:
    """Distinct probe values that may be members. Values meet their shard's filter only."""
    asked = probes.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()

    def run(key: tuple, rows: pa.Table, held: pa.Table) -> pa.Table:
        values = rows.column("value").to_pylist()
        filt = Cuckoo(buckets, fingerprint_bits)
        if held.num_rows:
            filt.table = np.frombuffer(held.column("filter")[0].as_py(), np.uint32).reshape(buckets, Cuckoo.SLOTS)
        return pa.table({"value": pa.array([v for v in values if held.num_rows and v in filt], pa.string())})

    dealt = asked.select(_shard("value", shards), "value")
    return dealt.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(run, "value string").withColumnRenamed("value", column)
