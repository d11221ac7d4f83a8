"""Grouped aggregates with a privacy gate, cohorts, counts and view aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import expressions


class GroupTooSmall(ValueError):
    """A group has fewer members than the privacy gate asks for; no rows are given."""


def _key(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def _metric(name: str) -> Column:
    """Missing and unreadable values count as 0."""
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))


def aggregate(df: DataFrame, group_by: list[str], metrics: list[str], min_group_size: int = 0) -> DataFrame:
    """Group keys as text, members, sum_<metric>. With min_group_size every row is made only
    if the smallest group is large enough: the check is part of the plan, so it needs no
    action beforehand, and the groups are aggregated once."""
    if not group_by:
        raise ValueError("group_by is required")
    out = df.groupBy(*(_key(df, g) for g in group_by)).agg(F.count(F.lit(1)).alias("members"), *(F.sum(_metric(m)).alias(f"sum_{m}") for m in metrics))
    return gated(out, min_group_size) if min_group_size > 1 else out


def gated(groups: DataFrame, min_group_size: int) -> DataFrame:
    """Raises in place of any row if a group has fewer members. The least is taken over whole
    rows, so that both sides read the same columns and Spark reuses the one exchange of the
    groups: they are scanned and aggregated once."""
    smallest = groups.agg(F.min(F.struct("members", *(c for c in groups.columns if c != "members")))["members"].alias("_least"))
    # one row
    ok = F.when(F.col("_least") < min_group_size, F.raise_error(F.lit(f"a group has fewer than {min_group_size} members"))).otherwise(F.lit(True))
    return groups.join(F.broadcast(smallest.select(ok.cast("boolean").alias("_ok"))), F.col("_ok")).drop("_ok")


def checked(df: DataFrame, group_by: list[str], metrics: list[str], min_group_size: int) -> DataFrame:
    """aggregate(), with the gate tried at once as GroupTooSmall."""
    out = aggregate(df, group_by, metrics)
    least = out.agg(F.min("members").alias("m")).first().m
    if least is not None and least < min_group_size:
        raise GroupTooSmall(f"a group has {least} members; {min_group_size} are needed")
    return out


def count_rows(df: DataFrame, condition: str | Column | None = None) -> DataFrame:
    if isinstance(condition, str):
        condition = expressions.condition(condition, df.schema)
    return (df if condition is None else df.where(condition)).agg(F.count(F.lit(1)).alias("n"))


def observed_selectivity(df: DataFrame, condition: Column) -> DataFrame:
    """Share of the rows that pass."""
    return df.agg(F.avg(condition.cast("double")).alias("selectivity"))


def view_aggregate(df: DataFrame, keys: list[str], sums: dict[str, str] | None = None, count: str | None = "count") -> DataFrame:
    """Counts and sums by view key; rows without a whole key are left out."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    out = [F.count(F.lit(1)).alias(count)] if count else []
    return df.groupBy(*keys).agg(*out, *(F.sum(F.col(c)).alias(name) for c, name in (sums or {}).items()))


# ---- cohorts: exact sets of ids

def cohort(df: DataFrame, field: str, condition: str | None = None) -> DataFrame:
    """id: the distinct values of a numeric field over the rows that pass; missing ones are skipped."""
    kept = df if condition is None else df.where(expressions.condition(condition, df.schema))
    return kept.where(F.col(field).isNotNull()).select(F.col(field).cast("long").alias("id")).distinct()


def cohort_bitmap(df: DataFrame, field: str) -> DataFrame:
    """bucket, bitmap: the same set as bitmaps of 32768 ids each; mergeable with bitmap_or_agg."""
    ids = df.where(F.col(field).isNotNull()).select(F.col(field).cast("long").alias("id"))
    return ids.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap"))


def bitmap_cardinality(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("cardinality"))


def cohort_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def cohort_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
