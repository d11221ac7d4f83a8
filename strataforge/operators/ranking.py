"""Exact and approximate top-k, filtered search, diversification and recommendation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as distances
from ..plans import expressions


class NeedsOperator(ValueError):
    """Neither an index nor a distance operator was given."""


def top_k(df: DataFrame, field_name: str, target, k: int, operator: str | None = None, tie: str | None = None, metric: str | None = None) -> DataFrame:
    """The k nearest rows with their distance, ascending; rows without the field are left out.

    target is a value or a column. metric is an index's; an explicit operator must agree.
    Each task keeps its k best and one merge follows (TakeOrderedAndProject), so no sort of
    the table takes place.
    """
    if operator and metric and operator != metric:
        raise ValueError(f"the index ranks by {metric}, not by {operator}")
    name = operator or metric
    if name is None:
        raise NeedsOperator("give a distance operator, or create an index")
    goal = target if isinstance(target, Column) else expressions.literal(target)
    d = distances.operator(name)(F.col(field_name), goal)
    ranked = df.where(F.col(field_name).isNotNull()).withColumn("distance", d)
    return ranked.orderBy("distance", *([tie] if tie else [])).limit(k)


def merge_top_k(parts: list[DataFrame], keys: list[str], k: int) -> DataFrame:
    """The k best of several stores' results, one row of each key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = out.groupBy(*keys).agg(F.min("distance").alias("distance"))
    return best.orderBy("distance", *keys).limit(k)


# ---- filtered search

MAX_OVERSCAN = 16
FILTER_FIRST = 0.20


@dataclass(frozen=True)
class SearchPlan:
    strategy: str          # filter_first or overscan
    selectivity: float
    factor: int

    def node(self, k: int, below: Node | None = None) -> Node:
        below = below or Node("Scan")
        if self.strategy == "filter_first":
            return Node("TopK", f"k={k}", [Node("Filter", f"selectivity={self.selectivity:.3f}", [below])])
        return Node("Limit", f"k={k}", [Node("Filter", f"selectivity={self.selectivity:.3f}", [Node("TopK", f"k={k * self.factor}", [below])])])


@dataclass
class Node:
    """A line of EXPLAIN, with what it reads below it."""

    operator: str
    detail: str = ""
    children: list = field(default_factory=list)
    plugin: str = ""

    def text(self, depth: int = 0) -> str:
        line = "  " * depth + f"- {self.operator}" + (f" [plugin={self.plugin}]" if self.plugin else "") + (f" {self.detail}" if self.detail else "")
        return "\n".join([line, *(c.text(depth + 1) for c in self.children)])

    def to_dict(self) -> dict:
        return {"operator": self.operator, "detail": self.detail, "plugin": self.plugin, "children": [c.to_dict() for c in self.children]}


def plan_search(condition, indexed: set[str], selectivity: float | None = None) -> SearchPlan:
    """Filter first where a conjunct is on an indexed column and few rows are expected to pass;
    else rank more than asked for and filter then."""
    s = expressions.selectivity(condition) if selectivity is None else selectivity
    covered = any(expressions.names_in(c) & indexed for c in expressions.conjuncts(condition))
    if covered and s <= FILTER_FIRST:
        return SearchPlan("filter_first", s, 1)
    return SearchPlan("overscan", s, min(MAX_OVERSCAN, max(1, math.ceil(1 / max(s, 1e-9)))))


def hybrid_search(df: DataFrame, field_name: str, target, k: int, operator: str, where: Column, plan: SearchPlan, tie: str) -> DataFrame:
    """Filter-first gives the k best that pass; overscan can give fewer than k."""
    if plan.strategy == "filter_first":
        return top_k(df.where(where), field_name, target, k, operator, tie)
    return top_k(df, field_name, target, k * plan.factor, operator, tie).where(where).orderBy("distance", tie).limit(k)


# ---- diversification

MAX_SLATE = 10_000


def mmr_order(vectors: np.ndarray, lam: float, n: int, metric: str = "cosine") -> list[int]:
    """Greedy maximal marginal relevance over candidates in rank order: relevance falls with
    the rank, similarity is 1 - distance within 0..1, ties go to the better rank."""
    total = len(vectors)
    if metric == "cosine":
        norm = np.linalg.norm(vectors, axis=1)
        safe = np.where(norm == 0, 1, norm)
        unit = vectors / safe[:, None]
    relevance = (total - np.arange(total)) / max(1, total)
    closest, free, out = np.zeros(total), np.ones(total, dtype=bool), []
    for _ in range(min(n, total)):
        score = np.where(free, lam * relevance - (1 - lam) * closest, -np.inf)
        pick = int(np.argmax(score))
        out.append(pick)
        free[pick] = False
        if metric == "cosine":
            d = 1 - np.clip(unit @ unit[pick], -1, 1)
            d[(norm == 0)] = 1
            if norm[pick] == 0:
                d[:] = 1
        elif metric == "euclidean":
            d = np.linalg.norm(vectors - vectors[pick], axis=1)
        else:
            d = np.abs(vectors - vectors[pick]).sum(axis=1)
        closest = np.maximum(closest, np.clip(1 - d, 0, 1))
    return out


def diversify(ranked: DataFrame, vector: str, lam: float, n: int, order: list[str], metric: str = "cosine") -> DataFrame:
    """The n rows that MMR picks from a ranked slate, with slot from 0. The choice is
    sequential, so the slate goes to one task; more than MAX_SLATE rows raise."""
    if not 0 <= lam <= 1:
        raise ValueError("lambda is 0 to 1")
    slate = ranked.orderBy(*order).limit(MAX_SLATE + 1)
    schema = slate.schema.simpleString()[len("struct<"):-1]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_SLATE:
            raise ValueError(f"a slate of more than {MAX_SLATE} rows can't be diversified; limit it first")
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        chosen = mmr_order(np.stack([np.asarray(v, float) for v in pdf[vector]]), lam, n, metric) if len(pdf) else []
        out = pdf.iloc[chosen].copy()
        out["slot"] = np.arange(len(out), dtype=np.int32)
        return out

    from pyspark.sql.types import IntegerType, StructType

    schema = StructType([*slate.schema.fields]).add("slot", IntegerType())
    return slate.groupBy(F.lit("all")).applyInPandas(pick, schema)


# ---- recommendation

def recommend(df: DataFrame, vector: str, target, limit: int, key: str, where: str | None = None, lam: float = 0.0, diversified: bool = True, candidate_limit: int | None = None, operator: str = "cosine", spent: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Retrieve, filter, diversify, cap. Returns the slate and stage, n_in, n_out of each stage.

    spent: keys that a cap or a duplicate rule holds back (see audience.decide)."""
    retrieved = top_k(df, vector, target, candidate_limit or max(100, 4 * limit), operator, key)
    kept = retrieved if where is None else retrieved.where(expressions.condition(where, df.schema))
    if diversified:
        slate = diversify(kept, vector, lam, limit if spent is None else MAX_SLATE, ["distance", key], operator)
    else:
        from pyspark.sql import Window

        slate = kept.withColumn("slot", (F.row_number().over(Window.orderBy("distance", key)) - 1).cast("int"))
    free = slate if spent is None else slate.join(spent.select(key), key, "left_anti")
    final = free.orderBy("slot").limit(limit)
    # each stage takes what the one before it gave, so five counts tell all
    sizes = None
    for at, part in enumerate((df, retrieved, kept, slate, free)):
        row = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(at).alias("at"), "n")
        sizes = row if sizes is None else sizes.unionByName(row)
    names = F.array(*(F.lit(n) for n in ("retrieve", "filter", "diversify", "cap")))
    whole = sizes.agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("n"))
    report = whole.select("n", F.posexplode(names).alias("at", "stage")).select("at", "stage", F.col("n")[F.col("at")].alias("n_in"), F.col("n")[F.col("at") + 1].alias("n_out"))
    return final, report
