"""Distance operators: lower is closer. Vector and set distances are column expressions; the
two edit distances that Spark lacks are Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spatial


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(a: Column, b: Column, each) -> Column:
    """Sum over components; vectors of different dimensions raise."""
    a, b = _doubles(a), _doubles(b)
    total = F.aggregate(F.zip_with(a, b, each), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("dimension mismatch"))).otherwise(total)


def _square_sum(v: Column) -> Column:
    return F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    """1 - similarity, the similarity clamped to -1..1; 1 for a zero vector."""
    norm = F.sqrt(_square_sum(a)) * F.sqrt(_square_sum(b))
    return F.when(norm == 0, F.lit(1.0)).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def hamming(a: Column, b: Column) -> Column:
    """Characters that differ; texts of different lengths raise."""
    differ = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("length mismatch"))).when(F.length(a) == 0, 0).otherwise(differ)


def hamming_binary(a: Column, b: Column) -> Column:
    """Bytes that differ."""
    return hamming(F.decode(a, "ISO-8859-1"), F.decode(b, "ISO-8859-1"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return spatial.haversine(lat1, lon1, lat2, lon2)


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct runs of size characters; a shorter text is its own only shingle."""
    n = F.length(text)
    return F.when(n < size, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (size - 1))), lambda i: F.substring(text, i, F.lit(size)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def jaccard_text(a: Column, b: Column) -> Column:
    return jaccard(shingles(a), shingles(b))


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def osa_distance(a: str, b: str) -> int:
    """Edits with transpositions of neighbours, no part edited twice."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


def jaro_winkler_similarity(a: str, b: str) -> float:
    """Prefix bonus of 0.1 a character, up to four, whatever the Jaro similarity is."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * .1 * (1 - jaro)


@F.pandas_udf(T.IntegerType())
def damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 1 - jaro_winkler_similarity(x, y) for x, y in zip(a, b)], dtype="float64")


#: Operators by name, as functions of two columns.
OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": cosine,
    "euclidean": euclidean,
    "manhattan": manhattan,
    "hamming": hamming,
    "haversine": lambda a, b: haversine(a["lat"], a["lon"], b["lat"], b["lon"]),
    "jaccard": jaccard,
    "levenshtein": levenshtein,
    "damerau": damerau,
    "jaro_winkler": jaro_winkler,
}


def operator(name: str) -> Callable[[Column, Column], Column]:
    if name not in OPERATORS:
        raise ValueError(f"unknown distance {name!r}; known: {', '.join(sorted(OPERATORS))}")
    return OPERATORS[name]


def register(spark) -> None:
    """The Python distances for SQL texts."""
    spark.udf.register("damerau", damerau)
    spark.udf.register("jaro_winkler", jaro_winkler)
