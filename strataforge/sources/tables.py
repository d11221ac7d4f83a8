"""Tables, keys and indexes over DataFrames: the catalog, reads by key, and tagged JSON.

A table is a DataFrame with a partition key and maybe a sort key. Reads are filters that
Catalyst pushes into the scan; an index is a projection derived from the table, so it can't
be stale. Limits come after filters; the `ref_order` readings with a limit first are options.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import expressions


@dataclass
class IndexDef:
    """kind: GSI, LSI or GLOBAL. projection: ALL, KEYS_ONLY or INCLUDE (with include)."""

    name: str
    kind: str
    pk: str
    sk: str | None = None
    projection: str = "ALL"
    include: list[str] = field(default_factory=list)
    shards: int = 1
    replication_factor: int = 1
    paused: bool = False


@dataclass
class TableDef:
    name: str
    pk: str
    sk: str | None = None
    indexes: dict[str, IndexDef] = field(default_factory=dict)
    vectors: dict[str, int] = field(default_factory=dict)
    counters: list[str] = field(default_factory=list)
    spatial: dict[str, tuple[str, str]] = field(default_factory=dict)
    storage: str = "standard"
    ttl: str | None = None
    stream: dict | None = None

    @property
    def keys(self) -> list[str]:
        return [self.pk, *([self.sk] if self.sk else [])]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> TableDef:
        d = json.loads(text)
        d["indexes"] = {k: IndexDef(**v) for k, v in d["indexes"].items()}
        d["spatial"] = {k: tuple(v) for k, v in d["spatial"].items()}
        return cls(**d)


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def _limited(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None or n <= 0 else df.limit(n)


def scan(df: DataFrame, condition: str | Column | None = None, limit: int | None = None, binds: dict | None = None) -> DataFrame:
    """Rows that pass, then the limit."""
    if isinstance(condition, str):
        condition = expressions.condition(condition, df.schema, binds)
    return _limited(df if condition is None else df.where(condition), limit)


def get(df: DataFrame, table: TableDef, pk, sk=None) -> DataFrame:
    out = df.where(F.col(table.pk) == F.lit(pk))
    return out if table.sk is None else out.where(F.col(table.sk) == F.lit(sk))


def query(df: DataFrame, table: TableDef, pk, low=None, high=None, limit: int | None = None, descending: bool = False, high_inclusive: bool = False) -> DataFrame:
    """Rows of a partition in sort key order; low <= sort key < high, or <= with high_inclusive."""
    return _ranged(df, table.pk, table.sk, pk, low, high, limit, descending, high_inclusive, table.keys)


def _ranged(df, pk, sk, value, low, high, limit, descending, inclusive, tie) -> DataFrame:
    out = df.where(F.col(pk) == F.lit(value))
    if sk is None:
        return _limited(out.orderBy(*tie), limit) if limit else out
    if low is not None:
        out = out.where(F.col(sk) >= F.lit(low))
    if high is not None:
        out = out.where(F.col(sk) <= F.lit(high) if inclusive else F.col(sk) < F.lit(high))
    order = [F.col(sk).desc() if descending else F.col(sk).asc(), *(F.col(c) for c in tie if c != sk)]
    return _limited(out.orderBy(*order), limit)


def index_view(df: DataFrame, table: TableDef, index: IndexDef) -> DataFrame:
    """The index's rows: those that have its keys, with the projected columns."""
    keys = [index.pk, *([index.sk] if index.sk else [])]
    out = df
    for k in keys:
        out = out.where(F.col(k).isNotNull())
    if index.projection == "ALL":
        return out
    extra = index.include if index.projection == "INCLUDE" else []
    return out.select(*dict.fromkeys([*keys, *table.keys, *extra]))


def query_index(df: DataFrame, table: TableDef, name: str, value, low=None, high=None, limit: int | None = None, descending: bool = False) -> DataFrame:
    """GSI: an alternate key. LSI: the table's partition key with another order. GLOBAL: by one column."""
    index = table.indexes[name]
    if index.paused:
        raise ValueError(f"index {name} is paused")
    pk = table.pk if index.kind == "LSI" else index.pk
    return _ranged(index_view(df, table, index), pk, index.sk, value, low, high, limit, descending, False, table.keys)


def dereference(pointers: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows of index pointers; dangling pointers are skipped."""
    return base.join(pointers.select(*keys).distinct(), keys, "left_semi")


def batch_get(df: DataFrame, table: TableDef, keys: DataFrame) -> DataFrame:
    """Rows of many keys; missing keys are skipped, repeated keys count once. Spark broadcasts
    the keys when their measured size is under its threshold."""
    return df.join(keys.select(*table.keys), table.keys, "left_semi")


def route(df: DataFrame, table: TableDef, pk, index: str | None = None, low=None, high=None, limit: int | None = None) -> DataFrame:
    """One query call for the table and all kinds of its indexes."""
    return query(df, table, pk, low, high, limit) if index is None else query_index(df, table, index, pk, low, high, limit)


def union_shards(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several stores, one of each key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(keys)


def in_memory(df: DataFrame) -> DataFrame:
    return df.persist()


# ---- tagged JSON

TAGGED = T.StructType([
    T.StructField("t", T.StringType()), T.StructField("s", T.StringType()), T.StructField("n", T.StringType()), T.StructField("b", T.BinaryType()),
    T.StructField("bool", T.BooleanType()), T.StructField("ss", T.ArrayType(T.StringType())), T.StructField("ns", T.ArrayType(T.StringType())), T.StructField("bs", T.ArrayType(T.BinaryType())),
    T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("doc", T.StringType()),
])


def to_tagged_json(df: DataFrame) -> DataFrame:
    """item: each row as one JSON text of letter-tagged values. Nulls are left out; numbers
    are decimal texts, binary is base64, vectors carry their dimension."""
    parts = []
    for f in df.schema:
        c, tag = F.col(f"`{f.name}`"), expressions.tag_of(f.dataType)
        if tag == "V":
            inner = F.struct(c.alias("V"), F.size(c).alias("D"))
        elif tag in ("S", "N"):
            inner = F.struct(c.cast("string").alias(tag))
        elif tag == "B":
            inner = F.struct(F.base64(c).alias("B"))
        elif tag == "NS":
            inner = F.struct(c.cast("array<string>").alias("NS"))
        else:
            inner = F.struct(c.alias(tag))
        parts.append(F.when(c.isNotNull(), inner).alias(f.name))
    return df.select(F.to_json(F.struct(*parts)).alias("item"))


def from_tagged_json(items: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Typed columns of item texts; columns maps a name to its tag and, for N, a Spark type:
    {"id": "S", "score": "N:double", "tags": "SS", "emb": "V"}. A vector of another
    dimension than it declares raises."""
    kinds = {"S": "string", "N": "string", "B": "string", "BOOL": "boolean", "SS": "array<string>", "NS": "array<string>", "BS": "array<string>", "V": "array<double>"}
    fields, out = [], []
    for name, tag in columns.items():
        letter, _, cast = tag.partition(":")
        fields.append(f"`{name}` struct<`{letter}`:{kinds[letter]}{',`D`:int' if letter == 'V' else ''}>")
        c = F.col("r")[name][letter]
        if letter == "N":
            c = c.cast(cast or "double")
        elif letter == "B":
            c = F.unbase64(c)
        elif letter == "V":
            c = F.when(F.size(c) == F.col("r")[name]["D"], c).when(c.isNotNull(), F.raise_error(F.lit(f"{name}: dimension mismatch")))
        out.append(c.alias(name))
    return items.select(F.from_json("item", ", ".join(fields)).alias("r")).select(*out)


def dynamic_row(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and one attrs map of tagged values: the schemaless layout of a table."""
    pairs = []
    for f in df.schema:
        if f.name in keys:
            continue
        c, tag = F.col(f"`{f.name}`"), expressions.tag_of(f.dataType)
        slot = {"S": "s", "N": "n", "B": "b", "BOOL": "bool", "SS": "ss", "NS": "ns", "BS": "bs", "V": "vec"}.get(tag, "doc")
        make = []
        for s in TAGGED:
            if s.name == "t":
                x = F.lit(tag)
            elif s.name == slot:
                x = F.to_json(c) if slot == "doc" else c.cast(s.dataType)
            else:
                x = F.lit(None).cast(s.dataType)
            make.append(x.alias(s.name))
        pairs.append(F.when(c.isNotNull(), F.struct(F.lit(f.name).alias("key"), F.struct(*make).alias("value"))))
    entries = F.filter(F.array(*pairs), lambda p: p.isNotNull())
    return df.select(*keys, F.map_from_entries(entries).alias("attrs"))


def render(df: DataFrame, form: str = "table", limit: int = 20) -> str:
    """The first rows as json lines, an aligned table, or text blocks."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit).collect()]
    if form == "json":
        return "\n".join(json.dumps(r, default=str, ensure_ascii=False) for r in rows)
    if form == "text":
        return "\n\n".join("\n".join(f"{k}: {v}" for k, v in r.items() if v is not None) for r in rows)
    cells = [df.columns, *([str(r[c]) if r[c] is not None else "" for c in df.columns] for r in rows)]
    widths = [max(len(row[i]) for row in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(row, widths)).rstrip() for row in cells)
