"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components are turned into integers. The index is a table of blocks of candidates; a block
keeps its vectors and, by quantised impact, its postings (candidate, dimension, value):
segment s holds the components whose magnitude has its highest bit at place s, and the length
of what each candidate has in the segments after it. A query takes the segments by
descending impact and adds their scores to the candidates' accumulators. What is still to
come for a pair is at most the query's length times that of the candidate's unread
components (Cauchy and Schwarz), so after each segment a candidate is a possible member only
if its accumulator plus that bound reaches the k-th best accumulator minus its bound. Each
query stops on that proof, once the rest of the postings is more work than scoring its
possible members, all of which are rescored exactly; candidates that are possible for no
query any more leave the segments still to come. No candidate is dropped without the proof.

The index is written to the shared folder; each query block meets every candidate block, and
the k best of each are merged by a window per query. Blocks are packed from rows sorted
within each task, so a task that runs again packs the same blocks.

Defined results: vectors that are null, empty, or hold null or non-finite components take no
part; a vector only meets vectors of its own dimension; the query's own row (equal vec_id)
is left out; ties go to the smaller vec_id; null ids take no part; repeated rows are each a
candidate; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stored

CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 512


def integers(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; rows that take no part are left out.

    Components beyond 32 bits make exact scores in 64-bit floats impossible and raise.
    """
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)))
        .select("vec_id", F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("int")).alias("v"))
    )


@dataclass
class Block:
    """Candidates of one dimension and their postings by descending impact."""

    ids: np.ndarray
    matrix: np.ndarray      # whole vectors, for exact scores
    postings: np.ndarray    # _POSTING, segment after segment
    ends: np.ndarray        # where each segment ends
    rest: np.ndarray        # length of each candidate's components after each segment


_POSTING = np.dtype([("row", "<i4"), ("dim", "<i4"), ("value", "<i4")])
_BLOCK = "slot int, dim int, ids binary, matrix binary, postings binary, ends binary, rest binary"


def indexed(ids: np.ndarray, matrix: np.ndarray) -> Block:
    place = np.frexp(np.abs(matrix).astype(np.float64))[1]
    row, dim = np.nonzero(matrix)
    impact = place[row, dim]
    order = np.argsort(-impact, kind="stable")
    row, dim, impact = row[order], dim[order], impact[order]
    postings = np.empty(len(row), _POSTING)
    postings["row"], postings["dim"], postings["value"] = row, dim, matrix[row, dim]
    ends = np.append(np.flatnonzero(impact[1:] != impact[:-1]) + 1, len(row)) if len(row) else np.zeros(0, np.int64)
    square = matrix.astype(np.float64) ** 2
    rest = [np.sqrt(np.where(place < impact[e - 1], square, 0).sum(axis=1)) for e in ends]
    return Block(ids, matrix, postings, ends.astype(np.int64), np.array(rest).reshape(len(ends), len(ids)))


def _packed(batch: pa.RecordBatch, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of one dimension each: the dimension, ids and a matrix of at most block vectors."""
    ids, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = np.asarray(v.value_lengths())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        for a in range(0, len(rows), block):
            some = rows[a:a + block]
            yield int(dim), ids[some].astype("<i8"), flat[starts[some][:, None] + np.arange(dim)].astype("<i4")


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "vec_id").sortWithinPartitions("vec_id", "v")


def build_index(rows: DataFrame, parts: int, slots: int) -> tuple[DataFrame, str]:
    """The blocks of integer vectors, dealt to slots, and the table's path."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for dim, ids, matrix in _packed(batch, CANDIDATE_BLOCK):
            b = indexed(ids, matrix)
            slot = int(np.uint64(ids[0]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % slots
            out.append({"slot": slot, "dim": dim, "ids": ids.tobytes(), "matrix": matrix.tobytes(), "postings": b.postings.tobytes(), "ends": b.ends.tobytes(), "rest": b.rest.tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("slot", pa.int32()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "matrix", "postings", "ends", "rest"))]))

    return stored(map_batches(_dealt(rows, parts), run, _BLOCK), "topk-index")


def _query_blocks(rows: DataFrame, parts: int) -> DataFrame:
    schema = pa.schema([("dim", pa.int32()), ("q_ids", pa.binary()), ("q_matrix", pa.binary())])

    def run(batch: pa.RecordBatch) -> pa.Table:
        return pa.Table.from_pylist([{"dim": dim, "q_ids": ids.tobytes(), "q_matrix": m.tobytes()} for dim, ids, m in _packed(batch, QUERY_BLOCK)], schema)

    return map_batches(_dealt(rows, parts), run, "dim int, q_ids binary, q_matrix binary")


def _kth_best(values: np.ndarray, k: int) -> np.ndarray:
    """k-th largest of each row, minus infinity if there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k]


def block_top_k(query_ids: np.ndarray, queries: np.ndarray, block: Block, k: int, read: dict | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query_id, candidate ids, scores) of each query's k best of the block, exact. read gets
    how many segments each query read.

    Sums of products of 32-bit integers are whole numbers in 64-bit floats as long as they
    stay under 2 ** 53, which is checked.
    """
    q, n, dim = queries.astype(np.float64), len(block.ids), queries.shape[1]
    if len(q) and n and np.abs(q).sum(1).max() * max(1.0, float(np.abs(block.matrix).max(initial=0))) >= 2**53:
        raise ValueError("scores exceed exact integers of 64-bit floats; use a smaller scale")
    active, live = np.arange(len(q)), np.arange(n)
    own = query_ids[:, None] == block.ids[None, :]
    acc = np.where(own, -np.inf, 0.0)
    norm = np.sqrt((q * q).sum(1))
    start, steps = 0, len(block.ends)

    def best(i: int, members: np.ndarray, scores: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        first = np.lexsort((block.ids[members], -scores))[:k]
        return int(query_ids[i]), block.ids[members[first]], scores[first].astype(np.int64)

    for step, end in enumerate(block.ends.tolist()):
        some = block.postings[start:end]
        start = end
        at = np.full(n, -1)
        at[live] = np.arange(len(live))
        row = at[some["row"]]
        segment = np.zeros((len(live), dim))
        segment[row[row >= 0], some["dim"][row >= 0]] = some["value"][row >= 0]
        acc += q[active] @ segment.T
        if read is not None:
            read.update({int(query_ids[i]): step + 1 for i in active})
        if step == steps - 1:
            break
        bound = norm[active][:, None] * block.rest[step][live][None, :] * (1 + 1e-9) + 1e-6
        floor = _kth_best(acc - bound, k)
        possible = (acc + bound >= floor[:, None]) & ~own
        # reading on costs the postings left of the candidates in hand
        left = (len(block.postings) - end) * len(live) / n
        stop = possible.sum(axis=1) * dim <= left
        for i, row in zip(active[stop].tolist(), possible[stop]):
            members = live[row]
            yield best(i, members, block.matrix[members].astype(np.float64) @ q[i])
        active, acc, own, possible = active[~stop], acc[~stop], own[~stop], possible[~stop]
        if not len(active):
            return
        some = possible.any(axis=0)
        if some.mean() < 0.8:
            live, acc, own = live[some], acc[:, some], own[:, some]
    for i, row, mine in zip(active.tolist(), acc, own):
        floor = _kth_best(row[None, :], k)[0]
        members = np.flatnonzero((row >= floor) & ~mine)
        yield best(i, live[members], row[members])


def top_k(vectors: DataFrame, k: int = 20, scale: float = 64.0, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for every vector whose id is divisible by every, the k
    best of all other vectors.

    Each query block is sent to every slot of candidate blocks; partial results are k rows
    for each query and block.
    """
    rows = integers(vectors, scale)
    n = rows.count()
    parts = max(1, -(-n // CANDIDATE_BLOCK))
    index, _ = build_index(rows, parts, parts)
    asked = rows.where(F.col("vec_id") % every == 0)
    query_parts = max(1, -(-(n // every) // QUERY_BLOCK))
    sent = _query_blocks(asked, query_parts).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = index.join(sent, ["slot", "dim"]).select("dim", "ids", "matrix", "postings", "ends", "rest", "q_ids", "q_matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                ids = np.frombuffer(p["ids"], "<i8")
                block = Block(ids, np.frombuffer(p["matrix"], "<i4").reshape(-1, p["dim"]), np.frombuffer(p["postings"], _POSTING), np.frombuffer(p["ends"], np.int64), np.frombuffer(p["rest"]).reshape(-1, len(ids)))
                found = list(block_top_k(np.frombuffer(p["q_ids"], "<i8"), np.frombuffer(p["q_matrix"], "<i4").reshape(-1, p["dim"]), block, k))
                if found:
                    yield pa.RecordBatch.from_pydict({"query_id": np.repeat([x for x, _, _ in found], [len(y) for _, y, _ in found]).astype(np.int64), "vec_id": np.concatenate([y for _, y, _ in found]), "score": np.concatenate([z for _, _, z in found])})

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    # rows of a repeated vec_id with equal scores are ordered alike whichever comes first
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
