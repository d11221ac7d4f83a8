"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

The lattice of a text has an edge for each vocabulary piece that matches at a place, and for
a character without a piece of its own an edge of its UTF-8 byte pieces. A piece of rank r
(the model's order) weighs (r + 2) ** -alpha. Forward filtering sums the weights of all
paths to each place; backward sampling draws the last edge of a path in proportion, then the
one before it, and so on, which samples whole segmentations exactly by their weight. The
draws come from a counter-based hash of the row's key, so a row's segmentation depends on
nothing but its text, its key, the seed, alpha and the model.

Pieces of this model hold space marks only in front, or are space marks alone, so the
lattice falls apart where spaces or a line feed begin: each distinct run, of spaces and what
follows them, is filtered once a batch and drawn from as often as it occurs. Shares are
counted in units of 2 ** -30, in whole numbers, so that a draw never depends on what else is
in the batch. A space mark character in the text itself is written in bytes. Decoding is
lossless: it joins the pieces and drops the one space that stands before every text.

Defined results: null text gives a null list, empty text an empty one; a null key draws like
the smallest 64-bit integer; repeated rows get equal segmentations.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, trim

MARK = "▁"
RUN = re.compile(r" *[^ \n]+| +|\n")
GROUP_CHARS = 1_500_000
LATTICE_CHARS = 150_000       # of the runs that are filtered at once
UNIT_BITS = 30
NULL_KEY = -(1 << 63)
_B = np.array([0x9E3779B97F4A7C15], np.uint64)
_SLOTS = 20


@dataclass
class Vocabulary:
    hashes: np.ndarray      # sorted hashes of the usable pieces
    ids: np.ndarray         # piece id by place in hashes
    slots: np.ndarray       # which slots of a small hash table are in use
    max_len: int
    byte_ids: np.ndarray    # piece id of each byte
    log_weight: np.ndarray  # by piece id
    output: list            # bytes of each piece id; None for controls


def _hash(codes: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in codes:
        h = h * _B + np.uint64(int(c) + 1)
    return h[0]


_LOADED: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(model_path: str, alpha: float) -> Vocabulary:
    if (model_path, alpha) in _LOADED:
        return _LOADED[model_path, alpha]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    byte_ids, output, found = np.full(256, -1, np.int64), [None] * n, {}
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            output[i] = bytes([int(piece[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i)):
            output[i] = piece.replace(MARK, " ").encode()
            body = piece.strip(MARK) and piece.removeprefix(MARK)
            if MARK not in body and " " not in body and "\n" not in body:
                found[_hash(np.array([ord(c) if c != MARK else 32 for c in piece]))] = (i, len(piece))
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so decoding could not be lossless")
    hashes = np.array(sorted(found), np.uint64)
    slots = np.zeros(1 << _SLOTS, dtype=bool)
    slots[_slot(hashes)] = True
    _LOADED[model_path, alpha] = Vocabulary(hashes, np.array([found[h][0] for h in hashes], np.int64), slots, max(size for _, size in found.values()), byte_ids, -alpha * np.log(np.arange(n) + 2.0), output)
    return _LOADED[model_path, alpha]


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Lattice:
    """Edges of many runs, sorted by the node they end at; node numbers go through all runs."""

    first: np.ndarray       # node of each run's start
    last: np.ndarray        # and end
    start: np.ndarray       # node at which each edge starts
    until: np.ndarray       # end node and the cumulated share of the edges there, in units
    piece: np.ndarray       # piece id, or -1 - code point for the bytes of a character
    nodes: int


def lattices(runs: list[str], v: Vocabulary) -> Lattice:
    """One lattice of all runs, filtered in portions so that memory stays small."""
    parts, a, size, nodes = [], 0, 0, 0
    for i, run in enumerate(runs):
        size += len(run)
        if size >= LATTICE_CHARS or i == len(runs) - 1:
            g = lattice(runs[a:i + 1], v)
            parts.append((g.first + nodes, g.last + nodes, g.start + np.int32(nodes), g.until + (nodes << UNIT_BITS), g.piece))
            nodes, a, size = nodes + g.nodes, i + 1, 0
    return Lattice(*map(np.concatenate, zip(*parts)), nodes)


def lattice(runs: list[str], v: Vocabulary) -> Lattice:
    sizes = np.array([len(r) for r in runs], dtype=np.int64)
    codes = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), "<i4")
    run = np.repeat(np.arange(len(runs), dtype=np.int32), sizes)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32)
    at = np.arange(len(codes), dtype=np.int32)
    left = (base + sizes.astype(np.int32))[run] - at  # characters from here to the run's end
    node = at + run                                   # each run has one node more than characters
    h = np.zeros(len(codes), np.uint64)
    starts, ends, pieces, logs, lengths = [], [], [], [], []
    single = np.zeros(len(codes), dtype=bool)
    for size in range(1, v.max_len + 1):
        fits = left[at] >= size
        at, h = at[fits], h[fits]
        if not len(at):
            break
        h = h * _B + (codes[at + size - 1] + 1).astype(np.uint64)
        maybe = np.flatnonzero(v.slots[_slot(h)])
        where = np.searchsorted(v.hashes, h[maybe])
        ok = v.hashes[np.minimum(where, len(v.hashes) - 1)] == h[maybe]
        here, ids = at[maybe[ok]], v.ids[where[ok]]
        if size == 1:
            single[here] = True
        starts.append(node[here])
        ends.append(node[here] + size)
        pieces.append(ids.astype(np.int32))
        logs.append(v.log_weight[ids])
        lengths.append(np.full(len(here), size, np.int8))
    bare = np.flatnonzero(~single)
    if len(bare):
        kinds, which = np.unique(codes[bare], return_inverse=True)
        weight = np.array([v.log_weight[v.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))]].sum() for c in kinds])
        starts.append(node[bare])
        ends.append(node[bare] + 1)
        pieces.append(-1 - codes[bare])
        logs.append(weight[which])
        lengths.append(np.ones(len(bare), np.int8))
    start, end, piece, log, length = map(np.concatenate, (starts, ends, pieces, logs, lengths))
    first = base + np.arange(len(runs), dtype=np.int32)
    total = np.full(len(codes) + len(runs), -np.inf)
    total[first] = 0
    # all edges that end t characters into their run, by t and then by length
    depth = (end - np.repeat(first, sizes + 1)[end]).astype(np.int64)
    step = depth * (v.max_len + 1) + length
    order = np.argsort(step, kind="stable")
    step = step[order]
    cuts = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]])) if len(step) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        e = order[a:b]
        total[end[e]] = np.logaddexp(total[end[e]], total[start[e]] + log[e])
    order = np.argsort(end, kind="stable")
    start, end, piece, log = start[order], end[order], piece[order], log[order]
    share = (np.exp(total[start] + log - total[end]) * (1 << UNIT_BITS)).astype(np.int64)
    # the running share starts afresh at each node; its last value there is a whole
    run_sum = np.cumsum(share)
    new = np.concatenate([[True], end[1:] != end[:-1]])
    before = np.repeat((run_sum - share)[new], np.diff(np.append(np.flatnonzero(new), len(end))))
    within = np.minimum(run_sum - before, 1 << UNIT_BITS)
    within[np.append(new[1:], True)] = 1 << UNIT_BITS
    return Lattice(first, first + sizes, start, (end.astype(np.int64) << UNIT_BITS) + within, piece, len(total))


class _Numbers(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def sample_ids(texts: list[str], keys: np.ndarray, v: Vocabulary, seed: int) -> list[np.ndarray]:
    """One sampled segmentation of each text, as piece ids."""
    distinct = _Numbers()
    number_of = distinct.__getitem__
    occurrence, counts = [], []
    for text in texts:
        runs = RUN.findall(" " + text) if text else []
        counts.append(len(runs))
        occurrence.extend(map(number_of, runs))
    if not occurrence:
        return [np.zeros(0, np.int32) for _ in texts]
    # a space mark of the text itself must not meet the pieces' marks: it has code 0x2581 here, theirs 32
    g = lattices(list(distinct), v)
    which, counts = np.array(occurrence), np.array(counts)
    row = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(which)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    stream = _mix(_mix(keys.astype(np.int64).view(np.uint64) + np.array([seed % (1 << 64)], np.uint64) * _B)[row] ^ (number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    at, first = g.last[which], g.first[which]
    live = np.argsort(which, kind="stable")  # in the lattice's order, so that searches stay near each other
    owner, edges, step = [], [], 0
    width = np.ones(len(g.piece), np.int64)
    odd = np.flatnonzero(g.piece < 0)
    if len(odd):
        kinds, kind = np.unique(-1 - g.piece[odd], return_inverse=True)
        as_bytes = [chr(c).encode("utf-8", "surrogatepass") for c in kinds]
        width[odd] = np.array([len(x) for x in as_bytes])[kind]
    done = np.zeros(len(which), np.int64)
    tails = []
    while len(live):
        u = (_mix(stream[live] + np.array([step + 1], np.uint64) * _B) >> np.uint64(64 - UNIT_BITS)).astype(np.int64)
        # edges ending at node n reach from n to n + 1 wholes in `until`
        e = np.searchsorted(g.until, (at[live].astype(np.int64) << UNIT_BITS) + u, side="right")
        owner.append(live)
        edges.append(e)
        done[live] += width[e]
        tails.append(done[live])
        at[live] = g.start[e]
        live = live[at[live] > first[live]]
        step += 1
    owner, edges, tails = np.concatenate(owner), np.concatenate(edges), np.concatenate(tails)
    ends = np.cumsum(done)
    out = np.empty(int(ends[-1]), np.int32)
    to = ends[owner] - tails
    plain = g.piece[edges] >= 0
    out[to[plain]] = g.piece[edges[plain]]
    if len(odd):
        kind_of = np.full(len(g.piece), -1, np.int64)
        kind_of[odd] = kind
        for t, k in zip(to[~plain], kind_of[edges[~plain]]):
            raw = as_bytes[k]
            out[t:t + len(raw)] = v.byte_ids[list(raw)]
    cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return [out[a:b] for a, b in zip(cut[:-1], cut[1:])]


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of the ids; controls and unknowns stand for nothing."""
    table = v.output
    return b"".join([table[i] or b"" for i in ids.tolist()])[1:].decode("utf-8", "surrogatepass")


def _groups(texts: list, most: int = GROUP_CHARS):
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 8
        if size >= most or i == len(texts) - 1:
            yield a, i + 1
            a, size = i + 1, 0


def encode(docs: DataFrame, model_path: str, seed: int = 0, alpha: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids of every row: the sampled segmentation. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path, alpha)
        for batch in batches:
            keys, texts = batch.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in _groups(texts):
                ids = sample_ids([t or "" for t in texts[a:b]], keys[a:b], v, seed)
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                none = np.array([t is None for t in texts[a:b]] + [False])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32(), mask=none), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["key", "ids"])
                ids = lists = None
                trim()

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"`{key}` long, ids array<int>")


def decoded(encoded: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """key, text of every row of ids; null ids give null text."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        v = vocabulary(model_path, 1.0)
        ids = batch.column(1)
        flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        return pa.table({"key": batch.column(0), "text": pa.array([decode(flat[a:b], v) if ok else None for ok, a, b in zip(valid, at[:-1], at[1:])], pa.string())})

    return map_batches(encoded.select(key, "ids"), run, f"`{key}` long, text string")


def round_trip(docs: DataFrame, model_path: str, seed: int = 0, alpha: float = 0.5) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers),
    n_chars of the decoded text, lossless: whether it equals the text."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        v = vocabulary(model_path, alpha)
        keys, texts = batch.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        n, crc, chars, same = [], [], [], []
        for a, b in _groups(texts):
            for text, ids in zip(texts[a:b], sample_ids([t or "" for t in texts[a:b]], keys[a:b], v, seed)):
                back = decode(ids, v)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                chars.append(len(back))
                same.append(back == (text or ""))
        return pa.table({"doc_id": batch.column(0), "n_ids": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "n_chars": pa.array(chars, pa.int64()), "lossless": pa.array(same, pa.bool_())})

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_ids long, ids_crc32 long, n_chars long, lossless boolean")
