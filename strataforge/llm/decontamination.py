"""Benchmark decontamination by the q-gram lemma.

Every benchmark item is cut into probes: overlapping windows of at most PROBE characters and,
in longer items, of SHORT characters at a small stride, each with an edit budget of RATE of its
length. So any verbatim excerpt of SHORT + SHORT_STRIDE - 1 = 71 characters holds a whole probe,
wherever in its item it lies. A text within e edits of a probe of L
characters shares at least L + 1 - q - q * e of its q-grams with it, on diagonals at most e
apart. So each document is scanned once: the q-grams it shares with the probes are counted
in overlapping diagonal bands, bands that reach the bound become regions, and a banded
alignment verifies each region. Where a phrase is common to many items, its q-grams have long
lists of probes; a text that holds them is then worked through by stretches of the text and
ranges of the probes that keep the lists in hand below POSTINGS, and many regions at a time
are aligned together, so memory doesn't follow their product. Text is compared lower-cased with white space runs as one
space; reported offsets are characters of the text as given.

Defined results: null, empty and too short texts have no hit; items shorter than q
characters, null or empty, are not searched for; equal items are reported each; every pair
of a document and an item is one row for each separate passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

Q = 10
PROBE, STRIDE = 96, 48
SHORT, SHORT_STRIDE = 60, 12
RATE = 0.07
TABLE_BITS = 20
GROUP_CHARS = 1_000_000
MAX_BROADCAST_CHARS = 2_400_000   # a character lies in about seven probes
PAD = 2 * PROBE                   # more than a window reaches beyond a text
POSTINGS = 1_000_000              # shared q-grams that are in hand at once
STRETCH = 2 * PROBE               # a region's q-grams lie within fewer positions
TOGETHER = 256                    # regions from which on they are first aligned together
_BASE = 0x9E3779B97F4A7C15
_B, _B2, _B4 = (np.uint64(pow(_BASE, k, 1 << 64)) for k in (1, 2, 4))
_SEP = "\U0010ffff"
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])  # no white space lies beyond


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the text in compared form, and the offset of each in the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    space = _SPACE[np.minimum(codes, 0x3001)]
    keep = ~space
    keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    return np.where(space[at], np.uint32(32), codes[at]), at


def q_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash of each run of Q = 10 code points, by doubling."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    c = codes.astype(np.uint64)
    h2 = c[:-1] * _B + c[1:]
    h4 = h2[:-2] * _B2 + h2[2:]
    h8 = h4[:-4] * _B4 + h4[4:]
    return h8[:-2] * _B2 + h2[8:]


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@dataclass
class ProbeIndex:
    items: np.ndarray      # item_id of each probe
    probes: list           # code points of each probe
    starts: np.ndarray     # offset of each probe in its item
    budgets: np.ndarray    # edits allowed
    bounds: np.ndarray     # q-grams that must be shared
    slots: np.ndarray      # which slots of the hash table are in use
    hashes: np.ndarray     # sorted distinct q-gram hashes
    first: np.ndarray      # postings of hash i: first[i] to first[i + 1]
    post_probe: np.ndarray
    post_at: np.ndarray


def build_index(items: list[tuple[int, str]]) -> ProbeIndex:
    ids, probes, starts = [], [], []
    whole = [(item_id, codes) for item_id, text in sorted(items) if len(codes := normalised(text.strip())[0]) >= Q]
    # the long probes of all items come first, so that find_regions verifies them first
    for size, stride in ((PROBE, STRIDE), (SHORT, SHORT_STRIDE)):
        for item_id, codes in whole:
            if size == SHORT and len(codes) <= SHORT:
                continue
            last = max(0, len(codes) - size)
            for a in sorted({*range(0, last, stride), last}):
                ids.append(item_id)
                starts.append(a)
                probes.append(codes[a:a + size])
    length = np.array([len(p) for p in probes], dtype=np.int64)
    budgets = (length * RATE).astype(np.int64)
    # where the lemma's bound is void the budget shrinks until it holds again
    budgets = np.minimum(budgets, np.maximum(0, (length - Q) // Q))
    bounds = length + 1 - Q - Q * budgets
    hs = [q_hashes(p) for p in probes]
    h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
    probe = np.repeat(np.arange(len(hs)), [len(x) for x in hs]) if hs else np.zeros(0, np.int64)
    at = np.concatenate([np.arange(len(x)) for x in hs]) if hs else np.zeros(0, np.int64)
    order = np.lexsort((at, probe, h))
    probe, at = probe.astype(np.int32), at.astype(np.int16)
    hashes, first = np.unique(h[order], return_index=True)
    slots = np.zeros(1 << TABLE_BITS, dtype=bool)
    slots[_slot(hashes)] = True
    return ProbeIndex(np.array(ids, dtype=np.int64), probes, np.array(starts, dtype=np.int64), budgets, bounds, slots, hashes, np.append(first, len(h)), probe[order], at[order])


def banded_edits(probe: np.ndarray, text: np.ndarray, budget: int) -> tuple[int, int]:
    """Fewest edits between the probe and any stretch of text that starts in it anywhere in
    the band 0 <= text position - probe position <= len(text) - len(probe), and that
    stretch's end; the band is as wide as the text exceeds the probe."""
    width = max(1, len(text) - len(probe) + 1)
    padded = np.full(len(probe) + width, np.uint32(0x110000))
    padded[:min(len(text), len(padded))] = text[:len(padded)]
    steps = np.arange(width)
    row = np.zeros(width, dtype=np.int64)
    for i in range(len(probe)):
        new = row + (padded[i:i + width] != probe[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > budget:
            return budget + 1, 0
    best = int(row.argmin())
    return int(row[best]), min(len(probe) + best, len(text))


def _shared(index: ProbeIndex, at: np.ndarray, where: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(probe, offset in it, position) of the shared q-grams, in portions of bounded size. All
    that belong to one region are in one portion; it may be in two.

    at: ascending positions, where: their places among the index's hashes."""
    n = index.first[where + 1] - index.first[where]
    ends = np.cumsum(n)
    a = 0
    while a < len(at):
        # from a on, as many positions as fit, but a stretch at least
        b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POSTINGS, side="right")), int(np.searchsorted(at, at[a] + STRETCH)))
        start = int(np.searchsorted(at, at[a] - STRETCH)) if a else 0
        some, place, size = where[start:b], at[start:b], n[start:b]
        low = index.first[some]
        ranges = -(-int(size.sum()) // (4 * POSTINGS))
        if ranges == 1:
            yield _expanded(index, low, size, place)
        else:
            # a hash's list is ordered by probe, so a range of probes is a part of it
            lists, which = np.unique(some, return_inverse=True)
            cuts = np.linspace(0, len(index.items), ranges + 1).astype(np.int64)
            split = np.array([index.first[x] + np.searchsorted(index.post_probe[index.first[x]:index.first[x + 1]], cuts) for x in lists])
            for i in range(ranges):
                yield _expanded(index, split[which, i], (split[:, i + 1] - split[:, i])[which], place)
        a = b


def _expanded(index: ProbeIndex, low: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    posting = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return index.post_probe[posting], index.post_at[posting], np.repeat(at, n)


def _banded(index: ProbeIndex, probe: np.ndarray, offset: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """(probe, first diagonal) of each band that shares as many q-grams as the lemma asks for."""
    diagonal = pos - offset
    step = index.budgets[probe] + 1
    found = []
    # bands of two steps, one step apart: any e + 1 neighbouring diagonals lie in one of them
    for shift in (0, 1):
        band = (diagonal + shift * step) // (2 * step)
        key = np.lexsort((offset, band, probe))
        p, b, o = probe[key], band[key], offset[key]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (p[1:] != p[:-1]) | (b[1:] != b[:-1]) | (o[1:] != o[:-1])
        p, b = p[fresh], b[fresh]
        edge = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (b[1:] != b[:-1])])) if len(p) else np.zeros(0, np.int64)
        edge = edge[np.diff(np.append(edge, len(p))) >= index.bounds[p[edge]]]
        step_of_edge = index.budgets[p[edge]] + 1
        found.append(np.column_stack([p[edge], b[edge] * 2 * step_of_edge - shift * step_of_edge]))
    return np.unique(np.concatenate(found), axis=0)


def _aligned(codes: np.ndarray, index: ProbeIndex, found: np.ndarray) -> np.ndarray:
    """Those of many (probe, first diagonal) whose probe has an alignment within its budget,
    by banded_edits' recurrence over rows of candidates."""
    keep = np.zeros(len(found), dtype=bool)
    sizes, budgets = np.array([len(x) for x in index.probes])[found[:, 0]], index.budgets[found[:, 0]]
    for size, budget in np.unique(np.column_stack([sizes, budgets]), axis=0).tolist():
        chosen = np.flatnonzero((sizes == size) & (budgets == budget))
        width = 2 * (budget + 1) + 2 * budget + 1
        steps = np.arange(width, dtype=np.int16)
        for some in np.array_split(chosen, -(-len(chosen) // 2048)):
            at = (found[some, 1] - budget)[:, None] + np.arange(size + width)
            text = np.where((at >= 0) & (at < len(codes)), codes[np.clip(at, 0, len(codes) - 1)], np.uint32(0x110000))
            probes = np.stack([index.probes[k] for k in found[some, 0]])
            row = np.zeros((len(some), width), np.int16)
            for i in range(size):
                new = row + (text[:, i:i + width] != probes[:, i:i + 1])
                new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
                row = np.minimum.accumulate(new - steps, axis=1) + steps
                if i % 8 == 7:
                    alive = row.min(axis=1) <= budget
                    if not alive.all():
                        some, text, probes, row = some[alive], text[alive], probes[alive], row[alive]
                    if not len(some):
                        break
            if len(some):
                keep[some[row.min(axis=1) <= budget]] = True
    return found[keep]


def find_regions(codes: np.ndarray, index: ProbeIndex) -> list[tuple[int, int, int, int]]:
    """(start, end, probe, edits) of every verified region of the code points, but for those of
    short probes inside a region that their item already has by a long one."""
    n_codes = len(codes)
    # windows at either end stay whole, so that edits may shift the first and last diagonals
    codes = np.concatenate([np.full(PAD, np.uint32(ord(_SEP))), codes, np.full(PAD, np.uint32(ord(_SEP)))])
    h = q_hashes(codes)
    at = np.flatnonzero(index.slots[_slot(h)]) if len(h) and len(index.hashes) else np.zeros(0, np.int64)
    if not len(at):
        return []
    where = np.searchsorted(index.hashes, h[at])
    good = (where < len(index.hashes)) & (index.hashes[np.minimum(where, len(index.hashes) - 1)] == h[at])
    at, where = at[good], where[good]
    found = []
    for portion in _shared(index, at, where):
        some = _banded(index, *portion)
        found.append(_aligned(codes, index, some) if len(some) > TOGETHER else some)
    if not found:
        return []
    out, seen, covered = [], set(), {}
    # long probes come first
    for k, low in np.unique(np.concatenate(found), axis=0).tolist():
        probe_codes, budget = index.probes[k], int(index.budgets[k])
        size, wide = len(probe_codes), 2 * (budget + 1)
        item = int(index.items[k])
        inside = covered.get((item, (low + size // 2) // PROBE), ())
        if any(s <= low and low + wide + size <= t for s, t in inside):
            continue
        a, z = max(0, low - budget), min(len(codes), low + wide + size + budget)
        window = codes[a:z]
        exact = [s for s in range(max(0, low) - a, min(low + wide, len(codes) - size + 1) - a) if s >= 0 and window[s] == probe_codes[0] and np.array_equal(window[s:s + size], probe_codes)]
        if exact:
            spans = [(a + s, a + s + size, 0) for s in exact]
        else:
            edits, end = banded_edits(probe_codes, window, budget)
            spans = [(max(0, a + end - size), a + end, edits)] if edits <= budget else []
        for s, t, edits in spans:
            if (k, s) not in seen:
                seen.add((k, s))
                out.append((max(0, s - PAD), min(n_codes, t - PAD), k, edits))
                if size > SHORT:
                    for place in range(s // PROBE, t // PROBE + 1):
                        covered.setdefault((item, place), []).append((s, t))
    return out


def passages(regions: list[tuple[int, int, int, int]], index: ProbeIndex, gap: int = STRIDE) -> list[tuple[int, int, int, int]]:
    """(item_id, start, end, edits): regions of an item that overlap or nearly meet, as one."""
    out: list[list[int]] = []
    for item, s, t, edits in sorted((int(index.items[k]), s, t, edits) for s, t, k, edits in regions):
        if out and out[-1][0] == item and s <= out[-1][2] + gap // 4:
            out[-1][2], out[-1][3] = max(out[-1][2], t), max(out[-1][3], edits)
        else:
            out.append([item, s, t, edits])
    return [tuple(x) for x in out]


def _scan_texts(texts: list, index: ProbeIndex) -> list[tuple]:
    """(row, item_id, start, end, edits) of each passage in the texts."""
    rows: list[tuple] = []
    group: list[int] = []
    size = 0
    for i in range(len(texts) + 1):
        if i < len(texts):
            if texts[i]:
                group.append(i)
                size += len(texts[i])
            if size < GROUP_CHARS:
                continue
        if group:
            rows += _scan_group(group, [texts[j] for j in group], index)
        group, size = [], 0
    return rows


def _scan(docs: DataFrame, index: ProbeIndex) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.Table | None:
        ids = batch.column(0).to_pylist()
        rows = _scan_texts(batch.column(1).to_pylist(), index)
        if not rows:
            return None
        at, item, s, t, edits = zip(*rows)
        return pa.table({"doc_id": pa.array([ids[i] for i in at], pa.int64()), "item_id": pa.array(item, pa.int64()), "start": pa.array(s, pa.int32()), "end": pa.array(t, pa.int32()), "edits": pa.array(edits, pa.int32())})

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, item_id long, start int, end int, edits int")


def _without_hits(docs: DataFrame, index: ProbeIndex) -> DataFrame:
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hit = {row for row, *_ in _scan_texts(batch.column(at).to_pylist(), index)}
        return batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def _scan_group(ids: list, texts: list[str], index: ProbeIndex) -> list[tuple]:
    """Scans several texts at once, set apart by a code point that no text has."""
    codes, at = normalised(_SEP.join(t.replace(_SEP, " ") for t in texts))
    regions = find_regions(codes, index)
    if not regions:
        return []
    cuts = np.flatnonzero(codes == ord(_SEP))
    out = []
    by_doc: dict[int, list] = {}
    for s, t, k, edits in regions:
        doc = int(np.searchsorted(cuts, (s + t) // 2))
        low = int(cuts[doc - 1]) + 1 if doc else 0
        high = int(cuts[doc]) if doc < len(cuts) else len(codes)
        by_doc.setdefault(doc, []).append((max(s, low), min(t, high), k, edits))
    for doc, some in sorted(by_doc.items()):
        origin = int(at[cuts[doc - 1]]) + 1 if doc else 0
        for item, s, t, edits in passages(some, index):
            out.append((ids[doc], item, int(at[s]) - origin, int(at[t - 1]) + 1 - origin, edits))
    return out


def _indexes(benchmark: DataFrame) -> Iterator[ProbeIndex]:
    """The probes of the benchmark. Their size is measured first; a benchmark over
    MAX_BROADCAST_CHARS characters is split by item into as many passes as hold it."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    passes = max(1, -(-chars // MAX_BROADCAST_CHARS))
    for k in range(passes):
        some = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        yield build_index([(r.item_id, r.text) for r in some.collect()])


def contaminated_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits of each benchmark passage in a document. The probes
    go to the executors with the task."""
    out = None
    for index in _indexes(benchmark):
        part = _scan(docs, index)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark passage, whatever their doc_id; all columns,
    no shuffle: the rows are filtered where they are scanned."""
    for index in _indexes(benchmark):
        docs = _without_hits(docs, index)
    return docs
