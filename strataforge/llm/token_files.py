"""Token-id files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

A dataset is a folder of parts. Part k holds the documents of one range of doc_id, ascending:

    part-k.bin   token ids, little-endian unsigned 16 bit if the vocabulary fits, else 32 bit
    part-k.idx   n + 1 little-endian signed 64-bit offsets, in tokens from the part's start
    part-k.ids   n little-endian signed 64-bit doc_ids; the part's null ids come first

and index.json: the id width, and for each part its documents, leading null ids, tokens, and
its base, the prefix sum of the tokens of all parts before it. Each part is written to a
name of the task attempt's own and then renamed, so a repeated or speculative attempt leaves
one whole part.

Defined results: null text is empty and has the end id only; null doc_ids sort first; rows
of the same doc_id are all kept, ordered by a hash of their text; an empty table makes a
dataset without parts.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

MAX_CACHED_WORDS = 1_200_000
GROUP_BYTES = 4_000_000
READ_ROWS = 8192


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)


class WordCachedEncoder:
    """Encodes with the tokenizers library, each distinct run between ASCII spaces once.

    The tokenizers meant here drop white space before their merges, so no token spans it and
    the ids of a text are those of its runs in order. Of runs of Latin letters, digits and
    marks, the parts into which the tokenizer's own pattern splits the lower-cased run are
    kept too, as many runs share them. Tokenizers of another build get whole texts.
    """

    def __init__(self, path: str):
        import json as js

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        probe = [self._whole("a b"), self._whole("a") + self._whole("b"), self._whole("a \n\tb")]
        self.by_word = probe[0] == probe[1] == probe[2]
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        build = js.loads(self.tokenizer.to_str())
        normal = [x["type"] for x in (build["normalizer"] or {}).get("normalizers", [])]
        split = ((build["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.pattern = None
        if set(normal) <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in normal and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert"):
            self.pattern = regex.compile(split["pattern"]["Regex"])
        # a vocabulary with a word-end suffix says where each part of a text ends
        suffix = build["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix and self.pattern:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        # NFC leaves characters below U+0240 as they are; special tokens start with <|
        self.odd = regex.compile(rb"[\x00-\x08\x0e-\x1f\x7f\xc9-\xff]|\xc2[\x80-\xa0]|<[|]")

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that the pattern leaves whole: encoded many to a text, and told apart
        by the ids that end a word, where the vocabulary marks those."""
        if self.ends is None:
            return self._batch(parts)
        runs = [parts[i:i + 256] for i in range(0, len(parts), 256)]
        out = []
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(run):
                out += self._batch(run)
                continue
            raw, at, size = ids.tobytes(), 0, self.dtype.itemsize
            for cut in (cuts * size).tolist():
                out.append(raw[at:cut])
                at = cut
        return out

    def _learn(self, new: list[bytes], check: bool) -> None:
        """check: whether a run may hold characters that the pattern alone can't deal with."""
        if len(self.parts) > MAX_CACHED_WORDS // 2:
            self.parts.clear()
        parts, whole, odd, findall = [], [], self.odd.search, self.pattern.findall if self.pattern else None
        for i, w in enumerate(new):
            if findall is None or (check and odd(w)):
                whole.append(i)
                parts.append(None)
                continue
            t = w.decode().lower()
            if t.isalpha():
                parts.append((t,))
            elif t[:-1].isalpha() and t[-1] in ".,;:?!":
                parts.append((t[:-1], t[-1]))
            else:
                parts.append(findall(t))
        for i, ids in zip(whole, self._batch([new[i].decode() for i in whole])):
            self.words[new[i]] = ids
        missing = list({x for p in parts if p for x in p}.difference(self.parts))
        self.parts.update(zip(missing, self._parts(missing)))
        get, put, join = self.parts.__getitem__, self.words.__setitem__, b"".join
        for w, p in zip(new, parts):
            if p is not None:
                put(w, get(p[0]) if len(p) == 1 else join(map(get, p)))

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, each text followed by end, and where
        each text ends."""
        tail = np.array([] if end is None else [end], self.dtype)
        if not self.by_word:
            ids = [np.append(np.frombuffer(x, self.dtype), tail) for x in self._batch([t.decode() for t in texts])]
            return np.concatenate(ids), np.cumsum([len(x) for x in ids])
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        kind, start, stop = distinct_runs(data)
        raw = data.tobytes()
        runs = [raw[i:j] for i, j in zip(start[kind.first].tolist(), stop[kind.first].tolist())]
        words = self.words
        if len(words) > MAX_CACHED_WORDS:
            words.clear()
        new = [w for w in runs if w not in words]
        if new:
            self._learn(new, self.odd.search(raw) is not None)
        packed = [words[w] for w in runs]
        flat = np.frombuffer(b"".join(packed), self.dtype)
        size = np.array([len(p) for p in packed], np.int64) // self.dtype.itemsize
        origin = np.concatenate([[0], np.cumsum(size)])[:-1]
        # a text's end counts as one more run, of the end id alone
        last = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
        n = len(texts) if end is not None else 0
        which = np.insert(kind.number, last, len(runs)) if n else kind.number
        flat, size, origin = np.append(flat, tail), np.append(size, len(tail)), np.append(origin, len(flat))
        counts = size[which]
        before = np.cumsum(counts) - counts
        total = int(counts.sum())
        at = np.ones(total, np.int64)
        full = counts > 0
        jump = origin[which][full]
        step = before[full]
        at[step] = jump
        at[step[1:]] -= jump[:-1] + counts[full][:-1] - 1
        ids = flat[np.cumsum(at)] if total else flat[:0]
        ends = np.append(before, total)[last + (np.arange(1, len(texts) + 1) if n else 0)]
        return ids, ends


@dataclass
class Distinct:
    number: np.ndarray  # of each run, which distinct run it is
    first: np.ndarray   # of each distinct run, the first place it has


_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def distinct_runs(data: np.ndarray) -> tuple[Distinct, np.ndarray, np.ndarray]:
    """The runs of non-space bytes of data, which ends in a space: which are equal, where they
    start and stop. Equal hashes are compared byte by byte, so the answer is exact."""
    if len(_POWERS[0]) < len(data):
        for i, base in enumerate((_MULTIPLIER, _INVERSE)):
            factor = np.full(len(data), np.uint64(base))
            factor[0] = 1
            _POWERS[i] = np.cumprod(factor)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    start, stop = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[0][:len(data)])])
    h = (sums[stop] - sums[start]) * _POWERS[1][start]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    number, values = pd.factorize(h)
    first = np.full(len(values), len(h), np.int64)
    first[number[::-1]] = np.arange(len(h) - 1, -1, -1)
    size = stop - start
    same = size == size[first[number]]
    if same.all() and len(size):
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        same = np.array([np.array_equal(data[np.repeat(start, size) + within], data[np.repeat(start[first[number]], size) + within])])
    if len(size) and not same.all():
        seen: dict[bytes, int] = {}
        raw = data.tobytes()
        number = np.array([seen.setdefault(raw[i:j], len(seen)) for i, j in zip(start.tolist(), stop.tolist())])
        first = np.full(len(seen), len(h), np.int64)
        first[number[::-1]] = np.arange(len(h) - 1, -1, -1)
    return Distinct(number, first), start, stop


_ENCODERS: dict[str, WordCachedEncoder] = {}


def encoder_for(path: str) -> WordCachedEncoder:
    """One encoder, and so one cache, for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordCachedEncoder(path)
    return _ENCODERS[path]


def groups(values: list, most: int) -> Iterator[list]:
    """Consecutive runs of values of about most bytes."""
    run, size = [], 0
    for v in values:
        run.append(v)
        size += len(v) + 16
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> dict:
    """Encodes every text, appends end_id, and writes the dataset; returns its index.

    One range shuffle of the texts by doc_id. The driver gets one row for each part.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_for(tokenizer_path)
        where, root = _located(path)
        k, mine = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = {x: (f"{root}/.{mine}.{x}", f"{root}/part-{k:06d}.{x}") for x in ("bin", "idx", "ids")}
        files, docs_n, nulls, tokens = None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                where.create_dir(root, recursive=True)
                files = {x: where.open_output_stream(a) for x, (a, _) in names.items()}
                files["idx"].write(np.zeros(1, "<i8").tobytes())
            ids = batch.column(0)
            nulls += ids.null_count
            docs_n += batch.num_rows
            files["ids"].write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            texts = [v or b"" for v in batch.column(1).cast(pa.large_binary()).to_pylist()]
            for some in groups(texts, GROUP_BYTES):
                packed, ends = encoder.encode(some, end_id)
                files["bin"].write(packed.tobytes())
                files["idx"].write((tokens + ends).astype("<i8").tobytes())
                tokens += len(packed)
        if files is not None:
            for x, (a, b) in names.items():
                files[x].close()
                if where.type_name != "local" and where.get_file_info(b).type != fs.FileType.NotFound:
                    where.delete_file(b)
                where.move(a, b)
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "documents": [docs_n], "null_ids": [nulls], "tokens": [tokens], "width": pa.array([encoder.dtype.itemsize], pa.int32())})

    order = F.xxhash64("text")
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), order.alias("h"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "h")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
        .select("doc_id", "text")
    )
    parts = ranged.mapInArrow(run, "part int, documents long, null_ids long, tokens long, width int").collect()
    index, base, first = {"width": max([p.width for p in parts], default=2), "parts": []}, 0, 0
    for p in sorted(parts, key=lambda p: p.part):
        index["parts"].append({"part": p.part, "documents": p.documents, "null_ids": p.null_ids, "tokens": p.tokens, "base": base, "first": first})
        base, first = base + p.tokens, first + p.documents
    where, root = _located(path)
    where.create_dir(root, recursive=True)
    with where.open_output_stream(f"{root}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def _mapped(where: fs.FileSystem, name: str, dtype: str) -> np.ndarray:
    """Memory-mapped where the folder is mounted, else read."""
    if where.type_name == "local":
        with pa.memory_map(name) as f:
            return np.frombuffer(f.read_buffer(), dtype)
    with where.open_input_file(name) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    where, root = _located(path)
    with where.open_input_stream(f"{root}/index.json") as f:
        index = json.loads(f.read())
    dtype = f"<u{index['width']}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = _located(path)
        for batch in batches:
            for p in batch.to_pylist():
                name = f"{root}/part-{p['part']:06d}"
                offsets, doc_ids = _mapped(where, f"{name}.idx", "<i8"), _mapped(where, f"{name}.ids", "<i8")
                tokens = _mapped(where, f"{name}.bin", dtype)
                for a in range(0, len(doc_ids), READ_ROWS):
                    b = min(a + READ_ROWS, len(doc_ids))
                    crc = [zlib.crc32(tokens[i:j].astype("<u4").tobytes()) for i, j in zip(offsets[a:b], offsets[a + 1:b + 1])]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(doc_ids[a:b], pa.int64(), mask=np.arange(a, b) < p["null_ids"]),
                        "start": pa.array(offsets[a:b] + p["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets[a:b + 1]), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    })

    rows = [(p["part"], p["null_ids"], p["base"]) for p in index["parts"]]
    parts = spark.createDataFrame(rows, "part int, null_ids long, base long")
    return parts.repartition(max(1, len(rows)), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Writes the dataset (in the shared folder unless path says where) and reads it back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    write(docs, path, tokenizer_path, end_id)
    return read(spark, path)
