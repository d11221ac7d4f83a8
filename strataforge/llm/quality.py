"""Compression classifier of text quality.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text is cut
into blocks, each block is compressed with either dictionary, and the difference of the two
compressed sizes, divided by the text's size, is turned into a probability by a logistic
curve fitted on labelled texts that built neither dictionary.

Defined results: a null or empty text has difference 0 and gets the curve's value there;
without labels of both classes every score is 0.5. Repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, crc_fold, labelled_sample, map_batches

LEVEL = 3
BLOCK_BYTES = 4096
DICT_BYTES = 32_768


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the logistic curve: constant, difference, log size


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(content)


def build_dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; for samples too small to train on, their end as raw content."""
    blocks = [t[i:i + BLOCK_BYTES] for t in texts for i in range(0, len(t), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:] or b" "


def _compressors(model: CompressionModel) -> list[zstandard.ZstdCompressor]:
    return [
        zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_content_size=False, write_dict_id=False, write_checksum=False)
        for d in (model.good, model.bad)
    ]


def differences(texts: list[bytes], model: CompressionModel) -> np.ndarray:
    """One row for each text: 1, (bad size - good size) / size, log size."""
    good, bad = _compressors(model)
    out = np.zeros((len(texts), 3))
    out[:, 0] = 1
    for i, text in enumerate(texts):
        diff = 0
        for at in range(0, len(text), BLOCK_BYTES):
            block = text[at:at + BLOCK_BYTES]
            diff += len(bad.compress(block)) - len(good.compress(block))
        if text:
            out[i, 1] = diff / len(text)
            out[i, 2] = np.log(len(text))
    return out


def _features(x: np.ndarray) -> np.ndarray:
    d, size = x[:, 1] * 100, x[:, 2]
    return np.column_stack([x[:, 0], d, np.clip(d, -1, 1) * size, np.where(size > 0, size - 6, 0)])


def fit_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method with step halving by damping."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta += step * min(1.0, 2.0 / (1e-12 + np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 3000, max_doc_bytes: int = 32_768) -> CompressionModel | None:
    """Learns from at most rows_per_class labelled rows of either class outside fold 0 of 5."""
    rows, counts = labelled_sample(docs, labels, "quality", crc_fold("doc_id", 5) != 0, rows_per_class, max_doc_bytes)
    texts = {y: [t.encode() for _, label, t in rows if label == y] for y in (0, 1)}
    if min(map(len, texts.values())) < 2:
        return None
    # the odd rows build the dictionaries, the even rows fit the curve
    model = CompressionModel(build_dictionary(texts[1][1::2]), build_dictionary(texts[0][1::2]), ())
    held = {y: texts[y][::2] for y in (0, 1)}
    x = _features(differences(held[0] + held[1], model))
    y = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
    total = counts[0] + counts[1]
    weight = np.where(y == 1, counts[1] / total / len(held[1]), counts[0] / total / len(held[0])) * len(y)
    return CompressionModel(model.good, model.bad, tuple(fit_curve(x, y, weight)))


def probabilities(texts: list[bytes], model: CompressionModel | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    return 1 / (1 + np.exp(-np.clip(_features(differences(texts, model)) @ np.array(model.weights), -30, 30)))


def score(docs: DataFrame, model: CompressionModel | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every whole text; one pass, no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        p = probabilities(binary_values(batch.column(1)), model)
        return pa.table({"doc_id": batch.column(0), "score": p, "predicted": (p >= threshold).astype(np.int32)})

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, **sample) -> DataFrame:
    """doc_id, held_out (fold 0 of 5, unused in fitting), score, predicted."""
    out = score(docs, fit(docs, labels, **sample))
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
