"""Multiple-instance toxicity model: sentences are instances, documents are bags.

A word's features are its prefixes of 3 to 7 characters and the whole word, case folded; a
sentence's score is the logistic of a constant plus its words' weights; a document's score
is the noisy-or of its sentences. Only document labels are learnt from, by the gradient of
the noisy-or's likelihood, so the model finds the sentences that explain a label.

Defined results: a null or empty text has no sentence and scores 0; without labels of both
classes every score is 0. A text without sentence marks is one sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, labelled_sample, map_batches

SENTENCE = re.compile(r"[.!?\n]+[\s]*")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 8)
MAX_CACHED_WORDS = 200_000


@dataclass(frozen=True)
class MilModel:
    bias: float
    weights: dict[str, float]


def word_features(word: str) -> list[str]:
    return [word[:k] for k in PREFIXES if k < len(word)] + [word + "$"]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of the sentences, without the white space between them."""
    out, at = [], 0
    for m in SENTENCE.finditer(text):
        if m.end() > at and text[at:m.end()].strip():
            out.append((at, m.end()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


class _WordWeights(dict):
    """Weight of each word met, worked out once; emptied when it holds too many."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > MAX_CACHED_WORDS:
            self.clear()
        get = self.weights.get
        total = get(word + "$", 0.0)
        for k in PREFIXES:
            if k < len(word):
                total += get(word[:k], 0.0)
        self[word] = total
        return total


def _log_or(z: np.ndarray) -> float:
    """Sum of softplus: -log(1 - noisy-or)."""
    return float(np.logaddexp(0, z).sum())


def sentence_scores(text: str, model: MilModel, cache: _WordWeights) -> np.ndarray:
    spans = sentence_spans(text)
    lower = text.lower()
    if len(lower) != len(text):  # a few letters lower to two characters: then by sentence
        parts = [text[a:b].lower() for a, b in spans]
    else:
        parts = [lower[a:b] for a, b in spans]
    return np.array([model.bias + sum([cache[w] for w in WORD.findall(p)]) for p in parts])


def train(rows: list[tuple[int, str]], counts: dict[int, int], max_features: int = 6000, min_docs: int = 3, steps: int = 250, l2: float = 1e-4, start: float = -6.0) -> MilModel | None:
    """Noisy-or likelihood by Adam over the max_features features that tell the classes apart best."""
    n = {y: sum(label == y for label, _ in rows) for y in (0, 1)}
    if not n[0] or not n[1]:
        return None
    bags = [[sorted({f for w in set(WORD.findall(text[a:b].lower())) for f in word_features(w)}) for a, b in sentence_spans(text)] for _, text in rows]
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for (label, _), sentences in zip(rows, bags):
        seen[label].update({f for s in sentences for f in s})
    tell = {f: abs(np.log((seen[1][f] + .5) / (n[1] + 1)) - np.log((seen[0][f] + .5) / (n[0] + 1))) * np.sqrt(seen[0][f] + seen[1][f]) for f in seen[0] | seen[1] if seen[0][f] + seen[1][f] >= min_docs}
    chosen = sorted(tell, key=lambda f: (-tell[f], f))[:max_features]
    index = {f: i for i, f in enumerate(chosen)}
    feature, sentence, bag, at = [], [], [], 0
    for b, sentences in enumerate(bags):
        for s in sentences:
            ids = [index[f] for f in s if f in index]
            feature += ids
            sentence += [at] * len(ids)
            bag.append(b)
            at += 1
    del bags
    feature, sentence, bag = np.array(feature, dtype=np.int64), np.array(sentence, dtype=np.int64), np.array(bag, dtype=np.int64)
    y = np.array([label for label, _ in rows], dtype=float)
    total = counts[0] + counts[1]
    sure = np.where(y == 1, counts[1] / total / n[1], counts[0] / total / n[0])
    w, bias = np.zeros(len(chosen)), start
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(sentence, w[feature], minlength=at)
        s = np.maximum(np.bincount(bag, np.logaddexp(0, z), minlength=len(y)), 1e-9)
        by_s = sure * np.where(y == 1, -1 / np.expm1(np.minimum(s, 50)), 1.0)
        by_z = by_s[bag] / (1 + np.exp(-z))
        grad = np.append(np.bincount(feature, by_z[sentence], minlength=len(w)) + l2 * w, by_z.sum())
        m, v = .9 * m + .1 * grad, .99 * v + .01 * grad * grad
        move = .15 * (m / (1 - .9**step)) / (np.sqrt(v / (1 - .99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return MilModel(float(bias), {f: float(x) for f, x in zip(chosen, w) if abs(x) > 1e-3})


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 1500, max_doc_bytes: int = 32_768) -> MilModel | None:
    """Learns from at most rows_per_class labelled rows of either class outside fold 1 of 3."""
    rows, counts = labelled_sample(docs, labels, "toxic", crc_fold("doc_id", 3) != 1, rows_per_class, max_doc_bytes)
    return train([(y, text) for _, y, text in rows], counts)


def score(docs: DataFrame, model: MilModel | None, threshold: float = 0.7, sentence_threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, and the sentences scored sentence_threshold or more as
    (start, end, score) with character offsets; one pass, no shuffle."""
    cache = _WordWeights(model.weights if model else {})
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.Table:
        scores, found = [], []
        for text in batch.column(1).to_pylist():
            hits: list[dict] = []
            total = 0.0
            if text and model:
                z = sentence_scores(text, model, cache)
                total = _log_or(z)
                loud = np.flatnonzero(z >= np.log(sentence_threshold / (1 - sentence_threshold)))
                if len(loud):
                    spans = sentence_spans(text)
                    hits = [{"start": spans[i][0], "end": spans[i][1], "score": float(1 / (1 + np.exp(-z[i])))} for i in loud]
            scores.append(-np.expm1(-total))
            found.append(hits)
        p = np.array(scores)
        return pa.table({"doc_id": batch.column(0), "score": p, "predicted": (p >= threshold).astype(np.int32), "sentences": pa.array(found, pa.list_(span))})

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, predicted int, sentences array<struct<start:int,end:int,score:double>>")


def kept(docs: DataFrame, model: MilModel | None, threshold: float = 0.7) -> DataFrame:
    """docs without the documents that score threshold or more; all columns, one pass, no
    shuffle: the rows are filtered where they are scored."""
    cache = _WordWeights(model.weights if model else {})
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        least = -np.log1p(-threshold)
        stay = [not (t and model and _log_or(sentence_scores(t, model, cache)) >= least) for t in batch.column(at).to_pylist()]
        return batch.filter(pa.array(stay, pa.bool_()))

    return map_batches(docs, run, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, **sample) -> DataFrame:
    """doc_id, held_out (fold 1 of 3, unused in fitting), score, predicted, sentences."""
    out = score(docs, fit(docs, labels, **sample))
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "sentences")
