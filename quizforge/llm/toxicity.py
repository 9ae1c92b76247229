"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A feature is the hash of a word, of two words in a row, of two words with one between, or of a word's first 3 to 8
characters (inflected forms share these), present or not in the whole text (two features with one hash are one).
Per-coordinate learning rates and L1 give few weights that are not zero; those are broadcast. They are learned on a
sample of at most ``sample_rows`` labelled documents, from the features that at least ``least_docs`` of them have; a
toxic document counts ``toxic_weight`` times. The sample lies in the shared folder, and the driver reads it twice, a
partition at a time: it holds the frequent features only.

Defined results: a null or wordless text has no feature and gets the bias alone; without labelled rows every
score is 0; repeated rows and null ids are scored each for itself; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizforge.llm.common import LOWER, mixed, runs, span_hashes, stored, text_chunks
from quizforge.llm.sampling import labelled_sample, remainder

SLOTS_LOG2 = 20
#: Lengths of word beginnings, in characters.
STEMS = (3, 4, 5, 6, 7, 8)
_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of the features present, sorted, each once; ``stems`` are lengths of word beginnings."""
    lower = LOWER[data]
    starts, ends, doc = runs(_WORD[lower], offsets)
    word = span_hashes(lower, starts, ends)
    found, owner = [word], [doc]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(doc) > gap:
            same = doc[gap:] == doc[:-gap]
            found.append(mixed(word[:-gap] * np.uint64(3) + word[gap:] + np.uint64(salt))[same])
            owner.append(doc[gap:][same])
    if stems:
        characters = np.flatnonzero((lower & 0xC0) != 0x80)
        first, bounds = np.searchsorted(characters, starts), np.append(characters, len(lower))
        for k in stems:
            cut = bounds[np.minimum(first + k, len(characters))]
            long = cut <= ends
            found.append(mixed(span_hashes(lower, starts[long], cut[long]) + np.uint64(0x7F4A7C15)))
            owner.append(doc[long])
    key = (np.concatenate(owner).astype(np.int64) << SLOTS_LOG2) | (np.concatenate(found) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
    key = np.sort(key)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key >> SLOTS_LOG2, key & ((1 << SLOTS_LOG2) - 1)


class FtrlProximal:
    """Logistic regression by FTRL-proximal; the last coordinate is the bias, which L1 spares."""

    def __init__(self, slots: int, alpha: float = 3.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, np.full(slots + 1, l1, np.float32), l2
        self.l1[slots] = 0
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)

    def _weights(self, z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
        return (np.clip(z, -l1, l1) - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n, self.l1)

    def learn(self, slots: np.ndarray, y: float, weight: float = 1.0) -> None:
        z, n = self.z[slots], self.n[slots]
        w = self._weights(z, n, self.l1[slots])
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = weight * (p - y)
        grown = n + g * g
        self.z[slots] = z + g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = grown


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(1)):
            doc, slot = features(data, offsets, STEMS)
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            rows = [slot[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(rows, pa.binary())], ["y", "slots"])


def fit(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", sample_rows: int = 12_000, folds: int = 3, epochs: int = 10, toxic_weight: float = 2.0, least_docs: int = 3,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots with a weight, their weights, and the bias; ids whose crc32 modulo ``folds`` is 1 are not learned from."""
    sample = labelled_sample(docs, labels, "toxic", remainder(F.col("doc_id"), folds) != 1, text=text, rows=sample_rows)
    sample = stored(sample.mapInArrow(_sampled, "y double, slots binary"), "toxicity_sample")
    bias = 1 << SLOTS_LOG2
    n_docs = np.zeros(bias + 1, np.int64)
    for r in sample.toLocalIterator():
        n_docs[np.frombuffer(r.slots, np.int32)] += 1
    n_docs[bias] = least_docs
    bags = []
    for r in sample.toLocalIterator():
        own = np.append(np.frombuffer(r.slots, np.int32), np.int32(bias))
        bags.append((own[n_docs[own] >= least_docs], r.y))
    if not bags:
        return np.zeros(0, np.int64), np.zeros(0), -np.inf
    # The order of rows depends on the cluster; the fit must not.
    bags.sort(key=lambda bag: (bag[0].tobytes(), bag[1]), reverse=True)
    # Only frequent features are numbered: the model's state stays small, and so fast.
    frequent = np.flatnonzero(n_docs >= least_docs)
    place = np.zeros(bias + 1, np.int32)
    place[frequent] = np.arange(len(frequent))
    bags = [(place[own], y) for own, y in bags]
    model = FtrlProximal(len(frequent) - 1)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            slots, y = bags[i]
            model.learn(slots, y, toxic_weight if y > 0 else 1.0)
    w = model.weights()
    used = np.flatnonzero(w[:-1])
    return frequent[used], w[used], float(w[-1])


def score(docs: DataFrame, labels: DataFrame, *, text: str = "text", threshold: float = 0.7, folds: int = 3, **options: int) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text=text, folds=folds, **options))  # at most 2**20 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, own, bias = sent.value
        weights = np.zeros(1 << SLOTS_LOG2)
        weights[slots] = own
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                doc, slot = features(data, offsets, STEMS)
                total = np.bincount(doc, weights[slot], j - i) + bias
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.where(total == -np.inf, 0.0, 1 / (1 + np.exp(-np.clip(total, -30, 30)))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), folds) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
