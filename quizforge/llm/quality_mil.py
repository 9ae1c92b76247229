"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 120 words. Every passage is encoded from what its characters and words look
like; gated attention weighs the passages, and the weighted passage representation is scored. The weights are
learned from document labels alone, on a sample of at most ``sample_rows`` labelled documents, of which every passage
is learned from; scoring looks at every passage of every text.

Defined results: a null or wordless text is one passage of zeros and gets a score as any other; without
labelled rows every score is 0.5; repeated rows and null ids are scored each for itself; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizforge.llm.common import LOWER, SEPARATOR, runs, span_hashes, text_chunks
from quizforge.llm.sampling import labelled_sample, remainder

PASSAGE_WORDS, WORD_SLOTS = 120, 128
HIDDEN, GATE = 24, 12
#: Shapes of bytes: lower, upper, digit, space, newline, punctuation, sign, beyond ASCII.
_SHAPE = np.full(256, 6, np.uint8)
for _value, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"?!-()")):
    _SHAPE[list(_chars)] = _value
_SHAPE[128:] = 7
FEATURES = 64 + WORD_SLOTS + 5


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (float32), and the first passage of each document."""
    n = len(offsets) - 1
    starts, ends, doc = runs(~SEPARATOR[data], offsets)
    words = np.bincount(doc, minlength=n)
    first_word = np.cumsum(words) - words
    each = np.maximum(1, -(-words // PASSAGE_WORDS))
    first = np.cumsum(each) - each
    own = first[doc] + (np.arange(len(doc)) - first_word[doc]) // PASSAGE_WORDS
    total = int(each.sum())
    out = np.zeros((total, FEATURES), np.float32)
    if not len(doc):
        return out, first
    # A byte belongs to the passage of the last word that starts at or before it.
    byte_doc = np.repeat(np.arange(n), np.diff(offsets))
    last = np.searchsorted(starts, np.arange(len(data)), "right") - 1
    of_byte = np.where((last >= 0) & (doc[last] == byte_doc), own[last], first[byte_doc])
    shape = _SHAPE[data].astype(np.int64)
    pair = of_byte[:-1] * 64 + shape[:-1] * 8 + shape[1:]
    pair = pair[byte_doc[:-1] == byte_doc[1:]]
    counts = np.bincount(pair, minlength=total * 64).reshape(total, 64)
    out[:, :64] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    hashes = span_hashes(LOWER[data], starts, ends)
    size = np.maximum(np.bincount(own, minlength=total), 1)
    slots = np.bincount(own * WORD_SLOTS + (hashes % np.uint64(WORD_SLOTS)).astype(np.int64), minlength=total * WORD_SLOTS)
    out[:, 64 : 64 + WORD_SLOTS] = np.sqrt(slots.reshape(total, WORD_SLOTS) / size[:, None])
    order = np.lexsort((hashes, own))
    new = np.ones(len(order), bool)
    new[1:] = (own[order[1:]] != own[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]])
    again = np.zeros(len(own), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    of = lambda weight: np.bincount(own, weight, total) / size
    out[:, 64 + WORD_SLOTS :] = np.stack(
        [np.bincount(own[order[new]], minlength=total) / size, of(again), of(ends - starts) / 10, np.log1p(np.bincount(own, minlength=total)) / 5, np.log1p(each[np.searchsorted(first, np.arange(total), "right") - 1]) / 5],
        axis=1,
    )
    return out, first


class AttentionBag:
    """A gated-attention network over bags; plain numpy, trained by Adam."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"e": draw(FEATURES, HIDDEN), "eb": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "a": draw(GATE, 1), "o": draw(HIDDEN, 1), "ob": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        h = np.tanh(x @ w["e"] + w["eb"])
        tv, su = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        logit = ((tv * su) @ w["a"])[:, 0]
        power = np.exp(logit - np.maximum.reduceat(logit, first)[bag])
        share = power / np.add.reduceat(power, first)[bag]
        z = np.add.reduceat(share[:, None] * h, first, axis=0)
        p = 1 / (1 + np.exp(-np.clip((z @ w["o"])[:, 0] + w["ob"][0], -30, 30)))
        return {"bag": bag, "h": h, "tv": tv, "su": su, "share": share, "z": z, "p": p}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale, first)["p"].astype(np.float64)

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.005, decay: float = 1e-4, seed: int = 3) -> None:
        n = sum(map(len, bags))
        self.mean = (sum(b.sum(0, np.float64) for b in bags) / n).astype(np.float32)
        self.scale = np.sqrt(sum(((b - self.mean) ** 2).sum(0, np.float64) for b in bags) / n).astype(np.float32) + np.float32(1e-2)
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                x = (np.concatenate([bags[i] for i in chosen]) - self.mean) / self.scale
                size = np.array([len(bags[i]) for i in chosen])
                grads = self._gradients(x, np.cumsum(size) - size, y[chosen])
                step += 1
                for k, g in grads.items():
                    g = g + decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        f, w = self._forward(x, first), self.w
        bag, h, share = f["bag"], f["h"], f["share"]
        d_logit = ((f["p"] - y) / len(y)).astype(np.float32)[:, None]
        d_z = d_logit @ w["o"].T
        d_share = (d_z[bag] * h).sum(1)
        d_score = share * (d_share - np.add.reduceat(share * d_share, first)[bag])
        gate = f["tv"] * f["su"]
        d_gate = d_score[:, None] @ w["a"].T
        d_tv, d_su = d_gate * f["su"] * (1 - f["tv"] ** 2), d_gate * f["tv"] * f["su"] * (1 - f["su"])
        d_h = (share[:, None] * d_z[bag] + d_tv @ w["v"].T + d_su @ w["u"].T) * (1 - h**2)
        return {"e": x.T @ d_h, "eb": d_h.sum(0), "v": h.T @ d_tv, "u": h.T @ d_su, "a": gate.T @ d_score[:, None], "o": f["z"].T @ d_logit, "ob": d_logit.sum(0)}


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(1)):
            x, first = passages(data, offsets)
            bags = [x[a:b].tobytes() for a, b in zip(first, [*first[1:], len(x)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(bags, pa.binary())], ["y", "bag"])


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", sample_rows: int = 4000, folds: int = 5) -> AttentionBag | None:
    """The network, learned from ids whose crc32 modulo ``folds`` is not 0; None without labelled rows."""
    sample = labelled_sample(docs, labels, "quality", remainder(F.col("doc_id"), folds) != 0, text=text, rows=sample_rows)
    rows = sample.mapInArrow(_bags, "y double, bag binary").collect()
    if not rows:
        return None
    # The order of rows depends on the cluster; the fit must not.
    rows.sort(key=lambda r: (r.bag, r.y))
    model = AttentionBag()
    model.fit([np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in rows], np.array([r.y for r in rows], np.float32))
    return model


def score(docs: DataFrame, labels: DataFrame, *, text: str = "text", threshold: float = 0.3, folds: int = 5, **options: int) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text=text, folds=folds, **options))  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                p = model.score(*passages(data, offsets)) if model else np.full(j - i, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(p)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, *, text: str = "text", threshold: float = 0.3, **options: int) -> DataFrame:
    """``docs`` without the documents that score under ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text=text, **options))
    columns = docs.columns
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(at)):
                p = model.score(*passages(data, offsets)) if model else np.full(j - i, 0.5)
                yield batch.slice(i, j - i).filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
