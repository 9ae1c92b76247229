"""Harmonic packing of token ids into sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of over capacity/(k + 1) and up to
capacity/k ids, and a bin of class k takes exactly k pieces. Each worker fills its bins for itself, in one
pass, with no shuffle and memory for one open bin a class. A text longer than the capacity gives whole
sequences first; its rest is cut at the largest reciprocals of the capacity until what a last piece leaves of its
share of a bin is under ``SLACK`` of the rest, so that bins come out nearly full with few cuts. What stays in open bins at a worker's end is laid end to end and cut at the capacity, and the last
remainder into powers of two, so that padding is only what the reciprocals leave.

Defined results: a null text is empty and gives one piece with the end id; repeated rows and null ids are
documents of their own; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quizforge.llm.common import text_chunks
from quizforge.llm.pieces import cut_byte_level, encoder

END_ID = 0
MAX_CUTS, SLACK = 4, 1 / 64
#: Sequence ids of a worker start at its number times this.
PER_WORKER = 1 << 40


def tail_cuts(rest: int, capacity: int) -> list[int]:
    """Piece lengths for the ``rest`` of a text under one capacity: largest reciprocals first."""
    out, spare = [], SLACK * rest
    while rest and len(out) < MAX_CUTS - 1 and capacity / (capacity // rest) - rest > spare:
        piece = capacity // -(-capacity // rest)
        out.append(piece)
        rest -= piece
    return out + [rest] if rest else out


class Worker:
    """The open bins of one worker; finished pieces collect in ``rows``."""

    def __init__(self, capacity: int, first_sequence: int) -> None:
        self.capacity, self.next_sequence = capacity, first_sequence
        self.bins: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, doc_tokens in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, self.next_sequence, at))
            at += len(ids)
        self.next_sequence += 1

    def add(self, doc: object, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self._close([(doc, at, ids[at : at + self.capacity], n)])
            at += self.capacity
        for size in tail_cuts(n - at, self.capacity):
            k = self.capacity // size
            bin_ = self.bins.setdefault(k, [])
            bin_.append((doc, at, ids[at : at + size].copy(), n))
            at += size
            if len(bin_) == k:
                self._close(self.bins.pop(k))

    def finish(self) -> None:
        left = [p for k in sorted(self.bins) for p in self.bins[k]]
        self.bins = {}
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if total % self.capacity >> b & 1]
        own: list[tuple] = []
        room = sizes.pop(0) if sizes else 0
        for doc, start, ids, n in left:
            while len(ids):
                part = ids[:room]
                own.append((doc, start, part, n))
                start, ids, room = start + len(part), ids[len(part) :], room - len(part)
                if not room:
                    self._close(own)
                    own, room = [], sizes.pop(0) if sizes else 0


def pack(docs: DataFrame, tokenizer: str, *, text: str = "text", capacity: int = 1024) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece."""
    field = docs.schema["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, cut_byte_level)
        worker = Worker(capacity, TaskContext.get().partitionId() * PER_WORKER)
        kind = None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*worker.rows, strict=True)) or [()] * len(names)
            worker.rows = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in batches:
            kind = batch.column(0).type
            for i, j, data, offsets in text_chunks(batch.column(1)):
                raw = data.tobytes()
                ids = own.encode([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                for doc, body in zip(batch.column(0)[i:j].to_pylist(), ids, strict=True):
                    worker.add(doc, np.append(body, np.int32(END_ID)))
                yield rows()
        if kind is not None:
            worker.finish()
            yield rows()

    schema = f"doc_id {field.dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", `offset` long"
    return docs.select("doc_id", text).mapInArrow(run, schema)
