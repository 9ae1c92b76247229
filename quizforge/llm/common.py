"""What the operators share: tables in the shared folder, and texts as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of bytes that are none of these: space and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes with A-Z as a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of its own only in local mode, where all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quizforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there: a lost executor costs a reread only."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of about ``limit`` bytes each, without copies; null is empty.

    A row is never split, so one very long text makes one larger chunk.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the maximal runs of true values that cross no document's end."""
    if not inside.size:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(inside.size + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for at least ``n`` places."""
    if not _powers or _powers[0].size < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, equal for equal contents; no proof that contents are equal."""
    up, down = _powers_to(values.size + 1)
    total = np.zeros(values.size + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: values.size], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans_equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes at a are those at b, for each triple."""
    out = np.ones(len(a), bool)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    for done in range(0, 64, 8):
        left = np.flatnonzero(out & (n > done))
        if not left.size:
            return out
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(n[left] - done, 8)).astype(np.uint64))
        x, y = (np.ascontiguousarray(words[at[left] + done]).view("<u8").ravel() for at in (a, b))
        out[left] = (x ^ y) & keep == 0
    for i in np.flatnonzero(out & (n > 64)).tolist():
        out[i] = np.array_equal(data[a[i] + 64 : a[i] + n[i]], data[b[i] + 64 : b[i] + n[i]])
    return out


def span_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, the same for the same bytes and for no others; and a span of each number."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = span_hashes(data, starts, ends)
    order = np.argsort(hashes, kind="stable")
    n, h = (ends - starts)[order], hashes[order]
    like = np.flatnonzero((h[1:] == h[:-1]) & (n[1:] == n[:-1]))
    new = np.ones(len(order), bool)
    new[like[spans_equal(data, starts[order[like]], starts[order[like + 1]], n[like])] + 1] = False
    clash = np.flatnonzero(new[1:] & (h[1:] == h[:-1]))
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new) - 1
    if clash.size:
        # Different spans under one hash: the runs of equal spans are joined by their bytes.
        seen: dict[bytes, int] = {}
        for i in order[np.isin(h, h[clash])].tolist():
            ids[i] = seen.setdefault(data[starts[i] : ends[i]].tobytes(), int(ids[i]))
        ids = np.unique(ids, return_inverse=True)[1]
    some = np.empty(int(ids.max()) + 1, np.int64)
    some[ids] = np.arange(len(ids))
    return ids, some
