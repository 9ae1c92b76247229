"""Large JSON arrays as many tasks: a file is cut into byte ranges, and each range yields the elements that begin in it.

Where a range begins inside a string or how deep it is nested isn't known from its own bytes. So the ranges are looked at
twice, both times by all tasks at once: first each says what it would do to either state (outside or inside a string),
which is a few numbers; those are put together in order, one row a range; then each range is read again with its
true state, and the element that runs over its end is read to its own end. A file that is no longer than a range begins in a
known state, so it is read once.

Files are opened by ``pyarrow.fs`` (local, HDFS, S3, GCS) inside the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizforge.sources.files import dealt, filesystem, list_files

RANGE_BYTES = 16 << 20
_PIECE = 1 << 20
_QUOTE, _BACKSLASH, _COMMA = ord('"'), ord("\\"), ord(",")
_DEPTH = np.zeros(256, np.int8)
_DEPTH[[ord("["), ord("{")]] = 1
_DEPTH[[ord("]"), ord("}")]] = -1
_MARK = _DEPTH != 0
_MARK[_COMMA] = True


def _open(path: str):
    own, at = filesystem(path)
    return own.open_input_file(at)


def _quotes(data: np.ndarray, escaped_first: bool) -> np.ndarray:
    """Places of quotes that no backslash escapes."""
    at = np.flatnonzero(data == _QUOTE)
    if not len(at):
        return at
    slash = data == _BACKSLASH
    # For each quote, the backslashes right before it: the distance to the last byte that is none.
    others = np.flatnonzero(~slash)
    before = np.searchsorted(others, at) - 1
    run = np.where(before >= 0, at - others[np.maximum(before, 0)] - 1, at)
    run += (before < 0) & escaped_first  # an escape that began before the data
    return at[run % 2 == 0]


def _marks(data: np.ndarray, escaped_first: bool, in_string: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of brackets and commas outside strings, the depth after each (0 at the start), and whether a string is open at the end."""
    quotes = _quotes(data, escaped_first)
    at = np.flatnonzero(_MARK[data])
    outside = (np.searchsorted(quotes, at) % 2 == 0) != in_string
    at = at[outside]
    return at, np.cumsum(_DEPTH[data[at]].astype(np.int64)), in_string != bool(len(quotes) % 2)


def _escapes_into(file, start: int, least: int) -> bool:
    """Whether the byte at ``start`` is escaped: an odd number of backslashes stands before it, as far back as ``least``."""
    n, at = 0, start
    while at > least:
        piece = file.read_at(min(256, at - least), max(least, at - 256))
        own = len(piece) - len(piece.rstrip(b"\\"))
        n += own
        if own < len(piece):
            break
        at -= len(piece)
    return n % 2 == 1


def _array_begin(file, size: int, key: str) -> int:
    """Where the file's array begins: its first byte that isn't white space, or after ``"key":`` in an object; -1 if neither."""
    found, at, head = re.compile(rb'"' + re.escape(key.encode()) + rb'"\s*:\s*\['), 0, b""
    while at < size:
        piece = file.read_at(_PIECE, at)
        at += len(piece)
        head += piece
        plain = head.removeprefix(b"\xef\xbb\xbf").lstrip()
        if not plain:
            head = b""
            continue
        begun = at - len(plain)
        if plain[:1] == b"[":
            return begun
        if plain[:1] != b"{":
            return -1
        # The key counts at the object's own depth and outside strings only.
        data = np.frombuffer(plain, np.uint8)
        quotes = _quotes(data, False)
        places, depth, _ = _marks(data, False, False)
        for m in found.finditer(plain):
            before = np.searchsorted(places, m.start()) - 1
            if np.searchsorted(quotes, m.start()) % 2 == 0 and depth[before] == 1:
                return begun + m.end() - 1
        head = plain
    return -1


def _begins(key: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            begins = []
            for path, size in zip(part["file"], part["size"], strict=True):
                with _open(path) as f:
                    begins.append(_array_begin(f, size, key))
            yield part.assign(begin=begins)

    return run


def _summaries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For both states at a range's start: the state at its end, its change of depth, and its commas by depth."""
    for part in parts:
        rows = []
        for r in part.itertuples():
            with _open(r.file) as f:
                data = np.frombuffer(f.read_at(r.end - r.start, r.start), np.uint8)
                escaped = _escapes_into(f, r.start, r.begin)
            for in_string in (False, True):
                at, depth, open_end = _marks(data, escaped, in_string)
                low = int(depth.min()) if len(depth) else 0
                commas = np.bincount(depth[data[at] == _COMMA] - low)
                rows.append((r.file, r.begin, r.start, r.end, escaped, in_string, open_end, int(depth[-1]) if len(depth) else 0, low, commas.tolist()))
        yield pd.DataFrame(rows, columns=["file", "begin", "start", "end", "escaped", "in_string", "open_end", "change", "low", "commas"])


_ELEMENT = "file string, pos long, element string"
_RANGE = "file string, begin long, start long, end long, escaped boolean"
_SUMMARY = f"{_RANGE}, in_string boolean, open_end boolean, change long, low long, commas array<long>"


def _put_together(part: pd.DataFrame) -> pd.DataFrame:
    """The true state at each range's start, one row a range; a file whose array never ends has none."""
    both = {(r.start, r.in_string): r for r in part.itertuples()}
    rows, in_string, depth, before, ended = [], False, 0, 0, False
    for start in sorted(set(part["start"])):
        r = both[start, in_string]
        rows.append((r.file, r.begin, start, r.end, r.escaped, in_string, depth, before))
        at = 1 - depth - r.low  # where the commas of the array's own depth are counted
        before += r.commas[at] if 0 <= at < len(r.commas) else 0
        if depth + r.low <= 0:  # the array ends here; an object that holds it goes on
            ended = True
            break
        depth, in_string = depth + r.change, r.open_end
    out = pd.DataFrame(rows, columns=["file", "begin", "start", "end", "escaped", "in_string", "depth", "before"])
    return out if ended else out[:0]


def _elements(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for r in part.itertuples():
            with _open(r.file) as f:
                found = _range_elements(f, r)
            for i in range(0, len(found), 10_000):
                yield pd.DataFrame({"file": r.file, "pos": [p for p, _ in found[i : i + 10_000]], "element": [e for _, e in found[i : i + 10_000]]})


#: Elements of small files are handed on together, once they are so many or so long.
_ELEMENTS, _CHARACTERS = 10_000, 4 << 20
#: Small files of one task, where there are few tasks.
_TASK_FILES = 32


def _small(key: str):
    """The elements of files of one range each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, long = [], 0
        for part in parts:
            for path in part["file"]:
                with _open(path) as f:
                    whole = pa.BufferReader(f.read())
                begin = _array_begin(whole, whole.size(), key)
                if begin < 0:
                    continue
                r = SimpleNamespace(begin=begin, start=begin, end=whole.size(), escaped=False, in_string=False, depth=0, before=0)
                found = _range_elements(whole, r, True)
                rows += [(path, i, x) for i, x in found]
                long += sum(len(x) for _, x in found)
                if len(rows) >= _ELEMENTS or long >= _CHARACTERS:
                    yield pd.DataFrame(rows, columns=["file", "pos", "element"])
                    rows, long = [], 0
        yield pd.DataFrame(rows, columns=["file", "pos", "element"])

    return run


def _range_elements(file, r, whole: bool = False) -> list[tuple[int, str]]:
    """(place in the array, text) of the elements whose delimiter, ``[`` or ``,``, is in the range; none if the ``whole`` array is there and doesn't end."""
    raw = file.read_at(r.end - r.start, r.start)
    data = np.frombuffer(raw, np.uint8)
    at, depth, in_string = _marks(data, r.escaped, r.in_string)
    depth = depth + r.depth
    kind = data[at]
    begin = (depth == 1) & ((kind == _COMMA) | ((at + r.start == r.begin)))
    stop = ((depth == 1) & (kind == _COMMA)) | ((depth == 0) & (_DEPTH[kind] == -1))
    over = np.flatnonzero((depth == 0) & (_DEPTH[kind] == -1))  # the array ends here; what follows isn't its own
    if len(over):
        begin[over[0] :], stop[over[0] + 1 :] = False, False
    elif whole:
        return []
    starts, stops = at[begin] + 1, at[stop]
    where = np.searchsorted(stops, starts)
    texts = [raw[a : stops[i]] if i < len(stops) else raw[a:] for a, i in zip(starts.tolist(), where.tolist(), strict=True)]
    if len(starts) and where[-1] == len(stops):
        texts[-1] += _rest(file, r.end, r.begin, in_string, int(depth[-1]) if len(depth) else r.depth)
    first = int(r.before) + (0 if r.start <= r.begin < r.end else 1)
    out = [(first + i, t.decode("utf-8", "replace").strip()) for i, t in enumerate(texts)]
    return [x for x in out if x[1]]


def _rest(file, at: int, least: int, in_string: bool, depth: int) -> bytes:
    """What follows at ``at`` up to the end of the element that is open there."""
    out = []
    while piece := file.read_at(_PIECE, at):
        data = np.frombuffer(piece, np.uint8)
        places, own, in_string = _marks(data, _escapes_into(file, at, least), in_string)
        own = own + depth
        stop = np.flatnonzero(((own == 1) & (data[places] == _COMMA)) | (own == 0))
        if len(stop):
            return b"".join([*out, piece[: places[stop[0]]]])
        out.append(piece)
        depth = int(own[-1]) if len(own) else depth
        at += len(piece)
    return b"".join(out)


def array_elements(spark: SparkSession, root: str, name: str = r"\.json$", key: str = "results", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, pos, element): the elements of the JSON arrays under ``root``, as text, with their places from 0.

    A file is an array, or an object with one under ``key``; other files, and arrays that don't end, have no rows. A task
    holds one range and the element that runs over its end. ``file`` is the path as it is, not encoded.
    """
    files = list_files(spark, root).where(F.col("file").rlike(name))
    is_large = F.col("size") > range_bytes
    n_small, n_large, n_ranges = files.agg(F.count_if(~is_large), F.count_if(is_large), F.sum(F.when(is_large, F.ceil(F.col("size") / range_bytes)))).first()
    small = dealt(files.where(~is_large), n_small // _TASK_FILES + 1, "file").mapInPandas(_small(key), _ELEMENT)
    if not n_large:
        return small
    known = dealt(files.where(is_large), n_large, "file").mapInPandas(_begins(key), "file string, size long, begin long").where("begin >= 0")
    ranges = known.select("file", "begin", "size", F.explode(F.sequence("begin", F.col("size") - 1, F.lit(range_bytes))).alias("start"))
    ranges = ranges.select("file", "begin", "start", F.least(F.col("start") + range_bytes, "size").alias("end"))
    told = dealt(dealt(ranges, n_ranges, "file", "start").mapInPandas(_summaries, _SUMMARY), n_large, "file", "begin")
    told = told.groupBy("file", "begin").applyInPandas(_put_together, f"{_RANGE}, in_string boolean, depth long, before long")
    return small.unionByName(dealt(told, n_ranges, "file", "start").mapInPandas(_elements, _ELEMENT))
