"""Word-id suffix arrays of a block of texts: which runs of words recur in it, and where.

A block is a sequence of word ids; ``room`` says for each place how many words a run that starts there may have (up to
the end of its document or piece). Memory is a few numbers a word, so callers cut long texts into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_WORDS = 1 << 20


def suffix_array(ids: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first ``depth`` words (fewer where there is less room), by prefix doubling; ties in any order."""
    key, length = ids, 1
    while True:
        order = np.argsort(key)
        if length >= depth:
            return order
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[order[1:]] != key[order[:-1]])))
        step = min(length, depth - length)
        key = rank * (len(ids) + 1)
        far = np.flatnonzero(room > step)
        key[far] += rank[far + step] + 1
        length += step


def common_words(ids: np.ndarray, room: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each neighbour pair of the suffix array, how many first words are the same, ``depth`` at most."""
    a, b = order[:-1], order[1:]
    space = np.minimum(room[a], room[b])
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for j in range(depth):
        alive = alive[space[alive] > j]
        alive = alive[ids[a[alive] + j] == ids[b[alive] + j]]
        out[alive] += 1
    return out


def ngram_runs(ids: np.ndarray, room: np.ndarray, sizes: range, owned: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, places, run of each place, first place of each run): the occurrences of every n-gram, those of one n-gram in one run.

    An n-gram is an interval of the suffix array in which neighbours share n words or more. Only places before
    ``owned`` are given: the words after them are there so that runs can reach beyond the block.
    """
    if not len(ids):
        return
    depth = sizes[-1]
    room = np.minimum(room, np.minimum(depth, len(ids) - np.arange(len(ids))))
    order = suffix_array(ids, room, depth)
    shared = common_words(ids, room, order, depth)
    mine = order < (len(ids) if owned is None else owned)
    for n in sizes:
        interval = np.concatenate(([0], np.cumsum(shared < n)))
        fits = np.flatnonzero((room[order] >= n) & mine)
        if not len(fits):
            continue
        new = np.ones(len(fits), bool)
        new[1:] = interval[fits[1:]] != interval[fits[:-1]]
        places = order[fits]
        yield n, places, np.cumsum(new) - 1, places[new]


def room_in_groups(same_as_next: np.ndarray) -> np.ndarray:
    """For each place, how many places from it on belong together, given whether each belongs with the next."""
    n = len(same_as_next) + 1
    ends = np.append(np.flatnonzero(~same_as_next), n - 1)
    at = np.arange(n)
    return ends[np.searchsorted(ends, at)] - at + 1


def blocks(n: int, reach: int, size: int = BLOCK_WORDS) -> Iterator[tuple[int, int, int]]:
    """(start, end of the own places, end with ``reach`` more) of blocks that cover n places once."""
    for a in range(0, n, size):
        b = min(n, a + size)
        yield a, b, min(n, b + reach)
