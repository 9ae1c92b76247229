"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item of m bytes that occurs in a text with at most k edits shares m + 1 - q(k + 1) or more q-grams
with it, and their diagonals (place in the text less place in the item) span at most k + 1 values. Shared
q-grams are counted in overlapping bands of 2(k + 1) diagonals, stepped by k + 1, so one band holds them all;
bands under the bound go, and the rest are verified by banded alignment. Nothing is lost by the filter: k is a tenth
of the item's length, and q is 8, or 4 for items under 40 bytes, for which 8 leaves no bound.

A benchmark whose items share a phrase makes every use of it a candidate for all of them. So postings are counted a
bounded number at a time, overlapping bands become one region, and the regions of items of like length are aligned
together: numpy steps through thousands of regions at once, with 64 cells of a column in each word.

The texts are read once. The benchmark is dealt into blocks of bounded bytes; each block is one broadcast, and a task
holds one block's index and a bounded number of texts at a time, so a benchmark of any size works. Texts and items are
compared with A-Z lower-cased and white space (space, 0x09 to 0x0D) turned into one space.

Defined results: null and empty texts and items have no match; an item under 8 bytes is found unchanged and
between edges of words only (it is in too many longer words); repeated rows and items match each for itself; an item
with a null id has item_id -1; other columns are not looked at. ``without_leaks`` judges each row by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizforge.llm.common import LOWER, SEPARATOR, text_chunks

Q, SHORT_Q = 8, 4
#: Items under so many bytes are filtered by q-grams of SHORT_Q; the budget of any longer one leaves a bound for Q.
SHORT_ITEM = 40
#: Bytes of texts that a task holds while it goes through the blocks.
HELD_BYTES = 64_000_000
#: Postings that are counted at a time, and regions that are aligned at a time.
POSTINGS, REGIONS = 1 << 21, 1 << 14
_SLOTS = 20
_ONE = np.uint64(1)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with white-space runs as one space; offsets; the place of each byte before."""
    space = SEPARATOR[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    places = np.flatnonzero(keep)
    out = LOWER[data[places]]
    out[space[places]] = 0x20
    return out, np.searchsorted(places, offsets), places


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q-gram at each place as a 64-bit value; the last q - 1 places have none."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    kind = {8: np.uint64, 4: np.uint32}[q]
    return np.lib.stride_tricks.as_strided(data, (len(data) - q + 1, q), (1, 1)).copy().view(kind).ravel().astype(np.uint64, copy=False)


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)


class Items:
    """Benchmark items that are filtered by one q: q-gram postings, budgets and bounds."""

    def __init__(self, ids: list[int], texts: list[np.ndarray], error_rate: float, q: int) -> None:
        self.q, self.ids, self.texts = q, np.array(ids, np.int64), texts
        self.size = np.array([len(t) for t in texts], np.int64)
        # The largest budget that leaves the filter a bound; at an error rate of a tenth it takes nothing away.
        self.budget = np.minimum((error_rate * self.size).astype(np.int64), self.size // q - 1)
        self.bound = self.size + 1 - q * (self.budget + 1)
        codes = [grams(t, q) for t in texts]
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.item, self.place = item[order], place[order]
        self.codes, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _SLOTS, bool)
        self.seen[_slot(self.codes)] = True
        self.words = -(-self.size // 64)
        used = np.zeros(256, bool)
        for t in texts:
            used[t] = True
        #: Each byte's class: those that no item has are one class, which matches nothing.
        self.classes = int(used.sum()) + 1
        self.class_of = np.where(used, np.cumsum(used) - 1, self.classes - 1).astype(np.int64)
        self._tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._rare: tuple[np.ndarray, Items] | None = None

    def rare_parts(self) -> tuple[np.ndarray, Items]:
        """Of each item, where the 64 bytes begin whose q-grams are in the fewest places of the benchmark; and these as items."""
        if self._rare is None:
            begins = []
            for t in self.texts:
                code = grams(t, self.q)
                often = np.concatenate(([0], np.cumsum(self.count[np.searchsorted(self.codes, code)])))
                wide = min(64 - self.q + 1, len(code))
                begins.append(int(np.argmin(often[wide:] - often[: len(often) - wide])))
            parts = [t[b : b + 64] for b, t in zip(begins, self.texts, strict=True)]
            self._rare = np.array(begins, np.int64), Items(self.ids.tolist(), parts, 0.0, self.q)
        return self._rare

    def places_of(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """For items of so many 64-bit words: each item's row, and by row and class of byte a bit for each place in the item."""
        if words not in self._tables:
            own = np.flatnonzero(self.words == words)
            rows = np.zeros(len(self.texts), np.int64)
            rows[own] = np.arange(len(own))
            data, size = np.concatenate([self.texts[i] for i in own]), self.size[own]
            place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
            table = np.zeros(len(own) * self.classes * words, np.uint64)
            at = (np.repeat(np.arange(len(own)), size) * self.classes + self.class_of[data]) * words + place // 64
            np.add.at(table, at, _ONE << (place % 64).astype(np.uint64))
            self._tables[words] = rows, table.reshape(-1, words)
        return self._tables[words]


class Block:
    """A block of benchmark items: short and long ones, each with its own q, and tiny ones."""

    def __init__(self, ids: list[int], texts: list[str | None], error_rate: float) -> None:
        every: dict[int, tuple[list[int], list[np.ndarray]]] = {0: ([], []), SHORT_Q: ([], []), Q: ([], [])}
        for i, t in zip(ids, texts, strict=True):
            raw = np.frombuffer((t or "").encode().strip(), np.uint8)
            if len(raw):
                body = normalised(raw, np.array([0, len(raw)]))[0]
                own = every[0 if len(body) < Q else SHORT_Q if len(body) < SHORT_ITEM else Q]
                own[0].append(i)
                own[1].append(body)
        self.tiny = [(i, t.tobytes()) for i, t in zip(*every[0], strict=True)]
        self.filtered = [Items(*every[q], error_rate, q) for q in (SHORT_Q, Q) if every[q][0]]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs."""
    if not keys.size:
        return keys, keys
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.concatenate((at, [keys.size])))


def candidate_bands(items: Items, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, band) with as many shared q-grams as the item's bound."""
    none = np.zeros(0, np.int64)
    code = grams(body, items.q)
    at = np.flatnonzero(items.seen[_slot(code)])
    if not at.size or not items.codes.size:
        return none, none, none
    where = np.minimum(np.searchsorted(items.codes, code[at]), len(items.codes) - 1)
    true = items.codes[where] == code[at]
    at, where = at[true], where[true]
    doc = np.searchsorted(offsets, at, "right") - 1
    whole = at + items.q <= offsets[doc + 1]
    at, where, doc = at[whole], where[whole], doc[whole]
    n = items.count[where]
    longest = int(items.size.max())
    # Diagonals lie between the longest item's length under zero and the longest text's, and bands are no further out.
    low, span = -longest - 1, longest + int(np.diff(offsets).max()) + 4
    cuts = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()), POSTINGS)[1:])
    merged = []
    for part in np.split(np.arange(len(at)), cuts):
        step, place = _steps(items, at[part] - offsets[doc[part]], where[part], doc[part], n[part], low, span)
        merged.append(counted(step))
    keys, counts = merged[0] if len(merged) == 1 else _summed(merged)
    # A band starts at each step and is two steps wide: its count is that of its own step and of the next.
    starts = counted(np.concatenate((keys, keys - 1)))[0]

    def tally(k: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return np.where(keys[i] == k, counts[i], 0)

    bound = items.bound[starts // span % len(items.texts)]
    enough = tally(starts) + tally(starts + 1) >= bound
    starts, bound = starts[enough], bound[enough]
    if not starts.size:
        return none, none, none
    # The lemma's q-grams lie at different places of the item: a text that repeats one of them has it once.
    if len(merged) == 1:  # where there are more, the alignment tells
        hits = []
        for shift in (0, 1):
            to = np.minimum(np.searchsorted(starts, step - shift), len(starts) - 1)
            own = starts[to] == step - shift
            hits.append(to[own] * longest + place[own])
        places = np.bincount(counted(np.concatenate(hits))[0] // longest, minlength=len(starts))
        starts = starts[places >= bound]
    doc, item = np.divmod(starts // span, len(items.texts))
    return doc, item, starts % span + low


def _steps(items: Items, at: np.ndarray, where: np.ndarray, doc: np.ndarray, n: np.ndarray, low: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, item and band as one number, place in the item) of the postings of q-grams at places ``at`` of documents."""
    posting = np.repeat(items.first[where] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    item, place = items.item[posting], items.place[posting]
    band = (np.repeat(at, n) - place) // (items.budget[item] + 1)
    return (np.repeat(doc, n) * len(items.texts) + item) * span + band - low, place


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all parts, each key once."""
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], np.concatenate([c for _, c in parts])[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


def align(item: np.ndarray, region: np.ndarray, first: int, width: int) -> tuple[int, int]:
    """Fewest edits of ``item`` anywhere on diagonals first .. first + width - 1 of ``region``, and the end there."""
    far = len(item) + len(region) + 1
    cells = np.arange(width)
    row = np.where((first + cells >= 0) & (first + cells <= len(region)), 0, far)
    shift = max(0, -first)
    padded = np.concatenate((np.zeros(shift, np.uint8), region, np.zeros(max(0, len(item) + first + width - len(region)), np.uint8)))
    for i in range(1, len(item) + 1):
        end = i + first + cells
        inside = (end >= 1) & (end <= len(region))
        swap = row + np.where(inside, padded[end[0] - 1 + shift : end[0] - 1 + shift + width] != item[i - 1], far)
        skip = np.concatenate((row[1:], [far])) + 1
        best = np.minimum(swap, skip)
        best = np.where((end >= 0) & (end <= len(region)), best, far)
        row = np.minimum(best, np.minimum.accumulate(best - cells) + cells)
        row = np.where((end >= 0) & (end <= len(region)), row, far)
    j = int(np.argmin(row))
    return int(row[j]), len(item) + first + j


def align_together(items: Items, words: int, item: np.ndarray, classes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits of each item anywhere in its region begin .. end of the texts, and the first end of such a place in it.

    All regions advance a byte at a time. A column of the alignment is kept as its differences between neighbouring cells, up
    (``more``) and down (``less``), one bit a cell.
    """
    rows, table = items.places_of(words)
    order = np.argsort(begin - end, kind="stable")  # longest first: those that are still going on come first
    item, begin, length = item[order], begin[order], (end - begin)[order]
    base, size = rows[item] * items.classes, items.size[item]
    last = ((size - 1) % 64).astype(np.uint64)
    more = [np.full(len(item), ~np.uint64(0)) for _ in range(words)]
    less = [np.zeros(len(item), np.uint64) for _ in range(words)]
    score, best, where = size.copy(), size.copy(), np.zeros(len(item), np.int64)
    going = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")  # regions longer than t
    for t, n in enumerate(going.tolist()):
        at = base[:n] + classes[begin[:n] + t]
        up = down = np.zeros(n, np.uint64)
        for w in range(words):
            up_to, less_than = more[w][:n], less[w][:n]
            same = table[at, w]
            vertical = same | less_than
            same = same | down
            across = (((same & up_to) + up_to) ^ up_to) | same
            rise, fall = less_than | ~(across | up_to), up_to & across
            top = last[:n] if w == words - 1 else np.uint64(63)
            next_up, next_down = (rise >> top) & _ONE, (fall >> top) & _ONE
            rise, fall = (rise << _ONE) | up, (fall << _ONE) | down
            more[w][:n], less[w][:n] = fall | ~(vertical | rise), rise & vertical
            up, down = next_up, next_down
        score[:n] += up.astype(np.int64) - down.astype(np.int64)
        better = np.flatnonzero(score[:n] < best[:n])
        best[better], where[better] = score[better], t + 1
    out = np.empty((2, len(order)), np.int64)
    out[:, order] = best, where
    return out[0], out[1]


def regions_of(items: Items, doc: np.ndarray, item: np.ndarray, band: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, item, lowest diagonal, diagonals, begin, end) of the bands' regions, in the texts; those that overlap are one."""
    if not len(doc):
        return (doc,) * 6
    order = np.lexsort((band, item, doc))
    doc, item, band = doc[order], item[order], band[order]
    k = items.budget[item]
    # A region may be entered k diagonals before the band and left k after it.
    low, high = band * (k + 1) - k, band * (k + 1) + 2 * (k + 1) + k
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1] + items.size[item[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    doc, item, low, high = doc[first], item[first], low[first], high[last]
    begin = cut[doc] + np.maximum(low, 0)
    end = np.minimum(cut[doc + 1], cut[doc] + high + items.size[item])
    some = end > begin
    return doc[some], item[some], low[some], (high - low)[some], begin[some], end[some]


def _filtered(items: Items, body: np.ndarray, cut: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, edits, end in the normalised document): the best verified match of each pair, the first of equals."""
    doc, item, low, width, begin, end = regions_of(items, *candidate_bands(items, body, cut), cut)
    words = items.words[item]
    if len(doc) > REGIONS // 8:
        likely = _likely(items, body, cut, doc, item, low, width)
        doc, item, low, width, begin, end, words = (x[likely] for x in (doc, item, low, width, begin, end, words))
    edits, stop = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    classes = items.class_of[body] if len(doc) else body
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        if len(own) > 2 * w:  # fewer are aligned sooner one by one
            own = own[np.argsort(end[own] - begin[own], kind="stable")]
            for at in range(0, len(own), REGIONS):
                part = own[at : at + REGIONS]
                edits[part], stop[part] = align_together(items, w, item[part], classes, begin[part], end[part])
            continue
        for r in own.tolist():
            region = body[begin[r] : end[r]]
            found = region.tobytes().find(items.texts[item[r]].tobytes())
            edits[r], stop[r] = (0, found + items.size[item[r]]) if found >= 0 else align(items.texts[item[r]], region, min(0, int(low[r])), int(width[r]))
    good = np.flatnonzero(edits <= items.budget[item])
    ends = begin[good] - cut[doc[good]] + stop[good]
    order = np.lexsort((ends, edits[good], item[good], doc[good]))
    seen = None
    for r, e in zip(good[order].tolist(), ends[order].tolist(), strict=True):
        if (doc[r], item[r]) != seen:
            seen = doc[r], item[r]
            yield int(doc[r]), int(item[r]), int(edits[r]), e


def _likely(items: Items, body: np.ndarray, cut: np.ndarray, doc: np.ndarray, item: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Which regions may have their item: its rarest 64 bytes alone have no more edits there than the whole item may have.

    Items that share a phrase go by what they don't share. It says nothing where the budget is about half of 64.
    """
    likely = np.ones(len(doc), bool)
    asked = np.flatnonzero((items.words[item] > 1) & (items.budget[item] < 32))
    if not len(asked):
        return likely
    at, parts = items.rare_parts()
    classes = parts.class_of[body]
    begin = np.maximum(cut[doc] + low + at[item], cut[doc])[asked]
    end = np.minimum(cut[doc] + low + at[item] + width + 64, cut[doc + 1])[asked]
    order = np.argsort(end - begin, kind="stable")
    for k in range(0, len(asked), REGIONS):
        own = order[k : k + REGIONS]
        edits = align_together(parts, 1, item[asked[own]], classes, begin[own], np.maximum(end[own], begin[own]))[0]
        likely[asked[own]] = edits <= items.budget[item[asked[own]]]
    return likely


def _tiny(item: bytes, raw: bytes, word: np.ndarray, cut: np.ndarray) -> Iterator[tuple[int, int]]:
    """(document, end in it) of the first place of each document that has the item between edges of words."""
    at, last = raw.find(item), -1
    while at >= 0:
        d, end = int(np.searchsorted(cut, at, "right")) - 1, at + len(item)
        inner = (at > cut[d] and word[at - 1] and word[at]) or (end < cut[d + 1] and word[end - 1] and word[end])
        if d != last and end <= cut[d + 1] and not inner:
            yield d, end - int(cut[d])
            last = d
        at = raw.find(item, at + 1)


def matches(block: Block, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item id, edits, end byte), in this order: the best verified match of each pair."""
    body, cut, places = normalised(data, offsets)
    found = [(d, int(items.ids[i]), edits, end) for items in block.filtered for d, i, edits, end in _filtered(items, body, cut)]
    if block.tiny:
        raw, word = body.tobytes(), _IN_WORD[body]
        found += [(d, i, 0, end) for i, item in block.tiny for d, end in _tiny(item, raw, word, cut)]
    return sorted((d, i, edits, int(places[cut[d] + end - 1] - offsets[d] + 1) if end else 0) for d, i, edits, end in found)


_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)]] = True


def _held(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about ``HELD_BYTES`` of texts."""
    own, size = [], 0
    for batch in batches:
        own.append(batch)
        size += batch.column(at).nbytes
        if size >= HELD_BYTES:
            yield own
            own, size = [], 0
    if own:
        yield own


class _Blocks:
    """The blocks, as broadcasts; a task has the index of one at a time."""

    def __init__(self, sent: list, error_rate: float) -> None:
        self.sent, self.error_rate = sent, error_rate
        self.last: tuple[int, Block] | None = None

    def __iter__(self) -> Iterator[Block]:
        for n, block in enumerate(self.sent):
            if self.last is None or self.last[0] != n:
                self.last = n, Block(*block.value, self.error_rate)
            yield self.last[1]


def _blocks(benchmark: DataFrame, error_rate: float, block_bytes: int) -> _Blocks:
    """The benchmark as broadcasts of about ``block_bytes`` of text; the driver holds one at a time."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("text").alias("text"))
    send = benchmark.sparkSession.sparkContext.broadcast
    sent, ids, texts, size = [], [], [], 0
    for row in items.toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text.encode())
        if size >= block_bytes:
            sent.append(send((ids, texts)))
            ids, texts, size = [], [], 0
    return _Blocks([*sent, send((ids, texts))] if ids else sent, error_rate)


def leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", error_rate: float = 0.1, block_bytes: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, edits, end_byte): a row for each document and benchmark item found in it."""
    blocks = _blocks(benchmark, error_rate, block_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, 1):
            for block in blocks:
                for batch in held:
                    for i, _, data, offsets in text_chunks(batch.column(1)):
                        found = matches(block, data, offsets)
                        rows = pa.array([i + d for d, *_ in found], pa.int64())
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *(pa.array([f[c] for f in found], pa.int64()) for c in (1, 2, 3))], ["doc_id", "item_id", "edits", "end_byte"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(scan, f"doc_id {kind}, item_id long, edits long, end_byte long")


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", error_rate: float = 0.1, block_bytes: int = 2_000_000) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; whole rows pass through the scan, with no shuffle."""
    blocks = _blocks(benchmark, error_rate, block_bytes)
    at = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, at):
            clean = [np.ones(len(batch), bool) for batch in held]
            for block in blocks:
                for batch, keep in zip(held, clean, strict=True):
                    for i, _, data, offsets in text_chunks(batch.column(at)):
                        keep[[i + d for d, *_ in matches(block, data, offsets)]] = False
            for batch, keep in zip(held, clean, strict=True):
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(scan, docs.schema)
