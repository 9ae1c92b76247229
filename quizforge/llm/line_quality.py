"""Quality rules with cross-document line frequency.

Base rules look at one text; the method counts, for each host (``source``), in how many documents a normalised
line occurs. Lines above ``max_docs`` documents of their host are taken out, and a document that keeps less
than ``min_left`` of its words is rejected as depleted. Only 128-bit hashes of host and line leave the tasks that
read the texts. Inside a text, words and lines are the same if their bytes are.

Defined results: a null text is empty (all counts 0, base_failed); a null host is a host of its own; rows with one
doc_id are one document when a line's documents are counted (rows with a null id are documents of their own),
but each row is judged and returned; no text is cut; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizforge.llm.common import SEPARATOR, runs, span_ids, stored, text_chunks

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_NEWLINE = 0x0A


def repeats(*keys: np.ndarray) -> np.ndarray:
    """For each entry, 0 if its keys are new together, 1 if an earlier entry has them, with 2 added if any other has them."""
    n = len(keys[0])
    order = np.lexsort((np.arange(n), *keys))
    like_before = np.zeros(n, bool)
    if n:
        like_before[1:] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    like_after = np.concatenate((like_before[1:], [False])) if n else like_before
    out = np.zeros(n, np.int8)
    out[order] = like_before + 2 * (like_before | like_after)
    return out


def text_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...]]:
    """The counts of each document, and (document, start, end, words) of every line with a word."""
    n = len(offsets) - 1
    of = lambda index, weights=None: np.bincount(index, weights, n).astype(np.int64)
    in_word = ~SEPARATOR[data]
    starts, ends, doc = runs(in_word, offsets)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out = {"n_words": of(doc), "word_chars": of(owner[in_word & (data & 0xC0 != 0x80)]), "n_symbols": of(owner[_IS_SYMBOL[data]])}

    word = span_ids(data, starts, ends)[0]
    first = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
    again = repeats(word[first], word[first + 1], word[first + 2], doc[first]) >= 2
    covered = np.zeros(len(doc), bool)
    for k in range(3):
        covered[first[again] + k] = True
    out["n_repeat_words"] = of(doc[covered])

    line_a, line_b, line_doc = runs(data != _NEWLINE, offsets)
    lo, hi = np.searchsorted(starts, line_a), np.searchsorted(starts, line_b)
    worded = hi > lo
    line_a, line_b, line_doc, words = line_a[worded], line_b[worded], line_doc[worded], (hi - lo)[worded]
    same = repeats(span_ids(data, line_a, line_b)[0], line_doc)
    out["n_dup_lines"] = of(line_doc[same % 2 == 1])
    return out, (line_doc, line_a, line_b, words)


def line_keys(data: np.ndarray, hosts: list[bytes], doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits for each line: a hash of its host and of its words, lower-cased, with single spaces between."""
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    keys = (digest(hosts[d] + b" ".join(raw[a:b].lower().split())) for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # A line has no newline: the last one before a line ends its host, and a null host has none.
        every = [b"" if h is None else str(h).encode() + b"\n" for h in batch.column(1).to_pylist()]
        for i, j, data, offsets in text_chunks(batch.column(2)):
            counts, (doc, start, end, words) = text_counts(data, offsets)
            key = line_keys(data, every[i:j], doc, start, end)
            # One entry for each document and line: its key, and the words of all its occurrences.
            order = np.lexsort((key[:, 1], key[:, 0], doc))
            doc, key, words = doc[order], key[order], words[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]).any(axis=1)
            at = np.flatnonzero(new)
            summed = np.add.reduceat(words, at) if len(at) else words
            ends = pa.array(np.searchsorted(doc[at], np.arange(j - i + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (key[at, 0], key[at, 1], summed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], *(pa.array(counts[c]) for c in COUNTS), *lists],
                ["doc_id", *COUNTS, "lines", "more", "line_words"],
            )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(docs: DataFrame, *, text: str = "text", host: str = "source", max_docs: int = 50, min_left: float = 0.5) -> DataFrame:
    """(doc_id, counts, base_failed, n_left, kept): one row for each document."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, {', '.join(f'{c} long' for c in COUNTS)}, lines array<long>, more array<long>, line_words array<long>"
    scanned = docs.select("doc_id", F.col(host).alias("host"), F.col(text).alias("text")).mapInArrow(_scan, schema)
    scanned = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "line_counts")
    each = scanned.select("row", "doc_id", F.explode(F.arrays_zip("lines", "more", "line_words")).alias("l"))
    each = each.select("row", "doc_id", "l.lines", "l.more", "l.line_words")
    # Rows of one document count once: the line's documents are its rows, less the rows that repeat an id.
    counted = each.groupBy("lines", "more").agg(F.count("*").alias("n_rows"))
    often = stored(counted.where(F.col("n_rows") > max_docs).select("lines", "more"), "often_lines")
    own_id = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("row"))
    documents = each.join(often, ["lines", "more"]).select("lines", "more", own_id.alias("d")).distinct().groupBy("lines", "more").agg(F.count("*").alias("n_docs"))
    frequent = stored(documents.where(F.col("n_docs") > max_docs).select("lines", "more"), "frequent_lines")
    removed = each.join(frequent, ["lines", "more"]).groupBy("row").agg(F.sum("line_words").alias("n_removed"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("n_removed", F.lit(0))
    kept = ~base_failed & (left >= min_left * F.col("n_words"))
    return scanned.drop("lines", "more", "line_words").join(removed, "row", "left").select(
        "doc_id", *COUNTS, base_failed.alias("base_failed"), left.alias("n_left"), kept.alias("kept")
    )
