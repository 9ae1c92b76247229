"""Phrase collocation mining over suffix arrays.

Texts are cut into pieces at punctuation and line ends, and pieces into words. Each shard of a few megabytes of texts
gets a suffix array of its word ids (numpy prefix doubling); an interval in which neighbours share n words is one
n-gram, its size the n-gram's count. Counts of all shards are merged by (lang, phrase), the phrase itself being the key.

The texts are read three times: for words, for pairs and for phrases of two words or more. A phrase can only be frequent if
all shorter ones in it are, so pairs leave out rare words, and phrases rare pairs. Pairs are first counted by a
64-bit hash alone, as nearly all of them are rare: two pairs under one hash can only let more through, and what is let
through is counted by its words. The hashes of what is frequent are sent to the tasks while there are at most
``MAX_KNOWN`` of them. Beyond that less is left out: more is shuffled, with the same result.

Scores are decimals without fraction, so products may pass 64 bits.

Defined results: a null text is empty; a null lang is ``und``; repeated rows count each; words hold whatever bytes
aren't spaces, tabs or piece ends; no text is cut (long ones are worked through in blocks that overlap by a phrase);
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizforge.llm.common import LOWER, mixed, runs, span_hashes, span_ids, stored, text_chunks
from quizforge.llm.suffixes import blocks, ngram_runs, room_in_groups

#: What ends a piece, and what ends a word.
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD_END = _PIECE_END.copy()
_WORD_END[[0x20, 0x09]] = True
MAX_KNOWN = 4_000_000
SHARD_BYTES = 2 << 20
_SALTS = 64


class Words:
    """The words of a chunk of texts, in a buffer where single spaces part them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        lower = LOWER[data]
        starts, ends, self.doc = runs(~_WORD_END[lower], offsets)
        piece = np.concatenate(([0], np.cumsum(_PIECE_END[lower])))[starts]
        size = ends - starts
        self.starts = np.concatenate(([0], np.cumsum(size + 1)))[:-1].astype(np.int64)
        self.ends = self.starts + size
        self.data = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        inside = np.ones(len(self.data), bool)
        inside[self.ends] = False
        self.data[inside] = lower[~_WORD_END[lower]]
        self.next = (self.doc[1:] == self.doc[:-1]) & (piece[1:] == piece[:-1])

    def hashes(self, start: np.ndarray, end: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """64 bits for the words from place ``start`` to place ``end``, in the lang of that hash."""
        return mixed(span_hashes(self.data, self.starts[start], self.ends[end]) + lang)

    def limit(self, known: np.ndarray, m: int, lang: np.ndarray) -> None:
        """Keep together only neighbours that are both known (m = 1), or a known pair (m = 2); ``known`` has sorted hashes."""
        first = np.flatnonzero(self.next) if m == 2 else np.arange(len(self.doc))
        ok = np.zeros(len(self.doc), bool)
        ok[first] = is_known(known, self.hashes(first, first + m - 1, lang[first]))
        self.next &= ok[:-1] if m == 2 else ok[1:] & ok[:-1]

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The n words at each place as strings, without copies in Python."""
        start, size = self.starts[at], self.ends[at + n - 1] - self.starts[at]
        edges = np.concatenate(([0], np.cumsum(size)))
        source = np.arange(edges[-1]) + np.repeat(start - edges[:-1], size)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(self.data[source])).cast(pa.string())


def is_known(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str], Words]]:
    """(lang code of each document, langs, words) of every few megabytes of texts."""
    langs = batch.column(0).dictionary_encode()
    names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
    for i, j, data, offsets in text_chunks(batch.column(1), SHARD_BYTES):
        yield codes[i:j].astype(np.int64), names, Words(data, offsets)


def _lang_hashes(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(n.encode()) for n in names], np.uint64)


def _runs(batches: Iterator[pa.RecordBatch], sizes: range, m: int, known: Broadcast | None) -> Iterator[tuple]:
    """(words, lang code of each, lang names, n, first place of each n-gram, its count) shard by shard; a shard's words come first, with n = 0."""
    for batch in batches:
        for codes, names, words in _shards(batch):
            if not len(words.doc):
                continue
            lang = codes[words.doc]
            yield words, lang, names, 0, None, np.bincount(lang, minlength=len(names))
            if known is not None:
                words.limit(known.value, m, _lang_hashes(names)[lang])
            room = room_in_groups(words.next)
            # Words that stand alone can't be in a phrase: they are left out of the suffix array.
            own = np.flatnonzero(room_in_groups(words.next[::-1])[::-1] + room - 1 >= sizes[0])
            ids = span_ids(words.data, words.starts[own], words.ends[own])[0] * len(names) + lang[own]
            room = room[own]
            for a, b, reach in blocks(len(ids), sizes[-1] - 1):
                for n, _, run, first in ngram_runs(ids[a:reach], room[a:reach], sizes, b - a):
                    yield words, lang, names, n, own[first + a], np.bincount(run)


def _counted(sizes: range, m: int, known: Broadcast | None):
    """Counts of the n-grams of each shard by their words; with n = 1 also the number of words of each lang, as n = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, lang, names, n, at, count in _runs(batches, sizes, m, known):
            every = pa.array(names, pa.string())
            if n:
                for k in range(0, len(at), 1 << 17):
                    part = at[k : k + (1 << 17)]
                    yield _rows(every.take(pa.array(lang[part])), n, words.phrases(part, n), count[k : k + (1 << 17)])
            elif sizes[0] == 1:
                yield _rows(every, 0, pa.array([""] * len(names)), count)

    return run


def _counted_by_hash(known: Broadcast | None):
    """Counts of the pairs of each shard by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, lang, names, n, at, count in _runs(batches, range(2, 3), 1, known):
            if n:
                hashes = words.hashes(at, at + 1, _lang_hashes(names)[lang[at]])
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(count.astype(np.int64))], ["h", "f"])

    return run


def _rows(lang: pa.Array, n: int, phrase: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(lang), n, np.int32)), phrase, pa.array(count.astype(np.int64))], ["lang", "n", "phrase", "f"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        lang = _lang_hashes(langs.dictionary.to_pylist())[langs.indices.to_numpy(zero_copy_only=False)]
        for i, j, data, offsets in text_chunks(batch.column(1)):
            hashes = mixed(span_hashes(data, offsets[:-1], offsets[1:]) + lang[i:j])
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["h"])


def _sent(hashes: DataFrame) -> Broadcast | None:
    """The hashes sorted, if there are few enough to send them."""
    if hashes.count() > MAX_KNOWN:
        return None
    found = hashes.toArrow().column("h")
    return hashes.sparkSession.sparkContext.broadcast(np.sort(found.to_numpy().view(np.uint64)))


def phrase_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_words: int = 5, min_count: int = 100) -> DataFrame:
    """(lang, n, phrase, f): every phrase of 1 to ``max_words`` words with f >= ``min_count``, and with n = 0 each lang's number of words."""
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))

    def merged(sizes: range, m: int, known: Broadcast | None) -> DataFrame:
        rows = own.mapInArrow(_counted(sizes, m, known), "lang string, n int, phrase string, f long")
        counts = rows.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
        return stored(counts.where((F.col("n") == 0) | (F.col("f") >= min_count)), f"phrases{sizes[0]}")

    words = merged(range(1, 2), 0, None)
    if max_words == 1:
        return words
    known_words = _sent(words.where("n = 1").select("lang", "phrase").mapInArrow(_hashes, "h long"))
    pairs = own.mapInArrow(_counted_by_hash(known_words), "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))
    known_pairs = _sent(stored(pairs.where(F.col("f") >= min_count).select("h"), "pair_hashes"))
    m, known = (2, known_pairs) if known_pairs is not None else (1, known_words)
    return words.unionByName(merged(range(2, max_words + 1), m, known))


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_words: int = 5, min_count: int = 100, top: int = 2000, cover: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each lang, those inside equally frequent longer ones left out."""
    counts = phrase_counts(docs, text=text, lang=lang, max_words=max_words, min_count=min_count)
    total = counts.where(F.col("n") == 0).select("lang", F.col("f").alias("words"))  # one row a lang
    frequent = counts.where(F.col("n") > 0)
    phrases = frequent.where(F.col("n") > 1).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    # A phrase is inside a longer one if it is so inside one that is longer by a word, which is no rarer.
    inner = F.explode(F.array(F.expr("slice(w, 2, size(w) - 1)"), F.expr("slice(w, 1, size(w) - 1)")))
    longer = phrases.where(F.size("w") > 2).select("lang", F.col("a").alias("f"), inner.alias("w")).select("lang", F.array_join("w", " ").alias("phrase"), "f")
    around = longer.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    left = phrases.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < cover * F.col("a"))).drop("around")

    cuts = left.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("head"), F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ").alias("tail"))
    part = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    joined = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(F.broadcast(total), "lang")
    score = F.expr("bigint(cast(1000 * a as decimal(20,0)) * cast(words as decimal(18,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))))")
    scored = joined.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r", "words").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    rows = scored.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.words").alias("n"), "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)).alias("salt"))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The best of a lang are among the best of its parts, so no task sorts a whole lang.
    some = rows.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("at") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
