"""Target-distribution importance resampling: documents that look like the benchmark are drawn more often.

Features are all runs of 1 to ``max_n`` words, and a feature's bucket is its crc32 modulo ``buckets``. In each block of a
partition a suffix array of word ids lines up the occurrences of every n-gram: each n-gram is hashed once and its bucket
is handed to all its places. Bucket counts of corpus and target give each bucket a gain; a document's weight is
the mean gain of its features, and adding Gumbel noise to it draws without replacement in proportion to exp(weight / 1000).

What goes to the driver and to all executors is one number a bucket. The ranks come from a distributed sort.

Defined results: a null or wordless text has no feature and weight 0; a null doc_id counts as empty text in the noise
and ranks after other ids; repeated rows are rows of their own and may each be drawn (at equal score and id the one
with fewer features first); with an empty target or an empty
corpus the gains stay finite; documents under ``min_words`` words are scored but never drawn; no text is cut; other
columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizforge.llm.common import LOWER, runs, span_ids, stored, text_chunks
from quizforge.llm.suffixes import blocks, ngram_runs, room_in_groups
from quizforge.operators.dedup import dense_index

SHARD_BYTES = 4 << 20
_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray, max_n: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, document, bucket) of the n-grams of a chunk of texts, repeats included, block by block."""
    lower = LOWER[data]
    starts, ends, doc = runs(_WORD[lower], offsets)
    if not len(starts):
        return
    ids = span_ids(lower, starts, ends)[0]
    room = room_in_groups(doc[1:] == doc[:-1])
    raw = lower.tobytes()
    for a, b, reach in blocks(len(ids), max_n - 1):
        for n, places, run, first in ngram_runs(ids[a:reach], room[a:reach], range(1, max_n + 1), b - a):
            words = zip(*[zip(starts[first + a + j].tolist(), ends[first + a + j].tolist(), strict=True) for j in range(n)], strict=True)
            hashed = np.fromiter((zlib.crc32(b" ".join([raw[s:e] for s, e in gram])) for gram in words), np.int64, len(first))
            yield n, doc[places + a], (hashed % buckets)[run]


def bucket_counts(docs: DataFrame, text: str, max_n: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts are in each bucket; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), SHARD_BYTES):
                for _, _, bucket in features(data, offsets, max_n, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    return docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * ln of how much likelier the target makes a bucket), with one added to every count."""
    both = []
    for counts in (corpus, target):
        own = [0] * buckets
        for bucket, n in counts.collect():  # one row a bucket
            own[bucket] = n
        both.append(own)
    (s, t), (all_s, all_t) = both, map(sum, both)
    return np.array([math.floor(1000 * math.log((float(t[i]) + 1) * (float(all_s) + buckets) / ((float(s[i]) + 1) * (float(all_t) + buckets)))) for i in range(buckets)], np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise), fixed by seed and doc_id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def weighted(docs: DataFrame, gain: np.ndarray, text: str, max_n: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1), SHARD_BYTES):
                n_words, n_features, total = (np.zeros(j - i, np.int64) for _ in range(3))
                for n, doc, bucket in features(data, offsets, max_n, len(own)):
                    each = np.bincount(doc, minlength=j - i)
                    n_features += each
                    n_words += each if n == 1 else 0
                    # Sums of whole numbers far under 2**53 are exact.
                    total += np.bincount(doc, own[bucket], j - i).astype(np.int64)
                weight = total // np.maximum(n_features, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, *, text: str = "text", max_n: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, min_words: int = 20) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row; ``rank`` is null where a document isn't drawn."""
    gain = gains(bucket_counts(docs, text, max_n, buckets), bucket_counts(target, text, max_n, buckets), buckets)
    scored = weighted(docs, gain, text, max_n).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = stored(scored, "scored")
    able = scored.where(F.col("n_words") >= min_words).drop("n_words")
    drawn = able.count() * percent // 100
    ranked = dense_index(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")], "rank", start=1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)
