"""Token counts behind a digest cache.

A cache row holds the digest of a normalised text, the digest of the tokenizer's file and the count. Texts are
joined to the cache by both digests; only distinct misses are encoded, and they are appended to the cache,
which is a Parquet table.

Normalisation lower-cases A-Z and turns white space into single spaces, which the vocabulary does too, so it
can't change a count; a text with "<|" (a special token is matched before the vocabulary's own normalisation)
keeps its form.

A digest that the cache holds more than once (two runs that appended at once) counts once.

Defined results: a null text is empty (0 bytes, 0 tokens); repeated rows are rows of their own; a null doc_id
passes through; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizforge.llm.common import new_path, stored, text_chunks
from quizforge.llm.pieces import cut_words, encoder

#: So many digests of 32 bytes are sent to the tasks at most.
FEW_MISSES = 200_000
CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def content_digest(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    plain = F.translate(F.regexp_replace(text, r"[ \t\n\x0b\f\r]+", " "), UPPER, LOWER)
    return F.unhex(F.sha2(F.when(text.contains("<|"), text).otherwise(plain), 256))


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``, one row for each text and tokenizer; empty if nothing was stored there yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
        return rows.groupBy("content_digest", "tokenizer_digest").agg(F.max("n_tokens").alias("n_tokens"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, cut_words)
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                raw = data.tobytes()
                counts = own.counts([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(counts)], ["content_digest", "n_tokens"])

    return encode


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, content_digest) of every row, stored: what is in the cache is known without another look at the texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    return stored(docs.select("doc_id", F.octet_length(body).cast("long").alias("n_bytes"), content_digest(body).alias("content_digest")), "digests")


def append_misses(docs: DataFrame, cache_path: str, tokenizer: str, text: str = "text", keyed: DataFrame | None = None) -> None:
    """Encode the distinct texts that the cache lacks and append their counts to it.

    Misses are found among digests. If there are none, no text is read again; up to ``FEW_MISSES`` of them are sent to the tasks, and
    only their texts travel. Beyond that all distinct texts do, copies meeting in the tasks that read them.
    """
    version = tokenizer_digest(tokenizer)
    keyed = digests(docs, text) if keyed is None else keyed
    known = read_cache(keyed.sparkSession, cache_path).where(F.col("tokenizer_digest") == version).select("content_digest")
    missing = stored(keyed.select("content_digest").distinct().join(known, "content_digest", "left_anti"), "missing")
    n = missing.count()
    if not n:
        return
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(content_digest(body).alias("content_digest"), body.alias("body"))
    if n <= FEW_MISSES:
        texts = texts.join(F.broadcast(missing), "content_digest", "left_semi").dropDuplicates(["content_digest"])
    else:
        texts = texts.dropDuplicates(["content_digest"]).join(missing, "content_digest", "left_semi")
    counted = texts.mapInArrow(_encode(tokenizer), "content_digest binary, n_tokens long")
    # Counts are complete in a table of their own before the cache, which is being read, gets them.
    found = stored(counted.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens"), "misses")
    found.write.mode("append").parquet(cache_path)


def token_counts(docs: DataFrame, tokenizer: str, *, text: str = "text", cache_path: str | None = None, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; the cache is kept at ``cache_path`` if given."""
    cache_path = cache_path or new_path(docs.sparkSession, "token_cache")
    keyed = digests(docs, text)
    append_misses(docs, cache_path, tokenizer, text, keyed)
    version = tokenizer_digest(tokenizer)
    cache = read_cache(docs.sparkSession, cache_path).where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    return keyed.join(cache, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
