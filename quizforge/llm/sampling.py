"""Bounded samples of labelled rows, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, *, text: str, rows: int) -> DataFrame:
    """(y, text) of at most ``rows`` labelled ids, chosen by the ids' hash; ``learnable`` is over ``doc_id``.

    An id with several labels has the largest, one with several texts the first in order; null labels and ids are
    left out. So the sample has no more rows than ids, whatever repeats.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learnable)
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id"), F.col(text).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id")  # ``ids`` has at most ``rows`` rows of two numbers
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")
