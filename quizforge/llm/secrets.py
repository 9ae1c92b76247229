"""Secret scans with corpus-wide ownership frequency.

Base patterns find assignments, access keys and hex strings in every text. The method looks at the values behind them,
and at opaque tokens (long mixed strings that no base pattern covers): their hashes are counted by distinct repositories
(documents) and owners (sources). A value that many have is a copied example; one that a single owner
has in few repositories and that looks random is a live credential. Live opaque tokens become spans of their own; base
spans always stay.

Only hashes with owner and repository are shuffled, each once a repository. A value that a third of all documents hold
is counted in parts before the shuffle.

Defined results: a null text is empty (no spans; the digest is that of the empty string); rows with one doc_id are one
repository, rows with a null id are repositories of their own; a null source is an owner of its own; each row is returned;
no text is cut; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizforge.llm.common import LOWER, runs, stored, text_chunks

#: The kinds in the order in which they are listed, then the method's own.
KINDS = ("assign", "access", "hex", "opaque")
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_OPAQUE = 6, 20, 24, 20
#: Over lower-cased text: A-Z and a-z are the same in all three groups.
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX, _OPAQUE = np.zeros(256, bool), np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_OPAQUE[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"]] = True
_CLASSES = tuple(map(re.compile, (rb"[0-9]", rb"[a-z]", rb"[A-Z]")))


def _runs_of(allowed: np.ndarray, least: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the longest runs of allowed bytes that have ``least`` or more."""
    starts, ends, doc = runs(allowed[data], offsets)
    long = ends - starts >= least
    return starts[long], ends[long], doc[long]


def find(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, kind, start, end, start of the value) of every span, in bytes of the chunk; values end where spans do."""
    raw, lower = data.tobytes(), LOWER[data].tobytes()
    found = []
    hex_start, hex_end, hex_doc = _runs_of(_HEX, MIN_HEX, data, offsets)
    found += zip(hex_doc.tolist(), [2] * len(hex_doc), hex_start.tolist(), hex_end.tolist(), hex_start.tolist(), strict=True)
    edges = offsets.tolist()
    for d, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        found += ((d, 0, *m.span(), m.start(2)) for m in _ASSIGN.finditer(lower, a, b) if m.end(2) - m.start(2) >= MIN_VALUE)
        if raw.find(b"AKIA", a, b) >= 0:
            found += ((d, 1, *m.span(), m.start()) for m in _ACCESS.finditer(raw, a, b) if m.end() - m.start() >= MIN_ACCESS)
    base = np.array(sorted((s, e) for _, _, s, e, _ in found), np.int64).reshape(-1, 2)
    start, end, doc = _runs_of(_OPAQUE, MIN_OPAQUE, data, offsets)
    if len(start):
        # A token is opaque if it has digits, small and capital letters, and no base span touches it.
        mixed = np.array([all(c.search(raw, a, b) for c in _CLASSES) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        reach = np.maximum.accumulate(base[:, 1]) if len(base) else base[:, 1]
        before = np.searchsorted(base[:, 0], end) - 1  # the last base span that starts before the token ends
        touched = (before >= 0) & (reach[np.maximum(before, 0)] > start) if len(base) else np.zeros(len(start), bool)
        keep = mixed & ~touched
        found += zip(doc[keep].tolist(), [3] * int(keep.sum()), start[keep].tolist(), end[keep].tolist(), start[keep].tolist(), strict=True)
    found.sort(key=lambda x: (x[0], x[2], x[1]))
    table = np.array(found, np.int64).reshape(-1, 5)
    return tuple(table[:, i] for i in range(5))


def looks_live(value: bytes, distinct: int = 8) -> bool:
    """Random-looking: ``distinct`` different characters or more, a letter and a digit among them."""
    return len(set(value)) >= distinct and re.search(rb"[0-9]", value) is not None and re.search(rb"[A-Za-z]", value) is not None


_SPANS = "array<struct<start:long,kind:int,end:long,value:binary,live:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(2)):
            doc, kind, start, end, value = find(data, offsets)
            points = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))
            first = points[offsets[:-1]][doc]
            raw = data.tobytes()
            values = [raw[a:b] for a, b in zip(value.tolist(), end.tolist(), strict=True)]
            spans = pa.StructArray.from_arrays(
                [pa.array(points[start] - first), pa.array(kind.astype(np.int32)), pa.array(points[end] - first), pa.array([hashlib.sha256(v).digest()[:16] for v in values], pa.binary()), pa.array([looks_live(v) for v in values], pa.bool_())],
                ["start", "kind", "end", "value", "live"],
            )
            ends = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.ListArray.from_arrays(ends, spans)], ["doc_id", "owner", "found"])


def ownership(each: DataFrame) -> DataFrame:
    """(value, owners, repositories) over rows of (value, owner, repository); nulls are values like others."""
    used = each.select("value", "owner", "repository").distinct()
    of_owner = used.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return of_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the spans' order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, *, text: str = "text", owner: str = "source", max_owners: int = 1, max_repositories: int = 3) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, live_spans, n_live, n_examples): one row for each row of ``docs``.

    ``live_spans`` are those whose value looks random, has at most ``max_owners`` owners and ``max_repositories`` repositories;
    ``n_examples`` counts the base spans whose value more owners or repositories have.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    found = docs.select("doc_id", F.col(owner).alias("owner"), F.col(text).alias("text")).mapInArrow(_scan, f"doc_id {kinds['doc_id']}, owner {kinds[owner]}, found {_SPANS}")
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "secret_spans")
    repository = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("row"))
    each = found.where(F.size("found") > 0).select("row", "owner", repository.alias("repository"), F.explode("found").alias("s")).select("row", "owner", "repository", "s.value", "s.live").distinct()
    owned = ownership(each).where((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).select("value")
    # The values that stay have few rows each; copied examples meet no partner.
    rare = each.select("row", "value", "live").join(stored(owned, "owned_values"), "value")
    rare = rare.groupBy("row").agg(F.collect_set("value").alias("rare"), F.collect_set(F.when(F.col("live"), F.col("value"))).alias("live"))
    none = F.array().cast("array<binary>")
    whole = found.join(rare, "row", "left").withColumn("rare", F.coalesce("rare", none)).withColumn("live", F.coalesce("live", none))
    is_base = lambda s: s["kind"] < 3
    base = F.filter("found", is_base)
    live = F.filter("found", lambda s: F.array_contains(F.col("live"), s["value"]))
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return whole.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.filter("found", lambda s: is_base(s) | F.array_contains(F.col("live"), s["value"]))).alias("spans"), joined_spans(live).alias("live_spans"),
        F.size(live).cast("long").alias("n_live"), F.size(F.filter(base, lambda s: ~F.array_contains(F.col("rare"), s["value"]))).cast("long").alias("n_examples"),
    )
