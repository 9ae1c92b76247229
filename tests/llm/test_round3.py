"""Archives of other writers, a warm token cache, and near copies of the given documents against all pairs."""

import base64
import collections
import gzip
import hashlib
import math

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quizforge.llm import simhash, token_counts, warc


def other_record(head, block):
    return b"\r\n".join([b"WARC/1.0", *head, b"Content-Length:%d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"


def other_archive():
    """Records of another writer: names in any case, no space after a colon, a folded header, records of other types."""
    html = "<p>é page</p>".encode()
    http = b"HTTP/1.1 200 OK\r\ncontent-LENGTH:%d\r\n\r\n" % len(html) + html
    digest = base64.b32encode(hashlib.sha1(html).digest())
    return html, [
        other_record([b"warc-type: warcinfo", b"Content-Type:application/warc-fields"], b"software: other\r\n"),
        other_record([b"WARC-TYPE:response", b"warc-target-uri: http://a/", b"x-page-id:1", b"warc-payload-digest:\tSHA1:" + digest.lower()], http),
        other_record([b"WARC-Type: request", b"X-Note: one", b"  folded: two"], b"GET / HTTP/1.1\r\n\r\n"),
        other_record([b"WARC-Type: response", b"X-Page-ID: 2", b"WARC-Payload-Digest: md5:abc"], b"HTTP/1.1 200 OK\r\n\r\n" + html),
        other_record([b"WARC-Type: revisit", b"X-Page-ID: 3", b"X-Refers-To-Page-ID: 1", b"WARC-Payload-Digest: sha1:" + digest], b"HTTP/1.1 304 Not Modified\r\nContent-Length: 15\r\n\r\n"),
    ]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_archives_of_other_writers(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(warc, "_BLOCK", block)
    html, records = other_archive()
    pad = b"\0" * 70
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "CC-MAIN-1.warc.gz").write_bytes(pad.join(gzip.compress(r) for r in records) + pad)
    (tmp_path / "in" / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    for name in ("CC-MAIN-1.warc.gz", "whole.warc.gz"):
        with (tmp_path / "in" / name).open("rb") as f:
            assert [h + b"\r\n\r\n" + b + b"\r\n\r\n" for h, b in warc.inflated_records(f)] == records
    folder = f"file://{tmp_path}"
    for _ in range(2):  # a second run replaces the files of the first
        assert warc.normalise(spark, f"{folder}/in", f"{folder}/out") == 2 * len(records)
    rows = warc.read_records(warc.sidecar_index(spark, f"{folder}/out"), "bigint").collect()
    digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
    want = [(1, "http://a/", len(html), digest, "response", None, html), (2, None, len(html), digest, "response", None, html), (3, None, 15, digest, "revisit", 1, b"")]
    assert sorted((tuple(r) for r in rows), key=lambda r: r[0]) == [x for w in want for x in (w, w)]


def test_a_file_that_ends_early_is_an_error(tmp_path):
    records = other_archive()[1]
    for bad in (gzip.compress(b"".join(records))[:-9], gzip.compress(b"".join(records)[:-3])):
        (tmp_path / "x.gz").write_bytes(bad)
        with pytest.raises(ValueError, match="ends inside"), (tmp_path / "x.gz").open("rb") as f:
            list(warc.inflated_records(f))


def test_a_warm_cache_needs_no_texts(spark, tmp_path, monkeypatch):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(i, f"some text {i % 40}") for i in range(120)] + [(None, None)], "doc_id long, text string")
    first = sorted(map(tuple, token_counts.token_counts(docs, path, cache_path=cache).collect()), key=repr)
    token_counts.append_misses(None, cache, path, keyed=token_counts.digests(docs))  # nothing is missing: no texts are asked for
    assert sorted(map(tuple, token_counts.token_counts(docs, path, cache_path=cache).collect()), key=repr) == first
    monkeypatch.setattr(token_counts, "FEW_MISSES", 3)
    more = docs.unionByName(spark.createDataFrame([(500 + i, f"new text {i}") for i in range(9)], "doc_id long, text string"))
    again = token_counts.token_counts(more, path, cache_path=cache)
    assert again.count() == 130 and token_counts.read_cache(spark, cache).count() == 50
    assert spark.read.parquet(cache).count() == 50


def test_near_copies_of_the_given_documents_against_all_pairs(spark):
    """Of the texts that go at an exact similarity of 0.8 in five-word shingles, at least 95 % go; what stays apart by far, stays."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("text").isNotNull()).dropDuplicates(["text"])
    rows = {r.doc_id: set(simhash.shingle_hashes(r.text.encode(), 5)) for r in docs.select("doc_id", "text").collect()}
    often = collections.Counter(h for s in rows.values() for h in s)
    postings, root = collections.defaultdict(list), {i: i for i in rows}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def joined(least):
        for i in root:
            root[i] = i
        postings.clear()
        for i in sorted(rows, key=lambda i: len(rows[i])):
            own = sorted(rows[i], key=lambda h: (often[h], h))
            met = {j for h in own[: len(own) - math.ceil(least * len(own)) + 1] for j in postings[h]}
            for h in own[: len(own) - math.ceil(least * len(own)) + 1]:
                postings[h].append(i)
            for j in met:
                shared = len(rows[i] & rows[j])
                if shared >= least * (len(rows[i]) + len(rows[j]) - shared):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        return {i for i in rows if find(i) != i}

    kept = {r.doc_id for r in simhash.one_of_each_group(docs).select("doc_id").collect()}
    tight = {r.doc_id for r in simhash.representatives(docs).select("doc_id").collect()}
    must, may = joined(0.8), joined(0.65)
    assert must and len(must - kept) >= 0.95 * len(must)
    # Beyond the classes of close fingerprints only near copies go.
    assert not (tight - kept) - may
