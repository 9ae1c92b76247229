"""WARC archives: written as whole-file gzip, then normalised to one gzip member a record with an offset index.

``write_archives`` gives each partition's pages as WARC/1.1 records in one gzip stream a file. ``normalise`` inflates each such
file once (of one gzip member or of several), rewrites every record as a member of its own, and writes a sidecar
``<file>.idx`` beside it: a line with offset and length for each record. ``read_records`` seeks to each record by the
sidecars. ``normalise`` takes archives of any writer, whatever their names: members padded with zeros, header names in any
case, folded headers, records of all types. Files lie in the folder that all executors share and take their final
name in one move, a sidecar before its archive; a task that runs again takes away the file it had made before the move.

Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the largest page_id is the response and the others are
revisits of it. Defined results: a null html is an empty payload (equal to other empty ones); a null page_id
is smaller than any other; of repeated rows with the largest page_id, each is a response with a record id of its own;
extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizforge.llm.common import new_path, stored

#: Salts over which the pages of one payload are dealt.
SALTS = 16
_BLOCK = 1 << 20


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI as Spark writes it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def record(kind: str, record_id: str, date: str, page_id: object, url: str | None, digest: str, size: int, refers_to: tuple[object, str | None] | None, payload: bytes) -> bytes:
    """One WARC/1.1 record of an HTTP response; a revisit has its HTTP head alone."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to[0]}"]
        if refers_to[1] is not None:
            head.append("WARC-Refers-To-Target-URI: " + " ".join(refers_to[1].split()))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Headers(dict):
    """Header values by name, in any case."""

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default: object = None) -> object:
        return super().get(name.lower(), default)


def parse_head(head: bytes) -> Headers:
    """Header values; a line that begins with white space goes on with the one before."""
    lines: list[str] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and line.strip() and lines:
            lines[-1] += " " + line.strip()
        elif line:
            lines.append(line)
    named = (line.partition(":") for line in lines)
    return Headers({name.strip().lower(): value.strip() for name, colon, value in named if colon})


class _Writer:
    """A file that takes its final name only when it is complete."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, at = open_fs(folder)
        self.final, self.part = f"{at}/{name}", f"{at}/_{name}.{TaskContext.get().taskAttemptId()}"
        self.fs.create_dir(at, recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)

    def close(self) -> None:
        self.out.close()
        if self.fs.get_file_info(self.final).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.final)  # some stores don't move onto a file
        self.fs.move(self.part, self.final)


def with_types(pages: DataFrame, *, html: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, payload_bytes, refers_to, refers_url): which pages revisit which."""
    body = F.coalesce(F.col(html), F.lit(""))
    keyed = pages.select("page_id", "url", body.alias("payload"), F.sha1(body.cast("binary")).alias("digest_key"), F.octet_length(body).alias("payload_bytes"))
    equal = keyed.where(F.col("payload_bytes") >= min_bytes).groupBy("digest_key").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("n"))
    # Payloads that occur once need no partner; of the others each salt gets its copy, so a hot one is dealt over many tasks.
    equal = equal.select("digest_key", F.col("last.page_id").alias("last_id"), F.col("last.url").alias("last_url"), "n")
    shared = equal.where((F.col("n") > 1) & F.col("last_id").isNotNull()).select("digest_key", "last_id", "last_url", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    shared = stored(shared, "payloads")
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    revisit = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    return salted.join(shared, ["digest_key", "salt"], "left").select(
        "page_id", "url", "payload", F.unhex("digest_key").alias("digest"), "payload_bytes", F.when(revisit, F.col("last_id")).alias("refers_to"), "last_url"
    )


def write_archives(typed: DataFrame, folder: str, *, archive_bytes: int = 64_000_000, level: int = 3) -> int:
    """Write the records as monolithic gzip files of about ``archive_bytes`` (before compression); their number."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size, out, deflate, name, placed = TaskContext.get().partitionId(), 0, 0, None, None, "", 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, payload, digest, payload_bytes, refers_to, last_url = row
                if out is None:
                    name = f"part-{part:05d}-{n:04d}.warc.gz"
                    out, deflate, size, placed = _Writer(folder, name), zlib.compressobj(level, wbits=31), 0, 0
                    n += 1
                kind, body = ("response", payload.encode()) if refers_to is None else ("revisit", b"")
                # The place in the archives names a record: repeated rows differ, and a task that runs again gives the same.
                record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{folder}/{name}#{placed}")
                placed += 1
                raw = record(kind, str(record_id), date, page_id, url, base64.b32encode(digest).decode(), payload_bytes, None if refers_to is None else (refers_to, last_url), body)
                out.out.write(deflate.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    out.out.write(deflate.flush())
                    out.close()
                    out = None
        if out is not None:
            out.out.write(deflate.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    ordered = typed.sortWithinPartitions("page_id", "url")  # a task that runs again writes the same files
    return ordered.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file, block by block; after a member's end the next member goes on."""
    inflate, begun = zlib.decompressobj(wbits=31), False
    while raw := stream.read(_BLOCK):
        while raw:
            if not begun and not (raw := raw.lstrip(b"\0")):  # files may be padded with zeros between members
                break
            begun = True
            yield inflate.decompress(raw)
            raw = inflate.unused_data
            if inflate.eof:
                inflate, begun = zlib.decompressobj(wbits=31), False
    if begun:
        raise ValueError("the archive ends inside a gzip member")


def inflated_records(stream) -> Iterator[tuple[bytes, bytes]]:
    """(head, block) of each record of a gzip file, which is inflated once."""
    buffer, at = bytearray(), 0
    need, head = None, b""
    for raw in inflated(stream):
        buffer += raw
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                head, at = bytes(buffer[at:end]), end + 4
                need = int(parse_head(head)["content-length"])
            if len(buffer) - at < need + 4:
                break
            yield head, bytes(buffer[at : at + need])
            at, need = at + need + 4, None
        del buffer[:at]
        at = 0
    if buffer or need is not None:
        raise ValueError("the archive ends inside a record")


def normalise(spark: SparkSession, folder: str, target: str, *, level: int = 5) -> int:
    """Rewrite the archives ``*.warc.gz`` of ``folder`` into ``target``, a member a record with a sidecar index; the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                own, at = open_fs(path)
                name = path.rsplit("/", 1)[1]
                out, sidecar, place, n = _Writer(target, name), _Writer(target, name + ".idx"), 0, 0
                with own.open_input_stream(at, compression=None) as stream:
                    for head, block in inflated_records(stream):
                        deflate = zlib.compressobj(level, wbits=31)
                        member = deflate.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()
                        out.out.write(member)
                        sidecar.out.write(f"{place} {len(member)}\n".encode())
                        place += len(member)
                        n += 1
                sidecar.close()
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")
    return paths.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def sidecar_index(spark: SparkSession, folder: str) -> DataFrame:
    """(file, offset, length) of every record of the normalised archives, from their sidecars."""
    lines = spark.read.schema("`offset` long, length long").option("sep", " ").option("pathGlobFilter", "*.warc.gz.idx").csv(folder)
    return lines.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.idx$", "").alias("file"), "offset", "length")


def read_records(index: DataFrame, page_type: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every indexed response and revisit.

    A response without a digest, or with one that isn't SHA-1, gets that of its payload.
    """
    number = page_type in ("bigint", "int", "smallint", "tinyint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != name:
                    name, (store, at) = path, open_fs(path)
                    file = store.open_input_file(at)
                file.seek(offset)
                head, block = zlib.decompress(file.read(length), wbits=31).split(b"\r\n\r\n", 1)
                h = parse_head(head)
                kind = h["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                http, _, payload = block[:-4].partition(b"\r\n\r\n")
                size = int(parse_head(http).get("content-length", len(payload)))
                algorithm, _, digest = h.get("warc-payload-digest", "").partition(":")
                if algorithm.lower() != "sha1":
                    digest = None
                if kind == "response":
                    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if digest is not None and digest.upper() != own or len(payload) != size:
                        raise ValueError(f"{path} at {offset}: the payload doesn't match its digest")
                    digest = own
                page, refers = [int(x) if x is not None and number else x for x in (h.get("x-page-id"), h.get("x-refers-to-page-id"))]
                rows.append((page, h.get("warc-target-uri"), size, digest, kind, refers, payload))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64() if number else pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64() if number else pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    kind = "long" if number else "string"
    return index.mapInArrow(run, f"page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary")


def archive_and_read(pages: DataFrame, *, html: str = "html", min_bytes: int = 0, folder: str | None = None, **options: int) -> DataFrame:
    """Write, normalise and read back all pages; the records as ``read_records`` gives them."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    if not write_archives(with_types(pages, html=html, min_bytes=min_bytes), f"{folder}/monolithic", **options):
        kind = "long" if pages.schema["page_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string"
        return spark.createDataFrame([], f"page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary")
    normalise(spark, f"{folder}/monolithic", f"{folder}/members")
    return read_records(sidecar_index(spark, f"{folder}/members"), pages.schema["page_id"].dataType.simpleString())
