"""Readers and writers. Files of JSON arrays are read whole, or with ``range_bytes`` as many tasks a file."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizforge.functions.keys import norm_id
from quizforge.sources.files import dealt, filesystem, list_files, new_table_path
from quizforge.sources.json_arrays import array_elements

ITEM = "struct<id:variant,query:string,target:variant,image_path:array<string>,field:string>"
VARIANT = "id string, can_modify boolean, original_query string, original_answer string, modified_query string, modified_answer string, reason string, verify_passed boolean"
OUTPUT = "struct<id:string,source_file:string,query:string,target:string,output:string,status:string>"
IMAGES = ("jpg", "jpeg", "png", "webp", "bmp", "gif")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    # Spark gives the file's path encoded; a plus sign is itself there.
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("value").alias("body"), file.alias("file"))


#: Bodies of files are handed on together, once they are so long.
_BODY_BYTES = 4 << 20
#: Files of one task, where there are few tasks.
_TASK_FILES = 32


def _bodies(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, texts, size = [], [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(names, pa.string())], ["body", "file"])
    for part in parts:
        for path in part.column(0).to_pylist():
            own, at = filesystem(path)
            with own.open_input_stream(at, compression=None) as f:
                texts.append(f.read().decode("utf-8", "replace"))
            names.append(path)
            size += len(texts[-1])
            if size >= _BODY_BYTES:
                yield batch()
                names, texts, size = [], [], 0
    yield batch()


def _whole_listed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(body, file) of the files under ``root`` whose path has ``name``; tasks list and read them."""
    files = list_files(spark, root).where(F.col("file").rlike(name)).select("file")
    return dealt(files, files.count() // _TASK_FILES + 1, "file").mapInArrow(_bodies, "body string, file string")


def _elements(spark: SparkSession, root: str, name: str, kind: str, range_bytes: int | None) -> DataFrame:
    """(file, pos, x): the elements of each file's array, whole files at a time or, with ``range_bytes``, a range at a time."""
    if range_bytes:
        return array_elements(spark, root, name, range_bytes=range_bytes).select("file", F.col("pos").cast("int").alias("pos"), F.from_json("element", kind).alias("x"))
    files = _whole_listed(spark, root, name)
    wrapped = F.from_json("body", f"struct<results:array<{kind}>>")["results"]
    rows = F.when(F.ltrim("body").startswith("["), F.from_json("body", f"array<{kind}>")).otherwise(wrapped)
    return files.select("file", F.posexplode(rows).alias("pos", "x"))


def read_qa(spark: SparkSession, root: str, range_bytes: int | None = None) -> DataFrame:
    """Question items of ``<dataset>/<subject>_qa.json``; other files and rows without an id drop."""
    rows = _elements(spark, root, r"_qa\.json$", ITEM, range_bytes)
    return rows.select(
        F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("dataset"), F.regexp_extract("file", r"([^/]+)_qa\.json$", 1).alias("subject"), "pos",
        norm_id(F.col("x.id")).alias("id"), "x.query", F.try_variant_get("x.target", "$", "string").alias("target"), "x.image_path", "x.field",
    ).where(F.col("id").isNotNull())


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(image_key, label) of one object a file."""
    return _whole(spark, path).select(F.explode(F.from_json("body", "map<string,string>")).alias("image_key", "label"))


def read_text_variants(spark: SparkSession, path: str, action: str) -> DataFrame:
    rows = spark.read.schema(f"dataset string, subject string, results array<struct<{VARIANT.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True)
    return rows.select("dataset", "subject", F.lit(action).alias("action"), F.posexplode("results").alias("pos", "r")).select("dataset", "subject", "action", "pos", "r.*")


def read_rounds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones drop."""
    return spark.read.schema(schema).json(path)


def read_outputs(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """Outputs of files that are an object with ``results``, or a bare list."""
    return _elements(spark, path, r"\.json$", OUTPUT, range_bytes).select("file", "pos", "x.*")


def read_variants(spark: SparkSession, root: str, range_bytes: int | None = None) -> DataFrame:
    """Variant files ``{dataset}_{field}_{level}.json``; a dataset may have ``_``."""
    name = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    part = lambda i: F.regexp_extract(name, r"^(.*)_([^_]+)_([^_]+)$", i)
    rows = _elements(spark, root, r"\.json$", ITEM, range_bytes).select(part(1).alias("dataset"), part(2).alias("field"), part(3).alias("level"), "pos", "x")
    return rows.select("dataset", "field", "level", "pos", norm_id(F.col("x.id")).alias("id"), "x.query", F.try_variant_get("x.target", "$", "string").alias("target"), "x.image_path").where(F.col("id").isNotNull())


def image_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path): images under ``root``, relative to it; no bytes are read, and no list of them comes to the driver."""
    start = len(root.rstrip("/")) + 2  # a path may have the root's names again further down
    files = list_files(spark, root).select(F.substring("file", start, 2**31 - 1).alias("path"))
    return files.where(F.lower(F.substring_index("path", ".", -1)).isin(*IMAGES))


#: Images are handed on once so many bytes are encoded, or with the batch of rows.
_ENCODED_BYTES = 32 << 20


def encode_images(rows: DataFrame, root: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, image, reason): base64 of one image under ``root``, or a JSON array of several in order.

    A row without images, or with one that is missing, has no image and the ``reason``. Images are opened in the task that holds
    the row: nothing is joined, and no bytes are shuffled.
    """
    keys = keys or ["id"]
    own = rows.select(*keys, "image_path")
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(root.rstrip("/"))
        for batch in batches:
            first, size, images, reasons = 0, 0, [], []

            def part(end: int) -> pa.RecordBatch:
                columns = [*(c[first:end] for c in batch.columns[:at]), pa.array(images, pa.large_string()).cast(pa.string()), pa.array(reasons, pa.string())]  # noqa: B023 - called at once
                return pa.RecordBatch.from_arrays(columns, [*keys, "image", "reason"])

            for i, paths in enumerate(batch.column(at).to_pylist()):
                image, reason = _encoded(store, base, paths)
                images.append(image)
                reasons.append(reason)
                size += len(image or "")
                if size >= _ENCODED_BYTES:
                    yield part(i + 1)
                    first, size, images, reasons = i + 1, 0, [], []
            if first < batch.num_rows:
                yield part(batch.num_rows)

    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return own.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", image string, reason string")


def _encoded(store, base: str, paths: list[str] | None) -> tuple[str | None, str | None]:
    if not paths:
        return None, "no_image"
    out = []
    for p in paths:
        try:
            with store.open_input_stream(f"{base}/{p}") as f:
                out.append(base64.b64encode(f.read()).decode())
        except FileNotFoundError:
            return None, "missing_image"
    return (out[0] if len(out) == 1 else json.dumps(out, separators=(",", ":"))), None


def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """``df`` as a table bucketed and sorted by ``keys``: tables with the same keys and buckets are joined, and grouped by
    the keys, without an exchange. Its files are under ``path``; a table of that name is replaced."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """A run again replaces the partitions that it has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_variants(df: DataFrame, path: str) -> None:
    replace_partitions(df, path, "dataset", "field", "level")


def write_judge(df: DataFrame, path: str) -> None:
    replace_partitions(df, path, "model", "dataset", "action", "run_tag")


def write_rounds(df: DataFrame, path: str) -> None:
    df.orderBy("dataset", F.col("id").cast("string"), "image_path_rel").write.json(path)


def write_class_matrix(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.csv(path, header=True)  # one row a subject
