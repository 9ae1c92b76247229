"""Files that tasks open themselves, by pyarrow, under the paths that Spark gives."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_LISTED = "file string, size long, folder boolean"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; the path is as it is, not encoded."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        plain = rest if scheme == "file" and colon else path
        return pafs.LocalFileSystem(), "/" + plain.lstrip("/") if plain.startswith("/") else plain
    return pafs.FileSystem.from_uri(quote(path, safe=":/@"))


def new_table_path(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can read: under spark.checkpoint.dir; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quizforge-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """Short rows, such as names of files, each of which is much work, in at most ``n`` partitions: Spark would put them
    together by their own size, which may mean one task."""
    return rows.repartition(max(1, min(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))), *by)


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each folder holds itself; a file is its own only entry."""
    for part in parts:
        for folder in part["file"]:
            own, base = filesystem(folder.rstrip("/"))
            at = own.get_file_info(base)
            found = [at] if at.type == pafs.FileType.File else own.get_file_info(pafs.FileSelector(base))
            start = len(at.path)
            for i in range(0, len(found), 10_000):
                rows = [(folder.rstrip("/") + x.path[start:], x.size or 0, x.type == pafs.FileType.Directory) for x in found[i : i + 10_000] if x is at or not _hidden(x.base_name)]
                yield pd.DataFrame(rows, columns=["file", "size", "folder"])


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, size): the files under ``root`` at any depth that aren't empty or hidden, the path as it is, not encoded.

    Tasks list the folders, a level at a time, and store what they find: no list of files comes to the driver, where Spark's
    own readers would keep one.
    """
    path, level = new_table_path(spark, "listing"), 0
    folders = spark.createDataFrame([(root,)], "file string")
    while True:
        folders.mapInPandas(_listed, _LISTED).write.parquet(f"{path}/{level}")
        folders = spark.read.schema(_LISTED).parquet(f"{path}/{level}").where("folder").select("file")
        level, n = level + 1, folders.count()
        if not n:
            break
        folders = dealt(folders, n, "file")
    found = spark.read.schema(_LISTED).parquet(*[f"{path}/{i}" for i in range(level)])
    return found.where("NOT folder AND size > 0").select("file", "size")
