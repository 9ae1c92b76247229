"""Evaluation tables as tab-separated files: one for each set and run, in item order, with the bytes that a CSV writer gives."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quizforge.sources.files import filesystem

_FILE = "_file"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (temporary path, final name) of each file."""

    files: list[tuple[str, str]]


class EvalTsvWriter(DataSourceArrowWriter):
    """Tasks write under temporary names; the commit gives files their own names, an abort leaves none behind."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names = path.rstrip("/"), [n for n in schema.names if n != _FILE]
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        own, base = filesystem(self.staging)
        own.create_dir(base, recursive=True)
        files: list[tuple[str, str]] = []
        out, name = None, None
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (_FILE, *self.names)]
            for file, *row in zip(*columns, strict=True):
                if file != name:
                    out = self._next(own, base, out, file, files)
                    name = file
                out.write(self._line(row))
        if out:
            out.close()
        return Written(files)

    def _next(self, own, base: str, out, file: str, files: list[tuple[str, str]]):
        if out:
            out.close()
        at = f"{base}/{uuid.uuid4().hex}"
        files.append((at, file))
        out = own.open_output_stream(at)
        out.write(self._line(self.names))
        return out

    @staticmethod
    def _line(row: list) -> bytes:
        line = io.StringIO(newline="")
        csv.writer(line, delimiter="\t", quoting=csv.QUOTE_MINIMAL).writerow(["" if v is None else v for v in row])
        return line.getvalue().encode()

    def commit(self, messages: list[Written | None]) -> None:
        own, base = filesystem(self.path)
        for message in messages:
            for at, name in message.files if message else ():
                final = f"{base}/{name}"
                own.create_dir(final.rsplit("/", 1)[0], recursive=True)
                if own.get_file_info(final).type.name != "NotFound":  # a move onto a file fails in some stores
                    own.delete_file(final)
                own.move(at, final)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        own, base = filesystem(self.staging)
        if own.get_file_info(base).type.name != "NotFound":
            own.delete_dir(base)


class EvalTsv(DataSource):
    """Write-only format ``eval_tsv``; the column ``_file`` says where a row goes, and rows of one file follow each other in a task."""

    @classmethod
    def name(cls) -> str:
        return "eval_tsv"

    def writer(self, schema: StructType, overwrite: bool) -> EvalTsvWriter:
        return EvalTsvWriter(self.options["path"], schema)


def write_eval_tsv(df: DataFrame, path: str, name: str = "dataset", tag: str = "run_tag", order: str = "pos", rows_per_file: int | None = None) -> None:
    """``<name>__<tag>.tsv`` for each set and run, rows in the order of ``order``; the other columns are the file's.

    With ``rows_per_file`` the rows of places from n times that on go to ``<name>__<tag>.part<n>.tsv``, so that a very large set
    isn't one task's work. A file that is there is replaced; others stay.
    """
    part = F.floor(F.col(order) / rows_per_file) if rows_per_file else F.lit(0)
    file = F.concat(F.col(name), F.lit("__"), F.col(tag), F.when(part > 0, F.concat(F.lit(".part"), part.cast("string"))).otherwise(F.lit("")), F.lit(".tsv"))
    rows = df.withColumn(_FILE, file).repartition(_FILE).sortWithinPartitions(_FILE, order)
    df.sparkSession.dataSource.register(EvalTsv)
    rows.select(_FILE, *[c for c in df.columns if c not in (name, tag, order)]).write.format("eval_tsv").mode("append").save(path)
