"""Rounds that cost: each is stored under a named folder and noted in a manifest, so that a loop which crashed goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from quizforge.sources.tables import new_table_path

MANIFEST = "name string, rows long"


class Rounds:
    """Results of named rounds under ``folder``; without one, a folder of its own that no later run finds.

    A round is in the manifest only after all of its rows are written. What a crash left of a round that isn't there is
    written over. One loop at a time may use a folder.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, kind: str = "rounds") -> None:
        self.spark, self.folder = spark, (folder or new_table_path(spark, kind)).rstrip("/")

    def done(self) -> dict[str, int]:
        """Names of the rounds that are complete, with their rows."""
        try:
            return {r.name: r.rows for r in self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest").collect()}  # one row a round
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}

    def get(self, name: str, work: Callable[[], DataFrame]) -> DataFrame:
        """The stored rows of the round; ``work`` is asked for them only if the round isn't complete."""
        path = f"{self.folder}/{name}"
        if name not in self.done():
            work().write.mode("overwrite").parquet(path)
            rows = self.spark.read.parquet(path).count()
            self.spark.createDataFrame([(name, rows)], MANIFEST).coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
        return self.spark.read.parquet(path)
