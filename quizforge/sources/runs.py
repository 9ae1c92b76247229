"""Stored results of runs: one table, partitioned by run, of which an update touches only the runs that it has rows for."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quizforge.functions.keys import norm_output_id
from quizforge.operators.dedup import keep_last
from quizforge.operators.inference import RUN, resume_pending
from quizforge.sources.tables import new_table_path, replace_partitions

#: So many runs (model, dataset, action, run_tag) at most are named in filters, which prune partitions while the query is
#: planned; with more of them a semi-join with their names prunes them while it runs.
MAX_NAMED_RUNS = 1000


def read_runs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored results; none if nothing was stored at ``path`` yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def only_runs_of(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``table`` whose run has rows in ``rows``; files of other runs aren't read. A null is a name like others."""
    runs = rows.select(*[F.col(c).alias(f"_{c}") for c in RUN]).distinct()
    named = runs.limit(MAX_NAMED_RUNS + 1).collect()
    if len(named) <= MAX_NAMED_RUNS:
        for c in RUN:
            values = {r[f"_{c}"] for r in named}
            known = F.col(c).isin(*(values - {None}))
            table = table.where(known | F.col(c).isNull() if None in values else known)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in RUN]
    return table.join(F.broadcast(runs), same, "left_semi")  # names of runs only


def upsert(new: DataFrame, path: str, keys: list[str], order: Column) -> None:
    """Add results to the table at ``path``: of each key, run included, the row that is last by ``order`` stays.

    The changed runs are merged into a table of their own first, and then take the place of the old ones; files of other
    runs are neither read nor written. After a crash the same call gives the same table. Rows without an id drop.
    """
    spark = new.sparkSession
    own = new.where(norm_output_id(F.col("id")) != "")
    old = only_runs_of(read_runs(spark, path, own.schema), own)
    merged = keep_last(old.unionByName(own), list(dict.fromkeys([*RUN, *keys])), order)
    staged = new_table_path(spark, "changed_runs")
    merged.write.parquet(staged)
    replace_partitions(spark.read.schema(merged.schema).parquet(staged), path, *RUN)


def pending(items: DataFrame, path: str, schema: StructType, keys: list[str], order: Column) -> DataFrame:
    """Items, with their run, that still lack a good last result in the table at ``path``; only their runs are read."""
    return resume_pending(items, only_runs_of(read_runs(items.sparkSession, path, schema), items), keys, order)
