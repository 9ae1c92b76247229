"""Keep-last, keep-first, order and shards; order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizforge.sources.tables import new_table_path


def _pick(df: DataFrame, keys: list[str], order: Column, chooser) -> DataFrame:
    # max_by and min_by aggregate before the shuffle, so repeated keys collapse where they are read. Keys stay columns of their
    # own: a table that is bucketed by them keeps its partitioning.
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    own = df.withColumn("_order", order).groupBy(*keys).agg(chooser(F.struct(*rest), F.col("_order")).alias("_row"))
    return own.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def keep_last(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the largest ``order`` of each key."""
    return _pick(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def distinct_keys(df: DataFrame, paths: str, order: str) -> DataFrame:
    """(image_key, first_pos): each image once, at its first place."""
    return df.select(F.explode(paths).alias("image_key"), F.col(order).alias("_at")).groupBy("image_key").agg(F.min("_at").alias("first_pos"))


def with_index(df: DataFrame, pos: str, id_column: str = "id") -> DataFrame:
    """The id, or the 1-based place where there is none."""
    return df.withColumn(id_column, F.coalesce(F.col(id_column), (F.col(pos) + 1).cast("string")))


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy("dataset", F.col("id").cast("string"), "image_path_rel")


def limit_records(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    return df.orderBy(pos).limit(n) if n else df


def assign_shards(df: DataFrame, index: str, shards: int, base_seed: int) -> DataFrame:
    """Round-robin shards; the seed is base + shard * 100000 + place in the shard."""
    shard = F.pmod(F.col(index), F.lit(shards))
    return df.withColumn("shard", shard.cast("int")).withColumn("seed", (base_seed + shard * 100_000 + F.floor(F.col(index) / shards)).cast("long"))


def dense_index(df: DataFrame, order: list[Column], name: str = "index", start: int = 0) -> DataFrame:
    """Rows with consecutive numbers from ``start`` in the order of ``order``; ties are numbered as they are read.

    A distributed sort is stored with each row's partition and its place there; a row's number is its place and
    the rows of the partitions before its own. The only window is over one row a partition. ``df`` must be readable twice
    with the same result (a scan or a stored table), as the sort samples it first.
    """
    place, part, tie = (f"{'_' * max(map(len, df.columns))}{n}" for n in ("place", "part", "tie"))  # no column has these names
    # The tie keeps a hot value from going to one partition whole.
    sorted_rows = df.withColumn(tie, F.monotonically_increasing_id()).orderBy(*order, tie).drop(tie).withColumn(place, F.monotonically_increasing_id())
    path = new_table_path(df.sparkSession, "sorted")
    sorted_rows.write.parquet(path)
    rows = df.sparkSession.read.schema(sorted_rows.schema).parquet(path).withColumn(part, F.shiftright(place, 33))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(part).agg(F.count("*").alias(name)).select(part, F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name))
    return rows.join(F.broadcast(offsets), part).select(*[f"`{c}`" for c in df.columns], (F.col(name) + F.col(place).bitwiseAND((1 << 33) - 1) + start).alias(name))
