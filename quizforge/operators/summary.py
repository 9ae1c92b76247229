"""Counts over variants; verification has three states and null counts as not applicable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).cast("long")


def variant_summary(df: DataFrame, grand: bool = False) -> DataFrame:
    """total, changed, unchanged, verify_passed, verify_failed, verify_not_applicable by dataset, subject, action."""
    keys = ["dataset", "subject", "action"]
    grouped = df.rollup(*keys) if grand else df.groupBy(*keys)
    verified = F.col("verify_passed")
    changed = F.col("modified_query") != F.col("original_query")
    out = grouped.agg(
        F.count("*").alias("total"),
        _n(changed).alias("changed"),
        (F.count("*") - _n(changed)).alias("unchanged"),
        _n(verified).alias("verify_passed"),
        _n(~verified).alias("verify_failed"),
        _n(verified.isNull()).alias("verify_not_applicable"),
        *([F.grouping_id().cast("long").alias("level")] if grand else []),
    )
    return out.where(F.col("level").isin(0, 7)) if grand else out


def chart_stats(df: DataFrame) -> DataFrame:
    """Counters over the ``state`` of chart tasks."""
    state = F.col("state")
    return df.agg(
        F.count("*").alias("total_items"),
        _n(state != "skipped_class").alias("class_matched"),
        _n(state == "processed").alias("processed"),
        _n(state == "skipped_class").alias("skipped_class"),
        _n(state == "skipped_missing_image").alias("skipped_missing_image"),
        _n(state == "failed").alias("failed"),
    )


def round_summary(df: DataFrame) -> DataFrame:
    """total, ok, failed, passed, rejected, retryable and final by round."""
    return df.groupBy("round_idx").agg(
        F.count("*").alias("total"),
        _n(F.col("ok")).alias("ok"),
        _n(~F.col("ok")).alias("failed"),
        _n(F.col("state") == "passed").alias("passed"),
        _n(F.col("state") == "retry").alias("retryable"),
        _n(F.col("state") == "cannot_modify").alias("final"),
    )


def output_summary(df: DataFrame) -> DataFrame:
    """results, ok and error by file and overall (file null); the status alone decides."""
    return df.rollup("source_file").agg(F.count("*").alias("results"), _n(F.col("status") == "ok").alias("ok"), _n(F.col("status") != "ok").alias("error"), F.grouping("source_file").cast("int").alias("overall"))


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(reason).agg(F.count("*").alias("n"))


def drop_report(df: DataFrame, *keys: str) -> DataFrame:
    """converted, skipped and reasons (how many rows each took) by the keys; a null ``reason`` is a converted row."""
    each = df.groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    skipped = F.col("reason").isNotNull()
    listed = F.array_sort(F.collect_list(F.when(skipped, F.struct("reason", "n"))))  # one entry a reason
    return each.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(~skipped, F.col("n"))), F.lit(0)).alias("converted"), F.coalesce(F.sum(F.when(skipped, F.col("n"))), F.lit(0)).alias("skipped"), listed.alias("reasons")
    )


def written_with_report(df: DataFrame, reasons: tuple[str, ...], write: Callable[[DataFrame], None]) -> DataFrame:
    """One row (converted, a count a reason): counted by ``write`` itself as it passes over the rows, not by a second run.

    ``write`` gets the rows without a ``reason`` and must write them once. Rows of a task that runs again count once.
    """
    seen = Observation()
    counts = [F.count_if(F.col("reason").isNull()).alias("converted"), *[F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(r) for r in reasons]]
    write(df.observe(seen, *counts).where(F.col("reason").isNull()).drop("reason"))
    got = seen.get
    names = ["converted", *reasons]
    return df.sparkSession.createDataFrame([tuple(int(got[n]) for n in names)], ", ".join(f"{n} long" for n in names))
