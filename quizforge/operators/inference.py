"""Model scoring as tables: requests, pending work, scoring by a caller's function, merging, judge rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizforge.functions.keys import norm_output_id
from quizforge.functions.text import result_ok
from quizforge.operators.dedup import keep_last
from quizforge.operators.scoring import Limits, infer

__all__ = ["Limits", "infer"]

RUN = ["model", "dataset", "action", "run_tag"]


def inference_ready(items: DataFrame) -> DataFrame:
    """Items with a query, which may be empty, a target and an image."""
    return items.where(F.col("query").isNotNull() & F.col("target").isNotNull() & (F.size("image_path") > 0))


def eval_ready(items: DataFrame) -> DataFrame:
    """Items with the ``reason`` they can't be evaluated for, null if they can."""
    reason = F.when(F.col("query").isNull(), "no_query").when(F.col("target").isNull(), "no_target").when(F.coalesce(F.size("image_path"), F.lit(0)) <= 0, "no_image")
    return items.withColumn("reason", reason)


def select_tasks(df: DataFrame, column: str, names: list[str] | str) -> tuple[DataFrame, DataFrame]:
    """The rows of the named values (``all``: every one), and the names that no row has."""
    if names == "all":
        return df, df.select(column).limit(0)
    asked = df.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")
    return df.where(F.col(column).isin(*names)), asked.join(df.select(column).distinct(), column, "left_anti")


def task_plan(datasets: DataFrame, actions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every (dataset, action) with whether its input exists; both sides are short lists of names."""
    plan = datasets.select("dataset").distinct().crossJoin(actions.select("action").distinct())
    return plan.join(catalog.select("dataset", "action").distinct().withColumn("found", F.lit(True)), ["dataset", "action"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def build_requests(items: DataFrame, action: str, instruction: str) -> DataFrame:
    """Items with ``request_id`` and ``prompt``."""
    key = F.sha2(F.concat_ws("\x1f", F.lit(action), "dataset", "id", "query"), 256)
    return items.withColumn("request_id", key).withColumn("prompt", F.concat_ws("\n\n", F.lit(instruction), "query"))


def decode_params(temperature: Column, top_p: Column) -> Column:
    """Greedy: temperature 0 and no top_p; else top_p alone."""
    return F.struct(F.when(temperature == 0, temperature).alias("temperature"), F.when(temperature != 0, top_p).alias("top_p"))


def ok_outputs(outputs: DataFrame) -> DataFrame:
    return outputs.where(result_ok(F.col("status"), F.col("output")))


def last_results(outputs: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """(keys, done): whether the last result of each key is a good one; outputs without an id drop. Texts don't travel."""
    own = outputs.where(norm_output_id(F.col("id")) != "").select(*keys, result_ok(F.col("status"), F.col("output")).alias("done"), order.alias("_at"))
    return own.groupBy(*keys).agg(F.max_by("done", "_at").alias("done"))


def resume_pending(items: DataFrame, outputs: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Items whose last result is missing or bad: a newer error hides an older good output."""
    done = last_results(outputs, keys, order).where("done").select(*keys)
    return items.join(done, keys, "left_anti")


def merge_outputs(items: DataFrame, old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row an item: the last new output over the last old one, by ``order``; no output gives an error row; orphans drop."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1))).where(norm_output_id(F.col("id")) != "")
    last = keep_last(both.select(*keys, "output", "status", F.struct("_age", order.alias("_at")).alias("_place")), keys, F.col("_place")).drop("_place")
    merged = items.join(last, keys, "left")
    return merged.withColumn("status", F.coalesce("status", F.lit("error"))).withColumn("output", F.coalesce("output", F.lit("[ERROR] missing result after resume")))


def resume_text(items: DataFrame, old: DataFrame) -> DataFrame:
    """Items of each file to run again: those that failed, or all where the old results' number differs."""
    sizes = items.groupBy("source_file").agg(F.count("*").alias("_n"))
    olds = old.groupBy("source_file").agg(F.count("*").alias("_m"))
    same = sizes.join(olds, "source_file", "left").select("source_file", (F.col("_n") == F.coalesce("_m", F.lit(-1))).alias("_same"))
    state = old.select("source_file", "pos", F.col("verify_passed").alias("_passed"), F.lit(True).alias("_old"))
    joined = items.join(same, "source_file").join(state, ["source_file", "pos"], "left")
    return joined.where(~F.col("_same") | F.col("_old").isNull() | (F.col("_passed") == F.lit(False))).drop("_same", "_passed", "_old")


def judge_rows(outputs: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """index, question, answer, prediction with the run's columns."""
    answers = items.select(*keys, F.col("query").alias("_question"), F.col("target").alias("_answer"))
    run = [c for c in RUN if c in outputs.columns]
    return outputs.join(answers, keys).select(*run, F.col("id").alias("index"), F.col("_question").alias("question"), F.col("_answer").alias("answer"), F.coalesce("output", F.lit("")).alias("prediction"))


def fan_out(df: DataFrame, run_tags: list[str]) -> DataFrame:
    return df.withColumn("run_tag", F.explode(F.array(*[F.lit(t) for t in run_tags])))


def only_missing(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(existing.select(*keys).distinct(), keys, "left_anti")


def pair_check(check: Callable[[str, str, str], bool]) -> Callable[[Column, Column, Column], Column]:
    """A caller's equivalence check over (kind, a, b) as a column function."""

    @F.pandas_udf("boolean")
    def run(kind: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bool(check(k, x, y)) for k, x, y in zip(kind, a, b, strict=True)])

    return run
