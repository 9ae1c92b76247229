"""Image variants: task selection, chart attempts, edit rounds with retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizforge.functions import text as X
from quizforge.functions.keys import image_key, image_kind
from quizforge.operators.dedup import keep_last
from quizforge.sources.rounds import Rounds

PASS_SCORE, MAX_ATTEMPTS, MAX_RETRIES = 90, 3, 2


def _keyed_labels(labels: DataFrame) -> DataFrame:
    own = labels.select(image_key(F.col("image_key")).alias("_key"), F.col("label").alias("_label"))
    return keep_last(own, ["_key"], F.col("_label"))


def select_chart_tasks(items: DataFrame, labels: DataFrame, manifest: DataFrame, label: str = "chart") -> DataFrame:
    """Items with ``state``: task, skipped_class or skipped_missing_image."""
    keyed = items.withColumn("_key", image_key(F.get("image_path", 0)))
    there = manifest.select(image_key(F.col("path")).alias("_key")).distinct().withColumn("_there", F.lit(True))
    joined = keyed.join(_keyed_labels(labels), "_key", "left").join(there, "_key", "left")
    same = F.coalesce(F.lower(F.trim("_label")) == label, F.lit(False))
    state = F.when(~same, "skipped_class").when(F.col("_there").isNull(), "skipped_missing_image").otherwise("task")
    return joined.withColumn("state", state).drop("_key", "_label", "_there")


def select_image_tasks(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Items with ``image_type`` and ``reason``: no_image, no_label, other_type or selected, in check order."""
    keyed = items.withColumn("_key", image_key(F.get("image_path", 0)))
    joined = keyed.join(_keyed_labels(labels), "_key", "left").withColumn("image_type", image_kind(F.col("_label")))
    reason = F.when(F.col("_key").isNull(), "no_image").when(F.col("_label").isNull(), "no_label").when(F.col("image_type").isNull(), "other_type").otherwise("selected")
    return joined.withColumn("reason", reason).drop("_key", "_label")


def edit_prompt(plan: Column, kind: Column) -> Column:
    edits = F.array_join(F.transform(plan, lambda e: F.concat(F.lit('write "'), e["text"], F.lit('" at '), e["position"])), "; ")
    tone = F.when(kind == "photograph", "Keep it a natural photograph.").otherwise("Keep the style of the drawing.")
    return F.concat_ws(" ", F.lit("Edit the image:"), F.concat(edits, F.lit(".")), tone)


def best_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The first attempt that passes, else the last; ``retry_times`` is its number less one.

    ``score`` is that of the last attempt up to it that rendered; one that didn't render keeps the score before it.
    """
    scored = attempts.where(F.col("attempt") <= MAX_ATTEMPTS).withColumn("score", X.parse_score(F.col("raw_evaluation")))
    rendered = F.coalesce("render_ok", F.lit(False))
    row = F.struct(*[c for c in scored.columns if c not in (*keys, "score")])
    good = rendered & (F.col("score") >= PASS_SCORE)
    # One row a key and side; min_by and max_by skip rows whose order is null, and a struct carries a null score.
    best = scored.groupBy(*keys).agg(
        F.min_by(F.struct(row.alias("row"), "score"), F.when(good, F.col("attempt"))).alias("_first"), F.max_by(row, F.col("attempt")).alias("_last"),
        F.max_by(F.struct("score"), F.when(rendered, F.col("attempt"))).alias("_scored"),
    )
    success = F.col("_first").isNotNull()
    chosen = best.select(*keys, F.coalesce("_first.row", "_last").alias("_row"), F.when(success, F.col("_first.score")).otherwise(F.col("_scored.score")).alias("score"), success.alias("success"))
    return chosen.select(*keys, "_row.*", "score", "success").withColumn("retry_times", F.col("attempt") - 1)


def run_chart_attempts(tasks: DataFrame, keys: list[str], attempt: Callable[[DataFrame, int], DataFrame], folder: str | None = None) -> DataFrame:
    """Run ``attempt`` (draw, render, evaluate: render_ok, raw_evaluation) on what has not passed, then ``best_attempt``.

    Every attempt is stored before use, as it costs; with a ``folder`` a call after a crash goes on at the first attempt that
    isn't complete.
    """
    left, every, rounds = tasks, None, Rounds(tasks.sparkSession, folder, "attempts")
    for n in range(1, MAX_ATTEMPTS + 1):
        done = rounds.get(f"attempt{n}", lambda: attempt(left, n).withColumn("attempt", F.lit(n)))  # noqa: B023 - called at once
        every = done if every is None else every.unionByName(done)
        passed = F.coalesce(F.col("render_ok") & (X.parse_score(F.col("raw_evaluation")) >= PASS_SCORE), F.lit(False))
        left = done.where(~passed).select(*tasks.columns)
        if n == MAX_ATTEMPTS or left.isEmpty():
            break
    return best_attempt(every, keys)


def split_round(df: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """``state`` of a verified round: passed, retry or cannot_modify; every failure, the last one too, adds to ``retry_times``."""
    passed = F.coalesce(F.col("ok"), F.lit(False)) & X.verdict_passes(F.col("judge_answer"))
    state = F.when(passed, "passed").when(F.col("retry_times") < max_retries, "retry").otherwise("cannot_modify")
    return df.withColumn("verified_passed", passed).withColumn("verify_fail", ~passed).withColumn("state", state).withColumn("retry_times", F.when(passed, F.col("retry_times")).otherwise(F.col("retry_times") + 1))


def run_rounds(df: DataFrame, step: Callable[[DataFrame, int], DataFrame], max_rounds: int = 3, folder: str | None = None) -> DataFrame:
    """Run ``step`` (propose, edit, verify) on what is left, round by round.

    Every round is stored before use; with a ``folder`` a call after a crash goes on at the first round that isn't complete.
    """
    left, out, rounds = df, None, Rounds(df.sparkSession, folder)
    for n in range(max_rounds):
        done = rounds.get(f"round{n}", lambda: split_round(step(left, n).withColumn("round_idx", F.lit(n))))  # noqa: B023 - called at once
        last = n == max_rounds - 1
        settled = done if last else done.where(F.col("state") != "retry")
        out = settled if out is None else out.unionByName(settled)
        left = done.where(F.col("state") == "retry").select(*df.columns)
        if last or left.isEmpty():
            break
    return out.withColumn("state", F.when(F.col("state") == "retry", "cannot_modify").otherwise(F.col("state")))
