"""Image classification: pending work, retries, and the subject by label matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizforge.functions.keys import LABELS, SUBJECTS, dataset_of, image_key, label_state, subject_of


def pending(keys: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Keys with no result; an error is a result."""
    return keys.join(done.select(*on), on, "left_anti")


def retry_errors(keys: DataFrame, done: DataFrame, on: list[str], label: str = "label") -> DataFrame:
    return keys.join(done.where(F.col(label).startswith("ERROR:")).select(*on), on, "left_semi")


def class_matrix(labels: DataFrame) -> DataFrame:
    """subject, a count for each label, invalid labels, total; every known subject, and ALL."""
    known = labels.withColumn("subject", subject_of(F.col("image_key"))).withColumn("state", label_state(F.col("label")))
    subjects = labels.sparkSession.createDataFrame([(s,) for s in SUBJECTS], "subject string")
    counted = known.where(F.col("subject") != "UNKNOWN").groupBy("subject").agg(
        *[F.count_if(F.col("label") == x).alias(x) for x in LABELS], F.count_if(F.col("state") != "valid").alias("invalid")
    )
    names = [*LABELS, "invalid"]
    full = subjects.join(counted, "subject", "left").select("subject", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    total = full.agg(*[F.sum(n).alias(n) for n in names]).select(F.lit("ALL").alias("subject"), *names)
    added = sum((F.col(x) for x in LABELS[1:]), F.col(LABELS[0]))
    return full.unionByName(total).withColumn("total", added)


def classified_layout(labels: DataFrame) -> DataFrame:
    """Where each classified image goes: label/dataset/path."""
    key = image_key(F.col("image_key"))
    valid = labels.where(label_state(F.col("label")) == "valid")
    return valid.select(key.alias("image_key"), "label", dataset_of(F.col("image_key")).alias("dataset"), F.concat_ws("/", F.col("label"), key).alias("target_path"))
