"""Generation sets and composites: joins on (dataset, field, id); ids repeat across datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizforge.functions.keys import ACTION_IMAGE_TYPE, image_key, to_modified_path, to_original_path
from quizforge.functions.text import combine_t2t4
from quizforge.operators.dedup import keep_last

KEY = ["dataset", "field", "id"]


def convert_original(items: DataFrame, default_field: str = "Chemistry") -> DataFrame:
    """Items as generation rows: original paths, a field, the target as text."""
    return items.select(
        "dataset", F.coalesce("field", F.lit(default_field)).alias("field"), F.lit("original").alias("level"), "id", "query",
        F.col("target").cast("string").alias("target"), F.transform("image_path", to_original_path).alias("image_path"),
    )


def text_qa_reason(variants: DataFrame) -> DataFrame:
    """Variants with the ``reason`` they are skipped for, null if they are taken; a null verification is no pass."""
    text = F.col("modified_query").isNotNull() & F.col("modified_answer").isNotNull()
    reason = F.when(~F.coalesce("verify_passed", F.lit(False)), "verify_failed").when(F.col("id").isNull(), "no_id").when(~text, "no_text")
    return variants.withColumn("reason", reason)


def verified(variants: DataFrame) -> DataFrame:
    """Variants that verification passed, with id, text and answer."""
    return text_qa_reason(variants).where(F.col("reason").isNull()).drop("reason")


def build_text_qa(variants: DataFrame, originals: DataFrame) -> DataFrame:
    """Verified text variants, the last of each id, with the images of its last original that has any list of them (else empty)."""
    own = verified(variants).select(*KEY, "action", "modified_query", "modified_answer", "pos")
    last = keep_last(own, [*KEY, "action"], F.col("pos"))
    images = keep_last(originals.where(F.col("image_path").isNotNull()).select(*KEY, "image_path", "pos"), KEY, F.col("pos")).select(*KEY, "image_path")
    joined = last.join(images, KEY, "left")
    return joined.select(
        *KEY, F.col("action").alias("level"), F.col("modified_query").alias("query"), F.col("modified_answer").alias("target"),
        F.coalesce(F.transform("image_path", to_original_path), F.array().cast("array<string>")).alias("image_path"),
    )


def missing_image_ids(text_qa: DataFrame, n: int = 20) -> DataFrame:
    return text_qa.where(F.size("image_path") == 0).select("id").distinct().orderBy("id").limit(n)


def image_qa_reason(originals: DataFrame, labels: DataFrame, manifest: DataFrame, action: str) -> DataFrame:
    """Originals with ``modified_path`` and the ``reason`` they are skipped for, in check order; null if they are taken."""
    kinds = keep_last(labels.select(image_key(F.col("image_key")).alias("_key"), F.lower(F.trim("label")).alias("_kind")), ["_key"], F.col("_kind"))
    keyed = originals.withColumn("_key", image_key(F.get("image_path", 0))).withColumn("modified_path", to_modified_path(F.get("image_path", 0)))
    there = manifest.select(F.col("path").alias("modified_path"), F.lit(True).alias("_there")).distinct()
    joined = keyed.join(kinds, "_key", "left").join(there, "modified_path", "left")
    reason = (
        F.when(F.col("id").isNull() | F.col("query").isNull() | F.col("target").isNull(), "no_text").when(F.coalesce(F.size("image_path"), F.lit(0)) <= 0, "no_image")
        .when(F.col("_kind").isNull(), "no_label").when(F.col("_kind") != ACTION_IMAGE_TYPE[action], "other_type").when(F.col("_there").isNull(), "missing_image")
    )
    return joined.withColumn("reason", reason).drop("_key", "_kind", "_there")


def build_image_qa(originals: DataFrame, labels: DataFrame, manifest: DataFrame, action: str) -> DataFrame:
    """Originals whose first image has the action's type and a modified image that exists; that image alone goes along."""
    taken = image_qa_reason(originals, labels, manifest, action).where(F.col("reason").isNull())
    return taken.select(*KEY, F.lit(action).alias("level"), "query", "target", F.array("modified_path").alias("image_path"))


def _place(df: DataFrame) -> Column:
    """What says which row of an id is the last: its place, or its images where there is none."""
    return F.col("pos") if "pos" in df.columns else F.to_json(F.struct("image_path", "target"))


def _with_text(df: DataFrame) -> DataFrame:
    return df.where(F.col("query").isNotNull() & F.col("target").isNotNull())


def compose_tv(text: DataFrame, image: DataFrame) -> DataFrame:
    """Text ∩ image: query and target of the text, images of the last image variant; a known target that differs is flagged."""
    own = image.select(*KEY, F.col("level").alias("_level"), F.col("target").alias("_target"), F.col("image_path").alias("_images"), _place(image).alias("_at"))
    v = keep_last(own, [*KEY, "_level"], F.col("_at"))
    images = F.coalesce(F.col("_images"), F.array().cast("array<string>"))
    joined = _with_text(text).join(v, KEY)
    return joined.select(*KEY, F.concat("level", "_level").alias("level"), "query", "target", images.alias("image_path"), F.coalesce(F.col("_target") != F.col("target"), F.lit(False)).alias("target_mismatch"))


def compose_t2t4(t2: DataFrame, t4: DataFrame) -> DataFrame:
    """T2's stem with the options of the last T4 of the id; target of T4, images of T2; rows without text are skipped."""
    last = keep_last(t4.select(*KEY, F.col("query").alias("_query"), F.col("target").alias("_target"), _place(t4).alias("_at")), KEY, F.col("_at"))
    joined = t2.where(F.col("query").isNotNull()).join(last.where(F.col("_query").isNotNull() & F.col("_target").isNotNull()), KEY)
    images = F.coalesce("image_path", F.array().cast("array<string>"))
    return joined.select(*KEY, F.lit("T2T4").alias("level"), combine_t2t4(F.col("query"), F.col("_query")).alias("query"), F.col("_target").alias("target"), images.alias("image_path"))


def composite_stats(composites: DataFrame) -> DataFrame:
    return composites.groupBy("level").agg(F.count("*").alias("n"), F.count_if("target_mismatch").alias("target_mismatch"), F.count_if(F.size("image_path") == 0).alias("missing_image"))


def shared_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).intersect(b.select(*KEY))


def union_variants(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
