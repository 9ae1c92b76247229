"""Keys, paths and labels of question items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
LABELS = ("chart", "illustration", "Photograph", "Structure")
SUBJECTS = ("biology", "chemistry", "geography", "materials", "math", "physics")
DATASET_SUBJECT = {"EMMA": "chemistry", "GEOBench-VLM": "geography", "MatCha": "materials", "MicroVQA": "biology"}
ACTION_IMAGE_TYPE = {"V1": "chart", "V2": "illustration", "V3": "photograph", "V4": "structure"}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def norm_id(value: Column) -> Column:
    """A VARIANT id that is a whole number or text, as text; anything else is null."""
    kind = F.schema_of_variant(value)
    return F.when(kind.isin("BIGINT", "STRING"), F.try_variant_get(value, "$", "string"))


def norm_output_id(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def to_original_path(path: Column) -> Column:
    return F.regexp_replace(path, "^image/", "original_image/")


def to_modified_path(path: Column) -> Column:
    return F.regexp_replace(path, "^(image|original_image)/", "modified_image/")


def image_key(path: Column) -> Column:
    """Trimmed, with slashes forward and a leading ``image/`` (or its original or modified form) taken off."""
    return F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "^(image|original_image|modified_image)/", "")


def dataset_of(path: Column) -> Column:
    parts = F.filter(F.split(image_key(path), "/"), lambda p: p != "")
    two = F.concat_ws("/", F.get(parts, 0), F.get(parts, 1))
    return F.when(F.size(parts) == 0, "root").when((F.get(parts, 0) == "MMMU") & (F.size(parts) >= 2), two).otherwise(F.get(parts, 0))


def subject_of(path: Column) -> Column:
    parts = F.filter(F.split(image_key(path), "/"), lambda p: p != "")
    second = F.lower(F.get(parts, 1))
    named = F.when(second.isin(*SUBJECTS), second)
    known = literal_map(DATASET_SUBJECT)[F.get(parts, 0)]
    return F.coalesce(F.when((F.get(parts, 0) == "MMMU") & (F.size(parts) >= 2), named).otherwise(known), F.lit("UNKNOWN"))


def field_of(dataset: Column, subject: Column, given: Column) -> Column:
    return F.coalesce(given, literal_map(DATASET_SUBJECT)[dataset], subject)


def model_slug(model: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(model, "/"), -1), "[^A-Za-z0-9._-]", "_")


def label_state(label: Column) -> Column:
    """valid, error or invalid; labels are case-sensitive."""
    return F.when(label.isin(*LABELS), "valid").when(label.startswith("ERROR:"), "error").otherwise("invalid")


def image_kind(label: Column) -> Column:
    plain = F.lower(F.trim(label))
    return F.when(plain.isin("photo", "photograph"), "photograph").when(plain == "illustration", "illustration")


def output_paths(image_rel: Column, output_root: Column, temp_root: Column) -> Column:
    """struct<generated, modified, edited>: where a chart drawn anew, its modified version, and an edited image go."""
    forward = F.replace(image_rel, F.lit("\\"), F.lit("/"))
    bare = F.regexp_replace(forward, r"(?<=[^/])\.[^./]+$", "")
    return F.struct(
        F.concat_ws("/", temp_root, F.lit("temp_image"), F.concat(bare, F.lit("_generated.png"))).alias("generated"),
        F.concat_ws("/", output_root, F.concat(F.regexp_replace(bare, "^image/", ""), F.lit(".png"))).alias("modified"),
        F.concat_ws("/", output_root, image_rel).alias("edited"),
    )
