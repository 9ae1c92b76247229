"""Replacements that depend on order: each works on what the ones before it left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.instr(text, old)
    return F.when((old != "") & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def apply_replacements(text: Column, edits: Column) -> Column:
    """struct<text, applied array<boolean>>: each ``old`` of ``edits`` (old, new) replaced once, in turn."""
    start = F.struct(text.alias("text"), F.array().cast("array<boolean>").alias("applied"))
    return F.aggregate(
        edits,
        start,
        lambda s, e: F.struct(
            _replace_first(s["text"], e["old"], e["new"]).alias("text"),
            F.concat(s["applied"], F.array((e["old"] != "") & (F.instr(s["text"], e["old"]) > 0))).alias("applied"),
        ),
    )


def clean_equiv_items(items: Column, query: Column) -> Column:
    """Items (kind, original, placeholder) whose trimmed original the query has; unknown kinds are math, placeholders ``{{PHn}}``."""
    named = r"^\{(?:\{PH([0-9]+)\}|PH([0-9]+))\}$"
    number = lambda p: F.concat(F.regexp_extract(F.trim(p), named, 1), F.regexp_extract(F.trim(p), named, 2))
    kind = lambda x: F.lower(F.coalesce(x["kind"], F.lit("math")))
    listed = F.transform(
        items,
        lambda x, i: F.struct(
            F.when(kind(x).isin("unit", "math", "chem"), kind(x)).otherwise("math").alias("kind"),
            F.trim(F.coalesce(x["original"], F.lit(""))).alias("original"),
            F.concat(F.lit("{{PH"), F.coalesce(F.nullif(number(x["placeholder"]), F.lit("")), i.cast("string")), F.lit("}}")).alias("placeholder"),
        ),
    )
    return F.filter(listed, lambda x: (x["original"] != "") & query.contains(x["original"]))


def template_query(query: Column, items: Column) -> Column:
    """The query with the first occurrence of each original, in turn, as its placeholder."""
    edits = F.transform(items, lambda x: F.struct(x["original"].alias("old"), x["placeholder"].alias("new")))
    return apply_replacements(query, edits)["text"]


def align_transformed(originals: Column, transformed: Column) -> Column:
    """As many texts as originals: what is missing or blank stays the original."""
    return F.transform(originals, lambda x, i: F.coalesce(F.nullif(F.trim(F.get(transformed, i)), F.lit("")), x))
