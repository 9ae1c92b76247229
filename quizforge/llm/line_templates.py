"""Line dedup by a log-template tree, in DataFrame functions only.

Every line is parsed at a fixed depth: its token count, then its leading tokens, lead to a leaf. Tokens with a
digit are variable fields. In a leaf the rest of a line is cut into segments, and a template is the line with
at most one segment generalised, so lines that differ in one field share a template. A template in at least
``min_docs`` documents recurs; of its lines the first one (smallest doc_id, then position) stays and the
others are dropped. With ``long_min_docs``, a whole line of over ``long_tokens`` tokens (fields not masked) also
recurs from so many different texts on; documents with the same text are one here and stay the same, so that a
later step finds them as copies.

Defined results: a null or empty text has one empty line and stays as it is; lines under ``min_tokens`` tokens
never drop; rows with one doc_id (repeated ones, or other texts under it) are one document for a template's frequency,
rows with a null doc_id are one document for each distinct text and sort last; equal rows come out equal; the
columns of ``docs`` keep their place, and a count whose name is one of them has underscores before it. Across documents
templates and long lines are known by 128 bits (a leaf by 64, which only says what is parsed further).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizforge.llm.common import stored

ODD_SPACES = r"[\t\r\x0b\f]|  "
SPACES = r"[ \t\r\x0b\f]+"
FIELD = r"[^\s0-9]*[0-9]\S*"


def _segment(tokens: Column, n: Column, s: int, depth: int, segments: int) -> Column:
    """The s-th of equal cuts of the tokens after the leading ones, as text."""
    low = F.floor((n - depth) * s / segments).cast("int")
    high = F.floor((n - depth) * (s + 1) / segments).cast("int")
    return F.array_join(F.slice(tokens, low + depth + 1, F.greatest(high - low, F.lit(0))), " ")


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """(document key, pos, line, whole): every line with its tokens lower-cased and single spaces between; whole is a hash of it."""
    body = F.coalesce(F.col(text), F.lit(""))
    lower = F.lower(body)
    even = F.when(lower.rlike(ODD_SPACES), F.regexp_replace(lower, SPACES, " ")).otherwise(lower)
    lines = docs.select(F.col("doc_id").alias("k_id"), F.xxhash64(body).alias("k_text"), F.posexplode(F.split(even, "\n")).alias("pos", "raw"))
    line = F.trim("raw")
    return lines.select("k_id", "k_text", "pos", line.alias("line"), F.struct(F.xxhash64(F.lit(-2), line).alias("a"), F.xxhash64(line, F.lit(-3)).alias("b")).alias("whole"))


def _masked(text: Column) -> Column:
    """The text with its fields masked. A field is a whole token, so tokens can be counted and cut before."""
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, FIELD, "<*>")).otherwise(text)


def _leaf(lines: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """Lines with their token count and leaf, for which the leading tokens alone are masked; the leaf of a line under ``min_tokens`` is null."""
    n = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    counted = lines.select("*", n.alias("n"), F.substring_index("line", " ", depth).alias("lead"))
    return counted.withColumn("leaf", F.when(F.col("n") >= min_tokens, F.xxhash64("n", _masked(F.col("lead")))))


def _templates(leaves: DataFrame, depth: int, segments: int) -> DataFrame:
    """The templates of each line: the whole line, and with each segment in turn generalised."""
    leaves = leaves.withColumn("line", _masked(F.col("line")))
    n, tokens = F.col("n"), F.split("line", " ")
    cut = F.array(*[_segment(tokens, n, s, depth, segments) for s in range(segments)])
    named = leaves.withColumn("cut", cut)
    part, lead = F.col("cut"), F.substring_index("line", " ", depth)
    key = lambda s, rest: F.struct(F.xxhash64("leaf", F.lit(s), *rest).alias("a"), F.xxhash64("n", F.lit(s), *rest[::-1], lead).alias("b"))
    forms = [key(-1, [part[i] for i in range(segments)])]
    for s in range(segments):
        rest = [part[i] for i in range(segments) if i != s]
        forms.append(F.when(n >= depth + 2 * segments, key(s, rest)))
    listed = F.filter(F.array(*forms), lambda x: x.isNotNull())
    return named.select("k_id", "k_text", "pos", listed.alias("templates"))


def _long_repeats(lines: DataFrame, min_docs: int) -> DataFrame:
    """(k_id, k_text, pos) of the long lines that stand in ``min_docs`` texts or more, without the first one's."""
    at = F.struct(F.col("k_id").isNull().alias("no_id"), "k_id", "pos", "k_text")
    texts = lines.groupBy("whole", "k_text").agg(F.min(at).alias("at"))
    recurring = texts.groupBy("whole").agg(F.count("*").alias("n_texts"), F.min("at").alias("first")).where(F.col("n_texts") >= min_docs)
    recurring = stored(recurring.select("whole", F.col("first.k_text").alias("f_text"), F.col("first.pos").alias("f_pos")), "long_lines")
    is_first = (F.col("k_text") == F.col("f_text")) & (F.col("pos") == F.col("f_pos"))
    return lines.join(recurring, "whole").where(~is_first).select("k_id", "k_text", "pos")


def count_names(docs: DataFrame) -> tuple[str, str]:
    """n_lines and n_dropped, each with as many underscores before it as no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    return tuple(next(n for k in range(len(taken) + 1) if (n := "_" * k + name) not in taken) for name in ("n_lines", "n_dropped"))


def drop_recurring_lines(
    docs: DataFrame, *, text: str = "text", min_docs: int = 5, min_tokens: int = 3, depth: int = 4, segments: int = 4, long_min_docs: int | None = None, long_tokens: int = 50,
) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and two columns more (long) at the end, named by ``count_names``: the lines, and those dropped."""
    counts = count_names(docs)
    lines = _lines(docs, text)
    leaves = _leaf(lines, depth, min_tokens)
    if long_min_docs is not None:
        # The short facts of a line, kept for both uses: leaves are counted, and long lines are matched whole.
        facts = stored(leaves.where(F.col("leaf").isNotNull()).select("k_id", "k_text", "pos", "leaf", F.when(F.col("n") > long_tokens, F.col("whole")).alias("whole")), "line_facts")
        counted = facts
    else:
        counted = leaves.where(F.col("leaf").isNotNull())
    # The tree is pruned first: a leaf with fewer lines than min_docs has no recurring template.
    hot = counted.groupBy("leaf").agg(F.count("*").alias("n_leaf")).where(F.col("n_leaf") >= min_docs)
    hot = stored(hot.select("leaf"), "leaves")
    # The few lines in those leaves are parsed further once; both uses below read what was stored.
    in_hot = stored(_templates(leaves.join(hot, "leaf", "left_semi"), depth, segments), "line_templates")
    templates = in_hot.select("k_id", "k_text", "pos", F.explode("templates").alias("template"))
    # One row for each template and document: a doc_id, or a text where there is none.
    nameless = F.when(F.col("k_id").isNull(), F.col("k_text")).alias("nameless")
    once = templates.groupBy("template", "k_id", nameless).agg(F.min(F.struct("pos", "k_text")).alias("at"))
    first = F.min(F.struct(F.col("k_id").isNull().alias("no_id"), F.col("k_id"), F.col("at")))
    recurring = (
        once.groupBy("template")
        .agg(F.count("*").alias("n_docs"), first.alias("first"))
        .where(F.col("n_docs") >= min_docs)
        .select("template", F.col("first.k_id").alias("f_id"), F.col("first.at.k_text").alias("f_text"), F.col("first.at.pos").alias("f_pos"))
    )
    recurring = stored(recurring, "templates")
    is_first = F.col("k_id").eqNullSafe(F.col("f_id")) & (F.col("k_text") == F.col("f_text")) & (F.col("pos") == F.col("f_pos"))
    repeats = templates.join(recurring, "template").where(~is_first).select("k_id", "k_text", "pos")
    if long_min_docs is not None:
        repeats = repeats.unionByName(_long_repeats(facts.where(F.col("whole").isNotNull()), long_min_docs))
    dropped = repeats.groupBy(F.col("k_id").alias("d_id"), F.col("k_text").alias("d_text")).agg(F.collect_set("pos").alias("d_pos"))
    dropped = stored(dropped, "dropped")
    body = F.coalesce(F.col(f"d.{text}"), F.lit(""))
    joined = docs.alias("d").join(
        dropped.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.d_id")) & (F.xxhash64(body) == F.col("x.d_text")), "left"
    )
    split = F.split(body, "\n")
    # The places that stay come from a set, and the lines are cut once: linear in the lines of a text.
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("x.d_pos"))
    kept = F.get(F.transform(F.array(split), lambda own: F.transform(stay, lambda i: F.get(own, i))), 0)
    columns = [F.col(f"d.`{c}`") if c != text else F.when(F.col("x.d_pos").isNull(), F.col(f"d.{text}")).otherwise(F.array_join(kept, "\n")).alias(text) for c in docs.columns]
    return joined.select(*columns, F.size(split).cast("long").alias(counts[0]), F.coalesce(F.size("x.d_pos"), F.lit(0)).cast("long").alias(counts[1]))
