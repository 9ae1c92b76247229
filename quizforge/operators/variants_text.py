"""Text variants T1 to T4: a model's answer is parsed, applied and verified by rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizforge.functions import folds, text as X
from quizforge.functions.text import match_key
from quizforge.sources.rounds import Rounds

MAX_T2_RETRIES = 3


def apply_t1(items: DataFrame, response: str = "response", literals: str | None = None) -> DataFrame:
    """Paraphrase: a new stem over the old options; every kept literal must be in it.

    ``answer_state`` is parse_failed (no JSON object: nothing is verified), refused, empty or given, in the order of the checks. The
    checklist is what the answer lists and the stem has; only where the model agrees to change the text and lists none
    of these do all the stem's literals stand in. They are kept as the column ``literals``, if it is named: finding them is most of the work.
    """
    none = F.array().cast("array<string>")
    parsed = X.once(items, _half=X.split_query(F.col("query")), _json=X.extract_json(F.col(response)))
    answer = X.json_text(F.col("_json"), "modified_query_text", "modified_query", "paraphrased_query")
    given = F.coalesce(X.normalize_checklist(X.json_text(F.col("_json"), "return_checklist")), none)
    parsed = X.once(parsed, _new=F.trim(F.coalesce(answer, F.lit(""))), _can=F.coalesce(X.json_text(F.col("_json"), "can_modify").try_cast("boolean"), F.lit(False)), _given=given, _literals=X.immutable_literals(F.col("_half.stem")))
    kept = X.sanitize_checklist(F.col("_given"), F.col("_half.stem"), F.col("_literals"))["kept"]
    state = F.when(F.col("_json").isNull(), "parse_failed").when(~F.col("_can"), "refused").when(F.col("_new") == "", "empty").otherwise("given")
    can = state == "given"
    kept = F.when(F.size("_given") == 0, none).otherwise(kept)
    checklist = X.let(kept, lambda k: F.when(F.col("_can") & (F.size(k) == 0), F.col("_literals")).otherwise(k))
    parsed = X.once(parsed, answer_state=state, can_modify=can, _stem=F.when(can, F.col("_new")).otherwise(F.col("_half.stem")), return_checklist=checklist)
    parsed = X.once(parsed, verify_missing_items=X.missing_items(F.col("return_checklist"), F.col("_stem")))
    joined = F.when((F.col("_half.options") != "") & (F.col("_stem") != ""), F.concat(F.col("_stem"), F.lit("\n"), F.col("_half.options"))).otherwise(F.concat("_stem", "_half.options"))
    failed = F.col("answer_state") == "parse_failed"
    query = F.when(failed, F.col("query")).otherwise(joined)
    if literals:
        parsed = parsed.withColumn(literals, F.col("_literals"))
    return (
        parsed.withColumn("action", F.lit("T1")).withColumn("original_query", F.col("query")).withColumn("modified_query", query)
        .withColumn("modified_answer", F.col("target")).withColumn("verify_passed", ~failed & (F.size("verify_missing_items") == 0)).drop("_half", "_json", "_new", "_can", "_given", "_literals", "_stem")
    )


def t2_state(can_modify: Column, n_items: Column, any_passed: Column) -> Column:
    """verify_passed of T2: null if it can't be modified, false without items, else whether any pair passed."""
    return F.when(~can_modify, F.lit(None).cast("boolean")).when(n_items == 0, F.lit(False)).otherwise(any_passed)


def apply_t2(items: DataFrame, pairs: str = "pairs", transformed: str = "transformed") -> DataFrame:
    """Equivalent rewriting: ``pairs`` (kind, original, placeholder), and a text for each pair that the query has, by place.

    Pairs that fail keep the original; if all fail, so does the query.
    """
    can = F.coalesce(F.col("can_modify"), F.lit(True))
    base = X.once(items, _can=can, _items=F.when(can, folds.clean_equiv_items(F.col(pairs), F.col("query"))).otherwise(F.slice(folds.clean_equiv_items(F.col(pairs), F.col("query")), 1, 0)))
    said = folds.align_transformed(F.transform("_items", lambda x: x["original"]), F.col(transformed))
    detail = lambda x, t, passed: F.struct(x["kind"].alias("kind"), x["original"].alias("original"), F.when(passed, t).otherwise(x["original"]).alias("modified"), t.alias("model_transformed"), passed.alias("passed"))
    base = X.once(base, return_checklist=F.zip_with("_items", said, lambda x, t: X.let(X.pair_equal(x["kind"], x["original"], t), lambda passed: detail(x, t, passed))))
    edits = F.zip_with("_items", "return_checklist", lambda x, d: F.struct(x["placeholder"].alias("old"), d["modified"].alias("new")))
    base = X.once(base, _any=F.exists("return_checklist", lambda d: d["passed"]), _new=folds.apply_replacements(folds.template_query(F.col("query"), F.col("_items")), edits)["text"])
    errors = F.transform(F.filter("return_checklist", lambda d: ~d["passed"]), lambda d: F.struct(d["kind"].alias("kind"), d["original"].alias("original"), d["model_transformed"].alias("transformed"), F.lit("not equivalent").alias("reason")))
    return (
        base.withColumn("action", F.lit("T2")).withColumn("original_query", F.col("query")).withColumn("modified_query", F.when(F.col("_any"), F.col("_new")).otherwise(F.col("query")))
        .withColumn("modified_answer", F.col("target")).withColumn("verify_passed", t2_state(F.col("_can"), F.size("_items"), F.col("_any"))).withColumn("verify_error_items", errors)
        .withColumn("text_changed", F.col("modified_query") != F.col("original_query")).drop("_items", "_can", "_any", "_new")
    )


def run_t2_rounds(items: DataFrame, rewrite: Callable[[DataFrame, int], DataFrame], max_retries: int = MAX_T2_RETRIES, folder: str | None = None) -> DataFrame:
    """``apply_t2`` over the texts that ``rewrite`` adds (``transformed``), again while every pair of an item fails.

    Only such items go again; ``retry_times`` says how often. Every round is stored before use, as it costs; with a ``folder``
    a call after a crash goes on at the first round that isn't complete.
    """
    left, out, rounds = items, None, Rounds(items.sparkSession, folder, "t2_rounds")
    for n in range(max_retries + 1):
        done = rounds.get(f"round{n}", lambda: apply_t2(rewrite(left, n)).withColumn("retry_times", F.lit(n)))  # noqa: B023 - called at once
        again = (F.size("return_checklist") > 0) & ~F.exists("return_checklist", lambda d: d["passed"])
        last = n == max_retries
        settled = done if last else done.where(~again)
        out = settled if out is None else out.unionByName(settled)
        left = done.where(again).select(*items.columns)
        if last or left.isEmpty():
            break
    return out


def lookup_terms(terms: DataFrame, reference_text: DataFrame, keys: list[str], words: str, most: int) -> DataFrame:
    """For each row of ``keys``: ``blocks``, (query_term, title, summary) in keyword order; unknown terms have no summary."""
    each = terms.select(*keys, F.posexplode(X.clean_keywords(F.col(words), most)).alias("_at", "query_term"))
    known = reference_text.groupBy(F.col("term_key").alias("_key")).agg(F.min(F.struct("title", "summary")).alias("_ref"))
    # The side is broadcast only if its size allows it: that is left to the optimiser.
    joined = each.withColumn("_key", match_key(F.col("query_term"))).join(known, "_key", "left")
    block = F.struct("_at", "query_term", F.col("_ref.title").alias("title"), F.col("_ref.summary").alias("summary"))
    return joined.groupBy(*keys).agg(F.array_sort(F.collect_list(block)).alias("blocks"))  # at most ``most`` a row


def _usable(blocks: Column) -> Column:
    return F.filter(F.coalesce(blocks, F.array().cast("array<struct<_at:int,query_term:string,title:string,summary:string>>")), lambda b: F.coalesce(F.trim(b["summary"]), F.lit("")) != "")


def _title(block: Column) -> Column:
    """A block's title, or what was looked up where it has none."""
    return F.coalesce(F.nullif(block["title"], F.lit("")), block["query_term"], F.lit(""))


def t3_context(blocks: Column) -> Column:
    first = F.get(_usable(blocks), 0)
    return F.concat(F.lit("("), _title(first), F.lit("): "), F.trim(first["summary"]))


def apply_t3(items: DataFrame) -> DataFrame:
    """Added background from ``blocks`` and ``background`` (a model's text); without context the fallback passes as it is."""
    context = t3_context(F.col("blocks"))
    text = F.trim(F.coalesce("background", F.lit("")))
    fallback = context.isNull() & (text != "")
    verify = F.when(~F.col("can_modify"), F.lit(None).cast("boolean")).otherwise((F.size(_usable(F.col("blocks"))) > 0) | fallback)
    return (
        items.withColumn("action", F.lit("T3")).withColumn("original_query", F.col("query"))
        .withColumn("modified_query", F.when(F.col("can_modify") & (text != ""), F.concat_ws("\n\n", text, F.col("query"))).otherwise(F.col("query")))
        .withColumn("modified_answer", F.col("target")).withColumn("verify_passed", verify).withColumn("fallback_mode", F.when(fallback, "no_context"))
        .withColumn("context", context).withColumn("word_count_en_tokens", X.word_count_en(text))
    )


def t4_context(blocks: Column) -> Column:
    """A line for each block that has a summary; the summaries' titles, or the words that were looked up."""
    return F.array_join(F.transform(_usable(blocks), lambda b: F.concat(F.lit("- "), F.trim(_title(b)), F.lit(": "), F.trim(b["summary"]))), "\n")


def clean_distractors(candidates: Column, options: Column, most: int = 10) -> Column:
    """Trimmed candidates that no option equals, distinct without case, at most ``most``."""
    taken = F.transform(options, lambda o: X.plain_key(o["text"]))
    new = F.filter(X.dedup_keep_order(candidates, X.plain_key), lambda c: ~F.array_contains(taken, X.plain_key(c)))
    return F.slice(F.transform(new, X.strip), 1, most)


def rebuild_mcq(items: DataFrame, distractors: str = "distractors", seed: int = 0, options: str | None = None) -> DataFrame:
    """``modified_query`` and ``modified_answer``: old options and distractors in a seeded order, labelled anew; ``new_options`` has their lines.

    A target that is no option leaves the item as it is, with null ``new_options``. ``options`` names a column that has the parsed
    options already.
    """
    base = X.once(items, _options=F.col(options) if options else X.parse_options(F.col("query")), _label=X.answer_label(F.col("target")), _stem=X.split_mcq(F.col("query"))["stem"])
    base = X.once(base, _right=F.get(F.filter("_options", lambda o: o["label"] == F.col("_label")), 0)["text"])
    wrong = F.transform(F.array_sort(F.filter("_options", lambda o: o["label"] != F.col("_label"))), lambda o: o["text"])
    every = F.concat(wrong, F.col(distractors), F.array(F.col("_right")))
    keyed = F.transform(every, lambda t, i: F.struct(F.md5(F.concat_ws("|", F.lit(seed), F.col("dataset"), F.col("id"), i)).alias("k"), i.alias("i"), t.alias("t")))
    base = X.once(base, _new=F.transform(F.array_sort(keyed), lambda s: s["t"]))
    lines = F.transform("_new", lambda t, i: F.concat(F.char(65 + i), F.lit(". "), t))
    known = F.col("_right").isNotNull()
    at = F.array_position("_new", F.col("_right"))
    return (
        base.withColumn("new_options", F.when(known, lines)).withColumn("modified_query", F.when(known, F.trim(F.concat(F.col("_stem"), F.lit("\n"), F.array_join(lines, "\n")))).otherwise(F.col("query")))
        .withColumn("modified_answer", F.when(known, F.char(64 + at)).otherwise(F.col("target"))).drop("_options", "_label", "_stem", "_right", "_new")
    )


def apply_t4(items: DataFrame, seed: int = 0) -> DataFrame:
    """Extra distractors from ``candidates``, with ``blocks`` as their sources (``context`` has them as text); ``can_modify`` is the gate's answer (null: yes).

    ``state`` is not_mcq, not_expandable (the gate), no_keywords or done, in the order of the checks.
    """
    gate = F.coalesce(F.col("can_modify"), F.lit(True)) if "can_modify" in items.columns else F.lit(True)
    parsed = X.once(items, _own=X.parse_options(F.col("query")), _gate=gate)
    no_blocks = F.coalesce(F.size("blocks"), F.lit(0)) <= 0
    state = F.when(F.size("_own") < 2, "not_mcq").when(~F.col("_gate"), "not_expandable").when(no_blocks, "no_keywords").otherwise("done")
    done = F.col("state") == "done"
    cleaned = X.once(parsed, state=state, distractors=clean_distractors(F.coalesce("candidates", F.array().cast("array<string>")), F.col("_own")))
    cleaned = cleaned.withColumn("distractors", F.when(done, F.col("distractors")).otherwise(F.slice("distractors", 1, 0)))
    built = rebuild_mcq(cleaned.withColumn("original_query", F.col("query")), "distractors", seed, options="_own")
    return (
        built.withColumn("action", F.lit("T4")).withColumn("can_modify", done).withColumn("context", t4_context(F.col("blocks")))
        .withColumn("modified_query", F.when(done, F.col("modified_query")).otherwise(F.col("query")))
        .withColumn("modified_answer", F.when(done, F.col("modified_answer")).otherwise(F.col("target")))
        .withColumn("verify_passed", F.when(F.col("state").isin("not_mcq", "not_expandable"), F.lit(None).cast("boolean")).otherwise(F.size(_usable(F.col("blocks"))) > 0)).drop("_own", "_gate")
    )
