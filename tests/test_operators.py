import json

import pytest
from pyspark.sql import functions as F

from quizforge.operators import classify, compose, dedup, inference, summary, variants_image, variants_text
from quizforge.sources import tables

ITEM = "dataset string, subject string, field string, id string, pos long, query string, target string, image_path array<string>"


def test_keep_last_aggregates_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("a", 2, "w")], "k string, o int, v string")
    last = dedup.keep_last(df, ["k"], F.col("o"))
    assert sorted(map(tuple, last.collect())) == [("a", 3, "y"), ("b", 2, "z")]
    assert "partial_max_by" in last._jdf.queryExecution().toString()
    assert sorted(map(tuple, dedup.keep_first(df, ["k"], F.col("o")).collect())) == [("a", 1, "x"), ("b", 2, "z")]


def test_text_variants_and_composites(spark):
    items = spark.createDataFrame([("d", "s", "f", "1", 0, "Mix 5 mL\nA. x\nB. y", "A", ["image/d/1.png"]), ("e", "s", "f", "1", 0, "Mix 6 mL\nA. x\nB. y", "B", [])], ITEM)
    answered = items.withColumn("response", F.to_json(F.struct(F.lit(True).alias("can_modify"), F.lit("Blend 5 ml").alias("paraphrased_query"))))
    t1 = variants_text.apply_t1(answered)
    got = {r.dataset: r for r in t1.collect()}
    assert got["d"].verify_passed and got["d"].modified_query == "Blend 5 ml\nA. x\nB. y"
    assert not got["e"].verify_passed and "6 mL" in got["e"].verify_missing_items
    text = compose.build_text_qa(t1, items)
    row = text.collect()
    assert len(row) == 1 and row[0].image_path == ["original_image/d/1.png"]
    labels = spark.createDataFrame([("image/d/1.png", "Illustration"), ("e/1.png", "chart")], "image_key string, label string")
    there = spark.createDataFrame([("modified_image/d/1.png",)], "path string")
    image = compose.build_image_qa(items, labels, there, "V2")
    both = compose.compose_tv(text, image).collect()
    assert [(r.level, r.image_path, r.target_mismatch) for r in both] == [("T1V2", ["modified_image/d/1.png"], False)]
    counts = {r.dataset: r for r in summary.variant_summary(t1).collect()}
    assert (counts["d"].verify_passed, counts["e"].verify_failed, counts["e"].verify_not_applicable) == (1, 1, 0)
    assert summary.variant_summary(t1, grand=True).where("level = 7").first().total == 2


def test_mcq_rebuild_keeps_options_and_answer(spark):
    items = spark.createDataFrame([("d", str(i), "Q?\nA. one\nB. two\nC. three", t) for i, t in enumerate(["A", "B", "C. three", "D"])], "dataset string, id string, query string, target string")
    raw = F.array(F.lit("Two"), F.lit("four"), F.lit("FOUR "), F.lit("five"))
    from quizforge.functions import text as X

    df = items.withColumn("distractors", variants_text.clean_distractors(raw, X.parse_options(F.col("query"))))
    out = variants_text.rebuild_mcq(df, seed=1).withColumn("o", X.parse_options(F.col("modified_query"))).collect()
    for r, right in zip(sorted(out, key=lambda r: r.id), ["one", "two", "three", None], strict=True):
        assert r.distractors == ["four", "five"]
        if right is None:
            assert r.modified_query == r.query and r.modified_answer == "D"
        else:
            assert sorted(o.text for o in r.o) == ["five", "four", "one", "three", "two"]
            assert {o.label: o.text for o in r.o}[r.modified_answer] == right


def test_class_matrix_totals(spark):
    labels = spark.createDataFrame([("image/EMMA/1.png", "chart"), ("MMMU/math/2.png", "Photograph"), ("MMMU/math/3.png", "ERROR: x"), ("zz/4.png", "chart")], "image_key string, label string")
    rows = {r.subject: r for r in classify.class_matrix(labels).collect()}
    assert len(rows) == 7 and rows["ALL"].total == 2 and rows["math"].invalid == 1 and rows["physics"].total == 0
    keys = labels.select("image_key")
    assert classify.pending(keys, labels, ["image_key"]).count() == 0
    assert [r.image_key for r in classify.retry_errors(keys, labels, ["image_key"]).collect()] == ["MMMU/math/3.png"]
    assert {r.target_path for r in classify.classified_layout(labels).collect()} == {"chart/EMMA/1.png", "Photograph/MMMU/math/2.png", "chart/zz/4.png"}


def test_attempts_and_rounds(spark):
    df = spark.createDataFrame([("a", 1, True, "Score: 80"), ("a", 2, True, "Score: 95"), ("a", 3, True, "Score: 99"), ("b", 1, False, "Score: 99"), ("b", 2, True, None)], "id string, attempt int, render_ok boolean, raw_evaluation string")
    rows = {r.id: r for r in variants_image.best_attempt(df, ["id"]).collect()}
    assert (rows["a"].attempt, rows["a"].retry_times, rows["a"].success) == (2, 1, True)
    assert (rows["b"].attempt, rows["b"].success) == (2, False)
    start = spark.range(30).withColumn("retry_times", F.lit(0))
    step = lambda left, n: left.withColumn("ok", F.lit(True)).withColumn("judge_answer", F.when(F.col("id") % 5 == n, "no").otherwise("yes"))
    out = variants_image.run_rounds(start, step).groupBy("round_idx", "state").count().collect()
    assert {(r.round_idx, r.state): r["count"] for r in out} == {(0, "passed"): 6, (1, "passed"): 6, (2, "passed"): 6, (2, "cannot_modify"): 12}
    retries = variants_image.run_rounds(start, step).groupBy("state", "retry_times").count().collect()
    assert {(r.state, r.retry_times): r["count"] for r in retries} == {("passed", 0): 6, ("passed", 1): 6, ("passed", 2): 6, ("cannot_modify", 3): 12}
    assert sum(r["count"] for r in out) == 30


def test_resume_is_idempotent(spark):
    items = spark.createDataFrame([("d", "1", "q"), ("d", "2", "q"), ("e", "1", "q")], "dataset string, id string, prompt string")
    keys = ["dataset", "id"]
    old = spark.createDataFrame([("d", "1", "fine", "ok"), ("d", "2", "Error: x", "ok"), ("z", "9", "orphan", "ok"), ("d", "", "blank", "ok")], "dataset string, id string, output string, status string")
    order = F.lit(0)
    left = inference.resume_pending(items, old, keys, order)
    assert {(r.dataset, r.id) for r in left.collect()} == {("d", "2"), ("e", "1")}

    def scorer():
        def run(prompt):
            if prompt == "boom":
                raise ValueError("x")
            return "B"

        return run

    new = inference.infer(left, scorer).select("dataset", "id", "output", "status")
    merged = inference.merge_outputs(items, old, new, keys, order)
    assert {(r.dataset, r.id): r.output for r in merged.collect()} == {("d", "1"): "fine", ("d", "2"): "B", ("e", "1"): "B"}
    assert inference.resume_pending(items, merged.select("dataset", "id", "output", "status"), keys, order).count() == 0
    failed = inference.infer(items.withColumn("prompt", F.lit("boom")), scorer).collect()
    assert {r.status for r in failed} == {"error"}


def test_sources_round_trip(spark, tmp_path):
    root = tmp_path / "qa" / "EMMA"
    root.mkdir(parents=True)
    (root / "chem_qa.json").write_text(json.dumps([{"id": 1, "query": "q", "target": 2, "image_path": ["image/x.png"]}, {"id": "1", "query": "p", "target": "A"}, {"id": 1.5}, {"id": None}]))
    (root / "bad_qa.json").write_text("not json")
    rows = sorted(tables.read_qa(spark, f"file://{tmp_path}/qa").collect(), key=lambda r: r.pos)
    assert [(r.dataset, r.subject, r.id, r.target) for r in rows] == [("EMMA", "chem", "1", "2"), ("EMMA", "chem", "1", "A")]
    (tmp_path / "labels.json").write_text(json.dumps({"a": "chart", "b": "ERROR: x"}))
    assert tables.read_labels(spark, f"file://{tmp_path}/labels.json").count() == 2
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "My_Set_math_T1.json").write_text(json.dumps([{"id": 3, "query": "q", "target": "A", "image_path": []}]))
    assert [(r.dataset, r.field, r.level) for r in tables.read_variants(spark, f"file://{tmp_path}/v").collect()] == [("My_Set", "math", "T1")]
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.json").write_text(json.dumps({"results": [{"id": "1", "output": "x", "status": "ok"}]}))
    (tmp_path / "o" / "b.json").write_text(json.dumps([{"id": "2", "output": "y", "status": "ok"}]))
    assert {r.id for r in tables.read_outputs(spark, f"file://{tmp_path}/o").collect()} == {"1", "2"}
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(bytes(range(200)))
    (tmp_path / "img" / "b.txt").write_bytes(b"x")
    assert [r.path for r in tables.image_manifest(spark, f"file://{tmp_path}/img").collect()] == ["a.png"]
    import base64

    one = tables.encode_images(spark.createDataFrame([("1", ["a.png"]), ("2", ["a.png", "a.png"])], "id string, image_path array<string>"), f"file://{tmp_path}/img")
    got = {r.id: r.image for r in one.collect()}
    want = base64.b64encode(bytes(range(200))).decode()
    assert got["1"] == want and json.loads(got["2"]) == [want, want]


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["text_qa", "composite_tv", "merged_outputs", "resume_pending", "sharded_seeds"])
def test_plans_have_no_python_and_no_nested_loop(spark, name):
    import __spark_entry__ as e

    plan = e.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_literal_rules_are_planned_once(spark):
    import __spark_entry__ as e

    for name in ("text_variant_summary", "text_qa", "composite_tv"):
        plan = e.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("titration curve") == 1, name


def test_image_rows_that_lack_images_have_reasons(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "_ENCODED_BYTES", 300)
    (tmp_path / "a").write_bytes(bytes(range(200)))
    (tmp_path / "b").write_bytes(b"x")
    rows = spark.createDataFrame([("1", ["a"]), ("2", ["a", "b", "a"]), ("3", []), ("4", None), ("5", ["zz"]), ("6", ["a", "zz"])], "id string, image_path array<string>")
    encoded = tables.encode_images(rows, f"file://{tmp_path}")
    assert "Exchange" not in encoded._jdf.queryExecution().toString()
    got = {r.id: (r.image, r.reason) for r in encoded.collect()}
    import base64

    a, b = (base64.b64encode(x).decode() for x in (bytes(range(200)), b"x"))
    assert got == {"1": (a, None), "2": (json.dumps([a, b, a], separators=(",", ":")), None), "3": (None, "no_image"), "4": (None, "no_image"), "5": (None, "missing_image"), "6": (None, "missing_image")}


def test_attempts_keep_the_last_score_that_was_given(spark):
    rows = [("a", 1, True, "Score: 70"), ("a", 2, False, "Score: 99"), ("a", 3, None, None), ("b", 1, True, "Score: 70"), ("b", 2, True, "none"), ("c", 1, False, None), ("c", 2, True, "Score: 91"), ("c", 3, True, "Score: 95")]
    df = spark.createDataFrame(rows, "id string, attempt int, render_ok boolean, raw_evaluation string")
    got = {r.id: (r.attempt, r.score, r.success, r.retry_times) for r in variants_image.best_attempt(df, ["id"]).collect()}
    assert got == {"a": (3, 70, False, 2), "b": (2, None, False, 1), "c": (2, 91, True, 1)}


def test_t2_rounds_ask_again_only_where_all_pairs_fail(spark):
    pair = lambda x: {"kind": "unit", "original": x, "placeholder": ""}
    rows = [("1", "5 mL and x9", [pair("5 mL"), pair("x9")], True), ("2", "7 mL", [pair("7 mL")], True), ("3", "no", [pair("zz")], True), ("4", "7 mL", [pair("7 mL")], False)]
    items = spark.createDataFrame(rows, "id string, query string, pairs array<struct<kind:string,original:string,placeholder:string>>, can_modify boolean").withColumn("target", F.lit("A"))
    asked = []

    def rewrite(left, n):
        asked.append(sorted(r.id for r in left.collect()))
        return left.withColumn("transformed", F.when(F.col("id") == "1", F.array(F.lit("0.005 L"), F.lit("1"))).otherwise(F.array(F.lit("7 g"))))

    out = {r.id: (r.modified_query, r.verify_passed, r.retry_times, [d.passed for d in r.return_checklist]) for r in variants_text.run_t2_rounds(items, rewrite).collect()}
    assert asked == [["1", "2", "3", "4"], ["2"], ["2"], ["2"]]
    assert out == {"1": ("0.005 L and x9", True, 0, [True, False]), "2": ("7 mL", False, 3, [False]), "3": ("no", False, 0, []), "4": ("7 mL", None, 0, [])}


def test_composites_skip_rows_without_text(spark):
    row = "dataset string, field string, id string, level string, query string, target string, image_path array<string>, pos int"
    t = spark.createDataFrame([("d", "f", str(i), "T1", q, g, ["t"], 0) for i, (q, g) in enumerate([("q", "A"), (None, "A"), ("q", None), ("q", "A"), ("q", "A")])], row)
    v = spark.createDataFrame([("d", "f", "0", "V2", "q", "B", ["new"], 2), ("d", "f", "0", "V2", "q", "A", ["zz"], 1), ("d", "f", "1", "V2", "q", "A", ["v"], 0), ("d", "f", "3", "V2", "q", None, None, 0)], row)
    got = {r.id: (r.image_path, r.target_mismatch) for r in compose.compose_tv(t, v).collect()}
    assert got == {"0": (["new"], True), "3": ([], False)}


def test_writing_again_replaces_partitions(spark, tmp_path):
    row = "dataset string, field string, level string, id string"
    for ids in (("1", "2"), ("3",)):
        tables.write_variants(spark.createDataFrame([("d", "f", "T1", i) for i in ids], row), f"file://{tmp_path}/v")
        tables.write_variants(spark.createDataFrame([("e", "f", "T1", "9")], row), f"file://{tmp_path}/v")
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/v").collect()) == ["3", "9"]


def test_drop_report(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("a", "x"), ("b", "y")], "k string, reason string")
    got = {r.k: (r.converted, r.skipped, [tuple(x) for x in r.reasons]) for r in summary.drop_report(df, "k").collect()}
    assert got == {"a": (1, 2, [("x", 2)]), "b": (0, 1, [("y", 1)])}


def test_entry_point_without_a_package_that_llm_needs(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "text_qa" in e.queries() and "pipeline" not in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_t1_answers_that_are_no_json_are_not_verified(spark):
    item = ("d", "f", "1", " Mix 5 mL of NaOH\nA. x\nB. y", "A")
    answers = {
        "none": None, "prose": "{no answer", "text first": '{"can_modify": true, "modified_query": "decoy", "modified_query_text": "Blend 5 ml naoh"}', "other name": '{"can_modify": true, "modified_query_text": "", "modified_query": "Blend 5 ml naoh"}',
        "refused": '{"can_modify": false, "modified_query_text": "x", "return_checklist": ["NaOH", "zz"]}', "empty": '{"can_modify": true, "modified_query_text": " "}',
    }
    rows = spark.createDataFrame([(*item, k, v) for k, v in answers.items()], "dataset string, field string, id string, query string, target string, k string, response string")
    got = {r.k: r for r in variants_text.apply_t1(rows).collect()}
    assert {k: (r.answer_state, r.verify_passed, r.can_modify) for k, r in got.items()} == {
        "none": ("parse_failed", False, False), "prose": ("parse_failed", False, False), "text first": ("given", True, True), "other name": ("given", True, True), "refused": ("refused", True, False), "empty": ("empty", True, False),
    }
    assert got["prose"].modified_query == item[3] and got["prose"].return_checklist == [] and got["text first"].modified_query == "Blend 5 ml naoh\nA. x\nB. y"
    assert got["refused"].return_checklist == ["NaOH"] and "5 mL" in got["empty"].return_checklist


def test_last_result_of_an_id_decides(spark):
    row = "dataset string, id string, output string, status string, attempt int"
    items = spark.createDataFrame([("d", "1"), ("d", "2"), ("d", "3")], "dataset string, id string")
    old = spark.createDataFrame([("d", "1", "good", "ok", 0), ("d", "1", "[ERROR] x", "error", 1), ("d", "2", "[ERROR] x", "error", 0), ("d", "2", "zz good", "ok", 2), ("d", "2", "a good", "ok", 1)], row)
    keys = ["dataset", "id"]
    assert {r.id for r in inference.resume_pending(items, old, keys, F.col("attempt")).collect()} == {"1", "3"}
    new = spark.createDataFrame([("d", "1", "zz", "ok", 0), ("d", "1", "last", "ok", 1)], row)
    got = {r.id: (r.output, r.status) for r in inference.merge_outputs(items, old, new, keys, F.col("attempt")).collect()}
    assert got == {"1": ("last", "ok"), "2": ("zz good", "ok"), "3": ("[ERROR] missing result after resume", "error")}


def test_originals_without_images_hide_none(spark):
    items = spark.createDataFrame([("d", "s", "f", "1", 0, "q", "A", ["image/1.png"]), ("d", "s", "f", "1", 1, "q", "A", None)], ITEM)
    variants = items.where("pos = 0").selectExpr("*", "true AS verify_passed", "query AS modified_query", "target AS modified_answer", "'T1' AS action")
    assert [r.image_path for r in compose.build_text_qa(variants, items).collect()] == [["original_image/1.png"]]


def test_contexts_name_what_was_looked_up_where_a_title_is_missing(spark):
    block = "array<struct<_at:int,query_term:string,title:string,summary:string>>"
    df = spark.createDataFrame([([(0, "k0", "t0", " "), (1, "k1", None, " s1 "), (2, "k2", "t2", "s2"), (3, "k3", "", "s3")],)], f"blocks {block}")
    got = df.select(variants_text.t3_context(F.col("blocks")).alias("t3"), variants_text.t4_context(F.col("blocks")).alias("t4")).first()
    assert (got.t3, got.t4) == ("(k1): s1", "- k1: s1\n- t2: s2\n- k3: s3")


def test_empty_queries_can_be_asked(spark):
    rows = spark.createDataFrame([("", "A", ["i"]), (None, "A", ["i"]), ("q", None, ["i"]), ("q", "A", [])], "query string, target string, image_path array<string>")
    assert inference.inference_ready(rows).count() == 1
    assert [r.reason for r in inference.eval_ready(rows).collect()] == [None, "no_query", "no_target", "no_image"]


def test_dense_index_is_consecutive_where_values_tie(spark):
    df = spark.range(5000).repartition(7).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("v"), "id")
    rows = dedup.dense_index(df, [F.col("v").desc()], "i", start=1).collect()
    assert sorted(r.i for r in rows) == list(range(1, 5001)) and sorted(r.id for r in rows) == list(range(5000))
    assert [r.v for r in sorted(rows, key=lambda r: r.i)] == sorted((r.v for r in rows), reverse=True)
    assert dedup.dense_index(df.limit(0), [F.col("v")], "i").collect() == []


def test_drops_are_counted_while_the_set_is_written(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "x" if i % 3 == 1 else "y") for i in range(90)], "id int, reason string")
    report = summary.written_with_report(df, ("x", "y", "z"), lambda kept: kept.write.parquet(f"file://{tmp_path}/kept"))
    assert tuple(report.first()) == (30, 30, 30, 0)
    assert spark.read.parquet(f"file://{tmp_path}/kept").columns == ["id"] and spark.read.parquet(f"file://{tmp_path}/kept").count() == 30
