"""Leaves of lines are found by their leading tokens alone."""

from pyspark.sql import functions as F

from quizforge.llm import line_templates as L


def test_a_leaf_masks_the_leading_tokens_only(spark):
    texts = ["a b2 c 3d e5f g", "  A\tb2  c\r9 9 9 \x0b9", "1", "", None, "x\n\n y1 z  w v u9", "é9é à\x855 b c d 7", "a-1-b 2.5% c d e" + " 7x" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    leaves = L._leaf(L._lines(docs, "text"), 4, 3)
    whole = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", L.FIELD, "<*>")).otherwise(F.col("line"))
    want = F.when(F.size(F.split(whole, " ")) >= 3, F.xxhash64(F.size(F.split(whole, " ")), F.substring_index(whole, " ", 4)))
    rows = leaves.select("leaf", want.alias("want"), "n", F.size(F.split(whole, " ")).alias("n_want")).collect()
    assert len(rows) == 10 and all(r.leaf == r.want and r.n == r.n_want for r in rows) and any(r.leaf for r in rows)
    plan = leaves.groupBy("leaf").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(lead" in plan and "regexp_replace(line" not in plan and "regexp_replace(trim" not in plan
