import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from quizforge.functions import folds, keys
from quizforge.functions import text as X


def values(spark, column, rows, schema="a string, b string"):
    return [r.v for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def one(spark, column, texts):
    return values(spark, column, [(t, None) for t in texts])


def test_splits(spark):
    a = F.col("a")
    got = one(spark, X.split_query(a), ["Stem 1\nA. x\nB. y", "Stem\n  (B) z", "no options", None, "A. first"])
    assert [(r.stem, r.options) for r in got] == [("Stem 1", "A. x\nB. y"), ("Stem", "(B) z"), ("no options", ""), ("", ""), ("", "A. first")]
    got = one(spark, X.split_lines(a), ["s\na. x", "s\n a. x"])
    assert [r.options for r in got] == ["a. x", ""]
    assert [r.options for r in one(spark, X.split_mcq(a), ["q (C) x", "q\n Z. x"])] == ["(C) x", "Z. x"]


def test_options(spark):
    got = one(spark, X.parse_options(F.col("a")), ["q\nA. x\nB. y\nA. z", "q (A) one (B) two", "q\nA. x", ""])
    assert [[(o.label, o.text) for o in r] for r in got] == [[("A", "z"), ("B", "y")], [("A", "one"), ("B", "two")], [], []]
    labels = ["B", "B. text", "b", " b text", "B, text", "B: text", "B;", "B\u3002x", "(B)", "", "BC", "B\u00b7", "B. x\ny", "\u00a0B ", None]
    assert one(spark, X.answer_label(F.col("a")), labels) == ["B"] * 8 + [""] * 4 + ["", "B", None]
    got = one(spark, X.parse_options(F.col("a")), ["(A) sin (x) (B) cos (y)", "q\nA.\nB. y", "q\r\n\u00a0A. x \nB.\u00a0y\u2028C. z", "(A)  (B) x", "(A) x (B) y (A) z", "B.5 and\nC.x"])
    assert [[(o.label, o.text) for o in r] for r in got] == [[("A", "sin (x)"), ("B", "cos (y)")], [], [("A", "x"), ("B", "y"), ("C", "z")], [("B", "x")], [("A", "z"), ("B", "y")], [("B", "5 and"), ("C", "x")]]
    assert one(spark, X.is_mcq(F.col("a")), ["q\nA. x\nB. y", "q (A) x", None]) == [True, False, False]
    assert [(r.stem, r.options) for r in one(spark, X.split_mcq(F.col("a")), ["At\nB.5 volts (A) x", "s\n\u00a0B. x"])] == [("At\nB.5 volts", "(A) x"), ("s", "B. x")]


def test_composite_texts(spark):
    got = values(spark, X.combine_t2t4(F.col("a"), F.col("b")), [("s \n\nA. x", "t\nA. y\nB. z"), ("s\nA. x", "no options"), ("A. x", "t\nB. y"), ("s", ""), ("\u00c9. e", "\u00e9. f")])
    assert got == ["s \n\nA. y\nB. z", "s\nno options", "A. x\nB. y", "s", "\u00c9. e\n\u00e9. f"]


def test_literals_and_checklists(spark):
    a = F.col("a")
    text = "Mix 5 mL of $H_2O$ and 5 mL of NaOH in <image 1>, acetic acid, ph 7. pH"
    got = one(spark, X.immutable_literals(a), [text])[0]
    assert got[:2] == ["<image 1>", "$H_2O$"] and "5 mL" in got and "NaOH" in got and "acetic acid" in got and got.count("5 mL") == 1
    kept = values(spark, X.sanitize_checklist(F.split("b", ";"), a, X.immutable_literals(a)), [(text, "5  ML;nothing;5 mL;")])[0]
    assert kept.kept == ["5  ML"] and kept.dropped == ["nothing"]
    assert values(spark, X.missing_items(F.split("b", ";"), a), [("has 5 ml", "5 mL;NaOH")]) == [["NaOH"]]
    assert one(spark, X.normalize_checklist(a), ['["x", " y "]', "x\n\n y"]) == [["x", "y"], ["x", "y"]]


def test_dedup_keep_order_against_python(spark):
    rows = [("a;A;b; ;B ;c;a  b;A b", None), ("", None), ("x", None)]

    def plain(items):
        seen, out = set(), []
        for i in items:
            k = re.sub(r"\s+", " ", i).strip().lower()
            if k and k not in seen:
                seen.add(k)
                out.append(i)
        return out

    assert values(spark, X.dedup_keep_order(F.split("a", ";")), rows) == [plain(a.split(";")) for a, _ in rows]


def test_model_answers(spark):
    a = F.col("a")
    assert one(spark, X.json_text(X.extract_json(a), "x"), ['{"x": "1"}', 'Sure: {"x": 2} ok', "no", "{broken", None, "[1]"]) == ["1", "2", None, None, None, None]
    assert one(spark, X.parse_score(a), ["Score: 95/100", "score - 7", "Score: 120", "none", "ok\nScore: 3\nScore: 4"]) == [95, 7, 100, None, 3]
    assert one(spark, X.verdict_passes(a), ["No", "no.", '"No"', "Yes", "No, because", "", None]) == [True, True, True, False, False, False, False]
    assert one(spark, X.strip_fence(a), ["```python\nx = 1\n```", "x = 2"]) == ["x = 1", "x = 2"]
    assert one(spark, X.word_count_en(a), ["it's two", "12 é"]) == [2, 0]
    assert values(spark, X.result_ok(a, F.col("b")), [("ok", "fine"), ("ok", "Error: x"), ("error", "fine"), ("ok", None)]) == [True, False, False, True]


def test_keywords_keep_their_digits(spark):
    assert values(spark, X.clean_keywords(F.split("a", ";"), 2), [(" term 0 ;term 1; ;term 0;x", None)]) == [["term 0", "term 1"]]


def test_pairs(spark):
    rows = [("500 mL", "0.5 L"), ("500 mL", "5 L"), ("5 g", "5 mL"), ("same", " same ")]
    assert values(spark, X.pair_equal(F.lit("unit"), F.col("a"), F.col("b")), rows) == [True, False, False, True]
    rows = [
        ("1,000 mL", "1 L"), ("36 km/h", "10 m/s"), ("1e3 g", "1 kg"), ("1 J", "1 N*m"), ("2 g/cm^3", "2000 kg/m**3"), ("5", "5.0"), ("1 kilometer", "1000 meters"), ("0.1 mol/L", "0.1 M"), ("1 \u00b5m", "1 um"), ("9.8 m/s^2", "9.8 N/kg"),
        ("0.0000001 mg", "0.0000002 mg"), ("5 g", "5 m"), ("1 L", "1.1 L"), ("x L", "x L2"), ("1 zz", "1 zzz"), ("1 kg g", "1 kg"),
    ]
    assert values(spark, X.unit_equal(F.col("a"), F.col("b")), rows) == [True] * 10 + [False] * 6
    rows = [("6 $CO_2$(g)", "CO2"), ("C_6H_{12}O_6", "C6O6H12"), ("H2O", "H2O2"), ("x", "y")]
    assert values(spark, X.pair_equal(F.lit("chem"), F.col("a"), F.col("b")), rows) == [True, True, False, False]
    assert values(spark, X.pair_equal(F.lit("other"), F.col("a"), F.col("b")), [("a", "b")]) == [False]


def test_folds(spark):
    df = spark.createDataFrame([Row(t="0 and 0", items=[Row(kind="", original="0", placeholder="{PH7}"), Row(kind="unit", original="zz", placeholder=""), Row(kind="x", original="and", placeholder="")])])
    items = folds.clean_equiv_items(F.col("items"), F.col("t"))
    got = df.select(items.alias("i"), folds.template_query(F.col("t"), items).alias("t")).first()
    assert [(x.kind, x.placeholder) for x in got.i] == [("math", "{{PH7}}"), ("math", "{{PH2}}")] and got.t == "{{PH7}} {{PH2}} 0"
    edits = F.array(F.struct(F.lit("0").alias("old"), F.lit("1").alias("new")), F.struct(F.lit("q").alias("old"), F.lit("1").alias("new")))
    got = df.select(folds.apply_replacements(F.col("t"), edits).alias("r")).first().r
    assert got.text == "1 and 0" and got.applied == [True, False]


def test_keys(spark):
    a = F.col("a")
    assert one(spark, keys.to_original_path(a), ["image/a/image/b", "x/image/a"]) == ["original_image/a/image/b", "x/image/a"]
    assert one(spark, keys.to_modified_path(a), ["image/a", "original_image/a", "a"]) == ["modified_image/a", "modified_image/a", "a"]
    assert one(spark, keys.image_key(a), [" image\\EMMA\\1.png "]) == ["EMMA/1.png"]
    assert one(spark, keys.dataset_of(a), ["image/MMMU/math/1.png", "EMMA/1.png", "", "MMMU"]) == ["MMMU/math", "EMMA", "root", "MMMU"]
    assert one(spark, keys.subject_of(a), ["image/EMMA/1.png", "MMMU/Biology/1.png", "MMMU/art/1.png", "zz/1"]) == ["chemistry", "biology", "UNKNOWN", "UNKNOWN"]
    assert one(spark, keys.model_slug(a), ["org/a b:c"]) == ["a_b_c"]
    assert one(spark, keys.label_state(a), ["chart", "Chart", "ERROR: x"]) == ["valid", "invalid", "error"]
    variant = F.try_parse_json(a)
    assert one(spark, keys.norm_id(variant), ["1", '"1"', "7.5", "true", "null"]) == ["1", "1", None, None, None]
