"""The registered queries of the question-set operators, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizforge.functions import folds, keys, text as X
from quizforge.jobs import adapters as A
from quizforge.operators import classify, compose, dedup, inference, summary, variants_image, variants_text
from quizforge.operators.inference import Limits
from quizforge.sources import runs
from quizforge.sources.tables import new_table_path, write_bucketed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RUN_KEYS = ["model", "dataset", "action", "run_tag", "id"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t1(spark: SparkSession, sf_dir: str, literals: str | None = None) -> DataFrame:
    return variants_text.apply_t1(A.t1_responses(A.plain_items(spark, sf_dir)), literals=literals)


_KEY = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
#: T1 worked out from the texts: literals by rule, what the answer loses, and the new question.
_T1 = A.oracle_ctes("items", "plain", "image_labels") + r""", found AS (SELECT doc_id, list_concat(regexp_extract_all(stem, '(?i)<image\s*\d+>'), regexp_extract_all(stem, '\$[^$]+\$'),
      regexp_extract_all(stem, '\b\d+(?:\.\d+)?\s*(?:mL|L|M|mol|mmol|g|kg|cm|mm|%|K|°C|N)\b'), regexp_extract_all(stem, '\b\d+(?:\.\d+)?\b'), regexp_extract_all(stem, '\b(?:[A-Z][a-z]?\d*){2,}\b'),
      regexp_extract_all(stem, '\b[a-zA-Z][a-zA-Z\-]*\s+(?:acid|base)\b'), regexp_extract_all(stem, '(?i)titration curve')[1:1], regexp_extract_all(stem, '(?i)equivalence point')[1:1], regexp_extract_all(stem, '(?i)pH')[1:1]) AS l FROM plain),
    each AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM found),
    firsts AS (SELECT doc_id, """ + _KEY.format("x") + r""" AS k, arg_min(x, i) AS x, min(i) AS i FROM each GROUP BY ALL),
    literals AS (SELECT doc_id, list(x ORDER BY i) AS xs, list(k ORDER BY i) AS ks FROM firsts GROUP BY doc_id),
    told AS (SELECT p.*, coalesce(xs, []) AS xs, coalesce(ks, []) AS ks, CASE WHEN doc_id % 6 IN (2, 4) THEN list_filter(['naoh', '12 kg'], lambda g: list_contains(coalesce(ks, []), g)) ELSE [] END AS listed FROM plain p LEFT JOIN literals USING (doc_id)),
    checked AS (SELECT *, CASE WHEN len(listed) > 0 OR doc_id % 6 IN (2, 3) THEN listed ELSE ks END AS asked, CASE WHEN doc_id % 6 IN (0, 1, 4) AND trim(said) <> '' THEN trim(said) ELSE trim(stem) END AS new FROM told),
    t1 AS (SELECT *, list_filter(asked, lambda k: NOT contains(""" + _KEY.format("new") + r""", k)) AS missing, concat(new, chr(10), opts) AS modified, len(missing) = 0 AND doc_id % 6 <> 3 AS passed FROM checked)"""


@query(
    _T1
    + """ SELECT dataset, subject, 'T1' AS action, count(*) AS total, count(*) FILTER (modified <> query) AS changed, count(*) FILTER (modified = query) AS unchanged,
    count(*) FILTER (passed) AS verify_passed, count(*) FILTER (NOT passed) AS verify_failed, CAST(0 AS BIGINT) AS verify_not_applicable FROM t1 GROUP BY ALL"""
)
def text_variant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, literals, canned answers, apply, verify, summarise."""
    return summary.variant_summary(_t1(spark, sf_dir))


@query(_T1 + " SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(p) AS BIGINT) AS verify_passed FROM (SELECT count(*) AS n, count(*) FILTER (passed) AS p FROM t1 GROUP BY dataset)")
def text_variant_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.variant_summary(_t1(spark, sf_dir), grand=True).where("level = 7").select("total", "verify_passed")


@query(_T1 + " SELECT doc_id, md5(array_to_string(xs, '|')) AS literals_md5, CAST(len(xs) AS BIGINT) AS n, CAST(len(missing) AS BIGINT) AS n_missing, array_to_string(missing, '|') AS missing, CASE WHEN doc_id % 6 = 3 THEN 'parse_failed' WHEN doc_id % 6 = 2 THEN 'refused' WHEN trim(said) = '' THEN 'empty' ELSE 'given' END AS answer_state, passed AS verify_passed FROM t1")
def immutable_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of every rule in order, and those that the answer loses."""
    own = X.once(_t1(spark, sf_dir, literals="xs"), gone=F.transform("verify_missing_items", X.match_key))
    return own.select("doc_id", F.md5(F.array_join("xs", "|")).alias("literals_md5"), F.size("xs").cast("long").alias("n"), F.size("gone").cast("long").alias("n_missing"), F.array_join("gone", "|").alias("missing"), "answer_state", "verify_passed")


@query(A.oracle_ctes("items") + " SELECT id, dataset, md5(regexp_replace(stem, '\\s+$', '')) AS stem_md5, md5(opts) AS options_md5, length(stem) AS n FROM items")
def split_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = X.split_query(F.col("query"))
    return A.items(spark, sf_dir).select("id", "dataset", F.md5(half["stem"]).alias("stem_md5"), F.md5(half["options"]).alias("options_md5"), F.length("stem").cast("long").alias("n"))


@query(
    A.oracle_ctes("items")
    + """ SELECT id, target AS label, CAST(4 AS BIGINT) AS n_options,
    CASE target WHEN 'A' THEN substr(md5(id), 1, 6) WHEN 'B' THEN substr(md5(id), 7, 6) WHEN 'C' THEN substr(md5(id), 13, 6) WHEN 'D' THEN substr(md5(id), 19, 6) END AS answer_text FROM items"""
)
def mcq_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = X.parse_options(F.col("query"))
    label = X.answer_label(F.col("target"))
    answer = F.get(F.filter(options, lambda o: o["label"] == label), 0)["text"]
    return A.items(spark, sf_dir).select("id", label.alias("label"), F.size(options).cast("long").alias("n_options"), answer.alias("answer_text"))


@query(
    A.oracle_ctes("items")
    + """, found AS (SELECT id, list_concat(regexp_extract_all(stem, '<image\\s*\\d+>'), regexp_extract_all(stem, '\\$[^$]+\\$')) AS x FROM items),
    keyed AS (SELECT id, list_distinct(list_transform(x, lambda s: lower(regexp_replace(s, '\\s+', ' ', 'g')))) AS k FROM found)
    SELECT id, CAST(len(k) AS BIGINT) AS n, array_to_string(list_sort(k), '|') AS literals FROM keyed"""
)
def placeholder_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image places and formulas among the immutable literals of whole stems."""
    own = F.filter(X.immutable_literals(F.col("stem")), lambda x: x.startswith("<") | x.startswith("$"))
    told = X.once(A.items(spark, sf_dir), own=own)
    return told.select("id", F.size("own").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("own", X.match_key)), "|").alias("literals"))


@query(
    _T1
    + """ SELECT dataset, field, id, 'T1' AS level, md5(modified) AS query_md5, target, CASE WHEN image IS NULL THEN '' ELSE replace(image, 'image/', 'original_image/') END AS images FROM t1 WHERE passed"""
)
def text_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified variants with the original's images; a later original without a list of images doesn't count."""
    items = A.items(spark, sf_dir)
    later = items.withColumn("image_path", F.lit(None).cast("array<string>")).withColumn("pos", F.col("pos") + 1)
    out = compose.build_text_qa(_t1(spark, sf_dir), items.unionByName(later))
    return out.select("dataset", "field", "id", "level", F.md5("query").alias("query_md5"), "target", F.array_join("image_path", "|").alias("images"))


_IMAGE = "FROM items i JOIN image_labels l ON i.doc_id = l.doc_id WHERE l.label = 'illustration' AND i.image IS NOT NULL AND i.doc_id % 13 <> 0"


def _v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = A.items(spark, sf_dir)
    return compose.build_image_qa(items, A.image_labels(spark, sf_dir), A.manifest(items, "modified_image", 13), "V2")


@query(A.oracle_ctes("items", "image_labels") + f" SELECT i.dataset, i.field, i.id, 'V2' AS level, i.target, replace(i.image, 'image/', 'modified_image/') AS images {_IMAGE}")
def image_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals of one image type with a modified image that exists."""
    return _v2(spark, sf_dir).select("dataset", "field", "id", "level", "target", F.array_join("image_path", "|").alias("images"))


#: An image side whose answers and images are not always those of the text side, with a row that is not the last.
_V = f""", v2 AS (SELECT i.dataset, i.field, i.id, i.doc_id, CASE length(i.stem) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Z' ELSE i.target END AS target, CASE WHEN length(i.stem) % 7 = 0 THEN '' ELSE replace(i.image, 'image/', 'modified_image/') END AS images {_IMAGE}),
    tv AS (SELECT t.dataset, t.field, t.id, t.target, v.images, coalesce(v.target <> t.target, false) AS target_mismatch FROM t1 t JOIN v2 v ON t.doc_id = v.doc_id WHERE t.passed)"""


def _tv(spark: SparkSession, sf_dir: str, buckets: int = 0) -> DataFrame:
    sizes = A.items(spark, sf_dir).select("dataset", "field", "id", F.length("stem").alias("n"))
    v = _v2(spark, sf_dir).join(sizes, compose.KEY)
    target = F.when(F.col("n") % 5 == 0, F.lit(None)).when(F.col("n") % 5 == 1, "Z").otherwise(F.col("target"))
    last = v.withColumn("target", target).withColumn("image_path", F.when(F.col("n") % 7 != 0, F.col("image_path"))).withColumn("pos", F.lit(1))
    first = v.withColumn("target", F.lit("old")).withColumn("pos", F.lit(0))
    text, image = compose.build_text_qa(_t1(spark, sf_dir), A.items(spark, sf_dir)), first.unionByName(last).drop("n")
    if buckets:
        text, image = (_bucketed(df, name, buckets) for df, name in ((text, "text_variants"), (image, "image_variants")))
    return compose.compose_tv(text, image)


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    path = new_table_path(df.sparkSession, name)
    return write_bucketed(df, path.rsplit("/", 1)[1].replace("-", "_"), path, compose.KEY, buckets)


@query(_T1 + _V + " SELECT 'T1V2' AS level, dataset, field, id, target, images, target_mismatch FROM tv")
def composite_tv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and image variants of the same item."""
    return _tv(spark, sf_dir).select("level", "dataset", "field", "id", "target", F.array_join("image_path", "|").alias("images"), "target_mismatch")


@query(_T1 + _V + " SELECT 'T1V2' AS level, dataset, field, id, target, images, target_mismatch FROM tv")
def composite_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored text and image variants with the same buckets: their composites need no exchange."""
    return _tv(spark, sf_dir, buckets=8).select("level", "dataset", "field", "id", "target", F.array_join("image_path", "|").alias("images"), "target_mismatch")


@query(_T1 + _V + " SELECT 'T1V2' AS level, count(*) AS n, count(*) FILTER (target_mismatch) AS target_mismatch, count(*) FILTER (images = '') AS missing_image FROM tv HAVING count(*) > 0")
def composite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.composite_stats(_tv(spark, sf_dir))


@query(
    A.oracle_ctes("items", "forms")
    + r""", t2 AS (SELECT *, CASE WHEN doc_id % 23 = 0 THEN NULL ELSE query END AS q2 FROM forms),
    t4 AS (SELECT id, dataset, field, CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN concat('No options for ', id) ELSE concat('T4 of ', id, chr(10), 'A. p', chr(10), 'B. q') END AS q4, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE plain_target END AS target4 FROM forms),
    cut AS (SELECT *, regexp_matches(q2, '(?m)^[A-Za-z]\.') AS has2, split_part(concat(chr(10), q2), regexp_extract(concat(chr(10), q2), '\n[A-Za-z]\.'), 1) AS before FROM t2)
    SELECT c.dataset, c.field, c.id, 'T2T4' AS level, md5(concat(CASE WHEN NOT has2 OR substr(before, 2) = '' THEN q2 ELSE substr(before, 2) END, chr(10), CASE WHEN contains(q4, 'A. p') THEN concat('A. p', chr(10), 'B. q') ELSE q4 END)) AS query_md5, target4 AS target
    FROM cut c JOIN t4 ON c.id = t4.id AND c.dataset = t4.dataset AND c.field = t4.field WHERE q2 IS NOT NULL AND q4 IS NOT NULL AND target4 IS NOT NULL"""
)
def composite_t2t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of one variant with the options of the last row of the other."""
    own, k = A.forms(spark, sf_dir), F.col("doc_id")
    t2 = own.withColumn("query", F.when(k % 23 != 0, F.col("query"))).withColumn("image_path", F.array().cast("array<string>"))
    text = F.when(k % 29 == 0, F.lit(None)).when(k % 4 == 0, F.concat(F.lit("No options for "), "id")).otherwise(F.concat(F.lit("T4 of "), "id", F.lit("\nA. p\nB. q")))
    last = own.select(*compose.KEY, text.alias("query"), F.when(k % 31 != 0, F.col("plain_target")).alias("target"), F.lit(2).alias("pos"))
    first = own.select(*compose.KEY, F.lit("Old\nA. old").alias("query"), F.lit("old").alias("target"), F.lit(1).alias("pos"))
    out = compose.compose_t2t4(t2, first.unionByName(last))
    return out.select("dataset", "field", "id", "level", F.md5("query").alias("query_md5"), "target")


@query(
    A.oracle_ctes("items", "forms")
    + r""", l AS (SELECT doc_id, query, upper(trim(target)) AS t, list_filter(list_transform(string_split(query, chr(10)), lambda x: regexp_extract(x, '^\s*([A-Z])\.(.+)$', ['k', 'v'])), lambda y: y.k <> '') AS dotted,
      list_transform(regexp_extract_all(replace(replace(query, '(A)', chr(1) || '(A)'), '(B)', chr(1) || '(B)') || chr(1), '\([AB]\)[^' || chr(1) || ']*'), lambda y: {'k': substr(y, 2, 1), 'v': trim(replace(substr(y, 4), '(C)', ''), ' ' || chr(10))}) AS marked FROM forms),
    o AS (SELECT *, list_distinct(list_transform(dotted, lambda y: y.k)) AS ks, CASE WHEN regexp_matches(t, '^[A-Z]([.,:; ].*)?$') THEN substr(t, 1, 1) ELSE '' END AS label FROM l),
    e AS (SELECT doc_id, label, CASE WHEN len(ks) >= 2 THEN CAST(len(ks) AS BIGINT) WHEN len(marked) >= 2 THEN CAST(len(marked) AS BIGINT) ELSE 0 END AS n_options,
      CASE WHEN len(ks) >= 2 THEN trim(list_filter(dotted, lambda y: y.k = label)[-1].v) WHEN len(marked) >= 2 THEN list_filter(marked, lambda y: y.k = label)[-1].v END AS answer_text FROM o)
    SELECT * FROM e"""
)
def option_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options and answers of questions in every form."""
    own = X.once(A.forms(spark, sf_dir), o=X.parse_options(F.col("query")), label=X.answer_label(F.col("target")))
    answer = F.get(F.filter("o", lambda x: x["label"] == F.col("label")), 0)["text"]
    return own.select("doc_id", "label", F.size("o").cast("long").alias("n_options"), answer.alias("answer_text"))


@query(
    A.oracle_ctes("items", "forms")
    + r""" SELECT doc_id, md5(CASE WHEN doc_id % 9 = 6 THEN '' WHEN doc_id % 9 = 3 THEN concat(first, chr(10), 'B.5 volts are left.') WHEN doc_id % 9 = 7 THEN substr(query, 1, strpos(query, chr(10) || 'F. ') - 1) ELSE first END) AS t4_stem_md5, CASE WHEN doc_id % 9 = 4 THEN '' WHEN doc_id % 9 = 6 THEN query WHEN doc_id % 9 = 3 THEN trim(substr(query, strpos(query, '(A)')))
    WHEN doc_id % 9 = 7 THEN substr(query, strpos(query, chr(10) || 'F. ') + 1) ELSE trim(substr(query, length(first) + 1), ' ' || chr(10)) END AS t4_options FROM forms"""
)
def t4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = X.once(A.forms(spark, sf_dir), h=X.split_mcq(F.col("query")))
    return half.select("doc_id", F.md5("h.stem").alias("t4_stem_md5"), F.col("h.options").alias("t4_options"))


@query("""WITH x AS (SELECT item_id, text, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM benchmark)
SELECT item_id, CAST(len(regexp_extract_all(text, '[A-Za-z]+(''[A-Za-z]+)?')) AS BIGINT) AS words, lower(trim(t)) AS match_key FROM x""")
def benchmark_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English word counts and match keys."""
    t = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return t.select("item_id", X.word_count_en(F.col("text")).cast("long").alias("words"), X.match_key(F.col("text")).alias("match_key"))


@query(
    A.oracle_ctes("image_labels")
    + """, k AS (SELECT CASE WHEN doc_id % 2 = 1 THEN 'chemistry' WHEN doc_id % 3 = 0 THEN 'math' WHEN doc_id % 3 = 1 THEN 'physics' END AS subject, label FROM image_labels),
    c AS (SELECT s.subject, count(*) FILTER (label = 'chart') AS chart, count(*) FILTER (label = 'illustration') AS illustration, count(*) FILTER (label = 'Photograph') AS "Photograph",
          count(*) FILTER (label = 'Structure') AS "Structure", count(*) FILTER (label LIKE 'ERROR:%') AS invalid
          FROM (SELECT unnest(['biology', 'chemistry', 'geography', 'materials', 'math', 'physics']) AS subject) s LEFT JOIN k ON s.subject = k.subject GROUP BY s.subject),
    t AS (SELECT * FROM c UNION ALL SELECT 'ALL', CAST(sum(chart) AS BIGINT), CAST(sum(illustration) AS BIGINT), CAST(sum("Photograph") AS BIGINT), CAST(sum("Structure") AS BIGINT), CAST(sum(invalid) AS BIGINT) FROM c)
    SELECT *, chart + illustration + "Photograph" + "Structure" AS total FROM t"""
)
def class_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject by label counts with totals."""
    labels = A.image_labels(spark, sf_dir).select(F.col("subject_key").alias("image_key"), "label")
    return classify.class_matrix(labels)


@query(
    A.oracle_ctes("items", "image_labels")
    + """, s AS (SELECT CASE WHEN coalesce(lower(l.label) <> 'chart', true) OR i.image IS NULL THEN 'skipped_class' WHEN i.doc_id % 13 = 0 THEN 'skipped_missing_image' ELSE 'task' END AS state
    FROM items i LEFT JOIN image_labels l ON i.doc_id = l.doc_id) SELECT state, count(*) AS n FROM s GROUP BY state"""
)
def chart_task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = A.items(spark, sf_dir)
    tasks = variants_image.select_chart_tasks(items, A.image_labels(spark, sf_dir), A.manifest(items, "image", 13))
    return summary.reason_counts(tasks, "state")


@query(
    A.oracle_ctes("items", "image_labels")
    + """, s AS (SELECT CASE WHEN i.image IS NULL THEN 'no_image' WHEN l.label IS NULL THEN 'no_label' WHEN l.label IN ('illustration', 'Photograph') THEN 'selected' ELSE 'other_type' END AS reason,
    CASE WHEN i.image IS NOT NULL AND l.label IN ('illustration', 'Photograph') THEN lower(l.label) END AS image_type
    FROM items i LEFT JOIN image_labels l ON i.doc_id = l.doc_id) SELECT reason, image_type, count(*) AS n FROM s GROUP BY ALL"""
)
def image_task_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = variants_image.select_image_tasks(A.items(spark, sf_dir), A.image_labels(spark, sf_dir))
    return tasks.groupBy("reason", "image_type").agg(F.count("*").alias("n"))


#: What an evaluator and a judge say of a document's text: a score by attempt (or none), whether it rendered, and a verdict by round.
_SAID = """a AS (SELECT doc_id, k AS attempt, CASE WHEN (length(text) + k) % 11 = 0 THEN NULL ELSE (length(text) * 7 + k * 31) % 140 END AS raw, substr(text, k, 1) BETWEEN 'a' AND 't' OR length(text) % 3 = 0 AS render_ok
    FROM documents, (SELECT unnest([1, 2, 3]) AS k)),
    s AS (SELECT *, CASE WHEN raw IS NOT NULL THEN CAST(least(100, raw) AS INTEGER) END AS score, coalesce(render_ok AND raw >= 90, false) AS good FROM a),
    f AS (SELECT doc_id, min(attempt) FILTER (good) AS won FROM s GROUP BY doc_id),
    best AS (SELECT doc_id, coalesce(won, 3) AS attempt, won IS NOT NULL AS success, (SELECT max(s.attempt) FROM s WHERE s.doc_id = f.doc_id AND s.render_ok AND s.attempt <= coalesce(won, 3)) AS seen FROM f)"""


def _evaluated(docs: DataFrame, n: F.Column) -> DataFrame:
    size = F.length("text")
    score = F.concat(F.lit("Looks fine.\nScore: "), ((size * 7 + n * 31) % 140).cast("string"), F.lit("/100"))
    rendered = F.substring("text", n, F.lit(1)).between("a", "t") | (size % 3 == 0)
    return docs.withColumn("raw_evaluation", F.when((size + n) % 11 == 0, "No score given").otherwise(score)).withColumn("render_ok", F.coalesce(rendered, F.lit(False)))


@query(f"WITH {_SAID} SELECT b.doc_id, coalesce(s.score, -1) AS score, b.success, CAST(b.attempt - 1 AS BIGINT) AS retry_times FROM best b LEFT JOIN s ON s.doc_id = b.doc_id AND s.attempt = b.seen")
def chart_best_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    attempts = _evaluated(docs.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(3)))), F.col("attempt")).drop("text")
    best = variants_image.best_attempt(attempts, ["doc_id"])
    return best.select("doc_id", F.coalesce("score", F.lit(-1)).alias("score"), "success", F.col("retry_times").cast("long").alias("retry_times"))


@query(
    f"""WITH {_SAID}, c AS (SELECT b.*, s.score FROM best b LEFT JOIN s ON s.doc_id = b.doc_id AND s.attempt = b.seen)
    SELECT CAST(attempt AS INTEGER) AS attempt, success, count(*) AS n, CAST(sum(score) AS BIGINT) AS score_sum FROM c GROUP BY ALL"""
)
def chart_attempt_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts drawn again until their score passes; only what has not passed goes again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = variants_image.run_chart_attempts(docs, ["doc_id"], lambda left, n: _evaluated(left, F.lit(n)))
    return done.groupBy("attempt", "success").agg(F.count("*").alias("n"), F.sum("score").alias("score_sum"))


_JUDGED = """WITH r AS (SELECT doc_id, k, lower(substr(text, k + 1, 1)) IN ('a', 'e', 'i', 'o', 'u') AND length(text) % 13 <> 0 AS good, length(text) % 13 <> 0 AS ok FROM documents, (SELECT unnest([0, 1, 2]) AS k)),
    w AS (SELECT doc_id, min(k) FILTER (good) AS won, bool_and(ok) AS ok FROM r GROUP BY doc_id)"""


def _edit_rounds(spark: SparkSession, sf_dir: str, folder: str | None = None, asked: list[int] | None = None, stop_at: int | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit(0).alias("retry_times"))

    def step(left: DataFrame, n: int) -> DataFrame:
        if asked is not None:
            asked.append(n)
        if n == stop_at:
            raise InterruptedError(n)
        answer = F.when(F.lower(F.substring("text", n + 1, 1)).isin("a", "e", "i", "o", "u"), ' "No." ').otherwise("Yes, it differs")
        return left.withColumn("ok", F.length("text") % 13 != 0).withColumn("judge_answer", answer)

    return variants_image.run_rounds(docs, step, folder=folder)


_ROUNDS = _JUDGED + " SELECT CAST(coalesce(won, 2) AS INTEGER) AS round_idx, CASE WHEN won IS NULL THEN 'cannot_modify' ELSE 'passed' END AS state, CAST(coalesce(won, 3) AS INTEGER) AS retry_times, count(*) AS n FROM w GROUP BY ALL"


@query(_ROUNDS)
def image_edit_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of edit and verify; what fails goes again, and each failure counts."""
    return _edit_rounds(spark, sf_dir).groupBy("round_idx", "state", "retry_times").agg(F.count("*").alias("n"))


@query(_ROUNDS)
def resumed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds that end early in the middle: the second call takes the complete ones from the folder and asks for the rest only."""
    folder, asked = new_table_path(spark, "resumed_rounds"), []
    try:
        _edit_rounds(spark, sf_dir, folder, asked, stop_at=2)
    except InterruptedError:
        done = _edit_rounds(spark, sf_dir, folder, asked)
    if asked != [0, 1, 2, 2]:
        raise AssertionError(f"rounds were asked for as {asked}")
    return done.groupBy("round_idx", "state", "retry_times").agg(F.count("*").alias("n"))


@query(
    _JUDGED
    + """ SELECT CAST(coalesce(won, 2) AS INTEGER) AS round_idx, count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, count(won) AS passed, CAST(0 AS BIGINT) AS retryable, count(*) FILTER (won IS NULL) AS final FROM w GROUP BY 1"""
)
def image_round_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.round_summary(_edit_rounds(spark, sf_dir))


_OK = "status = 'ok' AND NOT contains(output, '[ERROR]') AND NOT contains(output, 'Error:') AND NOT contains(output, 'Exception:')"


_LAST = A.oracle_ctes("asked", "history") + ", last AS (SELECT model, dataset, id, arg_max(status, attempt) AS status, arg_max(output, attempt) AS output FROM history GROUP BY ALL)"
_PENDING = _LAST + f" SELECT a.model, a.dataset, a.id FROM asked a WHERE NOT EXISTS (SELECT 1 FROM last o WHERE o.model = a.model AND o.dataset = a.dataset AND o.id = a.id AND {_OK})"


@query(_PENDING)
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose last result isn't a good output."""
    return inference.resume_pending(A.asked(spark, sf_dir), A.history(spark, sf_dir), RUN_KEYS, F.col("attempt")).select("model", "dataset", "id")


@query(
    _LAST
    + """, tried AS (SELECT *, status = 'error' AS again FROM last)
    SELECT a.id, a.dataset, coalesce(CASE WHEN again THEN 'ok' ELSE o.status END, 'error') AS status,
    md5(CASE WHEN o.id IS NULL THEN '[ERROR] missing result after resume' WHEN again THEN 'second try' ELSE o.output END) AS output_md5
    FROM asked a LEFT JOIN tried o ON a.model = o.model AND a.dataset = o.dataset AND a.id = o.id"""
)
def merged_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last new result over the last old one, in the items' order of keys; missing ones become error rows."""
    old = A.history(spark, sf_dir).select(*RUN_KEYS, "output", "status", "attempt")
    failed = dedup.keep_last(old, RUN_KEYS, F.col("attempt")).where(F.col("status") == "error")
    tries = F.explode(F.array(F.struct(F.lit(0).alias("attempt"), F.lit("zz first try").alias("output"), F.lit("error").alias("status")), F.struct(F.lit(1).alias("attempt"), F.lit("second try").alias("output"), F.lit("ok").alias("status"))))
    new = failed.select(*RUN_KEYS, tries.alias("t")).select(*RUN_KEYS, "t.output", "t.status", "t.attempt")
    out = inference.merge_outputs(A.asked(spark, sf_dir), old, new, RUN_KEYS, F.col("attempt"))
    return out.select("id", "dataset", "status", F.md5("output").alias("output_md5"))


def _stored_runs(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Outputs stored by run, then later attempts of some, then the same again: nothing changes the second time."""
    path, history = new_table_path(spark, "runs"), A.history(spark, sf_dir)
    runs.upsert(history.where("attempt = 0"), path, RUN_KEYS, F.col("attempt"))
    for _ in range(2):
        runs.upsert(history.where("attempt = 1"), path, RUN_KEYS, F.col("attempt"))
    return path, runs.read_runs(spark, path, history.schema)


@query(_LAST + " SELECT model, dataset, id, status, md5(output) AS output_md5 FROM last")
def stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results of runs of which an update writes only those that it changes."""
    return _stored_runs(spark, sf_dir)[1].select("model", "dataset", "id", "status", F.md5("output").alias("output_md5"))


@query(_PENDING + " AND a.dataset = 'd1'")
def stored_runs_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one set still lacks; only its runs are read."""
    path, stored = _stored_runs(spark, sf_dir)
    asked = A.asked(spark, sf_dir).where("dataset = 'd1'")
    return runs.pending(asked, path, stored.schema, RUN_KEYS, F.col("attempt")).select("model", "dataset", "id")


@query(
    A.oracle_ctes("outputs")
    + """ SELECT source_file, count(*) AS results, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS error, CAST(grouping(source_file) AS INTEGER) AS overall FROM outputs GROUP BY ROLLUP (source_file)"""
)
def output_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.output_summary(A.outputs(spark, sf_dir))


@query(
    A.oracle_ctes("asked", "outputs")
    + """ SELECT regexp_replace(o.model, '^.*/', '') AS model, a.id AS "index", md5(a.query) AS question_md5, a.target AS answer, md5(o.output) AS prediction_md5
    FROM asked a JOIN outputs o ON a.model = o.model AND a.dataset = o.dataset AND a.id = o.id"""
)
def judge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inference.judge_rows(A.outputs(spark, sf_dir), A.asked(spark, sf_dir), RUN_KEYS)
    return rows.select(keys.model_slug(F.col("model")).alias("model"), "index", F.md5("question").alias("question_md5"), "answer", F.md5("prediction").alias("prediction_md5"))


@query("SELECT c.conv_id, c.turn, c.role, md5(coalesce(c.text, '')) AS text_md5 FROM conversations c JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id) m ON c.conv_id = m.conv_id AND c.turn = m.turn")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-last by key."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    last = dedup.keep_last(t, ["conv_id"], F.col("turn"))
    return last.select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query("SELECT doc_id, i, CAST(i % 8 AS INTEGER) AS shard, 42 + (i % 8) * 100000 + i // 8 AS seed FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(coalesce(text, '')), doc_id) - 1 AS i FROM documents)")
def sharded_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards and seeds by consecutive numbers in the order of the texts' digests, numbered without a single task."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    numbered = dedup.dense_index(docs, [F.col("digest"), F.col("doc_id")], "i").drop("digest")
    return dedup.assign_shards(numbered, "i", 8, 42)


@query(
    A.oracle_ctes("items")
    + """, o AS (SELECT id, dataset, target, stem, [substr(md5(id), 1, 6), substr(md5(id), 7, 6), substr(md5(id), 13, 6), substr(md5(id), 19, 6)] AS x FROM items),
    e AS (SELECT id, dataset, target, stem, CASE WHEN target = 'E' THEN NULL ELSE x[ascii(target) - 64] END AS good, list_concat(list_filter(x, lambda v, i: i <> ascii(target) - 64), [concat('extra ', id), 'none of these'], [x[ascii(target) - 64]]) AS every FROM o),
    s AS (SELECT *, list_transform(list_sort(list_transform(every, lambda v, i: {'k': md5(concat('3|', dataset, '|', id, '|', CAST(i - 1 AS VARCHAR))), 'i': i, 't': v})), lambda y: y.t) AS shuffled FROM e)
    SELECT id, CASE WHEN good IS NULL THEN target ELSE chr(CAST(64 + list_position(shuffled, good) AS INTEGER)) END AS answer, good IS NOT NULL AS rebuilt,
    md5(CASE WHEN good IS NULL THEN '' ELSE array_to_string(list_transform(shuffled, lambda v, i: concat(chr(CAST(64 + i AS INTEGER)), '. ', v)), chr(10)) END) AS options_md5 FROM s"""
)
def rebuilt_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options with distractors, shuffled by a seeded hash and labelled anew."""
    items = A.items(spark, sf_dir)
    raw = F.array(F.concat(F.lit("extra "), "id"), F.lit("none of these"), F.concat(F.lit(" EXTRA "), "id", F.lit("  ")))
    items = X.once(items, own=X.parse_options(F.col("query")))
    out = variants_text.rebuild_mcq(items.withColumn("distractors", variants_text.clean_distractors(raw, F.col("own"))), seed=3, options="own")
    # The new question ends with the new options after the old stem, and nothing else.
    lines = F.array_join("new_options", "\n")
    rebuilt = F.col("modified_query").endswith(F.concat(F.lit("\n"), lines)) & (F.col("modified_query") != F.col("query"))
    return out.select("id", F.col("modified_answer").alias("answer"), F.coalesce(rebuilt, F.lit(False)).alias("rebuilt"), F.md5(F.coalesce(lines, F.lit(""))).alias("options_md5"))


#: Two equal quantities in a question, with what a model makes of each in a round; equality is worked out from numbers and factors.
_PAIRS = A.oracle_ctes("items") + r""", n AS (SELECT *, length(stem) % 900 + 1 AS n FROM items),
    q AS (SELECT *, CASE WHEN n % 7 = 0 THEN concat('Nothing here. ', query) ELSE concat('Heat ', n, ' dL now and ', n, ' dL later. ', query) END AS q, n % 7 <> 0 AND n % 11 <> 0 AS has FROM n),
    said AS (SELECT q.*, r, p, CASE WHEN p = 0 THEN CASE (n + r) % 6 WHEN 0 THEN concat(n * 100, ' mL') WHEN 1 THEN concat(n, ' dL') WHEN 2 THEN concat(n, ' L') WHEN 3 THEN concat(n, ' g') WHEN 4 THEN concat(n, '00 cm^3') ELSE '' END
      ELSE CASE (n + r) % 4 WHEN 0 THEN concat(n, '.5 dL') WHEN 1 THEN concat(n, '00 mL') ELSE 'some' END END AS t FROM q, (SELECT unnest([0, 1, 2, 3]) AS r), (SELECT unnest([0, 1]) AS p)),
    pair AS (SELECT *, CASE WHEN t = '' THEN concat(n, ' dL') ELSE t END AS new, t = '' OR t = concat(n, ' dL') OR coalesce(TRY_CAST(regexp_extract(t, '^[0-9.]+') AS DOUBLE) * CASE regexp_extract(t, ' (.*)$', 1) WHEN 'dL' THEN 100 WHEN 'mL' THEN 1 WHEN 'L' THEN 1000 WHEN 'cm^3' THEN 1 END = n * 100, false) AS passed FROM said),
    round AS (SELECT doc_id, id, n, r, query, any_value(q) AS q, any_value(has) AS has, bool_or(passed) AS good, max(CASE WHEN p = 0 AND passed THEN new END) AS a, max(CASE WHEN p = 1 AND passed THEN new END) AS b FROM pair GROUP BY doc_id, id, n, r, query),
    done AS (SELECT *, CASE WHEN n % 11 = 0 THEN NULL WHEN n % 7 = 0 THEN false ELSE good END AS verify_passed, CASE WHEN has AND good THEN concat('Heat ', coalesce(a, n || ' dL'), ' now and ', coalesce(b, n || ' dL'), ' later. ', query) ELSE q END AS new FROM round)"""


def state(verified: str) -> F.Column:
    """The three states of a verification as text."""
    return F.coalesce(F.col(verified).cast("string"), F.lit("n/a")).alias("verify_passed")


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.length("stem") % 900 + 1).alias("n")
    own = A.items(spark, sf_dir).select("*", n).withColumn("can_modify", F.col("n") % 11 != 0)
    amount = F.concat(F.col("n"), F.lit(" dL"))  # a unit that no text has
    question = F.when(F.col("n") % 7 == 0, F.concat(F.lit("Nothing here. "), "query")).otherwise(F.concat(F.lit("Heat "), amount, F.lit(" now and "), amount, F.lit(" later. "), "query"))
    pair = lambda kind, placeholder: F.struct(F.lit(kind).alias("kind"), amount.alias("original"), F.lit(placeholder).alias("placeholder"))
    return own.withColumn("query", question).withColumn("pairs", F.array(pair("Unit", "{PH0}"), pair("unit", "")))


def _rewritten(left: DataFrame, r: int) -> DataFrame:
    n, k = F.col("n"), (F.col("n") + r) % 6
    one = F.when(k == 0, F.concat(n * 100, F.lit(" mL"))).when(k == 1, F.concat(n, F.lit(" dL"))).when(k == 2, F.concat(n, F.lit(" L"))).when(k == 3, F.concat(n, F.lit(" g"))).when(k == 4, F.concat(n, F.lit("00 cm^3"))).otherwise("")
    two = F.when((n + r) % 4 == 0, F.concat(n, F.lit(".5 dL"))).when((n + r) % 4 == 1, F.concat(n, F.lit("00 mL"))).otherwise("some")
    return left.withColumn("transformed", F.array(one, two))


@query(_PAIRS + " SELECT id, coalesce(CAST(verify_passed AS VARCHAR), 'n/a') AS verify_passed, new <> q AS text_changed, md5(new) AS query_md5 FROM done WHERE r = 0")
def equivalent_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantity in other units is taken if it is equal, else the original stays."""
    out = variants_text.apply_t2(_rewritten(_quantities(spark, sf_dir), 0))
    return out.select("id", state("verify_passed"), "text_changed", F.md5("modified_query").alias("query_md5"))


@query(
    _PAIRS
    + """, last AS (SELECT doc_id, coalesce(min(r) FILTER (good OR NOT has), 3) AS r FROM done GROUP BY doc_id)
    SELECT d.id, coalesce(CAST(d.verify_passed AS VARCHAR), 'n/a') AS verify_passed, CAST(d.r AS INTEGER) AS retry_times, md5(d.new) AS query_md5 FROM done d JOIN last l ON d.doc_id = l.doc_id AND d.r = l.r"""
)
def equivalent_rewrite_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 asked again while every pair of an item fails, three times at most."""
    out = variants_text.run_t2_rounds(_quantities(spark, sf_dir), _rewritten)
    return out.select("id", state("verify_passed"), "retry_times", F.md5("modified_query").alias("query_md5"))


@query(
    A.oracle_ctes("items")
    + """, ref AS (SELECT 'term ' || CAST(page_id % 50 AS VARCHAR) AS term_key, min(md5(coalesce(html, ''))) AS summary FROM pages GROUP BY 1)
    SELECT i.id, r.summary IS NOT NULL AS verify_passed, CASE WHEN r.summary IS NOT NULL THEN concat('(', CASE WHEN i.doc_id % 60 % 3 = 0 THEN 'Term   ' || CAST(i.doc_id % 60 AS VARCHAR) ELSE 'ref' END, '): ', r.summary) END AS context FROM items i LEFT JOIN ref r ON r.term_key = 'term ' || CAST(i.doc_id % 60 AS VARCHAR)"""
)
def background_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords looked up in a reference table; the first usable block is the context."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    term = F.concat(F.lit("term "), (F.col("page_id") % 50).cast("string"))
    title = F.when(F.col("page_id") % 50 % 3 != 0, "ref")  # where there is none, the term that was looked up stands in
    reference = pages.select(term.alias("term_key"), title.alias("title"), F.md5(F.coalesce("html", F.lit(""))).alias("summary"))
    items = A.items(spark, sf_dir).withColumn("words", F.array(F.lit("unknown thing"), F.concat(F.lit("  Term   "), (F.col("doc_id") % 60).cast("string")), F.lit("third")))
    blocks = variants_text.lookup_terms(items, reference, ["dataset", "id"], "words", 2)
    joined = items.join(blocks, ["dataset", "id"], "left").withColumn("can_modify", F.lit(True)).withColumn("background", F.lit(""))
    return variants_text.apply_t3(joined).select("id", "verify_passed", "context")


@query(
    A.oracle_ctes("items", "image_labels")
    + """ SELECT i.id, coalesce(l.label LIKE 'ERROR:%', false) AS again FROM items i LEFT JOIN image_labels l ON i.doc_id = l.doc_id WHERE i.image IS NOT NULL AND (l.label IS NULL OR l.label LIKE 'ERROR:%')"""
)
def classification_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that have no label yet, and those to be tried again."""
    items = A.items(spark, sf_dir).where(F.col("image").isNotNull()).select("id", F.col("image").alias("image_key"))
    labels = A.image_labels(spark, sf_dir).select("image_key", "label")
    new = classify.pending(items, labels, ["image_key"]).select("id", F.lit(False).alias("again"))
    return new.unionByName(classify.retry_errors(items, labels, ["image_key"]).select("id", F.lit(True).alias("again")))


@query(A.oracle_ctes("items") + " SELECT id, md5(concat(replace(stem, 'Take', 'Use'))) AS text_md5, contains(stem, 'Take') AS first_applied FROM (SELECT id, concat('Take ', replace(stem, 'Take', 'Put')) AS stem FROM items)")
def ordered_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-occurrence edits in turn over whole stems."""
    items = A.items(spark, sf_dir).withColumn("stem", F.concat(F.lit("Take "), F.replace(F.col("stem"), F.lit("Take"), F.lit("Put"))))
    edits = F.array(F.struct(F.lit("Take").alias("old"), F.lit("Use").alias("new")), F.struct(F.lit("no such text at all").alias("old"), F.lit("x").alias("new")))
    done = folds.apply_replacements(F.col("stem"), edits)
    return items.select("id", F.md5(done["text"]).alias("text_md5"), F.get(done["applied"], 0).alias("first_applied"))


@query(
    A.oracle_ctes("items")
    + """ SELECT id, dataset, CASE WHEN length(query) % 10 = 9 THEN '[ERROR] no answer' ELSE substr('ABCD', CAST(length(concat('Answer with one letter.', chr(10), chr(10), query)) % 4 + 1 AS INTEGER), 1) END AS output, CASE WHEN length(query) % 10 = 9 THEN 'error' ELSE 'ok' END AS status FROM items"""
)
def scored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring boundary with a deterministic stand-in for a model."""
    requests = inference.build_requests(A.items(spark, sf_dir), "original", "Answer with one letter.").select("id", "dataset", "prompt")

    def scorer():
        def answer(prompt: str) -> str:
            if (len(prompt) - 25) % 10 == 9:
                raise ValueError("no answer")
            return "ABCD"[len(prompt) % 4]

        return answer

    return inference.infer(requests, scorer).select("id", "dataset", "output", "status")


@query(
    A.oracle_ctes("items")
    + """ SELECT id, dataset, CASE WHEN length(query) % 10 = 9 THEN '[ERROR] never' ELSE concat(substr(query, 1, 20), '...') END AS output, CASE WHEN length(query) % 10 = 9 THEN 'error' ELSE 'ok' END AS status FROM items"""
)
def scored_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts in batches, several in flight; a batch that fails is tried again, and one that keeps failing is error rows."""
    items = A.items(spark, sf_dir).select("id", "dataset", "query")

    def scorer():
        tried: set[tuple[str, ...]] = set()

        def answer(prompts: list[str]) -> list[str]:
            if len(prompts[0]) % 3 == 0 and tuple(prompts) not in tried:
                tried.add(tuple(prompts))
                raise ConnectionError("busy")
            if any(len(p) % 10 == 9 for p in prompts):
                raise ValueError("never")
            return [f"{p[:20]}..." for p in prompts]

        return answer

    # Rows that always fail have batches of their own, so that they take no others with them.
    never = F.length("query") % 10 == 9
    limits = Limits(in_flight=8, batch=16, retries=2, back_off=0.001)
    out = inference.infer(items.where(~never), scorer, limits, prompt="query").unionByName(inference.infer(items.where(never), scorer, limits, prompt="query"))
    return out.select("id", "dataset", "output", "status")


#: Quantities in two units whose factors to a common one are known, the second a step off for some.
_UNIT_FORMS = (
    ("hPa", 100.0, "Pa", 1.0), ("t", 1000.0, "kg", 1.0), ("inch", 2.54, "cm", 1.0), ("kJ/(mol*K)", 1000.0, "J/mol/K", 1.0), ("kohm", 1000.0, "\u03a9", 1.0), ("%", 1.0, "percent", 1.0),
    ("W/(m^2*(K/s))", 1.0, "W*m^-2*s/K", 1.0), ("mT", 1.0, "mWb/m^2", 1.0), ("mmHg", 133.322387415, "Pa", 1.0), ("km/h", 1.0, "m/(3.6 s)", 0.0),
)


@query(
    """WITH f AS (SELECT unnest(["""
    + ", ".join(f"{{'k': {k}, 'fa': {a!r}, 'fb': {b!r}}}" for k, (_, a, _, b) in enumerate(_UNIT_FORMS))
    + """]) AS f), n AS (SELECT doc_id, length(coalesce(text, '')) % 900 + 1 AS n, length(coalesce(text, '')) % 10 AS k FROM documents)
    SELECT doc_id, f.fb > 0 AND abs(n * f.fa - CASE WHEN n % 2 = 0 THEN n * f.fa ELSE n * f.fa + 0.5 END * f.fb) <= 1e-9 * n * f.fa AS equal FROM n JOIN f ON f.k = n.k"""
)
def unit_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities with brackets, powers, prefixes and units outside the base ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.length(F.coalesce("text", F.lit("")))
    n, k = size % 900 + 1, size % 10
    pick = lambda make: F.coalesce(*[F.when(k == i, make(*form)) for i, form in enumerate(_UNIT_FORMS)])
    one = F.concat(n.cast("string"), F.lit(" "), pick(lambda a, fa, b, fb: F.lit(a)))
    value = pick(lambda a, fa, b, fb: F.when(n % 2 == 0, n * fa).otherwise(n * fa + 0.5))
    two = F.concat(value.cast("string"), F.lit(" "), pick(lambda a, fa, b, fb: F.lit(b)))
    return docs.select("doc_id", X.unit_equal(one, two).alias("equal"))


@query(
    """WITH d AS (SELECT doc_id, length(text) % 9 + 2 AS a, length(text) % 4 + 2 AS b, length(text) % 5 + 2 AS c, length(text) % 3 AS k FROM documents)
    SELECT doc_id, concat('Al:', a, '|H:', 2 * c, '|O:', 4 * b + c, '|S:', b) AS elements, k <> 2 AS equal FROM d"""
)
def grouped_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas with groups and water of crystallisation, against the same atoms one by one."""
    n = F.length("text")
    a, b, c = ((n % m + 2) for m in (9, 4, 5))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    one = said("$Al_{", a, "}(SO_4)_{", b, "}\u00b7", c, "H_2O$")
    two = F.when(n % 3 == 0, said("Al", a, "[SO4]", b, "(H2O)", c)).when(n % 3 == 1, said("H", 2 * c, "S", b, "O", 4 * b + c, "Al", a)).otherwise(said("Al", a, "(SO4)", b))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.array_join(X.element_counts(X.chem_key(one)), "|").alias("elements"), X.pair_equal(F.lit("chem"), one, two).alias("equal"))
