"""Question-set tables derived from the given tables by expressions that Spark and DuckDB evaluate alike.

Each is one SQL text with the table names as parameters: Spark runs it over DataFrames, the oracles over views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = """
SELECT doc_id, source AS dataset, lang AS field, concat('s', CAST(doc_id % 3 AS STRING)) AS subject,
       CAST(doc_id AS STRING) AS id, doc_id AS pos, stem, opts, concat(stem, chr(10), opts) AS query,
       chr(CAST(65 + doc_id % 5 AS INT)) AS target,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE concat('image/', source, '/', CAST(doc_id AS STRING), '.png') END AS image
FROM (
  SELECT doc_id, source, lang,
         concat('Q: ', replace(coalesce(text, ''), chr(10), ' '), ' Take ', CAST(doc_id % 90 + 1 AS STRING), ' mL of $x_', CAST(doc_id % 7 AS STRING), '$ in <image ', CAST(doc_id % 3 AS STRING), '>.') AS stem,
         concat('A. ', substr(md5(CAST(doc_id AS STRING)), 1, 6), chr(10), 'B. ', substr(md5(CAST(doc_id AS STRING)), 7, 6), chr(10),
                'C. ', substr(md5(CAST(doc_id AS STRING)), 13, 6), chr(10), 'D. ', substr(md5(CAST(doc_id AS STRING)), 19, 6)) AS opts
  FROM {documents})
"""

LABELS = """
SELECT l.doc_id, concat(CASE WHEN l.doc_id % 2 = 0 THEN 'MMMU/' ELSE 'EMMA/' END, CASE l.doc_id % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'Physics' ELSE 'art' END, '/', CAST(l.doc_id AS STRING), '.png') AS subject_key,
       concat('image/', d.source, '/', CAST(l.doc_id AS STRING), '.png') AS image_key,
       CASE WHEN l.doc_id % 17 = 0 THEN 'ERROR: timeout' WHEN l.quality = 1 AND l.toxic = 0 THEN 'illustration' WHEN l.quality = 1 THEN 'Photograph'
            WHEN l.toxic = 0 THEN 'chart' ELSE 'Structure' END AS label
FROM (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM {labels} GROUP BY doc_id) l JOIN {documents} d ON l.doc_id = d.doc_id
"""

OUTPUTS = """
SELECT concat('org/model-', CAST(conv_id % 3 AS STRING)) AS model, concat('d', CAST(conv_id % 5 AS STRING)) AS dataset, 'T1' AS action, 'r1' AS run_tag,
       concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id, concat('f', CAST(conv_id % 5 AS STRING), '.json') AS source_file, turn,
       CASE WHEN conv_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN conv_id % 13 = 0 THEN concat('Error: ', coalesce(text, '')) ELSE coalesce(text, '') END AS output
FROM {conversations} WHERE role = 'assistant'
"""

#: Outputs and the later attempts of some: an error or another output, under the same id.
HISTORY = """
SELECT model, dataset, action, run_tag, id, source_file, status, output, 0 AS attempt FROM ({outputs})
UNION ALL
SELECT model, dataset, action, run_tag, id, source_file, CASE WHEN length(output) % 3 = 0 THEN 'error' ELSE 'ok' END AS status, concat('again ', output) AS output, 1 AS attempt FROM ({outputs}) WHERE length(output) % 4 = 1
"""

ASKED = """
SELECT concat('org/model-', CAST(conv_id % 3 AS STRING)) AS model, concat('d', CAST(conv_id % 5 AS STRING)) AS dataset, 'T1' AS action, 'r1' AS run_tag,
       concat(CAST(conv_id AS STRING), '-', CAST(turn + 1 AS STRING)) AS id, concat('f', CAST(conv_id % 5 AS STRING), '.json') AS source_file,
       coalesce(text, '') AS query, chr(CAST(65 + conv_id % 4 AS INT)) AS target
FROM {conversations} WHERE role = 'user'
"""


#: Items in ASCII, with literals of every rule; ``said`` is what a model answers, which may lose some of them.
PLAIN = """
SELECT doc_id, dataset, field, subject, id, pos, image, target, stem, opts, concat(stem, chr(10), opts) AS query,
       CASE doc_id % 6 WHEN 0 THEN concat('In other words: ', stem) WHEN 1 THEN replace(replace(stem, 'NaOH', 'lye'), 'pH', 'acidity') WHEN 4 THEN lower(replace(stem, ' mL', 'ml')) ELSE '' END AS said
FROM (
  SELECT doc_id, dataset, field, subject, id, pos, image, target, opts,
         concat(trim(regexp_replace(stem, '[^ -~]', 'x'{all})), CASE doc_id % 4 WHEN 0 THEN ' Add 2.5 mol of NaOH and acetic acid.' WHEN 1 THEN ' Read the pH at the Equivalence  Point of 12 kg or 12 kg.' WHEN 2 THEN ' See <IMAGE 7> and $a  b$ or $A b$.' ELSE '' END) AS stem
  FROM ({items}))
"""

#: Questions in every form that a split can meet, over the items' own texts.
FORMS = """
SELECT doc_id, dataset, field, id, target AS plain_target, first,
       CASE doc_id % 9 WHEN 0 THEN concat(first, chr(10), 'A. ', w1, chr(10), 'B. ', w2)
                       WHEN 1 THEN concat(first, chr(10), '  A. ', w1, chr(10), '  B. ', w2, chr(10), '  A. ', w3)
                       WHEN 2 THEN concat(first, ' (A) ', w1, ' (x) (B) ', w2, ' (C)  ')
                       WHEN 3 THEN concat(first, chr(10), 'B.5 volts are left.', chr(10), '(A) ', w1, chr(10), '(B) ', w2)
                       WHEN 4 THEN first
                       WHEN 5 THEN concat(first, chr(10), 'A. ', w1)
                       WHEN 6 THEN concat('A. ', w1, chr(10), 'B. ', w2)
                       WHEN 7 THEN concat(first, chr(10), chr(10), 'a. ', w1, chr(10), 'F. ', w2, chr(10), 'G. ', w3)
                       ELSE concat(first, chr(10), 'A. ', w1, chr(10), 'B.', chr(10), 'C. ', w3) END AS query,
       CASE doc_id % 7 WHEN 0 THEN 'B' WHEN 1 THEN 'b' WHEN 2 THEN concat('B. ', w2) WHEN 3 THEN 'B, or so' WHEN 4 THEN '(B)' WHEN 5 THEN concat(' a ', w1) ELSE 'BC' END AS target
FROM (SELECT doc_id, dataset, field, id, target, trim(regexp_replace(stem, '[^ -~]', 'x'{all})) AS first,
             substr(md5(stem), 1, 5) AS w1, substr(md5(stem), 6, 5) AS w2, substr(md5(stem), 11, 5) AS w3 FROM ({items}))
"""


def _filled(sql: str, tables: dict[str, str], every: str) -> str:
    """The text with its tables; ``every`` is what makes regexp_replace replace all."""
    return sql.replace("{items}", ITEMS).replace("{outputs}", OUTPUTS).replace("{all}", every).format(**tables)


def oracle_ctes(*names: str) -> str:
    """``WITH`` and the named tables for DuckDB."""
    every = {"items": ITEMS, "image_labels": LABELS, "outputs": OUTPUTS, "history": HISTORY, "asked": ASKED, "plain": PLAIN, "forms": FORMS}
    tables = {t: t for t in ("documents", "labels", "conversations")}
    return "WITH " + ", ".join(f"{n} AS ({_filled(every[n], tables, ", 'g'")})" for n in names)


def _sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql.replace("{items}", ITEMS).replace("{outputs}", OUTPUTS).replace("{all}", ""), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_images(_sql(spark, sf_dir, ITEMS, "documents"))


def image_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, LABELS, "labels", "documents")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, OUTPUTS, "conversations")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, HISTORY, "conversations")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, ASKED, "conversations")


def manifest(items: DataFrame, prefix: str, missing: int) -> DataFrame:
    """Image files under ``prefix``; those of every ``missing``-th item are not there."""
    there = items.where(F.col("image").isNotNull() & (F.col("doc_id") % missing != 0))
    return there.select(F.regexp_replace("image", "^image/", prefix + "/").alias("path"))


def _with_images(own: DataFrame) -> DataFrame:
    return own.withColumn("image_path", F.when(F.col("image").isNull(), F.array().cast("array<string>")).otherwise(F.array("image")))


def plain_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_images(_sql(spark, sf_dir, PLAIN, "documents"))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, FORMS, "documents")


def t1_responses(items: DataFrame) -> DataFrame:
    """Model answers around ``said``: in prose, under the other name, a refusal with a checklist, no JSON, with a checklist, and empty."""
    k = F.col("doc_id") % 6
    flag = lambda value: F.lit(value).alias("can_modify")
    good = F.concat(F.lit("Sure: "), F.to_json(F.struct(flag(True), F.lit("a decoy").alias("modified_query"), F.col("said").alias("modified_query_text"))), F.lit(" Done."))
    other = F.to_json(F.struct(flag(True), F.col("said").alias("modified_query")))
    checklist = F.array(F.lit("naoh"), F.lit("no such thing"), F.lit("12  KG")).alias("return_checklist")
    listed = F.to_json(F.struct(flag(True), F.col("said").alias("modified_query_text"), checklist))
    refusal = F.to_json(F.struct(flag(False), F.lit("anything").alias("modified_query_text"), checklist))
    empty = F.to_json(F.struct(flag(True), F.lit("  ").alias("modified_query_text")))
    response = F.when(k == 0, good).when(k == 1, other).when(k == 2, refusal).when(k == 3, "{no answer").when(k == 4, listed).otherwise(empty)
    return items.withColumn("response", response)
