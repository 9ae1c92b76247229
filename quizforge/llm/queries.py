"""The queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizforge.llm import collocations, decontaminate, html_blocks, line_quality, line_templates, packing, quality_mil, resample, secrets, simhash, token_counts, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines, dropped = line_templates.count_names(docs)
    out = line_templates.drop_recurring_lines(docs)
    return out.select("doc_id", F.col(lines).alias("n_lines"), F.col(dropped).alias("n_dropped"), "text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.apply_rules(table(spark, sf_dir, "documents"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OPERATORS = (
    op1_line_templates, op2_token_counts, op3_decontaminate, op4_simhash, op5_line_quality,
    op6_harmonic_packing, op7_attention_quality, op8_html_blocks, op9_warc, op10_toxicity,
    op11_secret_scan, op12_collocations, op13_resample,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_line_templates": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body, text FROM documents),
raw AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM docs),
parsed AS (SELECT doc_id, pos, string_split(regexp_replace(trim(regexp_replace(lower(line), '[ \t\r\x0b\f]+', ' ', 'g'), ' '), '[^\s0-9]*[0-9]\S*', '<*>', 'g'), ' ') AS t FROM raw),
counted AS (SELECT *, len(t) AS n, greatest(len(t) - 4, 0) AS m FROM parsed WHERE len(t) >= 3),
cut AS (SELECT *, [array_to_string(t[5 + m * s // 4 : 4 + m * (s + 1) // 4], ' ') FOR s IN [0, 1, 2, 3]] AS seg, array_to_string(t[1:4], ' ') AS lead FROM counted),
forms AS (
  SELECT doc_id, pos, n || '|' || lead || '|-1|' || array_to_string(seg, '|') AS form FROM cut
  UNION ALL
  SELECT doc_id, pos, n || '|' || lead || '|' || k || '|' || array_to_string([seg[i] FOR i IN [1, 2, 3, 4] IF i <> k], '|') FROM cut, range(1, 5) r(k) WHERE n >= 12),
frequent AS (SELECT form, min({'d': doc_id, 'p': pos}) AS first FROM forms GROUP BY form HAVING count(DISTINCT doc_id) >= 5),
dropped AS (SELECT DISTINCT f.doc_id, f.pos FROM forms f JOIN frequent q ON f.form = q.form WHERE NOT (f.doc_id = q.first.d AND f.pos = q.first.p)),
per_doc AS (SELECT r.doc_id, count(*) AS n_lines, count(x.pos) AS n_dropped, coalesce(string_agg(r.line, chr(10) ORDER BY r.pos) FILTER (x.pos IS NULL), '') AS kept
            FROM raw r LEFT JOIN dropped x ON r.doc_id = x.doc_id AND r.pos = x.pos GROUP BY r.doc_id)
SELECT p.doc_id, p.n_lines, p.n_dropped, CASE WHEN p.n_dropped = 0 THEN d.text ELSE p.kept END AS text FROM per_doc p JOIN docs d ON p.doc_id = d.doc_id
""",
    "op5_line_quality": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body, source FROM documents),
w AS (SELECT doc_id, body, source, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM docs),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(0, 3) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, unnest(string_split(body, chr(10))) AS line FROM docs),
worded AS (SELECT doc_id, source, line, [translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FOR x IN regexp_extract_all(line, '[^\x20\x09-\x0D]+')] AS lw FROM lines),
full_lines AS (SELECT * FROM worded WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY doc_id),
frequent AS (SELECT source, lw FROM full_lines GROUP BY source, lw HAVING count(DISTINCT doc_id) > 50),
gone AS (SELECT l.doc_id, CAST(sum(len(l.lw)) AS BIGINT) AS n_removed FROM full_lines l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.lw = f.lw GROUP BY l.doc_id),
base AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) - coalesce(n_removed, 0) AS n_left
  FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN gone ON w.doc_id = gone.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left >= 0.5 * n_words AS kept FROM base
""",
    "op11_secret_scan": r"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
pattern AS (SELECT * FROM (VALUES
  (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'AKIA[A-Z0-9]{16,}'), (2, '[0-9a-f]{24,}'), (3, '[A-Za-z0-9+/_=-]{20,}')) p(kind, re)),
cut AS (SELECT doc_id, source, kind, re, string_split(regexp_replace(body, '(' || re || ')', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS segs FROM docs, pattern WHERE regexp_matches(body, re)),
seg AS (SELECT doc_id, source, kind, re, unnest(segs) AS seg, generate_subscripts(segs, 1) AS i FROM cut),
placed AS (SELECT *, CAST(sum(length(replace(seg, chr(2), ''))) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) - length(replace(seg, chr(2), '')) AS s FROM seg),
hit AS (SELECT doc_id, source, kind, s, s + length(split_part(seg, chr(2), 1)) AS e, CASE WHEN kind = 0 THEN regexp_extract(split_part(seg, chr(2), 1), re, 2) ELSE split_part(seg, chr(2), 1) END AS v FROM placed WHERE i > 1),
base AS (SELECT * FROM hit WHERE kind IN (1, 2) OR (kind = 0 AND length(v) >= 6)),
opaque AS (SELECT * FROM hit h WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.s < h.e AND b.e > h.s)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
owned AS (SELECT v FROM (SELECT v, source, count(*) AS n FROM (SELECT DISTINCT v, source, doc_id FROM spans) GROUP BY v, source) GROUP BY v HAVING count(*) <= 1 AND sum(n) <= 3),
judged AS (SELECT s.*, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || s || ':' || e AS said, o.v IS NOT NULL AS rare,
  o.v IS NOT NULL AND len(list_distinct(string_split(s.v, ''))) >= 8 AND regexp_matches(s.v, '[0-9]') AND regexp_matches(s.v, '[A-Za-z]') AS live FROM spans s LEFT JOIN owned o ON s.v = o.v),
per_doc AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(said, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY s, kind) FILTER (kind < 3 OR live) AS spans, string_agg(said, ',' ORDER BY s, kind) FILTER (live) AS live_spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (kind < 3 AND NOT rare) AS n_examples FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(live_spans, '') AS live_spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples FROM docs d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
""",
    "op12_collocations": r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, size, unnest([array_to_string(w[i : i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS phrase FROM words, range(1, 6) s(size)),
freq AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE size >= 2),
inside AS (SELECT lang, f, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, a AS f, w, size, unnest(range(2, size)) AS k FROM cand), range(1, 5) r(i) WHERE i + k - 1 <= size),
kept AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 100 * c.a)),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : size], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, CAST(1000::HUGEINT * c.a * t.n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
           FROM cuts c JOIN freq x ON x.lang = c.lang AND x.phrase = c.head JOIN freq y ON y.lang = c.lang AND y.phrase = c.tail JOIN total t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM lowest QUALIFY rank <= 2000
""",
    "op13_resample": r"""
WITH polynomial AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
texts AS (SELECT 0 AS target, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (SELECT target, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
vocabulary AS (SELECT word, hex(word) AS h FROM (SELECT DISTINCT word FROM words)),
bytes AS (SELECT word, [CAST(16 * (strpos('0123456789ABCDEF', h[2 * i - 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i]) - 1 AS BIGINT) FOR i IN range(1, len(h) // 2 + 1)] AS b FROM vocabulary),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, polynomial),
counted AS (SELECT target, id, bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY ALL),
s AS (SELECT bucket, sum(n) FILTER (target = 0) AS s, sum(n) FILTER (target = 1) AS t FROM counted GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (coalesce((SELECT sum(s) FROM s), 0) + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * (coalesce((SELECT sum(t) FROM s), 0) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM s),
per_doc AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM counted JOIN gains USING (bucket) WHERE target = 0 GROUP BY id),
noise AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, [CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT) FOR c IN string_split(sha256('2024:' || doc_id)[1:8], '')]), lambda x, y: 16 * x + y) AS h FROM documents),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
           FROM noise LEFT JOIN per_doc ON doc_id = id),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS total FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * total // 100 THEN place END AS rank FROM scored s LEFT JOIN able a ON s.doc_id = a.doc_id
""",
}
