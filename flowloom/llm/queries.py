"""Registered queries of this subpackage, with production parameters over whole tables, and their DuckDB statements."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.bpe import Shared, bpe_encode
from flowloom.llm.decontaminate import find_leaks
from flowloom.llm.exact_dedup import exact_groups
from flowloom.llm.filter_audit import contingency, failures, interactions
from flowloom.llm.labelled import fold
from flowloom.llm.license_scan import license_report, scan_licenses
from flowloom.llm.quality import CUT, score_quality, train_quality
from flowloom.llm.quality_rules import BOILERPLATE, CELL_MARKS, LINE_ENDS, MAX_LOST, NOISE, NOTICE_CHARS, SYMBOLS, clean_lines
from flowloom.llm.resample import draw, importance_weights
from flowloom.llm.simhash import near_groups
from flowloom.llm.substring_dedup import repeated_spans, without_spans
from flowloom.llm.token_counts import context_totals, length_histogram
from flowloom.llm.toxicity import score_toxicity, train_toxicity
from flowloom.llm.url_filter import filter_urls

VOCABULARY = "byte_bpe_50k.json"

#: Rules of the url query; fixed values.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("row.page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule
  FROM u)
"""


def _vocabulary(spark: SparkSession) -> Shared:
    return Shared(spark, public_tokenizers.path(VOCABULARY))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, number of tokens, and digests of the ids and of the text decoded from them."""
    both = bpe_encode(docs.select("doc_id", "text"), _vocabulary(docs.sparkSession), decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def _judged(scored: DataFrame, cut: float) -> DataFrame:
    held_out = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return scored.select("row.doc_id", "score").select(
        "doc_id", held_out, "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(score_toxicity(docs, train_toxicity(docs, _table(spark, sf_dir, "labels"))), 0.5)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode(_table(spark, sf_dir, "documents").select("text"), _vocabulary(spark))
    lengths = coded.select(F.size("ids").alias("n_tokens"))
    return context_totals(length_histogram(lengths))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    kept = without_spans(docs, repeated_spans(docs))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM g WHERE i + 49 <= len(w)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM s),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM m WHERE least < doc_id),
k AS (
  SELECT g.doc_id, count(r.i) AS n_removed,
         string_agg(g.w[g.i], ' ' ORDER BY g.i) FILTER (WHERE r.i IS NULL) AS kept
  FROM g LEFT JOIN r ON g.doc_id = r.doc_id AND g.i = r.i GROUP BY g.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(scan_licenses(_table(spark, sf_dir, "documents"))).drop("spans")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(score_quality(docs, train_quality(docs, _table(spark, sf_dir, "labels"))), CUT)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(contingency(failures(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
f AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
                regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS tox
  FROM w LEFT JOIN labels USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (tox) AS x FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a),
o AS (
  SELECT p.a || q.a || r.a || s.a || t.a AS filter_order
  FROM l p JOIN l q ON q.a <> p.a JOIN l r ON r.a NOT IN (p.a, q.a) JOIN l s ON s.a NOT IN (p.a, q.a, r.a)
  JOIN l t ON t.a NOT IN (p.a, q.a, r.a, s.a)),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM o),
e AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, g, x,
         fails[strpos('ABCDE', substr(filter_order, step, 1))] AS here,
         len(list_filter(range(1, step), lambda i: fails[strpos('ABCDE', substr(filter_order, i::INTEGER, 1))])) > 0 AS gone,
         len(list_filter(fails, lambda v: v)) AS n_fails
  FROM c, s),
r AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND here), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND n_fails = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(g) FILTER (NOT gone AND here), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (NOT gone AND here), 0)::BIGINT AS toxic_lost
  FROM e GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(_table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "lost_chars")


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


OP12_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
i AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE n > 1) GROUP BY doc_id),
x AS (SELECT doc_id, unnest(lines) AS x FROM d),
y AS (
  SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, right(regexp_replace(x, '[\x20\x09-\x0D]+$', ''), 1) AS last FROM x),
z AS (
  SELECT doc_id, length(x) AS size, len(w) AS n, last,
         length(x) <= {NOTICE_CHARS} AND len(list_filter({_sql_list(BOILERPLATE)}, lambda p: contains(lower(x), p))) > 0 AS notice,
         len(list_filter(w, lambda v: regexp_full_match(v, '[{''.join(CELL_MARKS)}]+'))) AS cells,
         len(list_filter(w, lambda v: right(v, 3) IN ({_sql_list([m for m in NOISE if len(m) == 3])[1:-1]}) OR right(v, 2) = '!!')) AS noisy
  FROM y),
c AS (
  SELECT doc_id, sum(size) AS line_chars, sum(size) FILTER (
           notice OR (cells >= 2 AND 4 * cells >= n) OR (noisy >= 2 AND 3 * noisy >= n) OR last NOT IN ({_sql_list(LINE_ENDS)[1:-1]})) AS lost
  FROM z GROUP BY doc_id),
b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS chars,
         len(regexp_extract_all(t, '[{SYMBOLS}]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= {MAX_LOST} * line_chars AS kept, line_chars, lost_chars
FROM b
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = importance_weights(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return draw(weighted).select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH table_of AS (
  SELECT list(list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS step
  FROM range(256) AS t(b)),
texts AS (SELECT 'd' AS kind, doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 't', item_id, coalesce(text, '') FROM benchmark),
words AS (
  SELECT kind, doc_id, regexp_extract_all(
    translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (
  SELECT kind, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
unlike AS (
  SELECT f, xor(list_reduce(
    [4294967295] || list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i::INTEGER - 1, 2))::BIGINT),
    lambda c, v: xor(step[1 + (xor(c, v) & 255)], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), table_of),
b AS (SELECT kind, doc_id, bucket, count(*) AS n FROM features JOIN unlike USING (f) GROUP BY ALL),
s AS (SELECT bucket, sum(n) FILTER (kind = 'd') AS s, sum(n) FILTER (kind = 't') AS t FROM b GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM s),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE
                                 / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM s, whole),
m AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM b JOIN g USING (bucket) WHERE kind = 'd' GROUP BY doc_id),
v AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
         coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT AS h
  FROM words w LEFT JOIN m USING (doc_id) WHERE w.kind = 'd'),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM v),
q AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS able FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM q
"""


QUERIES = {"op1_url_filter": op1_url_filter, "op2_substring_dedup": op2_substring_dedup, "op3_license_scan": op3_license_scan,
           "op4_decontaminate": op4_decontaminate, "op5_bpe": op5_bpe,
           "op6_toxicity": op6_toxicity,
           "op7_token_counts": op7_token_counts, "op8_exact_dedup": op8_exact_dedup, "op9_quality": op9_quality, "op10_simhash": op10_simhash,
           "op11_filter_audit": op11_filter_audit, "op12_quality_rules": op12_quality_rules,
           "op13_importance_resampling": op13_importance_resampling}
ORACLES = {"op1_url_filter": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op8_exact_dedup": OP8_SQL,
           "op11_filter_audit": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_importance_resampling": OP13_SQL}
