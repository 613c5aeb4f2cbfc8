"""The registered queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmark.llm import bpe, decontaminate, html_extract, license_scan, near_dedup, quality, shuffle_shards, spotsigs, suffix_dedup, url_filter
from kinmark.llm._common import arrow_limits, table, text_or_empty

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SHARDS, SHARD_SEED = 24, 20240607


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"), "doc_id", "text")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), "page_id", "url", URL_RULES)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths of their own: source / language / id stands for one."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", "doc_id"))
    return license_scan.scan(docs, "doc_id", "path", "text")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    vocab = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", vocab, digests_only=True)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op6_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shuffle_shards.shuffled_shards(docs, "text", SHARDS, SHARD_SEED)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(8).cast("long")
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", size.alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"), law, "shard", "slot", grown)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs, model).select("doc_id", (quality.remainder("doc_id") == 2).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return spotsigs.edited_neighbours(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_url_filter, op3_license_scan, op4_bpe, op5_html_extract, op6_shuffle_shards, op7_suffix_dedup, op8_decontaminate, op9_quality, op10_spotsigs)}

_TEMPLATES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(license_scan.TEMPLATES))
_LICENSE_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[0-9]+)*')"
_BEST = """
  SELECT unit, name, score FROM (
    SELECT unit, name, score, row_number() OVER (PARTITION BY unit ORDER BY score DESC, name) AS k FROM (
      SELECT v.unit, tn.name, round(sum(v.v * t.v) / (any_value(v.norm) * any_value(tn.norm)), 6) AS score
      FROM (SELECT unit, word, v, sqrt(sum(v * v) OVER (PARTITION BY unit)) AS norm FROM
             (SELECT c.unit, c.word, c.tf * coalesce(w.idf, (SELECT max(unseen) FROM weights)) AS v FROM {counts} c LEFT JOIN weights w USING (word))) v
      JOIN tvec t USING (word) JOIN tnorm tn ON tn.unit = t.unit
      GROUP BY v.unit, t.unit, tn.name
    ) WHERE score >= {least}
  ) WHERE k = 1
"""

ORACLE_SQL = {
    "op3_license_scan": f"""
WITH t(unit, name, text) AS (VALUES {_TEMPLATES}),
base AS (SELECT doc_id AS id, concat_ws('/', source, lang, doc_id) AS path, concat_ws('/', source, lang) AS dir, text FROM documents),
lines AS (
  SELECT id, trim(line, ' ') AS text FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '(?i)licen[sc]|spdx|public domain')
), l AS (SELECT DISTINCT text AS unit, text FROM lines),
lcount AS (SELECT unit, word, count(*) AS tf FROM (SELECT unit, unnest({_LICENSE_WORDS}) AS word FROM l) GROUP BY ALL),
tcount AS (SELECT unit, word, count(*) AS tf FROM (SELECT unit, unnest({_LICENSE_WORDS}) AS word FROM t) GROUP BY ALL),
total AS (SELECT count(*) + {len(license_scan.TEMPLATES)} AS n FROM l),
weights AS (
  SELECT word, ln((n + 1) / (df + 1)) + 1 AS idf, ln(n + 1) + 1 AS unseen
  FROM (SELECT word, CAST(count(*) AS DOUBLE) AS df FROM (SELECT word FROM lcount UNION ALL SELECT word FROM tcount) GROUP BY word), total
), tvec AS (SELECT unit, word, tf * idf AS v FROM tcount JOIN weights USING (word)),
tnorm AS (SELECT unit, t.name, sqrt(sum(v * v)) AS norm FROM tvec JOIN t USING (unit) GROUP BY ALL),
by_line AS ({_BEST.format(counts="lcount", least=license_scan.LEAST)}),
heads AS (
  SELECT id, count(*) AS n_headers, arg_min(name, (-score, name)) AS own, max(score) AS own_score
  FROM lines JOIN by_line ON by_line.unit = lines.text GROUP BY id
), dcount AS (
  SELECT unit, word, count(*) AS tf FROM (SELECT id AS unit, unnest({_LICENSE_WORDS}) AS word FROM base WHERE id IN (SELECT id FROM heads)) GROUP BY ALL
), by_file AS ({_BEST.format(counts="dcount", least=license_scan.LEAST_FILE)}),
above AS (
  SELECT dir, arg_min(name, (-score, name)) AS given FROM base JOIN by_file ON by_file.unit = base.id GROUP BY dir
), near AS (
  SELECT d.dir, arg_max(a.given, length(a.dir)) AS given, max_by(a.dir, length(a.dir)) AS above
  FROM (SELECT DISTINCT dir FROM base) d JOIN above a ON d.dir = a.dir OR starts_with(d.dir, a.dir || '/') GROUP BY d.dir
)
SELECT base.id AS doc_id, path, CAST(coalesce(n_headers, 0) AS BIGINT) AS n_headers, own, own_score, by_file.unit IS NOT NULL AS is_license_file,
       coalesce(own, given) AS license, CASE WHEN own IS NULL THEN near.above END AS from_dir
FROM base LEFT JOIN heads USING (id) LEFT JOIN by_file ON by_file.unit = base.id LEFT JOIN near ON near.dir = base.dir
""",
    "op1_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{20}\x{09}-\x{0D}]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(least.b, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = w.doc_id
""",
    "op2_url_filter": """
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rh, rp, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT p.page_id, p.host, p.path, r.rh || r.rp AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rh || r.rp) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1
""",
    "op8_decontaminate": """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 12], ' ') AS win, least(13, len(w)) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM i WHERE len(w) > 0)
), spots AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), found AS (
  SELECT doc_id, item_id, s, spots.n FROM spots JOIN wins USING (win)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
""",
}
