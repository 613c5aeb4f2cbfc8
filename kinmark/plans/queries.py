"""The registered queries of the engine, each beside its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmark.functions import similarity as sim
from kinmark.functions import text as tx
from kinmark.operators import blocking, decisions, models, pairwise, passages, ranking, reports
from kinmark.operators.decisions import DecisionConfig
from kinmark.plans import oracle as sql
from kinmark.plans.funnel import Funnel
from kinmark.session import ensure_package, spread, stored
from kinmark.sources import records as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    ensure_package(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs_records(spark: SparkSession, d: str) -> DataFrame:
    return src.documents_as_records(spread(read(spark, d, "documents")))


def funnel(spark: SparkSession, d: str) -> Funnel:
    return Funnel(docs_records(spark, d))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return src.document_truth(read(spark, d, "documents"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return src.scored_pairs(read(spark, d, "lineitem"))


def counts(spark: SparkSession, d: str, p: DataFrame) -> DataFrame:
    return src.pair_truth(p, read(spark, d, "orders"))


def strings(c: str) -> str:
    return f"array_to_string(list_sort({c}), ' ')"


# sources, projections, text ------------------------------------------------------------------------------------

query("scan_records", sql.after("rec", "SELECT * FROM rec"))(docs_records)
query("partitions_list", sql.after("rec", "SELECT DISTINCT country FROM rec"))(lambda s, d: reports.countries(docs_records(s, d)))
query("load_pruned", sql.after("rec", "SELECT entity_id, business_name FROM rec WHERE src = 2 AND country = 'en'"))(lambda s, d: docs_records(s, d).where("src = 2 AND country = 'en'").select("entity_id", "business_name"))


@query("normalize_name", sql.after("norm", "SELECT entity_id, name_norm FROM norm"))
def _(spark, d):
    return docs_records(spark, d).select("entity_id", tx.name_form(F.col("business_name")).alias("name_norm"))


@query("normalize_address", sql.after("norm", "SELECT entity_id, addr_norm FROM norm"))
def _(spark, d):
    return docs_records(spark, d).select("entity_id", tx.address_form(F.col("business_address")).alias("addr_norm"))


@query("domain_forms", f"SELECT page_id, {sql.name_form('url')} AS name_norm FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", tx.name_form(F.col("url")).alias("name_norm"))


for _name, _col in (("name_tokens", "name_toks"), ("address_tokens", "addr_toks"), ("address_numbers", "addr_nums")):
    query(_name, sql.after("forms", f"SELECT entity_id, {strings(_col)} AS tokens, len({_col}) AS n FROM forms"))(
        lambda s, d, c=_col: tx.with_forms(docs_records(s, d)).select("entity_id", tx.joined(F.col(c)).alias("tokens"), F.size(c).cast("long").alias("n"))
    )

_VIEWS = ("name_norm", "addr_norm", "name_core", "name_key", "name_core_nospace", "name_nospace", "name_nonascii", "addr_nonascii")
query("name_views", sql.after("forms", f"SELECT entity_id, {', '.join(_VIEWS)} FROM forms"))(lambda s, d: tx.with_forms(docs_records(s, d)).select("entity_id", *_VIEWS))
query("nonascii_flags", "SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[^\\x00-\\x7f]')) AS n_nonascii FROM documents GROUP BY lang")(
    lambda s, d: read(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(tx.NON_ASCII)).alias("n_nonascii"))
)
query("script_profile", f"SELECT script, count(*) AS n FROM (SELECT CASE WHEN c = '' THEN 'NONE' {sql.SCRIPT_CASES} ELSE 'LATIN' END AS script FROM (SELECT regexp_extract(text, '\\p{{L}}', 0) AS c FROM documents)) GROUP BY script")(
    lambda s, d: reports.script_profile(read(s, d, "documents"), "text")
)
query("fold_accents", "SELECT page_id, length(lower(strip_accents(html))) AS n, md5(lower(strip_accents(url))) AS h FROM pages WHERE false UNION ALL SELECT doc_id, length(lower(strip_accents(text))), md5(lower(strip_accents(text))) FROM documents")(
    lambda s, d: read(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.lower(tx.fold(F.col("text"))).alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("h"))
)

# vocabulary, keys, index ---------------------------------------------------------------------------------------

query("vocab_df", sql.after("vocab", "SELECT country, kind, tok, df FROM vocab"))(lambda s, d: funnel(s, d).vocabulary.select("country", "kind", "tok", "df"))
query("vocab_rank", sql.after("vocab", "SELECT country, kind, tok, tid FROM vocab"))(lambda s, d: funnel(s, d).vocabulary.select("country", "kind", "tok", F.col("tid").cast("long").alias("tid")))
query("rarity_thresholds", sql.after("thr", "SELECT * FROM thr"))(lambda s, d: funnel(s, d).thresholds)
_IDS = ("at_all", "mt_all", "an_all")
query("token_id_lists", sql.after("lists", "SELECT entity_id, " + ", ".join(f"array_to_string({c}, ' ') AS {c}" for c in _IDS) + " FROM lists"))(
    lambda s, d: funnel(s, d).lists.select("entity_id", *(F.array_join(c, " ").alias(c) for c in _IDS))
)
query("rarest_k", sql.after("lists", "SELECT entity_id, array_to_string(at_all[1:5], ' ') AS at, array_to_string(mt_all[1:4], ' ') AS mt, array_to_string(an_all[1:3], ' ') AS an FROM lists"))(
    lambda s, d: funnel(s, d).prepared.select("entity_id", *(F.array_join(c, " ").alias(c) for c in ("at", "mt", "an")))
)


def _all_keys(spark: SparkSession, d: str) -> DataFrame:
    f = funnel(spark, d)
    return blocking.make_keys(f.prepared, f.cfg)


query("block_keys_all", sql.after("keys", "SELECT entity_id, fam, key FROM keys"))(lambda s, d: _all_keys(s, d).select("entity_id", "fam", "key"))
for _i, _fam in enumerate(blocking.FAMILIES):
    query(f"block_keys_{_fam.lower()}", sql.after("keys", f"SELECT entity_id, key FROM keys WHERE fam = {_i}"))(lambda s, d, i=_i: _all_keys(s, d).where(F.col("fam") == i).select("entity_id", "key"))
query("block_sizes", sql.after("keys", "SELECT country, fam, key, count(*) AS n FROM keys WHERE src > 1 GROUP BY ALL"))(lambda s, d: blocking.block_sizes(funnel(s, d).b_keys))
query("capped_index", sql.after("keys", f"SELECT k.country, k.entity_id, k.fam, k.key FROM keys k JOIN (SELECT country, fam, key, count(*) AS n FROM keys WHERE src > 1 GROUP BY ALL) s USING (country, fam, key) WHERE k.src > 1 AND s.n <= {sql._caps(5)}"))(
    lambda s, d: funnel(s, d).index_under(blocking.BlockConfig(max_block=5)).select("country", "entity_id", "fam", "key")
)
query("name_block_caps", "SELECT p_name, n FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) WHERE n <= 30")(
    lambda s, d: read(s, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).where("n <= 30")
)

# candidates ------------------------------------------------------------------------------------------------------

query("candidate_pairs", sql.after("cand", "SELECT a_id, b_id, n_keys, CAST(fam_mask AS BIGINT) AS fam_mask FROM cand"))(
    lambda s, d: funnel(s, d).candidates.select("a_id", "b_id", "n_keys", F.col("fam_mask").cast("long").alias("fam_mask"))
)
query("candidate_limit", sql.after("cand", "SELECT a_id, b_id, n_keys FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY n_keys DESC, b_id) AS k FROM cand) WHERE k <= 3"))(
    lambda s, d: blocking.limit_candidates(funnel(s, d).candidates, 3).select("a_id", "b_id", "n_keys")
)
query(
    "family_recall",
    sql.after(
        "cand truth",
        f"SELECT family, CAST(count(*) FILTER (y = 1) AS BIGINT) AS found, count(a_id) AS pairs, round(count(*) FILTER (y = 1) / (SELECT greatest(count(*), 1) FROM truth), 9) AS recall FROM (VALUES {sql.FAMILY_ROWS}) f(fam, family) LEFT JOIN (SELECT c.a_id, c.fam_mask, CASE WHEN t.a_id IS NULL THEN 0 ELSE 1 END AS y FROM cand c LEFT JOIN truth t USING (a_id, b_id)) m ON (m.fam_mask >> f.fam) & 1 = 1 GROUP BY family",
    ),
)(lambda s, d: blocking.family_recall(funnel(s, d).candidates, truth(s, d)))


@query("family_greedy")
def _(spark, d):
    return spark.createDataFrame(blocking.greedy_families(funnel(spark, d).true_masks(truth(spark, d)), truth(spark, d)), "family string, found long, recall double")


@query(
    "blocking_report",
    sql.after(
        "cand truth rec",
        """SELECT n_true, n_found, round(n_found / greatest(n_true, 1), 9) AS recall, round(full_ / greatest(with_truth, 1), 9) AS full_coverage, n_pairs, round(n_pairs / n_a, 9) AS mean_cands,
        median_cands, p95_cands, max_cands, round(no_cands / n_a, 9) AS zero_share, round(n_pairs / (n_a * n_b), 12) AS reduction_ratio FROM
        (SELECT CAST(sum(need) AS BIGINT) AS n_true, CAST(sum(hit) AS BIGINT) AS n_found, count(*) FILTER (hit = need) AS full_, count(*) AS with_truth FROM (SELECT t.a_id, count(*) AS need, count(c.a_id) AS hit FROM truth t LEFT JOIN cand c USING (a_id, b_id) GROUP BY t.a_id)),
        (SELECT count(*) AS n_a, CAST(sum(n) AS BIGINT) AS n_pairs, quantile_disc(n, 0.5) AS median_cands, quantile_disc(n, 0.95) AS p95_cands, max(n) AS max_cands, count(*) FILTER (n = 0) AS no_cands FROM (SELECT r.entity_id, count(c.a_id) AS n FROM rec r LEFT JOIN cand c ON c.a_id = r.entity_id WHERE r.src = 1 GROUP BY r.entity_id)),
        (SELECT count(*) AS n_b FROM rec WHERE src > 1)""",
    ),
)
def _(spark, d):
    f = funnel(spark, d)
    return blocking.blocking_report(f.candidates, truth(spark, d), f.records.where("src = 1"), b_side=f.records.where("src > 1"))


def _few_families(spark: SparkSession, d: str) -> Funnel:
    return Funnel(docs_records(spark, d), blocking.BlockConfig(max_block=2, max_block_by_family={}))


_TIGHT = f"SELECT a.country, a.entity_id AS a_id, b.entity_id AS b_id FROM keys a JOIN (SELECT k.* FROM keys k JOIN (SELECT country, fam, key, count(*) AS n FROM keys WHERE src > 1 GROUP BY ALL) s USING (country, fam, key) WHERE k.src > 1 AND s.n <= 2) b USING (country, key) WHERE a.src = 1 GROUP BY ALL"
query("missed_pairs", sql.after("keys truth rec", "SELECT t.a_id, t.b_id, x.business_name AS a_name, y.business_name AS b_name FROM truth t LEFT JOIN tight c USING (a_id, b_id) JOIN rec x ON x.entity_id = t.a_id JOIN rec y ON y.entity_id = t.b_id WHERE c.a_id IS NULL", tight=_TIGHT))(
    lambda s, d: blocking.missed_pairs(_few_families(s, d).candidates, truth(s, d), docs_records(s, d))
)
query("semi_matches", sql.after("cand truth", "SELECT a_id, b_id FROM truth WHERE (a_id, b_id) IN (SELECT (a_id, b_id) FROM cand)"))(lambda s, d: truth(s, d).join(funnel(s, d).candidates, ["a_id", "b_id"], "left_semi"))
query("anti_missed", sql.after("keys truth", "SELECT t.a_id, t.b_id FROM truth t LEFT JOIN tight c USING (a_id, b_id) WHERE c.a_id IS NULL", tight=_TIGHT))(
    lambda s, d: truth(s, d).join(_few_families(s, d).candidates, ["a_id", "b_id"], "left_anti")
)


@query("candidate_recall", sql.after("cand truth", "SELECT round((SELECT count(*) FROM truth JOIN cand USING (a_id, b_id)) / (SELECT greatest(count(*), 1) FROM truth), 9) AS recall, round(avg(n), 9) AS mean_cands, quantile_disc(n, 0.5) AS median_cands, quantile_disc(n, 0.95) AS p95_cands FROM (SELECT a_id, count(*) AS n FROM cand GROUP BY a_id)"))
def _(spark, d):
    named = lambda x: x.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return decisions.candidate_recall(named(funnel(spark, d).candidates), named(truth(spark, d)))


@query("benchmark_overlap", sql.after("ranked", "SELECT a_id, b_id, n_keys, round(score, 9) AS score, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 20", rec=sql.PASSAGES))
def _(spark, d):
    items, docs = read(spark, d, "benchmark"), spread(read(spark, d, "documents"))
    found = passages.best_runs(items.select(F.col("item_id").alias("id"), "text"), docs.select(F.col("doc_id").alias("id"), "text"), src.NAME_WORDS + src.ADDRESS_WORDS, src.PASSAGE_STEP, 20)
    found = found if found is not None else Funnel(src.passages_as_records(items, docs)).survivors
    return found.select("a_id", "b_id", "n_keys", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


# cheap features, ranking -------------------------------------------------------------------------------------------

_INTS = tuple(c for c in ranking.CHEAP_FEATURES if not c.endswith(("_jac", "_cont", "_minid")))
_REALS = tuple(c for c in ranking.CHEAP_FEATURES if c.endswith(("_jac", "_cont", "_minid")))
query("cheap_features", sql.after("cheap", "SELECT a_id, b_id, " + ", ".join([f"CAST({c} AS BIGINT) AS {c}" for c in _INTS] + [f"round({c}, 9) AS {c}" for c in _REALS]) + " FROM cheap"))(
    lambda s, d: funnel(s, d).cheap.select("a_id", "b_id", *(F.col(c).cast("long").alias(c) for c in _INTS), *(F.round(c, 9).alias(c) for c in _REALS))
)
query("heuristic_topk", sql.after("ranked", "SELECT a_id, b_id, round(score, 9) AS score, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 20"))(
    lambda s, d: funnel(s, d).survivors.select("a_id", "b_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))
)
query("recall_at_k", sql.after("ranked truth", "SELECT k, count(a_id) AS found, round(count(a_id) / (SELECT greatest(count(*), 1) FROM truth), 9) AS recall FROM (VALUES (8), (12), (16), (20), (24), (32), (48)) v(k) LEFT JOIN (SELECT a_id, rank FROM ranked JOIN truth USING (a_id, b_id)) r ON r.rank <= k GROUP BY k"))(
    lambda s, d: ranking.recall_at(funnel(s, d).scored, truth(s, d))
)

# string similarity ---------------------------------------------------------------------------------------------------


def _short_pairs(spark: SparkSession, d: str) -> DataFrame:
    """different part names with one first word."""
    names = read(spark, d, "part").select("p_name").distinct()
    key = F.split("p_name", " ")[0].alias("k")
    x, y = names.select(F.col("p_name").alias("x"), key), names.select(F.col("p_name").alias("y"), key)
    return x.join(y, "k").where("x < y").select("x", "y")


_SHORT = "SELECT x, y FROM (SELECT DISTINCT p_name AS x FROM part) JOIN (SELECT DISTINCT p_name AS y FROM part) ON split_part(x, ' ', 1) = split_part(y, ' ', 1) AND x < y"


def _short(name: str, oracle: str | None, make: Callable) -> None:
    text = f"WITH s AS ({_SHORT}) SELECT x, y, {oracle} AS v FROM s" if oracle else None
    query(name, text)(lambda s, d: _short_pairs(s, d).select("x", "y", make(F.col("x"), F.col("y")).alias("v")))


_short("levenshtein_sim", "round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 9)", lambda x, y: F.round(sim.levenshtein_similarity(x, y), 9))
_short("jaro_winkler_sim", "round(jaro_winkler_similarity(x, y), 6)", lambda x, y: F.round(sim.metric("jw", x, y), 6))
_short("token_sort", "array_to_string(list_sort(string_split(x, ' ')), ' ') || '|' || array_to_string(list_sort(string_split(y, ' ')), ' ')", lambda x, y: F.concat_ws("|", tx.joined(F.split(x, " ")), tx.joined(F.split(y, " "))))
_short("prefix_sim", "round(coalesce(list_max(list_filter(generate_series(0, least(length(x), length(y))), lambda n: x[1:n] = y[1:n])), 0) / greatest(length(x), length(y)), 9)", lambda x, y: F.round(sim.prefix_similarity(x, y), 9))
_SORTED = {c: f"array_to_string(list_sort(string_split({c}, ' ')), ' ')" for c in "xy"}
_RESTS = ", ".join(f"array_to_string(list_sort(list_distinct(list_filter(string_split({c}, ' '), lambda w: NOT list_contains(string_split({o}, ' '), w)))), ' ') AS r{c}" for c, o in ("xy", "yx"))
_TOKEN_SET = f"""WITH s AS ({_SHORT}), t AS (SELECT x, y, {_RESTS}, length(array_to_string(list_intersect(string_split(x, ' '), string_split(y, ' ')), ' ')) AS n FROM s),
  u AS (SELECT *, CASE WHEN n > 0 THEN 1 ELSE 0 END AS gap, length(rx) + length(ry) - 2 * {sql.common_length("rx", "ry")} AS edits FROM t)
  SELECT x, y, round(CASE WHEN n > 0 AND (rx = '' OR ry = '') THEN 1.0 ELSE greatest(1 - edits / (2 * (n + gap) + length(rx) + length(ry)), CASE WHEN n > 0 THEN greatest(1 - (gap + length(rx)) / (2 * n + gap + length(rx)), 1 - (gap + length(ry)) / (2 * n + gap + length(ry))) ELSE 0.0 END) END, 9) AS v FROM u"""
_PARTIAL = f"""WITH s AS ({_SHORT}), turns AS (SELECT x, y, x AS a, y AS b FROM s WHERE length(x) <= length(y) UNION ALL SELECT x, y, y, x FROM s WHERE length(y) <= length(x)),
  places AS (SELECT *, unnest(generate_series(1 - length(a), length(b) - 1)) AS k FROM turns),
  cut AS (SELECT x, y, a, substr(b, greatest(k, 0) + 1, least(k + length(a), length(b)) - greatest(k, 0)) AS w FROM places)
  SELECT x, y, round(max({sql.indel_ratio("a", "w")}), 9) AS v FROM cut GROUP BY x, y"""
for _name, _kind, _text in (
    ("indel_ratio", "ratio", f"WITH s AS ({_SHORT}) SELECT x, y, round({sql.indel_ratio('x', 'y')}, 9) AS v FROM s"),
    ("token_sort_ratio", "toksort", f"WITH s AS ({_SHORT}), t AS (SELECT x, y, {_SORTED['x']} AS a, {_SORTED['y']} AS b FROM s) SELECT x, y, round({sql.indel_ratio('a', 'b')}, 9) AS v FROM t"),
    ("token_set_ratio", "tokset", _TOKEN_SET), ("partial_ratio", "partial", _PARTIAL),
):
    query(_name, _text)(lambda s, d, k=_kind: _short_pairs(s, d).select("x", "y", F.round(sim.metric(k, F.col("x"), F.col("y")), 9).alias("v")))

# pairwise features ---------------------------------------------------------------------------------------------------


def _text_pairs(spark: SparkSession, d: str, *columns: Column) -> DataFrame:
    f = funnel(spark, d)
    return f.attached(f.kept.select("a_id", "b_id"), lambda both: both.select("a_id", "b_id", *columns))


query("exact_flags", sql.after("text_pairs", "SELECT a_id, b_id, CAST(a_name_norm = b_name_norm AS INTEGER) AS nm_exact, CAST(a_name_key = b_name_key AS INTEGER) AS nmkey_exact, CAST(a_name_core_nospace = b_name_core_nospace AS INTEGER) AS nmns_exact, CAST(a_addr_norm = b_addr_norm AS INTEGER) AS ad_exact, CAST(a_name_norm = b_name_norm AND a_addr_norm = b_addr_norm AS INTEGER) AS both_exact FROM text_pairs"))(
    lambda s, d: _text_pairs(s, d, *(c.alias(k) for k, c in pairwise.exact_flags().items()))
)
_LENGTHS = ", ".join(f"CAST(length(a_{v}) AS BIGINT) AS {s}_len_a, CAST(length(b_{v}) AS BIGINT) AS {s}_len_b, CAST(abs(length(a_{v}) - length(b_{v})) AS BIGINT) AS {s}_len_diff, round(least(length(a_{v}), length(b_{v})) / greatest(length(a_{v}), length(b_{v}), 1), 9) AS {s}_len_ratio" for s, v in (("nm", "name_core"), ("ad", "addr_norm")))
query("length_feats", sql.after("text_pairs", f"SELECT a_id, b_id, {_LENGTHS} FROM text_pairs"))(
    lambda s, d: _text_pairs(s, d, *((F.round(c, 9) if k.endswith("ratio") else c.cast("long")).alias(k) for k, c in pairwise.length_features().items()))
)
query("country_descriptors", sql.after("forms", "SELECT country, round(ln(1 + count(*)), 9) AS ctry_index_log, round(avg(CASE WHEN name_nonascii THEN 1.0 ELSE 0.0 END), 9) AS ctry_nonlatin_rate, round(avg(len(addr_toks)), 9) AS ctry_addr_tok_mean FROM forms WHERE src > 1 GROUP BY country"))(
    lambda s, d: pairwise.country_descriptors(tx.with_forms(docs_records(s, d)).where("src > 1")).select("country", *(F.round(c, 9).alias(c) for c in pairwise.COUNTRY_FEATURES))
)
_LEV = lambda v: f"(CASE WHEN greatest(length(a_{v}), length(b_{v})) = 0 THEN 1.0 ELSE 1 - levenshtein(a_{v}, b_{v}) / greatest(length(a_{v}), length(b_{v})) END)"
query(
    "interaction_feats",
    sql.after("text_pairs", "SELECT a_id, b_id, round(nm * ad, 9) AS nm_ad_prod, round(greatest(nm, ad), 9) AS nm_ad_max, round(least(nm, ad), 9) AS nm_ad_min, round(0.45 * nm + 0.55 * ad, 9) AS nm_ad_wsum, CAST(nm > 0.9 AND ad < 0.6 AS INTEGER) AS strong_nm_weak_ad, CAST(nm < 0.6 AND ad > 0.9 AS INTEGER) AS weak_nm_strong_ad FROM s", s=f"SELECT a_id, b_id, {_LEV('name_core')} AS nm, {_LEV('addr_norm')} AS ad FROM text_pairs"),
)(
    lambda s, d: _text_pairs(s, d, *(((c if "weak" in k else F.round(c, 9))).alias(k) for k, c in pairwise.interactions(*(sim.metric("lev", F.col(f"a_{v}"), F.col(f"b_{v}")) for v in ("name_core", "addr_norm"))).items()))
)


@query(
    "group_features_a",
    sql.after(
        "pairs",
        """SELECT a AS a_id, b AS b_id, n AS g_n_cands, CAST(k AS BIGINT) AS g_rank, round(p - best, 9) AS g_cheap_margin, round(best - coalesce(max(CASE WHEN k = 2 THEN p END) OVER (PARTITION BY a), best), 9) AS g_cheap_gap2, round(p / total, 6) AS g_cheap_share, round(max(q) OVER (PARTITION BY a), 9) AS g_ad_best, round(q - max(q) OVER (PARTITION BY a), 9) AS g_ad_margin
        FROM (SELECT a, b, p, q, count(*) OVER w AS n, row_number() OVER (PARTITION BY a ORDER BY p DESC, b) AS k, max(p) OVER w AS best, sum(p) OVER w AS total FROM (SELECT *, 1 - p AS q FROM pairs) WINDOW w AS (PARTITION BY a))""",
    ),
)
def _(spark, d):
    p = pairs(spark, d).select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), "p", (1 - F.col("p")).alias("q"))
    out = pairwise.group_features(p, "p", "p", "q")
    return out.select("a_id", "b_id", "g_n_cands", F.col("g_rank").cast("long").alias("g_rank"), *(F.round(c, n).alias(c) for c, n in (("g_cheap_margin", 9), ("g_cheap_gap2", 9), ("g_cheap_share", 6), ("g_ad_best", 9), ("g_ad_margin", 9))))


_AB_REALS = ("grp_best_score", "grp_margin_best", "grp_nm_rel", "grp_ad_rel", "bside_margin_best")


@query(
    "group_features_ab",
    sql.after("pairs", "SELECT a AS a_id, b AS b_id, count(*) OVER x AS grp_n_cands, CAST(row_number() OVER (PARTITION BY a ORDER BY p DESC, b) AS BIGINT) AS grp_rank, round(max(p) OVER x, 9) AS grp_best_score, round(p - max(p) OVER x, 9) AS grp_margin_best, round(q - max(q) OVER x, 9) AS grp_nm_rel, round(r - max(r) OVER x, 9) AS grp_ad_rel, count(*) OVER y AS bside_n_competitors, CAST(row_number() OVER (PARTITION BY b ORDER BY p DESC, a) AS BIGINT) AS bside_rank, round(p - max(p) OVER y, 9) AS bside_margin_best FROM (SELECT *, 1 - p AS q, p / 2 AS r FROM pairs) WINDOW x AS (PARTITION BY a), y AS (PARTITION BY b)"),
)
def _(spark, d):
    p = pairs(spark, d).select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), "p", (1 - F.col("p")).alias("q"), (F.col("p") / 2).alias("r"))
    out = pairwise.both_side_features(p, "p", "q", "r")
    return out.select("a_id", "b_id", "grp_n_cands", F.col("grp_rank").cast("long").alias("grp_rank"), "bside_n_competitors", F.col("bside_rank").cast("long").alias("bside_rank"), *(F.round(c, 9).alias(c) for c in _AB_REALS))


_JW = {"nm_jw": "name_core", "nmkey_jw": "name_key", "nmns_jw": "name_core_nospace", "ad_jw": "addr_norm"}
_PLAIN = (*(f"nm_{c}" for c in ("exact", "len_a", "len_b", "len_diff")), "nmkey_exact", "nmns_exact", "ad_exact", "both_exact", "ad_len_a", "ad_len_b", "ad_len_diff", "b_addr_empty", "b_name_nonlatin", "b_addr_nonlatin", "is_s3", "g_n_cands", "g_rank")
query("feature_matrix")(lambda s, d: funnel(s, d).features)
query(
    "feature_matrix_plain",
    sql.after(
        "text_pairs",
        "SELECT a_id, b_id, "
        + ", ".join(f"CAST(a_{v} = b_{v} AS BIGINT) AS {k}" for k, v in (("nm_exact", "name_norm"), ("nmkey_exact", "name_key"), ("nmns_exact", "name_core_nospace"), ("ad_exact", "addr_norm")))
        + ", CAST(a_name_norm = b_name_norm AND a_addr_norm = b_addr_norm AS BIGINT) AS both_exact, "
        + ", ".join(f"CAST(length(a_{v}) AS BIGINT) AS {k}_len_a, CAST(length(b_{v}) AS BIGINT) AS {k}_len_b, CAST(abs(length(a_{v}) - length(b_{v})) AS BIGINT) AS {k}_len_diff" for k, v in (("nm", "name_core"), ("ad", "addr_norm")))
        + ", CAST(b_addr_norm = '' AS BIGINT) AS b_addr_empty, CAST(b_name_nonascii AS BIGINT) AS b_name_nonlatin, CAST(b_addr_nonascii AS BIGINT) AS b_addr_nonlatin, CAST(starts_with(b_id, 'S3-') AS BIGINT) AS is_s3, "
        + "count(*) OVER w AS g_n_cands, CAST(row_number() OVER (PARTITION BY a_id ORDER BY round(score, 9) DESC, b_id) AS BIGINT) AS g_rank, round(score - max(score) OVER w, 6) AS g_cheap_margin, round(score / sum(score) OVER w, 6) AS g_cheap_share, "
        + ", ".join(f"round(CASE WHEN a_{v} = '' AND b_{v} = '' THEN 1.0 WHEN a_{v} = '' OR b_{v} = '' THEN 0.0 ELSE jaro_winkler_similarity(a_{v}, b_{v}) END, 6) AS {k}" for k, v in _JW.items())
        + " FROM text_pairs WINDOW w AS (PARTITION BY a_id)",
    ),
)(lambda s, d: funnel(s, d).features.select("a_id", "b_id", *(F.col(c).cast("long").alias(c) for c in _PLAIN), *(F.round(c, 6).alias(c) for c in ("g_cheap_margin", "g_cheap_share", *_JW))))

# folds, truth, samples -------------------------------------------------------------------------------------------------

_FOLD = "CAST(('0x' || substr(md5(entity_id), 1, 8))::BIGINT % 10 AS INTEGER)"
query("fold_assign", sql.after("rec", f"SELECT entity_id, {_FOLD} AS fold FROM rec"))(lambda s, d: docs_records(s, d).select("entity_id", decisions.fold_of(F.col("entity_id")).alias("fold")))
query("fold_sizes", sql.after("rec", f"SELECT {_FOLD} AS fold, count(*) AS n FROM rec GROUP BY ALL"))(lambda s, d: docs_records(s, d).groupBy(decisions.fold_of(F.col("entity_id")).alias("fold")).agg(F.count("*").alias("n")))
query("truth_pairs", sql.after("truth", "SELECT a_id, b_id FROM truth"))(truth)
query("truth_counts", sql.after("rec truth", "SELECT r.entity_id AS a, count(t.a_id) AS n_true FROM rec r LEFT JOIN truth t ON t.a_id = r.entity_id WHERE src = 1 GROUP BY r.entity_id"))(
    lambda s, d: docs_records(s, d).where("src = 1").select(F.col("entity_id").alias("a")).join(truth(s, d).groupBy(F.col("a_id").alias("a")).agg(F.count("*").alias("n")), "a", "left").select("a", F.coalesce("n", F.lit(0)).cast("long").alias("n_true"))
)
query("entity_split", sql.after("rec", "SELECT entity_id, ('0x' || substr(md5('3|' || entity_id), 1, 8))::BIGINT < 2147483648 AS first FROM rec WHERE src = 1"))(
    lambda s, d: (lambda x, y: x.withColumn("first", F.lit(True)).unionByName(y.withColumn("first", F.lit(False))))(*models.split_entities(docs_records(s, d).where("src = 1").select("entity_id"), "entity_id"))
)
query("seeded_sample", sql.after("rec", "SELECT country, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY md5(entity_id || '|7'), entity_id) AS k FROM rec) WHERE k <= 25"))(
    lambda s, d: decisions.seeded_sample(docs_records(s, d), "entity_id", 25, "7", per="country").select("country", "entity_id")
)

# decisions ---------------------------------------------------------------------------------------------------------------

_BEST = "SELECT *, max(p) OVER (PARTITION BY a) AS best FROM pairs"
_RULES = {
    "decide_threshold": (DecisionConfig(threshold=0.6), "SELECT a, b, p FROM pairs WHERE p >= 0.6"),
    "decide_per_source": (DecisionConfig(threshold=0.5, threshold_s3=0.7), "SELECT a, b, p FROM pairs WHERE p >= CASE WHEN is_s3 = 1 THEN 0.7 ELSE 0.5 END"),
    "decide_relative": (DecisionConfig(threshold=0.3, rel_threshold=0.7), f"SELECT a, b, p FROM ({_BEST}) WHERE p >= 0.3 AND p >= CAST(0.7 AS DOUBLE) * best"),
    "decide_gate": (DecisionConfig(threshold=0.3, min_best=0.8), f"SELECT a, b, p FROM ({_BEST}) WHERE p >= 0.3 AND best >= 0.8"),
    "decide_cap": (DecisionConfig(threshold=0.2, max_matches=2), "SELECT a, b, p FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY p DESC, b) AS k FROM pairs WHERE p >= 0.2) WHERE k <= 2"),
    "decide_exclusive": (DecisionConfig(threshold=0.2, exclusive=True), "SELECT a, b, p FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY p DESC, a) AS k FROM pairs WHERE p >= 0.2) WHERE k = 1"),
    "decide_all": (
        DecisionConfig(threshold=0.3, threshold_s2=0.35, threshold_s3=0.25, rel_threshold=0.5, min_best=0.6, max_matches=3, exclusive=True),
        f"SELECT a, b, p FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY p DESC, a) AS k2 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY p DESC, b) AS k FROM ({_BEST}) WHERE p >= CASE WHEN is_s3 = 1 THEN 0.25 ELSE 0.35 END AND p >= CAST(0.5 AS DOUBLE) * best AND best >= 0.6) WHERE k <= 3) WHERE k2 = 1",
    ),
}
for _name, (_cfg, _text) in _RULES.items():
    query(_name, sql.after("pairs", _text))(lambda s, d, c=_cfg: decisions.decide(pairs(s, d), c).select("a", "b", "p"))

# metrics -------------------------------------------------------------------------------------------------------------------

_CHOSEN = "SELECT a, b, y FROM pairs WHERE p >= 0.6"


def _chosen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = pairs(spark, d)
    return decisions.decide(p, DecisionConfig(threshold=0.6)), counts(spark, d, p)


query("fbeta_per_entity", sql.after("counts", "SELECT a, n_true, n_pred, n_hit, round(f, 9) AS f FROM e", chosen=_CHOSEN, e=sql.entities("chosen")))(lambda s, d: decisions.per_entity(*_chosen(s, d)).withColumn("f", F.round("f", 9)))
query("macro_f05", sql.after("counts", "SELECT round(avg(f), 9) AS macro_f05 FROM e", chosen=_CHOSEN, e=sql.entities("chosen")))(lambda s, d: decisions.per_entity(*_chosen(s, d)).agg(F.round(F.avg("f"), 9).alias("macro_f05")))
query("score_labeled", sql.after("counts", sql.summary("e"), chosen=_CHOSEN, e=sql.entities("chosen")))(lambda s, d: decisions.score_labelled(*_chosen(s, d)))


@query("score_predictions", sql.after("counts", sql.summary("e"), chosen=_CHOSEN, e=sql.entities("chosen")))
def _(spark, d):
    p = pairs(spark, d)
    return decisions.score_pairs(decisions.decide(p, DecisionConfig(threshold=0.6)), p.where("y = 1"), read(spark, d, "orders").select(F.col("o_orderkey").alias("a")))


_GRID = [round(0.05 + 0.025 * i, 3) for i in range(38)]


@query(
    "threshold_sweep",
    sql.after("counts", f"SELECT CAST(t AS DOUBLE) AS threshold, round(avg({sql.F_HALF}), 9) AS macro_f05, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(n_hit) AS BIGINT) AS n_hit FROM (SELECT t, c.a, any_value(n_true) AS n_true, count(p.a) AS n_pred, CAST(coalesce(sum(p.y), 0) AS BIGINT) AS n_hit FROM (SELECT unnest([{', '.join(map(str, _GRID))}]) AS t) g CROSS JOIN counts c LEFT JOIN pairs p ON p.a = c.a AND p.p >= CAST(t AS DOUBLE) GROUP BY t, c.a) GROUP BY t"),
)
def _(spark, d):
    p = pairs(spark, d)
    return decisions.threshold_sweep(p, counts(spark, d, p), _GRID)


@query(
    "gate_sweep",
    sql.after("counts", "SELECT CAST(g AS DOUBLE) AS gate, round(avg(CASE WHEN coalesce(best, -1) >= g THEN f WHEN n_true = 0 THEN 1.0 ELSE 0.0 END), 9) AS macro_f05 FROM e LEFT JOIN (SELECT a, max(p) AS best FROM pairs GROUP BY a) USING (a) CROSS JOIN (SELECT unnest([0.6, 0.65, 0.7, 0.8, 0.9]) AS g) GROUP BY g UNION ALL SELECT NULL, round(avg(CASE WHEN n_true = 0 THEN 1.0 ELSE f END), 9) FROM e", chosen=_CHOSEN, e=sql.entities("chosen")),
)
def _(spark, d):
    p = pairs(spark, d)
    return decisions.gate_sweep(p, counts(spark, d, p), 0.6, [0.6, 0.65, 0.7, 0.8, 0.9])


@query(
    "entity_score_shape",
    sql.after("pairs", "SELECT o_orderkey AS a, coalesce(n, 0) AS n, coalesce(best, 0.0) AS best, coalesce(second, 0.0) AS second, round(coalesce(best - second, 0.0), 9) AS gap, round(coalesce(total, 0.0), 6) AS total, coalesce(over_half, 0) AS over_half, coalesce(over_nine, 0) AS over_nine, coalesce(best_cheap, 0.0) AS best_cheap FROM orders LEFT JOIN (SELECT a, count(*) AS n, max(p) AS best, list_min(list_sort(list(p), 'DESC')[1:2]) AS second, sum(p) AS total, count(*) FILTER (p > 0.5) AS over_half, count(*) FILTER (p > 0.9) AS over_nine, max(p / 2) AS best_cheap FROM pairs GROUP BY a) ON a = o_orderkey"),
)
def _(spark, d):
    return decisions.score_shape(pairs(spark, d).withColumn("cheap", F.col("p") / 2), read(spark, d, "orders").select(F.col("o_orderkey").alias("a")))


query("auc_signal", sql.after("pairs", "SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(pos * (below + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)), 9) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM pairs GROUP BY p))"))(
    lambda s, d: decisions.auc(pairs(s, d), "p", "y")
)

# publication, audits, profiles ------------------------------------------------------------------------------------------

_IDS_OF = "SELECT 'S1-' || a AS a, CASE WHEN is_s3 = 1 THEN 'S3-' ELSE 'S2-' END || b AS b, p, is_s3 FROM pairs"


def _named(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = pairs(spark, d)
    named = p.select(F.concat(F.lit("S1-"), "a").alias("a"), F.concat(F.when(F.col("is_s3") == 1, "S3-").otherwise("S2-"), F.col("b")).alias("b"), "p", "is_s3")
    return named, read(spark, d, "orders").select(F.concat(F.lit("S1-"), "o_orderkey").alias("a"))


def _submission(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    named, scope = _named(spark, d)
    return decisions.match_lists(named.where("p >= 0.6"), scope), decisions.match_lists(named, scope, "candidate_entity_ids"), scope, named


_LISTS = "SELECT 'S1-' || o_orderkey AS source1_entity_id, coalesce(m, '') AS matched_entity_ids, coalesce(c, '') AS candidate_entity_ids FROM orders LEFT JOIN (SELECT a, string_agg(b, ',' ORDER BY b) FILTER (p >= 0.6) AS m, string_agg(b, ',' ORDER BY b) AS c FROM n GROUP BY a) ON a = 'S1-' || o_orderkey"
query("match_lists", sql.after("pairs", "SELECT source1_entity_id, matched_entity_ids FROM l", n=_IDS_OF, l=_LISTS))(lambda s, d: _submission(s, d)[0])


@query("submission_rows", sql.after("pairs", "SELECT * FROM l", n=_IDS_OF, l=_LISTS))
def _(spark, d):
    m, c, _, _ = _submission(spark, d)
    return m.join(c, "source1_entity_id")


_AUDIT = "matches_cover_scope candidates_cover_scope matches_within_scope no_repeated_match_rows no_repeated_candidate_rows no_repeated_ids_in_a_list only_other_sources matched_ids_exist matches_are_candidates match_headers candidate_headers".split()


@query("audit_checks", sql.after("pairs", "SELECT unnest([" + ", ".join(f"'{c}'" for c in _AUDIT) + "]) AS check_name, true AS ok, 0::BIGINT AS detail UNION ALL SELECT 'has_matches', count(*) > 0, count(*) FROM l WHERE matched_entity_ids <> '' UNION ALL SELECT 'has_candidates', count(*) > 0, count(*) FROM l WHERE candidate_entity_ids <> ''", n=_IDS_OF, l=_LISTS))
def _(spark, d):
    m, c, scope, named = _submission(spark, d)
    return reports.audit(m, c, scope, named.select("b"))


def _entity_countries(spark: SparkSession, d: str) -> DataFrame:
    """An order's priority stands for its country."""
    return read(spark, d, "orders").select(F.concat(F.lit("S1-"), "o_orderkey").alias("source1_entity_id"), F.col("o_orderpriority").alias("country"))


_COUNTED = "SELECT o_orderpriority AS country, len(ids) AS n, len(list_filter(ids, lambda x: starts_with(x, 'S2-'))) AS s2, len(list_filter(ids, lambda x: starts_with(x, 'S3-'))) AS s3 FROM (SELECT source1_entity_id, CASE WHEN matched_entity_ids = '' THEN [] ELSE string_split(matched_entity_ids, ',') END AS ids FROM l) JOIN orders ON 'S1-' || o_orderkey = source1_entity_id"
query(
    "country_distribution",
    sql.after("pairs", "SELECT country, count(*) AS n_entities, round(avg(n), 9) AS mean_matches, " + ", ".join(f"round(avg(CASE WHEN n = {k} THEN 1.0 ELSE 0.0 END), 9) AS share_{k}" for k in range(5)) + f", round(avg(CASE WHEN n >= 5 THEN 1.0 ELSE 0.0 END), 9) AS share_5_up FROM ({_COUNTED}) GROUP BY country", n=_IDS_OF, l=_LISTS),
)(lambda s, d: reports.country_distribution(_submission(s, d)[0], _entity_countries(s, d)))
query(
    "profile_truth_countries",
    sql.after(
        "pairs",
        f"SELECT country, count(*) AS n_entities, count(*) FILTER (n = 0) AS n_singletons, round(100 * count(*) FILTER (n = 0) / count(*), 9) AS singleton_percent, round(avg(n), 9) AS mean_matches, coalesce(round(avg(n) FILTER (n > 0), 9), 0.0) AS mean_matched, CAST(sum(n) AS BIGINT) AS n_matches, CAST(sum(s2) AS BIGINT) AS n_s2, CAST(sum(s3) AS BIGINT) AS n_s3 FROM ({_COUNTED}) GROUP BY country",
        n=_IDS_OF, l=_LISTS,
    ),
)(lambda s, d: reports.profile_truth_countries(_submission(s, d)[0], _entity_countries(s, d)))
query("profile_countries", sql.after("rec", "SELECT src, country, count(*) AS n_rows FROM rec GROUP BY ALL"))(lambda s, d: reports.profile_countries(docs_records(s, d)))
query("truth_lists", sql.after("pairs", "SELECT a AS a_id, b AS b_id FROM n WHERE p >= 0.6 AND b IN (SELECT b FROM n WHERE p < 0.05)", n=_IDS_OF))(
    lambda s, d: (lambda m, named: src.indexed_truth(m, named.where("p < 0.05").select(F.col("b").alias("entity_id"))))(*(lambda x: (x[0], x[3]))(_submission(s, d)))
)
query("truth_list_counts", sql.after("pairs", "SELECT source1_entity_id AS a, CAST(CASE WHEN matched_entity_ids = '' THEN 0 ELSE len(string_split(matched_entity_ids, ',')) END AS BIGINT) AS n_true FROM l", n=_IDS_OF, l=_LISTS))(lambda s, d: src.listed_counts(_submission(s, d)[0]))
query("match_distribution", sql.after("pairs", "SELECT CASE WHEN matched_entity_ids = '' THEN 0 ELSE len(string_split(matched_entity_ids, ',')) END AS n_matches, count(*) AS n FROM l GROUP BY ALL", n=_IDS_OF, l=_LISTS))(lambda s, d: reports.match_distribution(_submission(s, d)[0]))
query(
    "profile_truth",
    sql.after(
        "pairs",
        """SELECT count(*) AS n_entities, count(*) FILTER (n = 0) AS n_singletons, CAST(sum(n) AS BIGINT) AS n_matches, round(avg(n) FILTER (n > 0), 9) AS mean_matched, max(n) AS max_matches, CAST(sum(s2) AS BIGINT) AS n_s2, CAST(sum(s3) AS BIGINT) AS n_s3,
        count(*) FILTER (s2 > 0 AND s3 > 0) AS n_both, quantile_disc(n, 0.5) AS median_matches, (SELECT count(*) - count(DISTINCT b) FROM n WHERE p >= 0.6) AS n_reused
        FROM (SELECT len(ids) AS n, len(list_filter(ids, lambda x: starts_with(x, 'S2-'))) AS s2, len(list_filter(ids, lambda x: starts_with(x, 'S3-'))) AS s3 FROM (SELECT CASE WHEN matched_entity_ids = '' THEN [] ELSE string_split(matched_entity_ids, ',') END AS ids FROM l))""",
        n=_IDS_OF, l=_LISTS,
    ),
)(lambda s, d: reports.profile_truth(_submission(s, d)[0]))
query(
    "profile_source",
    sql.after(
        "rec",
        """SELECT src, count(*) AS n_rows, count(DISTINCT entity_id) AS n_ids, count(*) - count(DISTINCT entity_id) AS n_repeated_ids, count(*) - count(DISTINCT business_name) AS n_repeated_names, count(*) - count(DISTINCT business_address) AS n_repeated_addresses, round(avg(CASE WHEN regexp_matches(business_name, '[0-9]') THEN 1.0 ELSE 0.0 END), 9) AS name_digit_share, min(split_part(entity_id, '-', 2)::BIGINT) AS min_id, max(split_part(entity_id, '-', 2)::BIGINT) AS max_id, count(DISTINCT country) AS n_countries,
        round(avg(CASE WHEN trim(business_name) = '' THEN 1.0 ELSE 0.0 END), 9) AS name_missing, round(avg(CASE WHEN trim(business_address) = '' THEN 1.0 ELSE 0.0 END), 9) AS addr_missing, count(DISTINCT (business_name, business_address)) AS n_distinct_pairs,
        CAST(quantile_disc(length(business_name), 0.5) AS BIGINT) AS name_len_median, CAST(quantile_disc(length(business_name), 0.95) AS BIGINT) AS name_len_p95, CAST(quantile_disc(length(business_address), 0.5) AS BIGINT) AS addr_len_median, CAST(quantile_disc(length(business_address), 0.95) AS BIGINT) AS addr_len_p95,
        round(avg(CASE WHEN regexp_matches(business_address, '[0-9]') THEN 1.0 ELSE 0.0 END), 9) AS addr_digit_share, round(avg(CASE WHEN regexp_matches(business_name, '[^\\x00-\\x7f]') THEN 1.0 ELSE 0.0 END), 9) AS name_nonascii_share FROM rec GROUP BY src""",
    ),
)(lambda s, d: reports.profile_source(docs_records(s, d)))
query("value_counts", "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY c_mktsegment")(lambda s, d: reports.value_counts(read(s, d, "customer"), "c_mktsegment"))


def _errors(spark: SparkSession, d: str) -> tuple[DataFrame, Funnel]:
    f = funnel(spark, d)
    return reports.errors_at(f.kept, truth(spark, d), 4.5), f


def _ladder(spark: SparkSession, d: str, nm: Column, ad: Column) -> DataFrame:
    """Errors by kind and bucket. They are stored: each pass of the texts reads them."""
    errors, f = _errors(spark, d)
    found = f.attached(stored(errors, "errors"), lambda both: both.groupBy("kind", reports.error_bucket(nm, ad).alias("bucket")).agg(F.count("*").alias("n")))
    return found.groupBy("kind", "bucket").agg(F.sum("n").alias("n"))


_ERRORS = "SELECT a_id, b_id, 'fp' AS kind FROM sv WHERE score >= 4.5 AND (a_id, b_id) NOT IN (SELECT (a_id, b_id) FROM truth) UNION ALL SELECT t.a_id, t.b_id, CASE WHEN v.a_id IS NULL THEN 'fn_blocking' ELSE 'fn_scored' END FROM truth t LEFT JOIN sv v USING (a_id, b_id) WHERE v.a_id IS NULL OR v.score < 4.5"
_SV = "SELECT * FROM ranked WHERE rank <= 20"
_BUCKET = (
    "CASE WHEN x.name_key = y.name_key AND x.addr_norm = y.addr_norm THEN 'identical_name_and_address' WHEN x.name_key = y.name_key THEN 'identical_name_different_address' WHEN x.addr_norm = y.addr_norm THEN 'identical_address_different_name' WHEN y.name_nonascii THEN 'transliterated_name' "
    "WHEN y.addr_norm = '' THEN 'empty_address' WHEN {nm} >= 0.85 THEN 'near_identical_name' WHEN {ad} >= 0.85 THEN 'near_identical_address' ELSE 'weak_on_both' END"
).format(nm="(1 - levenshtein(x.name_core, y.name_core) / greatest(length(x.name_core), length(y.name_core), 1))", ad="(1 - levenshtein(x.addr_norm, y.addr_norm) / greatest(length(x.addr_norm), length(y.addr_norm), 1))")
query("error_by_partition", sql.after("ranked truth forms", "SELECT kind, country, count(*) AS n FROM e JOIN forms x ON x.entity_id = e.a_id GROUP BY ALL", sv=_SV, e=_ERRORS))(
    lambda s, d: (lambda e, f: e.join(f.normed.select(F.col("entity_id").alias("a_id"), "country"), "a_id").groupBy("kind", "country").agg(F.count("*").alias("n")))(*_errors(s, d))
)


@query("error_buckets")
def _(spark, d):
    return _ladder(spark, d, *(sim.metric("tokset", F.col(f"a_{v}"), F.col(f"b_{v}")) for v in ("name_key", "addr_norm")))


query("error_ladder", sql.after("ranked truth forms", f"SELECT kind, {_BUCKET} AS bucket, count(*) AS n FROM e JOIN forms x ON x.entity_id = e.a_id JOIN forms y ON y.entity_id = e.b_id GROUP BY ALL", sv=_SV, e=_ERRORS))(
    lambda s, d: _ladder(s, d, *(sim.levenshtein_similarity(F.col(f"a_{v}"), F.col(f"b_{v}")) for v in ("name_core", "addr_norm")))
)


# models, tuning ----------------------------------------------------------------------------------------------------------


def _training(spark: SparkSession, d: str) -> DataFrame:
    """Written once: every pass of a fit reads them again."""
    return stored(models.with_folds(models.labelled(funnel(spark, d).cheap, truth(spark, d))), "training")


@query("train_ranker")
def _(spark, d):
    rows = _training(spark, d)
    model = models.fit("logistic", rows.where("fold <= 4"), list(ranking.CHEAP_FEATURES))
    return ranking.top_k(models.apply(model, rows, "score"), 20).select("a_id", "b_id", "score", "rank")


@query("matcher_scores")
def _(spark, d):
    rows = _training(spark, d)
    model = models.fit("gbt", rows.where("fold < 8"), list(ranking.CHEAP_FEATURES))
    return models.apply(model, rows.where("fold >= 8")).select("a_id", "b_id", "p", "y")


@query("model_compare")
def _(spark, d):
    rows = _training(spark, d)
    held = docs_records(spark, d).where("src = 1").select(F.col("entity_id").alias("a")).where(decisions.fold_of(F.col("a")) >= 8)
    n = truth(spark, d).groupBy(F.col("a_id").alias("a")).agg(F.count("*").alias("n"))
    need = held.join(n, "a", "left").select("a", F.coalesce("n", F.lit(0)).cast("long").alias("n_true"))
    features = list(ranking.CHEAP_FEATURES)
    # the cheap features' own ablation: with and without those that only exist across all keys of a pair
    sets = {"all": features, "base": [f for f in features if f not in ("n_keys", "fam_mask")]}
    table, _ = models.compare(rows.where("fold < 8"), rows.where("fold >= 8"), features, need, sets=sets)
    return table


@query("singleton_signals")
def _(spark, d):
    p = pairs(spark, d).withColumn("cheap", F.col("p") / 2).where("p >= 0.6")
    need = counts(spark, d, pairs(spark, d))
    return models.singletons(decisions.score_shape(p, need), need)[0]


@query("tune_decision")
def _(spark, d):
    p = pairs(spark, d).persist()
    need = counts(spark, d, p).persist()
    cfg, f, log = decisions.tune(p, need)
    return spark.createDataFrame([("chosen", cfg.to_json(), f), *((stage, c.to_json(), v) for stage, c, v in log)], "stage string, config string, macro_f05 double")
