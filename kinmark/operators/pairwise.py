"""Derived, country and group features (DF1-DF6, GF1-GF2, FX1-FX2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmark.functions.similarity import STRING_FEATURES, VIEWS, string_features
from kinmark.functions.text import with_views
from kinmark.operators.ranking import CHEAP_FEATURES

# Names and order of the feature columns, which trained models and their files depend on.
TEXT_COLUMNS = (*VIEWS, "name_nonascii", "addr_nonascii")
NORMALISED = ("name_norm", "addr_norm", "name_nonascii", "addr_nonascii")
COUNTRY_FEATURES = ("ctry_index_log", "ctry_nonlatin_rate", "ctry_addr_tok_mean")
DERIVED = (
    "nm_exact", "nmkey_exact", "nmns_exact", "ad_exact", "both_exact", "nm_len_a", "nm_len_b", "nm_len_diff", "nm_len_ratio", "ad_len_a", "ad_len_b",
    "ad_len_diff", "ad_len_ratio", "b_addr_empty", "b_name_nonlatin", "b_addr_nonlatin", "is_s3", "nm_ad_prod", "nm_ad_max", "nm_ad_min", "nm_ad_wsum",
    "strong_nm_weak_ad", "weak_nm_strong_ad", *COUNTRY_FEATURES,
)
GROUP = ("g_cheap", "g_n_cands", "g_rank", "g_cheap_best", "g_cheap_margin", "g_cheap_gap2", "g_cheap_share", "g_nm_best", "g_nm_margin", "g_ad_best", "g_ad_margin")
FEATURE_NAMES = (*(name for name, _, _ in STRING_FEATURES), *DERIVED, *CHEAP_FEATURES, *GROUP)


def attach_text(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """FX2: both sides' text views, prefixed a_ and b_. Views are made after the joins, which carry what they are
    made of; records with src are read on their own side only."""
    sides = {"a": "src = 1", "b": "src > 1"} if "src" in records.columns else {"a": "true", "b": "true"}
    side = lambda p: records.where(sides[p]).select(F.col("entity_id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in NORMALISED))
    both = with_views(with_views(pairs.join(side("a"), "a_id").join(side("b"), "b_id"), "a_"), "b_")
    return both.select(*pairs.columns, *(f"{p}_{c}" for p in "ab" for c in TEXT_COLUMNS))


def country_descriptors(b_side: DataFrame) -> DataFrame:
    """DF6: one row for each country of the b side."""
    return b_side.groupBy("country").agg(
        F.log1p(F.count("*").cast("double")).alias("ctry_index_log"), F.avg(F.col("name_nonascii").cast("double")).alias("ctry_nonlatin_rate"), F.avg(F.size("addr_toks").cast("double")).alias("ctry_addr_tok_mean")
    )


def exact_flags() -> dict[str, Column]:
    """DF1."""
    same = lambda v: F.col(f"a_{v}") == F.col(f"b_{v}")
    flags = {"nm_exact": same("name_norm"), "nmkey_exact": same("name_key"), "nmns_exact": same("name_core_nospace"), "ad_exact": same("addr_norm"), "both_exact": same("name_norm") & same("addr_norm")}
    return {k: v.cast("int") for k, v in flags.items()}


def length_features() -> dict[str, Column]:
    """DF2."""
    out = {}
    for short, view in (("nm", "name_core"), ("ad", "addr_norm")):
        a, b = F.length(f"a_{view}"), F.length(f"b_{view}")
        out |= {f"{short}_len_a": a, f"{short}_len_b": b, f"{short}_len_diff": F.abs(a - b), f"{short}_len_ratio": F.least(a, b) / F.greatest(a, b, F.lit(1))}
    return out


def interactions(nm: Column, ad: Column) -> dict[str, Column]:
    """DF4, DF5 of a name and an address similarity."""
    return {
        "nm_ad_prod": nm * ad, "nm_ad_max": F.greatest(nm, ad), "nm_ad_min": F.least(nm, ad), "nm_ad_wsum": 0.45 * nm + 0.55 * ad,
        "strong_nm_weak_ad": ((nm > 0.9) & (ad < 0.6)).cast("int"), "weak_nm_strong_ad": ((nm < 0.6) & (ad > 0.9)).cast("int"),
    }


def group_features(pairs: DataFrame, score: str, nm: str, ad: str) -> DataFrame:
    """GF1: each a's candidates seen together; one window, so one shuffle. Margins are the value less the best one,
    so never positive; the gap is the best less the runner-up (0 for a single candidate)."""
    of_a = Window.partitionBy("a_id")
    out = pairs.withColumn("g_rank", F.row_number().over(of_a.orderBy(F.desc(F.round(score, 9)), "b_id")))
    best, total = F.max(score).over(of_a), F.sum(score).over(of_a)
    second = F.coalesce(F.max(F.when(F.col("g_rank") == 2, F.col(score))).over(of_a), best)
    return out.withColumns(
        {
            "g_cheap": F.col(score), "g_n_cands": F.count("*").over(of_a), "g_cheap_best": best, "g_cheap_margin": F.col(score) - best, "g_cheap_gap2": best - second,
            "g_cheap_share": F.when(total > 0, F.col(score) / total).otherwise(F.lit(0.0)), "g_nm_best": F.max(nm).over(of_a), "g_nm_margin": F.col(nm) - F.max(nm).over(of_a),
            "g_ad_best": F.max(ad).over(of_a), "g_ad_margin": F.col(ad) - F.max(ad).over(of_a),
        }
    )


def both_side_features(pairs: DataFrame, score: str, nm: str, ad: str) -> DataFrame:
    """GF2: rank and margin around a, and the competition for b. Margins and relative values are never positive."""
    a, b = Window.partitionBy("a_id"), Window.partitionBy("b_id")
    less_best = lambda c, w: F.col(c) - F.max(c).over(w)
    return pairs.withColumns(
        {
            "grp_n_cands": F.count("*").over(a), "grp_rank": F.row_number().over(a.orderBy(F.desc(score), "b_id")), "grp_best_score": F.max(score).over(a), "grp_margin_best": less_best(score, a),
            "grp_nm_rel": less_best(nm, a), "grp_ad_rel": less_best(ad, a), "bside_n_competitors": F.count("*").over(b), "bside_rank": F.row_number().over(b.orderBy(F.desc(score), "a_id")), "bside_margin_best": less_best(score, b),
        }
    )


def feature_table(ranked: DataFrame, records: DataFrame, b_side: DataFrame) -> DataFrame:
    """FX1: country, a_id, b_id, then the 85 features in order. ranked: candidates with cheap features and score.
    The group features' name signal is the better of name and address similarity (``nm_ad_max``), their address
    signal the token-set ratio of the addresses."""
    full = attach_text(ranked, records).join(country_descriptors(b_side), "country", "left")
    strings = string_features({v: (F.col(f"a_{v}"), F.col(f"b_{v}")) for v in VIEWS})
    full = full.select("*", *(c.alias(k) for k, c in strings.items()))
    nm, ad = F.greatest("nm_tokset", "nmns_ratio"), F.greatest("ad_tokset", "ad_ratio")
    more = exact_flags() | length_features() | interactions(nm, ad)
    more |= {
        "b_addr_empty": (F.length("b_addr_norm") == 0).cast("int"), "b_name_nonlatin": F.col("b_name_nonascii").cast("int"), "b_addr_nonlatin": F.col("b_addr_nonascii").cast("int"),
        "is_s3": F.col("b_id").startswith("S3-").cast("int"),
    } | {c: F.coalesce(c, F.lit(0.0)) for c in COUNTRY_FEATURES}
    return group_features(full.withColumns(more), "score", "nm_ad_max", "ad_tokset").select("country", "a_id", "b_id", *FEATURE_NAMES)
