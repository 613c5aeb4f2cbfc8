"""Set-overlap features, the heuristic ranker and top-K (CF1-CF8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmark.operators.blocking import DF_LEVELS, KINDS

NO_ID = 1 << 30
SHORTS = tuple(short for _, short in KINDS.values())
#: Weights of the heuristic score.
WEIGHTS = {"at_cont": 3.0, "mt_cont": 2.5, "an_cont": 1.0, "n_keys": 0.10, "at_r0": 0.6, "mt_r0": 0.5, "at_r1": 0.25, "mt_r1": 0.2}


def levels_of(short: str) -> int:
    return 2 if short == "an" else 3


CHEAP_FEATURES = ("n_keys", "fam_mask", *(f"{s}_{k}" for s in ("at", "mt", "an") for k in ("inter", "jac", "cont", *(f"r{i}" for i in range(levels_of(s))), "minid", "alen", "blen")))


def rarer_than(ids: Column, limit: Column) -> Column:
    return F.size(F.filter(ids, lambda t: t < limit))


def overlap(short: str, a: Column, b: Column, thresholds: list[Column]) -> dict[str, Column]:
    """CF1 for one kind of token."""
    shared = F.array_intersect(a, b)
    n, la, lb = F.size(shared), F.size(a), F.size(b)
    shorter, union = F.least(la, lb), la + lb - n
    out = {
        "inter": n,
        "jac": F.when(union > 0, n / union).otherwise(F.lit(0.0)),
        "cont": F.when(shorter > 0, n / shorter).otherwise(F.lit(0.0)),
        "alen": la,
        "blen": lb,
        "minid": F.log1p(F.coalesce(F.array_min(shared), F.lit(NO_ID)).cast("double")),
    }
    for i in range(levels_of(short)):
        out[f"r{i}"] = rarer_than(shared, thresholds[i])
    return {f"{short}_{k}": v for k, v in out.items()}


def cheap_features(pairs: DataFrame, lists: DataFrame, thresholds: DataFrame) -> DataFrame:
    """CF2: candidates with their 28 cheap features. Thresholds are one row for each country and kind."""
    sides = {"a": "src = 1", "b": "src > 1"} if "src" in lists.columns else {"a": "true", "b": "true"}
    side = lambda p: lists.where(sides[p]).select(F.col("entity_id").alias(f"{p}_id"), *(F.col(f"{s}_all").alias(f"{p}_{s}") for s in SHORTS))
    wide = thresholds.groupBy("country").agg(*(F.max(F.when(F.col("kind") == kind, F.col(f"le_{lv}"))).alias(f"{short}_le_{lv}") for kind, (_, short) in KINDS.items() for lv in DF_LEVELS))
    both = pairs.join(side("a"), "a_id").join(side("b"), "b_id").join(wide, "country", "left")
    made: dict[str, Column] = {}
    for s in SHORTS:
        made |= overlap(s, F.col(f"a_{s}"), F.col(f"b_{s}"), [F.coalesce(f"{s}_le_{lv}", F.lit(0)) for lv in DF_LEVELS])
    out = both.select("country", "a_id", "b_id", "n_keys", "fam_mask", *(c.alias(k) for k, c in made.items()))
    return out.select("country", "a_id", "b_id", *CHEAP_FEATURES)


def heuristic_score() -> Column:
    """CF3."""
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        score = score + F.lit(weight) * F.col(name)
    return score


def ranked(scored: DataFrame, score: str = "score") -> DataFrame:
    """Places by score to nine decimals, so that equal scores are ties whatever the order of additions."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc(F.round(score, 9)), "b_id")))


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """CF4: Spark keeps k rows of each group before the shuffle already."""
    return ranked(scored, score).where(F.col("rank") <= k)


def recall_at(scored: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (8, 12, 16, 20, 24, 32, 48), score: str = "score") -> DataFrame:
    """CF8: (k, found, recall) for all k from one ranking."""
    places = ranked(scored, score).select("a_id", "b_id", "rank").join(truth, ["a_id", "b_id"], "left_semi")
    found = places.agg(*(F.count_if(F.col("rank") <= k).alias(str(k)) for k in ks)).join(F.broadcast(truth.agg(F.count("*").alias("total"))))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("found")) for k in ks)))
    return found.select("total", rows.alias("r")).select("r.k", "r.found", F.round(F.col("r.found") / F.greatest("total", F.lit(1)), 9).alias("recall"))
