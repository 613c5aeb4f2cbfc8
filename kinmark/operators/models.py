"""Ranker, matcher and singleton models on MLlib (CF5-CF6, ML1-ML4), their files (SK6) and entity splits (PF11)."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import inf, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmark.operators.decisions import auc, fold_of, threshold_sweep
from kinmark.operators.pairwise import GROUP
from kinmark.session import stored

KINDS = ("logistic", "gbt", "gbt_deep", "forest")
THRESHOLDS = tuple(round(0.05 + 0.05 * i, 2) for i in range(19))
#: Folds of the a side: the first ranker's, the matcher's, and those held out.
RANKER_FOLDS, MATCHER_FOLDS, HELD_FOLDS = (0,), tuple(range(1, 8)), (8, 9)


def estimator(kind: str, features: list[str], label: str = "y", seed: int = 17) -> Pipeline:
    """ML1: a model kind over named columns; the vector exists only inside."""
    put = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    common = {"labelCol": label, "featuresCol": "_x"}
    if kind == "logistic":
        scaled = StandardScaler(inputCol="_x", outputCol="_z", withMean=True)
        return Pipeline(stages=[put, scaled, LogisticRegression(labelCol=label, featuresCol="_z", maxIter=50, regParam=1e-3)])
    if kind in ("gbt", "gbt_deep"):
        return Pipeline(stages=[put, GBTClassifier(**common, maxIter=20 if kind == "gbt" else 30, maxDepth=5 if kind == "gbt" else 7, stepSize=0.1, seed=seed)])
    if kind == "forest":
        return Pipeline(stages=[put, RandomForestClassifier(**common, numTrees=50, maxDepth=10, seed=seed)])
    raise ValueError(f"unknown model kind {kind!r}; known: {', '.join(KINDS)}")


#: How often a row occurs.
WEIGHT = "_n"


def grouped(rows: DataFrame, features: Sequence[str], label: str = "y") -> DataFrame:
    """Each different row of features and label once, with its number: features are counts of few values."""
    return stored(rows.groupBy(*features, label).agg(F.count("*").cast("double").alias(WEIGHT)), "grouped")


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        *columns, weight = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        for i, c in enumerate(columns):
            known = ~np.isnan(c)
            value, at = np.unique(c[known], return_inverse=True)
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(len(value), i, np.int32)), "value": pa.array(value), "n": pa.array(np.bincount(at, weight[known], len(value)))})


def _cut(values: pd.DataFrame, most: int) -> pd.DataFrame:
    """MLlib's own rule: cuts half-way between values, where the number below comes nearest to the next of equal shares."""
    values = values.sort_values("value")
    v, upto = values["value"].to_numpy(), np.cumsum(values["n"].to_numpy())
    at = list(range(1, len(v)))
    if len(at) > most:
        stride = upto[-1] / (most + 1)
        at, target, counts = [], stride, upto.tolist()
        for k in range(1, len(counts)):
            if abs(counts[k - 1] - target) < abs(counts[k] - target):
                at.append(k)
                target += stride
    return pd.DataFrame({"i": np.full(len(at), values["i"].iloc[0], np.int32), "cut": (v[at] + v[np.array(at, int) - 1]) / 2})


def bins(groups: DataFrame, features: Sequence[str], most: int) -> Bucketizer:
    """The at most ``most`` + 1 bins of each feature that a tree of MLlib tells apart, from all rows where it takes those of a
    sample. A value at a cut is below it."""
    columns = groups.select(*(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)), WEIGHT)
    counts = columns.mapInArrow(_values, "i int, value double, n double").groupBy("i", "value").agg(F.sum("n").alias("n"))
    cuts: dict[int, list[float]] = {}
    for r in counts.groupBy("i").applyInPandas(lambda values: _cut(values, most), "i int, cut double").collect():
        cuts.setdefault(r["i"], []).append(float(np.nextafter(r["cut"], inf)))
    return Bucketizer(splitsArray=[[-inf, *sorted(cuts.get(i, [0.0])), inf] for i in range(len(features))], inputCols=list(features), outputCols=[f"_bin_{f}" for f in features], handleInvalid="keep")


def fit(kind: str, train: DataFrame, features: list[str], label: str = "y", seed: int = 17, groups: DataFrame | None = None) -> PipelineModel:
    """``estimator(...).fit(train)`` from its different rows and how often they occur. Boosted trees see only bins, so rows
    of the same bins are one; a forest draws rows one by one, so it gets all of them. groups: ``grouped`` rows with these
    features or more."""
    put, *scaler, last = estimator(kind, features, label, seed).getStages()
    if kind == "forest":
        return Pipeline(stages=[put, last]).fit(train)
    groups = grouped(train, features, label) if groups is None else groups
    last = last.setWeightCol(WEIGHT)
    if scaler:  # means and deviations are those of all rows, so that the penalty is
        made = Pipeline(stages=[put, *scaler]).fit(train)
        return PipelineModel([*made.stages, last.setStandardization(False).fit(made.transform(groups))])
    made = bins(groups, features, last.getMaxBins() - 1)
    names = made.getOutputCols()
    of = [(F.col(c) + 0.0).alias(c) for c in names]  # without what the column says of itself: as numbers, not as categories
    few = stored(made.transform(groups).groupBy(*of, label).agg(F.sum(WEIGHT).alias(WEIGHT)), "binned")
    # so many bins are allowed that MLlib looks at every row for them; there are no more than before
    last = last.setMaxBins(max(last.getMaxBins(), min(46_340, isqrt(few.count()) + 1)))
    put = VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="keep")
    return PipelineModel([made, put, last.fit(put.transform(few))])


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """ML3: candidates with y; negatives are the candidates that are not true."""
    return pairs.join(truth.withColumn("y", F.lit(1)), ["a_id", "b_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def with_folds(df: DataFrame) -> DataFrame:
    return df.withColumn("fold", fold_of(F.col("a_id")))


def apply(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    """CF6: the probability of label 1 as a column."""
    keep = [c for c in df.columns if c != name]
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(name))


def feature_sets(features: Sequence[str]) -> dict[str, list[str]]:
    """ML2's ablation: all features, and those without the candidate group's."""
    return {"all": list(features), "base": [f for f in features if f not in GROUP]}


@dataclass(frozen=True)
class Fitted:
    """A model with what is needed to apply it elsewhere."""

    model: PipelineModel
    kind: str
    feature_set: str
    features: list[str]
    threshold: float
    macro_f05: float


def compare(
    train: DataFrame, held: DataFrame, features: Sequence[str], truth_counts: DataFrame, kinds: Sequence[str] = KINDS, thresholds: Sequence[float] = THRESHOLDS, sets: dict[str, list[str]] | None = None
) -> tuple[DataFrame, Fitted]:
    """ML2: (kind, feature_set, n_features, threshold, macro_f05) of each model's best threshold on held-out entities,
    and the best model; a tie stays with the earlier one."""
    rows, best = [], None
    train, held = train.persist(), held.persist()  # every fit reads them again
    groups = grouped(train, list(features))
    for name, columns in (sets or {"all": list(features)}).items():
        for kind in kinds:
            fitted = fit(kind, train, columns, groups=groups)
            scored = apply(fitted, held).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "p", "y")
            top = threshold_sweep(scored, truth_counts, list(thresholds)).orderBy(F.desc("macro_f05"), "threshold").first()
            rows.append((kind, name, len(columns), top["threshold"], top["macro_f05"]))
            if best is None or top["macro_f05"] > best.macro_f05:
                best = Fitted(fitted, kind, name, columns, top["threshold"], top["macro_f05"])
    train.unpersist(), held.unpersist()
    return train.sparkSession.createDataFrame(rows, "kind string, feature_set string, n_features int, threshold double, macro_f05 double"), best


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return sorted(zip(features, (float(abs(v)) for v in values.toArray()), strict=True), key=lambda x: -x[1])


def save(fitted: Fitted, path: str, **more: object) -> None:
    """SK6: the model and, beside it, one row of what it was fitted on (any file system that Spark writes to)."""
    fitted.model.write().overwrite().save(f"{path}/model")
    about = {k: getattr(fitted, k) for k in ("kind", "feature_set", "features", "threshold", "macro_f05")} | more
    about["importances"] = importances(fitted.model, fitted.features)
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> tuple[Fitted, dict]:
    """SC13: a saved model, and all that was said about it."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    model = PipelineModel.load(f"{path}/model")
    return Fitted(model, *(about[k] for k in ("kind", "feature_set", "features", "threshold", "macro_f05"))), about


SHAPE = ("n", "best", "second", "gap", "total", "over_half", "over_nine", "best_cheap")


def split_entities(df: DataFrame, key: str, share: float = 0.5, seed: str = "3") -> tuple[DataFrame, DataFrame]:
    """PF11: a random part of the entities, and the others; all rows of an entity are on one side, in every run."""
    first = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") < int(share * 2**32)
    return df.where(first), df.where(~first)


def singletons(shape: DataFrame, truth_counts: DataFrame, kind: str = "gbt") -> tuple[DataFrame, Fitted]:
    """ML4: can an entity without a match be told from how its scores look? (signal, auc) of each signal alone (fewer
    or lower means singleton) and of a model of all of them, the latter on the half that it was not fitted on."""
    rows = shape.join(truth_counts, "a").withColumn("y", (F.col("n_true") == 0).cast("int"))
    train, held = split_entities(rows, "a")
    model = estimator(kind, list(SHAPE)).fit(train)
    signed = rows.select("y", *((-F.col(c).cast("double")).alias(c) for c in SHAPE))
    table = None
    for df, name in (*((signed, c) for c in SHAPE), (apply(model, held, "model"), "model")):
        one = auc(df, name, "y").select(F.lit(name).alias("signal"), "auc", "n_pos", "n_neg")
        table = one if table is None else table.unionByName(one)
    return table, Fitted(model, kind, "shape", list(SHAPE), 0.5, 0.0)
