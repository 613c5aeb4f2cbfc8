"""Fits from the different rows and their numbers against fits from all rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmark.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    """Few values, one value of most rows, one feature of many values, one of a single value."""
    n = F.xxhash64("id")
    df = spark.range(4000).select("id", F.pmod(n, F.lit(7)).cast("double").alias("u"), F.when(F.pmod(n, F.lit(10)) > 0, 3.0).otherwise(F.pmod(n, F.lit(91)) / 10).alias("v"), (F.pmod(n, F.lit(300)) / 7).alias("w"), F.lit(2.5).alias("c"))
    return df.withColumn("y", (F.col("u") + F.col("w") / 9 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) > 8).cast("int")).cache()


def test_groups_give_the_fit_of_all_rows(spark, rows):
    features = ["u", "v", "w", "c"]
    both = {}
    for kind in ("gbt", "logistic"):
        want, got = models.estimator(kind, features).fit(rows), models.fit(kind, rows, features)
        found = [models.apply(m, rows).orderBy("id").toPandas() for m in (want, got)]
        assert list(found[1].columns) == [*rows.columns, "p"]
        both[kind] = want, got, np.abs(found[0]["p"] - found[1]["p"])
    assert both["logistic"][2].max() < 1e-4
    # of the trees, the first is the same; later ones may differ where two cuts gain the same
    leaves = [[float(x) for x in re.findall(r"Predict: (\S+)", m.stages[-1].trees[0].toDebugString)] for m in both["gbt"][:2]]
    assert len(leaves[0]) > 20 and np.allclose(*leaves, rtol=0, atol=1e-12) and both["gbt"][2].median() < 0.02


def test_a_fit_reads_each_different_row_once(spark, rows):
    twice = rows.unionByName(rows)
    groups = models.grouped(twice, ["u", "v"])
    assert groups.count() == rows.select("u", "v", "y").distinct().count() and groups.agg(F.sum(models.WEIGHT)).first()[0] == 8000


def test_a_value_at_a_cut_is_below(spark):
    groups = spark.createDataFrame([(1.0, 1, 5.0), (2.0, 0, 5.0)], f"x double, y int, {models.WEIGHT} double")
    made = models.bins(groups, ["x"], 31)
    got = made.transform(spark.createDataFrame([(1.0,), (1.5,), (1.6,), (2.0,), (-9.0,)], "x double")).collect()
    assert [r["_bin_x"] for r in got] == [0.0, 0.0, 1.0, 1.0, 0.0]
