"""Pair features of the registered queries."""

from pyspark.sql import functions as F

from kinmark.functions import similarity as sim
from kinmark.operators import pairwise
from kinmark.plans import queries


def test_interactions_take_edits_by_the_batch(spark):
    d = "/root/testdata/sf0.001"
    got = queries.QUERIES["interaction_feats"](spark, d)
    assert "levenshtein(" not in got._jdf.queryExecution().analyzed().toString()
    plain = pairwise.interactions(*(sim.levenshtein_similarity(F.col(f"a_{v}"), F.col(f"b_{v}")) for v in ("name_core", "addr_norm")))
    want = queries._text_pairs(spark, d, *((c if "weak" in k else F.round(c, 9)).alias(k) for k, c in plain.items()))
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect()) != []
