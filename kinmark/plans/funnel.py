"""The linkage funnel as one lazy plan (OR1, CF7): forms, vocabulary, keys, candidates, features, scores, decisions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmark.functions.text import normalised, with_views
from kinmark.operators import blocking, decisions, models, packed, pairwise, ranking, reports
from kinmark.operators.blocking import BlockConfig
from kinmark.operators.decisions import DecisionConfig
from kinmark.operators.models import Fitted
from kinmark.session import dropped, ensure_package, stored


class Funnel:
    """records: entity_id, src (1 for the a side), country, business_name, business_address. The
    tables that later steps read again (normalised texts, vocabulary, id lists, candidates) are written to the shared
    folder when they are first asked for; the shuffles of each write are gone before the next."""

    def __init__(self, records: DataFrame, cfg: BlockConfig | None = None, top: int = 20, folds: Sequence[int] | None = None, ranker: Fitted | None = None):
        """folds: only entities of these folds probe (the vocabulary is over all records all the same). ranker: scores
        candidates in place of the heuristic."""
        ensure_package(records.sparkSession)
        self.records, self.cfg, self.top, self.folds, self.ranker = records, cfg or BlockConfig(), top, folds, ranker

    @cached_property
    def normed(self) -> DataFrame:
        """The normalised texts, from which all views are made again where they are needed: the patterns cost most,
        the views take several times the space."""
        return stored(normalised(self.records).select("entity_id", "src", "country", "name_norm", "addr_norm", "name_nonascii", "addr_nonascii"), "normed")

    @cached_property
    def forms(self) -> DataFrame:
        return with_views(self.normed)

    @cached_property
    def vocabulary(self) -> DataFrame:
        """Always over all records of both sides, so that a filter on the a side never changes an id."""
        return blocking.vocabulary_of(self.normed)

    @cached_property
    def thresholds(self) -> DataFrame:
        return blocking.rarity_thresholds(self.vocabulary)

    @cached_property
    def lists(self) -> DataFrame:
        return blocking.linked_lists(self.normed, self.vocabulary)

    @cached_property
    def prepared(self) -> DataFrame:
        return blocking.with_heads(self.lists, self.cfg)

    def side(self, a: bool) -> DataFrame:
        return self.prepared.where("src = 1" if a else "src > 1")

    @property
    def probing(self) -> DataFrame:
        one = self.lists.where("src = 1")
        return one if self.folds is None else one.where(decisions.fold_of(F.col("entity_id")).isin(*self.folds))

    @cached_property
    def a_keys(self) -> DataFrame:
        return blocking.make_keys(blocking.with_heads(self.probing, self.cfg), self.cfg)

    @cached_property
    def b_keys(self) -> DataFrame:
        return blocking.make_keys(self.side(False), self.cfg)

    @cached_property
    def index(self) -> DataFrame:
        return blocking.capped_index(self.b_keys, self.cfg)

    def index_under(self, cfg: BlockConfig) -> DataFrame:
        """The b side's keys under the caps of cfg; texts are not needed any more then."""
        b, (n, numbered, *_) = self.lists.where("src > 1"), blocking.passes_of(self.lists)
        if not numbered:
            return blocking.capped_index(self.b_keys, cfg)
        if "forms" not in self.__dict__:
            dropped(self.__dict__.pop("normed"))
        return packed.capped_index(b, replace(self.cfg, max_block=cfg.max_block, max_block_by_family=cfg.max_block_by_family), n)

    def true_masks(self, truth: DataFrame) -> DataFrame:
        """(fam_mask, n) of the true candidates, without a table of all candidates if ids and configuration allow it."""
        n, numbered, *passes = blocking.passes_of(self.lists)
        if not numbered or self.cfg.max_candidates or "candidates" in self.__dict__:
            return blocking.true_masks(self.candidates, truth)
        return packed.true_masks(self.lists, self.probing, truth, self.cfg, n, *passes)

    def attached(self, pairs: DataFrame, made_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``made_of`` pairs with both sides' text views; of many records, stored in passes over the a side."""
        if self.normed.count() < blocking.MANY_RECORDS:
            return made_of(pairwise.attach_text(pairs, self.normed))
        n, part = blocking.PASSES, F.pmod(F.xxhash64("a_id"), F.lit(blocking.PASSES))
        mine = self.normed.select("*", F.pmod(F.xxhash64("entity_id"), F.lit(n)).alias("_part"))
        of = lambda i: mine.where((F.col("src") > 1) | (F.col("_part") == i)).drop("_part")
        return reduce(DataFrame.unionByName, [stored(made_of(pairwise.attach_text(pairs.where(part == i), of(i))), "attached") for i in range(n)])

    @cached_property
    def candidates(self) -> DataFrame:
        return blocking.probe_in_passes(self.lists, self.probing, self.cfg)

    def _overlaps(self, top: int = 0) -> DataFrame | None:
        """The cheap features (of the best candidates, with score and rank) without candidates in between, if ids and
        configuration allow it and no candidates are there."""
        if "candidates" in self.__dict__ or self.cfg.max_candidates:
            return None
        n, numbered, *passes = blocking.passes_of(self.lists)
        return packed.overlaps(self.lists, self.probing, self.thresholds, self.cfg, n, *passes, top, self._release) if numbered else None

    def _release(self) -> None:
        """The stored id lists go; they are made again if something asks for them."""
        if "prepared" not in self.__dict__:
            dropped(self.__dict__.pop("lists"))

    @cached_property
    def cheap(self) -> DataFrame:
        made = self._overlaps()
        return made if made is not None else ranking.cheap_features(self.candidates, self.lists, self.thresholds)

    @cached_property
    def scored(self) -> DataFrame:
        if self.ranker is not None:
            return models.apply(self.ranker.model, self.cheap, "score")
        return self.cheap.withColumn("score", ranking.heuristic_score())

    @cached_property
    def _best(self) -> DataFrame | None:
        """The survivors as stored tables, where the overlaps give them."""
        return self._overlaps(self.top) if self.ranker is None and "cheap" not in self.__dict__ else None

    @cached_property
    def survivors(self) -> DataFrame:
        return self._best if self._best is not None else ranking.top_k(self.scored, self.top)

    @cached_property
    def kept(self) -> DataFrame:
        """The survivors, written for what reads them again or joins them further."""
        return self._best if self._best is not None else stored(self.survivors, "survivors")

    @cached_property
    def features(self) -> DataFrame:
        b_side = self.forms.where("src > 1")
        return pairwise.feature_table(self.kept.drop("rank"), self.normed, b_side)

    def decided(self, scored: DataFrame, cfg: DecisionConfig) -> DataFrame:
        """scored: a_id, b_id, p."""
        pairs = scored.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "p", F.col("b_id").startswith("S3-").cast("int").alias("is_s3"))
        return decisions.decide(pairs, cfg)

    def publish(self, scored: DataFrame, cfg: DecisionConfig) -> tuple[DataFrame, DataFrame]:
        """SU1: match lists and candidate lists of every a entity; matches are candidates by construction."""
        scope = self.records.where("src = 1").select(F.col("entity_id").alias("a"))
        pairs = scored.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
        return decisions.match_lists(self.decided(scored, cfg), scope), decisions.match_lists(pairs, scope, "candidate_entity_ids")

    def close(self) -> None:
        """Tables are files in the shared folder, which go when the driver ends."""


def run(spark: SparkSession, records: DataFrame, out: str, cfg: BlockConfig | None = None, decision: DecisionConfig | None = None) -> DataFrame:
    """Index, score with the heuristic scaled to [0, 1], decide, write both TSVs, and return the audit."""
    from kinmark.sources.records import write_tsv

    funnel = Funnel(records, cfg)
    scored = funnel.survivors.withColumn("p", F.least(F.lit(1.0), F.col("score") / 8.0))
    matches, candidates = funnel.publish(scored, decision or DecisionConfig(threshold=0.6, exclusive=True))
    reports.assert_not_empty(matches)
    write_tsv(matches, f"{out}/matching_results", "source1_entity_id")
    write_tsv(candidates, f"{out}/candidate_pairs", "source1_entity_id")
    return reports.audit(matches, candidates, records.where("src = 1").select("entity_id"), records.where("src > 1").select("entity_id"))
