"""python -m kinmark STAGE ROOT WORK [--split SPLIT]: one stage of a linkage run, or all of them in turn.

ROOT holds SPLIT/source1.tsv, source2.tsv and source3.tsv, and train/ground_truth.tsv; WORK is the working folder.
``link-untrained`` needs no truth: it links a split with the heuristic ranker and default rules, and audits it.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from kinmark.plans import stages
from kinmark.plans.funnel import run
from kinmark.session import ensure_package, get_spark

STAGES = ("profile", "prepare", "train-ranker", "build-dataset", "train", "score", "tune", "evaluate", "link", "audit")


def report(checks: DataFrame) -> int:
    rows = checks.collect()
    for c in rows:
        print(f"{'ok  ' if c['ok'] else 'FAIL'} {c['check_name']} ({c['detail']})")
    return int(not all(c["ok"] for c in rows))


def run_stage(spark: SparkSession, stage: str, root: str, work: str, split: str) -> int:
    match stage:
        case "profile":
            stages.profile(spark, root, work, split)
        case "prepare":
            stages.prepare(spark, root, work, split)
        case "train-ranker":
            stages.train_ranker(spark, root, work)
        case "build-dataset":
            stages.build_dataset(spark, root, work)
        case "train":
            stages.train(spark, work)
        case "score":
            stages.score(spark, work, split)
        case "tune":
            print(stages.tune(spark, root, work).to_json())
        case "evaluate":
            stages.evaluate(spark, root, work)
        case "link":
            stages.link(spark, work, split)
        case "audit":
            return report(stages.audit(spark, work, split))
        case "link-untrained":
            return report(run(spark, stages.raw_records(spark, root, split), work))
    return 0


def run_all(spark: SparkSession, root: str, work: str, split: str) -> int:
    """Train on train, tune on its held-out folds, publish split."""
    for s in dict.fromkeys(("train", split)):
        run_stage(spark, "profile", root, work, s)
        run_stage(spark, "prepare", root, work, s)
    for stage in ("train-ranker", "build-dataset", "train"):
        run_stage(spark, stage, root, work, "train")
    run_stage(spark, "score", root, work, "train")
    for stage in ("tune", "evaluate"):
        run_stage(spark, stage, root, work, "train")
    if split != "train":
        run_stage(spark, "score", root, work, split)
    run_stage(spark, "link", root, work, split)
    return run_stage(spark, "audit", root, work, split)


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="kinmark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("stage", choices=(*STAGES, "all", "link-untrained"))
    p.add_argument("root")
    p.add_argument("work")
    p.add_argument("--split", default="test")
    a = p.parse_args(args)
    spark = SparkSession.getActiveSession() or get_spark()
    ensure_package(spark)
    return run_all(spark, a.root, a.work, a.split) if a.stage == "all" else run_stage(spark, a.stage, a.root, a.work, a.split)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
