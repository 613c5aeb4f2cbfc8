"""The funnel, decisions and metrics on small tables; registered queries against their SQL."""

import dataclasses
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from kinmark.functions.text import with_forms
from kinmark.operators import blocking, decisions, models, pairwise, ranking, reports
from kinmark.operators.blocking import BlockConfig
from kinmark.operators.decisions import DecisionConfig
from kinmark.plans import queries as plans
from kinmark.plans.funnel import Funnel, run
from kinmark.sources import records as src
from kinmark.streaming.probe import probe_stream

SF = "/root/testdata/sf0.001"
RECORDS = [
    ("S1-1", 1, "x", "Big Red Trading LLC", "12 Elm Road Springfield"), ("S1-2", 1, "x", "Alone", "1 Oak"), ("S1-3", 1, "x", "", ""), ("S2-1", 2, "x", "Big Red Trading", "12 Elm St Springfield"),
    ("S3-1", 3, "x", "big red trading inc", "Elm Springfield 12"), ("S2-2", 2, "x", "Green Apples", "7 Pine Hill Shelbyville"), ("S2-9", 2, "y", "Big Red Trading", "12 Elm Springfield"),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, "entity_id string, src int, country string, business_name string, business_address string")


def test_funnel_links_within_a_country(records):
    f = Funnel(records)
    got = {(r["a_id"], r["b_id"]) for r in f.survivors.collect()}
    assert got == {("S1-1", "S2-1"), ("S1-1", "S3-1")}
    row = f.features.where("b_id = 'S3-1'").first()
    assert row["nmkey_exact"] == 1 and row["is_s3"] == 1 and row["g_n_cands"] == 2 and row["nm_tokset"] == 1
    f.close()


def test_same_result_for_other_partitionings(spark, records):
    want = None
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted(map(tuple, Funnel(records.repartition(3)).scored.select("a_id", "b_id", F.round("score", 9)).collect()))
        assert want is None or got == want
        want = got
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_degenerate_pairs_are_a_flag(records):
    one = Funnel(records).prepared.where("entity_id = 'S1-2'")
    loose = blocking.make_keys(one, BlockConfig()).where("fam = 3").count()
    strict = blocking.make_keys(one, BlockConfig(degenerate_pairs=False)).where("fam = 3").count()
    assert (loose, strict) == (1, 0)


def test_configs_round_trip():
    assert BlockConfig.from_json(BlockConfig(max_block=7).to_json()) == BlockConfig(max_block=7)
    assert DecisionConfig.from_json(DecisionConfig(exclusive=True).to_json()).exclusive


@pytest.mark.parametrize(("true", "given", "hit", "f"), [(0, 0, 0, 1.0), (0, 3, 0, 0.0), (2, 0, 0, 0.0), (3, 4, 3, 0.789474)])
def test_f_half(spark, true, given, hit, f):
    got = spark.range(1).select(decisions.f_half(F.lit(true), F.lit(given), F.lit(hit))).first()[0]
    assert round(got, 6) == f


def test_rules_and_ties(spark):
    p = spark.createDataFrame([(1, 10, 0.9, 1, 0), (1, 11, 0.9, 0, 1), (2, 10, 0.9, 1, 0), (2, 12, 0.4, 0, 1), (3, 13, 0.3, 1, 0)], "a long, b long, p double, y int, is_s3 int")
    pick = lambda **k: sorted((r["a"], r["b"]) for r in decisions.decide(p, DecisionConfig(**k)).collect())
    assert pick(threshold=0.35) == [(1, 10), (1, 11), (2, 10), (2, 12)]
    assert pick(threshold=0.35, exclusive=True) == [(1, 10), (1, 11), (2, 12)]
    assert pick(threshold=0.1, max_matches=1) == [(1, 10), (2, 10), (3, 13)]
    assert pick(threshold=0.1, min_best=0.5, rel_threshold=0.5) == [(1, 10), (1, 11), (2, 10)]
    assert pick(threshold=0.35, threshold_s3=0.95) == [(1, 10), (2, 10)]
    need = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0)], "a long, n_true long")
    sweep = {r["threshold"]: r["macro_f05"] for r in decisions.threshold_sweep(p, need, [0.2, 0.35, 0.95]).collect()}
    for t, f in sweep.items():
        assert f == decisions.score_labelled(decisions.decide(p, DecisionConfig(threshold=t)), need).first()["macro_f05"]
    cfg, best, log = decisions.tune(p, need)
    assert best >= max(sweep.values()) and len(log) == 86


def test_tuner_takes_the_best_of_each_stage_in_turn(spark):
    import random

    r = random.Random(5)
    rows = [(a, b, round(r.random(), 2), int(r.random() < 0.4), r.randint(0, 1)) for a in range(40) for b in r.sample(range(60), r.randint(0, 12))]
    p = spark.createDataFrame(rows, "a long, b long, p double, y int, is_s3 int")
    need = spark.createDataFrame([(a, sum(x[3] for x in rows if x[0] == a)) for a in range(45)], "a long, n_true long")
    cfg, best, log = decisions.tune(p, need)
    score = lambda c: decisions.score_labelled(decisions.decide(p, c), need).first()["macro_f05"]
    assert score(cfg) == best == max(f for _, _, f in log)
    for stage, c, f in log[::9]:
        assert score(c) == f, stage


def test_margins_are_never_positive_and_flags_use_the_normalised_name(spark):
    p = spark.createDataFrame([("a1", "b1", 3.0, 0.9, 0.2), ("a1", "b2", 1.0, 0.4, 0.8), ("a2", "b1", 2.0, 0.5, 0.5)], "a_id string, b_id string, s double, nm double, ad double")
    g = {(r["a_id"], r["b_id"]): r for r in pairwise.group_features(p, "s", "nm", "ad").collect()}
    x, lone = g["a1", "b2"], g["a2", "b1"]
    assert (x["g_cheap_margin"], x["g_cheap_gap2"], x["g_nm_margin"], x["g_ad_margin"], x["g_cheap_share"]) == (-2.0, 2.0, -0.5, 0.0, 0.25)
    assert (lone["g_cheap_margin"], lone["g_cheap_gap2"], lone["g_rank"]) == (0.0, 0.0, 1)
    both = {(r["a_id"], r["b_id"]): r for r in pairwise.both_side_features(p, "s", "nm", "ad").collect()}
    x = both["a2", "b1"]
    assert (x["bside_margin_best"], x["bside_rank"], x["bside_n_competitors"], x["grp_margin_best"]) == (-1.0, 2, 2, 0.0)
    assert both["a1", "b2"]["grp_nm_rel"] == -0.5 and both["a1", "b1"]["grp_ad_rel"] == pytest.approx(-0.6)
    views = {v: "same" for side in "ab" for v in (f"{side}_name_core", f"{side}_name_key", f"{side}_name_core_nospace", f"{side}_addr_norm")}
    row = spark.createDataFrame([(*views.values(), "same ltd", "same")], ", ".join(f"{v} string" for v in (*views, "a_name_norm", "b_name_norm")))
    flags = row.select(*(c.alias(k) for k, c in pairwise.exact_flags().items())).first()
    assert (flags["nm_exact"], flags["nmkey_exact"], flags["ad_exact"], flags["both_exact"]) == (0, 1, 1, 0)


def test_score_shape_and_auc(spark):
    p = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.7, 0), (2, 1, 0.6, 1), (2, 3, None, 0)], "a long, b long, p double, y int")
    scope = spark.createDataFrame([(1,), (2,), (3,)], "a long")
    shape = {r["a"]: r for r in decisions.score_shape(p.where("p is not null"), scope).collect()}
    assert (shape[1]["gap"], shape[2]["second"], shape[2]["gap"], shape[3]["n"], shape[3]["best_cheap"]) == (pytest.approx(0.2), 0.6, 0.0, 0, 0.0)
    assert decisions.auc(p, "p", "y").first()["auc"] == 0.5
    assert decisions.auc(p.limit(0), "p", "y").first()["auc"] is None
    many = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("s"), (F.col("id") * 7919 % 1000 * 31 % 100 < F.col("id") * 7919 % 1000 / 10).cast("int").alias("y")).cache()
    rows = many.groupBy("s").agg(F.sum("y").alias("pos"), (F.count("*") - F.sum("y")).alias("neg")).orderBy("s").collect()
    wins, below = 0.0, 0
    for r in rows:
        wins, below = wins + r["pos"] * (below + r["neg"] / 2), below + r["neg"]
    assert decisions.auc(many, "s", "y", ranges=7).first()["auc"] == pytest.approx(wins / (sum(r["pos"] for r in rows) * below), abs=1e-9)


def test_vocabulary_ranks(spark):
    import random

    r = random.Random(9)
    words = ["".join(r.choices("abcé0", k=r.randint(1, 5))) for _ in range(200)]
    rows = [(i, "xy"[i % 2], r.sample(words, 6), [], []) for i in range(60)]
    df = spark.createDataFrame(rows, "entity_id int, country string, name_toks array<string>, addr_toks array<string>, addr_nums array<string>")
    got = {}
    for v in blocking.vocabulary(df).collect():
        got.setdefault((v["country"], v["kind"]), []).append((v["tid"], v["df"], v["tok"]))
    for ranks in got.values():
        assert [t for t, _, _ in sorted(ranks)] == list(range(len(ranks)))
        assert [(n, w) for _, n, w in sorted(ranks)] == sorted(((n, w) for _, n, w in ranks), key=lambda x: (x[0], x[1].encode()))


def test_folds_and_samples(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    folds = df.select(decisions.fold_of(F.col("k")).alias("f")).groupBy("f").count().collect()
    assert sum(r["count"] for r in folds) == 500 and len(folds) == 10
    assert decisions.seeded_sample(df, "k", 7, "s").count() == 7


def test_tsv_round_trip_and_publication(spark, tmp_path, records):
    path = str(tmp_path / "t.tsv")
    with open(path, "w") as f:
        f.write('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "quoted" name\t\tx\n')
    r = src.read_tsv(spark, path, src.RECORD).first()
    assert r["business_name"] == 'A "quoted" name' and r["business_address"] == ""
    checks = run(spark, records, str(tmp_path / "out")).collect()
    assert all(c["ok"] for c in checks) and len(checks) == 13
    back = src.read_tsv(spark, str(tmp_path / "out/matching_results"), src.TRUTH)
    assert back.where("source1_entity_id = 'S1-1'").first()["matched_entity_ids"] == "S2-1,S3-1"
    prepared = records.select(F.lit("train").alias("split"), F.col("src").alias("source"), "country", "entity_id")
    src.write_prepared(prepared, str(tmp_path / "p"))
    assert src.load_prepared(spark, str(tmp_path / "p"), "train", 2, "x", ["entity_id"]).count() == 2
    assert src.read_json_or_none(str(tmp_path / "none.json")) is None
    (tmp_path / "a.jsonl").write_text(json.dumps({"k": 1}) + "\n")
    assert src.read_json_or_none(str(tmp_path / "a.jsonl")) == [{"k": 1}]


def test_audit_finds_faults(spark):
    m = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", "S1-9")], "a string, b string")
    c = spark.createDataFrame([("S1-1", "")], "a string, b string")
    out = {r["check_name"]: r["ok"] for r in reports.audit(m, c, spark.createDataFrame([("S1-1",), ("S1-2",)], "a string"), spark.createDataFrame([("S2-1",)], "b string")).collect()}
    assert not any(out[k] for k in ("matches_cover_scope", "no_repeated_match_rows", "no_repeated_ids_in_a_list", "only_other_sources", "matched_ids_exist", "matches_are_candidates", "has_candidates"))
    with pytest.raises(ValueError):
        reports.assert_not_empty(c.toDF("source1_entity_id", "matched_entity_ids"))


def test_profile_with_sketches(records):
    exact, sketch = ({r["src"]: r.asDict() for r in reports.profile_source(records, approximate=a).collect()} for a in (False, True))
    assert exact == sketch and exact[1]["n_rows"] == 3


def test_models_rank_true_pairs_first(spark):
    rows = [(f"S1-{i}", f"S2-{i}-{j}", float(j == 0) + 0.01 * (i % 7), int(j == 0)) for i in range(60) for j in range(4)]
    df = spark.createDataFrame(rows, "a_id string, b_id string, s double, y int")
    model = models.estimator("logistic", ["s"]).fit(df)
    top = ranking.top_k(models.apply(model, df, "score"), 1)
    assert top.agg(F.sum("y")).first()[0] == 60
    assert models.importances(model, ["s"])[0][0] == "s"
    with pytest.raises(ValueError):
        models.estimator("other", ["s"])


def test_stream_gives_the_batch_result(spark, tmp_path, records):
    f = Funnel(records)
    cfg = dataclasses.replace(f.cfg)
    incoming = str(tmp_path / "in")
    f.records.where("src = 1").select("entity_id", "country", "business_name", "business_address").repartition(2).write.parquet(incoming)
    got = []
    stream = spark.readStream.schema("entity_id string, country string, business_name string, business_address string").option("maxFilesPerTrigger", 1).parquet(incoming)
    q = probe_stream(stream, f.vocabulary, f.index, cfg, lambda df, n: got.extend(df.select("a_id", "b_id").collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(map(tuple, got)) == sorted(map(tuple, f.candidates.select("a_id", "b_id").collect()))


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 9) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["scan_records", "domain_forms", "vocab_rank", "candidate_pairs", "heuristic_topk", "decide_all", "score_labeled", "group_features_ab", "audit_checks", "profile_source"])
def test_queries_match_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "lineitem", "orders"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = plans.QUERIES[name](spark, SF)
    want = db.sql(plans.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(want.fetchall(), want.columns)


def test_entry_module_needs_no_corpus_operators(spark):
    import __spark_entry__ as entry

    assert {*plans.QUERIES} <= {*entry.queries()} and {*entry.oracle_sql()} <= {*entry.queries()}
    assert entry.entry(spark).columns == ["a_id", "b_id", "score", "rank"]


def write_split(root, split, rows):
    folder = root / split
    folder.mkdir(exist_ok=True)
    for source in (1, 2, 3):
        lines = [f"{i}\t{name}\t{addr}\t{c}" for i, s, c, name, addr in rows if s == source]
        (folder / f"source{source}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "\n".join(lines) + "\n")


def test_command_line(spark, tmp_path, capsys):
    from kinmark.__main__ import main

    write_split(tmp_path, "test", RECORDS)
    assert main(["link-untrained", str(tmp_path), str(tmp_path / "out")]) == 0
    assert "ok   matches_are_candidates" in capsys.readouterr().out
    assert main(["profile", str(tmp_path), str(tmp_path / "out")]) == 0
    assert spark.read.json(str(tmp_path / "out/reports/profile_test")).count() == 3


def made_up_split(seed, n):
    """Records of source 1 with 0 to 3 noisy copies in the others, and the truth."""
    import random

    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghilmnoprstu", k=r.randint(4, 8))) for _ in range(400)]
    rows, truth, b = [], [], 0
    for i in range(n):
        name, addr, c = r.sample(words, 3), [str(r.randint(1, 999)), *r.sample(words, 3)], "xy"[i % 2]
        rows.append((f"S1-{i}", 1, c, " ".join(name), " ".join(addr)))
        own = []
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            s, b = r.choice([2, 3]), b + 1
            copy, place = list(name), list(addr)
            if r.random() < 0.5:
                copy[r.randrange(3)] = r.choice(words)
            r.shuffle(place)
            rows.append((f"S{s}-{b}", s, c, " ".join(copy), " ".join(place)))
            own.append(f"S{s}-{b}")
        truth.append((f"S1-{i}", ",".join(own)))
    return rows, truth


def test_all_stages(spark, tmp_path, capsys):
    from kinmark.__main__ import report, run_stage
    from kinmark.plans import stages

    root, work = str(tmp_path), str(tmp_path / "work")
    rows, truth = made_up_split(1, 160)
    write_split(tmp_path, "train", rows)
    (tmp_path / "train/ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "\n".join(f"{a}\t{m}" for a, m in truth) + "\n")
    write_split(tmp_path, "test", made_up_split(2, 30)[0])
    for split in ("train", "test"):
        run_stage(spark, "profile", root, work, split)
        run_stage(spark, "prepare", root, work, split)
    stages.train_ranker(spark, root, work, kind="logistic")
    stages.build_dataset(spark, root, work, per_country=60)
    data, info = src.read_dataset(spark, f"{work}/dataset")
    assert data.agg(F.max("y")).first()[0] == 1 and info["features"] == list(pairwise.FEATURE_NAMES) and {r["part"] for r in data.select("part").distinct().collect()} == {"train", "valid"}
    assert src.read_truth_counts(spark, f"{work}/truth", "train").groupBy("country").count().agg(F.max("count")).first()[0] <= 60
    stages.train(spark, work, kinds=("logistic",))
    table = spark.read.json(f"{work}/comparison").collect()
    assert {r["feature_set"] for r in table} == {"all", "base"} and {r["n_features"] for r in table} == {85, 74}
    fitted, about = models.load(spark, f"{work}/matcher")
    assert fitted.features == about["features"] and len(about["importances"]) == len(fitted.features)
    for split in ("train", "test"):
        stages.score(spark, work, split)
    cfg = stages.tune(spark, root, work)
    stages.evaluate(spark, root, work)
    score = spark.read.json(f"{work}/reports/evaluation").first()
    assert score["macro_f05"] > 0.8 and cfg == stages._decision(spark, work)
    signals = {r["signal"] for r in spark.read.json(f"{work}/reports/singletons").collect()}
    assert signals == {*models.SHAPE, "model"}
    stages.link(spark, work, "test")
    assert report(stages.audit(spark, work, "test")) == 0
    assert "ok   matching_results_header" in capsys.readouterr().out


def test_truth_in_the_index(spark):
    lists = spark.createDataFrame([("S1-1", "S2-1,S3-9"), ("S1-2", ""), ("S1-3", " ")], "source1_entity_id string, matched_entity_ids string")
    b = spark.createDataFrame([("S2-1",), ("S2-1",), ("S2-7",)], "entity_id string")
    assert [tuple(r) for r in src.indexed_truth(lists, b).collect()] == [("S1-1", "S2-1")]
    assert sorted(map(tuple, src.listed_counts(lists).collect())) == [("S1-1", 2), ("S1-2", 0), ("S1-3", 0)]


def test_texts_are_split_once(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", 5)], "doc_id long, text string, lang string, n_chars long")
    plan = src.documents_as_records(docs)._jdf.queryExecution().optimizedPlan().toString()
    made = next(line for line in plan.splitlines() if "Generate" in line)
    assert "split(" not in made  # within the lambda it would run again for each run of the text


def test_candidates_in_passes_are_those_of_all_keys(spark, monkeypatch):
    words = "red blue green gold iron salt wolf moss fern clay".split()
    rows = [(f"S{1 + i % 3}-{i}", 1 + i % 3, "x" if i % 5 else "y", " ".join(words[(i * k) % 10] for k in (1, 3, 7)) + f" only{i}", f"{words[i % 7]} {words[i % 4]} {i % 6} {i % 9}") for i in range(60)]
    df = spark.createDataFrame(rows, "entity_id string, src int, country string, business_name string, business_address string")
    forms = with_forms(df)
    whole = blocking.with_heads(forms.join(blocking.id_lists(forms, blocking.vocabulary(forms)), ["country", "entity_id"]), blocking.BlockConfig())
    want = sorted(map(tuple, blocking.candidates(whole.where("src = 1"), whole.where("src > 1"), blocking.BlockConfig()).collect()))
    monkeypatch.setattr(blocking, "MANY_RECORDS", 1)
    monkeypatch.setattr(blocking, "COMMON", 3)
    f = Funnel(df)
    assert want and sorted(map(tuple, f.candidates.collect())) == want
    shared, every = (blocking.make_keys(f.prepared, f.cfg, shared=s).count() for s in (True, False))
    assert shared < every == blocking.make_keys(whole, f.cfg).count()


@pytest.mark.parametrize("named", [False, True])
def test_blocks_that_span_batches_keep_their_cap(spark, monkeypatch, named):
    """Whole blocks are judged whatever the batches and passes: one of the cap's size, one beyond it, one with many a's;
    ids that are no numbers too. Intermediate tables of the probe are gone when the candidates are there."""
    import os

    monkeypatch.setattr(blocking, "MANY_RECORDS", 1)
    monkeypatch.setattr(blocking, "PASSES", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    name = {"low": "amber birch", "cap": "copper dune", "over": "ember fjord"}
    rows = [(f"S{s}-{x}{'x' * named}", s, "x", name[k], "") for k, s, ids in (("low", 1, range(100, 107)), ("low", 2, [1]), ("cap", 1, [200, 201]), ("cap", 3, range(10, 13)), ("over", 1, [300]), ("over", 2, range(20, 24))) for x in ids]
    df = spark.createDataFrame(rows, "entity_id string, src int, country string, business_name string, business_address string")
    cfg = BlockConfig(max_block=3, max_block_by_family={})
    try:
        found = Funnel(df, cfg).candidates
        got = sorted(map(tuple, found.collect()))
        folders = {f.rsplit("/", 2)[0] for f in found.inputFiles()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = with_forms(df)
    whole = blocking.with_heads(whole.join(blocking.id_lists(whole, blocking.vocabulary(whole)), ["country", "entity_id"]), cfg)
    want = sorted(map(tuple, blocking.candidates(whole.where("src = 1"), whole.where("src > 1"), cfg).collect()))
    assert got == want and len(got) == 7 + 6
    assert not [x for f in folders for x in os.listdir(f.removeprefix("file://").removeprefix("file:")) if x.startswith("live-") and os.path.isdir(f"{f.removeprefix('file://').removeprefix('file:')}/{x}") and any(y.endswith(".parquet") for y in os.listdir(f"{f.removeprefix('file://').removeprefix('file:')}/{x}"))]


def test_records_without_a_country_keep_their_row(spark):
    rows = [("S1-1", 1, None, "amber birch", "elm 4"), ("S2-1", 2, None, "amber birch", "elm 4"), ("S1-2", 1, "x", "amber birch", "elm 4"), ("S2-2", 2, "x", "amber birch", "elm 4")]
    f = Funnel(spark.createDataFrame(rows, "entity_id string, src int, country string, business_name string, business_address string"))
    assert {r["entity_id"]: len(r["mt_all"]) for r in f.lists.collect()} == {"S1-1": 0, "S2-1": 0, "S1-2": 2, "S2-2": 2}
    assert [(r["a_id"], r["b_id"]) for r in f.candidates.collect()] == [("S1-2", "S2-2")]


def _two_sided(n, words="red blue green gold iron salt wolf moss fern clay".split()):
    """Records of three sources and two countries that share words and numbers; some lists are long, some texts empty."""
    for i in range(n):
        name = " ".join(words[(i * k) % 10] for k in (1, 3, 7)) + f" only{i}" if i % 11 else ""
        address = f"{words[i % 7]} {words[i % 4]} {i % 6} {i % 9}" if i % 8 else " ".join(f"w{(i + k) % 70}" for k in range(50))
        yield f"S{1 + i % 3}-{i}", 1 + i % 3, "x" if i % 5 else "y", name, address


def test_overlaps_in_blocks_are_those_of_the_row_plans(spark, monkeypatch):
    """No candidate is dropped between the passes, slots and blocks, and no pairs with lists are shuffled by the row (F4, F5, F6)."""
    from kinmark.operators import packed

    df = spark.createDataFrame(list(_two_sided(150)), "entity_id string, src int, country string, business_name string, business_address string")
    forms = with_forms(df)
    vocab = blocking.vocabulary(forms)
    lists = forms.join(blocking.id_lists(forms, vocab), ["country", "entity_id"])
    whole, cfg = blocking.with_heads(lists, BlockConfig()), BlockConfig()
    pairs = blocking.candidates(whole.where("src = 1"), whole.where("src > 1"), cfg)
    cheap = ranking.cheap_features(pairs, lists, blocking.rarity_thresholds(vocab)).persist()
    want = cheap.select("country", "a_id", "b_id", *ranking.CHEAP_FEATURES)
    for name, value in (("MANY_RECORDS", 1), ("PASSES", 3), ("KEY_PASSES", 2)):
        monkeypatch.setattr(blocking, name, value)
    monkeypatch.setattr(packed, "SLOT_RECORDS", 20)
    got = Funnel(df).cheap
    assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    best = ranking.top_k(cheap.withColumn("score", ranking.heuristic_score()), 3).select("a_id", "b_id", "score", "rank")
    f = Funnel(df, top=3)
    plan = f.survivors._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, f.survivors.select("a_id", "b_id", "score", "rank").collect())) == sorted(map(tuple, best.collect()))
    assert "Exchange" not in plan and "candidates" not in f.__dict__ and f.kept is f.survivors
    assert f.lists.count() == 150  # made again after the overlaps have let them go


def test_packed_columns_and_rounding():
    import numpy as np

    from kinmark.operators import packed

    columns = [np.array([-1, 0, 1 << 62]), np.array([5, 6, 7])]
    assert [c.tolist() for c in packed.unpacked(packed.packed(*columns))] == [c.tolist() for c in columns]
    assert packed._half_up(np.array([0.0000000005, 1.0000000015, 2.5, 0.1 + 0.2])).tolist() == [1, 1000000002, 2500000000, 300000000]
    assert packed._text_order(np.array([9 << 3 | 2, 10 << 3 | 2, 1 << 3 | 3])).tolist() == [1, 0, 2]
    x = packed.Lists(np.array([4, 8]), np.array([[0, 2], [1, 0], [0, 0]]), np.array([7, 1, 3]))
    assert x.at(np.array([1, 0])).flat.tolist() == [1, 3, 7] and x.places(np.array([8, 5, 4]))[1].tolist() == [1, 0]


def _forced_passes(spark, monkeypatch):
    from kinmark.operators import packed

    for name, value in (("MANY_RECORDS", 1), ("PASSES", 2), ("KEY_PASSES", 2)):
        monkeypatch.setattr(blocking, name, value)
    monkeypatch.setattr(packed, "SLOT_RECORDS", 20)
    return Funnel(spark.createDataFrame(list(_two_sided(90)), "entity_id string, src int, country string, business_name string, business_address string"))


def test_true_masks_need_no_table_of_candidates(spark, monkeypatch):
    f, g = _forced_passes(spark, monkeypatch), _forced_passes(spark, monkeypatch)
    truth = g.candidates.where("n_keys > 2").select("a_id", "b_id").unionByName(spark.createDataFrame([("S1-0", "none")], "a_id string, b_id string")).persist()
    got = sorted(map(tuple, f.true_masks(truth).collect()))
    assert got and got == sorted(map(tuple, blocking.true_masks(g.candidates, truth).collect()))
    assert "candidates" not in f.__dict__
    assert blocking.greedy_families(f.true_masks(truth), truth)[-1][1] == truth.count() - 1


def test_index_shuffles_blocks_only(spark, monkeypatch):
    f, cfg = _forced_passes(spark, monkeypatch), BlockConfig(max_block=3, max_block_by_family={"NS": 1})
    want = blocking.capped_index(f.b_keys, cfg).select("country", "entity_id", "fam", "key").collect()
    got = f.index_under(cfg).select("country", "entity_id", "fam", "key")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want)
    assert "hashpartitioning(slot" in plan and "hashpartitioning(country" not in plan


def test_texts_are_attached_in_passes(spark, monkeypatch):
    f = _forced_passes(spark, monkeypatch)
    views = [f"{p}_{v}" for p in "ab" for v in ("name_core", "addr_norm")]
    got = f.attached(f.kept.select("a_id", "b_id"), lambda both: both.select("a_id", "b_id", *views))
    want = pairwise.attach_text(f.kept.select("a_id", "b_id"), f.normed).select("a_id", "b_id", *views)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_errors_of_scored_pairs_by_one_join(spark):
    ids = "a_id string, b_id string"
    scored = spark.createDataFrame([("a", "x", 5.0), ("a", "y", 4.5), ("a", "z", 1.0), ("c", "x", 2.0)], f"{ids}, score double")
    truth = spark.createDataFrame([("a", "x"), ("c", "x"), ("d", "x")], ids)
    got = reports.errors_at(scored, truth, 4.5)
    want = reports.error_kinds(scored.where("score >= 4.5"), scored, truth).select("a_id", "b_id", "kind")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def _odd_texts(seed, n):
    """Texts of few words, with alias markers, domains, marks and white space of many kinds; many copies, some parts of others."""
    import random

    rng = random.Random(seed)
    words = "red Blue GREEN the gold iron.com www.salt.org wolf, moss-fern clay Élan Kelvin café किताब x/y a/k/a aka dba makaka now known as trading as formerly\tknown Ａｋａ ten\nfold 12 007 a&b İz ´acute я.com akaя  aka co inc ß".split(" ")
    texts = [" ".join(rng.choices(words, k=900)), "red wolf " * 400, None, "", " ", "the of", "red", "red  red", "Ltd", "amber birch", "am berbirch", "x", "\n aka gold"]
    for i in range(n):
        texts.append(" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 5, 9, 10, 19, 40]))) + (f" rare{rng.randrange(n // 3)}" if i % 2 else ""))
    return texts + ["wolf moss gold iron clay once upon a hill"] * 4 + rng.sample(texts, n // 3)


@pytest.mark.parametrize("common", [1 << 22, 5])
def test_best_runs_are_those_of_the_funnel(spark, monkeypatch, common):
    """Benchmark passages find their runs without a row for each run of a document, with the results of the funnel (F10)."""
    from kinmark.operators import passages

    cfg = BlockConfig(max_block=6, max_block_by_family={"NK": 5, "NS": 9})
    docs = spark.createDataFrame(list(enumerate(_odd_texts(1, 240))), "id long, text string").repartition(3).persist()
    items = spark.createDataFrame([(7 * i, t) for i, t in enumerate(_odd_texts(1, 90) + _odd_texts(2, 30))], "id long, text string").persist()
    records = src.passages_as_records(items.withColumnRenamed("id", "item_id"), docs.withColumnRenamed("id", "doc_id"))
    columns = ["a_id", "b_id", "n_keys", F.round("score", 9).alias("score"), F.col("rank").cast("long")]
    want = Funnel(records, cfg, top=4).survivors.select(*columns).collect()
    monkeypatch.setattr(blocking, "COMMON", common)
    monkeypatch.setattr(passages, "PIECE", 2000)
    kept, unsettled = passages.stored, []

    def stored(df, label):
        out = kept(df, label)
        unsettled.extend([out.where("size(rest) > 0").count()] if "rest" in out.columns else [])
        return out

    monkeypatch.setattr(passages, "stored", stored)
    got = passages.best_runs(items, docs, 18, 9, 4, cfg).select(*columns).collect()
    assert len(got) > 100 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r["n_keys"] for r in got} > {1, 2} and (unsettled[0] > 0) == (common < 100)


def test_best_runs_leave_other_tables_to_the_funnel(spark):
    from kinmark.operators import passages

    one = spark.createDataFrame([(1, "gold iron wolf")], "id long, text string")
    for rows, kind in (([(1, "gold iron wolf"), (1, "moss")], "long"), ([(None, "gold iron wolf")], "long"), ([(-1, "gold iron wolf")], "long"), ([("1", "gold iron wolf")], "string")):
        other = spark.createDataFrame(rows, f"id {kind}, text string")
        assert passages.best_runs(one, other, 18, 9, 20) is None and passages.best_runs(other, one, 18, 9, 20) is None
    none = one.where("id > 1")
    assert passages.best_runs(none, one, 18, 9, 20).count() == passages.best_runs(one, none, 18, 9, 20).count() == 0
    assert [tuple(r)[:3] for r in passages.best_runs(one, one, 18, 9, 20).collect()] == [("S1-1000000", "S2-1000000", 8)]


def test_benchmark_overlap_needs_no_funnel(spark, monkeypatch):
    monkeypatch.setattr(plans, "Funnel", None)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = plans.QUERIES["benchmark_overlap"](spark, SF), db.sql(plans.ORACLE_SQL["benchmark_overlap"])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(want.fetchall(), want.columns)
