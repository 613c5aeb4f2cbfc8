"""The stages, each held against its operator's brute force, on a small corpus with planted cases."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from kinmark.llm import quality

R = random.Random(21)
WORDS = ["".join(R.choices("abcdefghij", k=R.randint(2, 8))) for _ in range(400)]


def words(n):
    return " ".join(R.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    passage, item = words(70), words(30)
    texts = {i: words(R.randint(40, 120)) for i in range(120)}
    texts |= {200: texts[3], 201: texts[4] + " tail"}  # copies
    texts |= {210: words(50) + "\n" + passage, 211: passage + "\n" + words(50)}  # a passage that repeats
    texts |= {220: words(60) + " " + item}  # benchmark
    loud = {300 + i: " ".join(w.upper() + "!!" for w in words(60).split()) for i in range(40)}
    rows = [(k, t, "en", "s", len(t)) for k, t in (texts | loud).items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(k, 1, 0) for k in range(100)] + [(k, 0, 0) for k in loud]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, texts, loud, passage


def test_stages_and_run(spark, corpus, tmp_path):
    d, texts, loud, passage = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if name != "bpe":
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append({r["doc_id"]: r.asDict() for r in docs.collect()})
    rated, single, cut, clean, encoded = seen
    assert not {*loud} & {*rated} and {*texts} <= {*rated}
    assert {*rated} - {*single} == {200, 201}
    assert {*cut} == {*single} and sum(passage in r["text"] for r in cut.values()) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values())
    assert {*cut} - {*clean} == {220} and {*encoded} == {*clean}
    whole = {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, d).collect()}
    assert whole == encoded


def test_run_against_brute_force(spark, corpus):
    """The last three kinds of decision recomputed in plain Python from what the classifier keeps."""
    import hashlib

    import numpy as np
    import public_tokenizers
    from test_tables import brute_components, brute_marks
    from tokenizers import Tokenizer

    d, texts, loud, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.classify(spark, docs, d).collect()}
    roots = brute_components([*kept.items()])
    kept = {i: t for i, t in kept.items() if roots[i][1] == i}
    seen, cut = set(), {}
    for i in sorted(kept):
        b = kept[i].encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        cut[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    marks = brute_marks([*cut.items()], items)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in cut.items():
        if not marks[i][4]:
            ids = lib.encode(t, add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, d).collect()}
    assert got == want


def test_names_and_threshold():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "suffix_dedup", "decontaminate", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None and quality.THRESHOLD == 0.7


def test_awkward_rows(spark, corpus, tmp_path):
    d = corpus[0]
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (3, "x " * 9000, "en", "s", 18000), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda df: sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in df.select("doc_id").collect())
    everything = ids(docs)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert ids(stage(spark, docs, d)) == everything
        assert stage(spark, docs.limit(0), d).count() == 0
    rated = corpus_pipeline.classify(spark, docs, d).collect()
    assert all(tuple(r) in rows for r in rated)
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_passages(spark, docs, d).collect()}
    assert cut[None] == "a b c" and cut[2] == "" and cut[3] == "x "
    item = spark.read.parquet(f"{d}/benchmark.parquet").first()["text"]
    nulls = spark.createDataFrame([(None, item, "en", "s", 1), (None, "clean", "en", "s", 5), (9, item, "en", "s", 1)], docs.schema)
    assert [r["text"] for r in corpus_pipeline.drop_contaminated(spark, nulls, d).collect()] == ["clean"]
