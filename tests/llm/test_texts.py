"""BPE, HTML, quality and SpotSigs: functions on texts, and their DataFrame forms on awkward rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinmark.llm import bpe, html_extract, html_train, quality, queries, spotsigs

VOCAB = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "é́", "ΑΣ ας", "<|endoftext|>x", "It's 12%%% fine!!", "x" * 5000, "a b " * 3000, "\x1c\x85　"]
SCHEMA = "doc_id long, text string, ID string, score string, n_chars string"


def odd_docs(spark):
    rows = [(i, t, "z", "9", "q") for i, t in enumerate(ODD)] + [(0, None, "z", "9", "q")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_bpe_is_the_librarys(text):
    own, lib = bpe.vocabulary(VOCAB), Tokenizer.from_file(VOCAB) if not hasattr(test_bpe_is_the_librarys, "lib") else test_bpe_is_the_librarys.lib
    test_bpe_is_the_librarys.lib = lib
    want = lib.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(own.encode(text), "<u4").tolist()
    assert got == want and own.decode(got) == lib.decode(want, skip_special_tokens=False)


def test_bpe_rows(spark, library):
    out = bpe.encode_texts(odd_docs(spark), "doc_id", "text", VOCAB, digests_only=True).collect()
    assert len(out) == len(ODD) + 1
    for r in out:
        ids = library.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = bpe.encode_texts(odd_docs(spark).where("doc_id = 7"), "doc_id", "text", VOCAB).first()
    assert whole["ids"] == library.encode(ODD[7], add_special_tokens=False).ids
    assert bpe.encode_texts(odd_docs(spark).limit(0), "doc_id", "text", VOCAB, True).count() == 0


PAGE = """<html><head><title>t</title></head><body><div id=header><a href=/>Home</a></div><div class="cookie-banner">We use cookies on this site. <button>Accept</button></div>
<div class=post><h2>Big title here</h2><p>First paragraph of the story, which goes on.</p><div class="ad-slot">Buy now!</div><p>Second <b>bold</b> paragraph &amp; more.</p></div>
<div id=comments><h3>Comments</h3><div class=comment><p>I really liked this article, thanks for sharing it.</p></div></div><aside class=sidebar><ul><li><a href=x>Other story</a></li></ul></aside>
<form><label>Email</label><input><button>Go</button></form><script>var x = "<p>no</p>";</script><div class=footer>&copy; 2020 Company</div></body></html>"""


def test_html_page():
    assert html_extract.main_texts([PAGE, None, "", "just text here."]) == ["Big title here First paragraph of the story, which goes on. Second bold paragraph & more.", "", "", "just text here."]


def test_html_held_out_accuracy():
    model = html_extract.labeller()
    right = total = 0
    for seed in range(5_000_000, 5_000_060):
        blocks = html_train.labelled(seed)
        if blocks:
            p = model.probabilities([html_extract.describe(blocks)])[0] >= 0.5
            right, total = right + int((p == np.array([b.label for b in blocks])).sum()), total + len(blocks)
    assert right / total > 0.97


def test_html_slopes_are_right():
    draw = np.random.default_rng(3)
    h = html_extract.HIDDEN
    w = {"o": np.zeros(1), "ox": draw.normal(0, 0.1, html_extract.INPUTS)}
    for k in "fb":
        w |= {"w" + k: draw.normal(0, 0.1, (html_extract.INPUTS, 4 * h)), "u" + k: draw.normal(0, 0.1, (h, 4 * h)), "b" + k: draw.normal(0, 0.1, 4 * h), "o" + k: draw.normal(0, 0.5, h)}
    x, mask = draw.normal(0, 1, (2, 4, html_extract.INPUTS)), np.array([[True] * 4, [True, True, False, False]])
    y = np.array([[1, 0, 1, 1], [0, 1, 0, 0]])
    loss, slopes = html_train.step(w, x, mask, y)
    for name, at in (("wf", (5, 7)), ("ub", (3, 50)), ("bf", (30,)), ("ob", (2,))):
        w[name][at] += 1e-5
        assert abs((html_train.step(w, x, mask, y)[0] - loss) / 1e-5 - slopes[name][at]) < 1e-3
        w[name][at] -= 1e-5


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "q"), (2, None, None, "q"), (3, "v", "<p>" * 3000 + "x", "q"), (1, "u", PAGE, "q")], "page_id long, url string, html string, TEXT string")
    out = html_extract.extract(df, "page_id", "url", "html").collect()
    assert len(out) == 4 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_extract.extract(df.limit(0), "page_id", "url", "html").count() == 0


def made_up(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        good = r.random() < 0.8
        text = " ".join(r.choices(words, k=r.randint(20, 80)))
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), int(good)))
    return rows


def test_quality_held_out(spark):
    rows = made_up(400, 5)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "x y", "x"), (900, None, "x"), (901, "", "x"), (902, "z " * 30000, "x")], "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7777, 0), (3, None), (1, rows[1][2])], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    clash = quality.score(docs, model, name="SCORE")
    assert clash.columns == [*docs.columns, "_SCORE"] and {r["Score"] for r in clash.collect()} == {"x"}
    got = {r["doc_id"]: r["p"] for r in quality.score(docs, model, name="p").collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((p >= quality.THRESHOLD) == bool(y) for p, y in held) / len(held) > 0.97
    assert got[900] == got[901] and 0 <= got[None] <= 1
    flags = {r[0]: r[1] for r in docs.where("doc_id < 50").select("doc_id", (quality.remainder("doc_id") == 2).alias("h")).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in flags)
    none = quality.fit(docs, labels.limit(0))
    assert quality.score(docs.limit(3), none, name="p").agg({"p": "max"}).first()[0] == 0.5


def test_quality_query_on_the_tables(spark):
    """Held-out accuracy of the registered query, and its parts recomputed."""
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, d).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {*got} == {*texts}
    by_text = {}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
        assert by_text.setdefault(texts[i], r["score"]) == r["score"]
    held = [(got[i]["predicted"], y) for i, y in labels.items() if got[i]["held_out"]]
    assert len(held) > 50 and sum(p == y for p, y in held) / len(held) >= 0.9


def plain_spots(text):
    """The spots by their definition, word by word."""
    tokens, word = [], ""
    for ch in text.lower() + " ":
        if ch.isalnum():
            word += ch
            continue
        tokens += [word] if word else []
        word = ""
        tokens += [ch] if ch in "\n|" else []
    tokens = ["\n", *tokens]
    content = [(i, t) for i, t in enumerate(tokens) if t not in spotsigs.COMMON]
    found = set()
    for i, t in enumerate(tokens):
        chain = [w for k, w in content if k > i][:2]
        if t in spotsigs.COMMON and len(chain) == 2:
            found.add((t, *chain))
    words = [w for _, w in content]
    if found:
        return found
    if len(words) > 1:
        return {("", a, b) for a, b in zip(words, words[1:])}
    rest = words or [t for t in tokens if t.isalpha()] or [text.strip()]
    return {("", t, "") for t in rest if t}


def plain_likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spots_and_likeness_against_their_definitions():
    r = random.Random(8)
    pool = "the of and was he cat dog sun sea big red é à der Haus | \n , . x1 42".split(" ")
    texts = ["", " ", "One", "the of", "cat dog", "a\nb\nc d"] + [" ".join(r.choices(pool, k=r.randint(0, 60))) for _ in range(80)]
    plain = [plain_spots(t) for t in texts]
    own = [spotsigs.fingerprint(t) for t in texts]
    assert [len(x) for x in own] == [len(x) for x in plain]
    for i in range(len(texts)):
        for j in range(len(texts)):
            want = plain_likeness(plain[i], plain[j])
            got = spotsigs.likeness(own[i], own[j])
            assert got == want or (got == 0 and want < spotsigs.LEAST)
            for least in (0.3, 0.75, 1.0):
                got = spotsigs.likeness(own[i], own[j], least)
                assert got == want if want >= least else got in (0, want)


def test_spotsigs_on_rows(spark):
    texts = {5: "The cat and the dog sat on a big mat.", 1: None, 2: "", 3: "One", 9: "the of and", 7: "long word chain " * 2000, 6: "été à la plage avec des amis très gentils"}
    df = spark.createDataFrame([(k, t, "q") for k, t in texts.items()], "doc_id long, text string, ID string")
    out = {r["doc_id"]: r for r in spotsigs.edited_neighbours(df, "doc_id", "text").collect()}
    order = sorted(texts)
    assert sorted(out) == order
    for k, after in zip(order, order[1:] + order[:1]):
        own, nxt = texts[k] or "", texts[after] or ""
        half = len(own) // 2
        changed = own[: len(own) - half] + nxt[:half]
        a, b, c = (plain_spots(t) for t in (own, changed, nxt))
        r = out[k]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        for name, other in (("near_edited", b), ("near_next", c)):
            assert r[name] == plain_likeness(a, other) or (r[name] == 0 and plain_likeness(a, other) < spotsigs.LEAST)
        assert len(base64.b64decode(r["fingerprint"])) == 4 * len(a) and len(base64.b64decode(r["edited_fingerprint"])) == 4 * len(b)
    one = spotsigs.edited_neighbours(df.where("doc_id = 5"), "doc_id", "text").first()
    assert one["near_next"] == 1
    assert spotsigs.edited_neighbours(df.limit(0), "doc_id", "text").count() == 0
    twice = df.where("doc_id in (5, 6)").union(df.where("doc_id = 5"))
    assert spotsigs.edited_neighbours(twice, "doc_id", "text").count() == 3


def test_spotsigs_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_BYTES", 400)
    r = random.Random(2)
    rows = [(r.randint(-10**12, 10**12), " ".join(r.choices("the of cat dog sun sea was big red".split(), k=12))) for _ in range(60)]
    out = {x["doc_id"]: x for x in spotsigs.edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    rows.sort()
    for (k, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        assert out[k]["edited_sha256"] == hashlib.sha256(spotsigs.edited(t, nxt).encode()).hexdigest()
    huge = [(2**62 + i, t) for i, (_, t) in enumerate(rows)]
    with_null = spark.createDataFrame([(None, "the cat of big sun"), *huge], "doc_id long, text string")
    after = [t for _, t in huge[1:]] + ["the cat of big sun"]
    out = {x["doc_id"]: x["edited_sha256"] for x in spotsigs.edited_neighbours(with_null, "doc_id", "text").collect()}
    assert [out[k] for k, _ in huge] == [hashlib.sha256(spotsigs.edited(t, n).encode()).hexdigest() for (_, t), n in zip(huge, after)]
    assert out[None] == hashlib.sha256(spotsigs.edited("the cat of big sun", huge[0][1]).encode()).hexdigest()


def test_spotsigs_pairs(spark):
    r = random.Random(4)
    base = [" ".join(r.choices([f"the w{i}" for i in range(60)] + ["of", "x", "yy"], k=40)) for _ in range(8)]
    texts = base + [b + " the tail" for b in base] + [base[0]]
    sets = [spotsigs.fingerprint(t) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if spotsigs.likeness(sets[i], sets[j]) >= 0.75}
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {(x["a"], x["b"]) for x in spotsigs.similar_pairs(spotsigs.spot_sets(df, "k", "t"), 0.75).collect()}
    assert got == want and want


BODY = "<article><h1>A title stands here</h1>" + "".join(f"<p>Sentence number {i} of this story tells what happened on the {i}th day in the old harbour town.</p>" for i in range(6)) + "</article>"


@pytest.mark.parametrize(
    "start",
    [
        "<html><head><title>t</title></head><body>", "<html><head><title>t</title><body>", "<html><head><title>t</title><meta charset=utf-8><link rel=x href=y>", "<title>t</title>", "<html><head><style>p {}</style><script>var a = '<p>no</p>';</script>",
        "<body><nav><svg class='i'/><a href=/>Home</a></nav>", "<body><nav><svg><path d='x'/></svg><a href=/>Home</a></nav>", "<body><iframe src='x'/>", "<body><iframe src='x'>", "<body><template><p>no</p></template><noscript><p>no</p></noscript>",
        "<HEAD><TITLE>t</TITLE></HEAD><BODY><TEXTAREA>no</TEXTAREA>",
    ],
)
def test_html_optional_and_unclosed_tags(start):
    """The article is whole, whatever optional, self-closed or unclosed tag stands before it."""
    text = html_extract.main_texts([start + BODY])[0]
    assert text.startswith("A title stands here Sentence number 0") and text.endswith("old harbour town.")


def test_html_scripts_without_an_end_and_many_unclosed_elements():
    assert html_extract.main_texts([BODY + "<script>var x = 1; <p>no</p>"])[0].endswith("old harbour town.")
    assert html_extract.main_texts([BODY + "<style>p { } <p>no</p>"])[0].endswith("old harbour town.")
    many = "<iframe>" * 20_000 + BODY
    assert "Sentence number 5" in html_extract.main_texts([many])[0]


def test_html_pieces_are_one_run(monkeypatch):
    pages = [blocks for seed in range(7_000_000, 7_000_006) if (blocks := html_train.labelled(seed))]
    model = html_extract.labeller()
    monkeypatch.setattr(html_extract, "PIECE", 7)
    for blocks in pages:
        whole = model.probabilities([html_extract.describe(blocks)])[0]
        assert np.allclose(model.of_long_page(blocks), whole, atol=1e-4)


def test_html_page_of_very_many_blocks():
    page = "<body><article>" + "<p>One more sentence of the very long story, told in the harbour town.</p>" * 200_000 + "</article></body>"
    text = html_extract.main_texts([page])[0]
    assert text.count("harbour town.") > 190_000


#: Pages written by hand, not by the maker of the training pages: each block is (kept, html).
BY_HAND = [
    [
        (0, '<div class="topbar"><a href="/">Harbour News</a></div>'), (0, '<ul class="menu"><li><a href="/a">World</a></li>'), (0, '<li><a href="/b">Sport</a></li></ul>'), (1, '<div class="story-body"><h1>Ferry returns after winter repairs</h1>'),
        (1, "<p>The ferry between the two islands sailed again on Monday, four months after a storm had damaged its hull.</p>"), (1, "<p>Passengers waited on the quay from early morning. “We missed it every day,” said one of them.</p>"),
        (0, '<div class="advert">Cheap flights from 19.99 – book now!</div>'), (1, "<p>The company expects about 300 passengers a day until the summer season begins in June.</p></div>"), (0, '<div class="related"><h3>Related</h3>'), (0, '<a href="/c">Storm closes harbour</a></div>'),
        (0, '<section id="comments"><h3>2 comments</h3>'), (0, '<div class="comment"><p>Great news, I will take it on Friday with my kids.</p></div></section>'), (0, '<footer><p>© 2021 Harbour News. All rights reserved.</p></footer>'),
    ],
    [
        (0, '<header><a href="/">My kitchen</a></header>'), (0, '<nav><a href="/r">Recipes</a></nav>'), (0, '<div class="cookie-notice"><p>This site uses cookies to give you a better experience.</p></div>'), (1, '<main><article><h2>Bread with walnuts</h2>'),
        (1, "<p>This bread needs little work, but it needs time: the dough should rest overnight in a cool place.</p>"), (1, "<ul><li>500 g of wheat flour</li>"), (1, "<li>150 g of walnuts, roughly chopped</li></ul>"),
        (1, "<p>Mix everything with the water in the evening. In the morning, fold the dough twice and bake it for forty minutes.</p></article></main>"), (0, '<aside class="sidebar"><h4>Newsletter</h4>'), (0, '<form><label>Your e-mail</label>'), (0, "<button>Subscribe</button></form></aside>"),
        (0, '<div id="footer"><a href="/imprint">Imprint</a></div>'),
    ],
]


def test_html_pages_written_by_hand():
    right = total = 0
    for blocks in BY_HAND:
        text = html_extract.main_texts(["<html><body>" + "".join(b for _, b in blocks) + "</body></html>"])[0]
        for keep, block in blocks:
            own = " ".join(x.text for x in html_extract.blocks_of(block))
            right, total = right + ((own in text) == bool(keep)), total + 1
    assert right / total >= 0.9
