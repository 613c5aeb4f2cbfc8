"""Operators over whole tables against brute force, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kinmark.llm import components, decontaminate, license_scan, near_dedup, queries, shuffle_shards, suffix_dedup, url_filter
from kinmark.llm.suffix_array import suffix_order

R = random.Random(11)
WORDS = ["".join(R.choices("abcdeé", k=R.randint(1, 6))) for _ in range(80)]


def words(n):
    return " ".join(R.choices(WORDS, k=n))


# url filter ------------------------------------------------------------------------------------------------------

URLS = {
    "https://A.example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/", "block"),
    "http://example.org/en/123": ("example.org", "/en/123", "example.org/en/1", "block"),
    "http://x.org": ("x.org", "", None, "allow"),
    "http://x.org/a": ("x.org", "/a", "org/", "allow"),
    "ftp://b.com/de/": ("b.com", "/de/", "com/de/", "block"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "no scheme.org/es/": ("", "", None, "allow"),
    "://#": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_urls(spark):
    rows = [(i, u, "h", "v") for i, u in enumerate(URLS)] + [(0, next(iter(URLS)), "h", "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, HOST string, verdict string")
    out = url_filter.filter_urls(df, "page_id", "url", queries.URL_RULES).collect()
    want = list(URLS.values())
    assert len(out) == len(rows) and all(tuple(r)[1:] == want[r["page_id"]] for r in out)
    assert url_filter.filter_urls(df.limit(0), "page_id", "url", queries.URL_RULES).count() == 0


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda text: len(text) % 3)
    stem = url_filter.DigestArray.write(str(tmp_path), [("org", "/", "allow"), ("example.org", "/es/", "block"), ("b.org", "/x", "block")])
    array = url_filter.DigestArray(str(tmp_path), stem)
    assert array.judge(["http://example.org/es/1", "http://c.org/x", "http://q.com/"])[2:] == (["example.org/es/", "org/", None], ["block", "allow", None])


# shuffle -----------------------------------------------------------------------------------------------------------


def test_shards(spark):
    rows = [(i, None if i % 9 == 0 else "same" if i % 3 else words(i % 40), "s") for i in range(200)] + [(None, "n", "s"), (5, "same", "s"), (5, "same", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Shard string")
    out = shuffle_shards.shuffled_shards(df, "text", 7, 3, bucket_bytes=2000)
    assert out.columns == ["doc_id", "text", "Shard", "_shard", "slot"]
    got = out.collect()
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, rows))
    slots = {}
    for r in got:
        slots.setdefault(r["_shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {r["doc_id"]: (r["_shard"], r["slot"]) for r in shuffle_shards.shuffled_shards(df.repartition(5), "text", 7, 3, bucket_bytes=2000).where("doc_id <> 5").collect()}
    assert again == {r["doc_id"]: (r["_shard"], r["slot"]) for r in got if r["doc_id"] not in (5, None)}
    assert shuffle_shards.shuffled_shards(df.limit(0), "text", 7, 3).count() == 0


def test_shards_against_a_plain_shuffle(spark):
    """Buckets, order, permutation and dealing recomputed by hand, on a table in which one text has a third of the rows."""
    rows = [(i, "hot" if i % 3 == 0 else words(i % 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in shuffle_shards.shuffled_shards(df, "text", 5, 9, bucket_bytes=3000).collect()}
    total = sum(len(t.encode()) + 64 for _, t in rows)
    n = -(-total // 3000)
    buckets = {}
    for r in df.selectExpr("doc_id", "text", f"pmod(xxhash64(9, doc_id, text), {n}) AS b").collect():
        buckets.setdefault(r["b"], []).append((r["doc_id"], r["text"]))
    assert n > 3 and len(buckets) > 3
    place = 0
    for b in sorted(buckets):
        held = sorted(buckets[b])
        draw = np.random.Generator(np.random.PCG64(np.random.SeedSequence([9, b]))).random(max(0, len(held) - 1))
        for k, i in enumerate(range(len(held) - 1, 0, -1)):
            j = int(draw[k] * (i + 1))
            held[i], held[j] = held[j], held[i]
        for k, (doc, _) in enumerate(held):
            assert got[doc] == ((place + k) % 5, (place + k) // 5)
        place += len(held)


def test_fisher_yates():
    assert sorted(shuffle_shards.fisher_yates(50, 1, 2)) == list(range(50)) and len(shuffle_shards.fisher_yates(0, 1, 2)) == 0
    firsts = [shuffle_shards.fisher_yates(4, 1, b)[0] for b in range(400)]
    assert all(60 < firsts.count(v) < 140 for v in range(4))


# near dedup ----------------------------------------------------------------------------------------------------------


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            m = len(sets[a] & sets[b])
            if m and 100 * m >= 75 * (len(sets[a]) + len(sets[b]) - m):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(groups, copies):
    rows, n = [], 0
    for _ in range(groups):
        base = words(R.randint(8, 120)).split()
        for _ in range(R.randint(1, copies)):
            w = list(base)
            for _ in range(R.randint(0, max(1, len(w) // 40))):
                w[R.randrange(len(w))] = R.choice(WORDS)
            rows.append((n, R.choice([" ", "\n", " \t"]).join(w)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "ONE two "), (n + 4, "\xa0"), (n + 5, "x " * 20000), (n + 6, "x " * 30000)]


@pytest.mark.parametrize("block", [(2_000_000, 128), (300, 4)])
def test_near_components(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "SMALL_CLUSTER", block[0])
    monkeypatch.setattr(near_dedup, "BLOCK", block[1])
    rows = near_rows(12, 12)
    df = spark.createDataFrame([(i, t, "q") for i, t in rows] + [(None, rows[0][1], "q"), (0, rows[0][1], "q")], "doc_id long, text string, ID string")
    out = near_dedup.near_components(df, "doc_id", "text").collect()
    want = brute_components(rows)
    assert len(out) == len(rows) + 2
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_components_of_a_large_template_group(spark, monkeypatch):
    """Members of a template at a likeness just under the limit stand between true partners in every order."""
    monkeypatch.setattr(near_dedup, "SMALL_CLUSTER", 4_000)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(21)
    core, texts = [f"t{i}" for i in range(100)], []
    for m in range(300):
        tail = [f"m{m}x{k}" for k in range(17)]
        texts += [core + tail, core + tail[:2] + [f"n{m}x{k}" for k in range(15)]] if m % 5 == 0 else [core + tail]
    r.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    out = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) == 300
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in out} == want


@pytest.mark.parametrize("most", [2_000_000, 20_000])
def test_near_components_of_many_variants(spark, monkeypatch, most):
    """Variants of one text around the limit, in one block or in many: every link counts, and both ways are exact."""
    monkeypatch.setattr(near_dedup, "SMALL_CLUSTER", most)
    r = random.Random(31)
    base = [f"w{i}" for i in range(104)]
    rows = []
    for i in range(1500):
        w = list(base)
        for k in r.sample(range(104), r.randint(1, 5)):
            w[k] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    out = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) > 50
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in out} == want


def test_near_components_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_components(df, "doc_id", "text").count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 60), (100, 50)]
    R.shuffle(links)
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 60: 50, 100: 50}


def test_components_in_rounds(spark, monkeypatch):
    """More links than one task contracts: a hub with a third of all nodes, long chains, and lone pairs."""
    monkeypatch.setattr(components, "LINKS_AT_ONCE", 20)
    r = random.Random(17)
    links = [(1000, i) for i in range(1001, 1101)] + [(i, i + 1) for i in range(120)] + [(500 + 2 * i, 501 + 2 * i) for i in range(30)]
    links += [(2000 + r.randrange(60), 2000 + r.randrange(60)) for _ in range(60)]
    links = [(a, b) for a, b in links if a != b]
    r.shuffle(links)
    forest = components.Forest()
    for a, b in links:
        forest.join(a, b)
    nodes = {x for link in links for x in link}
    got = {x["id"]: x["root"] for x in components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {x: forest.root(x) for x in nodes}


# suffix arrays ---------------------------------------------------------------------------------------------------------


def test_suffix_order():
    for _ in range(600):
        a = [R.randint(0, R.choice([1, 2, 4])) for _ in range(R.randint(0, 20))] * R.choice([1, 1, 3])
        assert suffix_order(np.array(a, dtype=np.int64)) == sorted(range(len(a)), key=lambda i: a[i:])


def brute_cuts(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if (w := b[s : s + n]) in seen:
                gone[s : s + n] = b"\1" * n
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("splits", [suffix_dedup.SPLITS, ((3, 16), (12, 4), (40, 1))])
def test_cut_repeats(spark, monkeypatch, splits):
    monkeypatch.setattr(suffix_dedup, "SPLITS", splits)
    base = ["".join(R.choices("ab é", k=300)) for _ in range(5)]
    rows = []
    for i in range(120):
        t = "".join(x[(a := R.randint(0, 200)) : a + R.randint(10, 250)] + R.choice(["", "", "z" * R.randint(1, 130), "é"]) for x in R.choices(base, k=R.randint(0, 4)))
        rows.append((i, t))
    hot = "".join(R.choices("abc d", k=160))  # a passage that a third of the documents share, between texts of their own
    rows += [(300 + i, "".join(R.choices("xyzé ", k=R.randint(0, 90))) + hot + "".join(R.choices("xyzé ", k=R.randint(0, 90)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "q" * 99), (203, "q" * 100), (204, "q" * 400), (205, "xy" * 300), (-3, base[0]), (10**12, base[0])]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows] + [(None, base[0], "q")], "doc_id long, text string, N_BYTES string")
    out = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.cut_repeats(df, "doc_id", "text").collect()}
    lone = out.pop(None)
    assert out == brute_cuts(rows) and lone[1] == 0
    twice = df.where("doc_id in (204, 205)").union(df.where("doc_id = 204"))
    assert sorted(r["doc_id"] for r in suffix_dedup.cut_repeats(twice, "doc_id", "text").collect()) == [204, 204, 205]
    rest = suffix_dedup.cut_repeats(df.where("doc_id = 204"), "doc_id", "text", with_text=True).first()
    assert rest["kept_text"] == "q"
    assert suffix_dedup.cut_repeats(df.limit(0), "doc_id", "text").count() == 0


def test_split_groups_give_the_same_windows():
    """The finer splits, run on the workers' code directly."""
    import pyarrow as pa

    base = "".join(R.choices("abc", k=260))
    texts = ["".join([R.choice("xyz"), base[: R.randint(120, 260)], R.choice("xyz")]) for _ in range(12)]
    want = brute_cuts(list(enumerate(texts)))
    for splits in (((10**9, 1),), ((2, 16),), ((2, 4),), ((2, 1),)):
        data = b"".join(t.encode() for t in texts)
        starts = np.cumsum([0, *[len(t) for t in texts[:-1]]])
        d, p, a, b, h = suffix_dedup._anchors(np.frombuffer(data, np.uint8), starts)
        count = {x: int((h == x).sum()) for x in set(h.tolist())}
        spots = [[{"h": int(h[k]), "q": int(p[k] << 16 | a[k] << 8 | b[k]), "n": count[int(h[k])]} for k in np.flatnonzero(d == i) if count[int(h[k])] > 1] for i in range(len(texts))]
        batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts, "spots": pa.array(spots, pa.list_(pa.struct([("h", pa.int64()), ("q", pa.int64()), ("n", pa.int64())])))})
        rows = sorted((r for x in suffix_dedup._contexts(splits)(iter([batch])) for r in zip(*(c.to_pylist() for c in x.columns))), key=lambda r: (r[0], r[4], r[5]))
        table = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()])], names=list("kabcip"))
        firsts = [r for x in suffix_dedup._firsts(iter([table])) for r in zip(*(c.to_pylist() for c in x.columns))]
        for i, t in enumerate(texts):
            lo, hi = suffix_dedup.removed_spans(len(t), [s["q"] for s in spots[i]], [q for k, q in firsts if k == i]) if spots[i] else ([], [])
            assert sum(int(y - x) for x, y in zip(lo, hi)) == want[i][1]


# decontamination ---------------------------------------------------------------------------------------------------------


def brute_marks(docs, items):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {i: {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} for i, t in items if (w := cut(t))}
    out = {}
    for d, t in docs:
        w, hit, names = cut(t), set(), set()
        for i, all_wins in wins.items():
            for win in all_wins:
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit.update(range(s, s + len(win)))
                        names.add(str(i))
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize(("few", "short"), [("", True), ("", False), ("BROADCAST_WINDOWS", True), ("LISTED_WORDS", True), ("LISTED_WORDS", False)])
def test_contamination(spark, monkeypatch, few, short):
    if few:
        monkeypatch.setattr(decontaminate, few, 0)
    items = [(i, words(R.choice([3, 13, 20] if short else [13, 20]))) for i in range(8)] + [(8, None), (9, "...")]
    items += [(12, " ".join(map(str, range(16)))), (13, " ".join(map(str, range(5, 22)))), (14, "1 2 0 " * 5)]  # digits only
    items += [(10, "École É a"), (11, "k É")] if short else [(10, items[0][1]), (11, "it's " + words(15) + ' \\ "q" ' + words(3))]
    docs = []
    for i in range(30):
        t = words(R.randint(0, 60)).upper()
        for _ in range(R.randint(0, 2)):
            t += "; " + (R.choice(items)[1] or "") + " " + words(5)
        docs.append((i, t))
    docs += [(60 + k, f"zz9 {k} zz9 " * k + (items[k][1] or "x") + f" zz9 {k}0 zz9 " + " ".join(map(str, range(k, k + 16)))) for k in range(8)]
    docs += [(50, None), (51, ""), (52, "école é A x"), (53, "ÉCOLE É a"), (54, "École É A K É"), (55, "K É"), (56, words(3000))]
    df = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, WIN string")
    tb = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(df, tb).collect()}
    assert got == brute_marks(docs, items)
    whole = next(t for i, t in items if t and len(t.split()) > 12)
    rows = spark.createDataFrame([(None, whole), (None, "clean words only"), (3, whole), (3, whole), (3, "other " * 400 + whole)], "doc_id long, text string")
    assert sorted(str((r["doc_id"], r["n_hit"] > 0, r["contaminated"])) for r in decontaminate.contamination(rows, tb).collect()) == sorted(
        map(str, [(None, True, True), (None, False, False), (3, True, True), (3, True, True), (3, True, 20 * len(whole.split()) >= 400 + len(whole.split()))])
    )
    assert decontaminate.contamination(df.limit(0), tb).count() == 0
    assert decontaminate.contamination(df.limit(4), tb.limit(0)).where("contaminated").count() == 0


# licences ------------------------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    rows = [
        (1, "a/b/c.txt", "Some code " + words(60) + "\nReleased under the MIT License.\nmore"), (2, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (3, "a/b/d/e.txt", "nothing here"), (4, "z/x.txt", "nothing here"),
        (5, None, "Licensed under CC BY-NC 4.0."), (6, "a/f.txt", None), (7, "a/g.txt", ""), (8, "q/h.txt", words(400) + "\nwe licensed many things to many other people in town\n" + words(400)), (9, None, "nothing"),
    ]
    df = spark.createDataFrame([(*r, "m") for r in rows] + [(3, "a/b/d/e.txt", "nothing here", "m")], "doc_id long, path string, text string, LICENSE string")
    out = {r["doc_id"]: r for r in license_scan.scan(df, "doc_id", "path", "text").collect()}
    want = {1: ("MIT", None), 2: ("Apache-2.0", None), 3: ("Apache-2.0", "a"), 4: (None, None), 5: ("CC-BY-NC-4.0", None), 6: ("Apache-2.0", "a"), 7: ("Apache-2.0", "a"), 8: (None, None), 9: (None, None)}
    assert {k: (r["license"], r["from_dir"]) for k, r in out.items()} == want
    assert out[2]["is_license_file"] and not out[1]["is_license_file"] and out[1]["own_score"] == 1.0
    assert license_scan.scan(df.limit(0), "doc_id", "path", "text").count() == 0


def plain_scan(rows):
    """The scan by its definitions: every line against every announcement, every window against every text, no bound."""
    cut = lambda t: re.findall(license_scan.WORD, t.lower())
    speaks = re.compile(license_scan.SPEAKS)
    lines = {k: [x.strip(" ") for x in (t or "").split("\n") if speaks.search(x)] for k, (_, t) in enumerate(rows)}
    distinct = {x for of in lines.values() for x in of}
    announced = [(name, Counter(cut(t))) for name, t in license_scan.TEMPLATES]
    df = Counter(w for unit in [*(Counter(cut(x)) for x in distinct), *(c for _, c in announced)] for w in unit)
    total = len(distinct) + len(announced)

    def cosine(a, b, idf, unseen, damp):
        tf = lambda n: 1 + math.log(n) if damp else n
        va, vb = ({w: tf(n) * idf.get(w, unseen) for w, n in x.items()} for x in (a, b))
        dot = sum(v * vb.get(w, 0.0) for w, v in va.items())
        return round(dot / math.sqrt(sum(v * v for v in va.values()) * sum(v * v for v in vb.values())), 6) if dot else 0.0

    idf = {w: math.log((total + 1) / (n + 1)) + 1 for w, n in df.items()}
    best = lambda unit, least: min(((-c, name) for name, t in announced if (c := cosine(unit, t, idf, math.log(total + 1) + 1, False)) >= least), default=None)
    texts = [(name, cut(t)) for name, t in license_scan.text_templates()]
    spread = Counter(w for _, t in texts for w in {*t})
    rare = {w: math.log((len(texts) + 1) / (n + 1)) + 1 for w, n in spread.items()}
    marked = []
    for k, (path, text) in enumerate(rows):
        heads = [m for x in lines[k] if (m := best(Counter(cut(x)), license_scan.LEAST))]
        w, windows, whole = cut(text or ""), [], []
        for name, t in texts:
            n, step, last = len(t), max(1, len(t) // 8), max(1, len(w) - len(t) + 1)
            for start in [0, *range(1, last + 1, step), last] if w else []:
                c = cosine(Counter(w[start - 1 : start - 1 + n] if start else w), Counter(t), rare, math.log(len(texts) + 1) + 1, True)
                if c >= license_scan.LEAST_TEXT:
                    windows.append((-c, name))
                    whole += [] if start else [(-c, name)]
        whole += [f] if heads and (f := best(Counter(w), license_scan.LEAST_FILE)) else []
        marked.append((path, len(heads) + bool(windows), min(heads + windows, default=None), min(whole, default=None)))
    folder = lambda p: p.rpartition("/")[0]
    speakers = {}
    for path, _, _, f in marked:
        if f and path is not None:
            speakers[folder(path)] = min(f, speakers.get(folder(path), f))
    out = []
    for path, n, own, f in marked:
        above = None
        if own is None and path is not None:
            parts = folder(path).split("/")
            above = next((d for k in range(len(parts), 0, -1) if (d := "/".join(parts[:k])) in speakers), None)
        out.append((n, own and own[1], own and -own[0], f is not None, own[1] if own else above is not None and speakers[above][1] or None, above))
    return out


def test_license_scan_against_its_definitions(spark):
    r = random.Random(13)
    known, pieces = license_scan.text_templates(), [t for _, t in license_scan.TEMPLATES] + ["we licensed it to many people in town", "no license here, version 2", "SPDX or not", "A public domain work of GNU"]
    legal = [w for _, t in known for w in t.split()]
    rows = []
    for k in range(70):
        parts = [" ".join(r.choices(WORDS, k=r.randint(0, 30))) for _ in range(r.randint(1, 4))]
        if r.random() < 0.4:
            parts.insert(r.randrange(len(parts) + 1), "  " + r.choice(pieces) + r.choice(["", " " + words(3)]))
        if r.random() < 0.25:
            short = r.choice([t for _, t in known if len(t) < 2500]).split()
            parts.insert(r.randrange(len(parts) + 1), " ".join(w if r.random() < 0.9 else r.choice(WORDS) for w in short))
        if r.random() < 0.2:
            parts.append(" ".join(r.choices(legal, k=150)))
        if r.random() < 0.15:
            parts = [r.choice(pieces + [t for _, t in known if len(t) < 2500])]
        rows.append((r.choice([None, f"x{k}", f"a/{k}", f"a/b/{k}", f"a/b/c/{k}", f"d/e/{k}"]), "\n".join(parts) if r.random() < 0.95 else None))
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "doc_id long, path string, text string")
    got = {x["doc_id"]: x for x in license_scan.scan(df, "doc_id", "path", "text").collect()}
    want = plain_scan(rows)
    assert sum(w[1] is not None for w in want) > 20 and sum(w[3] for w in want) > 3 and sum(w[5] is not None for w in want) > 5
    for k, w in enumerate(want):
        x = got[k]
        assert (x["n_headers"], x["own"], x["is_license_file"], x["license"], x["from_dir"]) == (w[0], w[1], w[3], w[4], w[5]), k
        assert (x["own_score"] is None) == (w[2] is None) and (w[2] is None or abs(x["own_score"] - w[2]) < 2e-6)


def test_license_texts(spark):
    known = dict(license_scan.text_templates()[: -len(license_scan.NOTICES)])
    notices = dict(license_scan.NOTICES)
    code = lambda: "\n".join(f"x{k} = y{k} + {k}" for k in range(60))
    wrapped = lambda text, mark, n: "\n".join(mark + " ".join(text.split()[k : k + n]) for k in range(0, len(text.split()), n))
    rows = [(k, f"d{k}/LICENSE", "Copyright (c) 1999 Someone Else\n" + text) for k, text in enumerate(known.values())]
    rows += [(100 + k, f"h{k}/a.c", code() + "\n" + wrapped(text, " * ", 7) + "\n" + code()) for k, text in enumerate(notices.values())]
    rows += [(200, "m/a.c", wrapped(known["MIT"], "# ", 9) + "\n" + code()), (201, "b/a.c", wrapped(known["BSD-3-Clause"], "// ", 9) + "\n" + code()), (202, "d0/sub/a.c", code()), (203, "n/a.c", code()), (204, "n/b.c", "")]
    out = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), "doc_id", "path", "text").collect()}
    assert len(out) == len(rows)
    for k, name in enumerate(known):
        assert (out[k]["own"], out[k]["is_license_file"]) == (name, True)
    for k, name in enumerate(notices):
        assert (out[100 + k]["own"], out[100 + k]["is_license_file"]) == (name, False)
    assert out[200]["own"] == "MIT" and out[201]["own"] == "BSD-3-Clause"
    assert out[202]["license"] == next(iter(known)) and out[202]["from_dir"] == "d0" and out[203]["license"] is None and out[204]["own"] is None


# queries -----------------------------------------------------------------------------------------------------------------


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_shard_query_columns(spark):
    out = queries.op6_shuffle_shards(spark, "/root/testdata/sf0.001")
    texts = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    for r in out.collect():
        b = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 8, zlib.crc32(b), "rows", None)
