"""Similarities over whole columns against one-pair definitions."""

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmark.functions import similarity as sim

PAIRS = st.lists(st.tuples(st.text("ab cé", max_size=14), st.text("ab cé", max_size=14)), max_size=6)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a, b):
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a, b):
    left, right = {*a.split()}, {*b.split()}
    if not left or not right:
        return 0.0
    both = sorted(left & right)
    if both and (left <= right or right <= left):
        return 1.0
    shared, with_a, with_b = " ".join(both), " ".join(both + sorted(left - right)), " ".join(both + sorted(right - left))
    rest = lambda x: len(x) - len(shared) - (1 if both else 0)
    edits = rest(with_a) + rest(with_b) - 2 * lcs(" ".join(sorted(left - right)), " ".join(sorted(right - left)))
    values = [1 - edits / (len(with_a) + len(with_b))]
    return max(values + ([ratio(shared, with_a), ratio(shared, with_b)] if both else []))


def partial(a, b):
    if not a or not b:
        return float(a == b)
    short, long = sorted((a, b), key=len)
    turns = [(short, long), (long, short)] if len(a) == len(b) else [(short, long)]
    return max(ratio(s, t[max(0, k) : k + len(s)]) for s, t in turns for k in range(1 - len(s), len(t)))


def jaro_winkler(a, b):
    if not a or not b:
        return float(a == b)
    reach, used, from_a = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == ch), None)
        if j is not None:
            used.add(j)
            from_a.append(ch)
    m = len(from_a)
    if not m:
        return 0.0
    t = sum(x != b[j] for x, j in zip(from_a, sorted(used))) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


PLAIN = {"ratio": ratio, "tokset": token_set, "toksort": token_sort, "partial": partial, "jw": jaro_winkler}


@pytest.mark.parametrize("kind", sim.METRICS)
@given(PAIRS)
def test_columns_are_the_plain_definitions(kind, pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    assert np.allclose(sim.METRICS[kind](a, b), [PLAIN[kind](x, y) for x, y in pairs], atol=1e-12)


def test_texts_longer_than_a_word():
    r = random.Random(3)
    texts = ["".join(r.choices("abcd ", k=n)) for n in (0, 1, 63, 64, 65, 127, 128, 129, 200)]
    a, b = zip(*((x, y) for x in texts for y in texts), strict=True)
    assert sim.common_lengths(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b)]
    few = [(texts[4], texts[2]), (texts[4], texts[5]), (texts[3], texts[7])]
    assert np.allclose(sim.partial_ratio([x for x, _ in few], [y for _, y in few]), [partial(x, y) for x, y in few])


def test_blocks_of_lanes_do_not_matter(monkeypatch):
    r = random.Random(4)
    a, b = (["".join(r.choices("abc ", k=r.randint(0, 30))) for _ in range(40)] for _ in range(2))
    want = sim.partial_ratio(a, b)
    monkeypatch.setattr(sim, "LANES", 7)
    assert sim.partial_ratio(a, b).tolist() == want.tolist()


def test_known_values():
    one = lambda kind, a, b: float(sim.METRICS[kind]([a], [b])[0])
    assert one("ratio", "", "") == 1 and one("tokset", "", "a") == 0 and one("partial", "abc", "xxabcxx") == 1
    assert one("tokset", "big red fox", "red big") == 1
    assert round(one("jw", "martha", "marhta"), 6) == 0.961111


def test_feature_block(spark):
    random.seed(1)
    rows = [("".join(random.choices("ab ", k=8)), "".join(random.choices("ab ", k=6))) for _ in range(20)] + [("", ""), ("", "a"), (None, "b"), (None, "b")]
    df = spark.createDataFrame(rows, "x string, y string")
    block = sim.string_features({v: (F.col("x"), F.col("y")) for v in sim.VIEWS})
    got = df.select("x", "y", *(c.alias(k) for k, c in block.items())).collect()
    assert len(got) == len(rows) and len(got[0]) == 2 + 20
    for r in got:
        x, y = r["x"] or "", r["y"] or ""
        for name, _, kind in sim.STRING_FEATURES:
            if kind in PLAIN:
                assert abs(r[name] - PLAIN[kind](x, y)) < 1e-12
        if r["x"] is not None:
            n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert abs(r["nm_prefix"] - (n / max(len(x), len(y)) if x or y else 1)) < 1e-12


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_diagonals_are_the_plain_definitions(monkeypatch):
    """Distances and windows by diagonals over lanes: of any lengths and alphabets, missing halves, texts past 8 bits."""
    r = random.Random(6)
    some = lambda n, of: "".join(r.choices(of, k=n))
    texts = ["", "a", "\ud800", *(some(n, of) for n in (2, 7, 63, 65, 130) for of in ("ab ", "abcdefgh éअ"))]
    a, b = zip(*((x, y) for x in texts for y in texts), strict=True)
    want = [edits(x, y) for x, y in zip(a, b)]
    assert sim.levenshtein_distances(a, b).tolist() == want
    wide = ["".join(map(chr, range(0x4E00, 0x4E00 + 300))), some(300, "ab")]
    assert sim.levenshtein_distances(wide, [wide[0][5:], wide[1] + "c"]).tolist() == [5, 1]
    assert sim.partial_ratio([wide[0][5:]], [wide[0]]).tolist() == [1.0] and np.isclose(sim.jaro_winkler([wide[0]], [wide[0] + "x"])[0], jaro_winkler(wide[0], wide[0] + "x"))
    full, best = sim.ratio_and_partial(a, b)
    assert full.tolist() == sim.ratio(a, b).tolist() and np.allclose(full, [ratio(x, y) for x, y in zip(a, b)])
    monkeypatch.setattr(sim, "LANES", 3)
    assert sim.levenshtein_distances(a, b).tolist() == want and sim.partial_ratio(a, b).tolist() == best.tolist()


def test_walks_do_not_grow_with_windows():
    """A window more is no lane more: a pair costs one strand for each place of its texts."""
    r = random.Random(7)
    a, b = ["".join(r.choices("ab ", k=60))], ["".join(r.choices("ab ", k=90))]
    texts = sim.Coded(a, b)
    one = np.zeros(1, np.int64)
    assert sim._strands(texts.lanes(0, one), texts.lanes(1, one)).shape == (90, 1)
