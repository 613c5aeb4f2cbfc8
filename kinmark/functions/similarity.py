"""String similarity (SF1-SF8). What Spark has stays in Catalyst; the rest is one Arrow function over whole columns.

Texts of a batch are matrices of small character numbers, a column (lane) for each pair, and every step is a few numpy
operations over all lanes. Common subsequences come from combing: the cells of pattern and text are walked along their
diagonals, and the order in which strands leave the last row gives the common length of the pattern and every window
of the text, so a partial ratio costs no more than one walk. Equal pairs of a batch are computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Texts = Sequence[str]
#: Lanes that are walked together, and how many characters they may have in all.
LANES, HELD = 512, 1 << 21
#: Words of so many low bits.
_LOW = np.array([(1 << n) - 1 for n in range(65)], np.uint64)


class Coded:
    """Texts as numbers from 2 on, one after the other."""

    def __init__(self, *sides: Texts):
        flat = np.frombuffer("".join(["".join(s) for s in sides]).encode("utf-32-le", "surrogatepass"), np.uint32)
        top = int(flat.max(initial=0))
        if top >= 254:  # number those that occur
            used = np.zeros(top + 1, bool)
            used[flat] = True
            flat = (np.cumsum(used) - 1)[flat]
            top = int(flat.max(initial=0))
        self.flat = np.append(flat + 2, 0).astype(np.uint8 if top < 254 else np.uint16 if top < 65534 else np.uint32)
        self.lens = [_lengths(s) for s in sides]
        ends = np.cumsum(np.concatenate(self.lens))
        self.starts = np.split(ends - np.concatenate(self.lens), np.cumsum([len(s) for s in sides])[:-1])

    def lanes(self, side: int, rows: np.ndarray, least: int = 1) -> np.ndarray:
        """A column of numbers for each of these texts; beyond its end the number of its side, which no text has."""
        n = self.lens[side][rows]
        place = np.arange(max(least, int(n.max())))[:, None]
        return np.where(place < n, self.flat[np.minimum(self.starts[side][rows] + place, len(self.flat) - 1)], self.flat.dtype.type(side))


def _chunks(first: np.ndarray, second: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of like lengths, bounded by LANES and HELD."""
    rows = rows[np.lexsort((second[rows], first[rows] // 8))]
    lo = 0
    while lo < len(rows):
        n = LANES
        while n > 1 and n * int(first[rows[lo : lo + n]].max() + second[rows[lo : lo + n]].max()) > HELD:
            n //= 2
        yield rows[lo : lo + n]
        lo += n


def _strands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each lane, the place in b at which the strand that leaves the last row under a place of b came in; negative
    if it came in from the left. A window of b has as many characters less in common with a as strands stay in it."""
    m, n, lanes = len(a), len(b), a.shape[1]
    kind = np.uint8 if m + n <= 1 << 8 else np.uint16 if m + n <= 1 << 16 else np.uint32
    level = np.repeat(np.arange(m - 1, -1, -1).astype(kind)[:, None], lanes, axis=1)
    upright = np.repeat(np.arange(m + n - 1, m - 1, -1).astype(kind)[:, None], lanes, axis=1)  # the last place first
    back = np.ascontiguousarray(b[::-1])
    wide = min(m, n)
    same, mask, passed = np.empty((wide, lanes), bool), np.empty((wide, lanes), kind), np.empty((wide, lanes), kind)
    for d in range(m + n - 1):
        lo, hi = max(0, d - n + 1), min(m - 1, d) + 1
        k = n - 1 - d
        h, v, s, x, p = level[lo:hi], upright[k + lo : k + hi], same[: hi - lo], mask[: hi - lo], passed[: hi - lo]
        np.equal(a[lo:hi], back[k + lo : k + hi], out=s)
        if kind is np.uint8:
            np.negative(s.view(np.uint8), out=x)
        else:
            np.negative(s.astype(kind), out=x)
        # strands cross once, and never where characters agree
        np.bitwise_and(v, np.invert(x, out=p), out=p)
        np.maximum(h, p, out=p)
        np.bitwise_or(h, x, out=h)
        np.minimum(h, v, out=h)
        v[...] = p
    return upright[::-1].astype(np.int64 if kind is np.uint32 else np.int32) - m


def _common(strands: np.ndarray) -> np.ndarray:
    return len(strands) - np.count_nonzero(strands >= 0, axis=0)


def _best_window(strands: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best ratio of a pattern of m characters to a window of m of a text of n, which may hang over either end."""
    long, lanes = strands.shape
    place, lane = np.arange(long)[:, None], np.arange(lanes)
    value = lambda size, stay: 2 * (size - stay) / (m + size)
    size = place + 1
    out = np.where(size < m, value(size, np.cumsum(strands >= 0, axis=0)), 0.0).max(axis=0)
    # a strand stays in the windows that begin between these places
    begin = np.maximum(place - m + 1, 0)
    stays = (strands >= begin) & (place < n)
    count = lambda x: np.bincount((x * lanes + lane)[stays], minlength=(long + 1) * lanes).reshape(-1, lanes)
    stay = np.cumsum(count(begin) - count(strands + 1), axis=0)[:-1]
    size = np.minimum(m, n - place)
    return np.maximum(out, np.where(place < n, value(np.maximum(size, 1), stay), 0.0).max(axis=0))


def common_lengths(a: Texts, b: Texts) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    texts, out = Coded(a, b), np.zeros(len(a), np.int64)
    la, lb = texts.lens
    for rows in _chunks(la, lb, np.flatnonzero((la > 0) & (lb > 0))):
        out[rows] = _common(_strands(texts.lanes(0, rows), texts.lanes(1, rows)))
    return out


def _lengths(texts: Texts) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def ratio(a: Texts, b: Texts) -> np.ndarray:
    """SF2: twice the common length over both lengths; two empty texts are equal."""
    total = _lengths(a) + _lengths(b)
    return np.where(total == 0, 1.0, 2 * common_lengths(a, b) / np.maximum(total, 1))


def token_sort_ratio(a: Texts, b: Texts) -> np.ndarray:
    """SF3."""
    of = {t: " ".join(sorted(t.split())) for t in {*a, *b}}
    return ratio([of[t] for t in a], [of[t] for t in b])


def token_set_ratio(a: Texts, b: Texts) -> np.ndarray:
    """SF4: the best of shared words against shared words plus either rest, and of the two rests behind the shared
    words; 0 without words on a side, 1 where one side's words are all shared."""
    n = len(a)
    rests: list[tuple[str, str]] = []
    size, fixed = np.zeros(n, np.int64), np.full(n, np.nan)
    words = {t: dict.fromkeys(sorted(t.split())) for t in {*a, *b}}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left, right = words[x], words[y]
        more, other = [w for w in left if w not in right], [w for w in right if w not in left]
        shared = len(left) - len(more)
        if not left or not right:
            fixed[i] = 0.0
        elif shared and not (more and other):
            fixed[i] = 1.0
        elif shared:
            size[i] = sum(map(len, left)) - sum(map(len, more)) + shared - 1
        rests.append(("", "") if fixed[i] == fixed[i] else (" ".join(more), " ".join(other)))
    rest_a, rest_b = [r[0] for r in rests], [r[1] for r in rests]
    la, lb, gap = _lengths(rest_a), _lengths(rest_b), (size > 0).astype(np.int64)
    whole_a, whole_b = size + gap + la, size + gap + lb
    apart = lambda edits, total: 1 - edits / np.maximum(total, 1)
    best = apart(la + lb - 2 * common_lengths(rest_a, rest_b), whole_a + whole_b)
    either = np.maximum(apart(gap + la, size + whole_a), apart(gap + lb, size + whole_b))
    return np.where(np.isnan(fixed), np.where(size > 0, np.maximum(best, either), best), fixed)


def ratio_and_partial(a: Texts, b: Texts) -> tuple[np.ndarray, np.ndarray]:
    """SF2 and SF5 from one walk."""
    texts, n = Coded(a, b), len(a)
    la, lb = texts.lens
    equal = np.fromiter((x == y for x, y in zip(a, b, strict=True)), bool, n)
    common, best = np.where(equal, la, 0), equal.astype(float)
    both = ~equal & (la > 0) & (lb > 0)
    for p, turn in ((0, both & (la <= lb)), (1, both & (lb <= la))):
        short, long = texts.lens[p], texts.lens[1 - p]
        for rows in _chunks(short, long, np.flatnonzero(turn)):
            strands = _strands(texts.lanes(p, rows), texts.lanes(1 - p, rows))
            common[rows] = _common(strands)
            best[rows] = np.maximum(best[rows], _best_window(strands, short[rows], long[rows]))
    total = la + lb
    return np.where(total == 0, 1.0, 2 * common / np.maximum(total, 1)), best


def partial_ratio(a: Texts, b: Texts) -> np.ndarray:
    """SF5: best ratio of the shorter text to a window of the longer one; windows may hang over either end. Of two
    texts of one length each takes a turn as the shorter."""
    return ratio_and_partial(a, b)[1]


def _low_bits(n: np.ndarray, words: int) -> list[np.ndarray]:
    return [_LOW[np.minimum(np.maximum(n - 64 * k, 0), 64)] for k in range(words)]


def jaro_winkler(a: Texts, b: Texts) -> np.ndarray:
    """SF6, with at most four common first characters. The places of b that are free, and those that agree with a
    character of a, are bits; the lowest in reach is taken."""
    texts, n = Coded(a, b), len(a)
    la, lb = texts.lens
    equal = np.fromiter((x == y for x, y in zip(a, b, strict=True)), bool, n)
    out = equal.astype(float)
    for rows in _chunks(lb, la, np.flatnonzero(~equal & (la > 0) & (lb > 0))):
        na, nb, lanes = la[rows], lb[rows], len(rows)
        x, words = texts.lanes(0, rows, 4), -(-int(nb.max()) // 64)
        y = np.ascontiguousarray(texts.lanes(1, rows, 64 * words).T)
        reach, all_b = np.maximum(0, np.maximum(na, nb) // 2 - 1), _low_bits(nb, words)
        free, met = [w.copy() for w in all_b], np.zeros(x.shape, bool)
        far = int(reach.max())
        upto_place = _low_bits(np.arange(-far, int(na.max()) + far + 1), words)
        for i in range(int(na.max())):
            same = np.packbits((y == x[i][:, None]).reshape(-1), bitorder="little").view("<u8").reshape(lanes, words)
            before, upto, found = i - reach + far, i + reach + 1 + far, met[i]
            for k in range(words):
                near = same[:, k] & free[k] & (upto_place[k][upto] ^ upto_place[k][before])
                lowest = np.where(found, np.uint64(0), near & (~near + np.uint64(1)))
                free[k] ^= lowest
                found |= lowest != 0
        taken = np.unpackbits(np.stack([w & ~f for w, f in zip(all_b, free, strict=True)], axis=1).view(np.uint8), axis=1, bitorder="little").view(bool)
        m = np.count_nonzero(met, axis=0)
        swapped = np.bincount(np.repeat(np.arange(lanes), m), x.T[met.T] != y[taken], lanes).astype(np.int64) // 2
        some = np.maximum(m, 1)
        jaro = np.where(m > 0, (m / na + m / nb + (m - swapped) / some) / 3, 0.0)
        same = np.cumprod(x[:4].T == y[:, :4], axis=1).sum(axis=1)
        out[rows] = np.where(jaro > 0.7, jaro + same * 0.1 * (1 - jaro), jaro)
    return out


def levenshtein_distances(a: Texts, b: Texts) -> np.ndarray:
    """Edits from one text to the other, by the diagonals of the table of all beginnings."""
    texts, n = Coded(a, b), len(a)
    la, lb = texts.lens
    equal = np.fromiter((x == y for x, y in zip(a, b, strict=True)), bool, n)
    out = np.where(equal, 0, np.maximum(la, lb))
    for rows in _chunks(la, lb, np.flatnonzero(~equal & (la > 0) & (lb > 0))):
        x, y, na, ends = texts.lanes(0, rows), texts.lanes(1, rows), la[rows], la[rows] + lb[rows]
        m, n, lanes = len(x), len(y), len(rows)
        kind, back = np.uint8 if max(m, n) < 255 else np.int32, np.ascontiguousarray(y[::-1])
        (two, one, now), step, other = (np.zeros((m + 1, lanes), kind) for _ in range(3)), np.empty((m, lanes), kind), np.empty((m, lanes), bool)
        by_end = np.argsort(ends, kind="stable")
        upto = np.searchsorted(ends[by_end], np.arange(m + n + 2)).tolist()
        for d in range(1, m + n + 1):
            lo, hi = max(1, d - n), min(m, d - 1) + 1
            if lo < hi:
                s, o = step[: hi - lo], other[: hi - lo]
                np.minimum(one[lo:hi], one[lo - 1 : hi - 1], out=s)
                np.add(s, kind(1), out=s)
                np.not_equal(x[lo - 1 : hi - 1], back[n - d + lo : n - d + hi], out=o)
                np.add(two[lo - 1 : hi - 1], o.view(np.uint8), out=now[lo:hi])
                np.minimum(now[lo:hi], s, out=now[lo:hi])
            if d <= n:
                now[0] = d
            if d <= m:
                now[d] = d
            if upto[d] < upto[d + 1]:
                done = by_end[upto[d] : upto[d + 1]]
                out[rows[done]] = now[na[done], done]
            two, one, now = one, now, two
    return out


def levenshtein(a: Texts, b: Texts) -> np.ndarray:
    """SF7."""
    longer = np.maximum(_lengths(a), _lengths(b))
    return np.where(longer == 0, 1.0, 1 - levenshtein_distances(a, b) / np.maximum(longer, 1))


def prefix(a: Texts, b: Texts) -> np.ndarray:
    """SF8."""
    texts, shared = Coded(a, b), np.zeros(len(a), np.int64)
    la, lb = texts.lens
    for rows in _chunks(la, lb, np.flatnonzero((la > 0) & (lb > 0))):
        x, y = texts.lanes(0, rows), texts.lanes(1, rows)
        n = min(len(x), len(y))
        shared[rows] = np.logical_and.accumulate(x[:n] == y[:n], axis=0).sum(axis=0)
    longer = np.maximum(la, lb)
    return np.where(longer == 0, 1.0, shared / np.maximum(longer, 1))


METRICS: dict[str, Callable[[Texts, Texts], np.ndarray]] = {"ratio": ratio, "tokset": token_set_ratio, "toksort": token_sort_ratio, "partial": partial_ratio, "jw": jaro_winkler}
#: Those that Catalyst has too.
EDITS: dict[str, Callable[[Texts, Texts], np.ndarray]] = {"lev": levenshtein, "prefix": prefix}


def over_pairs(kinds: Sequence[str], a: pd.Series, b: pd.Series) -> dict[str, np.ndarray]:
    """Metrics of two columns, null counting as empty; pairs that repeat in the batch are computed once."""
    codes, distinct = pd.factorize(pd.MultiIndex.from_arrays([a.fillna(""), b.fillna("")]))
    x, y = [p[0] for p in distinct], [p[1] for p in distinct]
    found = dict(zip(("ratio", "partial"), ratio_and_partial(x, y), strict=True)) if {"ratio", "partial"} <= {*kinds} else {}
    return {k: (found[k] if k in found else (METRICS | EDITS)[k](x, y))[codes] for k in kinds}


def metric(name: str, a: Column, b: Column) -> Column:
    """One of METRICS or EDITS over two string columns; null counts as empty."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(over_pairs([name], x, y)[name])

    return run(a, b)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """SF7: 1 - distance / longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def prefix_similarity(a: Column, b: Column) -> Column:
    """SF8: common prefix length / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b))))
    first_off = F.array_min(F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    shared = F.coalesce(first_off - 1, F.least(F.length(a), F.length(b)))
    return F.when(longer == 0, F.lit(1.0)).otherwise(shared / longer)


#: Fixed values: (feature, view of the record, metric), SF1's twenty columns in the order that models depend on.
STRING_FEATURES = (
    ("nm_ratio", "name_core", "ratio"), ("nm_tokset", "name_core", "tokset"), ("nm_toksort", "name_core", "toksort"), ("nm_partial", "name_core", "partial"),
    ("nm_jw", "name_core", "jw"), ("nm_lev", "name_core", "lev"), ("nm_prefix", "name_core", "prefix"), ("nmkey_ratio", "name_key", "ratio"),
    ("nmkey_jw", "name_key", "jw"), ("nmns_ratio", "name_core_nospace", "ratio"), ("nmns_partial", "name_core_nospace", "partial"),
    ("nmns_jw", "name_core_nospace", "jw"), ("nmfull_ratio", "name_norm", "ratio"), ("nmfull_tokset", "name_norm", "tokset"),
    ("ad_ratio", "addr_norm", "ratio"), ("ad_tokset", "addr_norm", "tokset"), ("ad_toksort", "addr_norm", "toksort"), ("ad_partial", "addr_norm", "partial"),
    ("ad_jw", "addr_norm", "jw"), ("ad_lev", "addr_norm", "lev"),
)
VIEWS = ("name_core", "name_key", "name_core_nospace", "name_norm", "addr_norm")


def string_features(columns: dict[str, tuple[Column, Column]]) -> dict[str, Column]:
    """SF1: every feature as a column; columns maps a view to its two sides. The metrics of all features are one
    call, so a pair's texts cross to Python once. Edits and beginnings of a missing text are missing."""
    views = list(dict.fromkeys(v for _, v, _ in STRING_FEATURES))

    @F.pandas_udf(", ".join(f"{name} double" for name, _, _ in STRING_FEATURES))
    def run(*texts: pd.Series) -> pd.DataFrame:
        found = {v: over_pairs([kind for _, view, kind in STRING_FEATURES if view == v], texts[2 * i], texts[2 * i + 1]) for i, v in enumerate(views)}
        return pd.DataFrame({name: found[view][kind] for name, view, kind in STRING_FEATURES})

    block = run(*(c for v in views for c in columns[v]))
    known = {v: a.isNotNull() & b.isNotNull() for v, (a, b) in columns.items()}
    return {name: F.when(known[view], block[name]) if kind in ("lev", "prefix") else block[name] for name, view, kind in STRING_FEATURES}
