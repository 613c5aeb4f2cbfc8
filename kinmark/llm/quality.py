"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Random indexing: every token has a fixed sparse ternary index vector drawn from its hash; a word's vector is the
normalised sum of the index vectors of its neighbours in the training texts. A token that is not in the
vocabulary has the index vector of its written shape (case, digits, signs), which known words carry as well. A
document is the mean and the spread of its tokens' vectors over its whole text, with the logarithm of its length
and its share of distinct tokens. The network (one tanh layer, one logistic unit) is trained with Adam; a
temperature fitted on training rows that the weights did not see calibrates its probabilities.

Fitting, word vectors included, uses the whole texts of at most ``TRAIN_ROWS`` labelled rows, those with the smallest
hash of their id (the driver holds them while it fits), and of their words at most ``MOST_WORDS`` that occur at least
``LEAST_COUNT`` times; all three are bounds of the fit, whatever the corpus, and every other word is known by its
written shape. Scoring reads every whole text. Labels, ids, language and source are no inputs of a score, so equal texts have equal scores.

Defined results: null and empty texts are scored like a text without tokens. Rows with a null id are scored, and
never learnt from (their remainder is unknown). Labels that are null, or whose document is missing, are skipped;
of repeated labels of a document one counts. An empty table gives an empty result; without labels of both kinds
every score is 0.5. Other columns, of any name, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmark.llm._common import fresh_name

TRAIN_ROWS = 3000
DIMS, NONZERO, HIDDEN, REACH, LEAST_COUNT, MOST_WORDS, TOKENS_KEPT = 64, 6, 24, 2, 3, 30_000, 400_000
THRESHOLD = 0.7
_RUNS = re.compile(r"(.)\1+", re.S)


def written_shape(token: str) -> str:
    if token.isalpha():
        return "low" if token.islower() else "UP" if token.isupper() and len(token) > 1 else "Cap" if token[1:].islower() or len(token) == 1 else "miX"
    marks = "".join("a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "x" if c.isalpha() else c for c in token)
    return _RUNS.sub(r"\1+", marks)[:12]


def index_vector(key: str) -> np.ndarray:
    draw = np.random.Generator(np.random.PCG64(xxhash.xxh64_intdigest(key)))
    v = np.zeros(DIMS, np.float32)
    v[draw.choice(DIMS, NONZERO, replace=False)] = np.where(draw.random(NONZERO) < 0.5, -1.0, 1.0)
    return v / np.sqrt(NONZERO)


class WordVectors:
    def __init__(self, words: list[str], vectors: np.ndarray):
        self.words = len(words)
        self.place = {w: i for i, w in enumerate(words)}  # and unknown tokens met, with their shape's row
        self.shapes: dict[str, int] = {}
        self.table = vectors.astype(np.float32).reshape(-1, DIMS)

    def unknown(self, token: str) -> int:
        if (i := self.shapes.get(s := written_shape(token))) is None:
            i = self.shapes[s] = len(self.table)
            self.table = np.vstack([self.table, index_vector("shape:" + s)[None]])
        if len(self.place) >= TOKENS_KEPT:
            self.place = {w: i for w, i in self.place.items() if i < self.words}
        self.place[token] = i
        return i

    def pooled(self, text: str) -> np.ndarray:
        tokens = text.split()
        n = len(tokens)
        if not n:
            return np.zeros(2 * DIMS + 2)
        counts = Counter(tokens)
        at = list(map(self.place.get, counts))
        if None in at:
            at = [self.unknown(t) if i is None else i for i, t in zip(at, counts, strict=True)]
        # whole numbers are summed by row first: the result does not depend on the order of the tokens
        used, where = np.unique(np.array(at), return_inverse=True)
        weights = np.bincount(where, weights=np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
        known = used < self.words  # rows of shapes are numbered in the order met: put them into a fixed order
        order = np.concatenate([np.flatnonzero(known), np.flatnonzero(~known)[np.lexsort(self.table[used[~known]].T)]])
        share, table = (weights[order] / n).astype(np.float32), self.table[used[order]]
        mean = share @ table
        spread = np.sqrt(np.maximum(0.0, share @ np.square(table) - mean * mean))
        return np.concatenate([mean, spread, [np.log1p(n) / 4, len(counts) / n]])


def word_vectors(texts: list[str]) -> WordVectors:
    split = [t.split() for t in texts]
    counts = Counter(w for tokens in split for w in tokens)
    words = sorted((w for w, n in counts.items() if n >= LEAST_COUNT), key=lambda w: (-counts[w], w))[:MOST_WORDS]
    place = {w: i for i, w in enumerate(words)}
    n = len(words)
    if not n:
        return WordVectors([], np.zeros((0, DIMS), np.float32))
    index = np.array([index_vector("word:" + w) for w in words])
    dims = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :NONZERO]
    signs = np.take_along_axis(index, dims, axis=1)
    gap = [n] * REACH  # no word reaches into the next text
    stream = np.array([i for tokens in split for i in (*(place.get(w, n) for w in tokens), *gap)], dtype=np.int64)
    context = np.zeros(n * DIMS)
    for k in range(1, REACH + 1):
        for here, there in ((stream[:-k], stream[k:]), (stream[k:], stream[:-k])):
            both = (here < n) & (there < n)
            a, b = here[both], there[both]
            for j in range(NONZERO):
                context += np.bincount(a * DIMS + dims[b, j], weights=signs[b, j], minlength=n * DIMS)
    context = context.reshape(n, DIMS)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    shapes = {s: index_vector("shape:" + s) for s in {written_shape(w) for w in words}}
    return WordVectors(words, 0.6 * context + np.array([shapes[written_shape(w)] for w in words]))


@dataclass
class Network:
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        # row by row, so that a score never depends on the rows beside it
        z = np.array([np.tanh(((r - self.center) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2 for r in x])
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7, steps: int = 300, rate: float = 0.01, decay: float = 2e-3) -> Network:
    draw = np.random.Generator(np.random.PCG64(seed))
    apart = draw.random(len(x)) < 0.2  # for the temperature
    if len({*y[~apart]}) < 2 or len({*y[apart]}) < 2:
        apart[:] = False
    xs, ys = x[~apart], y[~apart].astype(np.float64)
    center, scale = xs.mean(0), xs.std(0) + 1e-3
    xs = (xs - center) / scale
    parts = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        w1, b1, w2, b2 = parts
        h = np.tanh(xs @ w1 + b1)
        error = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -60, 60))) - ys) / len(ys)
        back = np.outer(error, w2) * (1 - h * h)
        slopes = [xs.T @ back + decay * w1, back.sum(0), h.T @ error + decay * w2, np.array([error.sum()])]
        for p, g, m, v in zip(parts, slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = Network(center, scale, parts[0], parts[1], parts[2], float(parts[3][0]), 1.0)
    if apart.any():
        p = np.clip(net.probability(x[apart]), 1e-9, 1 - 1e-9)
        logit, held = np.log(p / (1 - p)), y[apart]
        loss = lambda t: np.logaddexp(0, np.where(held == 1, -logit, logit) / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 81), key=loss))
    return net


@dataclass
class QualityModel:
    words: list[str]
    vectors: np.ndarray
    net: Network | None

    def scorer(self):
        table = WordVectors(self.words, self.vectors)

        def score(text: str) -> float:
            if self.net is None:
                return 0.5
            return float(self.net.probability(table.pooled(text)[None])[0])

        return score


def fit_rows(texts: list[str], labels: list[int]) -> QualityModel:
    y = np.array(labels, dtype=np.int64)
    if len({*labels}) < 2:
        return QualityModel([], np.zeros((0, DIMS), np.float32), None)
    table = word_vectors(texts)
    x = np.array([table.pooled(t) for t in texts])
    n = table.words
    return QualityModel([w for w, i in table.place.items() if i < n], table.table[:n].copy(), train(x, y))


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled rows outside the held-out quarter."""
    chosen = labels.where(F.col(label_col).isin(0, 1) & (remainder(id_col) != 2)).groupBy(F.col(id_col).alias("k")).agg(F.min(label_col).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("k"), "k").limit(rows)
    # at most ``rows`` pairs of integers: a bounded broadcast
    found = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "k")
    got = sorted(((r["k"], r["t"] or "", r["y"]) for r in found.toLocalIterator()), key=lambda r: r[0])
    return fit_rows([g[1] for g in got], [g[2] for g in got])


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with its columns unchanged plus the probability of label 1 as ``name``, lengthened if it is taken."""
    name = fresh_name(docs, name)
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_WORDS vectors

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = held.value.scorer()
        for texts in batches:
            yield pd.Series([one(t or "") for t in texts], dtype="float64")

    return docs.withColumn(name, probability(F.col(text_col)))
