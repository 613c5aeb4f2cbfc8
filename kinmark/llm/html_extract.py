"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, in page order. A block is described by a
hashed vector of its tag path (tag names, words of class, id and role of all open elements), a hashed vector of
all its words, and a few numbers (length, share of linked text, punctuation, place). A bidirectional LSTM in numpy
reads the whole sequence, so each block is judged with everything before and after it, and a logistic unit says
whether it belongs to the article. The weights beside this module were trained by ``html_train.py`` on pages that
it makes up; nothing is fitted at run time.

Defined results: a null or empty page, and one without article blocks, gives the empty text. Scripts, styles,
templates, comments and the head are markup, not blocks. Character references are decoded, white space inside a
block becomes one space, blocks are joined by one space; nothing is capped. Unclosed and stray tags are tolerated:
a head ends at its end tag or where the first tag or word of a body stands; an embedded element (``EMBEDDED``) that
is self-closing or never closed is its tag alone, and what follows is read on; a script or style that is never closed
runs to the end of the page, as in a browser. A page of very many blocks is read in pieces that carry the state of
the network on, so its vectors never stand in memory together. Repeated rows give repeated results; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from kinmark.llm._common import arrow_limits

PATH_DIMS, WORD_DIMS, NUMBERS, HIDDEN = 128, 24, 10, 24
INPUTS = PATH_DIMS + WORD_DIMS + NUMBERS
#: Pages and blocks that go through the network together; a page of more blocks goes in pieces of so many.
PAGES_AT_ONCE, PIECE = 64, 8192

_PARTS = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS_OF_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")
_DIGIT = re.compile(r"\d")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; a script or style needs an end tag.
ENDLESS, EMBEDDED = frozenset("script style".split()), frozenset("iframe noembed noframes noscript svg template textarea title".split())
_END_OF = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ENDLESS | EMBEDDED}
#: Tags that a head may hold; any other one begins the body.
IN_HEAD = frozenset("base basefont bgsound head html link meta".split()) | ENDLESS | EMBEDDED
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
#: An opening tag of these closes an open one of the same kind (or of its partner).
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An open p ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


@lru_cache(maxsize=20_000)
def _slot(token: str, dims: int) -> tuple[int, float]:
    h = xxhash.xxh3_64_intdigest(token)
    return h % dims, 1.0 if h >> 40 & 1 else -1.0


@lru_cache(maxsize=50_000)
def _word_slot(word: str) -> int:
    """Column, or column + WORD_DIMS for the negative sign."""
    h = xxhash.xxh3_64_intdigest("w:" + word)
    return h % (2 * WORD_DIMS)


@lru_cache(maxsize=5_000)
def _tag_tokens(tag: str, attributes: str) -> tuple[str, ...]:
    names = [w for _, v in _NAMED.findall(attributes) for w in _WORDS_OF_NAME.findall(v.lower())]
    return (f"t:{tag}", *(f"n:{w.rstrip('s') if len(w) > 3 else w}" for w in dict.fromkeys(names)))


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    v = np.zeros(PATH_DIMS, np.float32)
    for depth, tokens in enumerate(path):
        last = 1.0 if depth == len(path) - 1 else 0.0
        for t in tokens:
            at, sign = _slot(t, PATH_DIMS)
            v[at] += sign
            if last:
                at, sign = _slot("leaf " + t, PATH_DIMS)
                v[at] += 0.5 * sign
    return np.clip(v, -3, 3)


class Block:
    __slots__ = ("path", "text", "linked", "label")

    def __init__(self, path: tuple, text: str, linked: int, label: int = 0):
        self.path, self.text, self.linked, self.label = path, text, linked, label


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked, links, start = 0, 0, None

    def cut() -> None:
        nonlocal held, linked, start
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(start, text, min(linked, len(text))))
        held, linked, start = [], 0, None

    def add(raw: str) -> None:
        nonlocal linked, start
        if raw:
            if start is None and not raw.isspace():
                start = tuple(tokens for tag, tokens in stack if tag not in INLINE)
            held.append(raw)
            if links:
                linked += len(raw)

    at, in_head = 0, False
    unclosed: set[str] = set()
    while m := _PARTS.search(page, at):
        raw, at = page[at : m.start()], m.end()
        if in_head and not raw.isspace() and raw:
            in_head = False
        if not in_head:
            add(raw)
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "head":
            in_head = not m[1]
        elif in_head and tag not in IN_HEAD:
            in_head = False
        if tag in _END_OF and not m[1]:
            if tag not in INLINE:
                cut()
            if tag in EMBEDDED and (m[3].rstrip().endswith("/") or tag in unclosed):
                continue
            end = _END_OF[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in ENDLESS:
                at = len(page)
            else:
                unclosed.add(tag)
            continue
        if tag not in INLINE:
            if tag == "br":
                add(" ")
                continue
            cut()
        if tag in VOID:
            continue
        if m[1]:
            if any(t == tag for t, _ in stack):
                while stack:
                    t, _ = stack.pop()
                    links -= t == "a"
                    if t == tag:
                        break
            continue
        closing = CLOSES.get(tag, ("p",) if tag in ENDS_P else ())
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k][0]
                if t in closing:
                    links -= sum(x == "a" for x, _ in stack[k:])
                    del stack[k:]
                    break
                if t not in INLINE and not (tag == "tr" and t in ("td", "th")):
                    break
        if not m[3].rstrip().endswith("/"):
            stack.append((tag, _tag_tokens(tag, m[3])))
            links += tag == "a"
    if not in_head or page[at:].strip():
        add(page[at:])
    cut()
    return out


def describe(blocks: list[Block], first: int = 0, n: int | None = None) -> np.ndarray:
    """One row of INPUTS values for each block; the blocks stand from place ``first`` on in a page of n."""
    n = n or len(blocks)
    x = np.zeros((len(blocks), INPUTS), np.float32)
    for k, b in enumerate(blocks):
        i = first + k
        x[k, :PATH_DIMS] = _path_vector(b.path or ())
        words = _WORD.findall(b.text.lower())
        if words:
            slots = np.bincount(list(map(_word_slot, words)), minlength=2 * WORD_DIMS)
            x[k, PATH_DIMS : PATH_DIMS + WORD_DIMS] = (slots[:WORD_DIMS] - slots[WORD_DIMS:]) / np.sqrt(len(words))
        size = len(b.text)
        ends = b.text[-1] in ".!?\"'»”…:"
        x[k, PATH_DIMS + WORD_DIMS :] = (
            np.log1p(size) / 6, np.log1p(len(words)) / 4, b.linked / size, float(ends), b.text.count(",") / (1 + len(words)) * 4,
            i / n, min(i, 10) / 10, min(n - 1 - i, 10) / 10, len(b.path or ()) / 8, len(_DIGIT.findall(b.text)) / size,
        )
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def run_lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, state: list[np.ndarray] | None = None) -> np.ndarray:
    """Hidden states (pages, steps, HIDDEN) of one direction; masked steps keep the state. A given state is where the
    run starts, and becomes where it ended."""
    pages, steps, _ = x.shape
    h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
    out = np.zeros((pages, steps, HIDDEN), np.float32)
    z = x @ w + b
    for t in range(steps):
        g = z[:, t] + h @ u
        i, f, o = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN : 2 * HIDDEN]), _sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN])
        m = mask[:, t, None]
        c = np.where(m, f * c + i * np.tanh(g[:, 3 * HIDDEN :]), c)
        h = np.where(m, o * np.tanh(c), h)
        out[:, t] = h
    if state is not None:
        state[:] = h, c
    return out


class Labeller:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        if not pages:
            return []
        steps = max(map(len, pages))
        x = np.zeros((len(pages), steps, INPUTS), np.float32)
        mask = np.zeros((len(pages), steps), bool)
        for k, p in enumerate(pages):
            x[k, : len(p)], mask[k, : len(p)] = p, True
        ahead = run_lstm(x, mask, self.w["wf"], self.w["uf"], self.w["bf"])
        back = run_lstm(x[:, ::-1], mask[:, ::-1], self.w["wb"], self.w["ub"], self.w["bb"])[:, ::-1]
        z = ahead @ self.w["of"] + back @ self.w["ob"] + x @ self.w["ox"] + self.w["o"][0]
        return [_sigmoid(z[k, : len(p)]) for k, p in enumerate(pages)]

    def of_long_page(self, blocks: list[Block]) -> np.ndarray:
        """The probabilities of one page, PIECE blocks at a time; each direction carries its state on."""
        n, w = len(blocks), self.w
        z = np.full(n, w["o"][0], np.float32)
        for names, turn in ((("wf", "uf", "bf", "of"), 1), (("wb", "ub", "bb", "ob"), -1)):
            state = [np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)]
            for lo in range(0, n, PIECE)[::turn]:
                x = describe(blocks[lo : lo + PIECE], lo, n)
                out = run_lstm(x[None, ::turn], np.ones((1, len(x)), bool), *(w[k] for k in names[:3]), state)[0, ::turn]
                z[lo : lo + PIECE] += out @ w[names[3]] + (x @ w["ox"] if turn == 1 else 0)
        return _sigmoid(z)


_LOADED: list[Labeller] = []


def labeller() -> Labeller:
    """The trained weights; read through the package's loader, as the package may be shipped as a zip file."""
    if not _LOADED:
        import io
        import pkgutil

        raw = pkgutil.get_data("kinmark.llm", "html_weights.npz")
        with np.load(io.BytesIO(raw)) as f:
            _LOADED.append(Labeller(dict(f)))
    return _LOADED[0]


def main_texts(pages: list[str | None], model: Labeller | None = None) -> list[str]:
    model = model or labeller()
    cut = [blocks_of(p or "") for p in pages]
    out = [""] * len(pages)
    kept = lambda blocks, p: " ".join(b.text for b, keep in zip(blocks, p >= 0.5, strict=True) if keep)
    for i, blocks in enumerate(cut):
        if len(blocks) > PIECE:
            out[i] = kept(blocks, model.of_long_page(blocks))
    # pages of like length together, so that little is padded
    order = sorted((i for i in range(len(pages)) if 0 < len(cut[i]) <= PIECE), key=lambda i: len(cut[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < PAGES_AT_ONCE and (hi - lo + 1) * len(cut[order[hi]]) <= PIECE:
            hi += 1
        some = order[lo:hi]
        for i, p in zip(some, model.probabilities([describe(cut[i]) for i in some]), strict=True):
            out[i] = kept(cut[i], p)
        lo = hi
    return out


def extract(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Per page: id, url, text (empty if none), n_chars."""
    arrow_limits(df.sparkSession, 8)
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = main_texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    out = df.select(df[id_col].alias("id"), df[url_col].alias("url"), df[html_col].alias("html"))
    out = out.mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
