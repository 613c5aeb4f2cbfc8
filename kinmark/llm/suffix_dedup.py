"""Removal of byte strings that occurred earlier in the corpus, by suffix arrays over anchored contexts.

A byte is removed when a string of ``length`` bytes that covers it also starts earlier (smaller id, or an earlier
place of the same document). The corpus is never put into one array:

1. Every window of ``length`` bytes names one anchor: the rightmost smallest hash among the ``GRAM``-byte strings
   inside it. Equal windows name equal anchors at equal offsets, so they can only meet where anchors agree, and an
   anchor whose hash occurs once needs no further work.
2. The bytes around each repeated anchor, with the windows that name it, form a context. Where the digests of all
   contexts of a hash are equal, the earliest stays without its bytes being read again; else contexts of one anchor
   hash meet in a group, and equal ones collapse to the earliest. A hash with very many occurrences is split by the
   windows' offsets and by the bytes that all of them cover, finer the more occurrences it has, so that no group
   grows with the corpus.
3. Different contexts of a group go into a suffix array (Lyndon-prefix grouping) over cells of ``CELL`` bytes that
   are counted from the anchor. The order of the cells' suffixes, the common prefixes of neighbours in bytes, and
   the up to ``CELL - 1`` bytes before a cell decide for every single window which others equal it, byte by byte.
   The earliest of each class stays; every other window is a repeat.
4. A document's repeated windows are all windows of its repeated anchors but the earliest ones of step 3.

Defined results: null and empty texts have no bytes. Texts shorter than ``length`` lose nothing. Ids order the
documents and should be unique; rows that repeat id and text count as one document, with one result each. Rows
with a null id are neither compared nor changed. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmark.llm._common import arrow_limits, stored
from kinmark.llm.suffix_array import suffix_order

LENGTH, GRAM, CELL = 100, 32, 16
SPAN = LENGTH - GRAM + 1  # places of an anchor inside a window
BLOCK_BYTES, CONTEXTS_AT_ONCE, CONTEXTS_KEPT = 1 << 16, 20_000, 40_000
#: (occurrences from, offsets taken together)
SPLITS = ((4_097, 16), (65_537, 4), (1_048_577, 1))
_P = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def _anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents that lie end to end: document number, place, largest and smallest offset of the windows that
    name it, and hash, for every anchor."""
    n = len(data)
    empty = np.empty(0, np.int64)
    if n < LENGTH:
        return empty, empty, empty, empty, empty
    h = data.astype(np.uint64)
    step, power = 1, int(_P)
    while step < GRAM:
        h = h[:-step] * np.uint64(power) + h[step:]
        power, step = power * power % (1 << 64), step * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # the hash's high half decides, the place in the low half prefers the rightmost
    best = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    step = 1
    while step * 2 <= SPAN:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if SPAN > step:
        best = np.minimum(best[: step - SPAN], best[SPAN - step :])
    place = (_LOW - (best & _LOW)).astype(np.int64)
    owner = np.searchsorted(starts, np.arange(len(place)), side="right") - 1
    ends = np.append(starts[1:], n)
    valid = np.arange(len(place)) + LENGTH <= ends[owner]
    s = np.flatnonzero(valid)
    if not len(s):
        return empty, empty, empty, empty, empty
    place, owner = place[s], owner[s]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(owner) != 0)]))
    last = np.append(cut[1:], len(s)) - 1
    p, d = place[cut], owner[cut]
    return d, p - starts[d], p - s[cut], p - s[last], h[p].view(np.int64)


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about BLOCK_BYTES, with the number of the first."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_BYTES:
            yield lo, texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def anchors(docs: DataFrame, with_digests: bool) -> DataFrame:
    """h, id, q, d: the anchors of all texts; q packs place, largest and smallest offset, d is a digest of the
    context and its offsets, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in batch.column(1).to_pylist()]
            for lo, some in _blocks(texts):
                starts = np.cumsum([0, *map(len, some[:-1])])
                raw = b"".join(some)
                d, p, a, b, h = _anchors(np.frombuffer(raw, np.uint8), starts)
                at, offsets = starts[d] + p, (a << 8) | b
                digests = pa.nulls(len(h), pa.int64())
                if with_digests:
                    spans = zip((at - a).tolist(), (at - b + LENGTH).tolist(), offsets.tolist(), strict=True)
                    digests = pa.array(np.array([xxhash.xxh3_64_intdigest(raw[x:y], o) for x, y, o in spans], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[lo + d].astype(np.int64)), pa.array((p << 16) | offsets), digests], names=["h", "id", "q", "d"])

    return docs.where("id is not null").mapInArrow(run, "h long, id long, q long, d long")


def _split_of(count: int, splits: Sequence[tuple[int, int]]) -> int:
    width = SPAN
    for least, offsets in splits:
        if count >= least:
            width = offsets
    return width


_CONTEXT = "key long, a int, b int, ctx binary, id long, p long"


def _contexts(splits: Sequence[tuple[int, int]]):
    """Rows (id, text, list of (h, q, n)), by ascending id, to contexts; those met in a task already are left out
    (the earlier one stands for them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple] = set()
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "a", "b", "ctx", "id", "p"])

        for batch in batches:
            for i, text, spots in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if len(met) >= CONTEXTS_KEPT:
                    met.clear()
                data = (text or "").encode("utf-8", "surrogatepass")
                for spot in sorted(spots, key=lambda x: x["q"]):
                    q, h = spot["q"], spot["h"]
                    p, a, b = q >> 16, (q >> 8) & 255, q & 255
                    if not spot["n"]:  # all contexts of the hash are equal: no bytes needed
                        if (h,) not in met:
                            met.add((h,))
                            out.append((h, a, b, b"", i, p))
                        continue
                    width = _split_of(spot["n"], splits)
                    parts = [(h, a, b)]
                    if width < SPAN:
                        parts = []
                        for low in range(b // width * width, a + 1, width):
                            hi, lo = min(a, low + width - 1), max(b, low)
                            core = data[p - low : p - low - width + 1 + LENGTH]  # covered by every window of this part
                            parts.append((xxhash.xxh3_64_intdigest(core, seed=low) - (1 << 63), hi, lo))
                    for key, hi, lo in parts:
                        ctx = data[p - hi : p - lo + LENGTH]
                        mark = (key, hi, lo, ctx)
                        if mark in met:
                            continue
                        if len(met) >= CONTEXTS_KEPT:
                            met.clear()
                        met.add(mark)
                        out.append((key, hi, lo, ctx, i, p))
                if len(out) >= 5000:
                    yield emit()
                    out.clear()
        yield emit()

    return run


def _first_windows(rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows: (a, b, context) in order of occurrence inside each group. The runs of windows that are the first of
    their kind, as arrays: row, largest offset, smallest offset."""
    n = len(rows)
    a, b = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    top = a // CELL  # cells are counted from the anchor: the first one starts top * CELL before it
    cells = -(-(top * CELL + LENGTH - b) // CELL)
    width = int(cells.max()) * CELL
    skip = a - top * CELL  # bytes before the first cell
    body = np.zeros((n, width + LENGTH + CELL), np.uint8)
    lengths = np.zeros(n, np.int64)
    head = np.zeros((n, CELL), np.uint8)  # the bytes before the first cell, right-aligned
    for r, k in enumerate(skip.tolist()):
        raw = np.frombuffer(rows[r][2], np.uint8)
        if k:
            head[r, CELL - k :] = raw[:k]
        size = len(raw) - k
        body[r, :size] = raw[k:]
        lengths[r] = size
    grid = body[:, :width].reshape(n, width // CELL, CELL)
    real = np.arange(width // CELL)[None, :] < cells[:, None]
    _, symbol = np.unique(np.ascontiguousarray(grid[real]).view(">u8").reshape(-1, 2), axis=0, return_inverse=True)
    # text of the array: each row's cells, then a separator below all cells
    sizes = cells + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.full(offsets[-1], -1, np.int64)
    row_of, cell_of = np.nonzero(real)
    flat[offsets[row_of] + cell_of] = symbol.ravel()
    order = np.array(suffix_order(flat))
    where = np.searchsorted(offsets, order, side="right") - 1
    cell = order - offsets[where]
    # suffixes from which a window can be counted
    useful = (cell <= top[where] - b[where] // CELL) & (cell < cells[where])
    where, cell = where[useful], cell[useful]
    m = len(where)
    rank = np.full((n, width // CELL + 1), -1, np.int64)
    rank[where, cell] = np.arange(m)
    # bytes that neighbours in the order have in common, up to LENGTH
    take = cell[:, None] * CELL + np.arange(LENGTH)[None, :]
    window = body[where[:, None], take]
    window_len = np.minimum(lengths[where] - cell * CELL, LENGTH)
    differ = window[1:] != window[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    common = np.minimum(common, np.minimum(window_len[1:], window_len[:-1]))
    source = np.concatenate([head, body], axis=1)
    firsts: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(CELL):  # t bytes before a cell, then LENGTH - t bytes from it
        run = np.concatenate([[0], np.cumsum(common < LENGTH - t)]) if m else np.empty(0, np.int64)
        low = np.arange(0, SPAN + CELL, CELL)[None, :] + t  # offsets of windows with t bytes before their cell
        r, j = np.nonzero((low >= b[:, None]) & (low <= a[:, None]))
        if not len(r):
            continue
        o = low[0, j]
        c = top[r] - o // CELL
        keys = np.zeros((len(r), CELL), np.uint8)
        keys[:, :t] = source[r[:, None], (CELL + c * CELL - t)[:, None] + np.arange(t)[None, :]]
        used = [run[rank[r, c]].astype(np.uint64), *(keys.view(">u8").astype(np.uint64).T)][: 1 + -(-t // 8)]
        by = np.lexsort((r, *used))
        new = np.concatenate([[True], np.any([x[by[1:]] != x[by[:-1]] for x in used], axis=0)])
        firsts.append((r[by[new]], o[by[new]]))
    if not firsts:
        return (np.empty(0, np.int64),) * 3
    r, o = (np.concatenate(x) for x in zip(*firsts, strict=True))
    by = np.lexsort((-o, r))
    r, o = r[by], o[by]
    cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (o[1:] != o[:-1] - 1)]))
    return r[cut], o[cut], o[np.append(cut[1:], len(r)) - 1]


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by (key, id, p) to the windows that stay: (id, q), q as in the anchors."""
    pending: list[tuple[int, int, bytes]] = []
    whose: list[tuple[int, int]] = []
    out: list[tuple[int, int]] = []

    def close(group: dict[tuple, tuple[int, int]]) -> None:
        if len(group) == 1:
            ((a, b, _), (i, p)) = next(iter(group.items()))
            out.append((i, (p << 16) | (a << 8) | b))
            return
        pending.extend(group)
        whose.extend(group.values())

    def settle() -> None:
        if pending:
            r, a, b = _first_windows(pending)
            i, p = np.array(whose, dtype=np.int64)[r].T
            out.extend(zip(i.tolist(), ((p << 16) | (a << 8) | b).tolist(), strict=True))
        pending.clear()
        whose.clear()

    def emit() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["id", "q"])
        out.clear()
        return rows

    now, group = None, {}
    for batch in batches:
        for key, a, b, ctx, i, p in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if key != now:
                if group:
                    close(group)
                now, group = key, {}
                if len(pending) >= CONTEXTS_AT_ONCE:
                    settle()
            group.setdefault((a, b, ctx), (i, p))
        if len(out) >= 5000:
            yield emit()
    if group:
        close(group)
    settle()
    yield emit()


def _unpacked(q: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First and last starts of windows."""
    x = np.array(q, dtype=np.int64)
    p = x >> 16
    return p - ((x >> 8) & 255), p - (x & 255)


def removed_spans(n: int, repeats: list[int], firsts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of removed bytes."""
    mark = np.zeros(n + 1, np.int32)
    lo, hi = _unpacked(repeats)
    np.add.at(mark, lo, 1)
    np.add.at(mark, hi + 1, -1)
    starts = np.cumsum(mark)[:n] > 0
    lo, hi = _unpacked(firsts)
    for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
        starts[x : y + 1] = False
    at = np.flatnonzero(starts)
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.concatenate([[True], np.diff(at) > LENGTH]))
    return at[cut], at[np.append(cut[1:], len(at)) - 1] + LENGTH


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """id, spots: each document's anchors whose hash occurs more than once, with the number of occurrences, or 0
    where all their contexts are equal."""
    counts = anchors(docs, True).groupBy("h").agg(F.count("*").cast("int").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).where("n > 1")
    # stored, so that the join has a shuffle of its own on either side and adaptive execution can split a frequent hash
    counts = stored(counts.select("h", F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.col("n")).alias("n")), "counts")
    return anchors(docs, False).select("h", "id", "q").join(counts, "h").groupBy("id").agg(F.collect_list(F.struct("h", "q", "n")).alias("spots"))


def cut_repeats(df: DataFrame, id_col: str, text_col: str, with_text: bool = False) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans, kept_sha256, and on request the kept text, for which bytes of
    a character that is cut apart are left out."""
    spark = df.sparkSession
    arrow_limits(spark, 8)
    kind = df.schema[id_col].dataType
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spots = stored(repeated_anchors(docs), "anchors")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # both branches below join the same rows of the same columns, so the texts are shuffled once
    whole = docs.where("id is not null").join(spots.where("id is not null"), "id", "left")
    # by id, as the earliest of equal contexts is the one that a task passes on (a merge join has sorted already)
    repeated = whole.where("spots is not null").select("id", "text", "spots").sortWithinPartitions("id")
    contexts = repeated.mapInArrow(_contexts(SPLITS), _CONTEXT)
    firsts = contexts.repartition(n, "key").sortWithinPartitions("key", "id", "p").mapInArrow(_firsts, "id long, q long")
    kept = firsts.groupBy("id").agg(F.collect_list("q").alias("firsts"))
    both = whole.join(kept, "id", "left").select("id", "text", F.transform("spots", lambda x: x["q"]).alias("repeats"), "firsts")
    nothing = F.lit(None).cast("array<long>")
    both = both.union(docs.where("id is null").select("id", "text", nothing, nothing))
    extra = ", kept_text string" if with_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, repeats, ones in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                lo, hi = removed_spans(len(data), repeats, ones or []) if repeats else ([], [])
                edges = [0, *(x for span in zip(map(int, lo), map(int, hi), strict=True) for x in span), len(data)]
                left = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(data), len(data) - len(left), len(lo), hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "ignore")] if with_text else [])))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 + with_text]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 5 + with_text])

    out = both.mapInArrow(run, f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
