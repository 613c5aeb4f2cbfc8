"""Candidates, their set overlaps and the best of each record, from blocks of packed arrays (B1-B3, CF1-CF4).

The plans of ``blocking`` and ``ranking`` move a row for each key, pair and list. Here, a row of a shuffle is a block: all
that one task sends to one slot, as compressed integer columns; keys, pairs and overlaps are worked out by the
array. Ids are numbers (``blocking.NUMBERED``); tables of other ids go through the row plans, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmark.operators import blocking, ranking
from kinmark.operators.blocking import DF_LEVELS, FAMILIES, HASHED, KINDS, SLOT_BITS, BlockConfig
from kinmark.session import dropped, stored

BLOCK = "slot int, kind int, names array<string>, body binary, flat binary"
SHORTS = tuple(short for _, short in KINDS.values())
#: Records for each slot; rows that a task holds before it sends blocks.
SLOT_RECORDS, HELD = 25_000, 1_500_000
#: Lists of at most so many ids are compared all with all.
SHORT_LIST = 32
_ODD, _SPREAD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_BACK = pow(_ODD, -1, 1 << 64)


def packed(*columns: np.ndarray) -> bytes:
    """Integer columns of one length, byte by byte, compressed."""
    data = np.stack([np.asarray(c, np.int64) for c in columns])
    k, n = data.shape
    planes = data.view(np.uint8).reshape(k, n, 8).transpose(0, 2, 1).tobytes()
    return np.array([k, n], np.int32).tobytes() + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpacked(body: bytes) -> np.ndarray:
    k, n = np.frombuffer(body, np.int32, 2).tolist()
    planes = pa.Codec("zstd").decompress(memoryview(body)[8:], 8 * k * n, asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(k, 8, n).transpose(0, 2, 1).copy().view(np.int64)[:, :, 0]


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(_ODD)
    return (x ^ x >> np.uint64(29)) * np.uint64(_SPREAD)


def _place(mixed: np.ndarray, n: int) -> np.ndarray:
    """0 to n - 1, ascending with the mixed value."""
    return ((mixed >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int64)


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def _cuts(slots: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(slot, from, to) of ascending slots."""
    start = np.flatnonzero(np.diff(slots, prepend=-1))
    return zip(slots[start].tolist(), start.tolist(), [*start[1:].tolist(), len(slots)], strict=True)


def _block(rows: list[tuple[int, int, list[str], bytes, bytes | None]]) -> pa.RecordBatch:
    slot, kind, names, body, flat = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int32()), "kind": pa.array(kind, pa.int32()), "names": pa.array(names, pa.list_(pa.string())), "body": pa.array(body, pa.binary()), "flat": pa.array(flat, pa.binary())})


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, list[str], bytes, bytes]]]]:
    """The blocks of each slot; rows are sorted by slot."""
    at, held = None, []
    for b in batches:
        columns = [b.column(c) for c in ("slot", "kind", "names", "body", "flat")]
        for i in range(b.num_rows):
            slot, *rest = (c[i].as_py() for c in columns)
            if held and slot != at:
                yield at, held
                held = []
            at = slot
            held.append(rest)
    if held:
        yield at, held


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("slot").sortWithinPartitions("slot")


class Names:
    """Codes of countries within one task."""

    def __init__(self):
        self.codes: dict[str, int] = {}

    def of(self, names: list[str], codes: np.ndarray) -> np.ndarray:
        if not names:
            return codes
        return np.array([self.codes.setdefault(n, len(self.codes)) for n in names], np.int64)[codes]

    def sent(self, codes: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Only the names that these codes use, and the codes among them."""
        names = list(self.codes)
        if len(names) == 1:
            return names, codes
        used = np.flatnonzero(np.bincount(codes, minlength=len(names)))
        place = np.zeros(len(names), np.int64)
        place[used] = np.arange(len(used))
        return [names[i] for i in used.tolist()], place[codes]

    def salts(self) -> np.ndarray:
        return np.array([crc32(n.encode()) for n in self.codes], np.uint64) * np.uint64(_SPREAD)


def _runs(h: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: each row's run, and where runs start."""
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (code[1:] != code[:-1])])
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _family(h: np.ndarray, code: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return (h * np.uint64(_BACK) - salts[code] >> np.uint64(2 * SLOT_BITS)).astype(np.int64)


def _key_blocks(cfg: BlockConfig, caps: np.ndarray, slots: int, passes: int, i: int) -> Callable:
    """Blocks (country, key, id * 2 + is_a) of one pass over the keys. Of a key with more b's than its cap, a task
    sends the cap and one."""

    def sent(held: list[np.ndarray], names: Names) -> Iterator[pa.RecordBatch]:
        h, code, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        h, code, ids = h[order], code[order], ids[order]
        run, start = _runs(h, code)
        is_b = ids % 2 == 0
        cap, n_b, upto = caps[_family(h[start], code[start], names.salts())], np.bincount(run[is_b], minlength=len(start)), np.cumsum(is_b)
        nth = upto - 1 - (upto[start] - is_b[start])[run]
        keep = np.where(is_b, nth <= cap[run], (n_b <= cap)[run])
        h, code, ids = h[keep], code[keep], ids[keep]
        rows = []
        for slot, lo, hi in _cuts(_place(h, slots * passes)):
            of, codes = names.sent(code[lo:hi])
            rows.append((slot, 0, of, packed(np.diff(h[lo:hi], prepend=np.uint64(0)).view(np.int64), codes, ids[lo:hi]), None))
        if rows:
            yield _block(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, n = Names(), [], 0
        for b in batches:
            keys = blocking._shared_keys_of(b, cfg)
            row, at = np.nonzero(keys >= 0)
            countries = b.column("country").dictionary_encode()
            code = names.of(countries.dictionary.to_pylist(), countries.indices.to_numpy(zero_copy_only=False).astype(np.int64))[row]
            h = (keys[row, at].astype(np.uint64) + (names.salts()[code] if len(code) else np.zeros(0, np.uint64))) * np.uint64(_ODD)
            if passes > 1:
                mine = _place(h, slots * passes) // slots == i
                row, code, h = row[mine], code[mine], h[mine]
            held.append((h, code, b.column("id").to_numpy()[row]))
            n += len(h)
            if n >= HELD:
                yield from sent(held, names)
                held, n = [], 0
        if n:
            yield from sent(held, names)

    return run


def _sorted_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each slot: names, keys in order, their country codes and ids, and runs."""
    for _, blocks in _groups(batches):
        names, parts = Names(), []
        for _, of, body, _ in blocks:
            step, code, ids = unpacked(body)
            parts.append((np.cumsum(step.view(np.uint64), dtype=np.uint64), names.of(of, code), ids))
        h, code, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        if ((h[order][1:] == h[order][:-1]) & (code[order][1:] != code[order][:-1])).any():
            order = np.lexsort((code, h))  # keys of two countries that mix to one value
        h, code, ids = h[order], code[order], ids[order]
        yield names, h, code, ids, *_runs(h, code)


def _judged(caps: np.ndarray) -> Callable:
    """Blocks of the keys that both sides have and whose block is not over its cap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, h, code, ids, of_run, start in _sorted_keys(batches):
            n, n_b = np.diff(np.append(start, len(h))), np.bincount(of_run[ids % 2 == 0], minlength=len(start))
            good = ((n_b > 0) & (n_b < n) & (n_b <= caps[_family(h[start], code[start], names.salts())]))[of_run]
            if good.any():
                of, codes = names.sent(code[good])
                yield _block([(0, 0, of, packed(np.diff(h[good], prepend=np.uint64(0)).view(np.int64), codes, ids[good]), None)])

    return run


def _keyed(df: DataFrame, is_a: int, cfg: BlockConfig) -> DataFrame:
    """What keys are made of, ids as numbers with their side."""
    made = (blocking.id_number(F.col("entity_id")) * 2 + is_a).alias("id")
    return blocking.with_heads(df.where("country is not null"), cfg).select("country", made, "at", "mt", "an", *(f"{s}_lone" for s in SHORTS), *(f"key_{f}" for f in HASHED))


def live_blocks(lists: DataFrame, a: DataFrame, cfg: BlockConfig, slots: int, passes: int) -> DataFrame:
    """A stored block for each slot of the keys: those that both sides have under their cap."""
    caps = np.array([cfg.cap(f) for f in FAMILIES])

    records = _keyed(a, 1, cfg).unionByName(_keyed(lists.where("src > 1"), 0, cfg))
    made = [stored(_dealt(records.mapInArrow(_key_blocks(cfg, caps, slots, passes, i), BLOCK)).mapInArrow(_judged(caps), BLOCK), "live") for i in range(passes)]
    return reduce(DataFrame.unionByName, made)


def _pair_blocks(slots: int, passes: int, i: int, to_a: bool) -> Callable:
    """Blocks (a, b, country and family) of one pass over the a side, a row for each shared key, to the slots of the b's."""

    def met(blocks: Iterator[pa.RecordBatch], names: Names) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in blocks:
            for of, body in zip(batch.column("names").to_pylist(), batch.column("body"), strict=True):
                step, code, ids = unpacked(body.as_py())
                h, own = np.cumsum(step.view(np.uint64), dtype=np.uint64), Names()
                code = own.of(of, code)
                run, start = _runs(h, code)
                fam, both, is_a = _family(h[start], code[start], own.salts()), names.of(of, code[start]), ids % 2 == 1
                b_rows, n_b = np.flatnonzero(~is_a), np.bincount(run[~is_a], minlength=len(start))
                first, ids = np.cumsum(n_b) - n_b, ids >> 1
                a_rows = np.flatnonzero(is_a)
                if passes > 1:
                    a_rows = a_rows[_place(_mixed(ids[a_rows]), slots * passes) // slots == i]
                n = n_b[run[a_rows]]
                part = (np.cumsum(n) - n) // HELD
                for lo in np.flatnonzero(np.diff(part, prepend=-1)).tolist():
                    hi = lo + int(np.searchsorted(part[lo:], part[lo], "right"))
                    rows, k = a_rows[lo:hi], n[lo:hi]
                    yield np.repeat(ids[rows], k), ids[b_rows[_ranges(first[run[rows]], k)]], np.repeat((both * 8 + fam)[run[rows]], k)

    def sent(held: list, names: Names) -> pa.RecordBatch:
        a, b, tag = (np.concatenate(x) for x in zip(*held, strict=True))
        to = _place(_mixed(a if to_a else b), slots * passes if to_a else slots) % slots
        order = np.argsort(to.astype(np.uint16) if slots < 1 << 16 else to, kind="stable")
        a, b, tag, rows = a[order], b[order], tag[order], []
        for slot, lo, hi in _cuts(to[order]):
            of, code = names.sent(tag[lo:hi] >> 3)
            rows.append((slot, 0, of, packed(a[lo:hi], b[lo:hi], code * 8 + tag[lo:hi] % 8), None))
        return _block(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, n = Names(), [], 0
        for part in met(batches, names):
            held.append(part)
            n += len(part[0])
            if n >= HELD:
                yield sent(held, names)
                held, n = [], 0
        if n:
            yield sent(held, names)

    return run


def _counted(blocks: list, names: Names) -> tuple[np.ndarray, ...]:
    """(a, b, country, n_keys, fam_mask) of pair blocks, ascending."""
    parts = []
    for kind, of, body, _ in blocks:
        if kind == 0:
            a, b, tag = unpacked(body)
            parts.append((a, b, names.of(of, tag >> 3) * 8 + tag % 8))
    if not parts:
        return (np.zeros(0, np.int64),) * 5
    a, b, tag = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((tag, b, a)) if len(names.codes) > 1 else np.lexsort((b, a))
    a, b, tag = a[order], b[order], tag[order]
    code = tag >> 3
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (code[1:] != code[:-1])]))
    return a[start], b[start], code[start], np.diff(np.append(start, len(a))), np.bitwise_or.reduceat(1 << tag % 8, start)


def _named(names: Names, code: np.ndarray) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), pa.array(list(names.codes), pa.string())).cast(pa.string())


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, blocks in _groups(batches):
        names = Names()
        a, b, code, n, mask = _counted(blocks, names)
        yield pa.RecordBatch.from_pydict({"country": _named(names, code), "a": pa.array(a), "b": pa.array(b), "n_keys": pa.array(n.astype(np.int64)), "fam_mask": pa.array(mask.astype(np.int32))})


class Lists:
    """Id lists of records: ids, the lengths of each kind's list, and all values one after the other."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, flat: np.ndarray):
        self.ids, self.lens, self.flat = ids, lens, flat
        self.ends = np.cumsum(lens.sum(axis=0))

    @staticmethod
    def of(parts: list[Lists]) -> Lists:
        if not parts:
            return Lists(np.zeros(0, np.int64), np.zeros((len(SHORTS), 0), np.int64), np.zeros(0, np.int64))
        return Lists(np.concatenate([p.ids for p in parts]), np.concatenate([p.lens for p in parts], axis=1), np.concatenate([p.flat for p in parts]))

    @staticmethod
    def read(body: bytes, flat: bytes | None) -> Lists:
        ids, *lens = unpacked(body)
        return Lists(ids, np.array(lens), unpacked(flat)[0] if flat else np.zeros(0, np.int64))

    def at(self, rows: np.ndarray) -> Lists:
        n = self.lens.sum(axis=0)
        return Lists(self.ids[rows], self.lens[:, rows], self.flat[_ranges((self.ends - n)[rows], n[rows])])

    def sent(self) -> tuple[bytes, bytes | None]:
        return packed(self.ids, *self.lens), packed(self.flat) if len(self.flat) else None

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ids, row here) of all that agree."""
        order = np.argsort(self.ids, kind="stable")
        known = self.ids[order]
        lo, hi = np.searchsorted(known, ids, "left"), np.searchsorted(known, ids, "right")
        return np.repeat(np.arange(len(ids)), hi - lo), order[_ranges(lo, hi - lo)]

    def starts(self, kind: int) -> np.ndarray:
        return self.ends - self.lens[kind:].sum(axis=0)


def _list_blocks(slots: int, passes: int) -> Callable:
    """Blocks of records' lists: of a's (kind 1 + pass) and of b's (kind 0), each to its slot."""

    def sent(held: list[tuple[Lists, np.ndarray]]) -> pa.RecordBatch:
        all_of, to = Lists.of([x for x, _ in held]), np.concatenate([t for _, t in held])
        order = np.argsort(to, kind="stable")
        rows = []
        for t, lo, hi in _cuts(to[order]):
            rows.append((t % slots, t // slots, [], *all_of.at(order[lo:hi]).sent()))
        return _block(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            lists = [b.column(s) for s in SHORTS]
            lens = np.stack([pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists])
            offsets = [x.offsets.to_numpy().astype(np.int64)[:-1] for x in lists]
            flat = np.empty(lens.sum(), np.int64)
            before = np.cumsum(lens.sum(axis=0)) - lens.sum(axis=0)
            for k, x in enumerate(lists):
                flat[_ranges(before + lens[:k].sum(axis=0), lens[k])] = x.values.to_numpy(zero_copy_only=False)[_ranges(offsets[k], lens[k])]
            ids, is_a = b.column("id").to_numpy(), b.column("is_a").to_numpy(zero_copy_only=False)
            mixed = _mixed(ids)
            to = np.where(is_a, _place(mixed, slots * passes) + slots, _place(mixed, slots))
            held.append((Lists(ids, lens, flat), to))
            n += len(ids)
            if n >= HELD // 8:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    return run


def _with_b_lists(slots: int, passes: int) -> Callable:
    """Counted pairs with the b's lists, from the slots of the b's to those of the a's. A block's pairs have rows of the block's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _groups(batches):
            names = Names()
            a, b, code, n, mask = _counted(blocks, names)
            lists = Lists.of([Lists.read(body, flat) for kind, _, body, flat in blocks if kind == 1])
            row, of_b = lists.places(b)
            to = _place(_mixed(a[row]), slots * passes) % slots
            order = np.argsort(to, kind="stable")
            row, of_b, rows = row[order], of_b[order], []
            for slot, lo, hi in _cuts(to[order]):
                used, at = np.unique(of_b[lo:hi], return_inverse=True)
                r = row[lo:hi]
                of, codes = names.sent(code[r])
                body, flat = lists.at(used).sent()
                pairs = packed(a[r], at, codes, n[r], mask[r])
                rows.append((slot, 0, of, np.array([len(pairs)], np.int64).tobytes() + pairs + body, flat))
            if rows:
                yield _block(rows)

    return run


def _matrix(lists: Lists, kind: int, rows: np.ndarray, width: int, fill: int, dtype: type) -> np.ndarray:
    start, n, place = lists.starts(kind)[rows], lists.lens[kind][rows], np.arange(max(1, width))
    has = place < n[:, None]
    flat = lists.flat if len(lists.flat) else np.zeros(1, np.int64)
    return np.where(has, flat[np.where(has, start[:, None] + place, 0)], fill).astype(dtype)


def _shared(x: Lists, y: Lists, kind: int, rx: np.ndarray, ry: np.ndarray, limits: np.ndarray) -> list[np.ndarray]:
    """Of two records' lists: how many ids they share, the least one, and how many are below each limit."""
    n, most = len(rx), np.iinfo(np.int64).max
    out = [np.zeros(n, np.int64), np.full(n, most), *(np.zeros(n, np.int64) for _ in limits)]
    short = (x.lens[kind][rx] <= SHORT_LIST) & (y.lens[kind][ry] <= SHORT_LIST)
    dtype = np.int32 if max(x.flat.max(initial=0), y.flat.max(initial=0)) < 1 << 31 else np.int64
    for lo in range(0, n, 65536):
        rows = lo + np.flatnonzero(short[lo : lo + 65536])
        if not len(rows):
            continue
        p = _matrix(x, kind, rx[rows], int(x.lens[kind][rx[rows]].max()), -1, dtype)
        q = _matrix(y, kind, ry[rows], int(y.lens[kind][ry[rows]].max()), -2, dtype)
        same = reduce(np.logical_or, (p == q[:, j : j + 1] for j in range(q.shape[1])))
        out[0][rows] = same.sum(axis=1)
        first = p[np.arange(len(p)), same.argmax(axis=1)]
        out[1][rows] = np.where(same.any(axis=1), first, most)
        for k, limit in enumerate(limits):
            out[2 + k][rows] = (same & (p < limit[rows][:, None])).sum(axis=1)
    for r in np.flatnonzero(~short).tolist():
        u, v = (t.flat[s : s + t.lens[kind][i]] for t, i, s in ((x, rx[r], x.starts(kind)[rx[r]]), (y, ry[r], y.starts(kind)[ry[r]])))
        both = np.intersect1d(u, v)
        for k, value in enumerate((len(both), both.min(initial=most), *((both < limit[r]).sum() for limit in limits))):
            out[k][r] = value
    return out


def _half_up(values: np.ndarray) -> np.ndarray:
    """Rounded to nine decimals as SQL does, in units of the last one."""
    scaled = values * 1e9
    out = np.floor(scaled + 0.5).astype(np.int64)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3).tolist():
        out[i] = int(Decimal(repr(float(values[i]))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _text_order(ids: np.ndarray) -> np.ndarray:
    """Ranks of ids as texts."""
    used, at = np.unique(ids, return_inverse=True)
    texts = pc.binary_join_element_wise(pa.array(used & 7).cast(pa.string()), pa.array(used >> 3).cast(pa.string()), "-")
    rank = np.empty(len(used), np.int64)
    rank[pc.sort_indices(texts).to_numpy()] = np.arange(len(used))
    return rank[at]


#: Columns of stored overlaps: whole numbers from which all cheap features follow.
_OVERLAPS = ("n_keys", "fam_mask", *(f"{s}_{k}" for s in SHORTS for k in ("inter", "least", *(f"r{i}" for i in range(ranking.levels_of(s))), "alen", "blen")))
_KINDS_OF = {"n_keys": "bigint"} | {f"{s}_least": "bigint" for s in SHORTS}


def _overlaps(limits: dict[tuple[str, str], tuple[int, ...]], top: int) -> Callable:
    """Rows of each a's pairs with their overlaps; with top, only its best ones, with score and rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _groups(batches):
            names, pairs, b_lists, n_b = Names(), [], [], 0
            a_lists = Lists.of([Lists.read(body, flat) for kind, _, body, flat in blocks if kind == 1])
            for kind, of, body, flat in blocks:
                if kind == 0:
                    size = int(np.frombuffer(body, np.int64, 1)[0])
                    a, at, code, n, mask = unpacked(body[8 : 8 + size])
                    pairs.append((a, at + n_b, names.of(of, code), n, mask))
                    b_lists.append(Lists.read(body[8 + size :], flat))
                    n_b += len(b_lists[-1].ids)
            if not pairs:
                continue
            lists_b = Lists.of(b_lists)
            a, of_b, code, n, mask = (np.concatenate(x) for x in zip(*pairs, strict=True))
            row, of_a = a_lists.places(a)
            of_b, code = of_b[row], code[row]
            made = {"a": a[row], "b": lists_b.ids[of_b], "n_keys": n[row], "fam_mask": mask[row]}
            for k, (kind, (_, s)) in enumerate(KINDS.items()):
                of_country = np.array([limits.get((c, kind), (0,) * len(DF_LEVELS)) for c in names.codes], np.int64)
                found = _shared(a_lists, lists_b, k, of_a, of_b, of_country[code].T[: ranking.levels_of(s)])
                least = np.where(found[0] > 0, found[1], ranking.NO_ID)
                made |= {f"{s}_inter": found[0], f"{s}_least": least, **{f"{s}_r{i}": x for i, x in enumerate(found[2:])}, f"{s}_alen": a_lists.lens[k][of_a], f"{s}_blen": lists_b.lens[k][of_b]}
            if top:
                conts = {f"{s}_cont": np.divide(made[f"{s}_inter"], shorter, out=np.zeros(len(row)), where=shorter > 0) for s in SHORTS for shorter in [np.minimum(made[f"{s}_alen"], made[f"{s}_blen"])]}
                score = reduce(np.add, (w * (conts | made)[c] for c, w in ranking.WEIGHTS.items()), np.zeros(len(row)))
                order = np.lexsort((_text_order(made["b"]), -_half_up(score), made["a"]))
                start = np.flatnonzero(np.diff(made["a"][order], prepend=-1))
                rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) + 1
                order, rank = order[rank <= top], rank[rank <= top]
            else:
                order = np.lexsort((made["b"], made["a"]))
            ints = {c: pa.array(made[c][order].astype(np.int64 if c in _KINDS_OF else np.int32)) for c in _OVERLAPS}
            yield pa.RecordBatch.from_pydict({"country": _named(names, code[order]), "a": pa.array(made["a"][order]), "b": pa.array(made["b"][order]), **ints, **({"score": pa.array(score[order]), "rank": pa.array(rank.astype(np.int32))} if top else {})})

    return run


def slots_of(n: int) -> int:
    return max(1, n // SLOT_RECORDS)


def candidates(lists: DataFrame, a: DataFrame, cfg: BlockConfig, n: int, key_passes: int, passes: int, made_of: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """(country, a, b, n_keys, fam_mask) with numbers as ids, stored in passes over the a side: all pairs of an a are in one. made_of: what is
    stored of a pass in the place of its pairs."""
    slots = slots_of(n)
    live, out = live_blocks(lists, a, cfg, slots, key_passes), []
    for i in range(passes):
        pairs = _dealt(live.mapInArrow(_pair_blocks(slots, passes, i, True), BLOCK)).mapInArrow(_pair_rows, "country string, a bigint, b bigint, n_keys bigint, fam_mask int")
        out.append(stored(made_of(pairs), "candidates"))
    dropped(live)
    return reduce(DataFrame.unionByName, out)


def true_masks(lists: DataFrame, a: DataFrame, truth: DataFrame, cfg: BlockConfig, n: int, key_passes: int, passes: int) -> DataFrame:
    """(fam_mask, n) of the candidates that are true; of a pass, only these counts are stored."""
    numbered = [F.col(c).rlike(blocking.NUMBERED) for c in ("a_id", "b_id")]
    pairs = stored(truth.where(numbered[0] & numbered[1]).select(*(blocking.id_number(F.col(f"{p}_id")).alias(p) for p in "ab")), "truth")
    made = candidates(lists, a, cfg, n, key_passes, passes, lambda found: found.join(pairs, ["a", "b"]).groupBy("fam_mask").agg(F.count("*").alias("n")))
    dropped(pairs)
    return made.groupBy("fam_mask").agg(F.sum("n").alias("n"))


def _index_rows(caps: np.ndarray) -> Callable:
    """(country, id, key) of the blocks of each slot that are not over their cap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, h, code, ids, of_run, start in _sorted_keys(batches):
            n = np.diff(np.append(start, len(h)))
            good = (n <= caps[_family(h[start], code[start], names.salts())])[of_run]
            h, code = h[good], code[good]
            keys = (h * np.uint64(_BACK) - names.salts()[code]).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"country": _named(names, code), "id": pa.array(ids[good] >> 1), "key": pa.array(keys)})

    return run


def capped_index(b: DataFrame, cfg: BlockConfig, n: int) -> DataFrame:
    """``blocking.capped_index`` of all keys of these records, by one lazy shuffle of blocks."""
    caps = np.array([cfg.cap(f) for f in FAMILIES])
    every = b.withColumns({f"{s}_lone": F.lit(0) for s in SHORTS})  # keys that one side alone can have count too
    keys = _dealt(_keyed(every, 0, cfg).mapInArrow(_key_blocks(cfg, caps, slots_of(n), 1, 0), BLOCK)).mapInArrow(_index_rows(caps), "country string, id bigint, key bigint")
    return keys.select("country", "key", blocking.id_text(F.col("id")).alias("entity_id"), F.shiftrightunsigned("key", 2 * SLOT_BITS).cast("int").alias("fam"))


def overlaps(lists: DataFrame, a: DataFrame, thresholds: DataFrame, cfg: BlockConfig, n: int, key_passes: int, passes: int, top: int = 0, release: Callable[[], None] | None = None) -> DataFrame:
    """``ranking.cheap_features`` of all candidates, stored in passes over the a side. top: of the best ones of each a by the heuristic score,
    with score and rank. release: called when the lists are not read any more."""
    slots = slots_of(n)
    live = live_blocks(lists, a, cfg, slots, key_passes)
    number = blocking.id_number(F.col("entity_id")).alias("id")
    of = lambda df, is_a: df.select(number, F.lit(is_a).alias("is_a"), *(F.col(f"{s}_all").alias(s) for s in SHORTS))
    moved = stored(of(a, True).unionByName(of(lists.where("src > 1"), False)).mapInArrow(_list_blocks(slots, passes), BLOCK), "moved")
    if release:
        release()
    limits = {(r["country"], r["kind"]): tuple(r[f"le_{lv}"] for lv in DF_LEVELS) for r in thresholds.collect()}
    shape, out = ", ".join(["country string, a bigint, b bigint", *(f"{c} {_KINDS_OF.get(c, 'int')}" for c in _OVERLAPS), *(["score double, rank int"] if top else [])]), []
    lists_of = lambda kind: moved.where(F.col("kind") == kind).withColumn("kind", F.lit(1))
    for i in range(passes):
        pairs = _dealt(live.mapInArrow(_pair_blocks(slots, passes, i, False), BLOCK).unionByName(lists_of(0))).mapInArrow(_with_b_lists(slots, passes), BLOCK)
        # the a's lists of this pass: their kinds count slots of all passes
        out.append(stored(_dealt(pairs.unionByName(lists_of(i + 1))).mapInArrow(_overlaps(limits, top), shape), "overlaps"))
    dropped(live)
    dropped(moved)
    return _features(reduce(DataFrame.unionByName, out), top)


def _features(made: DataFrame, top: int) -> DataFrame:
    """The cheap features of stored overlaps (CF1)."""
    columns = {"n_keys": F.col("n_keys"), "fam_mask": F.col("fam_mask")}
    for s in SHORTS:
        n, la, lb = (F.col(f"{s}_{k}") for k in ("inter", "alen", "blen"))
        shorter, union = F.least(la, lb), la + lb - n
        columns |= {
            f"{s}_jac": F.when(union > 0, n / union).otherwise(F.lit(0.0)), f"{s}_cont": F.when(shorter > 0, n / shorter).otherwise(F.lit(0.0)), f"{s}_minid": F.log1p(F.col(f"{s}_least").cast("double")),
            **{f"{s}_{k}": F.col(f"{s}_{k}") for k in ("inter", "alen", "blen", *(f"r{i}" for i in range(ranking.levels_of(s))))},
        }
    ids = [blocking.id_text(F.col(p)).alias(f"{p}_id") for p in "ab"]
    return made.select("country", *ids, *(columns[c].alias(c) for c in ranking.CHEAP_FEATURES), *(["score", "rank"] if top else []))
