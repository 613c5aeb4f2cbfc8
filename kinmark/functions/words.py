"""Tokens of normalised texts for whole batches (TX6-TX9): what a word is worth is worked out once for each different
word of a batch; records hold places in that list. Gives the tokens of ``kinmark.functions.text.with_views``."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kinmark.functions.text import ADDRESS_WORDS, LEGAL_FORMS

_DIGITS = re.compile("[0-9]+")
_NO_NAME, _NO_ADDRESS = frozenset(("", *LEGAL_FORMS)), frozenset(ADDRESS_WORDS)


def _address_word(w: str) -> bool:
    return len(w) >= 2 and w not in _NO_ADDRESS and not _DIGITS.fullmatch(w)


class Tokens:
    """words: different tokens, ascending; rows and places: the record and the word of each token."""

    def __init__(self, words: list[str], rows: np.ndarray, places: np.ndarray, n: int):
        self.words, self.rows, self.places, self.n = words, rows, places, n

    def lists(self) -> pa.ListArray:
        return listed(self.rows, pa.array(self.words, pa.string()).take(pa.array(self.places)), self.n)

    def once(self) -> Tokens:
        """Each record's different tokens, ascending."""
        size = max(1, len(self.words))
        both = np.unique(self.rows * size + self.places)
        return Tokens(self.words, both // size, both % size, self.n)


def listed(rows: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """Values by ascending row as one list for each of n rows."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _split(texts: pa.Array) -> Tokens:
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), " ")
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return Tokens([words[i] for i in order], rows, rank[coded.indices.to_numpy(zero_copy_only=False)], len(texts))


def _only(t: Tokens, good: list[bool]) -> Tokens:
    keep = np.array(good, bool)[t.places] if len(t.places) else np.zeros(0, bool)
    return Tokens(t.words, t.rows[keep], t.places[keep], t.n)


def _numbers(t: Tokens) -> Tokens:
    """The digit runs of all words without leading zeros."""
    runs = [[d for d in (x.lstrip("0") for x in _DIGITS.findall(w)) if d] for w in t.words]
    words = sorted({d for r in runs for d in r})
    place = {d: i for i, d in enumerate(words)}
    count = np.array([len(r) for r in runs], np.int64)
    start, flat = np.concatenate([[0], np.cumsum(count)]), np.array([place[d] for r in runs for d in r], np.int64)
    times = count[t.places]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return Tokens(words, np.repeat(t.rows, times), flat[np.repeat(start[t.places], times) + nth], t.n)


def tokens_of(names: pa.Array, addresses: pa.Array) -> tuple[dict[str, Tokens], Tokens]:
    """The different tokens of each kind, and all content words of the names in their order."""
    name, address = _split(names), _split(addresses)
    content = _only(name, [w not in _NO_NAME for w in name.words])
    return {"addr": _only(address, [_address_word(w) for w in address.words]).once(), "name": content.once(), "num": _numbers(address).once()}, content


def hashed_keys(found: dict[str, Tokens], content: Tokens) -> dict[str, pa.Array]:
    """The keys of the families NK, AK and NS (K10-K12) without the family's bits."""

    def of(texts: pa.Array, good: np.ndarray) -> pa.Array:
        return pa.array([int(hashlib.md5(t.encode()).hexdigest()[:14], 16) if g else None for t, g in zip(texts.to_pylist(), good.tolist(), strict=True)], pa.int64())

    lists = {k: t.lists() for k, t in found.items()}
    name, spaceless = pc.binary_join(lists["name"], " "), pc.binary_join(content.lists(), "")
    address = pc.binary_join_element_wise(pc.binary_join(lists["addr"], " "), pc.binary_join(lists["num"], " "), " # ")
    long = lambda t, n: pc.utf8_length(t).to_numpy(zero_copy_only=False) >= n
    return {"NK": of(name, long(name, 3)), "AK": of(address, np.bincount(found["addr"].rows, minlength=content.n) >= 2), "NS": of(spaceless, long(spaceless, 6))}
