"""Byte-pair encoding and decoding with a vocabulary file of the public ``tokenizers`` library.

A piece of text becomes a doubly linked list of symbols (two integer arrays for the neighbours). All adjacent
pairs with a merge rank wait in a priority queue; the smallest rank (leftmost first) is taken, an entry whose
symbols have changed since is stale and skipped, and each merge links its new neighbours and queues the pairs it
creates. Decoding looks every id up in the vocabulary and concatenates the strings.

Pieces repeat, so each worker keeps the ids of pieces (two generations of ``PIECES_KEPT``) and of blank-free runs
of text (``CHUNKS_KEPT``) that it has met; how much is kept changes time but no result.

Defined results: a null text is encoded like an empty one (no ids, empty decoded text). Texts of any length are
encoded whole. Repeated rows give repeated results; an empty table gives an empty result. Other columns, of any
name, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kinmark.llm._common import schema_of

PIECES_KEPT, CHUNKS_KEPT = 250_000, 150_000
#: Ranges of code points that `regex` takes for letters or digits and the public library, whose
#: Unicode version is older, does not.
NOT_LETTERS = """
    558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1
    ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11df1-11df1 16ea0-16eb8 16ebb-16ed3
    16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6
    1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff
    2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
NOT_DIGITS = "11de0-11de9 1246f-1246f 12475-1247f 12550-12686 16ff4-16ff6"
#: str.split() parts at these as well; the vocabulary's pattern does not.
_CONTROLS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow from 256."""
    stays = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in stays else chr(next(others)) for b in range(256)]


def _ranges(text: str) -> str:
    return "".join("-".join(f"\\U{int(c, 16):08x}" for c in r.split("-")) for r in text.split())


class MergeBPE:
    """Encoder and decoder for a ``tokenizers`` JSON file with NFC, white-space and lower-case normalisers, a
    Split pre-tokenizer, byte-level letters and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError(f"{path}: not a vocabulary of the supported kind")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for kind, without in (("\\p{L}", NOT_LETTERS), ("\\p{N}", NOT_DIGITS)):
            pattern = pattern.replace(kind, f"[{kind}--[{_ranges(without)}]]")
        self.piece = regex.compile(pattern, regex.VERSION1)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.met: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece."""
        text, suffix, vocab, ranks = piece.encode(), self.suffix, self.vocab, self.ranks
        letters = [self.letters[b] for b in text]
        letters[-1] += suffix
        ids = [vocab[s] for s in letters]
        n = len(ids)
        if n == 1:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # (rank, place, left id, right id, merged id): the ids tell a stale entry
        queue = [(hit[0], i, a, b, hit[1]) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (hit := ranks.get((a, b)))]
        heapq.heapify(queue)
        while queue:
            _, left, a, b, made = heapq.heappop(queue)
            right = after[left]
            if ids[left] != a or right < 0 or ids[right] != b:
                continue  # stale: one of the two symbols was merged meanwhile
            ids[left], ids[right] = made, -1
            after[left] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = left
                if hit := ranks.get((made, ids[beyond])):
                    heapq.heappush(queue, (hit[0], left, made, ids[beyond], hit[1]))
            if (prior := before[left]) >= 0 and (hit := ranks.get((ids[prior], made))):
                heapq.heappush(queue, (hit[0], prior, ids[prior], made, hit[1]))
        return [i for i in ids if i >= 0]

    def chunk(self, chunk: str) -> bytes:
        """Packed ids of a run of text without blanks."""
        packed, known = b"", self.pieces
        for piece in (chunk,) if chunk.isalpha() and chunk.isascii() else self.piece.findall(chunk):
            if (ids := known.get(piece)) is None:
                if (ids := self.older.get(piece)) is None:
                    merged = self.merge(piece)
                    ids = pack(f"<{len(merged)}I", *merged)
                if len(known) >= PIECES_KEPT:
                    self.older, known = known, {}
                    self.pieces = known
                known[piece] = ids
            packed += ids
        if len(self.met) >= CHUNKS_KEPT:
            self.met.clear()
        self.met[chunk] = packed
        return packed

    def plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text)
        # each character is lower-cased on its own: a final capital sigma becomes the ordinary small one
        text = text.replace("Σ", "σ").lower()
        met, chunk = self.met.get, self.chunk
        chunks = filter(None, _WHITE.split(text)) if _CONTROLS.search(text) else text.split()
        return b"".join([met(c) or chunk(c) for c in chunks])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.apart is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.apart.split(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special else self.plain(p) for p in parts if p)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


_OPEN: dict[str, MergeBPE] = {}


def vocabulary(path: str) -> MergeBPE:
    """The vocabulary of a file, read once in each worker."""
    if path not in _OPEN:
        _OPEN[path] = MergeBPE(path)
    return _OPEN[path]


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocab_path: str, digests_only: bool = False) -> DataFrame:
    """Per row: the id, ``n_tokens``, and either ``ids`` (array<int>) with ``decoded``, or their SHA-256
    (``ids_sha256`` of the packed ids, ``decoded_sha256`` of the UTF-8 text), made where the texts are."""
    kind = df.schema[id_col].dataType.simpleString()
    extra = "ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts, first, second = [], [], []
                for text in part.column(1).to_pylist():
                    packed = bpe.encode(text or "")
                    ids = np.frombuffer(packed, dtype="<u4").tolist()
                    decoded = bpe.decode(ids)
                    counts.append(len(ids))
                    first.append(hashlib.sha256(packed).hexdigest() if digests_only else ids)
                    second.append(hashlib.sha256(decoded.encode()).hexdigest() if digests_only else decoded)
                schema = schema_of(id=part.column(0).type, n_tokens=pa.int64(), first=pa.string() if digests_only else pa.list_(pa.int32()), second=pa.string())
                arrays = [part.column(0), pa.array(counts, pa.int64()), pa.array(first, schema.field(2).type), pa.array(second, pa.string())]
                names = ["ids_sha256", "decoded_sha256"] if digests_only else ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_tokens", *names])

    out = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, {extra}")
    return out.withColumnRenamed("id", id_col)
