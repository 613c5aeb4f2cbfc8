"""URL filter over a sorted digest array.

The rules are laid out as three flat files: 64-bit xxhash keys in ascending order, offsets, and the full
strings. They are shipped to every executor once with ``SparkContext.addFile``; each Python worker maps the
files into memory (pages are shared by all workers of a machine) and probes whole Arrow batches with one
vectorised binary search. A key that is found is confirmed against the stored string, so a digest collision
never changes a verdict.

A rule is ``host + path``: it fits its host and every subdomain when the url's path starts with the rule's
path. The longest fitting rule wins (whole string first, then the host). Without a fitting rule the verdict is
that of the method, a list of exceptions: ``allow``.

Defined results: a null url, an empty one and one without ``://`` have empty host and path and no rule. Repeated
rows give repeated results. Other columns are ignored, whatever their names; an empty table gives an empty
result. Of two equal rules with different verdicts the one listed last holds.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import re
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from kinmark.llm._common import schema_of

_SPLIT = re.compile(r"([^/?#]*)([^?#]*)", re.S)
#: (application, digest of the list) to the stem of its files.
_SENT: dict[tuple[str, str], str] = {}
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    m = _SPLIT.match(url, url.index("://") + 3)
    return m[1].translate(_UPPER), m[2]


class DigestArray:
    """The three files of a rule list, and the probe."""

    def __init__(self, folder: str, stem: str):
        at = lambda kind: os.path.join(folder, f"{stem}.{kind}")
        self.keys = np.memmap(at("keys"), dtype="<u8", mode="r")
        self.starts = np.memmap(at("starts"), dtype="<i8", mode="r")
        self.heap = np.memmap(at("heap"), dtype=np.uint8, mode="r")
        self.lengths = np.fromfile(at("lengths"), dtype="<i4").tolist()

    @staticmethod
    def write(folder: str, rules: Iterable[tuple[str, str, str]]) -> str:
        """rules: (host, path, verdict). Returns the stem of the files, a digest of their content."""
        last = {host.translate(_UPPER) + path: (path, verdict) for host, path, verdict in rules}
        if not last:
            raise ValueError("a rule list needs at least one rule")
        rows = sorted((xxhash.xxh64_intdigest(text), text, *last[text]) for text in last)
        blobs = [f"{len(path)}\0{verdict}\0{text}".encode() for _, text, path, verdict in rows]
        stem = "rules-" + hashlib.sha256(b"\n".join(blobs)).hexdigest()[:24]
        at = lambda kind: os.path.join(folder, f"{stem}.{kind}")
        np.array([r[0] for r in rows], dtype="<u8").tofile(at("keys"))
        np.cumsum([0, *map(len, blobs)]).astype("<i8").tofile(at("starts"))
        np.frombuffer(b"".join(blobs), dtype=np.uint8).tofile(at("heap"))
        np.array(sorted({len(r[2]) for r in rows}), dtype="<i4").tofile(at("lengths"))
        return stem

    def stored(self, i: int) -> tuple[str, int, str]:
        length, verdict, text = bytes(self.heap[self.starts[i] : self.starts[i + 1]]).decode().split("\0", 2)
        return text, int(length), verdict

    def judge(self, urls: list[str | None]) -> tuple[list[str], list[str], list[str | None], list[str | None]]:
        """Hosts, paths, rules and verdicts of one batch; the probe is one searchsorted over all candidates."""
        parts = [split_url(u) for u in urls]
        who: list[int] = []
        text: list[str] = []
        for row, (host, path) in enumerate(parts):
            if not host:
                continue
            labels = host.split(".")
            paths = [path[:n] for n in self.lengths if n <= len(path)]
            for k in range(len(labels)):
                suffix = ".".join(labels[k:])
                text += [suffix + p for p in paths]
                who += [row] * len(paths)
        found: dict[int, tuple[int, int, str, str]] = {}
        if text:
            keys = np.fromiter(map(xxhash.xxh64_intdigest, text), dtype="<u8", count=len(text))
            lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            for c in np.flatnonzero(hi > lo).tolist():
                for i in range(lo[c], hi[c]):
                    rule, n_path, verdict = self.stored(i)
                    host, path = parts[who[c]]
                    own = rule[: len(rule) - n_path]
                    fits = (host == own or host.endswith("." + own)) and path.startswith(rule[len(own) :])
                    if rule == text[c] and fits:
                        best = (len(rule), len(own), rule, verdict)
                        found[who[c]] = max(found.get(who[c], best), best)
        rules = [found[i][2] if i in found else None for i in range(len(parts))]
        verdicts = [found[i][3] if i in found else None for i in range(len(parts))]
        return [p[0] for p in parts], [p[1] for p in parts], rules, verdicts


def ship_rules(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Hand the files of a rule list to every executor through the application's own file server, also to those that
    start later; a list that the application has already is neither written nor sent again."""
    rules = list(rules)
    key = (spark.sparkContext.applicationId, hashlib.sha256(repr(rules).encode()).hexdigest())
    if key not in _SENT:
        folder = tempfile.mkdtemp(prefix="kinmark-rules-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the file server reads it until then
        stem = DigestArray.write(folder, rules)
        if stem not in {s for (app, _), s in _SENT.items() if app == key[0]}:
            for kind in ("keys", "starts", "heap", "lengths"):
                spark.sparkContext.addFile(os.path.abspath(os.path.join(folder, f"{stem}.{kind}")))
        _SENT[key] = stem
    return _SENT[key]


def filter_urls(df: DataFrame, id_col: str, url_col: str, rules: Iterable[tuple[str, str, str]], otherwise: str = "allow") -> DataFrame:
    """One row per input row: the id, host, path, rule (null without one) and verdict."""
    stem = ship_rules(df.sparkSession, rules)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.getRootDirectory(), stem)
        for batch in batches:
            hosts, paths, fit, verdicts = array.judge(batch.column(1).to_pylist())
            verdicts = [v or otherwise for v in verdicts]
            schema = schema_of(id=batch.column(0).type, host=pa.string(), path=pa.string(), rule=pa.string(), verdict=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, fit, verdicts))], schema=schema)

    out = df.select(df[id_col].alias("id"), df[url_col].alias("url")).mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
