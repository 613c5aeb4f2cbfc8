"""SpotSigs fingerprints.

A common word (of the four languages below), a line break or a bar anchors a spot; the chain of the next two
content words after the anchor, common words skipped, is its signature. A text's fingerprint is the set of its
spots, held as sorted 32-bit digests in base64. Fingerprints are partitioned by set length: partition k holds sizes
whose logarithm to the base 1 / least lies in [k, k + 1), so sets that are ``least`` alike are in one partition or in
neighbouring ones. They are compared by pruned Jaccard: sets of partitions further apart, and sets whose sizes alone
keep them below ``least``, are never intersected; what is left is exact.

``similar_pairs`` finds all pairs of a table from a likeness on: records are partitioned by set length (a record
meets its own and the next shorter partition only), joined on the rarest spots (the prefix that any pair that is
similar enough must share) and verified on whole sets.

``edited_neighbours`` compares its fixed pairs the same way, with the low limit ``LEAST``, so that only a likeness that
the lengths alone show to be below it is given as 0. It holds each text against an edited copy (its second half replaced by the start of the next
text) and against the next text. Texts are dealt into id ranges of bounded size and sorted; the first text of a
range is also handed to the range before it, so each pair meets in one task and each text is shuffled once.

Defined results: a null text counts as empty. A text without an anchor that two content words follow takes every
word as an anchor; with a single word that word is the spot, and without words the stripped text itself. A text
without anything has the empty fingerprint: likeness 1 to another empty one, 0 to any other. Rows are ordered by
id (nulls first), then by a hash of the text; repeated rows stay apart. A single row is its own next one. An empty
table gives an empty result. Other columns, of any name, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
COMMON = frozenset(
    """
    a an and are as at be been but by can for from had has have he her his if in into is it its no not of on or our
    she so than that the their then there they this to was we were what when which who will with would you
    à au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas pour plus
    que qui se ses si son sont sur tu un une vous
    aber als auch auf aus bei das dass dem den der die ein eine einem einen einer er es für hat ich im ist mit nach
    nicht nur oder sein sich sie sind über um und von vor war werden wie wir wird zu zum zur
    al como con del desde el entre era esta este ha hay las lo los más me muy nos o para pero por sin sobre su sus
    también y ya yo
    \n |
    """.replace("\n", " ").split()
) | {"\n"}
_TOKENS = re.compile(r"[^\W_]+|[\n|]")
CHAIN = 2
#: Likenesses of fixed pairs below this are given as 0 where the set lengths show it.
LEAST = 0.05
#: Ranges of ids; their first rows travel in a broadcast of three integers each.
RANGE_BYTES, MOST_RANGES = 8 << 20, 1 << 16


def spots(text: str) -> set[str]:
    words: list[str] = []
    anchors: list[tuple[str, int]] = [("\n", 0)]
    for t in _TOKENS.findall(text.lower()):
        if t in COMMON:
            anchors.append((t, len(words)))
        else:
            words.append(t)
    last = len(words) - CHAIN
    found = {f"{t}:{words[k]}:{words[k + 1]}" for t, k in anchors if k <= last}
    if found:
        return found
    if len(words) > 1:
        return {f":{a}:{b}" for a, b in zip(words, words[1:], strict=False)}
    rest = words or [t for t, _ in anchors if t.isalpha()] or [text.strip()]
    return {f":{t}:" for t in rest if t}


def fingerprint(text: str) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(s.encode("utf-8", "surrogatepass")) for s in spots(text)), dtype=np.uint32))


def as_string(prints: np.ndarray) -> str:
    return base64.b64encode(prints.astype("<u4").tobytes()).decode()


def length_partition(n: int, least: float) -> int:
    return int(np.floor(np.log(n) / np.log(1 / least) + 1e-12)) if least < 1 else n


def likeness(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Jaccard of two sorted sets; 0 where the partitions or the sizes show that it stays below ``least``."""
    if not len(a) and not len(b):
        return 1.0
    small, large = sorted((len(a), len(b)))
    if not small or abs(length_partition(small, least) - length_partition(large, least)) > 1 or small < least * large:
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (small + large - shared)


def edited(text: str, following: str) -> str:
    keep = len(text) - len(text) // 2
    return text[:keep] + following[: len(text) // 2]


def edited_neighbours(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    ranges = int(min(MOST_RANGES, max(1, total // RANGE_BYTES)))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx("id", F.array(*map(F.lit, steps)), 20 * max(500, ranges))).first()[0] if steps else []
    edges = np.array(sorted({*(cuts or [])}))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right").astype("int32"))

    # the ranges' first rows: at most MOST_RANGES, read from the id and hash columns alone
    lowest = F.lit(int(edges[0]) - 1 if len(edges) else 0).cast(kind)  # nulls come first
    keyed = docs.withColumn("r", range_of(F.coalesce("id", lowest)))
    firsts = sorted((tuple(x) for x in keyed.groupBy("r").agg(F.min(F.struct("id", "h")).alias("m")).select("r", "m.id", "m.h").collect()), key=lambda x: x[0])
    numbers = [x[0] for x in firsts]
    before = [(r, i, h, numbers[k - 1]) for k, (r, i, h) in enumerate(firsts)]
    heads = df.sparkSession.createDataFrame(before, f"r int, head_id {kind}, head_h long, prior int")
    own = F.struct(F.col("r").alias("part"), F.lit(0).alias("tail"))
    also = F.struct(F.col("prior").alias("part"), F.lit(1).alias("tail"))
    is_head = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    dealt = keyed.join(F.broadcast(heads), "r").select("id", "text", "h", F.explode(F.when(is_head, F.array(own, also)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("id", "text", "h", "to.part", "to.tail").repartition(max(1, len(numbers)), "part").sortWithinPartitions("part", "tail", "id", "h")
    out = f"{id_col} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior: tuple | None = None  # id, text, prints, range
        closed = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[list] = [[] for _ in range(7)]
                for i, text, where, tail in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    if tail and closed == where:
                        continue  # a repeated first row: one stands after the range's last
                    prints = fingerprint(text)
                    if prior is not None and prior[3] == where:
                        changed = edited(prior[1], text)
                        after = prior[2] if changed == prior[1] else fingerprint(changed)
                        values = (prior[0], len(prior[1]), hashlib.sha256(changed.encode()).hexdigest(), as_string(prior[2]), as_string(after), likeness(prior[2], after), likeness(prior[2], prints))
                        for column, value in zip(rows, values, strict=True):
                            column.append(value)
                    prior = None if tail else (i, text, prints, where)
                    closed = where if tail else closed
                types = [part.column(0).type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
                names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    return dealt.mapInArrow(run, out)


def spot_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and ``prints``, the sorted digests of the text's spots."""

    @F.pandas_udf("array<long>")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t or "").astype(np.int64) for t in texts])

    return df.select(F.col(id_col).alias("id"), prints(F.col(text_col)).alias("prints"))


def _partition_column(n: Column, least: float) -> Column:
    """length_partition as a column."""
    return F.floor(F.log(n) / F.lit(float(np.log(1 / least))) + F.lit(1e-12)) if least < 1 else n.cast("long")


def similar_pairs(sets: DataFrame, least: float = 0.75) -> DataFrame:
    """Pairs (a, b, likeness) of ids, a < b, from ``least`` on; ``sets`` has unique ids and ``prints``."""
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    sized = sets.where(F.size("prints") > 0).withColumn("n", F.size("prints"))
    counts = sized.select(F.explode("prints").alias("p")).groupBy("p").agg(F.count("*").alias("f"))
    step = _partition_column(F.col("n"), least)
    ranked = sized.select("id", "n", F.explode("prints").alias("p")).join(counts, "p")
    heads = ranked.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "p"))).alias("o"))
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1
    heads = heads.select("id", "n", step.alias("k"), F.explode(F.transform(F.slice("o", 1, keep.cast("int")), lambda x: x["p"])).alias("p"))
    left = heads.select(F.col("id").alias("a"), F.col("n").alias("na"), "p", F.col("k"))
    right = heads.select(F.col("id").alias("b"), F.col("n").alias("nb"), "p", F.explode(F.array(F.col("k"), F.col("k") - 1)).alias("k"))
    near = left.join(right, ["p", "k"]).where((F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(least) - 1e-9) & (F.col("a") != F.col("b")))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    whole = near.join(sized.select(F.col("id").alias("a"), F.col("prints").alias("pa")), "a").join(sized.select(F.col("id").alias("b"), F.col("prints").alias("pb")), "b")
    shared = F.size(F.array_intersect("pa", "pb"))
    return whole.select("a", "b", (shared / (F.size("pa") + F.size("pb") - shared)).alias("likeness")).where(F.col("likeness") >= F.lit(least) - 1e-12)
