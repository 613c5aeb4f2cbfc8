"""MinHash near-duplicate detection with an LSH forest, confirmed on whole shingle sets.

1. Every text becomes the set of its 5-word shingles (64-bit hashes) and a MinHash signature; equal sets are
   collapsed to the one with the smallest id before anything else.
2. The forest: each tree is one order of the signatures, its own hash values compared in turn. All trees are
   sorted at once by range (so no region, however frequent its prefix, meets in one task). The longest common prefix
   of two rows is the least of the neighbours' between them, so a row is held against the rows after it while they
   share a value, up to ``REGION`` of them. The depth follows the region: one of at most ``REGION`` rows is covered
   whole at depth one; in a larger one the rows with the longest common prefixes come first, and the depth is the
   one at which the region fits. Pairs whose short sketches do not rule the similarity out are candidates, except
   those that nearer candidates connect already: they are in one cluster anyhow, and step 3 looks at all of it.
3. Candidates are grouped into clusters. A cluster's sets are brought together once, in blocks of bounded size, and
   links are confirmed exactly with integers: the candidates first, then all pairs of the block that are not
   connected and share one of their rarest shingles, at places that leave enough in common. Candidates across the blocks of a large cluster are confirmed
   in rounds: each component tests its most alike partners first, and pairs connected meanwhile drop out.
4. What a cluster of several blocks still lacks has an end outside its largest component. Those sets are joined with
   all sets of the cluster on their rarest shingles (the necessary prefix, with the length bound) and verified on
   whole sets. So no link inside a cluster, of whatever size, depends on luck.
5. Components of the confirmed links give each document the smallest id that it reaches.

A link is missed only if its ends are in different clusters. The sketch test lies five standard deviations below the
similarity asked for; in regions that the window covers a pair at the threshold shares a first value in one of
``TREES`` orders but for about one in 10^12. No candidate is dropped for its number.

Defined results: null and empty texts have the empty set and are linked with nothing. A text of fewer than five
words is one shingle. Rows with a null id are not linked: they keep a null component and are kept. Rows that
share an id count as one document. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmark.llm._common import arrow_limits, stored
from kinmark.llm.components import Forest, components

TREES, DEPTH, SKETCH, REGION = 20, 6, 64, 32
#: A cluster is confirmed in one block up to so many shingles (8 bytes each), beyond in blocks of so many texts.
SMALL_CLUSTER, BLOCK = 2_000_000, 128
#: Partners that each component tests in a round across blocks; whatever is left then is found by ``completed``.
ROUNDS = (1, 1, 4)
#: Up to so many ids (8 bytes each) choose the texts that are shuffled by a broadcast; beyond, all texts are.
FEW_IDS = 1_000_000
WORDS_KEPT = 300_000
_M = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int):
        self.width = width
        self.met: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        if len(self.met) >= WORDS_KEPT:
            self.met.clear()
        self.met[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        hashes = list(map(self.met.get, words))
        if None in hashes:
            hashes = [self.word(w) if h is None else h for h, w in zip(hashes, words, strict=True)]
        w = np.array(hashes, dtype=np.uint64)
        size = min(n, self.width)
        acc = np.full(n - size + 1, np.uint64(size))
        for j in range(size):
            acc = _mixed(acc * _M + w[j : n - size + 1 + j])
        return np.unique(acc)


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima, one for each multiplicative hash function."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 256):
        np.minimum(least, np.multiply.outer(shingles[lo : lo + 256], _FACTORS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(">u4")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """id, n (set size), digest of the set, and the packed signature (null for the empty set)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(width)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sizes, digests, packed = [], [], []
                for text in part.column(1).to_pylist():
                    s = cut(text or "")
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    packed.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["id", "n", "digest", "sig"])

    return docs.mapInArrow(run, f"id {kind}, n long, digest binary, sig binary")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            n = part.num_rows
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8).reshape(n, TREES, DEPTH * 4)
            whole = sig.reshape(n, TREES * DEPTH, 4)
            # the last byte of every other value, spread over the trees
            sketch = whole[:, np.linspace(0, TREES * DEPTH - 1, SKETCH).astype(int), 3]
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), TREES)
            flat = lambda x, w: pa.Array.from_buffers(pa.binary(w), n * TREES, [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), flat(sig, DEPTH * 4), pa.array(ids), flat(np.repeat(sketch, TREES, axis=0), SKETCH)], names=["tree", "key", "id", "sketch"])


_FOUND = "kind int, a long, b long, est double, tree int, key binary, sketch binary, part int, pos long"


def _neighbours(percent: int, edges_only: bool):
    """Candidates among neighbours of a sorted stream. With edges_only the stream holds the ends of earlier
    parts, and only pairs of different parts count."""
    least = percent / 100 - 5 * np.sqrt(percent / 100 * (1 - percent / 100) / SKETCH)

    def pairs(tree, key, ids, sketch, part, fresh):
        """Pairs whose later row is not one of the carried rows, as (a, b, est)."""
        n = len(ids)
        values = key.view(">u4")
        alike = (values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None]
        lcp = np.where(alike.all(axis=1), DEPTH, alike.argmin(axis=1))  # of each row and the next one
        shared, out = lcp, []
        group = np.arange(n)  # rows that candidates connect already have one number
        for w in range(1, min(REGION, n - 1) + 1):
            shared = lcp if w == 1 else np.minimum(shared[:-1], lcp[w - 1 :])
            at = np.flatnonzero(shared)
            if not len(at):
                break  # every region is covered
            at = at[group[at] != group[at + w]]
            if edges_only:
                at = at[part[at + w] != part[at]]
            est = (sketch[at] == sketch[at + w]).mean(axis=1)
            at, est = at[est >= least], est[est >= least]
            if w == 1 and not edges_only:
                joined = np.zeros(n, bool)
                joined[at + 1] = True
                group = np.cumsum(~joined)
            elif len(at):
                forest = Forest()
                fresh_links = np.fromiter(map(forest.join, group[at].tolist(), group[at + w].tolist()), bool, len(at))
                at, est = at[fresh_links], est[fresh_links]
                renamed = np.arange(group.max() + 1)
                for x in forest.up:
                    renamed[x] = forest.root(x)
                group = renamed[group]
            new = at + w >= fresh
            at, est = at[new], est[new]
            out.append((np.minimum(ids[at], ids[at + w]), np.maximum(ids[at], ids[at + w]), est))
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        carried: list[np.ndarray] | None = None
        seen = 0

        def rows(kind, a, b, est, tree=None, key=None, sketch=None, pos=None):
            n = len(a)
            null = lambda t: pa.nulls(n, t)
            blob = lambda x: null(pa.binary()) if x is None else pa.array([r.tobytes() for r in x], pa.binary())
            whole = lambda x, t: null(t) if x is None else pa.array(x, t)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a, pa.int64()), whole(b, pa.int64()), whole(est, pa.float64()), whole(tree, pa.int32()), blob(key), blob(sketch), pa.array(np.full(n, number, np.int32)), whole(pos, pa.int64())], names=[x.split()[0] for x in _FOUND.split(", ")])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fixed = lambda k, w: np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(n, w)  # noqa: E731, B023
            part = batch.column(4).to_numpy() if edges_only else np.zeros(n, np.int32)
            now = [batch.column(0).to_numpy(), fixed(1, DEPTH * 4), batch.column(2).to_numpy(), fixed(3, SKETCH), part]
            if not edges_only and not seen:
                yield rows(1, now[2][:REGION], None, None, now[0][:REGION], now[1][:REGION], now[3][:REGION])
            if not edges_only and (first := np.flatnonzero(now[0] == 0)).size:
                yield rows(2, now[2][first], None, None, pos=seen + first)
            seen += n
            fresh = len(carried[2]) if carried else 0
            joined = [np.concatenate(x) for x in zip(carried, now, strict=True)] if carried else now
            yield rows(0, *pairs(*joined, fresh))
            carried = [x[-REGION:] for x in joined]
        if carried and not edges_only:
            yield rows(1, carried[2], None, None, carried[0], carried[1], carried[3])

    return run


def candidates(reps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, est) pairs of ids, and (id, part, pos), the place of each id in the first tree's order."""
    spark = reps.sparkSession
    rows = reps.select("id", "sig").mapInArrow(_trees, "tree int, key binary, id long, sketch binary")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(width, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = stored(ordered.mapInArrow(_neighbours(percent, False), _FOUND), "forest")
    # the ends of the parts: 2 * REGION rows of each, a number that follows the parts and not the rows
    ends = found.where("kind = 1").select("tree", "key", F.col("a").alias("id"), "sketch", "part").distinct().coalesce(1).sortWithinPartitions("tree", "key", "id")
    across = ends.mapInArrow(_neighbours(percent, True), _FOUND).where("kind = 0")
    pairs = found.where("kind = 0").select("a", "b", "est").union(across.select("a", "b", "est"))
    pairs = pairs.groupBy("a", "b").agg(F.max("est").alias("est"))
    return pairs, found.where("kind = 2").select(F.col("a").alias("id"), "part", "pos")


def _confirm(width: int, percent: int):
    """Rows (block, id, set, partners), sorted by block: the confirmed links that connect what a block can."""

    def rarest(s: np.ndarray, seen: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The necessary prefix of a set by rarity, without shingles that no other set has, and its places."""
        f = counts[np.searchsorted(seen, s)]
        order = np.lexsort((s, f))[: len(s) - -(-percent * len(s) // 100) + 1]
        places = np.flatnonzero(f[order] > 1)
        return s[order][places], places

    def settle(rows: list[tuple[int, np.ndarray, list[int]]]) -> list[tuple[int, int]]:
        sets = {r[0]: r[1] for r in rows}
        forest, links = Forest(), []

        def test(a: int, b: int) -> None:
            if forest.root(a) != forest.root(b) and similar(sets[a], sets[b], percent):
                forest.join(a, b)
                links.append((a, b))

        for a, _, partners in rows:
            for b in partners:
                if b in sets:
                    test(a, b)
        roots = Counter(map(forest.root, sets))
        if len(roots) < 2 or (len(sets) < 3 and any(r[2] for r in rows)):
            return links
        # whatever the forest's order has not put side by side: two similar sets share one of their rarest shingles,
        # and of two sets that are not connected yet one lies outside the largest component
        largest = max(roots, key=lambda r: (roots[r], -r))
        ids = np.array(sorted(sets), dtype=np.int64)
        sizes = np.array([len(sets[i]) for i in ids.tolist()])
        seen, counts = np.unique(np.concatenate([*sets.values()]), return_counts=True)
        prefixes = [rarest(sets[i], seen, counts) for i in ids.tolist()]
        owners = np.repeat(np.arange(len(ids)), [len(x) for x, _ in prefixes])
        shingles, places = (np.concatenate(x) for x in zip(*prefixes, strict=True))
        order = np.argsort(shingles, kind="stable")
        shingles, owners, places = shingles[order], owners[order], places[order]
        for k, i in enumerate(ids.tolist()):
            own, at = prefixes[k]
            if forest.root(i) == largest or not len(own):
                continue
            lo, hi = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
            met = np.concatenate([np.arange(x, y) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
            near = owners[met]
            # from a pair's first common shingle on, no more can be shared than the shorter rest has
            most = np.minimum(sizes[k] - np.repeat(at, hi - lo), sizes[near] - places[met])
            for j in ids[np.unique(near[most * (100 + percent) >= percent * (sizes[k] + sizes[near])])].tolist():
                test(i, j)
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, list[int]]] = []
        now = None
        links: list[tuple[int, int]] = []
        emit = lambda: pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])
        for batch in batches:
            for block, i, packed, partners in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if block != now:
                    links += settle(held)
                    held, now = [], block
                held.append((i, np.frombuffer(packed, dtype=np.uint64), partners or []))
            yield emit()
            links = []
        links = settle(held)
        yield emit()

    return run


def _sets(width: int, listed: bool = False):
    """(block, id, text, partners) to (block, id, packed set, partners), or to (id, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(width)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [cut(t or "") for t in part.column(2).to_pylist()]
                if listed:
                    yield pa.RecordBatch.from_arrays([part.column(1), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "shingles"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([s.tobytes() for s in sets], pa.binary()), part.column(3)], names=["block", "id", "set", "partners"])

    return run


def confirmed(docs: DataFrame, wanted: DataFrame, width: int, percent: int) -> DataFrame:
    """wanted: (id, block, partners), a row for each block that an id's set is needed in. Links (a, b)."""
    kind = "block string, id long, set binary, partners array<long>"
    ids = wanted.select("id").distinct()
    if ids.count() <= FEW_IDS:
        docs = docs.join(F.broadcast(ids), "id", "left_semi")
    sets = wanted.join(docs, "id").select("block", "id", "text", "partners").mapInArrow(_sets(width), kind)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.repartition(n, "block").sortWithinPartitions("block", "id").mapInArrow(_confirm(width, percent), "a long, b long")


def completed(docs: DataFrame, members: DataFrame, roots: DataFrame, width: int, percent: int) -> DataFrame:
    """members: (id, cluster, n). The links (a, b) between sets of a cluster that ``roots`` does not connect.

    A link that is still missing has an end outside the cluster's largest component. With a cluster's shingles ordered
    by rarity, two similar sets share one of the first n - ceil(n * percent / 100) + 1 shingles of either; so the
    prefixes of the sets outside are joined with those of all sets of the cluster (an equi-join, whose frequent keys
    adaptive execution splits), and pairs whose sizes and places leave enough in common are verified on whole sets."""
    known = stored(members.join(roots, "id", "left").select("id", "cluster", "n", F.coalesce("root", "id").alias("known")), "known")
    counts = known.groupBy("cluster", "known").agg(F.count("*").alias("c"))
    main = counts.groupBy("cluster").agg(F.max(F.struct("c", (-F.col("known")).alias("k"))).alias("m"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select("cluster", (-F.col("m.k")).alias("main"))
    known = known.join(main, "cluster").select("id", "cluster", "n", "known", (F.col("known") != F.col("main")).alias("outer"))
    ids = known.select("id", F.lit("").alias("block"), F.lit(None).cast("array<long>").alias("partners"))
    texts = ids.join(docs, "id").select("block", "id", "text", "partners").dropDuplicates(["id"])
    sets = stored(known.join(texts.mapInArrow(_sets(width, listed=True), "id long, shingles array<long>"), "id"), "whole")
    each = sets.select("id", "cluster", F.explode("shingles").alias("x"))
    rarity = each.groupBy("cluster", "x").agg(F.count("*").alias("f"))
    ordered = each.join(rarity, ["cluster", "x"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("o"))
    n = F.size("o")
    prefix = ordered.select("id", F.posexplode(F.slice("o", F.lit(1), (n - F.ceil(n * percent / 100) + 1).cast("int"))).alias("at", "o")).where("o.f > 1")
    prefix = stored(prefix.join(known, "id").select("id", "cluster", "n", "known", "outer", "at", F.col("o.x").alias("x")), "prefixes")
    side = lambda p: prefix.select("cluster", "x", *(F.col(c).alias(f"{p}_{c}") for c in ("id", "n", "known", "outer", "at")))
    # from a pair's first common shingle on, no more can be shared than the shorter rest has
    most = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    fits = (F.col("a_known") != F.col("b_known")) & (most * (100 + percent) >= percent * (F.col("a_n") + F.col("b_n")))
    once = ~F.col("b_outer") | (F.col("a_id") < F.col("b_id"))  # two sets outside meet from both sides
    pairs = side("a").where("a_outer").join(side("b"), ["cluster", "x"]).where(fits & once).select("a_id", "b_id").distinct()
    whole = lambda p: sets.select(F.col("id").alias(f"{p}_id"), F.col("shingles").alias(p))
    both = pairs.join(whole("a"), "a_id").join(whole("b"), "b_id")
    shared = F.size(F.array_intersect("a", "b"))
    linked = both.where(100 * shared >= percent * (F.size("a") + F.size("b") - shared))
    return linked.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def near_components(df: DataFrame, id_col: str, text_col: str, percent: int = 75, width: int = 5) -> DataFrame:
    """Per row: the id, n_shingles, component_id, kept."""
    spark = df.sparkSession
    arrow_limits(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = stored(sketches(docs, width), "sketches")
    classes = base.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.min("sig").alias("sig"), F.min("n").alias("n"))
    pairs, places = candidates(classes, percent)
    pairs, places = stored(pairs, "pairs"), places
    clusters = components(pairs)
    sizes = clusters.join(classes.select("id", "n"), "id").groupBy("root").agg(F.sum("n").alias("size"))
    small = F.concat(F.lit("c"), F.col("root"))
    large = F.concat_ws("-", F.lit("p"), "root", "part", F.floor(F.col("pos") / BLOCK))
    members = clusters.join(sizes.where(F.col("size") > SMALL_CLUSTER), "root").join(classes.select("id", "n"), "id").select("id", F.col("root").alias("cluster"), "n")
    homes = clusters.join(sizes, "root").join(places, "id", "left").select("id", F.when(F.col("size") <= SMALL_CLUSTER, small).otherwise(large).alias("block"))
    homes = stored(homes, "blocks")
    placed = pairs.join(homes.select(F.col("id").alias("a"), F.col("block").alias("block_a")), "a").join(homes.select(F.col("id").alias("b"), F.col("block").alias("block_b")), "b")
    placed = stored(placed, "placed")
    inside = placed.where("block_a = block_b")
    partners = inside.groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("partners"))
    ends = inside.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = stored(ends.join(homes, "id").join(partners, "id", "left").select("id", "block", "partners"), "wanted")
    # one text for an id, also where rows share it
    texts = docs.where("id is not null")
    links = stored(confirmed(texts, wanted, width, percent), "confirmed")
    roots = stored(components(links), "roots")
    left = placed.where("block_a <> block_b").select("a", "b", "est")
    for most in () if left.isEmpty() else ROUNDS:
        ra, rb = roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        left = left.join(ra, "a", "left").join(rb, "b", "left").withColumn("ra", F.coalesce("ra", "a")).withColumn("rb", F.coalesce("rb", "b")).where("ra <> rb")
        left = stored(left, "left")
        if left.isEmpty():
            break
        ranks = [F.row_number().over(Window.partitionBy(c).orderBy(F.desc("est"), "a", "b")) for c in ("ra", "rb")]
        tops = [left.withColumn("k", r).where(F.col("k") <= most).select("a", "b") for r in ranks]
        tested = tops[0].union(tops[1]).distinct()
        tested = stored(tested.select("a", "b", F.concat_ws("-", "a", "b").alias("block")), "tested")
        one = tested.select(F.col("a").alias("id"), "block", F.array("b").alias("partners"))
        other = tested.select(F.col("b").alias("id"), "block", F.lit(None).cast("array<long>").alias("partners"))
        more = stored(confirmed(texts, one.union(other), width, percent), "confirmed")
        left = left.join(tested.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "est")
        links = links.union(more)
        roots = stored(components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more)), "roots")
    members = stored(members, "members")
    if not members.isEmpty():
        more = stored(completed(texts, members, roots, width, percent), "completed")
        roots = stored(components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more)), "roots")
    return _finish(df, base, classes, roots, id_col)


def _finish(df: DataFrame, base: DataFrame, classes: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    by_set = classes.select("digest", "id").join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("of"))
    out = base.select("id", "n", "digest").join(by_set, "digest", "left")
    root = F.when(F.col("id").isNotNull(), F.coalesce("of", "id"))
    kind = df.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), root.cast(kind).alias("component_id"), F.coalesce(root == F.col("id"), F.lit(True)).alias("kept"))
