"""Vocabulary, blocking keys, index and probe (V1-V4, K1-K13, B1-B7).

All countries go through one plan: the country is part of every key. Token ids are ranks by rarity, so that "the
rarest k" is the head of a sorted list and "rarer than" is an integer comparison. Keys are 64-bit integers, six
bits of family over two 29-bit slots; hash families hold 56 bits of an MD5, which any engine can recompute.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmark.functions.words import Tokens, hashed_keys, listed, tokens_of
from kinmark.session import dropped, stored

SLOT_BITS = 29
FAMILIES = ("AA", "NA", "MA", "MM", "MN", "NK", "AK", "NS")
#: Families of one key made from texts.
HASHED = ("NK", "AK", "NS")
#: kind of token -> (column of tokens, name of the id list)
KINDS = {"addr": ("addr_toks", "at"), "name": ("name_toks", "mt"), "num": ("addr_nums", "an")}
DF_LEVELS = (5, 50, 1000)
#: So many first tokens of a list have their lone bit.
HEADS = 16


@dataclass(frozen=True)
class BlockConfig:
    """How many of the rarest tokens make keys, and how large a block of the b side may be."""

    address_tokens: int = 5
    address_numbers: int = 3
    name_tokens: int = 4
    max_block: int = 60
    max_block_by_family: dict[str, int] = field(default_factory=lambda: {"NK": 3000, "AK": 3000, "NS": 3000})
    families: tuple[str, ...] = FAMILIES
    max_candidates: int = 0
    degenerate_pairs: bool = True

    def cap(self, family: str) -> int:
        return self.max_block_by_family.get(family, self.max_block)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> BlockConfig:
        raw = json.loads(text)
        return BlockConfig(**raw | {"families": tuple(raw["families"])})


def tagged_tokens() -> Column:
    """All distinct tokens of a record with their kind."""

    def of(kind: str, col: str) -> Column:
        return F.transform(F.array_distinct(col), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("tok")))

    return F.flatten(F.array(*(of(kind, col) for kind, (col, _) in KINDS.items())))


def vocabulary(records: DataFrame) -> DataFrame:
    """V1: (country, kind, tok, df, tid), ranked by frequency, then token. A rank is the place among the tokens of
    one frequency and beginning, plus the number of tokens of rarer frequencies or earlier beginnings: a frequency
    that most tokens have (usually 1) is dealt over as many tasks as it has beginnings."""
    # a token of one source alone can't be in a key that both sides have
    sides = [(F.max((F.col("src") == 1).cast("int")) + F.max((F.col("src") > 1).cast("int")) < 2).cast("int").alias("lone")] if "src" in records.columns else []
    df = records.select("country", *(["src"] if sides else []), F.explode(tagged_tokens()).alias("t")).groupBy("country", "t.kind", "t.tok").agg(F.count("*").alias("df"), *sides)
    return with_ranks(df)


def with_ranks(df: DataFrame) -> DataFrame:
    """``vocabulary`` of counted tokens."""
    sides = ["lone"] if "lone" in df.columns else []
    df = df.withColumn("start", F.substring("tok", 1, 3))
    levels = df.groupBy("country", "kind", "df", "start").agg(F.count("*").alias("n"))
    below = Window.partitionBy("country", "kind").orderBy("df", "start").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("country", "kind", "df", "start", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("country", "kind", "df", "start").orderBy("tok")) - 1
    return df.withColumn("place", within).join(levels, ["country", "kind", "df", "start"]).select("country", "kind", "tok", "df", (F.col("base") + F.col("place")).alias("tid"), *sides)


def rarity_thresholds(vocab: DataFrame, levels: tuple[int, ...] = DF_LEVELS) -> DataFrame:
    """V3: (country, kind, le_<level>...): how many tokens have at most that frequency."""
    return vocab.groupBy("country", "kind").agg(*(F.count_if(F.col("df") <= lv).alias(f"le_{lv}") for lv in levels))


def id_lists(records: DataFrame, vocab: DataFrame) -> DataFrame:
    """V2: (country, entity_id, at_all, mt_all, an_all), ids ascending, so the rarest come first."""
    found = records.select("country", "entity_id", F.explode(tagged_tokens()).alias("t")).select("country", "entity_id", "t.*").join(vocab.select("country", "kind", "tok", "tid"), ["country", "kind", "tok"])
    lists = found.groupBy("country", "entity_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("tid")))).alias(f"{short}_all") for kind, (_, short) in KINDS.items()))
    none = F.array().cast("array<bigint>")
    return records.select("country", "entity_id").join(lists, ["country", "entity_id"], "left").select("country", "entity_id", *(F.coalesce(f"{s}_all", none).alias(f"{s}_all") for s in ("at", "mt", "an")))


#: Tokens that each worker holds in memory (16 bytes each): those of the highest frequencies, so many at most.
COMMON = 4_000_000
#: Bit of a record's lone tokens that says that it has any; the bits below stand for the first ones of its list.
ANY_LONE = 1 << 20


def common_from(vocab: DataFrame) -> int:
    """The least power of two so that at most COMMON tokens have that frequency."""
    levels = [1 << i for i in range(63)]
    counts = vocab.agg(*(F.count_if(F.col("df") >= lv).alias(str(lv)) for lv in levels)).first()
    return next(lv for lv, n in zip(levels, counts, strict=True) if n <= COMMON)


#: Records whose words are worked out at once, and records sent back at once.
WORKED, SENT = 100_000, 10_000


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in larger ones: a word is looked at once in each, and counted once for each."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= WORKED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _counted(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """(country, kind, tok, df, in_a, in_b) of a batch of normalised records."""
    found, _ = tokens_of(batch.column("name_norm"), batch.column("addr_norm"))
    countries = batch.column("country").dictionary_encode()
    of_row, names = countries.indices.to_numpy(zero_copy_only=False).astype(np.int64), countries.dictionary
    is_a, parts = batch.column("src").to_numpy(zero_copy_only=False) == 1, []
    for kind, t in found.items():
        size = max(1, len(t.words))
        both, at, n = np.unique(of_row[t.rows] * size + t.places, return_inverse=True, return_counts=True)
        in_a = np.bincount(at, weights=is_a[t.rows], minlength=len(both)).astype(np.int64)
        words = pa.array(t.words, pa.string()).take(pa.array(both % size))
        parts.append(pa.record_batch([names.take(pa.array(both // size)).cast(pa.string()), pa.array([kind] * len(both), pa.string()), words, pa.array(n.astype(np.int64)), pa.array((in_a > 0).astype(np.int32)), pa.array((in_a < n).astype(np.int32))], ["country", "kind", "tok", "df", "in_a", "in_b"]))
    return pa.Table.from_batches(parts).combine_chunks().to_batches()


def vocabulary_of(normed: DataFrame) -> DataFrame:
    """``vocabulary`` of normalised records with src, stored. Tokens are counted by the batch before they are shuffled, and their
    counts are stored, as the ranks read them twice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _large(batches):
            yield from _counted(b)

    parts = normed.where("country is not null").select("src", "country", "name_norm", "addr_norm").mapInArrow(count, "country string, kind string, tok string, df bigint, in_a int, in_b int")
    counts = stored(parts.groupBy("country", "kind", "tok").agg(F.sum("df").alias("df"), (F.max("in_a") + F.max("in_b") < 2).cast("int").alias("lone")), "counts")
    out = stored(with_ranks(counts), "vocabulary")
    dropped(counts)
    return out


def _digests(kind: str, country: str | None, words: list[str], seed: str) -> np.ndarray:
    return hash_array(np.array([f"{kind}:{country}:{w}" for w in words], object), hash_key=seed, categorize=False)


def _lone_bits(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Of each record's list of values: which of the first HEADS tokens are lone, and whether any is."""
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    lone, first = values % 2 == 1, place < HEADS
    heads = np.bincount(rows[lone & first], weights=1 << place[lone & first], minlength=n).astype(np.int32)
    return heads + (np.bincount(rows[lone], minlength=n) > 0).astype(np.int32) * np.int32(ANY_LONE)


def _looked_up(known: tuple[np.ndarray, np.ndarray, str], every: bool, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The id lists and hash keys of a batch of normalised records, and ``rest``: the tokens that are not known, each
    after its kind and a colon. every: the whole vocabulary is known."""
    digests, ids, seed = known
    found, content = tokens_of(batch.column("name_norm"), batch.column("addr_norm"))
    n, countries = batch.num_rows, batch.column("country").dictionary_encode()
    of_row, names = pc.fill_null(countries.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), countries.dictionary.to_pylist()
    made = {c: batch.column(c) for c in ("country", "entity_id", "src")}
    for f, keys in hashed_keys(found, content).items():
        code = FAMILIES.index(f) << (2 * SLOT_BITS)
        made[f"key_{f}"] = pc.add(keys, pa.scalar(code, pa.int64()))
    left, left_rows, seen = [], [], []
    for kind, (_, short) in KINDS.items():
        t, known_country = found[kind], of_row[found[kind].rows] >= 0
        t = Tokens(t.words, t.rows[known_country], t.places[known_country], n)
        size = max(1, len(t.words))
        both, at = np.unique(of_row[t.rows] * size + t.places, return_inverse=True)
        values = np.empty(len(both), np.int64)
        for c, lo, hi in ((c, *np.searchsorted(both, [c * size, (c + 1) * size])) for c in np.unique(both // size).tolist()):
            h = _digests(kind, names[c], [t.words[i] for i in (both[lo:hi] % size).tolist()], seed)
            place = np.searchsorted(digests, h)
            place[place == len(digests)] = 0
            values[lo:hi] = np.where(digests[place] == h, ids[place], -1) if len(digests) else -1
        values = values[at]
        has = values >= 0
        order = np.lexsort((values[has], t.rows[has]))
        rows, values = t.rows[has], values[has][order]
        made[f"{short}_all"], made[f"{short}_lone"] = listed(rows, pa.array(values >> 1), n), pa.array(_lone_bits(rows, values, n))
        if not every:
            lacking = np.bincount(t.rows[~has], minlength=n) > 0
            seen.append((short, rows, values, lacking))
            left.append(pc.binary_join_element_wise(kind, pa.array(t.words, pa.string()).take(pa.array(t.places[~has])), ":"))
            left_rows.append(t.rows[~has])
    if not every:
        rows = np.concatenate(left_rows)
        order = np.argsort(rows, kind="stable")
        made["rest"] = listed(rows[order], pa.concat_arrays(left).take(pa.array(order)), n)
        some = np.any([x[3] for x in seen], axis=0)
        for short, rows, values, _ in seen:
            made[short] = listed(rows[some[rows]], pa.array(values[some[rows]]), n)
    return pa.RecordBatch.from_pydict(made)


def known_tokens(ids: DataFrame) -> tuple[np.ndarray, np.ndarray, str]:
    """Digests (64 bits) of tokens in ascending order, their values, and the seed under which no two digests agree. Digests of
    tokens outside ``ids`` may agree with one of them, see ``linked_lists``."""

    def digest(seed: str) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = np.array(b.column("text").to_pylist(), object)
                yield pa.RecordBatch.from_pydict({"h": pa.array(hash_array(texts, hash_key=seed, categorize=False).view(np.int64)), "v": b.column("v")})

        return run

    for i in range(1000):
        seed = f"{i:016d}"
        table = ids.select(F.concat_ws(":", "kind", "country", "tok").alias("text"), "v").mapInArrow(digest(seed), "h bigint, v bigint").toArrow()
        digests, values = table["h"].to_numpy().view(np.uint64), table["v"].to_numpy()
        order = np.argsort(digests)
        if (np.diff(digests[order]) > 0).all():
            return digests[order], values[order], seed
    raise ValueError("no seed tells the tokens apart")


def linked_lists(normed: DataFrame, vocab: DataFrame) -> DataFrame:
    """``id_lists`` of normalised records with their own (stored) vocabulary, with all that keys are made of: src, the hash
    keys, and which of the first tokens are of one source alone. Tokens are looked up where the record is, by
    digests that are checked to differ. Only of a vocabulary over COMMON tokens, the rarer ones and the records that hold them
    are shuffled: there, a token counts as known only if its digest is of no rarer one."""
    spark, keys, least = normed.sparkSession, ["country", "kind", "tok"], common_from(vocab)
    ids, every = vocab.select(*keys, (F.col("tid") * 2 + F.col("lone")).alias("v"), "df"), least == 1
    known = known_tokens(ids.where(F.col("df") >= least))
    if not every:
        known = _told_apart(known, ids.where(F.col("df") < least))
    rare_ids = ids.drop("df")
    sent = spark.sparkContext.broadcast(known)
    shorts, hashes = [short for _, short in KINDS.values()], [f"key_{f}" for f in HASHED]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _large(batches):
            made = _looked_up(sent.value, every, b)
            yield from (made.slice(i, SENT) for i in range(0, max(1, made.num_rows), SENT))

    plain = ["country string", "entity_id string", "src int", *(f"{n} bigint" for n in hashes), *(f"{s}_all array<bigint>, {s}_lone int" for s in shorts), *([] if every else ["rest array<string>", *(f"{s} array<bigint>" for s in shorts)])]
    given = normed.select("country", "entity_id", "src", "name_norm", "addr_norm")
    out = stored(given.mapInArrow(look_up, ", ".join(plain)), "lists")
    if every:
        return out
    lacking = out.where("size(rest) > 0")
    t = F.split("t", ":", 2)
    others = lacking.select("country", "entity_id", F.explode("rest").alias("t")).select("country", "entity_id", t[0].alias("kind"), t[1].alias("tok"))
    others = others.join(rare_ids, keys).select("country", "entity_id", *(F.when(F.col("kind") == kind, F.array("v")).alias(short) for kind, (_, short) in KINDS.items()))
    merged = lacking.select("country", "entity_id", "src", *hashes, *shorts).unionByName(others, allowMissingColumns=True).groupBy("country", "entity_id")
    merged = merged.agg(F.max("src").alias("src"), *(F.max(n).alias(n) for n in hashes), *(F.array_sort(F.flatten(F.collect_list(s))).alias(s) for s in shorts))

    def lone(short: str) -> Column:
        bits = F.when(F.exists(short, lambda v: v % 2 == 1), F.lit(ANY_LONE)).otherwise(F.lit(0))
        for i in range(HEADS):
            bits = bits + F.coalesce(F.get(F.col(short), F.lit(i)) % 2, F.lit(0)).cast("int") * (1 << i)
        return bits.alias(f"{short}_lone")

    merged = merged.select("country", "entity_id", "src", *hashes, *(c for s in shorts for c in (F.transform(s, lambda v: F.shiftright(v, 1)).alias(f"{s}_all"), lone(s))))
    return out.where("size(rest) = 0").drop("rest", *shorts).unionByName(stored(merged, "lists"))


def _told_apart(known: tuple[np.ndarray, np.ndarray, str], rare: DataFrame) -> tuple[np.ndarray, np.ndarray, str]:
    """The known tokens without those whose digest a rarer token has too (none, as a rule): these go with the rarer ones."""
    digests, values, seed = known
    sent = rare.sparkSession.sparkContext.broadcast(digests)

    def clash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = hash_array(np.array(b.column("text").to_pylist(), object), hash_key=seed, categorize=False)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[np.isin(h, sent.value)].view(np.int64))})

    both = rare.select(F.concat_ws(":", "kind", "country", "tok").alias("text")).mapInArrow(clash, "h bigint").toArrow()["h"].to_numpy().view(np.uint64)
    keep = ~np.isin(digests, both)
    return digests[keep], values[keep], seed


def with_heads(lists: DataFrame, cfg: BlockConfig) -> DataFrame:
    """V4: the rarest k ids of each kind."""
    return lists.withColumns({"at": F.slice("at_all", 1, cfg.address_tokens), "mt": F.slice("mt_all", 1, cfg.name_tokens), "an": F.slice("an_all", 1, cfg.address_numbers)})


def slot(name: str, i: int) -> Column:
    """K1."""
    return F.get(F.col(name), F.lit(i))


def pack_pair(family: str, x: Column, y: Column, cfg: BlockConfig) -> Column:
    """K2: an unordered pair of one vocabulary. A missing partner gives the pair of a token with itself."""
    code = FAMILIES.index(family) << (2 * SLOT_BITS)
    hi, lo = F.greatest(x, y) % (1 << SLOT_BITS), F.least(x, y) % (1 << SLOT_BITS)
    key = F.lit(code).cast("long") + F.shiftleft(hi.cast("long"), SLOT_BITS) + lo
    return key if cfg.degenerate_pairs else F.when(x.isNotNull() & y.isNotNull(), key)


def pack_two(family: str, x: Column, y: Column) -> Column:
    """K3: a pair of two vocabularies; null without either."""
    code = FAMILIES.index(family) << (2 * SLOT_BITS)
    return F.lit(code).cast("long") + F.shiftleft((x % (1 << SLOT_BITS)).cast("long"), SLOT_BITS) + y % (1 << SLOT_BITS)


def pack_hash(family: str, text: Column) -> Column:
    """K4: 56 bits of the MD5."""
    code = FAMILIES.index(family) << (2 * SLOT_BITS)
    return F.lit(code).cast("long") + F.conv(F.substring(F.md5(text.cast("binary")), 1, 14), 16, 10).cast("long")


def family_keys(cfg: BlockConfig) -> dict[str, list[Column]]:
    """K5-K12: each family's key expressions over a record with id heads and text views."""
    pairs = lambda n: [(i, j) for i in range(n) for j in range(i + 1, n)]
    key = F.concat_ws(" # ", F.array_join(F.array_sort("addr_toks"), " "), F.array_join(F.array_sort("addr_nums"), " "))
    return {
        "AA": [pack_pair("AA", slot("at", i), slot("at", j), cfg) for i, j in pairs(cfg.address_tokens)],
        "NA": [pack_two("NA", slot("an", i), slot("at", j)) for i in range(cfg.address_numbers) for j in range(2)],
        "MA": [pack_two("MA", slot("mt", i), slot("at", j)) for i in range(2) for j in range(2)],
        "MM": [pack_pair("MM", slot("mt", i), slot("mt", j), cfg) for i, j in pairs(cfg.name_tokens)],
        "MN": [pack_two("MN", slot("mt", i), slot("an", 0)) for i in range(2)],
        "NK": [F.when(F.length("name_key") >= 3, pack_hash("NK", F.col("name_key")))],
        "AK": [F.when(F.size("addr_toks") >= 2, pack_hash("AK", key))],
        "NS": [F.when(F.length("name_core_nospace") >= 6, pack_hash("NS", F.col("name_core_nospace")))],
    }


def shared_keys(cfg: BlockConfig) -> dict[str, list[Column]]:
    """``family_keys`` of ``linked_lists`` without those that only records of one side can have, because a token in
    them is of one source alone (spaceless names have no tokens: all are kept)."""
    pairs = lambda n: [(i, j) for i in range(n) for j in range(i + 1, n)]
    none = lambda short, bits: F.col(f"{short}_lone").bitwiseAND(bits) == 0
    first = lambda s, i, t, j: none(s, 1 << i) & none(t, 1 << j)
    tests = {
        "AA": [none("at", 1 << i | 1 << j) for i, j in pairs(cfg.address_tokens)], "NA": [first("an", i, "at", j) for i in range(cfg.address_numbers) for j in range(2)], "MA": [first("mt", i, "at", j) for i in range(2) for j in range(2)],
        "MM": [none("mt", 1 << i | 1 << j) for i, j in pairs(cfg.name_tokens)], "MN": [first("mt", i, "an", 0) for i in range(2)], "NK": [none("mt", ANY_LONE)], "AK": [none("at", ANY_LONE) & none("an", ANY_LONE)], "NS": [F.lit(True)],
    }
    made = family_keys(cfg) | {f: [F.col(f"key_{f}")] for f in HASHED}
    return {f: [F.when(t, k) for t, k in zip(tests[f], made[f], strict=True)] for f in FAMILIES}


def make_keys(records: DataFrame, cfg: BlockConfig, shared: bool = False) -> DataFrame:
    """K13: (country, entity_id, fam, key), one row for each different key of a record; a key's upper bits are its
    family. shared: only keys that both sides can have, see ``shared_keys``."""
    by_family = shared_keys(cfg) if shared else family_keys(cfg) | ({f: [F.col(f"key_{f}")] for f in HASHED} if "key_NK" in records.columns else {})
    all_keys = F.array_distinct(F.array(*(k for f in cfg.families for k in by_family[f])))
    keys = records.select("country", "entity_id", F.explode(all_keys).alias("key")).where("key is not null")
    return keys.select("country", "entity_id", F.shiftrightunsigned("key", 2 * SLOT_BITS).cast("int").alias("fam"), "key")


def block_sizes(keys: DataFrame) -> DataFrame:
    return keys.groupBy("country", "fam", "key").agg(F.count("*").alias("n"))


def capped_index(keys: DataFrame, cfg: BlockConfig) -> DataFrame:
    """B1: the b side's keys whose block is not over the family's cap. The cap is part of the semantics."""
    caps = F.element_at(F.array(*(F.lit(cfg.cap(f)) for f in FAMILIES)), F.col("fam") + 1)
    small = block_sizes(keys).where(F.col("n") <= caps).select("country", "key")
    return keys.join(small, ["country", "key"])


def probe(a_keys: DataFrame, index: DataFrame, cfg: BlockConfig) -> DataFrame:
    """B2, B3: (country, a_id, b_id, n_keys, fam_mask)."""
    a, b = a_keys.select("country", "key", "fam", F.col("entity_id").alias("a_id")), index.select("country", "key", F.col("entity_id").alias("b_id"))
    out = a.join(b, ["country", "key"]).groupBy("country", "a_id", "b_id").agg(F.count("*").alias("n_keys"), F.bit_or(F.expr("shiftleft(1, fam)")).alias("fam_mask"))
    return limit_candidates(out, cfg.max_candidates) if cfg.max_candidates else out


#: From so many records on, candidates are made in passes, the shuffles of one being removed before the next: a fixed
#: number, so that the work grows with the records alone.
MANY_RECORDS, PASSES, KEY_PASSES = 1_000_000, 8, 3

#: Ids that fit a number: the source and a number without leading zeros.
NUMBERED = "^S[1-7]-(0|[1-9][0-9]{0,16})$"


def id_number(c: Column) -> Column:
    return F.substring(c, 4, 18).cast("long") * 8 + F.substring(c, 2, 1).cast("long")


def id_text(c: Column) -> Column:
    return F.concat(F.lit("S"), c.bitwiseAND(F.lit(7)).cast("string"), F.lit("-"), F.shiftright(c, 3).cast("string"))


def _heads(lists: pa.ListArray, most: int) -> np.ndarray:
    """The first values of each list as columns, -1 where it is shorter."""
    offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
    place = offsets[:-1, None] + np.arange(most)
    has = place < offsets[1:, None]
    return np.where(has, flat[np.where(has, place, 0)], -1) if len(flat) else np.full((len(lists), most), -1, np.int64)


def _shared_keys_of(batch: pa.RecordBatch, cfg: BlockConfig) -> np.ndarray:
    """``shared_keys`` of a batch: a row for each record, each different key once, -1 elsewhere."""
    at, mt, an = (_heads(batch.column(s), n) for s, n in (("at", cfg.address_tokens), ("mt", cfg.name_tokens), ("an", cfg.address_numbers)))
    lone = {s: batch.column(f"{s}_lone").to_numpy(zero_copy_only=False) for s in ("at", "mt", "an")}
    mod, made = 1 << SLOT_BITS, {f: [] for f in FAMILIES}

    def put(f: str, s: str, x: np.ndarray, i: int, t: str, y: np.ndarray, j: int) -> None:
        """A key of the i-th value of s and the j-th of t; of one list, a missing partner stands for the value itself."""
        one, other = x[:, i], y[:, j]
        good = (lone[s] & 1 << i == 0) & (lone[t] & 1 << j == 0) & (one >= 0)
        if s == t and cfg.degenerate_pairs:
            other = np.where(other >= 0, other, one)
        hi, lo = (np.maximum(one, other), np.minimum(one, other)) if s == t else (one, other)
        made[f].append(np.where(good & (other >= 0), (FAMILIES.index(f) << 2 * SLOT_BITS) + (hi % mod << SLOT_BITS) + lo % mod, -1))

    for f, s, x in (("AA", "at", at), ("MM", "mt", mt)):
        for i in range(x.shape[1]):
            for j in range(i + 1, x.shape[1]):
                put(f, s, x, i, s, x, j)
    for f, s, x, ni, t, y, nj in (("NA", "an", an, cfg.address_numbers, "at", at, 2), ("MA", "mt", mt, 2, "at", at, 2), ("MN", "mt", mt, 2, "an", an, 1)):
        for i in range(min(ni, x.shape[1])):
            for j in range(min(nj, y.shape[1])):
                put(f, s, x, i, t, y, j)
    for f, lists in (("NK", ("mt",)), ("AK", ("at", "an")), ("NS", ())):
        keys = pc.fill_null(batch.column(f"key_{f}"), -1).to_numpy(zero_copy_only=False)
        made[f].append(np.where(np.all([lone[s] & ANY_LONE == 0 for s in lists], axis=0), keys, -1) if lists else keys)
    out = np.sort(np.stack([k for f in cfg.families for k in made[f]], axis=1), axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out


def _live_runs(batches: Iterator[pa.RecordBatch], caps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by country, key and is_a, those of the keys that both sides have and whose block is not over its cap.
    A key that goes on in the next batch is held back: of the b side not more than the cap and one, of the a side only if it has a b."""
    held: pa.Table | None = None

    def judged(t: pa.Table, last: bool) -> tuple[pa.Table, pa.Table | None]:
        t = t.combine_chunks()
        country, key, is_a = pc.fill_null(t["country"], "").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), t["key"].to_numpy(), t["is_a"].to_numpy()
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (country[1:] != country[:-1])])
        run, start = np.cumsum(new) - 1, np.flatnonzero(new)
        n_b, n = np.bincount(run, weights=~is_a).astype(np.int64), np.diff(np.append(start, len(key)))
        cap = caps[key[start] >> 2 * SLOT_BITS]
        good = (n_b > 0) & (n_b < n) & (n_b <= cap)
        if last:
            return t.filter(pa.array(good[run])), None
        good[-1] = False
        tail = t.slice(start[-1])
        tail = tail.slice(0, 1) if n_b[-1] == 0 else tail.slice(0, int(cap[-1]) + 1) if n_b[-1] > cap[-1] else tail
        return t.filter(pa.array(good[run])), tail

    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            out, held = judged(t if held is None else pa.concat_tables([held, t]), False)
            yield from out.to_batches()
    if held is not None:
        yield from judged(held, True)[0].to_batches()


def live_keys(lists: DataFrame, a: DataFrame, cfg: BlockConfig, numbered: bool, passes: int) -> DataFrame:
    """(country, key, id, is_a): the keys that both sides have and whose block is not over the family's cap, a small
    part of all, made in passes over the key space with one shuffle each. The cap is judged on all of sources above 1."""
    caps, kind = np.array([cfg.cap(f) for f in FAMILIES]), "bigint" if numbered else "string"

    def of(df: DataFrame, is_a: bool) -> DataFrame:
        made = id_number(F.col("entity_id")) if numbered else F.col("entity_id")
        return with_heads(df.where("country is not null"), cfg).select("country", made.alias("id"), F.lit(is_a).alias("is_a"), "at", "mt", "an", *(f"{s}_lone" for s in ("at", "mt", "an")), *(f"key_{f}" for f in HASHED))

    def keyed(i: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = _shared_keys_of(b, cfg)
                take = keys >= 0
                if passes > 1:
                    take &= (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(passes) == i
                rows = pa.array(np.nonzero(take)[0])
                yield pa.RecordBatch.from_pydict({"country": b.column("country").take(rows), "key": pa.array(keys[take]), "id": b.column("id").take(rows), "is_a": b.column("is_a").take(rows)})

        return run

    shape, records = f"country string, key bigint, id {kind}, is_a boolean", of(a, True).unionByName(of(lists.where("src > 1"), False))
    made = []
    for i in range(passes):
        keys = records.mapInArrow(keyed(i), shape).repartition("country", "key").sortWithinPartitions("country", "key", "is_a")
        made.append(stored(keys.mapInArrow(lambda batches: _live_runs(batches, caps), shape), "live"))
    return reduce(DataFrame.unionByName, made)


def pairs_of(live: DataFrame, passes: int) -> list[DataFrame]:
    """(country, a, b, n_keys, fam_mask) of ``live_keys``, one lazy table for each pass over the a side; all pairs of an a are in one
    pass and one partition."""
    side = lambda p: live.where("is_a" if p == "a" else "not is_a").select("country", "key", F.col("id").alias(p))
    fam = F.shiftrightunsigned("key", 2 * SLOT_BITS).cast("int")
    out = []
    for i in range(passes):
        a = side("a").where(F.pmod(F.xxhash64("a"), F.lit(passes)) == i) if passes > 1 else side("a")
        met = a.join(side("b"), ["country", "key"]).select("country", "a", "b", fam.alias("fam")).repartition("a")
        out.append(met.groupBy("country", "a", "b").agg(F.count("*").alias("n_keys"), F.bit_or(F.expr("shiftleft(1, fam)")).alias("fam_mask")))
    return out


def passes_of(lists: DataFrame) -> tuple[int, bool, int, int]:
    """How many records there are, whether all ids are numbers, and the passes over the keys and over the a side."""
    n, numbered = lists.agg(F.count("*"), F.bool_and(F.coalesce(F.col("entity_id").rlike(NUMBERED), F.lit(False)))).first()
    return n, bool(numbered), *((KEY_PASSES, PASSES) if n >= MANY_RECORDS else (1, 1))


def probe_in_passes(lists: DataFrame, a: DataFrame, cfg: BlockConfig) -> DataFrame:
    """``probe`` of ``linked_lists``: a are those that probe, the index is all of sources above 1."""
    from kinmark.operators import packed

    n, numbered, key_passes, passes = passes_of(lists)
    if numbered:
        made = packed.candidates(lists, a, cfg, n, key_passes, passes)
    else:
        live = live_keys(lists, a, cfg, numbered, passes)
        made = reduce(DataFrame.unionByName, [stored(p.sortWithinPartitions("a", "b"), "candidates") for p in pairs_of(live, passes)])
        dropped(live)
    text = id_text if numbered else (lambda c: c)
    out = made.select("country", text(F.col("a")).alias("a_id"), text(F.col("b")).alias("b_id"), "n_keys", "fam_mask")
    return limit_candidates(out, cfg.max_candidates) if cfg.max_candidates else out


def limit_candidates(pairs: DataFrame, most: int) -> DataFrame:
    """B3: the pairs with most keys of each a, ties by b."""
    w = Window.partitionBy("a_id").orderBy(F.desc("n_keys"), "b_id")
    return pairs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def candidates(a: DataFrame, b: DataFrame, cfg: BlockConfig) -> DataFrame:
    """B4: records with heads on both sides."""
    return probe(make_keys(a, cfg), capped_index(make_keys(b, cfg), cfg), cfg)


def mask_counts(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(fam_mask, is_true, n): at most 512 rows, all that family recall needs."""
    marked = pairs.join(truth.withColumn("is_true", F.lit(1)), ["a_id", "b_id"], "left")
    return marked.groupBy("fam_mask", F.coalesce("is_true", F.lit(0)).alias("is_true")).agg(F.count("*").alias("n"))


def family_recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """B5: per family, its true pairs, all its pairs, and recall alone."""
    counts, fams = mask_counts(pairs, truth), pairs.sparkSession.createDataFrame(list(enumerate(FAMILIES)), "fam int, family string")
    total = truth.agg(F.count("*").alias("total"))
    per = counts.select(F.explode(F.sequence(F.lit(0), F.lit(len(FAMILIES) - 1))).alias("fam"), "fam_mask", "is_true", "n").where("shiftright(fam_mask, fam) & 1 = 1")
    sums = per.groupBy("fam").agg(F.sum(F.col("n") * F.col("is_true")).alias("found"), F.sum("n").alias("pairs"))
    out = fams.join(sums, "fam", "left").join(F.broadcast(total))
    return out.select("family", F.coalesce("found", F.lit(0)).cast("long").alias("found"), F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"), F.round(F.coalesce("found", F.lit(0)) / F.greatest("total", F.lit(1)), 9).alias("recall"))


def true_masks(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(fam_mask, n) of the pairs that are true."""
    return mask_counts(pairs, truth).where("is_true = 1").select("fam_mask", "n")


def greedy_families(found: DataFrame, truth: DataFrame) -> list[tuple[str, int, float]]:
    """B5: families in the order of marginal recall: (family, found so far, recall so far). found: ``true_masks``."""
    masks = [(r["fam_mask"], r["n"]) for r in found.collect()]
    total, used, out, rest = truth.count(), 0, [], set(range(len(FAMILIES)))
    while rest:
        reach = {f: sum(n for m, n in masks if m & (used | 1 << f)) for f in rest}
        best = max(sorted(rest), key=lambda f: reach[f])
        used |= 1 << best
        rest.discard(best)
        out.append((FAMILIES[best], reach[best], reach[best] / max(1, total)))
    return out


def blocking_report(pairs: DataFrame, truth: DataFrame, a_side: DataFrame, n_b: int | None = None, b_side: DataFrame | None = None) -> DataFrame:
    """B6: one row: recall, full coverage, candidates per entity (those without count as zero), reduction ratio."""
    hit = truth.join(pairs.select("a_id", "b_id"), ["a_id", "b_id"], "left_semi").groupBy("a_id").agg(F.count("*").alias("hit"))
    per_truth = truth.groupBy("a_id").agg(F.count("*").alias("need")).join(hit, "a_id", "left")
    t = per_truth.agg(F.coalesce(F.sum("need"), F.lit(0)).alias("n_true"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"), F.count_if(F.col("hit") == F.col("need")).alias("full"), F.count("*").alias("with_truth"))
    per_a = a_side.select(F.col("entity_id").alias("a_id")).join(pairs.groupBy("a_id").agg(F.count("*").alias("n")), "a_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    c = per_a.agg(F.count("*").alias("n_a"), F.sum("n").alias("n_pairs"), F.expr("percentile_disc(0.5) within group (order by n)").alias("median_cands"), F.expr("percentile_disc(0.95) within group (order by n)").alias("p95_cands"), F.max("n").alias("max_cands"), F.count_if(F.col("n") == 0).alias("no_cands"))
    size = b_side.agg(F.count("*").alias("n_b")) if b_side is not None else pairs.sparkSession.range(1).select(F.lit(n_b).cast("long").alias("n_b"))
    # three one-row results side by side
    one = c.join(F.broadcast(t)).join(F.broadcast(size))
    return one.select(
        "n_true", "n_found", F.round(F.col("n_found") / F.greatest("n_true", F.lit(1)), 9).alias("recall"), F.round(F.col("full") / F.greatest("with_truth", F.lit(1)), 9).alias("full_coverage"), "n_pairs",
        F.round(F.col("n_pairs") / F.col("n_a"), 9).alias("mean_cands"), F.col("median_cands").cast("long").alias("median_cands"), F.col("p95_cands").cast("long").alias("p95_cands"), "max_cands",
        F.round(F.col("no_cands") / F.col("n_a"), 9).alias("zero_share"), F.round(F.col("n_pairs") / (F.col("n_a") * F.col("n_b")), 12).alias("reduction_ratio"),
    )


def missed_pairs(pairs: DataFrame, truth: DataFrame, records: DataFrame) -> DataFrame:
    """B7: true pairs that are no candidates, with both names."""
    gone = truth.join(pairs.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
    name = lambda p: records.select(F.col("entity_id").alias(f"{p}_id"), F.col("business_name").alias(f"{p}_name"))
    return gone.join(name("a"), "a_id").join(name("b"), "b_id").select("a_id", "b_id", "a_name", "b_name")
