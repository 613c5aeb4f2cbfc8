"""Benchmark decontamination: a prefix-filtered set join of item windows against documents, in SQL functions only.

Every item is cut into windows of ``width`` words (an item of fewer words is one window). A document that contains a
window has it inside a run of consecutive words that all occur in windows. So the documents are read once: each text
is cut into words, the words that no window has are blanked, and only runs at least as long as the shortest window are
stored; everything else works on these runs.

A window is a set that a run must contain whole, so with its tokens in order of rarity the necessary prefix is its
single rarest word. Words of runs join that prefix; the place of the word gives the one place where the window could
start, which must lie inside the run (length and positional bounds); the candidate is then verified word by word on a
slice of exactly the window's size. Rarity is counted over the runs of all documents, for other places join nothing.

The windows' words are written into the first pass while there are at most ``LISTED_WORDS`` of them, and the windows
are broadcast up to ``BROADCAST_WINDOWS`` and ``BROADCAST_BYTES`` (both are counted first). Beyond, a text is one run,
and the words travel with the slice around them and Spark joins by shuffle, where adaptive execution splits the
partitions of frequent words. The results are the same.

Defined results: null and empty texts have no words and no hits. Items without words have no window; items with
equal texts count once each. Every row is judged for itself, so repeated rows, repeated ids and null ids get a result
each. Texts are read whole. Other columns, of any name, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmark.llm._common import stored

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters outside ASCII that lower() would change too; only texts with one need the slower exact mapping.
_OTHER_CAPITALS = "[\\p{IsUppercase}\\p{Lt}&&[^\\x00-\\x7F]]"
LISTED_WORDS, BROADCAST_WINDOWS, BROADCAST_BYTES = 30_000, 100_000, 16 << 20


def ascii_lower(text: Column) -> Column:
    return F.when(text.rlike(_OTHER_CAPITALS), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """item, win (array of words): the distinct windows of each item."""
    cut = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(width) + 1))
    return cut.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("win")).distinct()


def runs_of(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str] | None, shortest: int) -> DataFrame:
    """row (a number of its own), doc, n_words, runs (texts of at least ``shortest`` words, all of the vocabulary)."""
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), words_of(F.col(text_col)).alias("w"))
    if vocabulary is None:
        return cut.select("row", "doc", F.size("w").cast("long").alias("n_words"), F.when(F.size("w") >= shortest, F.array(F.array_join("w", " "))).alias("runs"))
    # words have letters, digits and characters outside ASCII only, so they need no quoting
    listed = ", ".join(f"'{w}'" for w in vocabulary) or "''"
    kept = F.expr(f"transform(w, x -> if(x in ({listed}), x, '\n'))")
    long_enough = lambda run: (F.length(run) >= 2 * shortest - 1) & (F.size(F.split(run, " ")) >= shortest)
    runs = F.filter(F.transform(F.split(F.array_join(kept, " "), "\n"), lambda x: F.trim(x)), long_enough)
    return cut.select("row", "doc", F.size("w").cast("long").alias("n_words"), runs.alias("runs"))


def hits(runs: DataFrame, wins: DataFrame, width: int, fits: bool) -> DataFrame:
    """row, run (its number), win (words), start (1-based place in the run): every occurrence of every window."""
    held = F.broadcast if fits else lambda d: d
    words = runs.where(F.size("runs") > 0).select("row", F.posexplode("runs").alias("run", "text")).select("row", "run", F.split("text", " ").alias("w"))
    counts = words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("f"))
    # windows with their words ranked by rarity; the place is that of the rarest word's first occurrence
    ranked = wins.select("win", F.posexplode("win").alias("off", "word")).join(counts, "word", "left")
    prefix = ranked.groupBy("win").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "word", "off")).alias("m"), F.min(F.coalesce("f", F.lit(0))).alias("least"))
    prefix = prefix.where("least > 0").select(F.col("m.word").alias("word"), F.col("m.off").alias("off"), "win")
    around = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.struct(i.alias("at"), F.get("w", i - 1).alias("word"), F.slice("w", F.greatest(i - width + 1, F.lit(1)), F.least(i, F.lit(width)) + width - 1).alias("near")))
    spread = words.select("row", "run", F.explode(around).alias("x")).select("row", "run", "x.*")
    found = spread.join(held(prefix), "word")
    begin = F.least(F.col("at"), F.lit(width)) - F.col("off")  # within the slice around the word
    size = F.size("win")
    inside = (begin >= 1) & (begin + size - 1 <= F.size("near"))
    return found.where(inside).where(F.slice("near", F.greatest(begin, F.lit(1)), size) == F.col("win")).select("row", "run", "win", (F.col("at") - F.col("off")).alias("start"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, share: int = 20) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    of_items = stored(windows(items, item_col, item_text_col, width), "items")
    wins = of_items.select("win").distinct()
    small = wins.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("win", " "))), F.lit(0)).alias("b"), F.coalesce(F.min(F.size("win")), F.lit(width)).alias("shortest")).first()
    fits = small["n"] <= BROADCAST_WINDOWS and small["b"] <= BROADCAST_BYTES
    vocabulary = [r[0] for r in wins.select(F.explode("win")).distinct().limit(LISTED_WORDS + 1).collect()] if fits else []
    listed = sorted(vocabulary) if fits and len(vocabulary) <= LISTED_WORDS else None
    runs = stored(runs_of(docs, id_col, text_col, listed, small["shortest"]), "runs")
    # one row for each run and window, stored: places and items both follow from it
    found = stored(hits(runs, wins, width, fits).groupBy("row", "run", "win").agg(F.collect_set("start").alias("starts")), "windows")
    size = F.size("win")
    places = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + size - 1)))
    covered = found.select("row", "run", F.explode(places).alias("p")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    listed_items = found.select("row", "win").join(of_items, "win").select("row", "item").distinct()
    listed_items = listed_items.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("names"))
    out = runs.select("row", F.col("doc").alias(id_col), "n_words").join(covered, "row", "left").join(listed_items, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated")
    )
