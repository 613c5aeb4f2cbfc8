"""Sources and sinks (SC*, SK*), and the views of driver tables that stand for records (F1-F5)."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmark.functions.text import comma_list

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SC1: tab-separated, header, no quoting; a missing field is the empty string."""
    raw = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return raw.select(*(F.coalesce(F.col(f.name), F.lit("")).alias(f.name) for f in schema.fields))


def read_source(spark: SparkSession, root: str, split: str, source: int) -> DataFrame:
    """SC2, SC3: one source of a split; lazy, as every DataFrame."""
    return read_tsv(spark, f"{root}/{split}/source{source}.tsv", RECORD)


def read_truth(spark: SparkSession, root: str, split: str) -> DataFrame:
    """SC4, SC5."""
    return read_tsv(spark, f"{root}/{split}/ground_truth.tsv", TRUTH)


def read_json_or_none(path: str) -> dict | list | None:
    """SC14: a small JSON or JSON-lines artefact, or nothing if it is absent."""
    p = Path(path)
    if not p.exists():
        return None
    text = p.read_text()
    return [json.loads(x) for x in text.splitlines() if x.strip()] if p.suffix == ".jsonl" else json.loads(text)


def write_prepared(df: DataFrame, path: str) -> None:
    """SK1: Parquet by split, source and country, so that scans prune to what they need."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("split", "source", "country").parquet(path)


def load_prepared(spark: SparkSession, path: str, split: str, source: int, country: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """SC6: partition and column pruning are left to the scan."""
    df = spark.read.parquet(path).where((F.col("split") == split) & (F.col("source") == source))
    df = df if country is None else df.where(F.col("country") == country)
    return df.select(*columns) if columns else df


def write_scored(df: DataFrame, path: str, fresh: bool = True) -> None:
    """SK2."""
    df.write.mode("overwrite" if fresh else "append").partitionBy("country").parquet(path)


def write_tsv(df: DataFrame, path: str, order_by: str) -> None:
    """SK3: one file with header, nothing quoted, in a stated order."""
    flat = df.orderBy(order_by).coalesce(1)
    flat.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """SK7: a report of a few rows as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


#: Words of a record's name and address, and what separates a document's runs in record numbers.
NAME_WORDS, ADDRESS_WORDS, RUN_STEP = 6, 12, 1_000_000
#: Words from the beginning of a document's passage to that of the next.
PASSAGE_STEP = (NAME_WORDS + ADDRESS_WORDS) // 2


def _runs(df: DataFrame, id_col: str, words: int, step: int) -> DataFrame:
    """``df`` with i (number of the run) and run (array of at most ``words`` words), one row for each ``step`` words
    of the whole text; an empty or null text has one run without words. Numbers are id * RUN_STEP + i."""
    w = F.col("_w")  # a column of its own: within the lambda, the text would be split again for each run
    count = F.greatest(F.lit(1), F.ceil((F.size(w) - (words - step)) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(w, i * step + 1, words))
    split = df.withColumn("_w", F.split(F.coalesce("text", F.lit("")), " "))
    return split.select(*df.columns, F.posexplode(cut).alias("i", "run")).withColumn("number", F.col(id_col) * RUN_STEP + F.col("i"))


def _source(doc_id: str) -> Column:
    return 1 + F.col(doc_id) % 3


def documents_as_records(docs: DataFrame) -> DataFrame:
    """whole documents as records, 18 words each: the first six words of a run are the name, the others and a
    number (n_chars plus the run's number) the address, the language is the country; ids deal documents out to
    sources 1 to 3."""
    part = lambda lo, n: F.array_join(F.slice("run", lo, n), " ")
    return _runs(docs, "doc_id", NAME_WORDS + ADDRESS_WORDS, NAME_WORDS + ADDRESS_WORDS).select(
        F.concat(F.lit("S"), _source("doc_id"), F.lit("-"), F.col("number")).alias("entity_id"),
        _source("doc_id").cast("int").alias("src"),
        F.coalesce("lang", F.lit("")).alias("country"),
        part(1, NAME_WORDS).alias("business_name"),
        F.concat(part(NAME_WORDS + 1, ADDRESS_WORDS), F.lit(" "), F.coalesce((F.col("n_chars") + F.col("i")).cast("string"), F.lit(""))).alias("business_address"),
    )


def document_truth(docs: DataFrame) -> DataFrame:
    """(a_id, b_id): runs of one number of documents of source 1 and of sources 2 or 3 with one text and language."""
    words = F.size(F.split("text", " "))
    runs = F.greatest(F.lit(1), F.ceil(words / (NAME_WORDS + ADDRESS_WORDS))).cast("int")
    side = lambda p: docs.select(_source("doc_id").alias(f"{p}_src"), F.col("doc_id").alias(p), "lang", F.sha2("text", 256).alias("h"), runs.alias("n"))
    a, b = side("a").where("a_src = 1"), side("b").where("b_src > 1")
    same = a.join(b, ["lang", "h", "n"]).select("a", "b", "b_src", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return same.select(F.concat(F.lit("S1-"), F.col("a") * RUN_STEP + F.col("i")).alias("a_id"), F.concat(F.lit("S"), "b_src", F.lit("-"), F.col("b") * RUN_STEP + F.col("i")).alias("b_id"))


def passages_as_records(items: DataFrame, docs: DataFrame) -> DataFrame:
    """benchmark passages (source 1) against whole documents (source 2), one country. Runs of 18 words are names;
    those of documents begin every nine words, so each run of a passage shares at least nine words in a row with one
    of the document that holds it, wherever it stands."""
    size = NAME_WORDS + ADDRESS_WORDS

    def shape(df: DataFrame, id_col: str, source: int, step: int) -> DataFrame:
        cut = _runs(df.select(id_col, "text"), id_col, size, step)
        return cut.select(F.concat(F.lit(f"S{source}-"), F.col("number")).alias("entity_id"), F.lit(source).alias("src"), F.lit("all").alias("country"), F.array_join("run", " ").alias("business_name"), F.lit("").alias("business_address"))

    return shape(items, "item_id", 1, size).unionByName(shape(docs, "doc_id", 2, PASSAGE_STEP))


def urls_as_records(pages: DataFrame) -> DataFrame:
    """F3."""
    return pages.select(F.concat(F.lit("S2-"), "page_id").alias("entity_id"), F.coalesce("url", F.lit("")).alias("business_name"), F.lit("").alias("business_address"), F.lit("all").alias("country"))


def scored_pairs(lineitem: DataFrame) -> DataFrame:
    """(a, b, p, y, is_s3) from order lines."""
    return lineitem.groupBy(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).agg(
        F.max(F.round(F.col("l_extendedprice") / 105000.0, 6)).alias("p"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"),
        F.min(F.col("l_linenumber") % 2).cast("int").alias("is_s3"),
    )


def pair_truth(pairs: DataFrame, orders: DataFrame) -> DataFrame:
    """(a, n_true) for every order."""
    n = pairs.groupBy("a").agg(F.sum("y").alias("n"))
    return orders.select(F.col("o_orderkey").alias("a")).join(n, "a", "left").select("a", F.coalesce("n", F.lit(0)).cast("long").alias("n_true"))


def exploded_truth(truth: DataFrame) -> DataFrame:
    """(a_id, b_id) of the comma lists."""
    return truth.select(F.col("source1_entity_id").alias("a_id"), F.explode(comma_list(F.col("matched_entity_ids"))).alias("b_id")).where("b_id <> ''")


def indexed_truth(truth: DataFrame, b_side: DataFrame) -> DataFrame:
    """TR1: the true pairs whose b is in the index; b_side has entity_id."""
    return exploded_truth(truth).join(b_side.select(F.col("entity_id").alias("b_id")).distinct(), "b_id", "left_semi").select("a_id", "b_id")


def listed_counts(truth: DataFrame) -> DataFrame:
    """TR2: (a, n_true) of every listed entity, also of those without a match, over all listed ids."""
    return truth.select(F.col("source1_entity_id").alias("a"), F.size(F.filter(comma_list(F.col("matched_entity_ids")), lambda x: x != "")).cast("long").alias("n_true"))


def write_truth_counts(counts: DataFrame, path: str) -> None:
    """SK4: (a, n_true, country, part), a folder for each country and part."""
    counts.write.mode("overwrite").partitionBy("country", "part").parquet(path)


def read_truth_counts(spark: SparkSession, path: str, part: str | None = None) -> DataFrame:
    """SC10: all shards as one table, or those of a part."""
    df = spark.read.parquet(path)
    return df if part is None else df.where(F.col("part") == part)


def write_dataset(rows: DataFrame, path: str, info: dict) -> None:
    """SK5: feature rows with their keys and labels by part and country, and what they were made with."""
    rows.write.mode("overwrite").partitionBy("part", "country").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """SC11: the feature rows, read by column as needed, and their description."""
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/info").first()["value"])


def read_lists(spark: SparkSession, path: str, column: str) -> DataFrame:
    """SC9: a published table of comma lists."""
    return read_tsv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", column)]))
