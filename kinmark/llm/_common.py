"""Small helpers shared by the corpus operators: where intermediate tables go, safe columns, Arrow slices."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmark.session import ensure_package, shared_dir, spread, stored  # noqa: F401 (the operators take the last ones from here)

def arrow_limits(spark: SparkSession, mb: int = 16) -> None:
    """Keep one Arrow batch to Python small whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_package(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def schema_of(**columns: pa.DataType) -> pa.Schema:
    return pa.schema(list(columns.items()))


def fresh_name(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish
