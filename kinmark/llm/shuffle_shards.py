"""Global shuffle and sharding in two passes over external storage.

Pass one scatters whole records into buckets of bounded size by a seeded hash of the record; the shuffle of
Spark is the external storage, so an executor that is lost only costs its own partitions. Pass two reads one
bucket at a time, brings it into a fixed order, applies a Fisher-Yates shuffle drawn from the seed and the
bucket's number, and writes the records on.

The position in the whole order (records in earlier buckets + place in the own bucket) deals records out like
cards: shard = position mod n, slot = position div n. Counts of shards differ by one at most and slots are
gapless. The hash is over all columns, so neither a frequent text nor a frequent key gathers in one bucket; only
rows that agree in every column share one.

Defined results: a null text counts as no bytes; rows with null keys and repeated rows are kept, one result per
row; an empty table gives an empty result. Helper columns get names that clash with none of the input's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kinmark.llm._common import fresh_name

#: More buckets than this are never made, so the table of their sizes (two integers each) stays below 16 MB; at 100 TB
#: a bucket has 100 MB. A task takes one bucket, or, beyond so many tasks, its share of them one after the other.
MOST_BUCKETS, MOST_TASKS = 1 << 20, 1 << 16


def bucket_count(total_bytes: int, bucket_bytes: int) -> int:
    return int(min(MOST_BUCKETS, max(1, -(-total_bytes // bucket_bytes))))


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of 0..n-1, the same for the same seed and bucket."""
    draw = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, bucket])))
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), (draw.random(max(0, n - 1)) * np.arange(n, 1, -1)).astype(np.int64).tolist(), strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shuffled_shards(df: DataFrame, text_col: str, n_shards: int, seed: int, bucket_bytes: int = 16 << 20) -> DataFrame:
    """``df`` with its columns unchanged plus ``shard`` and ``slot`` (names lengthened if taken)."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    bucket, base = fresh_name(df, "bucket_no"), fresh_name(df, "bucket_base")
    shard, slot = fresh_name(df, "shard"), fresh_name(df, "slot")
    total = df.agg(F.coalesce(F.sum(F.octet_length(text_col) + F.lit(64)), F.lit(0))).first()[0]
    n = bucket_count(total, bucket_bytes)
    keys = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    rows = df.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n)).cast("long"))
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    upto = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(bucket, F.coalesce(F.sum("n").over(upto), F.lit(0)).alias(base))
    # at most MOST_BUCKETS rows of two integers: small enough to broadcast at any size of the input
    dealt = rows.join(F.broadcast(starts), bucket).select(*df.columns, bucket, base)
    orderable = [c for c in df.columns if c in keys]
    tasks = min(n, MOST_TASKS)
    # by the number itself: a hash of it would put several buckets on one task and none on others
    dealt = dealt.repartitionById(tasks, (F.col(bucket) % tasks).cast("int")).sortWithinPartitions(bucket, *orderable)
    schema = T.StructType([*df.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(slot, T.LongType())])
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now: int | None = None

        def emit() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            first = whole.column(base)[0].as_py()
            order = fisher_yates(whole.num_rows, seed, now)
            place = first + np.arange(whole.num_rows)
            # record order[i] gets the i-th place of the bucket
            for lo in range(0, whole.num_rows, 1024):
                part = whole.take(pa.array(order[lo : lo + 1024])).select(range(width)).combine_chunks()
                at = place[lo : lo + 1024]
                yield pa.RecordBatch.from_arrays([*(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in part.columns), pa.array((at % n_shards).astype(np.int32)), pa.array(at // n_shards)], names=[*part.column_names, shard, slot])

        for batch in batches:
            numbers = batch.column(batch.schema.get_field_index(bucket)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if now is not None and int(numbers[lo]) != now:
                    yield from emit()
                    held = []
                now = int(numbers[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from emit()

    return dealt.mapInArrow(run, schema)
