"""Incremental linkage: a stream of new a-side records probes a fixed index. Vocabulary and index are built once in
batch; each micro-batch is normalised, keyed and joined like any other a side. The operators are those of the batch
plan, applied through foreachBatch, so results of a record do not depend on the batch that it came in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinmark.functions.text import with_forms
from kinmark.operators import blocking
from kinmark.operators.blocking import BlockConfig


def probe_stream(records: DataFrame, vocab: DataFrame, index: DataFrame, cfg: BlockConfig, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """records: a streaming DataFrame of entity_id, country, business_name, business_address."""

    def handle(batch: DataFrame, number: int) -> None:
        forms = with_forms(batch)
        lists = blocking.id_lists(forms, vocab)
        side = blocking.with_heads(forms.join(lists, ["country", "entity_id"]), cfg)
        sink(blocking.probe(blocking.make_keys(side, cfg), index, cfg), number)

    return records.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
