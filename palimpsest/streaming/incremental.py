"""An extension: new documents checked against fixed targets as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions import text as T
from palimpsest.operators import overlap


def watch(stream: DataFrame, targets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, doc: str = "doc_id", text: str = "text", target: str = "item_id", target_text: str = "text") -> StreamingQuery:
    """Every micro-batch is matched against the targets; sink gets (matches, batch id) and must write idempotently."""
    fixed = targets.withColumn("_norm", T.norm_light(target_text))

    def batch(df: DataFrame, number: int) -> None:
        sink(overlap.contamination(df.withColumn("_norm", T.norm_light(text)), doc, "_norm", fixed, target, "_norm", least_set=0), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
