"""Incremental linkage: new pool records meet a static table of keys as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def link_stream(new: DataFrame, keys: DataFrame) -> DataFrame:
    """Stream of (s1, pool, bits): new has (pool, part, family, key), keys (s1, part, family, key)."""
    return new.join(keys, ["part", "family", "key"]).select("s1", "pool", F.expr("shiftleft(1, family)").alias("bits"))


def start(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]):  # noqa: ANN201
    """Each batch's pairs, their bits joined, go to the sink once."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(batch.groupBy("s1", "pool").agg(F.bit_or("bits").alias("bits")), epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
