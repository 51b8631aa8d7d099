"""Freshness from a change feed: the drift operator on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.drift import changes


def watch(feed: DataFrame, known: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand the drifted paths of each micro-batch to `apply`.

    feed: a stream of path, size, mtime, hash; the last row of a path in a batch counts.
    known: the stored snapshot at that moment. Only paths of the feed are compared.
    """

    def batch(rows: DataFrame, number: int) -> None:
        last = rows.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "hash"), "mtime").alias("x")).select("path", "x.*")
        old = known().join(last.select("path"), "path", "left_semi")
        apply(changes(old, last).where("state <> 'same'"), number)

    return feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
