"""Connected components: union-find in each partition, then one more of what they leave where that
is few links, else large-star and small-star rounds (Kiveris et al., 2014). No task holds more than
HELD nodes or so, whatever the components, and no driver any."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deal import dealt
from .store import forget, keep
from .workers import by_batch

#: Nodes that one union-find holds before it hands on its forest.
HELD = 1 << 20


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > HELD:
            yield out()
            parent.clear()
    yield out()


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long). Returns u and root, the least node that u reaches, for each u that isn't a root;
    the caller may forget() them."""
    spark = links.sparkSession
    edges = keep(by_batch(links.where("u <> v"), forest, "u long, v long"), "forest")
    if edges.count() <= HELD // 2:  # at most HELD nodes: one union-find ends it
        root = keep(by_batch(edges.coalesce(1), forest, "u long, v long").toDF("u", "root"), "roots")
        forget(edges)
        return root
    total = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = total()
    while True:
        before, old = now, edges
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", "n", F.least("u", "m").alias("m"))
        large = keep(dealt(both, low, ["u"], "n", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = dealt(large, least, ["u"], "n", before[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(small.union(least.select("u", "m")).distinct(), "stars")
        forget(old, large)
        now = total()
        if now == before:
            root = edges.select("u", F.col("v").alias("root"))
            root.kept = edges.kept
            return root
