"""Bounded reverse reach: what depends on the given symbols."""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import USAGE, score, tier_rank
from graphloom.operators.traverse import fan_in, p95

MAX_DEPTH, MAX_NODES = 6, 500
#: Nodes that the driver holds, and that a level broadcasts, at most.
MOST_NODES = 100_000
#: Ids up to which a level is asked for by literals; beyond, by joins. The rows are the same.
FEW = 2000


def seeds_of_files(symbol: DataFrame, file: DataFrame, changed: DataFrame) -> DataFrame:
    """All symbols of the changed paths."""
    return symbol.join(file.join(changed, "path", "left_semi").select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")


def radius(edge: DataFrame, symbol: DataFrame, seeds: list[int], depth: int = MAX_DEPTH, nodes: int = MAX_NODES, fan: DataFrame | None = None, most: int | None = None, seconds: float = math.inf) -> tuple[DataFrame, list[str]]:
    """The symbols that reach the seeds backwards, by level, and warnings about what was cut.

    Inside a level the best evidence comes first, so a cut drops the weakest. A level is one
    join with a frontier of at most `nodes` ids; no level is planned on the one before, so
    plans don't grow. fan, most: as in neighbours(). seconds: no level begins later than that.
    Returns id, depth, tier, score, stable_key.
    """
    if nodes > MOST_NODES:
        raise ValueError(f"at most {MOST_NODES} nodes are held on the driver")
    spark, start = edge.sparkSession, time.monotonic()
    usage = edge.where(F.col("kind").isin(USAGE)).select("src", "dst", "tier")
    used = fan_in(edge) if fan is None else fan
    most = p95(used).first()[0] if most is None else most
    seen, frontier, rows, warnings = set(seeds), sorted(set(seeds)), [], []
    for level in range(1, depth + 2):
        if not frontier:
            break
        if time.monotonic() - start > seconds:
            warnings.append(f"{seconds:g} seconds reached")
            break
        if len(frontier) + len(seen) <= FEW:  # as literals, which reach the scan
            fresh = usage.where(F.col("dst").isin(frontier) & ~F.col("src").isin(sorted(seen)))
        else:
            here = F.broadcast(spark.createDataFrame([(x,) for x in frontier], "dst long"))  # at most `nodes` rows
            past = F.broadcast(spark.createDataFrame([(x,) for x in sorted(seen)], "src long"))  # seeds and at most `nodes` rows
            fresh = usage.join(here, "dst", "left_semi").join(past, "src", "left_anti")
        if level > depth:
            if not fresh.isEmpty():
                warnings.append(f"depth {depth} reached")
            break
        best = fresh.groupBy(F.col("src").alias("id")).agg(F.min(F.struct(tier_rank(F.col("tier")).alias("rank"), "tier")).alias("e"))
        value = score(level, F.coalesce("fan_in", F.lit(0)), F.lit(most), F.col("exported"))
        some = best.select("id", "e.rank", "e.tier").limit(FEW + 1).collect()
        if len(some) <= FEW:
            tiers = {r.id: (r["rank"], r.tier) for r in some}
            told = used.where(F.col("id").isin(list(tiers))) if tiers else used.limit(0)
            known = symbol.where(F.col("id").isin(list(tiers))).select("id", "stable_key", "exported") if tiers else symbol.select("id", "stable_key", "exported").limit(0)
            rated = known.join(F.broadcast(told), "id", "left").select("id", "stable_key", value.alias("score")).collect()  # at most FEW rows on either side
            found = sorted((Row(id=r.id, rank=tiers[r.id][0], tier=tiers[r.id][1], score=r.score, stable_key=r.stable_key) for r in rated), key=lambda r: (r.rank, -r.score, r.stable_key))
        else:
            known = best.join(symbol.select("id", "stable_key", "exported"), "id").join(used, "id", "left")
            ordered = known.select("id", F.col("e.rank").alias("rank"), F.col("e.tier").alias("tier"), value.alias("score"), "stable_key").orderBy("rank", F.desc("score"), "stable_key")
            found = ordered.limit(nodes - len(rows) + 1).collect()  # at most `nodes` + 1 rows
        left = nodes - len(rows)
        if len(found) > left:
            warnings.append(f"{nodes} nodes reached")
        found = found[:left]
        rows += [(r.id, level, r.tier, r.score, r.stable_key) for r in found]
        if warnings:
            break
        frontier = [r.id for r in found]
        seen.update(frontier)
    return spark.createDataFrame(rows, "id long, depth long, tier string, score double, stable_key string"), warnings


def reachable(links: DataFrame, start: str, downstream: bool = True) -> DataFrame:
    """The modules that links (source, target) lead to, or come from, without the start itself."""
    spark = links.sparkSession
    here, there = ("source", "target") if downstream else ("target", "source")
    seen, frontier = {start}, [start]
    while frontier:  # one round for each step of the longest shortest path
        step = links.join(F.broadcast(spark.createDataFrame([(x,) for x in frontier], f"{here} string")), here, "left_semi")
        frontier = [r[0] for r in step.select(there).distinct().collect() if r[0] not in seen]  # modules, not symbols
        seen.update(frontier)
    return spark.createDataFrame([(x,) for x in sorted(seen - {start})], "module string")


def ranks(modules: list[str], links: list[tuple[str, str]]) -> dict[str, int]:
    """Longest-path columns of a module graph, compacted. Cycles end after as many passes as there are modules."""
    rank = dict.fromkeys(modules, 0)
    for _ in modules:
        changed = False
        for a, b in sorted(links):
            if a in rank and b in rank and rank[b] < rank[a] + 1 < len(modules):
                rank[b], changed = rank[a] + 1, True
        if not changed:
            break
    dense = {r: i for i, r in enumerate(sorted(set(rank.values())))}
    return {m: dense[r] for m, r in rank.items()}


def rows_in_columns(placed: DataFrame) -> DataFrame:
    """column and path to column, path and row index."""
    return placed.withColumn("row", F.row_number().over(Window.partitionBy("column").orderBy("path")) - 1)
