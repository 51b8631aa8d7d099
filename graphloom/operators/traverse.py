"""One-hop traversals, fan-in and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import USAGE, score, tier_rank

#: Pattern: edge kinds, and whether the given symbol is the edge's target.
PATTERNS = {
    "callers_of": (["CALLS"], True),
    "callees_of": (["CALLS"], False),
    "references_to": (["CALLS", "REFERENCES"], True),
    "imports_of": (["IMPORTS"], False),
    "imported_by": (["IMPORTS"], True),
    "implementations_of": (["IMPLEMENTS"], True),
    "inheritors_of": (["INHERITS"], True),
    "inherits_from": (["INHERITS"], False),
    "tests_for": (["TESTS"], True),
    "contained_by": (["CONTAINS"], True),
    "contains": (["CONTAINS"], False),
}


def fan_in(edge: DataFrame) -> DataFrame:
    """id and fan_in: usage edges, not distinct callers, of every symbol that has one."""
    return edge.where(F.col("kind").isin(USAGE)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))


def fan_in_p95(edge: DataFrame) -> DataFrame:
    """One row: the nearest-rank 95th percentile of fan-in, 0 without usage."""
    return p95(fan_in(edge))


def p95(fan: DataFrame) -> DataFrame:
    """The same from a table of fan_in()."""
    return fan.agg(F.coalesce(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY fan_in)"), F.lit(0)).cast("long").alias("p95"))


def seed(symbol: DataFrame, name: str) -> DataFrame:
    """The id that a name means: by stable key, else qualified name, else short name.

    The first level with a match decides, and only a single match counts.
    """
    level = F.when(F.col("stable_key") == name, 0).when(F.col("qualified_name") == name, 1).when(F.col("short_name") == name, 2)
    hits = symbol.select("id", level.alias("level")).where("level is not null").groupBy("level").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return hits.agg(F.min(F.struct("level", "n", "id")).alias("x")).where("x.n = 1").select("x.id")


def neighbours(edge: DataFrame, symbol: DataFrame, file: DataFrame, pattern: str, of: DataFrame | int, distance: int = 1, fan: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """The symbols that a pattern reaches, once each by its best edge, with tier and score.

    of: an id, or a one-row DataFrame of `id`. fan, most: a table of fan_in() and its 95th
    percentile where these are written; else they are counted from all edges.
    """
    kinds, reverse = PATTERNS[pattern]
    here, there = ("dst", "src") if reverse else ("src", "dst")
    some = edge.where(F.col("kind").isin(kinds))
    if isinstance(of, int):
        some = some.where(F.col(here) == of)
    else:
        some = some.join(F.broadcast(of.select(F.col("id").alias(here))), here, "left_semi")  # one row
    order = Window.partitionBy("id").orderBy("tier_rank", F.when(F.col("edge_kind") == "CALLS", 0).otherwise(1), F.asc_nulls_first("site_line"), "edge_kind", "confidence")
    hits = some.select(F.col(there).alias("id"), F.col("kind").alias("edge_kind"), "tier", "confidence", "site_line", tier_rank(F.col("tier")).alias("tier_rank"))
    best = hits.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    used = fan if fan is not None else fan_in(edge).join(best.select("id"), "id", "left_semi")
    found = best.join(symbol, "id").join(file.select(F.col("id").alias("file_id"), "path"), "file_id").join(used, "id", "left")
    found = found.crossJoin(F.broadcast(p95(used if fan is not None else fan_in(edge)))) if most is None else found.withColumn("p95", F.lit(most))  # one row
    value = score(distance, F.coalesce("fan_in", F.lit(0)), F.col("p95"), F.col("exported"))
    return found.select("id", "stable_key", "qualified_name", F.col("kind"), "path", "edge_kind", "tier", "tier_rank", "confidence", "site_line", F.coalesce("fan_in", F.lit(0)).cast("long").alias("fan_in"), value.alias("score"))


def one_hop(edge: DataFrame, symbol: DataFrame, file: DataFrame, pattern: str, of: DataFrame | int, limit: int = 50, fan: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, bool]:
    """The best `limit` neighbours, tier before score before key, and whether there are more."""
    ordered = neighbours(edge, symbol, file, pattern, of, fan=fan, most=most).orderBy("tier_rank", F.desc("score"), F.expr("collate(stable_key, 'UNICODE')"))
    return ordered.limit(limit), len(ordered.select("id").take(limit + 1)) > limit


def completeness(external: DataFrame, unresolved: DataFrame, symbol: DataFrame, of: int, reverse: bool) -> DataFrame:
    """What a traversal can't see. Forward: the symbol's own refs; reverse: unresolved refs by its short name."""
    if reverse:
        own = unresolved.join(F.broadcast(symbol.where(F.col("id") == of).select(F.col("short_name").alias("name"))), "name", "left_semi")
        outside = F.lit(0).cast("long")
        return own.agg(F.count("*").alias("unresolved"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names")).withColumn("external", outside)
    own = unresolved.where(F.col("src") == of).agg(F.count("*").alias("unresolved"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return own.crossJoin(external.where(F.col("src") == of).agg(F.count("*").alias("external")))  # one row each
