"""What changed between a stored snapshot and the present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REFRESH_LIMIT = 25


def changes(known: DataFrame, present: DataFrame) -> DataFrame:
    """path and state (new, deleted, changed, same). Both: path, size, mtime, hash.

    The hash only decides where size or time differ.
    """
    a, b = known.alias("a"), present.alias("b")
    stat = (F.col("a.size") == F.col("b.size")) & (F.col("a.mtime") == F.col("b.mtime"))
    state = F.when(F.col("a.path").isNull(), "new").when(F.col("b.path").isNull(), "deleted").when(stat | (F.col("a.hash") == F.col("b.hash")), "same").otherwise("changed")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), state.alias("state"))


def freshness(changed: DataFrame, failures: DataFrame | None = None, limit: int = REFRESH_LIMIT) -> DataFrame:
    """One row: how many paths drifted, and fresh, refreshable or partial."""
    count = changed.agg(F.count(F.when(F.col("state") != "same", 1)).alias("drifted"))
    bad = failures.where("parse_state <> 'ok'").limit(1).agg(F.count("*").alias("bad")) if failures is not None else count.select(F.lit(0).alias("bad"))
    state = F.when((F.col("bad") > 0) | (F.col("drifted") > limit), "partial").when(F.col("drifted") == 0, "fresh").otherwise("refreshable")
    return count.crossJoin(bad).select("drifted", state.alias("freshness"))  # one row each


def statistics(changed: DataFrame) -> DataFrame:
    """One row: files indexed, skipped (unchanged) and deleted by an incremental run."""
    n = lambda *s: F.count(F.when(F.col("state").isin(*s), 1))
    return changed.agg(n("new", "changed").alias("indexed"), n("same").alias("skipped"), n("deleted").alias("deleted"))
