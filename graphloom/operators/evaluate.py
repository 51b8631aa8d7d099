"""Evaluation: precision and recall of edges, recall of evidence, means over tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import TIERS


def precision_recall(actual: DataFrame, expected: DataFrame, by: str = "kind") -> DataFrame:
    """by, tp, fp, fn, precision, recall of two sets of equal rows; an empty denominator gives 1."""
    keys = actual.columns
    both = actual.distinct().withColumn("a", F.lit(1)).join(expected.select(*keys).distinct().withColumn("e", F.lit(1)), keys, "full_outer")
    n = lambda when: F.count(F.when(when, 1))
    made = both.groupBy(by).agg(n(F.col("a").isNotNull() & F.col("e").isNotNull()).alias("tp"), n(F.col("e").isNull()).alias("fp"), n(F.col("a").isNull()).alias("fn"))
    share = lambda x: F.when(F.col("tp") + F.col(x) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(x)))
    return made.withColumns({"precision": share("fp"), "recall": share("fn")})


def mentions(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """task, evidence and the first ordinal whose text names it between identifier boundaries, case aside.

    texts: task, ordinal, text; evidence: task, name. Joined by task, never across.
    """
    pattern = F.concat(F.lit("(?iu)(?<![\\p{L}\\p{N}_$])\\Q"), F.col("name"), F.lit("\\E(?![\\p{L}\\p{N}_$])"))
    hits = texts.join(evidence, "task").where(F.rlike(F.col("text"), pattern)).groupBy("task", "name").agg(F.min("ordinal").alias("first"))
    return evidence.join(hits, ["task", "name"], "left")


def means(tasks: DataFrame, columns: list[str]) -> DataFrame:
    """Means over tasks; null values are left out."""
    return tasks.agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("tasks"))


def compare(actual: DataFrame, expected: DataFrame, by: list[str] = ()) -> DataFrame:
    """kind, tp, fp, fn, precision and recall of edges (src, dst, kind), and a row `overall` of their sums.

    Calls and heritage are references, too: the kind REFERENCES counts every actual edge, so
    its rows and the others' overlap. by: columns that both tables have besides, compared apart.
    """
    keys = [*by, "src", "dst"]
    kinds = actual.select(*by, "kind").union(expected.select(*by, "kind")).distinct()
    wide = actual.select(*keys, "kind").union(actual.select(*keys, F.lit("REFERENCES").alias("kind"))).join(kinds, [*by, "kind"], "left_semi")
    both = wide.distinct().withColumn("a", F.lit(1)).join(expected.select(*keys, "kind").distinct().withColumn("e", F.lit(1)), [*keys, "kind"], "full_outer")
    n = lambda when: F.count(F.when(when, 1))
    made = both.groupBy(*by, "kind").agg(n(F.col("a").isNotNull() & F.col("e").isNotNull()).alias("tp"), n(F.col("e").isNull()).alias("fp"), n(F.col("a").isNull()).alias("fn"))
    whole = made.groupBy(*by).agg(F.lit("overall").alias("kind"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    share = lambda x: F.when(F.col("tp") + F.col(x) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(x)))
    return made.unionByName(whole).withColumns({"precision": share("fp"), "recall": share("fn")})


def by_tier(actual: DataFrame, expected: DataFrame | Column) -> DataFrame:
    """compare() of each tier alone with all that is expected, and of all edges as the tier ALL.

    actual: src, dst, kind, tier. expected: a table of edges, or a condition on actual's rows
    where what is expected is among them. A tier's row of a kind that neither side has is left out.

    A pair of ends has bits for each kind: one for each tier with such an edge, one for any
    edge and one for what is expected. Pairs are counted by their bits, and those few are read.
    """
    width, some, wanted = len(TIERS) + 2, 1 << len(TIERS), 2 << len(TIERS)
    own = reduce(lambda x, i: F.when(F.col("tier") == TIERS[i], some | 1 << i).otherwise(x), range(len(TIERS)), F.lit(some))
    if isinstance(expected, DataFrame):
        rows = actual.select("src", "dst", "kind", own.alias("bits")).union(expected.select("src", "dst", "kind", F.lit(wanted)))
    else:
        rows = actual.select("src", "dst", "kind", own.bitwiseOR(F.when(expected, wanted).otherwise(0)).alias("bits"))
    kinds = sorted((r.kind for r in rows.select("kind").distinct().collect()), key=lambda k: (k is None, k))
    in_one = 63 // width
    packs = [kinds[a : a + in_one] for a in range(0, len(kinds), in_one)] or [[None]]
    put = lambda pack: reduce(lambda x, i: F.when(F.col("kind").eqNullSafe(F.lit(pack[i])), F.col("bits").cast("long") * F.lit(1 << width * i).cast("long")).otherwise(x), range(len(pack)), F.lit(0).cast("long"))
    pairs = rows.groupBy("src", "dst").agg(*[F.bit_or(put(pack)).alias(f"pack{p}") for p, pack in enumerate(packs)])
    # ends that are null equal nothing
    seen = pairs.groupBy((F.col("src").isNull() | F.col("dst").isNull()).alias("loose"), *[f"pack{p}" for p in range(len(packs))]).agg(F.count("*").alias("n"))
    word = 0 if not kinds else sum(1 << width * i for i in range(in_one))
    levels = F.array(*[F.struct(F.lit(tier).alias("tier"), F.lit(1 << t).cast("long").alias("bit"), F.lit(word << t).cast("long").alias("all")) for t, tier in enumerate([*TIERS, "ALL"])])
    slots = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(width * i).alias("by"), F.lit(k).cast("string").alias("kind")) for p, pack in enumerate(packs) for i, k in enumerate(pack)])
    names = [f"pack{p}" for p in range(len(packs))]
    spread = seen.select("*", F.inline(levels)).select("*", F.inline(slots)).withColumn("own", F.expr(f"shiftright(array({', '.join(names)})[p], by)"))
    set_in = lambda column, bit: F.col(column).bitwiseAND(bit) != 0
    flags = spread.select(
        "tier", "kind", "n", "loose",
        (set_in("own", F.col("bit")) & F.col("kind").isNotNull()).alias("direct"), set_in("own", F.lit(wanted).cast("long")).alias("e"),
        reduce(lambda x, name: x | set_in(name, F.col("all")), names, F.lit(False)).alias("any"),
    )
    a, e = F.when(F.col("kind") == "REFERENCES", F.col("any")).otherwise(F.col("direct")), F.col("e")
    both = a & e & ~F.col("loose")
    n = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    made = flags.groupBy("tier", "kind").agg(n(both).alias("tp"), n(a & ~both).alias("fp"), n(e & ~both).alias("fn"), F.max(F.col("direct") | e).alias("there")).where("there").drop("there")
    whole = made.groupBy("tier").agg(F.lit("overall").alias("kind"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    share = lambda x: F.when(F.col("tp") + F.col(x) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(x)))
    return made.unionByName(whole).withColumns({"precision": share("fp"), "recall": share("fn")})


def hits(included: DataFrame, evidence: DataFrame) -> DataFrame:
    """task, recall, hits by the tier of the first text that names each piece, and distractors named.

    included: task, ordinal, tier (null: unranked), text; evidence: task, name, required.
    """
    found = mentions(included, evidence.select("task", "name"))
    placed = found.join(included.select("task", F.col("ordinal").alias("first"), F.coalesce("tier", F.lit("unranked")).alias("tier"), F.lit(True).alias("hit")), ["task", "first"], "left")
    told = evidence.join(placed.select("task", "name", "tier", F.coalesce("hit", F.lit(False)).alias("hit")), ["task", "name"], "left")
    n = lambda when: F.count(F.when(when, 1))
    required, hit = F.col("required"), F.col("hit")
    tier = lambda t: n(required & hit & (F.col("tier") == t)).alias(t.lower())
    recall = F.when(n(required) == 0, 1.0).otherwise(n(required & hit) / n(required))
    return told.groupBy("task").agg(recall.alias("recall"), *map(tier, [*TIERS, "unranked"]), n(~required & hit).alias("distractors"))
