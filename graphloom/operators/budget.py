"""Packing of answers into a token budget, envelopes, and checks of bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import tokens


def pack(sections: DataFrame, budget: int, size: Column | None = None) -> DataFrame:
    """Which sections of an answer fit; sections: answer, ordinal, priority, text.

    In order of priority, then ordinal. A section that doesn't fit is skipped and later ones
    may still be taken; priority 0 is always taken. The two line ends between sections count.
    One answer's sections are folded as one array (an answer has some hundred rows at most).
    """
    cost = tokens(F.col("text")) if size is None else size
    item = F.struct("priority", "ordinal", cost.alias("cost"))
    listed = sections.groupBy("answer").agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<ordinal:long,taken:boolean>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        total = state["used"] + x["cost"] + F.when(state["used"] > 0, 1).otherwise(0)
        take = (x["priority"] == 0) | (total <= budget)
        row = F.struct(x["ordinal"].cast("long").alias("ordinal"), take.alias("taken"))
        return F.struct(F.when(take, total).otherwise(state["used"]).cast("long").alias("used"), F.concat(state["out"], F.array(row)).alias("out"))

    done = listed.select("answer", F.aggregate("items", start, step).alias("r"))
    return done.select("answer", F.col("r.used").alias("used"), F.explode("r.out").alias("s")).select("answer", F.col("s.ordinal").alias("ordinal"), F.col("s.taken").alias("taken"), "used")


def envelope(rows: DataFrame, summary: str, freshness: str, truncated: bool, warnings: list[str] = ()) -> DataFrame:
    """One row: the JSON of a response. Freshness and truncation add their own warnings, once."""
    auto = [*(["the index is partial"] if freshness == "partial" else []), *(["results were cut"] if truncated else [])]
    told = list(dict.fromkeys([*warnings, *auto]))
    results = rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("results"))
    return results.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit(freshness).alias("freshness"), F.lit(summary).alias("summary"), "results", F.array(*map(F.lit, told)).cast("array<string>").alias("warnings"))).alias("json"))


def verified(symbol: DataFrame, bodies: DataFrame) -> DataFrame:
    """id and whether its stored hash is that of its bytes. symbol: id, file, start, end, body_hash; bodies: file, content (binary)."""
    body = F.expr("substring(content, start + 1, end - start)")
    valid = (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.octet_length("content")) & F.col("body_hash").isNotNull()
    return symbol.join(bodies, "file", "left").select("id", F.coalesce(valid & (F.sha2(body, 256) == F.col("body_hash")), F.lit(False)).alias("verified"))
