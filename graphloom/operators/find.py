"""Symbol retrieval: exact names, then trigram full text ranked by BM25."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import symbol_document, under

COLUMNS = ["short_name", "qualified_name", "signature"]


def terms(query: str) -> list[str]:
    """Word runs of at least three characters; shorter ones have no trigram."""
    return [t.lower() for t in re.findall(r"[\w$]+", query) if len(t) >= 3]


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs, overlaps included, ASCII case aside."""
    return F.regexp_count(F.coalesce(F.lower(text), F.lit("")), F.lit(f"(?=\\Q{term}\\E)"))


def full_text(symbol: DataFrame, query: str) -> DataFrame:
    """id and BM25 score (smaller is better) of symbols that have every term in some column."""
    wanted = terms(query)
    if not wanted:
        return symbol.select("id", F.lit(0.0).alias("score")).limit(0)
    length = sum((F.greatest(F.lit(0), F.coalesce(F.length(c), F.lit(0)) - 2) for c in COLUMNS), F.lit(0))
    counts = symbol.select("id", length.alias("d"), *[sum((occurrences(F.col(c), t) for c in COLUMNS), F.lit(0)).alias(f"f{i}") for i, t in enumerate(wanted)])
    whole = counts.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), *[F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"n{i}") for i in range(len(wanted))])
    joined = counts.crossJoin(F.broadcast(whole))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        joined = joined.where(F.col(f"f{i}") > 0)
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        score = score - idf * F.col(f"f{i}") * 2.2 / (F.col(f"f{i}") + 1.2 * (0.25 + 0.75 * F.col("d") / F.col("mean")))
    return joined.select("id", score.alias("score"))


def scoped(symbol: DataFrame, file: DataFrame, kinds: list[str] = (), paths: list[str] = ()) -> DataFrame:
    """Symbols of the kinds and below the path prefixes, with `path`; none given means any."""
    some = symbol.join(file.select(F.col("id").alias("file_id"), "path"), "file_id").where(under(F.col("path"), list(paths)))
    return some.where(F.col("kind").isin(list(kinds))) if kinds else some


def find(symbol: DataFrame, file: DataFrame, query: str, kinds: list[str] = (), paths: list[str] = (), limit: int = 20) -> DataFrame:
    """Symbols in three phases (exact qualified name, exact short name, full text); the first phase of a symbol counts."""
    some = scoped(symbol, file, kinds, paths)
    exact = some.where(F.col("qualified_name") == query).select("id", F.lit(0).alias("phase"), F.lit(0.0).alias("score"))
    short = some.where(F.col("short_name") == query).select("id", F.lit(1).alias("phase"), F.lit(0.0).alias("score"))
    # ranks come from the whole table, as a full-text index has them
    text = full_text(symbol, query).select("id", F.lit(2).alias("phase"), "score")
    best = exact.unionByName(short).unionByName(text).groupBy("id").agg(F.min(F.struct("phase", "score")).alias("b"))
    return best.join(some.select("id", "stable_key", "qualified_name", "kind", "path"), "id").select("id", F.col("b.phase").cast("long").alias("phase"), F.col("b.score").alias("score"), "stable_key", "qualified_name", "kind", "path").orderBy("phase", "score", "stable_key").limit(limit)


def fuse(rankings: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rows (ranking, item, position from 1); ties keep the first seen."""
    return rankings.groupBy("item").agg(F.sum(F.lit(1.0) / (k + F.col("position"))).alias("score"), F.min(F.struct("ranking", "position")).alias("first")).select("item", "score", "first")


def nearest(vectors: DataFrame, query: DataFrame, k: int = 20) -> DataFrame:
    """The k rows (id, vector) nearest to one query row (vector), by cosine."""
    from graphloom.functions.scalars import cosine

    asked = F.broadcast(query.select(F.col("vector").alias("asked")))  # one row
    return vectors.crossJoin(asked).select("id", cosine(F.col("vector"), F.col("asked")).alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def stale(symbol: DataFrame, embedding: DataFrame, model: str) -> DataFrame:
    """Symbols without an embedding of the model."""
    return symbol.join(embedding.where(F.col("model") == model).select(F.col("symbol_id").alias("id")), "id", "left_anti")


def embed(symbol: DataFrame, file: DataFrame, embedding: DataFrame, model: str, embedder: Callable[[list[str]], list[list[float]]], size: int = 64) -> DataFrame:
    """Rows of the embedding table for the symbols that lack one of the model.

    embedder: texts to vectors, at most `size` texts at once; it runs in the executors.
    """
    made = stale(symbol, embedding, model).join(file.select(F.col("id").alias("file_id"), "path"), "file_id")
    documentation = F.col("documentation") if "documentation" in symbol.columns else F.lit(None).cast("string")
    texts = made.select("id", symbol_document(F.col("qualified_name"), F.col("kind"), F.col("path"), F.col("signature"), documentation).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), size):
                some = batch.iloc[a : a + size]
                vectors = embedder(some["text"].tolist())
                hashes = [hashlib.sha256(t.encode()).hexdigest() for t in some["text"]]
                yield pd.DataFrame({"symbol_id": some["id"], "model": model, "dim": [len(v) for v in vectors], "vector": [np.asarray(v, "float32") for v in vectors], "input_hash": hashes})

    return texts.mapInPandas(run, "symbol_id long, model string, dim int, vector array<float>, input_hash string")


def semantic(embedding: DataFrame, query: DataFrame, model: str, k: int = 20) -> DataFrame:
    """The k symbols (id, score) whose vectors of a model are nearest to one query row (vector)."""
    return nearest(embedding.where(F.col("model") == model).select(F.col("symbol_id").alias("id"), "vector"), query, k)


def to_blob(vector: list[float]) -> bytes:
    """A vector as little-endian 32-bit floats, for stores that hold blobs."""
    return np.asarray(vector, "<f4").tobytes()


def from_blob(blob: bytes) -> list[float]:
    return np.frombuffer(blob, "<f4").tolist()


def positions(scored: DataFrame, ranking: str, order: list[Column]) -> DataFrame:
    """A ranking's rows with their positions, for fuse(); partitioned by ranking."""
    return scored.withColumn("ranking", F.lit(ranking)).withColumn("position", F.row_number().over(Window.partitionBy("ranking").orderBy(*order)))
