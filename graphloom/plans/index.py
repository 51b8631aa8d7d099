"""The index build: scanned files to the tables of a graph, and keeping them fresh."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import drift, link, resolve
from graphloom.sources.extract import LANGUAGES, extracted, language
from graphloom.sources.store import Store, duplicates, keep

EXTRACTOR = "1"


@dataclass
class Config:
    """How a repository's module names are resolved."""

    aliases: dict[str, list[str]] = field(default_factory=dict)
    base: str | None = None
    resolution: str = "bundler"
    packages: dict[str, str] = field(default_factory=dict)
    sdk: list[str] = field(default_factory=list)


def tables(files: DataFrame, config: Config = Config(), languages=LANGUAGES) -> dict[str, DataFrame]:
    """All tables of the graph of files (path, content, and optional size, mtime, hash).

    Extraction is one pass over the files; ids are given once, when its rows are written.
    References meet candidates by name after these were counted, imports and exports by
    module. Every reference ends as an edge, an external or an unresolved reference.
    """
    made = keep(extracted(files, languages), "extracted")
    stat = files.select("path", *[F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("mtime", "double"), ("hash", "string"))])
    file = keep(made.join(stat, "path").select(F.monotonically_increasing_id().alias("id"), "path", "language", F.col("hash").alias("content_hash"), F.col("mtime").alias("mtime_ms"), "size", F.when(F.col("state") == "ok", "ok").otherwise("failed").alias("parse_state"), F.lit(None).cast("string").alias("diagnostics"), F.current_timestamp().alias("indexed_at")), "file")
    ids = file.select("path", F.col("id").alias("file_id"))
    prefix = F.coalesce(*[F.when(F.col("language") == name, p) for name, _, p, _ in languages])
    listed = made.join(ids, "path")
    whole = listed.select("file_id", F.concat(prefix, F.lit(":"), F.col("path"), F.lit("#")).alias("stable_key"), F.col("path").alias("qualified_name"), F.col("path").alias("short_name"), F.lit("file").alias("kind"))
    inner = listed.select("file_id", F.explode("symbols").alias("s")).select("file_id", "s.*")
    symbol = keep(inner.unionByName(whole, allowMissingColumns=True).withColumns({"id": F.monotonically_increasing_id(), "exported": F.coalesce("exported", F.lit(False)), "is_test": F.coalesce("is_test", F.lit(False))}), "symbol")
    if clash := duplicates(symbol).first():
        raise ValueError(f"stable key {clash.stable_key} occurs {clash['count']} times")

    # modules: what each import means, and what each file exports
    raw = listed.select("path", "language", F.posexplode("imports").alias("ordinal", "i")).select("path", "language", F.col("ordinal").cast("long").alias("ordinal"), "i.*")
    sourced = listed.select("path", "language", F.posexplode("exports").alias("ordinal", "e")).select("path", "language", F.col("ordinal").cast("long").alias("ordinal"), "e.*")
    asked = raw.select("path", "language", "specifier").union(sourced.where("source is not null").select("path", "language", F.col("source").alias("specifier"))).distinct()
    asked = asked.withColumn("ref", F.struct("path", "specifier"))
    script = link.specifiers(asked.where("language <> 'python'").select("ref", "path", "specifier"), file, config.aliases, config.base, config.resolution, config.packages)
    place = script.union(link.python_modules(asked.where("language = 'python'").select("ref", "path", "specifier"), file))
    place = keep(place.select("ref.path", "ref.specifier", F.col("path").alias("target"), "package"), "modules")
    target = place.select("path", F.col("specifier").alias("source"), "target")
    reexport = sourced.join(target, ["path", "source"], "left").where("source is null or target is not null")
    rows = reexport.select(F.col("path").alias("file"), F.col("exported").alias("name"), F.col("target").alias("source"), "star", "ordinal")
    modules = inner.join(ids, "file_id").join(made.where("language = 'python'").select("path"), "path", "left_semi").where(~F.col("qualified_name").contains("."))
    exports = link.export_map(rows).unionByName(modules.select(F.col("path").alias("file"), F.col("short_name").alias("name"), F.col("path").alias("owner")).distinct())
    named = raw.join(place, ["path", "specifier"])
    bound = link.bindings(named.select(F.col("path").alias("file"), "local", "imported", F.col("target").alias("path"), "package", "ordinal"), exports)

    # references: each with its source, what its name is bound to, its candidates and its fate
    refs = listed.select("path", "file_id", F.explode("refs").alias("r")).select(F.col("path").alias("file"), F.col("file_id").alias("src_file"), "r.*").withColumn("ref", F.monotonically_increasing_id())
    refs = keep(refs.join(symbol.select(F.col("stable_key").alias("from_key"), F.col("id").alias("src")), "from_key"), "refs")
    meant = link.bound(refs, bound, exports)
    meant = meant.join(file.select(F.col("path").alias("binding_file"), F.col("id").alias("_file")), "binding_file", "left").drop("binding_file").withColumnRenamed("_file", "binding_file")
    # a Swift file belongs to the module of its target, and imports modules, not names
    module = lambda path: F.when(F.col(path).endswith(".swift"), F.nullif(F.regexp_extract(path, "(?:^|/)(?:Sources|Tests)/([^/]+)/", 1), F.lit("")))
    modules_of = raw.where("language = 'swift'").groupBy(F.col("path").alias("file")).agg(F.collect_set("specifier").alias("imported"))  # the imports of one file
    meant = meant.join(modules_of, "file", "left").withColumn("module", module("file"))
    known = symbol.where("kind <> 'file'").join(ids.withColumn("module", module("path")).drop("path"), "file_id")
    placed = keep(resolve.candidates(meant, known, config.sdk).withColumn("binding_reason", F.lit(None).cast("string")), "placed")
    failed = listed.where("state <> 'ok'").join(raw.groupBy("path").agg(F.lit(1).alias("x")), "path", "left_semi").select(F.col("path").alias("name"))
    edges, outside, missing = resolve.split(placed, failed, failed.limit(0))

    # edges that follow from the declarations and imports themselves
    line = lambda df: df.select("src", "dst", "kind", F.lit("LEXICAL").alias("tier"), F.lit(1.0).alias("confidence"), "site_line" if "site_line" in df.columns else F.lit(None).cast("int").alias("site_line"))
    tops = symbol.where("kind = 'file'").join(ids, "file_id").select("path", F.col("id").alias("top"))
    sites = named.where("target is not null").join(tops.withColumnRenamed("top", "src"), "path").join(tops.select(F.col("path").alias("target"), F.col("top").alias("dst")), "target")
    contains = line(resolve.containment(symbol))
    imported = line(resolve.imports(sites.select("src", "dst", "ordinal", "site_line")).withColumn("kind", F.lit("IMPORTS")))
    base = keep(edges.where("src <> dst").select("src", "dst", "kind", "tier", "confidence", F.col("site_line").cast("int").alias("site_line")).unionByName(contains).unionByName(imported), "edges")
    related = resolve.members(base, symbol.select("id", "short_name"))
    edge = resolve.insert_absent(base, related.select("src", "dst", "kind", "tier", "confidence", F.col("site_line").cast("int").alias("site_line")))
    return {"file": file, "symbol": symbol, "edge": edge.withColumn("extractor_version", F.lit(EXTRACTOR)), "external_ref": outside, "unresolved_ref": missing.withColumn("candidates", F.col("candidates").cast("int"))}


def snapshot(file: DataFrame) -> DataFrame:
    """What drift compares: path, size, mtime, hash of a file table."""
    return file.select("path", "size", F.col("mtime_ms").alias("mtime"), F.col("content_hash").alias("hash"))


def build(files: DataFrame, store: Store, config: Config = Config(), languages=LANGUAGES) -> dict[str, int]:
    """Write the graph of files to a store, and count its files by what an incremental run would say of them.

    Everything is extracted and linked anew, as one changed file may move any reference;
    unchanged files count as skipped. Embeddings of symbols that stay are kept by stable key.
    """
    seen = files.where(language(F.col("path"), languages).isNotNull())
    now = seen.select("path", *[F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("mtime", "double"), ("hash", "string"))])
    stats = drift.statistics(drift.changes(snapshot(store.read("file")), now)).first().asDict()
    made = {name: keep(df, name) for name, df in tables(files, config, languages).items()}
    old = store.read("symbol").select(F.col("id").alias("symbol_id"), "stable_key")
    vectors = store.read("embedding").join(old, "symbol_id").drop("symbol_id").join(made["symbol"].select("stable_key", F.col("id").alias("symbol_id")), "stable_key")
    made["embedding"] = keep(vectors.select("symbol_id", "model", "dim", "vector", "input_hash"), "embedding")
    for name, df in made.items():
        store.write(name, df)
    return stats


@dataclass
class State:
    """What a reader is told of the tables that it reads."""

    freshness: str
    drifted: int = 0
    verified: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def ensure_fresh(store: Store, scan: Callable[[], DataFrame], refresh: Callable[[], object], limit: int = drift.REFRESH_LIMIT) -> State:
    """Before a read: rebuild a store that drifted by at most `limit` files, and look again.

    scan: the present files (path, size, mtime, hash). A store that drifted further, has files
    that failed to parse, or drifts again meanwhile is partial; compiler edges that the
    rebuild lost are told.
    """

    def look() -> tuple[str, int, list[str]]:
        changed = keep(drift.changes(snapshot(store.read("file")), scan()).where("state <> 'same'"), "changes")
        row = drift.freshness(changed, store.read("file"), limit).first()
        return row.freshness, row.drifted, [r.path for r in changed.where("state <> 'deleted'").orderBy("path").limit(limit).collect()]

    state, drifted, paths = look()
    if state == "fresh":
        return State("fresh")
    if state == "partial":
        return State("partial", drifted, [], [f"{drifted} files drifted or some failed to parse; the index is partial"])
    proved = store.read("edge").where("tier = 'COMPILER'").limit(1).count()
    refresh()
    again, left, _ = look()
    told = ["the index was refreshed before this read"]
    if proved and not store.read("edge").where("tier = 'COMPILER'").limit(1).count():
        told.append("compiler edges were lost by the refresh; run the compiler pass again")
    if again != "fresh":
        return State("partial", left, [], [*told, f"{left} files still drifted after the refresh"])
    return State("refreshed", drifted, paths, told)


def pretty(value: object) -> str:
    """A response as JSON, two spaces a level."""
    return json.dumps(value, indent=2, ensure_ascii=False, default=str)
