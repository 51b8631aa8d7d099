"""References to edges: candidates, tiers, derived edges, promotion by outside evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import disposition, last_part, owner

CAP = 8


def tiers(refs: DataFrame, symbol: DataFrame, sdk: list[str] = ()) -> DataFrame:
    """Each reference with `n`, the number of its candidates, `all`, that before narrowing, and its tier.

    refs: ref, src, src_file, name, kind, site_line, receiver, and optional binding_file,
    binding_kind (file, external, unresolved), receiver_type, module and imported (modules).
    symbol: id, short_name, file_id, visibility, qualified_name and optional module. Narrowing
    drops private symbols of other files; for a reference without receiver those of modules
    that are neither its own nor imported; and where the receiver's type is known members of
    other owners. Symbols are counted by name and what decides before they meet the
    references, so a common name isn't multiplied out.
    """
    known = symbol if "module" in symbol.columns else symbol.withColumn("module", F.lit(None).cast("string"))
    for c, kind in (("module", "string"), ("imported", "array<string>")):
        refs = refs if c in refs.columns else refs.withColumn(c, F.lit(None).cast(kind))
    hidden = F.coalesce(F.col("visibility").isin("private", "fileprivate"), F.lit(False))
    each = known.select(F.col("short_name").alias("_name"), F.col("file_id").alias("dst_file"), F.col("module").alias("dst_module"), hidden.alias("hidden"), last_part(owner(F.col("qualified_name"))).alias("tail"))
    kinds = lambda rows, *by: rows.groupBy("_name", *by).agg(F.count("*").alias("copies"))
    named, shown, own = F.col("name") == F.col("_name"), each.where("not hidden"), each.where("hidden")
    open_, typed = refs.where("coalesce(binding_kind, 'file') = 'file'"), F.col("receiver").isNotNull() & F.col("receiver_type").isNotNull()
    bound, free = open_.where("binding_file is not null"), open_.where("binding_file is null")
    n, none = F.col("copies").alias("n"), F.lit(0).cast("long")
    # each join is on the name and what else must be equal, so a name costs no more rows than it has modules
    parts = [
        bound.join(kinds(each, "dst_file", "dst_module", "hidden", "tail"), named & (F.col("binding_file") == F.col("dst_file"))).select("ref", F.when(_kept(), F.col("copies")).otherwise(0).alias("n"), F.col("copies").alias("all")),
        free.join(kinds(each), named).select("ref", none.alias("n"), F.col("copies").alias("all")),
        free.where(typed).join(kinds(shown, "tail"), named & (last_part(F.col("receiver_type")) == F.col("tail"))).select("ref", n, none.alias("all")),
        free.where(F.col("receiver").isNotNull() & F.col("receiver_type").isNull()).join(kinds(shown), named).select("ref", n, none.alias("all")),
        free.where("receiver is null").join(kinds(shown, "dst_module"), named).where(~_away()).select("ref", n, none.alias("all")),
        free.join(kinds(own, "dst_file", "dst_module", "hidden", "tail"), named & (F.col("src_file") == F.col("dst_file"))).where(_kept()).select("ref", n, none.alias("all")),
    ]
    summed = reduce(DataFrame.unionAll, parts).groupBy("ref").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    counts = refs.select("ref").join(summed, "ref", "left").select("ref", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("all", F.lit(0)).alias("all"))
    tier = disposition(
        F.coalesce(F.col("binding_kind") == "external", F.lit(False)), F.coalesce(F.col("binding_kind") == "unresolved", F.lit(False)), F.col("n"), F.col("receiver").isNotNull(),
        F.coalesce(F.col("binding_kind") == "file", F.lit(False)), F.col("n") < F.col("all"), F.col("name").isin(list(sdk)) if sdk else F.lit(False), CAP,
    )
    return refs.join(counts, "ref").withColumn("tier", tier)


def _open(refs: DataFrame, file: Column) -> Column:
    """Whether a reference may have candidates in a file, by its binding."""
    return F.coalesce(refs.binding_file == file, F.lit(True)) & F.coalesce(refs.binding_kind == "file", refs.binding_kind.isNull(), F.lit(True))


def _away() -> Column:
    """Whether a candidate's module (dst_module) is neither the reference's own nor imported, which matters without a receiver."""
    other = F.col("dst_module").isNotNull() & (F.col("dst_module") != F.col("module")) & ~F.coalesce(F.array_contains("imported", F.col("dst_module")), F.lit(False))
    return F.col("receiver").isNull() & F.coalesce(other, F.lit(False))


def _kept() -> Column:
    """Whether narrowing leaves a candidate, given as dst_file, dst_module, hidden and tail beside the reference."""
    private = F.col("hidden") & (F.col("dst_file") != F.col("src_file"))
    foreign = F.col("receiver").isNotNull() & F.col("receiver_type").isNotNull() & ~F.coalesce(F.col("tail") == last_part(F.col("receiver_type")), F.lit(False))
    return F.col("dst_file").isNotNull() & ~F.coalesce(private, F.lit(False)) & ~_away() & ~foreign


def candidates(refs: DataFrame, symbol: DataFrame, sdk: list[str] = ()) -> DataFrame:
    """tiers() with the candidates (dst) of references that become edges: at most CAP rows each, others one with dst null."""
    placed = tiers(refs, symbol, sdk)
    known = symbol if "module" in symbol.columns else symbol.withColumn("module", F.lit(None).cast("string"))
    hidden = F.coalesce(F.col("visibility").isin("private", "fileprivate"), F.lit(False))
    each = known.select(F.col("id").alias("dst"), F.col("short_name").alias("_name"), F.col("file_id").alias("dst_file"), F.col("module").alias("dst_module"), hidden.alias("hidden"), last_part(owner(F.col("qualified_name"))).alias("tail"))
    linked = placed.where(F.col("tier").isin("LEXICAL", "HEURISTIC"))
    some = linked.join(each, (linked.name == F.col("_name")) & _open(linked, F.col("dst_file"))).where(_kept()).select(*placed.columns, "dst")
    rest = placed.where(~F.col("tier").isin("LEXICAL", "HEURISTIC")).withColumn("dst", F.lit(None).cast("long"))
    return some.unionByName(rest).withColumn("confidence", F.when(F.col("tier") == "HEURISTIC", F.lit(1.0) / F.col("n")).when(F.col("tier") == "LEXICAL", 1.0))


def split(placed: DataFrame, failed: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, external refs and unresolved refs of candidates().

    failed, removed: names of symbols in files that no longer parse, and of deleted ones; a
    removed name is unresolved even if it would be external. No reference is lost.
    """
    lost = placed.join(removed.select("name", F.lit(True).alias("removed")).distinct(), "name", "left").join(failed.select("name", F.lit(True).alias("failed")).distinct(), "name", "left")
    edges = lost.where(F.col("tier").isin("LEXICAL", "HEURISTIC")).select("src", "dst", "kind", "tier", "confidence", "site_line")
    rest = lost.where(F.col("tier").isin("EXTERNAL", "UNRESOLVED")).dropDuplicates(["ref"])
    gone = F.coalesce(F.col("removed"), F.lit(False))
    outside = rest.where((F.col("tier") == "EXTERNAL") & ~gone).select("src", "name", "package", "site_line")
    reason = (
        F.when((F.col("n") > CAP), "too_ambiguous").when(F.coalesce(F.col("failed"), F.lit(False)), "parse_failed").when(gone, "target_removed")
        .when(F.col("binding_kind") == "unresolved", F.coalesce("binding_reason", F.lit("binding_target_missing"))).otherwise("no_candidate")
    )
    missing = rest.where((F.col("tier") == "UNRESOLVED") | gone).select("src", "name", "kind", "site_line", F.col("n").alias("candidates"), reason.alias("reason"))
    return edges, outside, missing


def containment(symbol: DataFrame) -> DataFrame:
    """CONTAINS edges: the symbol of the same file with the parent's qualified name, else the file's own symbol."""
    child = symbol.where("kind <> 'file'").select(F.col("id").alias("dst"), "file_id", owner(F.col("qualified_name")).alias("parent"))
    named = symbol.where("kind <> 'file'").groupBy("file_id", F.col("qualified_name").alias("parent")).agg(F.min("id").alias("by_name"))
    top = symbol.where("kind = 'file'").select("file_id", F.col("id").alias("by_file"))
    joined = child.join(named, ["file_id", "parent"], "left").join(top, "file_id", "left")
    return joined.select(F.coalesce("by_name", "by_file").alias("src"), "dst", F.lit("CONTAINS").alias("kind")).where("src is not null")


def members(edge: DataFrame, symbol: DataFrame) -> DataFrame:
    """IMPLEMENTS edges between members of the same name of related types."""
    held = edge.where("kind = 'CONTAINS'").join(symbol.select(F.col("id").alias("dst"), F.col("short_name").alias("name")), "dst").select(F.col("src").alias("type"), F.col("dst").alias("member"), "name")
    pairs = edge.where(F.col("kind").isin("IMPLEMENTS", "INHERITS")).select(F.col("src").alias("below"), F.col("dst").alias("above"), "site_line")
    below = held.select(F.col("type").alias("below"), F.col("member").alias("src"), "name")
    above = held.select(F.col("type").alias("above"), F.col("member").alias("dst"), "name")
    return pairs.join(below, "below").join(above, ["above", "name"]).where("src <> dst").groupBy("src", "dst").agg(F.min("site_line").alias("site_line")).withColumns({"kind": F.lit("IMPLEMENTS"), "tier": F.lit("LEXICAL"), "confidence": F.lit(1.0)})


def imports(refs: DataFrame) -> DataFrame:
    """One IMPORTS edge for each pair of files, at the first site; refs: src, dst, ordinal, site_line."""
    return refs.where("src <> dst").groupBy("src", "dst").agg(F.min_by("site_line", "ordinal").alias("site_line"))


def insert_absent(edge: DataFrame, new: DataFrame, by_line: bool = False) -> DataFrame:
    """edge and the new edges whose pair (or pair and line) it lacks."""
    keys = ["src", "dst", "kind", *["site_line"] * by_line]
    same = [edge[k].eqNullSafe(new[k]) for k in keys]
    return edge.unionByName(new.join(edge.select(*keys), same, "left_anti"))


def promote(edge: DataFrame, unresolved: DataFrame, proof: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raise edges that outside evidence (src, dst, kind, name) proves to COMPILER, add missing ones, and drop the unresolved names."""
    pairs = proof.where("src <> dst").select("src", "dst", "kind").distinct().withColumn("proved", F.lit(True))
    raised = edge.join(pairs, ["src", "dst", "kind"], "left").select("src", "dst", "kind", F.when(F.col("proved"), "COMPILER").otherwise(F.col("tier")).alias("tier"), F.when(F.col("proved"), 1.0).otherwise(F.col("confidence")).alias("confidence"), "site_line")
    fresh = pairs.join(edge, ["src", "dst", "kind"], "left_anti").select("src", "dst", "kind", F.lit("COMPILER").alias("tier"), F.lit(1.0).alias("confidence"), F.lit(None).cast("long").alias("site_line"))
    return raised.unionByName(fresh), unresolved.join(proof.select("src", "name").distinct(), ["src", "name"], "left_anti")


def settle_sites(edge: DataFrame, proof: DataFrame) -> DataFrame:
    """Site-exact evidence (src, kind, site_line, dst; dst null: outside) removes competing HEURISTIC edges and raises the proved one."""
    sites = proof.select("src", "kind", "site_line").distinct().withColumn("known", F.lit(True))
    hits = proof.where("dst is not null").select("src", "kind", "site_line", "dst").distinct().withColumn("proved", F.lit(True))
    keys = ["src", "kind", "site_line"]
    joined = edge.join(sites, keys, "left").join(hits, [*keys, "dst"], "left")
    kept = joined.where(~(F.coalesce("known", F.lit(False)) & ~F.coalesce("proved", F.lit(False)) & (F.col("tier") == "HEURISTIC")))
    return kept.select("src", "dst", "kind", F.when(F.col("proved"), "COMPILER").otherwise(F.col("tier")).alias("tier"), F.when(F.col("proved"), 1.0).otherwise(F.col("confidence")).alias("confidence"), "site_line")


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The innermost span of each point (file, at): the latest start with start <= at < end.

    A range join without a cross product: spans open and close as events in one ordered
    pass by file would need state, so spans are dealt into buckets that they cover instead.
    """
    width = 4096
    bucket = lambda c: F.floor(F.col(c) / width)
    dealt = spans.withColumn("bucket", F.explode(F.sequence(bucket("start"), F.floor((F.col("end") - 1) / width))))
    joined = points.withColumn("bucket", bucket("at")).join(dealt, ["file", "bucket"]).where("start <= at and at < end")
    return joined.groupBy("file", "at").agg(F.max_by("key", F.struct("start", -F.col("end"))).alias("key"))


def as_of(points: DataFrame, bindings: DataFrame, width: int = 4096) -> DataFrame:
    """The latest binding (owner, name, start, type) at or before each point (owner, name, at).

    Rows of a key are dealt into stretches of `width`, so that a hot key isn't one task; what
    the last stretch with a binding ends with is carried over.
    """
    keys = ["owner", "name"]
    rows = bindings.select(*keys, F.col("start").alias("at"), "type", F.lit(0).alias("side")).unionByName(points.select(*keys, "at", F.lit(None).cast("string").alias("type"), F.lit(1).alias("side")))
    rows = rows.withColumn("stretch", F.floor(F.col("at") / width))
    near = F.last("type", ignorenulls=True).over(Window.partitionBy(*keys, "stretch").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.groupBy(*keys, "stretch").agg(F.max_by("type", F.when(F.col("type").isNotNull(), F.col("at"))).alias("end"))
    carried = F.last("end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    told = ends.withColumn("carried", carried).select(*[F.col(k).alias(f"_{k}") for k in [*keys, "stretch"]], "carried")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "stretch"]]
    return rows.withColumn("near", near).where("side = 1").join(told, same).select(*keys, "at", F.coalesce("near", "carried").alias("type"))


def collision_keys(rows: DataFrame) -> DataFrame:
    """Unique keys for symbols that share a base key: the signature's hash, then an ordinal."""
    whole = Window.partitionBy("base")
    tagged = rows.withColumns({"n": F.count("*").over(whole), "hash": F.substring(F.sha2("signature", 256), 1, 8)})
    tagged = tagged.withColumn("k", F.row_number().over(Window.partitionBy("base", "hash").orderBy("start")))
    key = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("~"), "hash", F.when(F.col("k") > 1, F.concat(F.lit("~"), F.col("k").cast("string"))).otherwise("")))
    return tagged.select(*rows.columns, key.alias("stable_key"))


def heuristic_sites(edge: DataFrame, symbol: DataFrame) -> DataFrame:
    """Distinct (src, site_line, name, kind) of edges without proof; name: the target's."""
    names = symbol.select(F.col("id").alias("dst"), F.col("short_name").alias("name"))
    return edge.where("tier = 'HEURISTIC'").join(names, "dst").select("src", "site_line", "name", "kind").distinct()


def query_sites(refs: DataFrame, unresolved: DataFrame, heuristic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The places to ask a compiler about, and the number of sites without a line.

    refs: src, site_line, name, kind, column, ordinal, as extracted now; the first of a (src,
    site_line, name) that has a column counts. unresolved, heuristic: src, site_line, name.
    Returns src, site_line, name, kind, column and was_unresolved.
    """
    keys = ["src", "site_line", "name"]
    sites = unresolved.select(*keys, F.lit(True).alias("u")).unionByName(heuristic.select(*keys, F.lit(False).alias("u")))
    wanted = sites.where("site_line is not null").groupBy(*keys).agg(F.max("u").alias("was_unresolved"))
    first = refs.where("column is not null").groupBy(*keys).agg(F.min_by(F.struct("kind", "column"), "ordinal").alias("r")).select(*keys, "r.*")
    return first.join(wanted, keys), sites.where("site_line is null").agg(F.count("*").alias("skipped"))


def declared_at(places: DataFrame, symbol: DataFrame) -> DataFrame:
    """places (file_id, line) with `id`, the symbol with the smallest span that begins there, the first of equal ones."""
    best = symbol.groupBy("file_id", F.col("start_line").alias("line")).agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), F.col("start_byte"), "id")).alias("b"))
    return places.join(best.select("file_id", "line", "b.id"), ["file_id", "line"], "left")


def settle(edge: DataFrame, external: DataFrame, unresolved: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tables after a compiler's answers, and one row of counts.

    answers: src, name, kind, site_line, dst (null: outside, then package), was_unresolved. An
    answer removes the competing HEURISTIC edges of its site, proves or adds its own edge or
    external reference, and clears the unresolved rows of its source and name, whatever their
    line; those beyond the answered ones are counted as extra.
    """
    inside = answers.where("dst is not null")
    settled = settle_sites(edge, answers.select("src", "kind", "site_line", "dst"))
    fresh = inside.select("src", "dst", "kind", F.lit("COMPILER").alias("tier"), F.lit(1.0).alias("confidence"), "site_line").distinct()
    outside = answers.where("dst is null").select("src", "name", "package", "site_line")
    groups = answers.where("was_unresolved").groupBy("src", "name").agg(F.count("*").alias("expected"))
    removed = unresolved.join(groups, ["src", "name"]).groupBy("src", "name", "expected").agg(F.count("*").alias("removed"))
    extra = removed.agg(F.coalesce(F.sum("removed"), F.lit(0)).alias("unresolved_cleared"), F.coalesce(F.sum(F.greatest(F.lit(0), F.col("removed") - F.col("expected"))), F.lit(0)).alias("extra_cleared"))
    done = answers.agg(F.count("dst").alias("upgraded"), F.count(F.when(F.col("dst").isNull(), 1)).alias("externalized"))
    left = unresolved.join(groups, ["src", "name"], "left_anti")
    return insert_absent(settled, fresh, by_line=True), external.unionByName(outside), left, done.crossJoin(extra)  # one row each


def unresolved_report(unresolved: DataFrame, names: int = 10) -> DataFrame:
    """reason, n, its share of all, and its most frequent names."""
    by_name = unresolved.groupBy("reason", "name").agg(F.count("*").alias("n"))
    top = by_name.withColumn("r", F.row_number().over(Window.partitionBy("reason").orderBy(F.desc("n"), "name"))).where(F.col("r") <= names)
    listed = top.groupBy("reason").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("names"))  # `names` a reason
    counts = by_name.groupBy("reason").agg(F.sum("n").alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"))
    return counts.join(listed, "reason").crossJoin(F.broadcast(whole)).select("reason", "n", (F.col("n") / F.col("whole")).alias("share"), "names")  # one row
