"""Modules and exports: specifiers, export maps, import bindings."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, in the order in which they are tried.
EXTENSIONS = [".ts", ".tsx", ".d.ts", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"]
ENDINGS = ["", *EXTENSIONS, *(f"/index{e}" for e in EXTENSIONS)]
PASSES = 20


def normalise(path: Column) -> Column:
    """A path without . and .. parts."""
    folded = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda kept, part: F.when(part.isin("", "."), kept).when((part == "..") & (F.size(kept) > 0), F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.concat(kept, F.array(part))),
    )
    return F.array_join(folded, "/")


def _substituted(specifier: Column, pattern: str, target: str) -> Column:
    """The target of an alias with what its `*` stands for; null where the pattern doesn't match."""
    regex = "^" + "(.*)".join(re.escape(p) for p in pattern.split("*")) + "$"
    made = F.lit(target.partition("*")[0])
    if "*" in target:
        star = F.regexp_extract(specifier, regex, 1) if "*" in pattern else F.lit("")
        made = F.concat(*[x for part in target.split("*") for x in (F.lit(part), star)][:-1])
    return F.when(specifier.rlike(regex), made)


def specifiers(refs: DataFrame, file: DataFrame, aliases: dict[str, list[str]] | None = None, base: str | None = None, resolution: str = "bundler", packages: dict[str, str] | None = None) -> DataFrame:
    """ref, path (null: outside) and package of import specifiers.

    refs: ref, path of the importing file, specifier. A specifier that ends in .js, .mjs or
    .cjs is tried without that first, unless `resolution` is node or classic. Relative ones
    are probed beside the file; others by aliases in their order (`prefix/*`, targets below
    the base folder), then below the base folder, then by the exports of workspace packages
    (specifier pattern -> path in the repository). The first file that exists wins. A
    relative specifier without a file is its own package.
    """
    folder = F.regexp_extract("path", "^(.*)/", 1)
    script = F.col("specifier").rlike("\\.(js|mjs|cjs)$")
    stem = F.when(script, F.regexp_replace("specifier", "\\.(js|mjs|cjs)$", ""))
    tried = [F.col("specifier")] if resolution in ("node", "classic") else [stem, F.col("specifier")]
    below = lambda path: F.concat(F.lit(f"{base}/" if base else ""), path)
    roots = []
    for s in tried:
        relative = s.startswith(".")
        roots.append(F.when(relative, F.concat(folder, F.lit("/"), s)))
        roots += [F.when(~relative, below(_substituted(s, pattern, target))) for pattern, targets in (aliases or {}).items() for target in targets]
        if base is not None:
            roots.append(F.when(~relative, below(s)))
    relative = F.col("specifier").startswith(".")
    for pattern, target in (packages or {}).items():
        short = re.sub(r"\.(js|mjs|cjs)$", "", target)
        roots += [F.when(~relative, _substituted(F.col("specifier"), pattern, t)) for t in dict.fromkeys([short, target])]
    probes = F.array(*[F.concat(normalise(r), F.lit(e)) for r in roots for e in ENDINGS])
    ranked = refs.select("ref", F.posexplode(probes).alias("rank", "probe")).where("probe is not null")
    hits = ranked.join(file.select(F.col("path").alias("probe")), "probe").groupBy("ref").agg(F.min_by("probe", "rank").alias("found"))
    package = F.when(relative, F.col("specifier")).when(F.col("specifier").startswith("@"), F.substring_index("specifier", "/", 2)).otherwise(F.substring_index("specifier", "/", 1))
    return refs.join(hits, "ref", "left").select("ref", F.col("found").alias("path"), F.when(F.col("found").isNull(), package).alias("package"))


def package_exports(name: str, root: str, manifest: dict) -> dict[str, str]:
    """Specifier patterns of a workspace package and their paths, from its package.json."""

    def chosen(value) -> str | None:
        if isinstance(value, list):
            return next((c for v in value if (c := chosen(v))), None)
        if isinstance(value, dict):
            return next((c for k in ("types", "import", "default", "node") if (c := chosen(value.get(k)))), None)
        return value if isinstance(value, str) else None

    exports = manifest.get("exports")
    if isinstance(exports, str) or isinstance(exports, dict) and not any(k.startswith(".") for k in exports):
        exports = {".": exports}
    made = {k: c for k, v in (exports or {}).items() if (c := chosen(v))}
    if "." not in made:
        main = next((manifest[k] for k in ("types", "module", "main") if isinstance(manifest.get(k), str)), None)
        made = {".": main, **made} if main else made
    exact = sorted(made, key=lambda k: "*" in k)
    return {name + k[1:]: f"{root}/{made[k][2:]}" for k in exact if made[k].startswith("./")}


def python_modules(refs: DataFrame, file: DataFrame) -> DataFrame:
    """ref, path (null: outside) and package of Python module names.

    refs: ref, path of the importing file, specifier. Leading dots are the file's package and
    its parents. Others are looked for below the import root, the nearest folder upwards that
    is no package, then at the top; a module before a package of the same name.
    """
    parts = F.split("path", "/")
    inits = file.where(F.col("path").endswith("/__init__.py")).select(F.expr("substring(path, 1, length(path) - 12)").alias("folder"), F.lit(True).alias("packaged"))
    depth = F.sequence(F.lit(0), F.size(parts) - 1)
    above = refs.select("ref", "path").withColumn("n", F.explode(depth)).select("ref", "n", F.array_join(F.slice(parts, F.lit(1), F.col("n")), "/").alias("folder"))
    root = above.join(inits, "folder", "left").where("packaged is null").groupBy("ref").agg(F.max_by("folder", "n").alias("root"))
    dots = F.length(F.regexp_extract("specifier", "^\\.*", 0))
    rest = F.regexp_replace(F.expr("substring(specifier, length(regexp_extract(specifier, '^\\\\.*', 0)) + 1)"), "\\.", "/")
    home = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - F.greatest(dots, F.lit(1)))), "/")
    join = lambda *x: F.array_join(F.filter(F.array(*x), lambda p: p != ""), "/")
    both = lambda b: [F.concat(b, F.lit(".py")), F.concat(b, F.lit("/__init__.py"))]
    near = F.when(rest == "", F.array(F.concat(join(home, F.lit("__init__")), F.lit(".py")))).otherwise(F.array(*both(join(home, rest))))
    probes = F.when(dots > 0, near).otherwise(F.array(*both(join(F.col("root"), rest)), *both(rest)))
    ranked = refs.join(root, "ref").select("ref", F.posexplode(probes).alias("rank", "probe"))
    hits = ranked.join(file.select(F.col("path").alias("probe")), "probe").groupBy("ref").agg(F.min_by("probe", "rank").alias("found"))
    package = F.when(dots > 0, F.col("specifier")).otherwise(F.substring_index("specifier", ".", 1))
    return refs.join(hits, "ref", "left").select("ref", F.col("found").alias("path"), F.when(F.col("found").isNull(), package).alias("package"))


def export_map(exports: DataFrame) -> DataFrame:
    """file, name, owner after star and named re-exports reach a fixed point.

    exports: file, name, source (null: local), star, ordinal. A name that a file already has
    is kept; `export *` never hands on `default`. Each pass is one join; at most PASSES.
    """
    from graphloom.sources.store import keep

    direct = exports.where("not star")
    own = direct.groupBy("file", "name").agg(F.max_by(F.coalesce("source", "file"), "ordinal").alias("owner"))
    stars = exports.where("star and source is not null").groupBy("file", "source").agg(F.min("ordinal").alias("ordinal"))
    own = keep(own, "exports")
    for _ in range(PASSES):
        offered = stars.join(own.select(F.col("file").alias("source"), "name", "owner"), "source").where("name <> 'default'")
        fresh = offered.groupBy("file", "name").agg(F.min_by("owner", "ordinal").alias("owner")).join(own, ["file", "name"], "left_anti")
        fresh = keep(fresh, "exports")
        if fresh.isEmpty():
            break
        own = keep(own.unionByName(fresh), "exports")
    else:
        warnings.warn(f"star exports aren't settled after {PASSES} passes; longer chains of them are cut", stacklevel=2)
    named = direct.where("source is not null").select("file", "name", "source", "ordinal")
    for _ in range(PASSES):
        through = named.join(own.select(F.col("file").alias("source"), "name", F.col("owner").alias("far")), ["source", "name"]).groupBy("file", "name").agg(F.max_by("far", "ordinal").alias("far"))
        moved = own.join(through, ["file", "name"], "left")
        if moved.where("far is not null and far <> owner").isEmpty():
            break
        own = keep(moved.select("file", "name", F.coalesce("far", "owner").alias("owner")), "exports")
    else:
        warnings.warn(f"re-exports aren't settled after {PASSES} passes; longer chains of them are cut", stacklevel=2)
    return own


def bound(refs: DataFrame, bindings: DataFrame, exports: DataFrame) -> DataFrame:
    """refs with binding_file, binding_kind, package and the name to look for, by the importing file's bindings.

    refs: file, name, receiver and others. The import that a receiver names owns the binding; a
    namespace import (`*`) is looked up in the export map of its module; a bare name takes the
    original name and file of its import. A reference that no import names is unbound.
    """
    local = F.coalesce("receiver", "name")
    held = bindings.select("file", F.col("local").alias("_local"), F.col("imported").alias("_imported"), F.col("kind").alias("_kind"), F.col("owner").alias("_owner"), F.col("package").alias("_package"))
    joined = refs.withColumn("_local", local).join(held, ["file", "_local"], "left")
    star = F.col("receiver").isNotNull() & (F.col("_imported") == "*")
    offered = exports.select(F.col("file").alias("_owner"), F.col("name").alias("_name"), F.col("owner").alias("_far"))
    joined = joined.withColumn("_name", F.when(star, F.col("name"))).join(offered, ["_owner", "_name"], "left")
    bare = F.col("receiver").isNull() & (F.col("_kind") == "file") & ~F.col("_imported").isin("*", "default")
    kind = F.when(star & (F.col("_kind") == "file"), F.when(F.col("_far").isNotNull(), "file").otherwise("unresolved")).otherwise(F.col("_kind"))
    made = {"binding_kind": kind, "binding_file": F.when(kind == "file", F.coalesce("_far", "_owner")), "package": F.when(kind == "external", F.col("_package")), "name": F.when(bare, F.col("_imported")).otherwise(F.col("name"))}
    return joined.withColumns(made).drop("_local", "_imported", "_kind", "_owner", "_package", "_name", "_far")


def bindings(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """The binding of each local name of a file: the last import of it wins.

    imports: file, local, imported, path (null: outside), package, ordinal.
    """
    last = imports.groupBy("file", "local").agg(F.max_by(F.struct("imported", "path", "package"), "ordinal").alias("i")).select("file", "local", "i.*")
    joined = last.join(exports.select(F.col("file").alias("path"), F.col("name").alias("imported"), "owner"), ["path", "imported"], "left")
    kind = F.when(F.col("path").isNull(), "external").when(F.col("owner").isNotNull() | (F.col("imported") == "*"), "file").otherwise("unresolved")
    return joined.select("file", "local", "imported", kind.alias("kind"), F.when(kind == "file", F.coalesce("owner", "path")).alias("owner"), F.when(kind == "external", F.col("package")).alias("package"))
