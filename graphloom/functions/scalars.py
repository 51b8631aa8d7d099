"""Scalar column functions of the engine; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

USAGE = ["CALLS", "REFERENCES", "IMPLEMENTS", "INHERITS"]
TIERS = ["COMPILER", "LEXICAL", "HEURISTIC"]


def tier_rank(tier: Column) -> Column:
    """0, 1, 2 in order of evidence; 3 for anything else."""
    rank = F.lit(3)
    for i, name in reversed(list(enumerate(TIERS))):
        rank = F.when(tier == name, i).otherwise(rank)
    return rank


def score(distance: int | Column, fan_in: Column, p95: Column, exported: Column, focus: bool = False) -> Column:
    """Closeness, relative fan-in, visibility and focus, in that weight."""
    near = F.lit(0.4) / (F.lit(1) + distance)
    used = F.when(p95 > 0, F.least(F.lit(1.0), F.log1p(fan_in) / F.log1p(p95))).otherwise(0.0)
    return near + 0.25 * used + 0.2 * exported.cast("int") + 0.15 * int(focus)


def module_of(path: Column) -> Column:
    """The directory of a path, `.` at the top."""
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/", 1)).otherwise(".")


def roll_up(module: Column) -> Column:
    """Two parts below src, else one."""
    return F.when(F.substring_index(module, "/", 1) == "src", F.substring_index(module, "/", 2)).otherwise(F.substring_index(module, "/", 1))


def evidence(resolved: Column, heuristic: Column) -> Column:
    return F.when(resolved == 0, "unverified").when(resolved > heuristic, "resolved").otherwise("weak")


def is_product(module: Column) -> Column:
    return (module == "src") | module.startswith("src/")


def has_extension(path: Column, extensions: list[str]) -> Column:
    """Whether a path ends in one of the extensions, ASCII case aside; true for none."""
    found = F.lit(not extensions)
    for e in extensions:
        found = found | F.lower(path).endswith(e.lower())
    return found


def under(path: Column, prefixes: list[str]) -> Column:
    """Whether a path begins with one of the literal prefixes; true for none."""
    found = F.lit(not prefixes)
    for p in prefixes:
        found = found | path.startswith(p)
    return found


def split_identifier(name: Column) -> Column:
    """An identifier's parts, lower-cased, one space between; white space of its own stays."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.trim(F.lower(F.regexp_replace(spaced, "[._\\-/]+", " ")))


def signature(text: Column) -> Column:
    """White space collapsed and trimmed, without a last semicolon."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, "\\s+", " ")), ";$", "")


def owner(qualified: Column) -> Column:
    """The qualified name without its last part; empty for a single part."""
    return F.when(qualified.contains("."), F.regexp_extract(qualified, "^(.*)\\.", 1)).otherwise("")


def last_part(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", -1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double; 0 if a norm is 0; raises on unequal lengths."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    product = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norm = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    value = F.when(norm == 0, 0.0).otherwise(product(a, b) / norm)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).otherwise(value)


def tokens(text: Column) -> Column:
    """An estimate of a text's tokens: a quarter of its UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def disposition(external: Column, unresolved_binding: Column, candidates: Column, receiver: Column, file_binding: Column, narrowed: Column, sdk: Column, cap: int = 8) -> Column:
    """The tier of a reference with `candidates` symbols; the branches' order matters."""
    return (
        F.when(external, "EXTERNAL")
        .when(unresolved_binding, "UNRESOLVED")
        .when(candidates == 0, F.when(sdk, "EXTERNAL").otherwise("UNRESOLVED"))
        .when(receiver, F.when(candidates > cap, "UNRESOLVED").otherwise("HEURISTIC"))
        .when(file_binding, "LEXICAL")
        .when((candidates == 1) & ~narrowed, "LEXICAL")
        .when(candidates > cap, "UNRESOLVED")
        .otherwise("HEURISTIC")
    )


def symbol_document(qualified: Column, kind: Column, path: Column, signature: Column, documentation: Column) -> Column:
    """The text that stands for a symbol in a vector index: its name, the name's and the path's words, and what is known besides, a line each."""
    parts = F.array(qualified, split_identifier(qualified), kind, split_identifier(F.regexp_replace(path, "\\.[^.]+$", "")), F.coalesce(signature, F.lit("")), F.coalesce(documentation, F.lit("")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def by_tier(tier: Column, n: Column) -> Column:
    """An aggregate: a map of the three tiers to sums, 0 for a tier without rows."""
    return F.map_from_entries(F.array(*[F.struct(F.lit(t), F.coalesce(F.sum(F.when(tier == t, n)), F.lit(0)).cast("long")) for t in TIERS]))
