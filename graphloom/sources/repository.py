"""Source trees as tables: scan, ignore rules, configuration."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The source files that are read, and the folders that never are (the engine's own among them).
EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".swift", ".py", ".pyi"]
ALWAYS_IGNORED = [".git", "node_modules", ".graphloom", "dist", "build", "out", ".next", ".turbo", "coverage", "__pycache__", ".venv"]


def rule(pattern: str) -> tuple[str, bool]:
    """A gitignore-like line as a regular expression over relative paths, and whether it re-includes."""
    negated = pattern.startswith("!")
    body = pattern[negated:]
    folder, body = body.endswith("/"), body.rstrip("/")
    anchored = "/" in body
    regex = ""
    for part in re.findall(r"\*\*/?|\*|\?|\[!?[^\]]+\]|.", body.lstrip("/"), re.S):
        if part.startswith("**"):
            regex += "(?:.*/)?" if part == "**/" else ".*"
        elif len(part) > 2 and part.startswith("["):
            regex += "[" + ("^" if part[1] == "!" else "") + part[1 + (part[1] == "!") : -1].replace("\\", "\\\\") + "]"
        else:
            regex += {"*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    # a rule for a folder is one for what is below it
    return ("^" if anchored else "(^|/)") + regex + ("/" if folder else "(/|$)"), negated


def ignored(path: Column, lines: list[str]) -> Column:
    """The last rule that matches decides."""
    state = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ALWAYS_IGNORED)))
    found = F.lit(False)
    for line in lines:
        if line.strip() and not line.startswith("#"):
            regex, negated = rule(line.strip())
            found = F.when(path.rlike(regex), F.lit(not negated)).otherwise(found)
    return state | found


def contained(root: str, path: str) -> str:
    """`path` below root; raises for escapes and NUL."""
    import posixpath

    if "\0" in path or posixpath.normpath(posixpath.join("/r", path)).split("/")[1:2] != ["r"] or path.startswith("/"):
        raise ValueError(f"{path!r} leaves {root!r}")
    return posixpath.join(root, path)


def listed(root: str) -> Iterator[tuple[str, int, float]]:
    """path below root, size and time in milliseconds of each file; no links, nothing below folders that are always ignored."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root))
    base, local = base.rstrip("/"), system.type_name == "local"
    folders = [base]
    while folders:
        for info in system.get_file_info(fs.FileSelector(folders.pop())):
            if local and os.path.islink(info.path):
                continue
            if info.type == fs.FileType.Directory:
                if info.base_name not in ALWAYS_IGNORED:
                    folders.append(info.path)
            elif info.type == fs.FileType.File:
                yield info.path[len(base) + 1 :], info.size, info.mtime.timestamp() * 1000


def scan(spark: SparkSession, root: str, ignore: list[str] = (), most: int = 2_000_000) -> DataFrame:
    """path, size, mtime, hash, content of the source files below a folder; files above `most` bytes aren't read.

    The driver lists names (Spark's own listing passes over those that begin with an
    underscore, such as __init__.py); the executors, which must reach the folder, read.
    """
    schema = "path string, size long, mtime double"
    ending = re.compile("(" + "|".join(re.escape(e) for e in EXTENSIONS) + ")$")
    found = sorted(x for x in listed(root) if x[1] <= most and ending.search(x[0]) and not x[0].endswith(".d.ts"))
    rows = spark.createDataFrame(found, schema).where(~ignored(F.col("path"), list(ignore)))
    where = root if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(where)
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.iloc[at : at + 64]
                content = []
                for path in some["path"]:
                    with system.open_input_file(f"{base.rstrip('/')}/{path}") as f:
                        content.append(f.read())
                yield some.assign(hash=[hashlib.sha256(c).hexdigest() for c in content], content=content)

    return rows.repartition(max(1, min(len(found) // 64, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(read, schema + ", hash string, content binary")


def load_config(read, path: str, seen: frozenset[str] = frozenset()) -> dict:
    """compilerOptions of a JSON-with-comments file, with its `extends` chain merged. read: path -> text."""
    import posixpath

    if path in seen:
        raise ValueError(f"{path} extends itself")
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", read(path), flags=re.S)
    data = json.loads(re.sub(r",(\s*[}\]])", r"\1", text))
    base = load_config(read, posixpath.normpath(posixpath.join(posixpath.dirname(path), data["extends"])), seen | {path}) if "extends" in data else {}
    return base | {k: v for k, v in data.get("compilerOptions", {}).items() if k in ("baseUrl", "paths", "moduleResolution")}
