"""From scanned files to rows: one extractor for each language, one pass over the files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources import python, swift, typescript

SYMBOL = "stable_key string, qualified_name string, short_name string, kind string, signature string, start_byte int, end_byte int, start_line int, end_line int, body_hash string, exported boolean, is_test boolean, visibility string"
REF = "from_key string, name string, receiver string, receiver_type string, kind string, site_line int, site_column int"
IMPORT = "local string, imported string, specifier string, site_line int"
EXPORT = "exported string, local string, source string, star boolean, site_line int"

Extract = Callable[[str, bytes], tuple[str, list[dict], list[dict], list[dict], list[dict]]]

#: Language, the paths that it reads, the prefix of its keys, and its extractor; the first one that takes a path counts.
LANGUAGES: list[tuple[str, str, str, Extract]] = [
    ("typescript", r"(?<!\.d)\.(ts|tsx|mts|cts)$", "ts", typescript.extract),
    ("python", r"\.pyi?$", "py", python.extract),
    ("swift", r"\.swift$", "swift", swift.extract),
]


def language(path: Column, languages: list[tuple[str, str, str, Extract]] = LANGUAGES) -> Column:
    """The language whose extractor takes a path, null for none."""
    found = F.lit(None).cast("string")
    for name, pattern, _, _ in reversed(languages):
        found = F.when(path.rlike(pattern), name).otherwise(found)
    return found


def extracted(files: DataFrame, languages: list[tuple[str, str, str, Extract]] = LANGUAGES) -> DataFrame:
    """path, language, state and arrays of symbols, refs, imports and exports of files (path, content); each file on its own.

    An adapter of another language is a further entry of `languages`.
    """
    by_name = {name: run for name, _, _, run in languages}
    parts = {"symbols": SYMBOL, "refs": REF, "imports": IMPORT, "exports": EXPORT}
    schema = "path string, language string, state string, " + ", ".join(f"{n} array<struct<{s.replace(' ', ':').replace(',:', ',')}>>" for n, s in parts.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [by_name[name](path, bytes(content)) for path, name, content in zip(batch["path"], batch["language"], batch["content"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "language": batch["language"], **{c: [m[i] for m in made] for i, c in enumerate(["state", *parts])}})

    return files.withColumn("language", language(F.col("path"), languages)).where("language is not null").select("path", "language", "content").mapInPandas(run, schema)
