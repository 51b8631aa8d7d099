"""The command line: index, update, status, query, search, impact, doc, map, compiler, embed and clean.

    python -m graphloom.cli index ROOT [--store FOLDER]
    python -m graphloom.cli query ROOT callers_of Name
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import drift, modules
from graphloom.operators.traverse import PATTERNS, fan_in, p95
from graphloom.plans import index, report, tools
from graphloom.sources import git, repository
from graphloom.sources.store import SCHEMAS, Store, location


def session() -> SparkSession:
    spark = SparkSession.builder.appName("graphloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class Repository:
    """A source tree and the store of its graph."""

    def __init__(self, spark: SparkSession, root: str, folder: str | None):
        self.spark, self.root = spark, os.path.abspath(root)
        self.folder = location(folder or os.path.join(self.root, ".graphloom"), self.root)
        self.store = Store(spark, self.folder)

    def files(self) -> DataFrame:
        lines: list[str] = []
        path = os.path.join(self.root, ".gitignore")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                lines = f.read().splitlines()
        return repository.scan(self.spark, self.root, lines)

    def config(self) -> index.Config:
        def read(path: str) -> str:
            with open(repository.contained(self.root, path), encoding="utf-8") as f:
                return f.read()

        if not os.path.exists(os.path.join(self.root, "tsconfig.json")):
            return index.Config()
        options = repository.load_config(read, "tsconfig.json")
        base = os.path.normpath(options["baseUrl"]).removeprefix(".") if "baseUrl" in options else None
        return index.Config(options.get("paths", {}), base or None, options.get("moduleResolution", "bundler"))

    def build(self) -> dict[str, int]:
        if not os.path.exists(os.path.join(self.folder, "meta")):
            self.store.create()
        return index.build(self.files(), self.store.open(), self.config())

    def present(self) -> DataFrame:
        return self.files().select("path", "size", "mtime", "hash")

    def opened(self) -> index.State:
        """The state of the store, brought up to date where few files drifted."""
        if not os.path.exists(os.path.join(self.folder, "meta")):
            raise SystemExit(f"no index of {self.root}; run index first")
        self.store.open()
        return index.ensure_fresh(self.store, self.present, self.build)

    def tools(self) -> tools.Tools:
        state = self.opened()
        edge, symbol, file, external, unresolved = (self.store.read(n) for n in ("edge", "symbol", "file", "external_ref", "unresolved_ref"))
        fan = fan_in(edge)
        return tools.Tools(edge, symbol, file, external, unresolved, fan, p95(fan).first()[0], state=state, seeds_of_diff=lambda: git.changed(self.spark, self.root))

    def modules(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Dependencies, summaries, surfaces and incoming names of the module graph."""
        self.opened()
        symbol, file = self.store.read("symbol"), self.store.read("file")
        counts = modules.symbol_counts(symbol, file)
        cross = modules.crossing(modules.dependency_rows(self.store.read("edge"), symbol, file), modules.excluded(counts))
        return modules.dependencies(cross), modules.summaries(counts), modules.ranked_surface(modules.surface(cross)), modules.incoming(cross)


def run(words: list[str], spark: SparkSession | None = None) -> str:
    """The output of a command."""
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("--store", help="folder of the tables; .graphloom below the root by default")
    commands = parser.add_subparsers(dest="command", required=True)
    add = {name: commands.add_parser(name) for name in ("index", "update", "status", "search", "query", "impact", "doc", "map", "clean")}
    for p in add.values():
        p.add_argument("root")
    add["search"].add_argument("query")
    add["search"].add_argument("--kind", action="append")
    add["search"].add_argument("--path", action="append")
    add["query"].add_argument("pattern", choices=list(PATTERNS))
    add["query"].add_argument("symbol")
    for name in ("search", "query"):
        add[name].add_argument("--limit", type=int)
    add["impact"].add_argument("symbols", nargs="*")
    add["impact"].add_argument("--diff", action="store_true")
    add["impact"].add_argument("--budget", type=int)
    add["doc"].add_argument("--module")
    for name in ("doc", "map"):
        add[name].add_argument("--out")
    asked = parser.parse_args(words)
    here = Repository(spark or session(), asked.root, asked.store)
    if asked.command in ("index", "update"):
        return index.pretty(here.build())
    if asked.command == "status":
        here.store.open()
        changed = drift.changes(index.snapshot(here.store.read("file")), here.present())
        row = drift.freshness(changed, here.store.read("file")).first()
        revision, dirty = git.state(here.root)
        counts = {name: here.store.read(name).count() for name in SCHEMAS if name != "meta"}
        return index.pretty({"freshness": row.freshness, "drifted": row.drifted, "revision": revision, "dirty": dirty, "rows": counts, **here.store.provenance()})
    if asked.command == "search":
        return index.pretty(here.tools().find_symbols(asked.query, asked.kind, asked.path, asked.limit))
    if asked.command == "query":
        return index.pretty(here.tools().query_graph(asked.pattern, asked.symbol, asked.limit))
    if asked.command == "impact":
        return index.pretty(here.tools().get_impact_radius(asked.symbols, asked.diff, asked.budget))
    if asked.command == "clean":
        here.store.drop()
        return f"{here.folder} is gone"
    deps, summaries, surface, incoming = here.modules()
    if asked.command == "map":
        text = report.page(os.path.basename(here.root), report.structure(deps, summaries))
    elif asked.module:
        text = report.module_page(asked.module, deps, summaries, surface, incoming)
    else:
        text = report.document(os.path.basename(here.root), deps, summaries, surface, git.state(here.root)[0] or "")
    return report.save(asked.out, text) if asked.out else text


#: Outcomes of merging one server's entry into a client's configuration.
CREATE, MERGE, NOOP, CONFLICT, INVALID = "create", "merge", "noop", "conflict", "invalid-json"


def merge_config(text: str | None, name: str, entry: dict, key: str = "mcpServers") -> tuple[str, str | None]:
    """What adding `entry` under key/name to a JSON configuration would do, and the new text where something changes."""
    if text is None or not text.strip():
        return CREATE, json.dumps({key: {name: entry}}, indent=2) + "\n"
    try:
        held = json.loads(text)
    except ValueError:
        return INVALID, None
    if not isinstance(held, dict) or not isinstance(held.get(key, {}), dict):
        return INVALID, None
    old = held.get(key, {}).get(name)
    if old is not None:
        return (NOOP if old == entry else CONFLICT), None
    return MERGE, json.dumps({**held, key: {**held.get(key, {}), name: entry}}, indent=2) + "\n"


if __name__ == "__main__":
    print(run(sys.argv[1:]))
