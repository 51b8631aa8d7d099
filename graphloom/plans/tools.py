"""The three public calls over a graph: find_symbols, query_graph, get_impact_radius."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import find, impact, traverse
from graphloom.plans.index import State, pretty
from graphloom.sources.store import KINDS

CAVEAT = "edges to tests show that they are related, not that they cover anything"
FIND_LIMIT, QUERY_LIMIT, BUDGET, SECONDS = 20, 50, 8000, 2.0


def limit_of(value: float | None, default: int) -> int:
    """A limit as a whole number of at least 0; the default where none or no finite one is given."""
    return default if value is None or not math.isfinite(value) else max(0, math.floor(value))


def budget_of(value: float) -> float:
    """A budget as a whole number of at least 0; without end stays without end, anything else that isn't finite is 0."""
    return value if value == math.inf else max(0, math.floor(value)) if math.isfinite(value) else 0


def estimate(text: str) -> int:
    """Tokens of a text: a quarter of its bytes, rounded up."""
    return -(-len(text.encode()) // 4)


def checked(name: str, value: object, kind: type, among: list[str] | None = None) -> None:
    """Refuse what a call doesn't take: another type, an empty text, a number below 1, a word of no list."""
    if value is None:
        return
    for x in value if isinstance(value, list) and kind is not list else [value]:
        if not isinstance(x, kind) or isinstance(x, bool) != (kind is bool):
            raise ValueError(f"{name}: {x!r} is no {kind.__name__}")
        if kind is str and among is None and x == "":
            raise ValueError(f"{name} is empty")
        if kind is int and x < 1:
            raise ValueError(f"{name}: {x} is not positive")
        if among is not None and x not in among:
            raise ValueError(f"{name}: {x!r} is none of {', '.join(among)}")


def pack(texts: list[str], budget: float, count: Callable[[str], int] = estimate) -> tuple[list[int], int]:
    """The texts that fit, by number, and their tokens: the first is always taken, one that doesn't fit is passed over."""
    taken, used = [], 0
    for i, t in enumerate(texts):
        total = used + count(t) + (1 if used else 0)
        if i == 0 or total <= budget:
            taken.append(i)
            used = total
    return taken, used


@dataclass
class Tools:
    """The calls over tables; `fan`, `p95` and `edge_by_src` are used where they are written.

    seeds_of_diff: gives the changed paths as a DataFrame of `path`, None if unknown. count:
    tokens of a text; a tokenizer's count may take the estimate's place.
    """

    edge: DataFrame
    symbol: DataFrame
    file: DataFrame
    external: DataFrame
    unresolved: DataFrame
    fan: DataFrame | None = None
    p95: int | None = None
    edge_by_src: DataFrame | None = None
    state: State = field(default_factory=lambda: State("fresh"))
    seeds_of_diff: Callable[[], DataFrame | None] = lambda: None
    count: Callable[[str], int] = estimate

    def envelope(self, summary: str, results: object, warnings: list[str] = (), omitted: int = 0, truncated: bool = False, tokens: int | None = None) -> dict:
        told = [*self.state.warnings, *warnings, *(["results were cut"] if truncated else [])]
        return {
            "schemaVersion": 1, "freshness": {"state": self.state.freshness, "driftCount": self.state.drifted, "verified": self.state.verified}, "summary": summary, "results": results,
            "warnings": list(dict.fromkeys(told)), "truncated": truncated, "omittedCount": omitted, "estimatedTokens": self.count(pretty(results)) if tokens is None else tokens,
        }

    def find_symbols(self, query: str, kinds: list[str] | None = None, paths: list[str] | None = None, limit: int | None = None) -> dict:
        """Exact qualified names, then exact short names, then full text; a phase runs only while rows are wanted."""
        checked("query", query, str)
        checked("kinds", kinds, str, KINDS)
        checked("paths", paths, str)
        checked("limit", limit, int)
        most, out, seen = limit_of(limit, FIND_LIMIT), [], set()
        some = find.scoped(self.symbol, self.file, kinds or [], paths or [])
        lines = [F.col(c) if c in self.symbol.columns else F.lit(None).cast("int").alias(c) for c in ("start_line", "end_line")]

        def add(rows: DataFrame, reason: str) -> None:
            wanted = rows.select("id", "stable_key", "path", "kind", "signature", *lines).limit(most + len(seen)).collect()  # at most 2 * `most`
            for r in wanted:
                if r.id not in seen and len(out) < most:
                    seen.add(r.id)
                    out.append({"stableKey": r.stable_key, "path": r.path, "kind": r.kind, "signature": r.signature, "startLine": r.start_line, "endLine": r.end_line, "reason": reason})

        add(some.where(F.col("qualified_name") == query).orderBy("stable_key"), "exact_qualified")
        if len(out) < most:
            add(some.where(F.col("short_name") == query).orderBy("stable_key"), "exact_short")
        if len(out) < most and find.terms(query):
            add(some.join(find.full_text(self.symbol, query), "id").orderBy("score", "stable_key"), "fts")
        return self.envelope(f"{len(out)} match(es)", out)

    def query_graph(self, pattern: str, symbol: str, limit: int | None = None) -> dict:
        """One hop from a symbol, by tier; and what the tables can't say."""
        checked("pattern", pattern, str, list(traverse.PATTERNS))
        checked("symbol", symbol, str)
        checked("limit", limit, int)
        result: dict = {"compiler": [], "lexical": [], "heuristic": [], "external": {"count": 0}, "unresolved": {"count": 0, "names": []}}
        warnings = [CAVEAT] if pattern == "tests_for" else []
        start = traverse.seed(self.symbol, symbol).first()
        if start is None:
            return self.envelope(f"no single symbol {symbol!r}", result, warnings)
        reverse = traverse.PATTERNS[pattern][1]
        edge = self.edge if reverse or self.edge_by_src is None else self.edge_by_src
        most = limit_of(limit, QUERY_LIMIT)
        rows = traverse.neighbours(edge, self.symbol, self.file, pattern, start.id, fan=self.fan, most=self.p95)
        found = rows.orderBy("tier_rank", F.desc("score"), F.expr("collate(stable_key, 'UNICODE')")).limit(most + 1).collect()
        for r in found[:most]:
            result.get((r.tier or "").lower(), result["heuristic"]).append({"stableKey": r.stable_key, "path": r.path, "qualifiedName": r.qualified_name, "kind": r.edge_kind, "siteLine": r.site_line})
        told = traverse.completeness(self.external, self.unresolved, self.symbol, start.id, reverse).first()
        result["external"]["count"] = told.external
        result["unresolved"] = {"count": told.unresolved, "names": told.names.split(",") if told.names else []}
        n = min(len(found), most)
        return self.envelope(f"{n} {pattern} {symbol}", result, warnings, truncated=len(found) > most)

    def get_impact_radius(self, symbols: list[str] | None = None, from_git_diff: bool | None = None, token_budget: int | None = None) -> dict:
        """What depends on symbols, or on the changed files, ranked and cut to a token budget."""
        checked("symbols", symbols, str)
        checked("from_git_diff", from_git_diff, bool)
        checked("token_budget", token_budget, int)
        seeds = {r.id for s in symbols or [] for r in traverse.seed(self.symbol, s).collect()}
        warnings = []
        if from_git_diff:
            changed = self.seeds_of_diff()
            if changed is None:
                warnings.append("the changed files aren't known")
            else:
                seeds |= {r.id for r in impact.seeds_of_files(self.symbol, self.file, changed).limit(impact.MOST_NODES).collect()}
        rows, cut = impact.radius(self.edge, self.symbol, sorted(seeds), fan=self.fan, most=self.p95, seconds=SECONDS)
        found = [{"stableKey": r.stable_key, "depth": r.depth, "tier": r.tier, "score": round(r.score, 9)} for r in rows.collect()]  # at most MAX_NODES
        taken, used = pack([pretty(r) for r in found], budget_of(BUDGET if token_budget is None else token_budget), self.count)
        results = [found[i] for i in taken]
        left = self.unresolved.count()
        warnings += [*cut, CAVEAT, f"{left} unresolved reference(s) may hide dependents"]
        return self.envelope(f"{len(results)} affected symbol(s) from {len(seeds)} seed(s)", results, warnings, len(found) - len(results), bool(cut) or len(taken) < len(found), used)
