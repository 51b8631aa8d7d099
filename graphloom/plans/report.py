"""The module graph as text: a Markdown document and an SVG map.

Spark computes and limits the rows; what reaches the driver is a bounded number of modules
and dependencies. What a limit leaves out is always told.
"""

from __future__ import annotations

import html
import json
import math
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import impact, modules

MARK = "<!-- written by graphloom; changes are lost -->"
#: Lines that may differ between two documents of one structure begin so.
VOLATILE = "_State:"
DIAGRAM, TABLE = 25, 30


def ordered(deps: DataFrame) -> DataFrame:
    """Dependencies, those with the most resolved uses first."""
    return deps.orderBy(F.desc(F.col("compiler") + F.col("lexical")), F.desc("total"), "source", "target")


def cell(text: object) -> str:
    """A value inside a Markdown table."""
    return str(text).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def _table(head: list[str], rows: list[tuple]) -> list[str]:
    return ["| " + " | ".join(map(cell, row)) + " |" for row in [head, ["---"] * len(head), *rows]]


def document(title: str, deps: DataFrame, summaries: DataFrame, surface: DataFrame, state: str = "", diagram: int = DIAGRAM, table: int = TABLE) -> str:
    """Markdown of modules.dependencies, modules.summaries and modules.ranked_surface."""
    told = modules.totals(deps, diagram).first()
    top = ordered(deps).limit(max(diagram, table)).collect()
    drawn = [r for r in top if r.evidence != "unverified"][:diagram]
    number = {m: i for i, m in enumerate(sorted({m for r in drawn for m in (r.source, r.target)}))}
    boxes = [f'  m{i}["{html.escape(m)}"]' for m, i in number.items()]
    arrows = [f"  m{number[r.source]} {'-->' if r.evidence == 'resolved' else '-.->'}|{r.total}| m{number[r.target]}" for r in drawn]
    listed = summaries.join(surface, "module", "left").orderBy(F.desc("symbols"), "module").limit(table + 1).collect()
    lines = [MARK, f"# {title}", "", f"{VOLATILE} {state}_" if state else "", "## Dependencies", "", "```mermaid", "flowchart LR", *boxes, *arrows, "```", ""]
    lines += _table(["From", "To", "Compiler", "Lexical", "Heuristic", "Evidence"], [(r.source, r.target, r.compiler, r.lexical, r.heuristic, r.evidence) for r in top[:table]])
    if told.omitted:
        lines += ["", f"The diagram leaves out {told.omitted} dependencies with resolved uses."]
    if told.pairs > table:
        lines += ["", f"The table leaves out {told.pairs - table} dependencies."]
    if told.unverified:
        lines += ["", f"{told.unverified} dependencies rest on heuristics alone and are not drawn."]
    lines += ["", "## Modules", "", *_table(["Module", "Files", "Symbols", "Tests", "Used by others"], [(r.module, r.files, r.symbols, r.test_symbols, r.names or "") for r in listed[:table]])]
    if len(listed) > table:
        lines += ["", f"The table shows the {table} largest modules."]
    return "\n".join(lines) + "\n"


def collapsed(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with their number."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def module_page(module: str, deps: DataFrame, summaries: DataFrame, surface: DataFrame, incoming: DataFrame, most: int = TABLE) -> str:
    """Markdown of one module: its size, what it uses and is used by, and its names that others use."""
    own = summaries.where(F.col("module") == module).first()
    if own is None:
        return f"{MARK}\n# {module}\n\nNo such module.\n"
    names = surface.where(F.col("module") == module).first()
    lines = [MARK, f"# {module}", "", f"{own.files} files, {own.symbols} symbols, {own.test_symbols} of them tests.", ""]
    for head, here, there in (("Uses", "source", "target"), ("Used by", "target", "source")):
        rows = ordered(deps.where(F.col(here) == module)).limit(most + 1).collect()
        lines += [f"## {head}", "", *_table(["Module", "Compiler", "Lexical", "Heuristic", "Evidence"], [(r[there], r.compiler, r.lexical, r.heuristic, r.evidence) for r in rows[:most]])]
        lines += ["", f"More than {most} modules; the others are left out.", ""] if len(rows) > most else [""]
    rows = incoming.where(F.col("module") == module).orderBy("name").limit(most + 1).collect()
    lines += ["## Names that others use", "", f"Most used: {names.names if names else 'none'}", "", *_table(["Name", "Users"], [(r.name, r.users) for r in rows[:most]])]
    lines += ["", f"More than {most} names; the others are left out."] if len(rows) > most else []
    return "\n".join(lines) + "\n"


def layout(deps: DataFrame, summaries: DataFrame, most: int = 200) -> tuple[list[dict], list[dict]]:
    """Placed modules and weighted dependencies of the `most` largest modules.

    Columns are longest-path ranks, rows follow the names, a radius grows with the root of
    the symbols, a weight from 1 to 6 with the share of the most resolved uses.
    """
    size = {r.module: r.symbols for r in summaries.orderBy(F.desc("symbols"), "module").limit(most).collect()}
    some = F.broadcast(summaries.sparkSession.createDataFrame([(m,) for m in size], "module string"))  # at most `most` rows
    inside = deps.where("evidence <> 'unverified'")
    for side in ("source", "target"):
        inside = inside.join(some.withColumnRenamed("module", side), side, "left_semi")
    rows = inside.orderBy("source", "target").collect()  # at most `most` squared
    column = impact.ranks(sorted(size), [(r.source, r.target) for r in rows])
    taken: dict[int, int] = {}
    placed = []
    for m in sorted(size):
        row = taken.get(column[m], 0)
        taken[column[m]] = row + 1
        placed.append({"module": m, "column": column[m], "row": row, "radius": 6 + 2 * math.sqrt(size[m])})
    high = max((r.compiler + r.lexical for r in rows), default=0)
    links = [{"source": r.source, "target": r.target, "evidence": r.evidence, "weight": 1 + 5 * (r.compiler + r.lexical) / high if high else 1} for r in rows]
    return placed, links


def left_out(summaries: DataFrame, most: int = 200) -> int:
    """The modules beyond the `most` that layout() places."""
    return max(0, summaries.count() - most)


def structure(deps: DataFrame, summaries: DataFrame, most: int = 200) -> dict:
    """The map's model as plain data: placed modules, links, what was left out, and a page of each link's evidence."""
    placed, links = layout(deps, summaries, most)
    return {"modules": placed, "links": links, "omitted": left_out(summaries, most)}


def page(title: str, model: dict) -> str:
    """A self-contained HTML document of structure(): the map, what it leaves out, and its data as JSON."""
    data = json.dumps(model, sort_keys=True).replace("<", "\\u003c")  # no tag can end the script
    told = f"<p>{model['omitted']} smaller modules are left out.</p>" if model["omitted"] else ""
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>{MARK}<h1>{html.escape(title)}</h1>{told}{svg(model["modules"], model["links"])}<script type="application/json" id="model">{data}</script></body></html>\n'


def svg(placed: list[dict], links: list[dict], step: int = 160) -> str:
    """A map of layout(): solid lines for resolved dependencies, dashed ones for weak."""
    at = {p["module"]: (step * (p["column"] + 1), step * (p["row"] + 1) // 2) for p in placed}
    wide, high = (max((xy[i] for xy in at.values()), default=0) + step for i in (0, 1))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {wide} {high}" font-family="sans-serif" font-size="11">', f"<!-- {MARK[5:-4]} -->"]
    for x in links:
        (a, b), (c, d) = at[x["source"]], at[x["target"]]
        out.append(f'<line x1="{a}" y1="{b}" x2="{c}" y2="{d}" stroke="#888" stroke-width="{x["weight"]:.2f}"' + ("" if x["evidence"] == "resolved" else ' stroke-dasharray="4"') + "/>")
    for p in placed:
        x, y = at[p["module"]]
        out.append(f'<circle cx="{x}" cy="{y}" r="{p["radius"]:.1f}" fill="#cde"/><text x="{x}" y="{y}" text-anchor="middle">{html.escape(p["module"])}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"


def save(path: str, text: str) -> str:
    """Write a document: created, updated, unchanged (but for its state), or refused (another's file)."""
    mark = MARK[5:-4].strip()
    if not os.path.exists(path):
        outcome = "created"
    else:
        with open(path, encoding="utf-8") as f:
            before = f.read()
        if mark not in before:
            return "refused"
        same = [[line for line in t.splitlines() if not line.startswith(VOLATILE)] for t in (before, text)]
        if same[0] == same[1]:
            return "unchanged"
        outcome = "updated"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return outcome
