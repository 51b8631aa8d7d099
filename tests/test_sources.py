"""Extraction, linking, the index build and the public calls, against literal rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.operators import budget, drift, evaluate, find, impact, link, resolve
from graphloom.plans import index, report, tools
from graphloom.sources import python, repository, swift, traces, typescript
from graphloom.sources.extract import language
from graphloom.sources.store import Store
from graphloom.streaming import refresh

SHAPES = """import fs, { join as j, type X } from "node:fs";
import * as ns from "./ns.js";
import type { T1 } from './t';
export * from "./all";
export { a as b, c } from "./x";
export interface Shape<T> extends Base { area(): number; name?: string; }
export type Alias = { id: string; tags: Tag[] } | null;
export enum Color { Red, Green }
export default class Circle<T> extends ns.Round implements Shape<T>, Other {
  private r: number = compute(1);
  constructor(public x: Point, y = mk()) { super(x); this.r = y; }
  async area(p: Point): Promise<number> {
    const helper = (q: Size) => { inner(q); };
    return Math.abs(this.scale(helper, other).value);
  }
}
export const make = async (n: number): Promise<Circle<any>> => new Circle(n);
let plain = 3, second: Foo = four();
function over(a: string): void;
function over(a: any) { if (a) { run("call(x)"); } }
namespace N { export function inside() { return /re[/]x/.test(s); } }
"""


def test_typescript():
    state, symbols, refs, imports, exports = typescript.extract("src/a.test.ts", SHAPES.encode())
    assert state == "ok" and all(s["is_test"] for s in symbols)
    assert [(s["kind"], s["qualified_name"], s["start_line"], s["end_line"], s["exported"]) for s in symbols] == [
        ("interface", "Shape", 6, 6, True), ("method", "Shape.area", 6, 6, True), ("property", "Shape.name", 6, 6, True), ("type", "Alias", 7, 7, True), ("property", "Alias.id", 7, 7, True), ("property", "Alias.tags", 7, 7, True),
        ("enum", "Color", 8, 8, True), ("class", "Circle", 9, 16, True), ("property", "Circle.r", 10, 10, True), ("method", "Circle.constructor", 11, 11, True), ("method", "Circle.area", 12, 15, True), ("function", "Circle.area.helper", 13, 13, True),
        ("function", "make", 17, 17, True), ("variable", "plain", 18, 18, False), ("variable", "second", 18, 18, False), ("function", "over", 19, 19, False), ("function", "over", 20, 20, False), ("module", "N", 21, 21, False), ("function", "N.inside", 21, 21, True),
    ]
    over = [s["stable_key"] for s in symbols if s["short_name"] == "over"]
    assert all(k.startswith("ts:src/a.test.ts#over~") for k in over) and len(set(over)) == 2
    assert {(r["kind"], r["name"], r["receiver"], r["from_key"].split("#")[1].split("~")[0], r["site_line"]) for r in refs} == {
        ("REFERENCES", "Tag", None, "Alias.tags", 7), ("INHERITS", "Round", "ns", "Circle", 9), ("IMPLEMENTS", "Shape", None, "Circle", 9), ("IMPLEMENTS", "Other", None, "Circle", 9), ("CALLS", "compute", None, "Circle.r", 10),
        ("REFERENCES", "Point", None, "Circle.constructor", 11), ("CALLS", "mk", None, "Circle.constructor", 11), ("REFERENCES", "Point", None, "Circle.area", 12), ("REFERENCES", "Promise", None, "Circle.area", 12), ("REFERENCES", "Size", None, "Circle.area.helper", 13),
        ("CALLS", "inner", None, "Circle.area.helper", 13), ("REFERENCES", "q", None, "Circle.area.helper", 13), ("CALLS", "abs", "Math", "Circle.area", 14), ("CALLS", "scale", "this", "Circle.area", 14), ("REFERENCES", "helper", None, "Circle.area", 14),
        ("REFERENCES", "other", None, "Circle.area", 14), ("REFERENCES", "Promise", None, "make", 17), ("REFERENCES", "Circle", None, "make", 17), ("CALLS", "Circle", None, "make", 17), ("REFERENCES", "n", None, "make", 17), ("REFERENCES", "Foo", None, "second", 18),
        ("CALLS", "four", None, "second", 18), ("CALLS", "run", None, "over", 20), ("CALLS", "test", "/re[/]x/", "N.inside", 21), ("REFERENCES", "s", None, "N.inside", 21),
    }
    assert [(x["local"], x["imported"], x["specifier"]) for x in imports] == [("fs", "default", "node:fs"), ("j", "join", "node:fs"), ("X", "X", "node:fs"), ("ns", "*", "./ns.js"), ("T1", "T1", "./t")]
    assert [(x["exported"], x["local"], x["source"], x["star"]) for x in exports][:6] == [("*", None, "./all", True), ("b", "a", "./x", False), ("c", "c", "./x", False), ("Shape", "Shape", None, False), ("Alias", "Alias", None, False), ("Color", "Color", None, False)]
    assert typescript.extract("a.ts", b"class {")[0] == "failed" and typescript.extract("a.ts", b"") == ("ok", [], [], [], [])
    text = "// \u00e9\nfunction f() {}\n"
    made = typescript.extract("a.ts", text.encode())[1][0]
    assert text.encode()[made["start_byte"] : made["end_byte"]] == b"function f() {}"


def test_python_keys_of_one_chain():
    source = b"""X = 1
X = 2
@overload
def f(a: int): ...
@typing.overload
def f(a: str): ...
def f(a): return g(a)
class K(Base, m.Other):
    @property
    def p(self) -> T: return self.q()
    @p.setter
    def p(self, v): os.x(v)
    def dup(self): pass
    def dup(self): pass
if X:
    def hidden(): pass
async def co(x: "str" = ")", *, y: D[E]) -> F:
    v: G = h()
"""
    state, symbols, refs, _, exports = python.extract("tests/a.py", source)
    assert state == "ok" and exports == [] and all(s["is_test"] for s in symbols)
    assert [(s["kind"], s["stable_key"].split("#")[1], s["start_line"], s["signature"]) for s in symbols] == [
        ("variable", "X", 1, None), ("function", "f", 7, "(a)"), ("class", "K", 8, None), ("method", "K.p", 10, "(self) -> T"), ("method", "K.p@setter", 12, "(self, v)"),
        ("method", "K.dup", 13, "(self)"), ("method", "K.dup$2", 14, "(self)"), ("function", "co", 17, '(x: "str" = ")", *, y: D[E]) -> F'),
    ]
    assert [(r["name"], r["receiver"], r["receiver_type"]) for r in refs if r["kind"] == "CALLS"] == [("g", None, None), ("q", "self", "K"), ("x", "os", None), ("h", None, None)]
    assert [r["name"] for r in refs if r["kind"] == "INHERITS"] == ["Base"]


SWIFT = """import Foundation
import struct Kit.Box
/* a /* nested */ comment */
public protocol Shape { func area() -> Double; var name: String { get } }
public final class Circle<T>: Base, Shape where T: X {
  private let r: Double = compute(1)
  public init(r: Double, store: Store) { self.r = r; store.save(r) }
  func area() -> Double { return helper.mul(r, r) }
  fileprivate func hidden(_ a: T) async throws -> [T] where T: Y {
    let s: Service = make()
    s.run("x\\(call(")"))")
    return []
  }
}
extension Outer.Inner { func ext() {} }
enum Color: String { case red }
func top(x: Int) { Circle(r: 1) }
"""


def test_swift():
    state, symbols, refs, imports, exports = swift.extract("Sources/App/a.swift", SWIFT.encode())
    assert state == "ok" and exports == [] and swift.target("x/Sources/App/a.swift") == "App" and swift.extract("a.swift", b"func f( {")[0] == "failed"
    assert [(s["kind"], s["qualified_name"], s["start_line"], s["end_line"], s["visibility"], s["exported"]) for s in symbols] == [
        ("interface", "Shape", 4, 4, "public", True), ("method", "Shape.area", 4, 4, "public", True), ("property", "Shape.name", 4, 4, "public", True), ("class", "Circle", 5, 14, "public", True),
        ("property", "Circle.r", 6, 6, "private", False), ("method", "Circle.init", 7, 7, "public", True), ("method", "Circle.area", 8, 8, "public", True), ("method", "Circle.hidden", 9, 13, "fileprivate", False),
        ("variable", "Circle.hidden.s", 10, 10, "internal", False), ("method", "Outer.Inner.ext", 15, 15, "internal", False), ("enum", "Color", 16, 16, "internal", False), ("function", "top", 17, 17, "internal", False),
    ]
    assert {(r["kind"], r["name"], r["receiver"], r["receiver_type"], r["from_key"].split("#")[1], r["site_line"]) for r in refs} == {
        ("REFERENCES", "String", None, None, "Shape.name", 4), ("INHERITS", "Base", None, None, "Circle", 5), ("IMPLEMENTS", "Shape", None, None, "Circle", 5), ("REFERENCES", "Double", None, None, "Circle.r", 6), ("CALLS", "compute", None, None, "Circle.r", 6),
        ("CALLS", "save", "store", "Store", "Circle.init", 7), ("CALLS", "mul", "helper", None, "Circle.area", 8), ("REFERENCES", "Service", None, None, "Circle.hidden.s", 10), ("CALLS", "make", None, None, "Circle.hidden.s", 10),
        ("CALLS", "run", "s", "Service", "Circle.hidden", 11), ("IMPLEMENTS", "String", None, None, "Color", 16), ("CALLS", "Circle", None, None, "top", 17),
    }
    assert [(x["local"], x["imported"], x["specifier"]) for x in imports] == [("Foundation", "*", "Foundation"), ("Box", "Box", "Kit")]


def test_swift_modules_narrow_candidates(spark):
    sources = {"Sources/A/a.swift": "import B\nfunc go() { near(); far(); hid() }\n", "Sources/B/b.swift": "public func near() {}\nprivate func hid() {}\n", "Sources/C/c.swift": "public func far() {}\n"}
    made = index.tables(files_of(spark, sources))
    names = {r.id: r.stable_key for r in made["symbol"].collect()}
    assert [(names[r.dst], r.tier) for r in made["edge"].where("kind = 'CALLS'").collect()] == [("swift:Sources/B/b.swift#near", "LEXICAL")]
    assert {r.name for r in made["unresolved_ref"].collect()} == {"far", "hid"}


def test_command_line(spark, tmp_path):
    for path, text in SOURCES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "bad.py").unlink()
    (tmp_path / "tsconfig.json").write_text('{ // comment\n "compilerOptions": {"paths": {"@/*": ["src/*"]},}, }')
    root = str(tmp_path)
    assert json.loads(cli.run(["index", root], spark)) == {"indexed": 6, "skipped": 0, "deleted": 0}
    assert json.loads(cli.run(["status", root], spark))["freshness"] == "fresh"
    assert json.loads(cli.run(["query", root, "callers_of", "helper"], spark))["results"]["lexical"][0]["stableKey"] == "ts:src/a.ts#Derived.run"
    assert json.loads(cli.run(["search", root, "far", "--kind", "function"], spark))["summary"] == "1 match(es)"
    assert json.loads(cli.run(["impact", root, "helper", "--budget", "500"], spark))["results"][0]["stableKey"] == "ts:src/a.ts#Derived.run"
    assert "## Modules" in cli.run(["doc", root], spark) and "<svg" in cli.run(["map", root], spark) and "src" in cli.run(["doc", root, "--module", "src"], spark)
    assert cli.run(["map", root, "--out", str(tmp_path / "map.html")], spark) == "created"
    assert cli.run(["clean", root], spark).endswith("is gone")
    with pytest.raises(SystemExit):
        cli.run(["query", root, "callers_of", "helper"], spark)


def test_configuration_merge():
    entry = {"command": "graphloom"}
    assert cli.merge_config(None, "g", entry)[0] == "create" and cli.merge_config("{", "g", entry) == ("invalid-json", None)
    outcome, text = cli.merge_config('{"a": 1, "mcpServers": {"x": {}}}', "g", entry)
    assert outcome == "merge" and json.loads(text) == {"a": 1, "mcpServers": {"x": {}, "g": entry}}
    assert cli.merge_config(text, "g", entry) == ("noop", None) and cli.merge_config(text, "g", {"command": "other"}) == ("conflict", None)


def test_languages(spark):
    rows = spark.createDataFrame([("a.ts",), ("a.d.ts",), ("b/c.tsx",), ("x.mts",), ("p.py",), ("p.pyi",), ("s.swift",), ("r.js",)], "path string")
    assert [r[0] for r in rows.select(language(F.col("path"))).collect()] == ["typescript", None, "typescript", "typescript", "python", "python", "swift", None]


def test_ignore_rules(spark):
    paths = ["a/out/x.ts", "coverage/y.ts", "src/z.ts", "src/gen1.ts", "src/gen2.ts", "src/gena.ts", "docs/a/b.ts", "deep/docs/b.ts", "keep.ts"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    left = lambda *rules: [r[0] for r in rows.where(~repository.ignored(F.col("path"), list(rules))).collect()]
    assert left() == paths[2:]
    assert left("src/gen[0-9].ts", "/docs/", "*.ts", "!keep.ts") == ["keep.ts"]
    assert left("gen[!0-9].ts", "docs/**") == ["src/z.ts", "src/gen1.ts", "src/gen2.ts", "deep/docs/b.ts", "keep.ts"]


def test_specifiers_are_probed_in_order(spark):
    have = ["src/x.mts", "src/x.js", "src/y.cjs", "src/d/index.cts", "lib/k.ts", "packages/p/src/main.ts"]
    file = spark.createDataFrame([(p,) for p in have], "path string")
    asked = {"./x": "src/x.mts", "./x.js": "src/x.mts", "./y": "src/y.cjs", "./d": "src/d/index.cts", "@l/k": "lib/k.ts", "k": "lib/k.ts", "pkg": "packages/p/src/main.ts", "./no": None, "@o/p/q": None, "left/right": None}
    refs = spark.createDataFrame([(s, "src/a.ts", s) for s in asked], "ref string, path string, specifier string")
    packages = link.package_exports("pkg", "packages/p", {"exports": {".": {"import": "./src/main.js"}}})
    got = {r.ref: (r.path, r.package) for r in link.specifiers(refs, file, {"@l/*": ["*"]}, "lib", packages=packages).collect()}
    assert {k: v[0] for k, v in got.items()} == asked
    assert [got[k][1] for k in ("./no", "@o/p/q", "left/right", "k")] == ["./no", "@o/p", "left", None]
    node = {r.ref: r.path for r in link.specifiers(refs, file, resolution="node").collect()}
    assert node["./x.js"] == "src/x.js"
    assert link.package_exports("p", "r", {"main": "./m.js", "exports": {"./s/*": ["./d/*.js"]}}) == {"p": "r/m.js", "p/s/*": "r/d/*.js"}


def test_python_modules(spark):
    have = ["lib/a/__init__.py", "lib/a/b.py", "lib/a/c/__init__.py", "lib/a/c/d.py", "lib/e.py", "top.py", "os.py"]
    file = spark.createDataFrame([(p,) for p in have], "path string")
    asked = {".d": "lib/a/c/d.py", ".": "lib/a/c/__init__.py", "..b": "lib/a/b.py", "..": "lib/a/__init__.py", "a.c": "lib/a/c/__init__.py", "e": "lib/e.py", "top": "top.py", "os": "os.py", "sys.path": None, "...e": "lib/e.py", ".no": None}
    refs = spark.createDataFrame([(s, "lib/a/c/d.py", s) for s in asked], "ref string, path string, specifier string")
    got = {r.ref: (r.path, r.package) for r in link.python_modules(refs, file).collect()}
    assert {k: v[0] for k, v in got.items()} == asked and got["sys.path"][1] == "sys" and got[".no"][1] == ".no"


def test_long_chains_of_exports_are_told(spark, monkeypatch):
    rows = [("m0", "x", None, False, 0)] + [(f"m{i}", None, f"m{i - 1}", True, 0) for i in range(1, 6)]
    exports = spark.createDataFrame(rows, "file string, name string, source string, star boolean, ordinal long")
    assert {r.file for r in link.export_map(exports).collect()} == {f"m{i}" for i in range(6)}
    monkeypatch.setattr(link, "PASSES", 2)
    with pytest.warns(UserWarning, match="2 passes"):
        assert {r.file for r in link.export_map(exports).collect()} == {"m0", "m1", "m2"}


def test_narrowing(spark):
    schema = "ref long, src long, src_file long, name string, kind string, site_line long, receiver string, binding_file long, binding_kind string, receiver_type string, module string, imported array<string>, package string, binding_reason string"
    rows = [(1, 9, 1, "f", "CALLS", 1, None, None, None, None, "A", [], None, None), (2, 9, 1, "f", "CALLS", 1, None, None, None, None, "A", ["B"], None, None), (3, 9, 1, "f", "CALLS", 1, "x", None, None, "Q.T", "A", [], None, None), (4, 9, 2, "f", "CALLS", 1, None, 2, "file", None, "A", None, None, None), (5, 9, 1, "f", "CALLS", 1, None, None, "external", None, "A", None, "lib", None)]
    symbol = [(1, "f", 1, "private", "f", "A"), (2, "f", 2, "private", "f", "A"), (3, "f", 2, None, "U.T.f", "B"), (4, "f", 3, None, "T.f", None), (5, "g", 3, None, "g", None)]
    known = spark.createDataFrame(symbol, "id long, short_name string, file_id long, visibility string, qualified_name string, module string")
    refs = spark.createDataFrame(rows, schema)
    made = {}
    for r in resolve.candidates(refs, known).collect():
        made.setdefault(r.ref, (r.tier, []))[1].append(r.dst)
    assert {k: (t, sorted(x for x in d if x)) for k, (t, d) in made.items()} == {1: ("HEURISTIC", [1, 4]), 2: ("HEURISTIC", [1, 3, 4]), 3: ("HEURISTIC", [3, 4]), 4: ("LEXICAL", [2]), 5: ("EXTERNAL", [])}
    edges, outside, missing = resolve.split(resolve.candidates(refs, known), known.limit(0).select(F.col("short_name").alias("name")), known.limit(0).select(F.col("short_name").alias("name")))
    assert edges.count() == 8 and outside.count() == 1 and missing.count() == 0


def test_tiers_equal_brute_force(spark):
    """Counts by way of aggregates equal those over every pair of a reference and a symbol."""
    random.seed(6)
    pick = random.choice
    symbol = [(i, pick("fg"), pick([1, 2, 3]), pick([None, "private", "public"]), pick(["f", "T.f", "U.T.f", "V.f"]), pick([None, "A", "B", "C"])) for i in range(120)]
    refs = []
    for i in range(300):
        kind = pick([None, None, "file", "external", "unresolved"])
        receiver = pick([None, "x"])
        refs.append((i, 9, pick([1, 2, 3]), pick("fgh"), "CALLS", 1, receiver, pick([1, 2]) if kind == "file" else None, kind, pick([None, "T", "Q.V"]) if receiver else None, pick([None, "A", "B"]), pick([None, [], ["B"], ["C", "A"]])))
    want = {}
    for ref, _, file, name, _, _, receiver, place, kind, written, module, imported in refs:
        n = every = 0
        for _, short, at, visibility, qualified, other in symbol:
            if short != name or kind in ("external", "unresolved") or place is not None and at != place:
                continue
            every += 1
            hidden = visibility == "private" and at != file
            away = receiver is None and other is not None and module is not None and other != module and other not in (imported or [])
            tail = qualified.rpartition(".")[0].rpartition(".")[2]
            foreign = receiver is not None and written is not None and tail != written.rpartition(".")[2]
            n += not (hidden or away or foreign)
        want[ref] = (n, every)
    schema = "ref long, src long, src_file long, name string, kind string, site_line long, receiver string, binding_file long, binding_kind string, receiver_type string, module string, imported array<string>"
    known = spark.createDataFrame(symbol, "id long, short_name string, file_id long, visibility string, qualified_name string, module string")
    assert {r.ref: (r.n, r["all"]) for r in resolve.tiers(spark.createDataFrame(refs, schema), known).collect()} == want


SOURCES = {
    "src/a.ts": 'import { helper as h, Base } from "./b.js";\nimport * as ns from "./c";\nimport ext from "left-pad";\nexport class Derived extends Base {\n  run(): void { h(); ns.far(); ext(); this.own(); missing(); }\n  own() {}\n}\n',
    "src/b.ts": 'export function helper() {}\nexport class Base { run() {} }\nexport * from "./c";\n', "src/c.ts": "export function far() {}\n",
    "pkg/__init__.py": "", "pkg/m.py": "from .n import f as g\nimport os\ndef top():\n    g()\n    os.getcwd()\n", "pkg/n.py": "def f(): pass\n", "bad.py": "def (:\n",
}


def files_of(spark, sources):
    return spark.createDataFrame([(p, bytearray(c.encode()), len(c), 1.0, c) for p, c in sources.items()], "path string, content binary, size long, mtime double, hash string")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("graph") / "s")).create().open()
    assert index.build(files_of(spark, SOURCES), store) == {"indexed": 7, "skipped": 0, "deleted": 0}
    return store


def test_index_build(built):
    names = {r.id: r.stable_key.split(":", 1)[1] for r in built.read("symbol").collect()}
    edges = {(r.kind, r.tier, names[r.src], names[r.dst], r.site_line) for r in built.read("edge").where("kind <> 'CONTAINS'").collect()}
    assert edges == {
        ("CALLS", "HEURISTIC", "src/a.ts#Derived.run", "src/a.ts#Derived.own", 5), ("CALLS", "HEURISTIC", "src/a.ts#Derived.run", "src/c.ts#far", 5), ("CALLS", "LEXICAL", "pkg/m.py#top", "pkg/n.py#f", 4),
        ("CALLS", "LEXICAL", "src/a.ts#Derived.run", "src/b.ts#helper", 5), ("IMPLEMENTS", "LEXICAL", "src/a.ts#Derived.run", "src/b.ts#Base.run", 4), ("IMPORTS", "LEXICAL", "pkg/m.py#", "pkg/n.py#", 1),
        ("IMPORTS", "LEXICAL", "src/a.ts#", "src/b.ts#", 1), ("IMPORTS", "LEXICAL", "src/a.ts#", "src/c.ts#", 2), ("INHERITS", "LEXICAL", "src/a.ts#Derived", "src/b.ts#Base", 4),
    }
    assert {(names[r.src], r.name, r.package) for r in built.read("external_ref").collect()} == {("src/a.ts#Derived.run", "ext", "left-pad"), ("pkg/m.py#top", "getcwd", "os")}
    assert [(names[r.src], r.name, r.reason) for r in built.read("unresolved_ref").collect()] == [("src/a.ts#Derived.run", "missing", "no_candidate")]
    assert {r.path: r.parse_state for r in built.read("file").collect()}["bad.py"] == "failed"


def test_tools(built):
    calls = tools.Tools(*(built.read(n) for n in ("edge", "symbol", "file", "external_ref", "unresolved_ref")))
    found = calls.find_symbols("run")["results"]
    assert [(r["stableKey"], r["reason"]) for r in found] == [("ts:src/a.ts#Derived.run", "exact_short"), ("ts:src/b.ts#Base.run", "exact_short")]
    assert calls.find_symbols("Derived.run", limit=1)["results"][0]["reason"] == "exact_qualified" and calls.find_symbols("elper")["results"][0]["reason"] == "fts"
    assert calls.find_symbols("run", kinds=["class"])["results"] == [] and calls.find_symbols("run", paths=["src/b"])["summary"] == "1 match(es)"
    made = calls.query_graph("callees_of", "Derived.run")
    assert [r["stableKey"] for r in made["results"]["lexical"]] == ["ts:src/b.ts#helper"] and len(made["results"]["heuristic"]) == 2 and not made["truncated"]
    assert made["results"]["external"] == {"count": 1} and made["results"]["unresolved"] == {"count": 1, "names": ["missing"]}
    assert calls.query_graph("callees_of", "Derived.run", 1)["truncated"] and calls.query_graph("callers_of", "nobody")["results"]["lexical"] == []
    assert tools.CAVEAT in calls.query_graph("tests_for", "helper")["warnings"]
    radius = calls.get_impact_radius(["far"])
    assert [(r["stableKey"], r["depth"]) for r in radius["results"]] == [("ts:src/a.ts#Derived.run", 1)] and radius["omittedCount"] == 0
    assert json.loads(index.pretty(radius))["schemaVersion"] == 1
    for call in (lambda: calls.find_symbols(""), lambda: calls.find_symbols("x", kinds=["nothing"]), lambda: calls.query_graph("who", "x"), lambda: calls.query_graph("callers_of", "x", 0), lambda: calls.get_impact_radius(token_budget=1.5)):
        with pytest.raises(ValueError):
            call()
    assert (tools.limit_of(None, 20), tools.limit_of(float("nan"), 20), tools.limit_of(2.9, 20), tools.limit_of(-1, 20)) == (20, 20, 2, 0)
    assert (tools.budget_of(float("inf")), tools.budget_of(float("-inf")), tools.budget_of(7.9)) == (float("inf"), 0, 7)
    assert tools.pack(["x" * 400, "y" * 4000, "z" * 40], 115) == ([0, 2], 111) and tools.pack(["x" * 400], 1) == ([0], 100)
    changed = built.spark.createDataFrame([("src/c.ts",)], "path string")
    assert {built_key.stable_key for built_key in built.read("symbol").join(impact.seeds_of_files(built.read("symbol"), built.read("file"), changed), "id").collect()} == {"ts:src/c.ts#", "ts:src/c.ts#far"}


def test_refresh_before_a_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s")).create()
    good = {p: c for p, c in SOURCES.items() if p != "bad.py"}
    index.build(files_of(spark, good), store)
    scan = lambda sources: lambda: index.snapshot(files_of(spark, sources).select("path", "size", F.col("mtime").alias("mtime_ms"), F.col("hash").alias("content_hash")))
    assert index.ensure_fresh(store, scan(good), lambda: None).freshness == "fresh"
    later = {**good, "src/c.ts": "export function far() {}\nexport function near() {}\n"}
    assert index.ensure_fresh(store, scan(later), lambda: None, limit=0).freshness == "partial"
    stale = index.ensure_fresh(store, scan(later), lambda: None)
    assert stale.freshness == "partial" and stale.drifted == 1 and len(stale.warnings) == 2
    done = index.ensure_fresh(store, scan(later), lambda: index.build(files_of(spark, later), store))
    assert done.freshness == "refreshed" and done.verified == ["src/c.ts"]
    assert index.build(files_of(spark, {p: c for p, c in later.items() if p != "pkg/n.py"}), store) == {"indexed": 0, "skipped": 5, "deleted": 1}


def test_compiler_answers(spark):
    edge = spark.createDataFrame([(1, 2, "CALLS", "HEURISTIC", 0.5, 3), (1, 3, "CALLS", "HEURISTIC", 0.5, 3), (1, 4, "CALLS", "HEURISTIC", 1.0, 9)], "src long, dst long, kind string, tier string, confidence double, site_line int")
    external = spark.createDataFrame([], "src long, name string, package string, site_line int")
    unresolved = spark.createDataFrame([(1, "f", "CALLS", 5), (1, "f", "CALLS", 6), (2, "f", "CALLS", 5)], "src long, name string, kind string, site_line int")
    answers = spark.createDataFrame([(1, "g", "CALLS", 3, 2, None, False), (1, "h", "CALLS", 9, None, "lib", False), (1, "f", "CALLS", 5, 7, None, True)], "src long, name string, kind string, site_line int, dst long, package string, was_unresolved boolean")
    made, outside, left, counts = resolve.settle(edge, external, unresolved, answers)
    assert sorted((r.dst, r.tier) for r in made.collect()) == [(2, "COMPILER"), (7, "COMPILER")]
    assert [tuple(r) for r in outside.collect()] == [(1, "h", "lib", 9)] and [tuple(r) for r in left.collect()] == [(2, "f", "CALLS", 5)]
    assert counts.first().asDict() == {"upgraded": 2, "externalized": 1, "unresolved_cleared": 2, "extra_cleared": 1}
    sites, skipped = resolve.query_sites(answers.withColumns({"column": F.col("dst").cast("int"), "ordinal": F.col("site_line")}), unresolved, resolve.heuristic_sites(edge, spark.createDataFrame([(2, "g")], "id long, short_name string")))
    assert sorted((r.name, r.was_unresolved) for r in sites.collect()) == [("f", True), ("g", False)] and skipped.first().skipped == 0
    symbol = spark.createDataFrame([(1, 1, 5, 9, 0), (2, 1, 5, 6, 4), (3, 1, 5, 6, 2)], "id long, file_id long, start_line int, end_line int, start_byte int")
    places = spark.createDataFrame([(1, 5), (1, 6)], "file_id long, line int")
    assert sorted((r.line, r.id) for r in resolve.declared_at(places, symbol).collect()) == [(5, 3), (6, None)]


def test_references_are_a_superset(spark):
    schema = "src long, dst long, kind string, tier string"
    actual = spark.createDataFrame([(1, 2, "CALLS", "LEXICAL"), (1, 3, "CALLS", "HEURISTIC")], schema)
    expected = spark.createDataFrame([(1, 2, "CALLS", None), (1, 2, "REFERENCES", None), (1, 9, "REFERENCES", None)], schema)
    rows = {r.kind: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in evaluate.compare(actual, expected).collect()}
    assert rows == {"CALLS": (1, 1, 0, 0.5, 1.0), "REFERENCES": (1, 1, 1, 0.5, 0.5), "overall": (2, 2, 1, 0.5, 2 / 3)}
    tiers = {(r.tier, r.kind): (r.tp, r.fp, r.fn) for r in evaluate.by_tier(actual, expected).collect()}
    assert tiers[("LEXICAL", "CALLS")] == (1, 0, 0) and tiers[("COMPILER", "REFERENCES")] == (0, 0, 2) and tiers[("ALL", "overall")] == (2, 2, 1)


def test_evidence_hits(spark):
    texts = spark.createDataFrame([(1, 0, "LEXICAL", "calls Foo.bar here"), (1, 1, None, "and quux or foobar")], "task long, ordinal long, tier string, text string")
    evidence = spark.createDataFrame([(1, "foo.bar", True), (1, "quux", True), (1, "foo", True), (1, "bar", False), (1, "oba", False), (2, "x", True), (3, "x", False)], "task long, name string, required boolean")
    rows = {r.task: r for r in evaluate.hits(texts, evidence).collect()}
    assert (rows[1].recall, rows[1].lexical, rows[1].unranked, rows[1].distractors) == (1.0, 2, 1, 1) and rows[2].recall == 0.0 and rows[3].recall == 1.0


def test_embedding_of_what_lacks_one(spark, tmp_path):
    file = spark.createDataFrame([(1, "src/http/basic-auth.ts")], "id long, path string")
    symbol = spark.createDataFrame([(i, 1, f"SmartRouter{i}.go", "method", None) for i in range(5)], "id long, file_id long, qualified_name string, kind string, signature string")
    held = spark.createDataFrame([(0, "m", 1, [0.5], "x"), (1, "other", 1, [0.5], "x")], "symbol_id long, model string, dim int, vector array<float>, input_hash string")

    def embedder(texts):
        assert len(texts) <= 2
        return [[float(len(t)), 1.0] for t in texts]

    made = find.embed(symbol, file, held, "m", embedder, 2).collect()
    text = "SmartRouter1.go\nsmart router1 go\nmethod\nsrc http basic auth"
    assert sorted(r.symbol_id for r in made) == [1, 2, 3, 4] and {r.symbol_id: r.vector for r in made}[1] == [float(len(text)), 1.0]
    assert find.from_blob(find.to_blob([1.5, -2.0])) == [1.5, -2.0] and find.to_blob([1.0]) == b"\x00\x00\x80?"
    store = Store(spark, str(tmp_path / "s")).create()
    assert store.provenance(compiler="5.1", other=None) == {"schema_version": "3", "compiler": "5.1"} and store.provenance(compiler=None) == {"schema_version": "3"}
    store.open().append("embedding", held)
    assert [r.symbol_id for r in store.embeddings("m").collect()] == [0]
    rows = spark.createDataFrame([(1, "k", 1, "q", "q", "class", None, 0, 1, 1, 1, None, True, False)], "id long, stable_key string, file_id long, qualified_name string, short_name string, kind string, signature string, start_byte int, end_byte int, start_line int, end_line int, body_hash string, exported boolean, is_test boolean")
    store.append("symbol", rows)
    with pytest.raises(ValueError):
        store.append("symbol", rows)
    store.append("edge", spark.createDataFrame([(1, 2, "LEXICAL", 1.0, 3, "CALLS")], "src long, dst long, tier string, confidence double, site_line int, kind string"), "9")
    assert store.read("edge").first().extractor_version == "9"


def test_traces(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"task": "t", "calls": [{"tool": "grep", "text": "x", "milliseconds": 2.5}]}))
    assert traces.traces(spark, str(tmp_path)).first().calls[0].tool == "grep"
    (tmp_path / "b.json").write_text("{ not json")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|Malformed"):
        traces.traces(spark, str(tmp_path)).collect()


def test_change_feed(spark, tmp_path):
    schema = "path string, size long, mtime double, hash string"
    spark.createDataFrame([("a", 1, 1.0, "x"), ("a", 2, 2.0, "y"), ("b", 1, 1.0, "x"), ("new", 1, 1.0, "z")], schema).coalesce(1).write.json(str(tmp_path / "feed"))
    known = spark.createDataFrame([("a", 1, 1.0, "x"), ("b", 1, 1.0, "x"), ("c", 1, 1.0, "x")], schema)
    seen = []
    feed = spark.readStream.schema(schema).json(str(tmp_path / "feed"))
    refresh.watch(feed, lambda: known, lambda rows, number: seen.extend((r.path, r.state) for r in rows.collect()), str(tmp_path / "at")).awaitTermination(60)
    assert sorted(seen) == [("a", "changed"), ("new", "new")]


def test_pages(spark):
    deps = spark.createDataFrame([("a", "b", 2, 1, 0, 3, "resolved"), ("b", "<c>", 0, 0, 4, 4, "unverified")], "source string, target string, compiler long, lexical long, heuristic long, total long, evidence string")
    summaries = spark.createDataFrame([("a", 1, 9, 0), ("b", 2, 4, 1), ("<c>", 1, 1, 0)], "module string, files long, symbols long, test_symbols long")
    surface = spark.createDataFrame([("b", "f,g")], "module string, names string")
    incoming = spark.createDataFrame([("b", "f", "a")], "module string, name string, users string")
    text = report.module_page("b", deps, summaries, surface, incoming)
    assert "2 files, 4 symbols, 1 of them tests." in text and "| a | 2 | 1 | 0 | resolved |" in text and "| f | a |" in text and "Most used: f,g" in text
    assert "No such module" in report.module_page("z", deps, summaries, surface, incoming)
    model = report.structure(deps, summaries, 2)
    assert [m["module"] for m in model["modules"]] == ["a", "b"] and model["omitted"] == 1
    whole = report.page("A & B", report.structure(deps, summaries))
    assert "A &amp; B" in whole and "<c>" not in whole and json.loads(whole.split('id="model">')[1].split("</script>")[0])["omitted"] == 0
    assert report.collapsed(deps.select("evidence").union(deps.select("evidence"))).select(F.sum("n")).first()[0] == 4


def test_envelope_and_statistics(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "n long, x string")
    made = json.loads(budget.envelope(rows, "two", "partial", True, ["w", "w"]).first().json)
    assert made["results"] == [{"n": 1, "x": "a"}, {"n": 2, "x": "b"}] and made["warnings"] == ["w", "the index is partial", "results were cut"]
    states = spark.createDataFrame([("a", "new"), ("b", "same"), ("c", "deleted"), ("d", "changed")], "path string, state string")
    assert drift.statistics(states).first().asDict() == {"indexed": 2, "skipped": 1, "deleted": 1}


def test_bindings_to_references(spark):
    refs = spark.createDataFrame([("f", "h", None, 1), ("f", "far", "ns", 2), ("f", "gone", "ns", 3), ("f", "go", "obj", 4), ("f", "pad", None, 5), ("f", "own", None, 6)], "file string, name string, receiver string, ref long")
    held = spark.createDataFrame([("f", "h", "helper", "file", "m", None), ("f", "ns", "*", "file", "m", None), ("f", "obj", "thing", "file", "k", None), ("f", "pad", "default", "external", None, "pkg")], "file string, local string, imported string, kind string, owner string, package string")
    exports = spark.createDataFrame([("m", "far", "z"), ("m", "helper", "m")], "file string, name string, owner string")
    got = {r.ref: (r.name, r.binding_kind, r.binding_file, r.package) for r in link.bound(refs, held, exports).collect()}
    assert got == {1: ("helper", "file", "m", None), 2: ("far", "file", "z", None), 3: ("gone", "unresolved", None, None), 4: ("go", "file", "k", None), 5: ("pad", "external", None, "pkg"), 6: ("own", None, None, None)}
