import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import budget, drift, evaluate, find, impact, link, resolve, roles, traverse
from graphloom.sources import repository, store
from graphloom.sources.extract import extracted

SYMBOL = "id long, stable_key string, file_id long, qualified_name string, short_name string, kind string, signature string, exported boolean, is_test boolean"
EDGE = "src long, dst long, kind string, tier string, confidence double, site_line long"


def symbols(spark, n):
    return spark.createDataFrame([(i, f"k{i:04}", 1, f"s{i}", f"s{i}", "function", f"function s{i}()", False, False) for i in range(n)], SYMBOL)


def edges(spark, pairs, kind="CALLS", tier="LEXICAL"):
    return spark.createDataFrame([(a, b, kind, tier, 1.0, 1) for a, b in pairs], EDGE)


@pytest.fixture(scope="module")
def file(spark):
    return spark.createDataFrame([(1, "src/a.ts")], "id long, path string")


def test_traversal_keeps_the_best_edge(spark, file):
    rows = spark.createDataFrame([(0, 1, "CALLS", "HEURISTIC", 0.5, 3), (0, 1, "CALLS", "COMPILER", 1.0, 9), (2, 1, "REFERENCES", "LEXICAL", 1.0, None)], EDGE)
    found = traverse.neighbours(rows, symbols(spark, 3), file, "references_to", 1).orderBy("id").collect()
    assert [(r.id, r.tier, r.site_line) for r in found] == [(0, "COMPILER", 9), (2, "LEXICAL", None)]
    top, more = traverse.one_hop(rows, symbols(spark, 3), file, "references_to", 1, limit=1)
    assert [r.id for r in top.collect()] == [0] and more


def test_fan_in_p95(spark):
    assert traverse.fan_in_p95(edges(spark, [(1, 0)])).first().p95 == 1
    assert traverse.fan_in_p95(edges(spark, [(1, 0)], "CONTAINS")).first().p95 == 0


def test_seed_stops_at_the_first_level(spark):
    some = spark.createDataFrame([(1, "a", 1, "x", "y", "class", None, False, False), (2, "b", 1, "x", "z", "class", None, False, False), (3, "c", 1, "q", "x", "class", None, False, False)], SYMBOL)
    assert [r.id for r in traverse.seed(some, "x").collect()] == []
    assert [r.id for r in traverse.seed(some, "z").collect()] == [2]


@pytest.mark.parametrize("few", [2000, 0])
def test_impact_depth_and_node_caps(spark, monkeypatch, few):
    monkeypatch.setattr(impact, "FEW", few)  # by literals and by joins
    chain = edges(spark, [(i + 1, i) for i in range(6)])
    rows, warnings = impact.radius(chain, symbols(spark, 8), [0])
    assert sorted((r.id, r.depth) for r in rows.collect()) == [(i, i) for i in range(1, 7)] and not warnings
    rows, warnings = impact.radius(edges(spark, [(i + 1, i) for i in range(7)]), symbols(spark, 8), [0])
    assert rows.count() == 6 and warnings == ["depth 6 reached"]
    fan = edges(spark, [(i, 0) for i in range(1, 502)])
    rows, warnings = impact.radius(fan, symbols(spark, 502), [0])
    assert rows.count() == 500 and warnings == ["500 nodes reached"]
    cycle, _ = impact.radius(edges(spark, [(1, 0), (0, 1)]), symbols(spark, 2), [0])
    assert [r.id for r in cycle.collect()] == [1]


def test_tier_truth_table(spark):
    cases = [  # external, unresolved, candidates, receiver, file binding, narrowed, sdk
        ((True, False, 1, False, False, False, False), "EXTERNAL"), ((False, True, 1, False, False, False, False), "UNRESOLVED"), ((False, False, 0, False, False, False, False), "UNRESOLVED"),
        ((False, False, 0, False, False, False, True), "EXTERNAL"), ((False, False, 1, True, False, False, False), "HEURISTIC"), ((False, False, 9, True, False, False, False), "UNRESOLVED"),
        ((False, False, 1, False, True, False, False), "LEXICAL"), ((False, False, 1, False, False, False, False), "LEXICAL"), ((False, False, 1, False, False, True, False), "HEURISTIC"),
        ((False, False, 8, False, False, False, False), "HEURISTIC"), ((False, False, 9, False, False, False, False), "UNRESOLVED"),
    ]
    rows = spark.createDataFrame([c for c, _ in cases], "a boolean, b boolean, c int, d boolean, e boolean, f boolean, g boolean")
    assert [r[0] for r in rows.select(S.disposition(*[F.col(c) for c in "abcdefg"])).collect()] == [t for _, t in cases]


def test_export_map_barrels(spark):
    rows = [("a", "x", None, False, 0), ("a", "default", None, False, 1), ("b", None, "a", True, 0), ("b", "x2", None, False, 1), ("c", None, "b", True, 0), ("a", None, "c", True, 2), ("d", "x", "c", False, 0)]
    made = link.export_map(spark.createDataFrame(rows, "file string, name string, source string, star boolean, ordinal long"))
    got = {(r.file, r.name): r.owner for r in made.collect()}
    assert got[("c", "x")] == "a" and got[("d", "x")] == "a" and got[("a", "x2")] == "b" and ("b", "default") not in got


def test_bindings_last_import_wins(spark):
    exports = spark.createDataFrame([("m", "x", "m")], "file string, name string, owner string")
    rows = [("f", "x", "x", "m", None, 0), ("f", "y", "gone", "m", None, 0), ("f", "z", "z", "m", None, 0), ("f", "z", "z", None, "pkg", 1)]
    got = {r.local: (r.kind, r.owner, r.package) for r in link.bindings(spark.createDataFrame(rows, "file string, local string, imported string, path string, package string, ordinal long"), exports).collect()}
    assert got == {"x": ("file", "m", None), "y": ("unresolved", None, None), "z": ("external", None, "pkg")}


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, 0, 0, "x" * 400), (1, 1, 1, "y" * 4000), (1, 2, 1, "z" * 40)], "answer long, ordinal long, priority int, text string")
    assert [(r.ordinal, r.taken) for r in budget.pack(rows, 115).orderBy("ordinal").collect()] == [(0, True), (1, False), (2, True)]


def test_drift_hashes_only_after_stat(spark):
    schema = "path string, size long, mtime double, hash string"
    old = spark.createDataFrame([("a", 1, 1.0, "x"), ("b", 1, 1.0, "x"), ("c", 1, 1.0, "x"), ("d", 1, 1.0, "x")], schema)
    new = spark.createDataFrame([("a", 1, 1.0, "other"), ("b", 1, 2.0, "x"), ("c", 1, 2.0, "y"), ("e", 1, 1.0, "x")], schema)
    made = drift.changes(old, new)
    assert {r.path: r.state for r in made.collect()} == {"a": "same", "b": "same", "c": "changed", "d": "deleted", "e": "new"}
    assert drift.freshness(made).first().freshness == "refreshable" and drift.freshness(made, limit=2).first().freshness == "partial"


def test_promotion_only_raises(spark):
    rows = edges(spark, [(0, 1), (0, 2)], tier="HEURISTIC")
    missing = spark.createDataFrame([(0, "f", "CALLS"), (0, "g", "CALLS")], "src long, name string, kind string")
    proof = spark.createDataFrame([(0, 1, "CALLS", "f"), (0, 3, "CALLS", "f")], "src long, dst long, kind string, name string")
    made, left = resolve.promote(rows, missing, proof)
    assert sorted((r.dst, r.tier) for r in made.collect()) == [(1, "COMPILER"), (2, "HEURISTIC"), (3, "COMPILER")] and [r.name for r in left.collect()] == ["g"]


def test_full_text_needs_every_term(spark):
    some = spark.createDataFrame([(1, "refreshSession"), (2, "Session"), (3, "other")], "id long, short_name string").withColumns({"qualified_name": F.col("short_name"), "signature": F.lit(None).cast("string")})
    assert [r.id for r in find.full_text(some, "refresh session").collect()] == [1]
    assert find.full_text(some, "ab").count() == 0 and find.terms("a bcd $x_1") == ["bcd", "$x_1"]


def test_precision_recall_of_nothing(spark):
    a = spark.createDataFrame([(1, "CALLS")], "src long, kind string")
    assert evaluate.precision_recall(a.limit(0), a).first().precision == 1.0


def test_python_extraction_and_scan(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("import os\nfrom .b import c as d\nclass K(Base):\n    def run(self):\n        return d(os.getcwd())\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (:\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.py").write_text("x = 1\n")
    files = repository.scan(spark, str(tmp_path), ["*.tmp"])
    rows = {r.path: r for r in extracted(files).collect()}
    assert set(rows) == {"pkg/a.py", "pkg/bad.py"} and rows["pkg/bad.py"].state == "failed"
    assert [s.qualified_name for s in rows["pkg/a.py"].symbols] == ["K", "K.run"]
    assert [(r.name, r.receiver, r.kind) for r in rows["pkg/a.py"].refs] == [("Base", None, "INHERITS"), ("d", None, "CALLS"), ("getcwd", "os", "CALLS")]
    with pytest.raises(ValueError):
        repository.contained("/r", "../x")


def test_store_version_gate_and_unique_keys(spark, tmp_path):
    folder = str(tmp_path / "s")
    made = store.Store(spark, folder).create().open()
    spark.createDataFrame([("schema_version", "2")], store.SCHEMAS["meta"]).write.mode("overwrite").parquet(f"{folder}/meta")
    with pytest.raises(ValueError):
        made.open()
    rows = symbols(spark, 2).withColumn("stable_key", F.lit("k"))
    assert store.duplicates(rows).count() == 1


def test_entry_without_optional_parts():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "callers_of" in e.queries()


def test_as_of_across_stretches(spark):
    random.seed(2)
    held = [(random.choice("ab"), None if i % 9 == 0 else "n", i * 7 % 500, f"t{i}") for i in range(60)]
    asked = [(o, n, at) for o in "abc" for n in ("n", None) for at in range(0, 520, 13)]
    want = {(o, n, at): max(((s, t) for p, m, s, t in held if p == o and m == n and s <= at), default=(0, None))[1] for o, n, at in asked}
    bindings, points = spark.createDataFrame(held, "owner string, name string, start long, type string"), spark.createDataFrame(asked, "owner string, name string, at long")
    for width in (10, 100, 4096):
        assert {(r.owner, r.name, r.at): r.type for r in resolve.as_of(points, bindings, width).collect()} == want


def test_graph_is_written_once_and_again_when_removed(spark):
    from graphloom.plans.views import Graph

    folder = "/root/testdata/sf0.001"
    first = Graph(spark, folder).written
    assert Graph(spark, folder).written is first
    store.Store(spark, first["fan"].kept).drop()
    again = Graph(spark, folder).written
    assert again is not first and again["fan"].count() > 0
    assert again["edge"].count() == again["edge_by_src"].count() == Graph(spark, folder).view("edge").count()


def test_tiers_in_one_pass_equal_each_compared_alone(spark):
    """Also with null ends and kinds, kinds beyond one word of bits, and expected edges as a condition."""
    rng = random.Random(2)
    kinds = ["REFERENCES", "CALLS", None, *[f"K{i:02}" for i in range(14)]]
    end = lambda: rng.choice([None, *range(5)])
    edge = [(end(), end(), rng.choice(kinds), rng.choice([*evaluate.TIERS, "OTHER", None])) for _ in range(400)]
    schema = "src long, dst long, kind string, tier string"
    for rows, more in ((edge, edge[:50]), (edge[200:], [(1, 2, "NEW", None), *edge[:30]]), ([r for r in edge if r[2] not in ("REFERENCES", None)], edge[:0]), ([], edge[:20]), ([], [])):
        actual, expected = spark.createDataFrame(rows, schema), spark.createDataFrame(more, schema)
        each = actual.where(F.col("tier").isin(evaluate.TIERS)).union(actual.withColumn("tier", F.lit("ALL")))
        wanted = expected.select("src", "dst", "kind", F.explode(F.array(*[F.lit(t) for t in [*evaluate.TIERS, "ALL"]])).alias("tier"))
        spell = lambda df: sorted(map(str, df.collect()))
        assert spell(evaluate.by_tier(actual, expected)) == spell(evaluate.compare(each, wanted, ["tier"]))
    actual = spark.createDataFrame(edge, schema)
    assert spell(evaluate.by_tier(actual, F.expr("src % 3 <> 0"))) == spell(evaluate.by_tier(actual, actual.where("src % 3 <> 0")))


def test_fallback_is_ranked_key_by_key(spark, monkeypatch):
    """Equal to the whole ranking by brute force, with ties, too few near callables, and ids sent or not."""
    file = spark.createDataFrame([(0, "src/a.ts"), (1, "src/b.ts"), (2, "lib/c.ts")], "id long, path string")
    for seed, dense in ((0, 60), (1, 200), (2, 12)):
        rng = random.Random(seed)
        names = ["run", "handlerOf", "sendResponse", "handleResponseHandler", "x"]
        symbols = [(i, rng.randrange(3), rng.choice(names), f"q{i:02}", rng.choice(["function", "class", "method"]), False, rng.random() < 0.1) for i in range(40)]
        edges = [(rng.randrange(40), rng.randrange(40), rng.choice(["CALLS", "REFERENCES", "REFERENCES", "CONTAINS"])) for _ in range(dense)]
        s = {x[0]: x for x in symbols}
        app = {i for i, x in s.items() if not x[6] and x[1] < 2}
        step = {(a, b) for a, b, k in edges if k in ("CALLS", "REFERENCES")}
        said = lambda i, word: word in s[i][2].lower()
        want = []
        for i in sorted(app):
            one = {b for a, b in step if a == i and said(b, "response")}
            two = {c for a, b in step if a == i for x, c in step if x == b and said(c, "response")}
            handlers = {b for a, b, k in edges if a == i and k == "REFERENCES" and said(b, "handler")}
            if s[i][4] in ("function", "method") and handlers and one | two:
                by = {k: {a for a, b, x in edges if b == i and x == k and a in app} for k in ("REFERENCES", "CALLS")}
                n = {k: (len(v), len({s[a][1] for a in v})) for k, v in by.items()}
                want.append((1 if one else 2, -len(handlers), -n["REFERENCES"][1], -n["CALLS"][1], -len(one | two), s[i][3], n["REFERENCES"][0], n["CALLS"][0]))
        r = roles.Roles(spark.createDataFrame(edges, "src long, dst long, kind string"), spark.createDataFrame(symbols, "id long, file_id long, short_name string, qualified_name string, kind string, exported boolean, is_test boolean"), file)
        for limit, most in ((2, 500_000), (6, 0), (50, 0)):
            monkeypatch.setattr(roles, "FEW", most)
            got = [(x.depth, -x.handlers, -x.references_files, -x.callers_files, -x.responses, x.qualified_name, x.references, x.callers) for x in r.fallback_terminal(limit=limit).collect()]
            assert got == sorted(want)[:limit]
    rows = spark.createDataFrame([(1, 5), (1, 5), (1, 5), (1, 4), (2, 9)], "a long, b long")
    assert sorted(map(tuple, roles.leading(rows, [F.col("a"), -F.col("b")], 2).collect())) == [(1, 5)] * 3
