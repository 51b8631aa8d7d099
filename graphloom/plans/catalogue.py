"""The registered queries over the star-schema code graph, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import budget, drift, evaluate, find, impact, link, modules, resolve, roles, traverse
from graphloom.plans.views import Graph, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
USAGE = "('CALLS', 'REFERENCES', 'IMPLEMENTS', 'INHERITS')"
RANK = "CASE tier WHEN 'COMPILER' THEN 0 WHEN 'LEXICAL' THEN 1 WHEN 'HEURISTIC' THEN 2 ELSE 3 END"
FAN = f"fan AS (SELECT dst AS id, count(*) AS fan_in FROM edge WHERE kind IN {USAGE} GROUP BY dst), p AS (SELECT coalesce(quantile_disc(fan_in, 0.95), 0) AS p95 FROM fan)"
SCORE = "round(0.4 / (1 + {d}) + 0.25 * CASE WHEN p95 > 0 THEN least(1.0, ln(1 + coalesce(fan_in, 0)) / ln(1 + p95)) ELSE 0 END + 0.2 * CAST(exported AS INT), 9)"


def query(sql: str | None = None, ctes: str = ""):
    """Register a function of a Graph under its name."""

    def add(f: Callable[[Graph], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Graph(spark, folder))
        if sql:
            ORACLES[f.__name__] = duck(sql, ctes)
        return f

    return add


SEEDS = {"callers_of": 3000007, "callees_of": 10000007, "references_to": 1000003, "imports_of": 3, "imported_by": 10, "implementations_of": 1000003, "inheritors_of": 2000001, "inherits_from": 2000011, "tests_for": 3000007, "contained_by": 10000007, "contains": 2000003}


def _patterns() -> None:
    for pattern, (kinds, reverse) in traverse.PATTERNS.items():
        here, there = ("dst", "src") if reverse else ("src", "dst")
        some = ", ".join(f"'{k}'" for k in kinds)

        def run(spark: SparkSession, folder: str, pattern: str = pattern, reverse: bool = reverse) -> DataFrame:
            g = Graph(spark, folder)
            return traverse.neighbours(g.edge if reverse else g.edge_by_src, g.symbol, g.file, pattern, SEEDS[pattern], fan=g.fan, most=g.p95).select("id", "stable_key", "path", "edge_kind", "tier", "site_line", "fan_in", F.round("score", 9).alias("score"))

        QUERIES[pattern] = run
        ORACLES[pattern] = duck(
            f"SELECT h.id, stable_key, path, edge_kind, tier, site_line, coalesce(fan_in, 0) AS fan_in, {SCORE.format(d=1)} AS score FROM h JOIN symbol s ON s.id = h.id JOIN file f ON f.id = s.file_id LEFT JOIN fan ON fan.id = h.id CROSS JOIN p WHERE n = 1",
            FAN + f", h AS (SELECT {there} AS id, kind AS edge_kind, tier, site_line, row_number() OVER (PARTITION BY {there} ORDER BY {RANK}, CASE WHEN kind = 'CALLS' THEN 0 ELSE 1 END, site_line NULLS FIRST, kind, confidence) AS n FROM edge WHERE {here} = {SEEDS[pattern]} AND kind IN ({some}))",
        )


_patterns()


@query("SELECT CAST(p95 AS BIGINT) AS p95 FROM p", FAN)
def fan_in_p95(g: Graph) -> DataFrame:
    return traverse.p95(g.fan)


@query(f"SELECT s.id, {SCORE.format(d=2)} AS score FROM symbol s LEFT JOIN fan ON fan.id = s.id CROSS JOIN p", FAN)
def ranked_score(g: Graph) -> DataFrame:
    joined = g.symbol.join(g.fan, "id", "left").crossJoin(F.broadcast(traverse.p95(g.fan)))  # one row
    return joined.select("id", F.round(S.score(2, F.coalesce("fan_in", F.lit(0)), F.col("p95"), F.col("exported")), 9).alias("score"))


@query("""SELECT (SELECT count(*) FROM unresolved_ref WHERE name IN (SELECT short_name FROM symbol WHERE id = 3000007)) AS unresolved, 0 AS external,
  coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM unresolved_ref WHERE name IN (SELECT short_name FROM symbol WHERE id = 3000007)), '') AS names""")
def reverse_completeness(g: Graph) -> DataFrame:
    return traverse.completeness(g.external, g.unresolved, g.symbol, 3000007, True)


@query("""SELECT (SELECT count(*) FROM unresolved_ref WHERE src = 2000008) AS unresolved, (SELECT count(*) FROM external_ref WHERE src = 2000008) AS external,
  coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM unresolved_ref WHERE src = 2000008), '') AS names""")
def forward_completeness(g: Graph) -> DataFrame:
    return traverse.completeness(g.external, g.unresolved, g.symbol, 2000008, False)


@query("SELECT kind, tier, count(*) AS n FROM edge GROUP BY kind, tier")
def tier_counts(g: Graph) -> DataFrame:
    return g.edge.groupBy("kind", "tier").agg(F.count("*").alias("n"))


@query(f"SELECT tier, count(*) AS sites FROM (SELECT DISTINCT tier, src, site_line, kind FROM edge WHERE kind IN {USAGE}) GROUP BY tier")
def reference_sites(g: Graph) -> DataFrame:
    return g.edge.where(F.col("kind").isin(S.USAGE)).select("tier", "src", "site_line", "kind").distinct().groupBy("tier").agg(F.count("*").alias("sites"))


@query("SELECT (SELECT count(*) FROM symbol) AS symbols, (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM external_ref) AS externals, (SELECT count(*) FROM unresolved_ref) AS unresolved, (SELECT count(*) FROM file WHERE parse_state <> 'ok') AS failures")
def store_counts(g: Graph) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(g.symbol, "symbols").crossJoin(n(g.edge, "edges")).crossJoin(n(g.external, "externals")).crossJoin(n(g.unresolved, "unresolved")).crossJoin(n(g.file.where("parse_state <> 'ok'"), "failures"))  # one row each


@query("SELECT path, count(s.id) AS symbols, CAST(coalesce(sum(CAST(is_test AS INT)), 0) AS BIGINT) AS test_symbols FROM file f LEFT JOIN symbol s ON s.file_id = f.id GROUP BY path")
def doc_symbol_counts(g: Graph) -> DataFrame:
    return modules.symbol_counts(g.symbol, g.file)


ROWS = "rows AS (SELECT a.path AS src_file, b.path AS dst_file, t.short_name AS dst_name, t.kind AS dst_kind, e.kind, e.tier FROM edge e JOIN symbol s ON s.id = e.src JOIN file a ON a.id = s.file_id JOIN symbol t ON t.id = e.dst JOIN file b ON b.id = t.file_id WHERE e.kind NOT IN ('CONTAINS', 'TESTS'))"
# in the star-schema graph a module is one region's folder
COUNTS = "counts AS (SELECT path, count(s.id) AS symbols, coalesce(sum(CAST(is_test AS INT)), 0) AS tests FROM file f LEFT JOIN symbol s ON s.file_id = f.id GROUP BY path), away AS (SELECT regexp_extract(path, '^(.*)/', 1) AS module FROM counts GROUP BY 1 HAVING sum(symbols) > 0 AND sum(symbols) = sum(tests))"
CROSS = "crossing AS (SELECT *, regexp_extract(src_file, '^(.*)/', 1) AS source, regexp_extract(dst_file, '^(.*)/', 1) AS target FROM rows), x AS (SELECT * FROM crossing WHERE source <> target AND tier IN ('COMPILER', 'LEXICAL', 'HEURISTIC') AND source NOT IN (SELECT module FROM away) AND target NOT IN (SELECT module FROM away))"
DEPS = "deps AS (SELECT source, target, count(*) FILTER (tier = 'COMPILER') AS compiler, count(*) FILTER (tier = 'LEXICAL') AS lexical, count(*) FILTER (tier = 'HEURISTIC') AS heuristic, count(*) AS total FROM x GROUP BY 1, 2), ev AS (SELECT *, CASE WHEN compiler + lexical = 0 THEN 'unverified' WHEN compiler + lexical > heuristic THEN 'resolved' ELSE 'weak' END AS evidence FROM deps)"
GRAPH = f"{ROWS}, {COUNTS}, {CROSS}, {DEPS}"


def _cross(g: Graph) -> DataFrame:
    return modules.crossing(modules.dependency_rows(g.edge, g.symbol, g.file), modules.excluded(modules.symbol_counts(g.symbol, g.file)))


@query("SELECT src_file, dst_file, kind, tier, count(*) AS n FROM rows GROUP BY ALL", ROWS)
def doc_edge_rows(g: Graph) -> DataFrame:
    return modules.dependency_rows(g.edge, g.symbol, g.file).groupBy("src_file", "dst_file", "kind", "tier").agg(F.count("*").alias("n"))


@query("SELECT source, target, compiler, lexical, heuristic, total, evidence FROM ev", GRAPH)
def module_deps_pivot(g: Graph) -> DataFrame:
    return modules.dependencies(_cross(g))


@query("SELECT regexp_extract(path, '^(.*)/', 1) AS module, count(DISTINCT path) AS files, CAST(sum(symbols) AS BIGINT) AS symbols, CAST(sum(tests) AS BIGINT) AS test_symbols FROM counts GROUP BY 1", COUNTS)
def module_summaries(g: Graph) -> DataFrame:
    return modules.summaries(modules.symbol_counts(g.symbol, g.file))


@query("SELECT module FROM away", COUNTS)
def all_test_modules(g: Graph) -> DataFrame:
    return modules.test_modules(modules.symbol_counts(g.symbol, g.file))


@query("SELECT module, string_agg(name, ',' ORDER BY r) AS names FROM (SELECT target AS module, dst_name AS name, row_number() OVER (PARTITION BY target ORDER BY count(*) DESC, dst_name) AS r FROM x WHERE tier <> 'HEURISTIC' AND dst_kind <> 'file' GROUP BY 1, 2) WHERE r <= 6 GROUP BY 1", GRAPH)
def module_surface(g: Graph) -> DataFrame:
    return modules.ranked_surface(modules.surface(_cross(g)))


@query("SELECT target AS module, dst_name AS name, string_agg(DISTINCT source, ',' ORDER BY source) AS users FROM x GROUP BY 1, 2", GRAPH)
def module_incoming(g: Graph) -> DataFrame:
    return modules.incoming(_cross(g))


@query("SELECT count(*) AS pairs, count(*) FILTER (evidence = 'unverified') AS unverified, greatest(0, count(*) FILTER (compiler + lexical > 0) - 3) AS omitted FROM ev", GRAPH)
def dependency_totals(g: Graph) -> DataFrame:
    return modules.totals(modules.dependencies(_cross(g)), 3)


@query("""SELECT source, target, CAST(sum(compiler) AS BIGINT) AS compiler, CAST(sum(lexical) AS BIGINT) AS lexical, CAST(sum(heuristic) AS BIGINT) AS heuristic, CAST(sum(total) AS BIGINT) AS total
FROM (SELECT array_to_string(string_split(source, '/')[1:2], '/') AS source, array_to_string(string_split(target, '/')[1:2], '/') AS target, compiler, lexical, heuristic, total FROM ev WHERE evidence = 'resolved') WHERE source <> target AND source LIKE 'src%' AND target LIKE 'src%' GROUP BY 1, 2""", GRAPH)
def rollup_modules(g: Graph) -> DataFrame:
    return modules.simplified(modules.dependencies(_cross(g)))


@query("SELECT DISTINCT module FROM r WHERE module <> 'src/asia'", GRAPH + ", r AS (SELECT 'src/asia' AS module UNION SELECT target FROM r JOIN ev ON ev.source = r.module AND evidence <> 'unverified')")
def module_reachability(g: Graph) -> DataFrame:
    deps = modules.dependencies(_cross(g)).where("evidence <> 'unverified'")
    return impact.reachable(deps.select("source", "target"), "src/asia")


APP = "app AS (SELECT s.*, path FROM symbol s JOIN file f ON f.id = s.file_id WHERE NOT is_test AND path LIKE 'src/%'), used AS (SELECT e.src, e.dst, e.kind, a.file_id AS src_file FROM edge e JOIN app a ON a.id = e.src), inbound AS (SELECT dst AS id, count(DISTINCT src) AS inbound_callers, count(DISTINCT src_file) AS inbound_files FROM used WHERE kind = 'CALLS' GROUP BY dst), outbound AS (SELECT src AS id, count(DISTINCT dst) AS outbound_calls FROM edge WHERE kind = 'CALLS' GROUP BY src), cand AS (SELECT * FROM app WHERE kind IN ('function', 'method', 'property', 'variable'))"
TAIL = "coalesce(inbound_callers, 0) AS inbound_callers, coalesce(inbound_files, 0) AS inbound_files, coalesce(outbound_calls, 0) AS outbound_calls"
JOINS = "LEFT JOIN inbound i ON i.id = c.id LEFT JOIN outbound o ON o.id = c.id"


@query(f"SELECT qualified_name, path, handlers, {TAIL} FROM cand c JOIN hc ON hc.id = c.id {JOINS} ORDER BY handlers DESC, inbound_files DESC, outbound_calls DESC, exported DESC, qualified_name LIMIT 3", APP + ", hc AS (SELECT src AS id, count(DISTINCT dst) AS handlers FROM edge JOIN symbol t ON t.id = dst WHERE edge.kind = 'REFERENCES' AND (lower(t.short_name) LIKE '%supplier%' OR lower(t.short_name) LIKE '%handler%') GROUP BY src)")
def role_handler_chain(g: Graph) -> DataFrame:
    return roles.Roles(g.edge, g.symbol, g.file).handler_chain(["supplier", "handler"]).select("qualified_name", "path", "handlers", "inbound_callers", "inbound_files", "outbound_calls")


@query(f"SELECT qualified_name, path, errors, {TAIL} FROM cand c JOIN hc ON hc.id = c.id {JOINS} ORDER BY errors DESC, inbound_files DESC, inbound_callers DESC, outbound_calls DESC, qualified_name LIMIT 3", APP + ", hc AS (SELECT src AS id, count(DISTINCT dst) AS errors FROM edge JOIN symbol t ON t.id = dst WHERE edge.kind IN ('CALLS', 'REFERENCES') AND (lower(t.short_name) LIKE '%widget%' OR lower(t.short_name) LIKE '%ring%') GROUP BY src)")
def role_exception_boundary(g: Graph) -> DataFrame:
    return roles.Roles(g.edge, g.symbol, g.file).exception_boundary(["widget", "ring"]).select("qualified_name", "path", "errors", "inbound_callers", "inbound_files", "outbound_calls")


@query("SELECT qualified_name, path, user_files, used_members, members, coalesce(direct_files, 0) AS direct_files FROM (SELECT o.id, o.qualified_name, o.path, count(DISTINCT c.dst) AS members, count(DISTINCT CASE WHEN u.src_file <> o.file_id THEN c.dst END) AS used_members, count(DISTINCT CASE WHEN u.src_file <> o.file_id THEN u.src_file END) AS user_files FROM app o LEFT JOIN edge c ON c.src = o.id AND c.kind = 'CONTAINS' LEFT JOIN used u ON u.dst = c.dst AND u.kind IN ('CALLS', 'REFERENCES') WHERE o.kind IN ('class', 'interface') AND o.exported GROUP BY 1, 2, 3) m LEFT JOIN (SELECT dst AS id, count(DISTINCT src_file) AS direct_files FROM used WHERE kind IN ('CALLS', 'REFERENCES') GROUP BY dst) d ON d.id = m.id ORDER BY user_files DESC, used_members DESC, members DESC, direct_files DESC, qualified_name LIMIT 3", APP)
def role_lifecycle_carrier(g: Graph) -> DataFrame:
    return roles.Roles(g.edge, g.symbol, g.file).lifecycle_carrier().select("qualified_name", "path", "user_files", "used_members", "members", "direct_files")


@query(
    "SELECT qualified_name, path, depth, responses, handlers, coalesce(\"references\", 0) AS \"references\", coalesce(callers, 0) AS callers FROM cand c JOIN rc ON rc.id = c.id JOIN hc ON hc.id = c.id LEFT JOIN iu ON iu.id = c.id ORDER BY depth, handlers DESC, coalesce(reference_files, 0) DESC, coalesce(call_files, 0) DESC, responses DESC, qualified_name LIMIT 3",
    APP + """, st AS (SELECT DISTINCT src, dst FROM edge WHERE kind IN ('CALLS', 'REFERENCES')), t1 AS (SELECT src, dst FROM st JOIN symbol t ON t.id = dst WHERE lower(t.short_name) LIKE '%supplier%'),
rr AS (SELECT src, dst, 1 AS depth FROM t1 UNION ALL SELECT a.src, b.dst, 2 FROM st a JOIN t1 b ON b.src = a.dst), rc AS (SELECT src AS id, CAST(min(depth) AS BIGINT) AS depth, count(DISTINCT dst) AS responses FROM rr GROUP BY src),
hc AS (SELECT src AS id, count(DISTINCT dst) AS handlers FROM edge JOIN symbol t ON t.id = dst WHERE edge.kind = 'REFERENCES' AND lower(t.short_name) LIKE '%supplier%' GROUP BY src),
iu AS (SELECT dst AS id, count(DISTINCT CASE WHEN kind = 'REFERENCES' THEN src END) AS "references", count(DISTINCT CASE WHEN kind = 'REFERENCES' THEN src_file END) AS reference_files, count(DISTINCT CASE WHEN kind = 'CALLS' THEN src END) AS callers, count(DISTINCT CASE WHEN kind = 'CALLS' THEN src_file END) AS call_files FROM used GROUP BY dst)""",
)
def role_fallback_terminal(g: Graph) -> DataFrame:
    return roles.Roles(g.edges, g.symbol, g.file).fallback_terminal(["supplier"], ["supplier"]).select("qualified_name", "path", "depth", "responses", "handlers", "references", "callers")


@query("SELECT id, CAST(0 AS BIGINT) AS phase, stable_key FROM symbol WHERE qualified_name = 'Customer#000000003' UNION ALL SELECT id, 1, stable_key FROM symbol WHERE short_name = 'o7'")
def find_exact(g: Graph) -> DataFrame:
    exact = find.find(g.symbol, g.file, "Customer#000000003").where("phase = 0")
    short = find.find(g.symbol, g.file, "o7", kinds=["method"]).where("phase = 1")
    return exact.union(short).select("id", "phase", "stable_key")


@query("""SELECT id, round(score, 9) AS score FROM (SELECT id, - ln((n - n0 + 0.5) / (n0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * d / mean)) - ln((n - n1 + 0.5) / (n1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * d / mean)) AS score
FROM t CROSS JOIN (SELECT count(*) AS n, avg(d) AS mean, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM t) WHERE f0 > 0 AND f1 > 0)""",
       "t AS (SELECT id, greatest(0, length(short_name) - 2) + greatest(0, length(qualified_name) - 2) + greatest(0, coalesce(length(signature), 0) - 2) AS d, (length(z) - length(replace(z, 'widget', ''))) / 6 AS f0, (length(z) - length(replace(z, 'red', ''))) / 3 AS f1 FROM (SELECT *, lower(concat(short_name, '|', qualified_name, '|', coalesce(signature, ''))) AS z FROM symbol))")
def find_bm25(g: Graph) -> DataFrame:
    return find.full_text(g.symbol, "red WIDGET of").select("id", F.round("score", 9).alias("score"))


@query("SELECT id FROM symbol WHERE qualified_name = 'Customer#000000005'")
def seed_resolution(g: Graph) -> DataFrame:
    return traverse.seed(g.symbol, "Customer#000000005").union(traverse.seed(g.symbol, "small ring"))


@query(f"SELECT b.id, b.depth, b.tier, {SCORE.format(d='b.depth')} AS score, CASE WHEN EXISTS (SELECT 1 FROM dep WHERE depth > 6) THEN 'depth 6 reached' ELSE '' END AS warnings FROM (SELECT e.src AS id, d.depth, min_by(e.tier, {RANK}) AS tier FROM dep d JOIN edge e ON e.src = d.id AND e.kind IN {USAGE} JOIN dep t ON t.id = e.dst AND t.depth = d.depth - 1 WHERE d.depth <= 6 GROUP BY 1, 2) b JOIN symbol s ON s.id = b.id LEFT JOIN fan ON fan.id = b.id CROSS JOIN p",
       FAN + f", bfs AS (SELECT CAST(3000007 AS BIGINT) AS id, CAST(0 AS BIGINT) AS depth UNION SELECT e.src, b.depth + 1 FROM bfs b JOIN edge e ON e.dst = b.id AND e.kind IN {USAGE} WHERE b.depth < 7), dep AS (SELECT id, min(depth) AS depth FROM bfs GROUP BY id)")
def impact_radius(g: Graph) -> DataFrame:
    rows, warnings = impact.radius(g.edge, g.symbol, [3000007], nodes=100_000, fan=g.fan, most=g.p95)
    return rows.select("id", "depth", "tier", F.round("score", 9).alias("score"), F.lit("; ".join(warnings)).alias("warnings"))


REFS = "SELECT event_id AS ref, 2000000 + user_id AS src, CAST(user_id % 25 AS BIGINT) AS src_file, p_name AS name, 'CALLS' AS kind, event_id % 7 AS site_line, CASE WHEN event_id % 3 = 0 THEN 'x' END AS receiver, CASE WHEN event_id % 4 = 1 THEN CAST(event_id % 25 AS BIGINT) END AS binding_file, CASE event_id % 4 WHEN 1 THEN 'file' WHEN 2 THEN CASE WHEN event_id % 8 = 2 THEN 'external' ELSE 'unresolved' END END AS binding_kind FROM {events} JOIN {part} ON p_partkey = event_id % (SELECT count(*) FROM {part})"


def _refs(g: Graph) -> DataFrame:
    refs = g.spark.sql(REFS, events=g.table("events"), part=g.table("part"))
    return refs.withColumns({"receiver_type": F.lit(None).cast("string"), "package": F.lit("pkg"), "binding_reason": F.lit(None).cast("string")})


def _known(g: Graph) -> DataFrame:
    return g.symbol.where("kind = 'function'").withColumn("visibility", F.when(F.col("id") % 9 == 0, "private"))


@query("""SELECT ref, n, CASE WHEN binding_kind = 'external' THEN 'EXTERNAL' WHEN binding_kind = 'unresolved' THEN 'UNRESOLVED' WHEN n = 0 THEN 'UNRESOLVED' WHEN receiver IS NOT NULL THEN CASE WHEN n > 8 THEN 'UNRESOLVED' ELSE 'HEURISTIC' END
  WHEN binding_kind = 'file' THEN 'LEXICAL' WHEN n = 1 AND n = allc THEN 'LEXICAL' WHEN n > 8 THEN 'UNRESOLVED' ELSE 'HEURISTIC' END AS tier
FROM (SELECT q.ref, q.binding_kind, q.receiver, count(s.id) AS allc, count(CASE WHEN s.id % 9 = 0 AND s.file_id <> q.src_file THEN NULL ELSE s.id END) AS n
  FROM refs q LEFT JOIN symbol s ON s.kind = 'function' AND s.short_name = q.name AND (q.binding_file IS NULL OR q.binding_file = s.file_id) AND (q.binding_kind IS NULL OR q.binding_kind = 'file') GROUP BY 1, 2, 3)""", "refs AS (" + REFS.format(events="events", part="part") + ")")
def candidate_tiering(g: Graph) -> DataFrame:
    return resolve.tiers(_refs(g), _known(g)).select("ref", "n", "tier")


@query("SELECT p.src AS src, p.dst AS dst FROM (SELECT DISTINCT a.dst AS src, b.dst AS dst FROM edge t JOIN edge a ON a.src = t.src AND a.kind = 'CONTAINS' JOIN symbol x ON x.id = a.dst JOIN edge b ON b.src = t.dst AND b.kind = 'CONTAINS' JOIN symbol y ON y.id = b.dst WHERE t.kind IN ('IMPLEMENTS', 'INHERITS') AND x.start_line = y.start_line AND a.dst <> b.dst) p")
def member_implements(g: Graph) -> DataFrame:
    # methods of the graph have names of their own; the line stands for the name here
    named = g.symbol.withColumn("short_name", F.col("start_line").cast("string"))
    return resolve.members(g.edge, named).select("src", "dst")


@query("SELECT coalesce(p.id, f.id) AS src, c.id AS dst FROM symbol c LEFT JOIN symbol p ON p.file_id = c.file_id AND p.qualified_name = regexp_extract(c.qualified_name, '^(.*)\\.', 1) AND p.kind <> 'file' JOIN symbol f ON f.kind = 'file' AND f.file_id = c.file_id WHERE c.kind <> 'file'")
def containment_edges(g: Graph) -> DataFrame:
    return resolve.containment(g.symbol).select("src", "dst")


@query("SELECT src, dst, min_by(site_line, ordinal) AS site_line FROM (SELECT l_suppkey % 25 AS src, l_partkey % 25 AS dst, l_orderkey * 10 + l_linenumber * 1.0 AS ordinal, CAST(l_linenumber AS BIGINT) AS site_line FROM lineitem WHERE l_suppkey % 25 <> l_partkey % 25 GROUP BY ALL) GROUP BY 1, 2")
def import_edges(g: Graph) -> DataFrame:
    rows = g.table("lineitem").select((F.col("l_suppkey") % 25).alias("src"), (F.col("l_partkey") % 25).alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_linenumber").cast("long").alias("site_line"))
    return resolve.imports(rows)


@query("SELECT src, dst, kind, count(*) AS n FROM (SELECT src, dst, kind FROM edge WHERE kind = 'IMPLEMENTS' UNION ALL SELECT x.src, x.dst, 'IMPLEMENTS' FROM edge x WHERE x.kind = 'INHERITS' AND NOT EXISTS (SELECT 1 FROM edge y WHERE y.kind = 'IMPLEMENTS' AND y.src = x.src AND y.dst = x.dst)) GROUP BY ALL")
def insert_if_absent(g: Graph) -> DataFrame:
    new = g.edge.where("kind = 'INHERITS'").withColumn("kind", F.lit("IMPLEMENTS"))
    return resolve.insert_absent(g.edge.where("kind = 'IMPLEMENTS'"), new).groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


PROOF = "SELECT DISTINCT src, dst, kind, 'x' AS name FROM edge WHERE kind = 'CALLS' AND src % 7 = 0"


@query("SELECT tier, count(*) AS n FROM (SELECT CASE WHEN pr.src IS NOT NULL THEN 'COMPILER' ELSE e.tier END AS tier FROM edge e LEFT JOIN pr ON pr.src = e.src AND pr.dst = e.dst AND pr.kind = e.kind) GROUP BY tier", f"pr AS ({PROOF})")
def tier_promotion(g: Graph) -> DataFrame:
    proof = g.edge.where("kind = 'CALLS' and src % 7 = 0").select("src", "dst", "kind", F.lit("x").alias("name")).distinct()
    return resolve.promote(g.edge, g.unresolved, proof)[0].groupBy("tier").agg(F.count("*").alias("n"))


# all events enter both snapshots; of eleven users one has moved, of five one has more, of seven one was only touched
BEFORE = "SELECT concat('f', CAST(user_id AS STRING)) AS path, count(*) AS size, CAST(max(event_id) AS DOUBLE) AS mtime, CAST(sum(event_id) AS STRING) AS hash FROM {events} GROUP BY user_id"
AFTER = "SELECT concat(CASE WHEN user_id % 11 = 0 THEN 'g' ELSE 'f' END, CAST(user_id AS STRING)) AS path, count(*) + CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS size, CAST(max(event_id) + CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS mtime, concat(CAST(sum(event_id) AS STRING), CASE WHEN user_id % 5 = 0 THEN 'x' ELSE '' END) AS hash FROM {events} GROUP BY user_id"


@query("SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN (a.size = b.size AND a.mtime = b.mtime) OR a.hash = b.hash THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path", f"a AS ({BEFORE.format(events='events')}), b AS ({AFTER.format(events='events')})")
def drift_full_outer(g: Graph) -> DataFrame:
    before, after = (g.spark.sql(x, events=g.table("events")) for x in (BEFORE, AFTER))
    return drift.changes(before, after)


@query("SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 9) AS score FROM embeddings ORDER BY score DESC, id LIMIT 20")
def cosine_topk(g: Graph) -> DataFrame:
    rows = g.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return find.nearest(rows, rows.where("id = 0").select("vector")).select("id", F.round("score", 9).alias("score"))


@query("SELECT item, round(sum(1.0 / (60 + position)), 9) AS score FROM (SELECT c_custkey AS item, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer UNION ALL SELECT c_custkey, row_number() OVER (ORDER BY c_name DESC) FROM customer) GROUP BY item")
def rrf(g: Graph) -> DataFrame:
    some = g.table("customer").select(F.col("c_custkey").alias("item"), "c_acctbal", "c_name")
    one, two = find.positions(some, "a", [F.desc("c_acctbal"), F.col("item")]), find.positions(some, "b", [F.desc("c_name")])
    return find.fuse(one.union(two)).select("item", F.round("score", 9).alias("score"))


@query(r"SELECT c_custkey AS id, trim(lower(regexp_replace(regexp_replace(regexp_replace(concat('get', c_mktsegment, 'Value_of.', c_name), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[._\-/]+', ' ', 'g'))) AS words FROM customer")
def identifier_split(g: Graph) -> DataFrame:
    return g.table("customer").select(F.col("c_custkey").alias("id"), S.split_identifier(F.concat(F.lit("get"), "c_mktsegment", F.lit("Value_of."), "c_name")).alias("words"))


@query("SELECT kind, count(*) FILTER (a AND e) AS tp, count(*) FILTER (a AND NOT e) AS fp, count(*) FILTER (e AND NOT a) AS fn, CASE WHEN count(*) FILTER (a) = 0 THEN 1.0 ELSE round(count(*) FILTER (a AND e) / count(*) FILTER (a), 9) END AS precision, CASE WHEN count(*) FILTER (e) = 0 THEN 1.0 ELSE round(count(*) FILTER (a AND e) / count(*) FILTER (e), 9) END AS recall FROM (SELECT src, dst, kind, bool_or(tier <> 'HEURISTIC') AS a, bool_or(src % 3 <> 0) AS e FROM edge GROUP BY 1, 2, 3) WHERE a OR e GROUP BY kind")
def oracle_precision_recall(g: Graph) -> DataFrame:
    actual, expected = g.edge.where("tier <> 'HEURISTIC'").select("src", "dst", "kind"), g.edge.where("src % 3 <> 0").select("src", "dst", "kind")
    return evaluate.precision_recall(actual, expected).withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


@query("SELECT avg(quality) AS quality, avg(toxic) AS toxic, count(*) AS tasks FROM labels")
def benchmark_means(g: Graph) -> DataFrame:
    return evaluate.means(g.table("labels"), ["quality", "toxic"])


@query("""SELECT answer, ordinal, taken, max(used) OVER (PARTITION BY answer) AS used FROM w WHERE k > 0""",
       """s AS (SELECT conv_id AS answer, turn AS ordinal, CASE WHEN turn = 0 THEN 0 ELSE 1 END AS priority, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn = 0 THEN 0 ELSE 1 END, turn) AS k FROM conversations),
w AS (SELECT DISTINCT answer, CAST(0 AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS used, false AS taken, CAST(0 AS BIGINT) AS k FROM s
  UNION ALL SELECT s.answer, s.ordinal, CASE WHEN s.priority = 0 OR w.used + s.cost + (CASE WHEN w.used > 0 THEN 1 ELSE 0 END) <= 200 THEN w.used + s.cost + (CASE WHEN w.used > 0 THEN 1 ELSE 0 END) ELSE w.used END, s.priority = 0 OR w.used + s.cost + (CASE WHEN w.used > 0 THEN 1 ELSE 0 END) <= 200, s.k FROM w JOIN s ON s.answer = w.answer AND s.k = w.k + 1)""")
def budget_pack(g: Graph) -> DataFrame:
    rows = g.table("conversations").select(F.col("conv_id").alias("answer"), F.col("turn").alias("ordinal"), F.when(F.col("turn") == 0, 0).otherwise(1).alias("priority"), "text")
    return budget.pack(rows, 200)


@query("SELECT doc_id AS id, doc_id % 3 <> 0 AS verified FROM documents")
def body_hash_verify(g: Graph) -> DataFrame:
    docs = g.table("documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content"))
    symbols = docs.select("id", F.col("id").alias("file"), F.lit(0).alias("start"), F.octet_length("content").alias("end"), F.sha2(F.when(F.col("id") % 3 != 0, F.col("content")).otherwise(F.lit("other").cast("binary")), 256).alias("body_hash"))
    return budget.verified(symbols, docs.select(F.col("id").alias("file"), "content"))


@query("SELECT id FROM symbol WHERE id % 4 <> 0")
def stale_embeddings(g: Graph) -> DataFrame:
    made = g.symbol.where("id % 4 = 0").select(F.col("id").alias("symbol_id"), F.lit("m").alias("model"))
    return find.stale(g.symbol, made, "m").select("id")


@query("SELECT id, CASE WHEN n = 1 THEN base ELSE concat(base, '~', h, CASE WHEN k > 1 THEN concat('~', CAST(k AS STRING)) ELSE '' END) END AS stable_key FROM (SELECT *, count(*) OVER (PARTITION BY base) AS n, row_number() OVER (PARTITION BY base, h ORDER BY start) AS k FROM (SELECT p_partkey AS id, p_name AS base, substr(sha256(p_type), 1, 8) AS h, p_partkey AS start FROM part))")
def collision_keys(g: Graph) -> DataFrame:
    rows = g.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("base"), F.col("p_type").alias("signature"), F.col("p_partkey").alias("start"))
    return resolve.collision_keys(rows).select("id", "stable_key")


@query("SELECT p.file, p.at, max_by(s.key, s.start * 1000000 - s.end) AS key FROM (SELECT DISTINCT l_suppkey AS file, l_orderkey AS at FROM lineitem) p JOIN (SELECT l_suppkey AS file, l_partkey * 3 AS start, l_partkey * 3 + l_linenumber * 900 + 1 AS \"end\", max(l_partkey * 10 + l_linenumber) AS key FROM lineitem GROUP BY 1, 2, 3) s ON s.file = p.file AND s.start <= p.at AND p.at < s.end GROUP BY 1, 2")
def enclosing_symbol(g: Graph) -> DataFrame:
    items = g.table("lineitem")
    points = items.select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("at")).distinct()
    spans = items.select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") * 3).alias("start"), (F.col("l_partkey") * 3 + F.col("l_linenumber") * 900 + 1).alias("end"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("key"))
    return resolve.enclosing(points, spans.groupBy("file", "start", "end").agg(F.max("key").alias("key")))


@query("SELECT p.owner, p.name, p.at, max_by(b.type, b.start) AS type FROM (SELECT DISTINCT user_id AS owner, event_type AS name, event_id AS at FROM events) p LEFT JOIN (SELECT user_id AS owner, event_type AS name, event_id + 1 AS start, props AS type FROM events) b ON b.owner = p.owner AND b.name = p.name AND b.start <= p.at GROUP BY 1, 2, 3")
def as_of_binding(g: Graph) -> DataFrame:
    rows = g.table("events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("name"), "event_id", "props")
    points = rows.select("owner", "name", F.col("event_id").alias("at"))
    return resolve.as_of(points, rows.select("owner", "name", (F.col("event_id") + 1).alias("start"), F.col("props").alias("type")))


EXPORTS = "SELECT concat('m', CAST(n_nationkey AS STRING)) AS file, concat('x', CAST(n_nationkey % 4 AS STRING)) AS name, CAST(NULL AS STRING) AS source, false AS star, CAST(0 AS BIGINT) AS ordinal FROM {nation} UNION ALL SELECT concat('m', CAST(n_nationkey AS STRING)), CAST(NULL AS STRING), concat('m', CAST(n_nationkey - 3 AS STRING)), true, CAST(1 AS BIGINT) FROM {nation} WHERE n_nationkey >= 3"


@query("SELECT concat('m', CAST(f AS STRING)) AS file, name, concat('m', CAST(max(o) AS STRING)) AS owner FROM r GROUP BY f, name", "r AS (SELECT CAST(n_nationkey AS BIGINT) AS f, concat('x', CAST(n_nationkey % 4 AS STRING)) AS name, CAST(n_nationkey AS BIGINT) AS o FROM nation UNION SELECT r.f + 3, r.name, r.o FROM r WHERE r.f + 3 < 25)")
def export_map_star(g: Graph) -> DataFrame:
    # in a chain of barrels the nearest owner, the one with the largest number, comes first
    return link.export_map(g.spark.sql(EXPORTS, nation=g.table("nation")))


@query("SELECT page_id AS ref, CASE WHEN (page_id * 7) % 25 % 8 <> 7 THEN concat('src/', lower(replace(r_name, ' ', '_')), '/', lower(n_name), '.ts') END AS path, CASE WHEN (page_id * 7) % 25 % 8 = 7 THEN concat('../', lower(replace(r_name, ' ', '_')), '/./', lower(n_name)) END AS package FROM pages JOIN nation ON n_nationkey = (page_id * 7) % 25 JOIN region ON r_regionkey = n_regionkey")
def specifier_resolution(g: Graph) -> DataFrame:
    target = g.table("nation").join(g.table("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("k"), F.concat(F.lit("../"), F.lower(F.regexp_replace("r_name", " ", "_")), F.lit("/./"), F.lower("n_name")).alias("specifier"))
    refs = g.table("pages").select(F.col("page_id").alias("ref"), F.lit("src/asia/x.ts").alias("path"), ((F.col("page_id") * 7) % 25).alias("k")).join(target, "k")
    return link.specifiers(refs.select("ref", "path", "specifier"), g.file)


@query("SELECT conv_id AS task, name, first FROM (SELECT DISTINCT conv_id, 'the' AS name FROM conversations) t LEFT JOIN (SELECT conv_id, min(turn) AS first FROM conversations WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_$])the($|[^\\p{L}\\p{N}_$])') GROUP BY 1) h USING (conv_id)")
def evidence_mentions(g: Graph) -> DataFrame:
    texts = g.table("conversations").select(F.col("conv_id").alias("task"), F.col("turn").alias("ordinal"), "text")
    return evaluate.mentions(texts, texts.select("task").distinct().withColumn("name", F.lit("the")))


@query("SELECT reason, count(*) AS n FROM unresolved_ref GROUP BY reason")
def unresolved_reasons(g: Graph) -> DataFrame:
    return g.unresolved.groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT 'file' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS total FROM file WHERE path NOT LIKE 'src/asia/%' UNION ALL SELECT 'symbol', count(*), CAST(sum(id) AS BIGINT) FROM symbol WHERE id NOT IN (SELECT id FROM dead)
UNION ALL SELECT 'edge', count(*), CAST(sum(src + dst) AS BIGINT) FROM edge WHERE src NOT IN (SELECT id FROM dead) AND dst NOT IN (SELECT id FROM dead) UNION ALL SELECT 'external', count(*), CAST(sum(src) AS BIGINT) FROM external_ref WHERE src NOT IN (SELECT id FROM dead)
UNION ALL SELECT 'unresolved', count(*), CAST(sum(src) AS BIGINT) FROM unresolved_ref WHERE src NOT IN (SELECT id FROM dead)""", "dead AS (SELECT s.id FROM symbol s JOIN file f ON f.id = s.file_id WHERE path LIKE 'src/asia/%')")
def cascade_delete(g: Graph) -> DataFrame:
    """What every table keeps when one folder's files go."""
    from graphloom.sources.store import cascade

    file, symbol, left = cascade(g.file, g.symbol, {"edge": g.edge, "external": g.external, "unresolved": g.unresolved}, g.file.where(F.col("path").startswith("src/asia/")).select("path"))
    sums = {"file": (file, F.col("id")), "symbol": (symbol, F.col("id")), "edge": (left["edge"], F.col("src") + F.col("dst")), "external": (left["external"], F.col("src")), "unresolved": (left["unresolved"], F.col("src"))}
    rows = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(c).alias("total")) for name, (df, c) in sums.items()]
    return reduce(DataFrame.unionAll, rows)


@query('SELECT "column", path, row_number() OVER (PARTITION BY "column" ORDER BY path) - 1 AS "row" FROM (SELECT id % 3 AS "column", path FROM file)')
def map_rows(g: Graph) -> DataFrame:
    return impact.rows_in_columns(g.file.select((F.col("id") % 3).alias("column"), "path")).withColumn("row", F.col("row").cast("long"))
