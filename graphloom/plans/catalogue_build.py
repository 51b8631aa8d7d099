"""Further registered queries: extraction, linking, the compiler pass, evaluation and the public calls.

Sources to extract from are written from the star-schema tables, so that SQL can say which
symbols and edges they hold without reading them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import evaluate, find, link, modules, resolve
from graphloom.plans import index, report, tools
from graphloom.plans.catalogue import FAN, GRAPH, RANK, SCORE, SEEDS, USAGE, _cross, query
from graphloom.plans.views import Graph
from graphloom.sources.extract import extracted


def _source(g: Graph, folder: str, ending: str, head: str, line: str, tail: str) -> DataFrame:
    """One file for each nation: a head, a line for each of its suppliers in order, a tail. {n} and {s} are keys."""
    fill = lambda text, **c: F.concat(*[x for part in text.replace("{n}", "\0n\0").replace("{s}", "\0s\0").split("\0") for x in [c[part].cast("string") if part in c else F.lit(part)]])
    nation, supplier = g.table("nation"), g.table("supplier")
    lines = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list("s_suppkey")).alias("keys"))
    body = F.array_join(F.transform(F.coalesce("keys", F.array().cast("array<long>")), lambda s: fill(line, n=F.col("n_nationkey"), s=s)), "")
    text = F.concat(fill(head, n=F.col("n_nationkey")), body, fill(tail, n=F.col("n_nationkey")))
    return nation.join(lines, "n_nationkey", "left").select(F.concat(F.lit(folder + "/f"), F.col("n_nationkey").cast("string"), F.lit(ending)).alias("path"), F.encode(text, "utf-8").alias("content"))


def _typescript(g: Graph) -> DataFrame:
    return _source(g, "src", ".ts", "import { f0 } from './f0.js';\nexport class C{n} extends f0 {\n", "  m{s}(a: T{s}): void { this.m{s}(a); }\n", "}\nexport function f{n}() { f0(); }\n")


def _python(g: Graph) -> DataFrame:
    return _source(g, "pkg", ".py", "from .f0 import g as h\nclass C{n}(h):\n    x = 1\n", "    def m{s}(self, a: T{s}) -> int:\n        return self.m{s}(a)\n", "def g():\n    return h()\n")


ROWS = "s AS (SELECT n_nationkey AS n, s_suppkey AS k, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY n_nationkey) AS c FROM nation JOIN supplier ON s_nationkey = n_nationkey), f AS (SELECT n_nationkey AS n, count(s_suppkey) AS c FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)"


@query("""SELECT concat('ts:src/f', n, '.ts#C', n) AS stable_key, 'class' AS kind, concat('class C', n, ' extends f0') AS signature, 2 AS start_line, CAST(3 + c AS INT) AS end_line, true AS exported FROM f
UNION ALL SELECT concat('ts:src/f', n, '.ts#C', n, '.m', k), 'method', concat('m', k, '(a: T', k, '): void'), CAST(2 + i AS INT), CAST(2 + i AS INT), true FROM s
UNION ALL SELECT concat('ts:src/f', n, '.ts#f', n), 'function', concat('function f', n, '()'), CAST(4 + c AS INT), CAST(4 + c AS INT), true FROM f""", ROWS)
def typescript_symbols(g: Graph) -> DataFrame:
    return extracted(_typescript(g)).select(F.explode("symbols").alias("s")).select("s.stable_key", "s.kind", "s.signature", "s.start_line", "s.end_line", "s.exported")


@query("""SELECT concat('ts:src/f', n, '.ts#C', n) AS from_key, 'f0' AS name, CAST(NULL AS STRING) AS receiver, 'INHERITS' AS kind, 2 AS site_line FROM f
UNION ALL SELECT concat('ts:src/f', n, '.ts#C', n, '.m', k), concat('T', k), NULL, 'REFERENCES', CAST(2 + i AS INT) FROM s UNION ALL SELECT concat('ts:src/f', n, '.ts#C', n, '.m', k), concat('m', k), 'this', 'CALLS', CAST(2 + i AS INT) FROM s
UNION ALL SELECT concat('ts:src/f', n, '.ts#C', n, '.m', k), 'a', NULL, 'REFERENCES', CAST(2 + i AS INT) FROM s UNION ALL SELECT concat('ts:src/f', n, '.ts#f', n), 'f0', NULL, 'CALLS', CAST(4 + c AS INT) FROM f""", ROWS)
def typescript_references(g: Graph) -> DataFrame:
    return extracted(_typescript(g)).select(F.explode("refs").alias("r")).select("r.from_key", "r.name", "r.receiver", "r.kind", "r.site_line")


@query("""SELECT concat('py:pkg/f', n, '.py#C', n) AS stable_key, 'class' AS kind, CAST(NULL AS STRING) AS signature, 2 AS start_line, CAST(3 + 2 * c AS INT) AS end_line FROM f
UNION ALL SELECT concat('py:pkg/f', n, '.py#C', n, '.m', k), 'method', concat('(self, a: T', k, ') -> int'), CAST(2 + 2 * i AS INT), CAST(3 + 2 * i AS INT) FROM s
UNION ALL SELECT concat('py:pkg/f', n, '.py#g'), 'function', '()', CAST(4 + 2 * c AS INT), CAST(5 + 2 * c AS INT) FROM f""", ROWS)
def python_symbols(g: Graph) -> DataFrame:
    return extracted(_python(g)).select(F.explode("symbols").alias("s")).select("s.stable_key", "s.kind", "s.signature", "s.start_line", "s.end_line")


@query("""SELECT concat('py:pkg/f', n, '.py#') AS from_key, 'h' AS name, CAST(NULL AS STRING) AS receiver, CAST(NULL AS STRING) AS receiver_type, 'INHERITS' AS kind, 2 AS site_line, concat('C', n) = '' OR length(concat('class C', n, '(')) > 0 AS placed FROM f
UNION ALL SELECT concat('py:pkg/f', n, '.py#C', n), 'int', NULL, NULL, 'REFERENCES', CAST(2 + 2 * i AS INT), true FROM s
UNION ALL SELECT concat('py:pkg/f', n, '.py#C', n, '.m', k), concat('m', k), 'self', concat('C', n), 'CALLS', CAST(3 + 2 * i AS INT), true FROM s
UNION ALL SELECT concat('py:pkg/f', n, '.py#g'), 'h', NULL, NULL, 'CALLS', CAST(5 + 2 * c AS INT), true FROM f""", ROWS)
def python_references(g: Graph) -> DataFrame:
    rows = extracted(_python(g)).select(F.explode("refs").alias("r")).select("r.*")
    return rows.select("from_key", "name", "receiver", "receiver_type", "kind", "site_line", F.col("site_column").isNotNull().alias("placed"))


@query("""SELECT concat('ts:src/f', n, '.ts#C', n) AS src, 'ts:src/f0.ts#f0' AS dst, 'INHERITS' AS kind, 'LEXICAL' AS tier FROM f
UNION ALL SELECT concat('ts:src/f', n, '.ts#f', n), 'ts:src/f0.ts#f0', 'CALLS', 'LEXICAL' FROM f WHERE n <> 0
UNION ALL SELECT concat('ts:src/f', n, '.ts#'), 'ts:src/f0.ts#', 'IMPORTS', 'LEXICAL' FROM f WHERE n <> 0
UNION ALL SELECT concat('ts:src/f', n, '.ts#'), concat('ts:src/f', n, '.ts#C', n), 'CONTAINS', 'LEXICAL' FROM f UNION ALL SELECT concat('ts:src/f', n, '.ts#'), concat('ts:src/f', n, '.ts#f', n), 'CONTAINS', 'LEXICAL' FROM f
UNION ALL SELECT concat('ts:src/f', n, '.ts#C', n), concat('ts:src/f', n, '.ts#C', n, '.m', k), 'CONTAINS', 'LEXICAL' FROM s""", ROWS)
def index_edges(g: Graph) -> DataFrame:
    """The edges of a whole index build; calls of one's own method go to oneself and are no edges."""
    made = index.tables(_typescript(g))
    names = made["symbol"].select("id", "stable_key")
    edge = made["edge"].join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
    return edge.select(F.col("a").alias("src"), F.col("b").alias("dst"), "kind", "tier")


@query("""SELECT concat('ts:src/f', n, '.ts#C', n, '.m', k) AS src, x AS name, 'no_candidate' AS reason FROM s, (SELECT unnest(['T', 'a']) AS y) JOIN LATERAL (SELECT CASE WHEN y = 'T' THEN concat('T', k) ELSE 'a' END AS x) ON true""", ROWS)
def index_unresolved(g: Graph) -> DataFrame:
    made = index.tables(_typescript(g))
    return made["unresolved_ref"].join(made["symbol"].select(F.col("id").alias("src"), "stable_key"), "src").select(F.col("stable_key").alias("src"), "name", "reason")


REGION = "lower(replace(r_name, ' ', '_'))"


@query(f"""SELECT page_id AS ref, CASE page_id % 6 WHEN 0 THEN concat('lib/', r, '/', n, '.py') WHEN 1 THEN concat('lib/', r, '/__init__.py') WHEN 2 THEN concat('lib/', r, '/', n, '.py') WHEN 3 THEN concat('tools/', n, '.py') WHEN 4 THEN NULL ELSE NULL END AS path,
  CASE page_id % 6 WHEN 4 THEN 'os' WHEN 5 THEN '.gone' END AS package FROM q""", f"q AS (SELECT page_id, {REGION} AS r, lower(n_name) AS n FROM pages JOIN nation ON n_nationkey = page_id % 25 JOIN region ON r_regionkey = n_regionkey)")
def python_module_resolution(g: Graph) -> DataFrame:
    """Relative modules and packages, modules below the import root and at the top, others."""
    place = g.table("nation").join(g.table("region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.lower(F.regexp_replace("r_name", " ", "_")).alias("r"), F.lower("n_name").alias("n"))
    file = place.select(F.explode(F.array(F.concat(F.lit("lib/"), "r", F.lit("/"), "n", F.lit(".py")), F.concat(F.lit("lib/"), "r", F.lit("/__init__.py")), F.concat(F.lit("tools/"), "n", F.lit(".py")))).alias("path")).distinct()
    rows = g.table("pages").select(F.col("page_id").alias("ref")).join(place, F.col("ref") % 25 == F.col("n_nationkey"))
    at = F.col("ref") % 6
    asked = F.when(at == 0, F.concat(F.lit("."), "n")).when(at == 1, ".").when(at == 2, F.concat("r", F.lit("."), "n")).when(at == 3, F.concat(F.lit("tools."), "n")).when(at == 4, "os.path").otherwise(".gone")
    return link.python_modules(rows.select("ref", F.concat(F.lit("lib/"), "r", F.lit("/x.py")).alias("path"), asked.alias("specifier")), file)


EXACT = "e AS (SELECT DISTINCT kind, src, dst FROM edge WHERE src % 3 <> 0)"
SHARES = "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE round(tp / (tp + fp), 9) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE round(tp / (tp + fn), 9) END AS recall"


@query(f"SELECT kind, {SHARES} FROM (SELECT * FROM c UNION ALL SELECT 'overall', sum(tp), sum(fp), sum(fn) FROM c)", EXACT + ", a AS (SELECT DISTINCT kind, src, dst FROM edge WHERE tier <> 'HEURISTIC' UNION SELECT DISTINCT 'REFERENCES', src, dst FROM edge WHERE tier <> 'HEURISTIC'), j AS (SELECT coalesce(a.kind, e.kind) AS kind, a.src IS NOT NULL AS x, e.src IS NOT NULL AS y FROM a FULL JOIN e ON a.kind = e.kind AND a.src = e.src AND a.dst = e.dst), c AS (SELECT kind, count(*) FILTER (x AND y) AS tp, count(*) FILTER (x AND NOT y) AS fp, count(*) FILTER (y AND NOT x) AS fn FROM j GROUP BY kind)")
def oracle_compare(g: Graph) -> DataFrame:
    actual, expected = g.edge.where("tier <> 'HEURISTIC'"), g.edge.where("src % 3 <> 0")
    return evaluate.compare(actual, expected).withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


@query(f"SELECT tier, kind, {SHARES} FROM (SELECT * FROM c UNION ALL SELECT tier, 'overall', sum(tp), sum(fp), sum(fn) FROM c GROUP BY tier)", EXACT + """, t AS (SELECT unnest(['COMPILER', 'LEXICAL', 'HEURISTIC', 'ALL']) AS tier), et AS (SELECT tier, e.* FROM e, t), wide AS (SELECT t.tier, kind, src, dst FROM edge JOIN t ON t.tier = edge.tier OR t.tier = 'ALL'),
a AS (SELECT DISTINCT tier, kind, src, dst FROM wide UNION SELECT DISTINCT tier, 'REFERENCES', src, dst FROM wide), j AS (SELECT coalesce(a.tier, e.tier) AS tier, coalesce(a.kind, e.kind) AS kind, a.src IS NOT NULL AS x, e.src IS NOT NULL AS y FROM a FULL JOIN et e ON a.tier = e.tier AND a.kind = e.kind AND a.src = e.src AND a.dst = e.dst),
c AS (SELECT tier, kind, count(*) FILTER (x AND y) AS tp, count(*) FILTER (x AND NOT y) AS fp, count(*) FILTER (y AND NOT x) AS fn FROM j GROUP BY 1, 2)""")
def oracle_by_tier(g: Graph) -> DataFrame:
    return evaluate.by_tier(g.edges, F.expr("src % 3 <> 0")).withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


@query("""SELECT conv_id AS task, round(count(*) FILTER (required AND first IS NOT NULL) / count(*) FILTER (required), 9) AS recall, count(*) FILTER (required AND first % 4 = 0) AS compiler, count(*) FILTER (required AND first % 4 = 1) AS lexical, count(*) FILTER (required AND first % 4 = 2) AS heuristic, count(*) FILTER (required AND first % 4 = 3) AS unranked, count(*) FILTER (NOT required AND first IS NOT NULL) AS distractors FROM m GROUP BY 1""",
       r"""n AS (SELECT DISTINCT conv_id, name, name <> 'der' AS required FROM conversations, (SELECT unnest(['the', 'de', 'der']) AS name)), m AS (SELECT n.*, h.first FROM n LEFT JOIN (SELECT conv_id, name, min(turn) AS first FROM conversations, (SELECT unnest(['the', 'de', 'der']) AS name) WHERE regexp_matches(text, concat('(?i)(^|[^\p{L}\p{N}_$])', name, '($|[^\p{L}\p{N}_$])')) GROUP BY 1, 2) h USING (conv_id, name))""")
def evidence_hits(g: Graph) -> DataFrame:
    rows = g.table("conversations").select(F.col("conv_id").alias("task"), F.col("turn").alias("ordinal"), F.when(F.col("turn") % 4 == 0, "COMPILER").when(F.col("turn") % 4 == 1, "LEXICAL").when(F.col("turn") % 4 == 2, "HEURISTIC").alias("tier"), "text")
    wanted = rows.select("task").distinct().select("task", F.explode(F.array(*map(F.lit, ("the", "de", "der")))).alias("name")).withColumn("required", F.col("name") != "der")
    return evaluate.hits(rows, wanted).withColumn("recall", F.round("recall", 9))


@query("SELECT reason, sum(n) AS n, round(sum(n) / (SELECT count(*) FROM unresolved_ref), 9) AS share, string_agg(name, ',' ORDER BY r) FILTER (r <= 3) AS names FROM (SELECT reason, name, count(*) AS n, row_number() OVER (PARTITION BY reason ORDER BY count(*) DESC, name) AS r FROM unresolved_ref GROUP BY 1, 2) GROUP BY 1".replace("sum(n) AS n", "CAST(sum(n) AS BIGINT) AS n"))
def unresolved_by_reason(g: Graph) -> DataFrame:
    return resolve.unresolved_report(g.unresolved, 3).select("reason", "n", F.round("share", 9).alias("share"), F.array_join("names", ",").alias("names"))


@query("SELECT DISTINCT src, site_line, short_name AS name, edge.kind AS kind FROM edge JOIN symbol ON symbol.id = dst WHERE tier = 'HEURISTIC'")
def heuristic_sites(g: Graph) -> DataFrame:
    return resolve.heuristic_sites(g.edge, g.symbol)


@query("""SELECT r.src, r.site_line, r.name, min_by(r.kind, r.ordinal) AS kind, min_by(r.col, r.ordinal) AS col, any_value(w.u) AS was_unresolved FROM (SELECT e.src, site_line, short_name AS name, e.kind, dst % 80 AS col, dst AS ordinal FROM edge e JOIN symbol s ON s.id = dst WHERE dst % 5 <> 0) r
JOIN w ON w.src = r.src AND w.site_line = r.site_line AND w.name = r.name GROUP BY 1, 2, 3""",
       "w AS (SELECT src, site_line, name, bool_or(u) AS u FROM (SELECT src, site_line, name, true AS u FROM unresolved_ref UNION ALL SELECT src, site_line, short_name, false FROM edge JOIN symbol ON symbol.id = dst WHERE tier = 'HEURISTIC') WHERE site_line IS NOT NULL GROUP BY 1, 2, 3)")
def compiler_query_sites(g: Graph) -> DataFrame:
    """Where a compiler is asked: one place for each unproved site that is still in the sources."""
    names = g.symbol.select(F.col("id").alias("dst"), F.col("short_name").alias("name"))
    refs = g.edge.join(names, "dst").select("src", "site_line", "name", "kind", F.when(F.col("dst") % 5 != 0, F.col("dst") % 80).alias("column"), F.col("dst").alias("ordinal"))
    found, _ = resolve.query_sites(refs, g.unresolved, resolve.heuristic_sites(g.edge, g.symbol))
    return found.select("src", "site_line", "name", "kind", F.col("column").alias("col"), "was_unresolved")


@query("""SELECT p.file_id, p.line, s.id FROM (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS file_id, l_partkey % 60 AS line FROM lineitem) p LEFT JOIN (SELECT file_id, line, id FROM (SELECT l_suppkey AS file_id, l_partkey % 50 AS line, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 50 ORDER BY l_linenumber * 3, l_orderkey, l_orderkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r = 1) s ON s.file_id = p.file_id AND s.line = p.line""")
def smallest_span(g: Graph) -> DataFrame:
    items = g.table("lineitem")
    spans = items.select(F.col("l_suppkey").alias("file_id"), (F.col("l_partkey") % 50).alias("start_line"), (F.col("l_partkey") % 50 + F.col("l_linenumber") * 3).alias("end_line"), F.col("l_orderkey").alias("start_byte"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return resolve.declared_at(items.select(F.col("l_suppkey").cast("long").alias("file_id"), (F.col("l_partkey") % 60).alias("line")).distinct(), spans)


ANSWERS = "SELECT u.src, u.name, u.kind, CAST(u.site_line AS BIGINT) AS site_line, CASE WHEN u.src % 3 <> 0 THEN 3000000 + u.site_line END AS dst, 'lib' AS package, true AS was_unresolved FROM {unresolved} u WHERE reason = 'no_candidate'"


@query("""SELECT 'upgraded' AS what, count(dst) AS n FROM x UNION ALL SELECT 'externalized', count(*) - count(dst) FROM x UNION ALL SELECT 'unresolved_cleared', count(*) FROM g UNION ALL SELECT 'extra_cleared', CAST(coalesce(sum(greatest(0, removed - expected)), 0) AS BIGINT) FROM (SELECT src, name, count(*) AS removed, any_value(expected) AS expected FROM g GROUP BY 1, 2)
UNION ALL SELECT concat('edges ', kind, ' ', tier), count(*) FROM (SELECT kind, tier FROM edge UNION ALL SELECT kind, 'COMPILER' FROM (SELECT DISTINCT src, dst, kind, site_line FROM x WHERE dst IS NOT NULL)) GROUP BY kind, tier UNION ALL SELECT 'external', (SELECT count(*) FROM external_ref) + (SELECT count(*) FROM x WHERE dst IS NULL) UNION ALL SELECT 'unresolved', (SELECT count(*) FROM unresolved_ref) - (SELECT count(*) FROM g)""",
       "x AS (" + ANSWERS.format(unresolved="unresolved_ref") + "), g AS (SELECT u.src, u.name, e.expected FROM unresolved_ref u JOIN (SELECT src, name, count(*) AS expected FROM x GROUP BY 1, 2) e ON e.src = u.src AND e.name = u.name)")
def compiler_settlement(g: Graph) -> DataFrame:
    """The tables after a compiler has answered every unresolved reference without a candidate."""
    answers = g.spark.sql(ANSWERS, unresolved=g.unresolved)
    edge, external, left, counts = resolve.settle(g.edge, g.external, g.unresolved, answers)
    told = counts.select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("long")) for c in counts.columns]))).alias("what", "n"))
    edges = edge.groupBy("kind", "tier").agg(F.count("*").alias("n")).select(F.concat(F.lit("edges "), "kind", F.lit(" "), "tier").alias("what"), "n")
    return told.unionAll(edges).unionAll(external.agg(F.lit("external"), F.count("*"))).unionAll(left.agg(F.lit("unresolved"), F.count("*")))


@query(r"""SELECT s.id, concat_ws(chr(10), nullif(qualified_name, ''), nullif(trim(lower(regexp_replace(regexp_replace(regexp_replace(qualified_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[._\-/]+', ' ', 'g'))), ''), kind, nullif(trim(lower(regexp_replace(regexp_replace(path, '\.[^.]+$', ''), '[._\-/]+', ' ', 'g'))), ''), signature) AS text FROM symbol s JOIN file f ON f.id = s.file_id""")
def symbol_documents(g: Graph) -> DataFrame:
    joined = g.symbol.join(g.file.select(F.col("id").alias("file_id"), "path"), "file_id")
    return joined.select("id", S.symbol_document(F.col("qualified_name"), F.col("kind"), F.col("path"), F.col("signature"), F.lit(None).cast("string")).alias("text"))


@query("SELECT kind, tier, confidence, count(*) AS n FROM edge GROUP BY ALL")
def duplicate_rows(g: Graph) -> DataFrame:
    return report.collapsed(g.edge.select("kind", "tier", "confidence"))


@query("SELECT kind, count(*) FILTER (tier = 'COMPILER') AS compiler, count(*) FILTER (tier = 'LEXICAL') AS lexical, count(*) FILTER (tier = 'HEURISTIC') AS heuristic FROM edge GROUP BY kind")
def tier_record(g: Graph) -> DataFrame:
    made = g.edge.groupBy("kind").agg(S.by_tier(F.col("tier"), F.lit(1)).alias("m"))
    return made.select("kind", *[F.col("m")[t].alias(t.lower()) for t in S.TIERS])


@query("SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 9) AS score FROM embeddings WHERE label % 2 = 0 ORDER BY score DESC, id LIMIT 20")
def semantic_search(g: Graph) -> DataFrame:
    """The nearest vectors of one of two models."""
    rows = g.table("embeddings").select(F.col("vec_id").alias("symbol_id"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("model"), F.col("embedding").alias("vector"))
    return find.semantic(rows, rows.where("symbol_id = 0").select("vector"), "even").select("id", F.round("score", 9).alias("score"))


def _tools(g: Graph) -> tools.Tools:
    return tools.Tools(g.edge, g.symbol, g.file, g.external, g.unresolved, g.fan, g.p95, g.edge_by_src)


def _rows(g: Graph, rows: list[dict], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return g.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


@query("SELECT stable_key AS \"stableKey\", path, symbol.kind AS kind, signature, 'exact_qualified' AS reason FROM symbol JOIN file ON file.id = file_id WHERE qualified_name = 'Customer#000000003'")
def find_symbols_call(g: Graph) -> DataFrame:
    made = _tools(g).find_symbols("Customer#000000003", limit=1)["results"]
    return _rows(g, made, "stableKey string, path string, kind string, signature string, reason string")


@query(f"SELECT lower(tier) AS bucket, stable_key AS \"stableKey\", path, qualified_name AS \"qualifiedName\", edge_kind AS kind, site_line AS \"siteLine\" FROM h JOIN symbol s ON s.id = h.id JOIN file f ON f.id = s.file_id LEFT JOIN fan ON fan.id = h.id CROSS JOIN p WHERE n = 1 ORDER BY tr, {SCORE.format(d=1)} DESC, stable_key LIMIT 50",
       FAN + f", h AS (SELECT src AS id, kind AS edge_kind, tier, {RANK} AS tr, site_line, row_number() OVER (PARTITION BY src ORDER BY {RANK}, site_line NULLS FIRST, confidence) AS n FROM edge WHERE dst = {SEEDS['callers_of']} AND kind = 'CALLS')")
def query_graph_call(g: Graph) -> DataFrame:
    key = g.symbol.where(F.col("id") == SEEDS["callers_of"]).first().stable_key
    made = _tools(g).query_graph("callers_of", key)["results"]
    rows = [{"bucket": b, **r} for b in ("compiler", "lexical", "heuristic") for r in made[b]]
    return _rows(g, rows, "bucket string, stableKey string, path string, qualifiedName string, kind string, siteLine long")


@query(f"SELECT stable_key AS \"stableKey\", CAST(1 AS BIGINT) AS depth, tier, {SCORE.format(d=1)} AS score FROM (SELECT src, min_by(tier, {RANK}) AS tier FROM edge WHERE dst = 2000001 AND kind IN {USAGE} AND src <> dst GROUP BY src) e JOIN symbol s ON s.id = e.src LEFT JOIN fan ON fan.id = s.id CROSS JOIN p", FAN)
def impact_call(g: Graph) -> DataFrame:
    """What directly depends on one class, through the public call; nothing is further away in these tables."""
    key = g.symbol.where("id = 2000001").first().stable_key
    made = _tools(g).get_impact_radius([key], token_budget=100_000)["results"]
    return _rows(g, [r for r in made if r["depth"] == 1], "stableKey string, depth long, tier string, score double")


@query("SELECT m.module, CAST(files AS BIGINT) AS files, CAST(symbols AS BIGINT) AS symbols, coalesce(names, '') AS names FROM (SELECT array_to_string(string_split(module, '/')[1:2], '/') AS module, sum(files) AS files, sum(symbols) AS symbols FROM (SELECT regexp_extract(path, '^(.*)/', 1) AS module, count(DISTINCT path) AS files, sum(symbols) AS symbols FROM counts GROUP BY 1) WHERE module LIKE 'src%' GROUP BY 1) m LEFT JOIN (SELECT module, string_agg(name, ',' ORDER BY place) AS names FROM (SELECT array_to_string(string_split(module, '/')[1:2], '/') AS module, name, min({'m': module, 'r': r}) AS place FROM (SELECT target AS module, dst_name AS name, row_number() OVER (PARTITION BY target ORDER BY count(*) DESC, dst_name) AS r FROM x WHERE tier <> 'HEURISTIC' AND dst_kind <> 'file' GROUP BY 1, 2) WHERE r <= 6 GROUP BY 1, 2) GROUP BY 1) n ON n.module = m.module", GRAPH)
def rollup_summaries(g: Graph) -> DataFrame:
    return modules.rolled_summaries(modules.summaries(modules.symbol_counts(g.symbol, g.file)), modules.surface(_cross(g)))
