"""A code graph over the star-schema tables, as SQL that Spark and DuckDB both read.

`{t}` stands for a base table. Nations are files, suppliers interfaces, customers classes,
parts functions and orders methods; line items, keys and dates give the edges.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import traverse
from graphloom.sources.store import keep, still_there

VIEWS = {
    "file": """SELECT CAST(n_nationkey AS BIGINT) AS id,
  concat('src/', lower(replace(r_name, ' ', '_')), '/', lower(n_name), CASE WHEN n_nationkey % 8 = 7 THEN '.test.ts' ELSE '.ts' END) AS path,
  CASE WHEN n_nationkey % 11 = 5 THEN 'partial' ELSE 'ok' END AS parse_state
FROM {nation} JOIN {region} ON r_regionkey = n_regionkey""",
    "symbol": """SELECT id, concat('typescript:', path, '#') AS stable_key, id AS file_id, path AS qualified_name, path AS short_name, 'file' AS kind,
  CAST(NULL AS STRING) AS signature, CAST(0 AS BIGINT) AS start_line, false AS exported, id % 8 = 7 AS is_test FROM {file}
UNION ALL SELECT 1000000 + s_suppkey, concat('typescript:', CAST(s_nationkey AS STRING), '#', s_name), CAST(s_nationkey AS BIGINT), s_name, s_name, 'interface',
  concat('interface ', s_name), CAST(s_suppkey % 100 AS BIGINT), s_suppkey % 2 = 0, s_nationkey % 8 = 7 FROM {supplier}
UNION ALL SELECT 2000000 + c_custkey, concat('typescript:', CAST(c_nationkey AS STRING), '#', c_name), CAST(c_nationkey AS BIGINT), c_name, c_name, 'class',
  concat('class ', c_name), CAST(c_custkey % 100 AS BIGINT), c_custkey % 3 <> 0, c_nationkey % 8 = 7 FROM {customer}
UNION ALL SELECT 3000000 + p_partkey, concat('typescript:', CAST(p_partkey % 25 AS STRING), '#', p_name, '~', CAST(p_partkey AS STRING)), CAST(p_partkey % 25 AS BIGINT), concat(p_name, '.', CAST(p_partkey AS STRING)), p_name, 'function',
  concat('function ', p_name, '(): ', p_type), CAST(p_partkey % 100 AS BIGINT), p_partkey % 4 = 0, p_partkey % 25 % 8 = 7 FROM {part}
UNION ALL SELECT 10000000 + o_orderkey, concat('typescript:', CAST(c_nationkey AS STRING), '#', c_name, '.o', CAST(o_orderkey AS STRING)), CAST(c_nationkey AS BIGINT), concat(c_name, '.o', CAST(o_orderkey AS STRING)), concat('o', CAST(o_orderkey AS STRING)), 'method',
  CAST(NULL AS STRING), CAST(o_orderkey % 100 AS BIGINT), false, c_nationkey % 8 = 7 FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    "edge": """SELECT 10000000 + l_orderkey AS src, 3000000 + l_partkey AS dst, 'CALLS' AS kind,
  CASE l_returnflag WHEN 'A' THEN 'COMPILER' WHEN 'N' THEN 'LEXICAL' ELSE 'HEURISTIC' END AS tier, CASE WHEN l_returnflag = 'R' THEN 0.5e0 ELSE 1e0 END AS confidence, CAST(l_linenumber AS BIGINT) AS site_line FROM {lineitem}
UNION ALL SELECT 10000000 + o_orderkey, 10000000 + prior, 'CALLS', 'LEXICAL', 1e0, CAST(NULL AS BIGINT) FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior FROM {orders}) x WHERE prior IS NOT NULL
UNION ALL SELECT DISTINCT 3000000 + l_partkey, 1000000 + l_suppkey, 'REFERENCES', CASE l_linestatus WHEN 'F' THEN 'LEXICAL' ELSE 'HEURISTIC' END, 1e0, CAST(1 AS BIGINT) FROM {lineitem}
UNION ALL SELECT 2000000 + c_custkey, 1000000 + s_suppkey, 'IMPLEMENTS', 'LEXICAL', 1e0, CAST(2 AS BIGINT) FROM {customer} JOIN {supplier} ON c_nationkey = s_nationkey AND c_custkey % 20 = s_suppkey % 20
UNION ALL SELECT 2000000 + c_custkey, 2000000 + CAST(floor(c_custkey / 10) AS BIGINT), 'INHERITS', 'COMPILER', 1e0, CAST(3 AS BIGINT) FROM {customer} WHERE c_custkey > 0
UNION ALL SELECT CAST(c_nationkey AS BIGINT), 2000000 + c_custkey, 'CONTAINS', 'LEXICAL', 1e0, CAST(NULL AS BIGINT) FROM {customer}
UNION ALL SELECT 2000000 + o_custkey, 10000000 + o_orderkey, 'CONTAINS', 'LEXICAL', 1e0, CAST(NULL AS BIGINT) FROM {orders}
UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST((3 * n_nationkey + 1) % 25 AS BIGINT), 'IMPORTS', 'LEXICAL', 1e0, CAST(1 AS BIGINT) FROM {nation} WHERE n_nationkey <> (3 * n_nationkey + 1) % 25""",
    "external_ref": """SELECT 2000000 + user_id % (SELECT count(*) FROM {customer}) AS src, event_type AS name, props AS package, event_id % 7 AS site_line FROM {events} WHERE event_type = 'click'""",
    "unresolved_ref": """SELECT 2000000 + user_id % (SELECT count(*) FROM {customer}) AS src, p_name AS name, 'CALLS' AS kind, event_id % 7 AS site_line, event_id % 12 AS candidates,
  CASE WHEN event_id % 12 > 8 THEN 'too_ambiguous' WHEN event_id % 5 = 0 THEN 'parse_failed' ELSE 'no_candidate' END AS reason
FROM {events} JOIN {part} ON p_partkey = event_id % (SELECT count(*) FROM {part}) WHERE event_type = 'error'""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(body: str, ctes: str = "") -> str:
    """`body` for DuckDB, after the graph views and further CTEs."""
    plain = {t: t for t in [*TABLES, *VIEWS]}
    views = [f"{n} AS ({v.format(**plain)})" for n, v in VIEWS.items()]
    return "WITH RECURSIVE " + ",\n".join([*views, *([ctes] if ctes else [])]) + "\n" + body


#: Tables written for a session and folder, by what they were made from.
_written: dict[tuple, dict[str, DataFrame]] = {}

PARTS = 32


def _ranged(edge: DataFrame, end: str) -> DataFrame:
    return edge.repartitionByRange(PARTS, "kind", end).sortWithinPartitions("kind", end)


#: How each table is made, from views and other tables, and the column that it is written by.
MADE = {
    **{n: (lambda g, n=n: g.view(n), None) for n in VIEWS if n != "edge"},
    "edges": (lambda g: g.view("edge"), None),
    "edge": (lambda g: _ranged(g.kept("edges"), "dst"), "kind"),
    "edge_by_src": (lambda g: _ranged(g.kept("edges"), "src"), "kind"),
    "fan": (lambda g: traverse.fan_in(g.kept("edges")).repartitionByRange("id").sortWithinPartitions("id"), None),
    "p95": (lambda g: traverse.p95(g.kept("fan")), None),
}


@dataclass
class Graph:
    """The tables of a code graph over a folder of base tables, each written once in a session, when it is first read.

    They lie in the shared folder: edges as they come, for what reads all of them, and by kind,
    once in the order of their targets and once in that of their sources, so that a pattern
    reads its own kinds and, by the files' statistics, little else; fan-in is a table of its own.
    """

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        frames = {t: self.table(t) for t in TABLES if f"{{{t}}}" in text}
        frames |= {v: self.view(v) for v in VIEWS if f"{{{v}}}" in text}
        return self.spark.sql(text, **frames)

    def state(self) -> tuple:
        """What the written tables depend on: the session, and the base tables' sizes and times."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = []
        for t in TABLES[:8]:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{t}.parquet")
            system = at.getFileSystem(conf)
            found.append((t, system.getContentSummary(at).getLength(), system.getFileStatus(at).getModificationTime()))
        return (self.spark.sparkContext.applicationId, self.folder, *found)

    @cached_property
    def held(self) -> dict[str, DataFrame]:
        """The tables that are written; none where one of them was removed."""
        state = self.state()
        if not all(map(still_there, _written.get(state, {}).values())):
            del _written[state]
        return _written.setdefault(state, {})

    def kept(self, name: str) -> DataFrame:
        """A table, written if it isn't there."""
        if name not in self.held:
            make, by = MADE[name]
            self.held[name] = keep(make(self), name, by)
        return self.held[name]

    @cached_property
    def written(self) -> dict[str, DataFrame]:
        """All tables."""
        for name in MADE:
            self.kept(name)
        return self.held

    @cached_property
    def file(self) -> DataFrame:
        return self.kept("file")

    @cached_property
    def symbol(self) -> DataFrame:
        return self.kept("symbol")

    @cached_property
    def edges(self) -> DataFrame:
        """All edges in no order, for queries that read the whole graph."""
        return self.kept("edges")

    @cached_property
    def edge(self) -> DataFrame:
        return self.kept("edge")

    @cached_property
    def edge_by_src(self) -> DataFrame:
        """The same edges, for patterns that start at the source."""
        return self.kept("edge_by_src")

    @cached_property
    def fan(self) -> DataFrame:
        return self.kept("fan")

    @cached_property
    def p95(self) -> int:
        return self.kept("p95").first()[0]

    @cached_property
    def external(self) -> DataFrame:
        return self.kept("external_ref")

    @cached_property
    def unresolved(self) -> DataFrame:
        return self.kept("unresolved_ref")
