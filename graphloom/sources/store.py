"""The graph's tables at rest: Parquet in one folder, with a version gate."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3
SCHEMAS = {
    "meta": "key string, value string",
    "file": "id long, path string, language string, content_hash string, mtime_ms double, size long, parse_state string, diagnostics string, indexed_at timestamp",
    "symbol": "id long, stable_key string, file_id long, qualified_name string, short_name string, kind string, signature string, start_byte int, end_byte int, start_line int, end_line int, body_hash string, exported boolean, is_test boolean",
    "edge": "src long, dst long, tier string, confidence double, site_line int, extractor_version string, kind string",
    "external_ref": "src long, name string, package string, site_line int",
    "unresolved_ref": "src long, name string, kind string, site_line int, candidates int, reason string",
    "embedding": "symbol_id long, model string, dim int, vector array<float>, input_hash string",
}
# Fixed values of the data model.
KINDS = ["file", "module", "class", "interface", "type", "enum", "function", "method", "property", "variable", "test"]
EDGES = ["CONTAINS", "IMPORTS", "CALLS", "REFERENCES", "IMPLEMENTS", "INHERITS", "TESTS"]


def shared(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a temporary folder in local mode; an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the folder that the cluster shares and read it back, to end its lineage. by: a column of few values."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.kept = path
    return made


def still_there(made: DataFrame) -> bool:
    """Whether a table of keep() hasn't been removed."""
    context = made.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(made.kept)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).exists(at)


def location(base: str, root: str) -> str:
    """The folder of a repository's tables."""
    return f"{base.rstrip('/')}/{hashlib.sha256(root.encode()).hexdigest()[:16]}"


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def create(self) -> Store:
        self.spark.createDataFrame([("schema_version", str(VERSION))], SCHEMAS["meta"]).write.parquet(f"{self.folder}/meta")
        for name, schema in SCHEMAS.items():
            if name != "meta":
                self.write(name, self.spark.createDataFrame([], schema))
        return self

    def open(self) -> Store:
        """Refuse tables of another version."""
        found = {r.key: r.value for r in self.read("meta").collect()}.get("schema_version")
        if found != str(VERSION):
            raise ValueError(f"schema version {found}, expected {VERSION}")
        return self

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")

    def write(self, name: str, df: DataFrame) -> None:
        """Replace a table; edges are partitioned by kind, so a pattern reads only its own."""
        writer = df.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]).write.mode("overwrite")
        (writer.partitionBy("kind") if name == "edge" else writer).parquet(f"{self.folder}/{name}")

    def provenance(self, **versions: str | None) -> dict[str, str]:
        """The meta table as a dict, after setting the given keys (None removes one)."""
        held = {r.key: r.value for r in self.read("meta").collect()}
        if versions:
            held = {k: v for k, v in {**held, **versions}.items() if v is not None}
            self.spark.createDataFrame(sorted(held.items()), SCHEMAS["meta"]).write.mode("overwrite").parquet(f"{self.folder}/meta")
        return held

    def embeddings(self, model: str) -> DataFrame:
        """The vectors of one model."""
        return self.read("embedding").where(F.col("model") == model)

    def append(self, name: str, df: DataFrame, extractor: str | None = None) -> None:
        """Add rows to a table. Edges get the extractor's version; symbols whose stable key is held or repeated abort the write."""
        if name == "edge":
            df = df.withColumn("extractor_version", F.lit(extractor)) if extractor else df
        if name == "symbol":
            clash = duplicates(self.read("symbol").select("stable_key").unionByName(df.select("stable_key"))).first()
            if clash:
                raise ValueError(f"stable key {clash.stable_key} occurs {clash['count']} times")
        writer = df.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]).write.mode("append")
        (writer.partitionBy("kind") if name == "edge" else writer).parquet(f"{self.folder}/{name}")

    def drop(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def with_ids(rows: DataFrame, symbol: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Stable keys to ids. keys: key column -> id column. A key without a symbol fails the write."""
    for key, name in keys.items():
        ids = symbol.select(F.col("stable_key").alias(key), F.col("id").alias(name))
        rows = rows.join(ids, key, "left").withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.concat(F.lit("no symbol "), F.col(key))).cast("long")).otherwise(F.col(name))).drop(key)
    return rows


def duplicates(symbol: DataFrame) -> DataFrame:
    """Stable keys that occur more than once."""
    return symbol.groupBy("stable_key").count().where("count > 1")


def cascade(file: DataFrame, symbol: DataFrame, tables: dict[str, DataFrame], gone: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Delete files by path, with their symbols and every row that names these (columns src, dst, symbol_id)."""
    files = file.join(gone.select("path"), "path", "left_semi").select(F.col("id").alias("file_id"))
    dead = symbol.join(files, "file_id", "left_semi").select("id")
    out = {}
    for name, df in tables.items():
        for c in {"src", "dst", "symbol_id"} & set(df.columns):
            df = df.join(dead.select(F.col("id").alias(c)), c, "left_anti")
        out[name] = df
    return file.join(gone.select("path"), "path", "left_anti"), symbol.join(files, "file_id", "left_anti"), out
