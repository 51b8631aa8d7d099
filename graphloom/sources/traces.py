"""Recorded tool traces, one JSON file a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "task string, calls array<struct<tool: string, text: string, milliseconds: double>>"


def traces(spark: SparkSession, path: str) -> DataFrame:
    """task and calls of every file; one that isn't of that form fails the read."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").option("multiLine", True).json(path)
