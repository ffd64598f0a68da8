"""JSON in and out: labelled texts, audits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..deploy import ship

ITEMS = "text string, pii array<struct<start:int,end:int,label:string,pool:string>>"
GOLD = "para int, substring string, label string"


def read_items(spark: SparkSession, path: str, schema: str = ITEMS) -> DataFrame:
    """Labelled texts from files that hold one JSON array each; fields that are missing are null."""
    return ship(spark).read.schema(schema).option("multiLine", "true").json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """para, substring and label of gold strings, from files that hold one JSON array each."""
    return read_items(spark, path, GOLD)


def write_audit(audited: DataFrame, path: str, originals: bool = False) -> None:
    """The audit as JSON lines. Originals are personal data: they are written only on demand."""
    (audited if originals else audited.drop("original")).write.json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A table of metrics as one JSON file; it has a row for each label, set and mode."""
    metrics.coalesce(1).write.json(path)
