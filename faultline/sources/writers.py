"""Batch sinks: datasets, exported views, notification intents, incident bundles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def write_frame(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Write CSV or Parquet, chosen by suffix; a folder of part files, split by ``partition_by``."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in ("csv", "parquet"):
        raise ValueError(f"unsupported export format: .{suffix}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if suffix == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def export_views(views: Mapping[str, DataFrame], base: str) -> dict[str, str]:
    """Write windows, features, signatures, eligibility… as Parquet folders under ``base``."""
    return {name: write_frame(df, f"{base}/{name}.parquet") for name, df in views.items()}


def append_notifications(intents: DataFrame, path: str, *, compression: str = "none") -> str:
    """Append notification intents as JSON lines, with ``gzip`` in compressed files; nothing is sent anywhere."""
    intents.select("event_id", "severity", "channel", "message").write.mode("append").option("compression", compression).json(path)
    return path


def write_incident_bundle(bundle: DataFrame, path: str) -> str:
    """One table of cards, confidence vectors, recommendations and traces, split by severity."""
    spark = bundle.sparkSession
    before = spark.conf.get(OPEN_FILES)
    # A task keeps a file per severity open, else it would sort its finished texts by severity first.
    spark.conf.set(OPEN_FILES, "16")
    try:
        split = bundle.withColumn("severity_level", F.col("severity")).write.mode("append").partitionBy("severity_level")
        split.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(OPEN_FILES, before)
    return path
