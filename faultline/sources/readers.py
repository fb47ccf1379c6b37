"""Batch readers: frames by suffix, decision logs, JSON-array views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import constants as C
from faultline.session import prepare

LONG_EVENT = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("sequence_number", T.LongType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("is_training_only_field", T.BooleanType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("window_id", T.StringType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("scenario_tag", T.StringType()),
        T.StructField("chaos_suitability", T.StringType()),
    ]
)

WIDE_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("generated_at", T.TimestampType()),
        T.StructField("source_node", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("is_synthetic", T.BooleanType()),
        T.StructField("scenario_tag", T.StringType()),
        T.StructField("telemetry_profile", T.StringType()),
        *[T.StructField(f, T.DoubleType()) for f in C.MODEL_FEATURES],
    ]
)

DECISION = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("generated_at", T.TimestampType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("anomaly_flag", T.BooleanType()),
        T.StructField("candidate_flag", T.BooleanType()),
        T.StructField("reason_codes", T.ArrayType(T.StringType())),
        T.StructField("scenario_tag", T.StringType()),
    ]
)


def read_frame(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read CSV or Parquet, chosen by suffix; other suffixes are rejected.

    Give a schema for CSV: without one Spark reads the data twice to infer it.
    """
    prepare(spark)
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if suffix == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported dataset format: .{suffix}")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = DECISION) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines) of a JSON-lines log; blank lines are skipped."""
    prepare(spark)
    lines = spark.read.text(path).where(F.trim("value") != "")
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    options = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    parsed = lines.withColumn("_r", F.from_json("value", full, options))
    bad = "_r is null or _r._bad is not null"
    return parsed.where(f"not ({bad})").select("_r.*").drop("_bad"), parsed.where(bad).select("value")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of files that each hold one JSON array; convert such files to Parquet once."""
    prepare(spark)
    return spark.read.schema(schema).option("multiLine", True).json(path)
