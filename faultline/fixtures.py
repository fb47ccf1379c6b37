"""Adapters that give the test tables the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.scalars import lookup
from faultline.operators.windows import WindowingPolicy
from faultline.session import prepare

# Windows of 12 h every 6 h with 1 h tolerance suit the 30-day test stream.
TEST_POLICY = WindowingPolicy(length_s=43_200, stride_s=21_600, tolerance_s=3_600)

# Components of the embeddings table.
POINT_DIMS = 64

# The surrogate score tops out near 0.7: lower limits make every flag branch occur.
TEST_THRESHOLDS = {"payments-api": 0.58, "orders-api": 0.56, "checkout-api": 0.60}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as its files give it."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _service() -> Column:
    return lookup(
        F.col("event_type"),
        {"purchase": "payments-api", "view": "orders-api", "click": "checkout-api", "error": "redis", "signup": "redis"},
    )


def _metric() -> Column:
    by_id = F.element_at(F.array(*[F.lit(m) for m in C.API_METRICS]), (F.col("event_id") % 3 + 1).cast("int"))
    return (
        F.when(F.col("event_type") == "error", F.lit("redis_latency"))
        .when(F.col("event_type") == "signup", F.lit("redis_queue_depth"))
        .otherwise(by_id)
    )


def long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long telemetry events from the ``events`` table."""
    return long_from(table(spark, sf_dir, "events"))


def long_from(raw: DataFrame) -> DataFrame:
    """The same projection over any (also streaming) event frame."""
    ev = raw.select("event_id", "ts", "user_id", "event_type", "value", "props")
    base = lookup(
        F.concat_ws("|", "service_name", "metric_name"),
        {f"{s}|{m}": v for (s, m), v in C.BASELINE.items()},
    )
    level = F.when(
        F.col("metric_name") == "throughput", F.greatest(F.lit(0.35), F.lit(1.3) - F.col("value") / 100)
    ).otherwise(F.lit(0.5) + F.col("value") / 50)
    tags = {tag[:2]: tag for tag, *_ in C.SCENARIO_CATALOG}
    suit = {tag: s for tag, _, s, _ in C.SCENARIO_CATALOG}
    planted = (F.col("event_id") % 997 == 0) & (F.col("event_id") > 0)
    out = ev.withColumn("service_name", _service()).withColumn("metric_name", _metric())
    out = out.withColumn(
        "scenario_tag", lookup(F.concat(F.lit("S"), (F.dayofmonth("ts") % 9).cast("string")), tags)
    )
    return out.select(
        F.lit(C.LONG_EVENT_VERSION).alias("schema_version"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(planted, F.col("event_id") - 500).otherwise(F.col("event_id")).alias("sequence_number"),
        "service_name",
        "metric_name",
        (base * level).alias("metric_value"),
        lookup(F.col("metric_name"), C.METRIC_UNIT).alias("unit"),
        F.lit("runtime").alias("source"),
        F.lit(False).alias("is_training_only_field"),
        F.create_map(F.lit("props"), F.col("props")).alias("metadata"),
        F.when(F.col("event_id") % 41 != 0, F.date_format("ts", "'win_'yyyyMMdd")).alias("window_id"),
        F.lit(None).cast("string").alias("correlation_id"),
        "scenario_tag",
        lookup(F.col("scenario_tag"), suit).alias("chaos_suitability"),
        F.concat(F.lit("node-"), (F.col("user_id") % 4).cast("string")).alias("source_node"),
    )


def raw_long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as untyped strings, with contract faults planted by id."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")

    def fault(mod: int, bad: str | None, good: Column) -> Column:
        return F.when(eid % mod == mod - 1, F.lit(bad)).otherwise(good)

    return ev.select(
        F.col("event_id").alias("row_id"),
        fault(59, "v0", F.lit(C.LONG_EVENT_VERSION)).alias("schema_version"),
        fault(61, None, eid.cast("string")).alias("event_id"),
        fault(67, "not-a-time", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        fault(71, "-5", eid.cast("string")).alias("sequence_number"),
        fault(73, "unknown-service", _service()).alias("service_name"),
        fault(79, "  ", _metric()).alias("metric_name"),
        fault(83, "abc", F.col("value").cast("string")).alias("metric_value"),
        fault(89, "", F.lit("ratio")).alias("unit"),
        fault(97, "mystery", F.lit("runtime")).alias("source"),
        fault(101, "yes", F.lit("false")).alias("is_training_only_field"),
        fault(103, "[1]", F.col("props")).alias("metadata"),
        fault(107, "maybe", F.lit(None).cast("string")).alias("chaos_suitability"),
    )


def wide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide telemetry rows with a deterministic surrogate score, from ``lineitem``."""
    return wide_from(table(spark, sf_dir, "lineitem"))


def wide_from(li: DataFrame) -> DataFrame:
    """The same projection over any (also streaming) line-item frame."""
    q, price, disc, tax = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    http = (F.col("l_partkey") % 100) / F.lit(20.0)
    cents = lambda c: F.round(c * 100, 0).cast("long").cast("string")
    event_id = F.md5(
        F.concat_ws(
            "|",
            *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            *[cents(c) for c in (q, price, disc, tax)],
            "l_returnflag",
            "l_linestatus",
            F.date_format("l_shipdate", "yyyyMMdd"),
        )
    )
    # Whole prices keep the sum at six decimals, so rounding has no ties.
    score = F.round(0.35 + 0.004 * q + 0.000001 * F.floor(price) + 0.5 * disc, 6)
    return li.select(
        event_id.alias("event_id"),
        F.col("l_shipdate").cast("timestamp").alias("generated_at"),
        F.concat(F.lit("node-"), (F.col("l_orderkey") % 16).cast("string")).alias("source_node"),
        lookup(F.col("l_returnflag"), {"R": "payments-api", "N": "orders-api", "A": "checkout-api"}).alias("service_name"),
        F.when(http >= 4, F.lit(503)).when(http >= 3, F.lit(429)).otherwise(F.lit(200)).alias("status_code"),
        F.lit(True).alias("is_synthetic"),
        F.when((F.col("l_linestatus") == "O") & (q > 30), F.lit("anomalous")).otherwise(F.lit("normal")).alias("scenario_tag"),
        F.lit("simple").alias("telemetry_profile"),
        F.least(F.lit(100.0), 2 * q).alias("cpu_pct"),
        (40 + 500 * tax).alias("memory_pct"),
        (price / 200).alias("latency_ms"),
        F.least(F.lit(100.0), 1000 * disc).alias("disk_io_pct"),
        (disc * q).alias("net_error_rate"),
        (q * (1 + 10 * tax)).alias("queue_length"),
        (1000 / (1 + q)).alias("throughput_rate"),
        http.alias("http_5xx_rate"),
        (-score).alias("raw_score"),
        score.alias("anomaly_score"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from all embedding components."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(POINT_DIMS)],
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("scenario_tag"),
    )
