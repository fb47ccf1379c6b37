"""Topics: stream sources with resume positions, envelope decoding, append sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from faultline.session import prepare


def read_topic_files(spark: SparkSession, path: str, *, per_trigger: int | None = 100) -> DataFrame:
    """A topic kept as files of JSON envelopes, one per line.

    The query's checkpoint holds the position, so a restart continues where the
    last batch ended.
    """
    prepare(spark)
    reader = spark.readStream.format("text")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def read_topic_kafka(
    spark: SparkSession, servers: str, topic: str, *, start: str = "latest", per_trigger: int | None = 1_000_000
) -> DataFrame:
    """A Kafka topic as ``value`` strings; ``start`` is ``earliest`` or ``latest``.

    Needs the Kafka connector on the class path.  The start applies to the
    first run only, later runs resume from the checkpoint.
    """
    if start not in ("earliest", "latest"):
        raise ValueError("start must be earliest or latest")
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start)
    )
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return reader.load().selectExpr("cast(value as string) as value")


def decode_envelopes(raw: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(events, quarantined) from envelope lines ``{"payload": "<json object>", …}``.

    A line without a payload, or whose payload is no JSON object, is
    quarantined with its reason.
    """
    read = read_envelopes(raw, schema)
    return read.where("reason is null").select("event.*"), read.where("reason is not null").select("value", "reason")


def read_envelopes(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """(value, event, reason): every envelope line with its event, or the reason it is quarantined for."""

    def parts(p: Column) -> Column:
        reason = (
            F.when(p.isNull(), F.lit("missing payload"))
            .when(~F.ltrim(p).startswith("{") | F.json_object_keys(p).isNull(), F.lit("payload is not an object"))
        )
        return F.struct(F.from_json(p, schema).alias("event"), reason.alias("reason"))

    # One parse a line: filters on the result are not worked out again below the generator.
    one = F.transform(F.array(F.get_json_object("value", "$.payload")), parts)
    return raw.select("value", F.inline(one))


def encode_envelopes(df: DataFrame, topic: str) -> DataFrame:
    return df.select(F.to_json(F.struct(F.lit(topic).alias("topic"), F.to_json(F.struct("*")).alias("payload"))).alias("value"))


def publish(df: DataFrame, topic: str, path: str, checkpoint: str) -> StreamingQuery:
    """Publish a stream to a file topic."""
    return (
        encode_envelopes(df, topic).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def append_log(df: DataFrame, path: str, checkpoint: str, *, available_now: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Append a stream to a Parquet log; the file sink's own log makes it exactly-once."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()
