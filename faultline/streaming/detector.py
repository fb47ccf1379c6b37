"""Detector and correlation on streams: the batch column logic plus keyed state.

State per key is a few dozen flags, or three latest signals.  Rows of one
micro-batch are put in arrival order inside each key and decided as arrays; bound
the batch with the source's per-trigger limit.  Where each node is a system of
its own, ``keys=("source_node", "service_name")`` spreads a busy service over
the nodes that report it.

:func:`write_signals` and :func:`write_enriched` take batches of any size: each
is decided by the batch operators, cut into blocks over all tasks, from a state
table that the batch before has left (the last flags per key, the last signal
per scope and service).  A batch keeps a folder of its own for rows and state;
one that is run again replaces them, and reads the state it read before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from faultline import constants as C
from faultline.operators.correlation import SNAP, enrich, latest, snapshots
from faultline.operators.detector import BUFFER, buffer_size, candidate_flags, last_flags, signals_after, with_decision
from faultline.operators.incidents import incidents
from faultline.session import shuffles_freed


def _arrival(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All rows of a key in arrival order; ``_tie`` was hashed before the shuffle."""
    return pd.concat(list(batches), ignore_index=True).sort_values(["generated_at", "_tie", "event_id"], ignore_index=True).drop(columns="_tie")


def trailing_counts(flags: np.ndarray, width: int) -> np.ndarray:
    """Set flags among the last ``width`` places up to each place."""
    total = np.concatenate([[0], np.cumsum(flags)])
    end = np.arange(1, len(flags) + 1)
    return total[end] - total[np.maximum(end - width, 0)]


def carried_last(places: np.ndarray) -> np.ndarray:
    """The greatest place so far: places only grow, so it is the latest one named."""
    return np.maximum.accumulate(places)


def stream_signals(
    scored: DataFrame,
    *,
    thresholds: Mapping[str, float] = C.SERVICE_THRESHOLDS,
    min_flag_window: int = C.MIN_FLAG_WINDOW,
    buffer: int = BUFFER,
    keys: Sequence[str] = ("service_name",),
) -> DataFrame:
    """Detector signals on a stream of scored rows, with one buffer of flags per key."""
    limit = buffer_size(min_flag_window, buffer)
    rows = candidate_flags(scored, thresholds)
    extra = [
        T.StructField("window_fill", T.IntegerType()),
        T.StructField("window_size", T.IntegerType()),
        T.StructField("service_candidate_rate", T.DoubleType()),
        T.StructField("anomaly_flag", T.BooleanType()),
    ]
    out_schema = T.StructType([*rows.schema.fields, *extra])
    names = [f.name for f in out_schema.fields]

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = np.frombuffer(state.get[0].encode(), np.uint8) - ord("0") if state.exists else np.zeros(0, np.uint8)
        pdf = _arrival(batches)
        flags = np.concatenate([before, pdf["candidate_flag"].fillna(False).to_numpy(dtype=np.uint8)]).astype(np.int64)
        new = slice(len(before), None)
        seen = np.arange(1, len(flags) + 1)[new]
        fill, size = np.minimum(seen, min_flag_window), np.minimum(seen, limit)
        share = trailing_counts(flags, limit)[new] / size
        hit = trailing_counts(flags, min_flag_window)[new] == min_flag_window
        state.update(("".join(map(str, flags[-limit:])),))
        yield pdf.assign(window_fill=fill, window_size=size, service_candidate_rate=share, anomaly_flag=hit)[names]

    kept = rows.withColumn("_tie", F.md5("event_id")).groupBy(*keys).applyInPandasWithState(step, out_schema, "flags string", "append", GroupStateTimeout.NoTimeout)
    return with_decision(kept, min_flag_window)


_SNAP_JSON = T.StructType(
    [
        T.StructField("service_name", T.StringType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("anomaly_flag", T.BooleanType()),
        T.StructField("candidate_flag", T.BooleanType()),
        T.StructField("iforest_label", T.StringType()),
        T.StructField("scored_us", T.LongType()),
        T.StructField("generated_us", T.LongType()),
        T.StructField("queue_length", T.DoubleType()),
        T.StructField("event_id", T.StringType()),
    ]
)


def stream_snapshots(signals: DataFrame, *, scope: str = "source_node") -> DataFrame:
    """Latest signal per API service as of each signal, per scope, on a stream.

    Give the signals as read back from their log or topic: state follows state
    only across queries.
    """
    text = (
        "to_json(struct(service_name, anomaly_score, anomaly_flag, candidate_flag, iforest_label, unix_micros(scored_at) as scored_us, "
        "unix_micros(generated_at) as generated_us, queue_length, event_id))"
    )
    rows = signals.where(F.col("service_name").isin(*C.API_SERVICES)).select(
        scope, "event_id", "generated_at", "service_name", F.expr(text).alias("_snap"), F.md5("event_id").alias("_tie")
    )
    out_schema = T.StructType([T.StructField("event_id", T.StringType()), *[T.StructField(c, T.StringType()) for c in SNAP.values()]])
    order = list(C.API_SERVICES)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = list(state.get) if state.exists else [None] * len(order)
        pdf = _arrival(batches)
        # The carried snapshots stand at places 0..; row r of the batch at len(order) + r.
        snaps = np.array([*before, *pdf["_snap"]], dtype=object)
        at = np.arange(len(pdf)) + len(order)
        out = {"event_id": pdf["event_id"]}
        for i, (service, column) in enumerate(zip(order, SNAP.values())):
            out[column] = snaps[carried_last(np.where(pdf["service_name"] == service, at, i))]
        frame = pd.DataFrame(out)
        state.update(tuple(frame.iloc[-1, 1:]))
        yield frame

    state_schema = ", ".join(f"{c} string" for c in SNAP.values())
    kept = rows.groupBy(scope).applyInPandasWithState(step, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)

    def back(col: str):
        j = F.from_json(col, _SNAP_JSON)
        return F.when(
            F.col(col).isNotNull(),
            F.struct(
                j["service_name"].alias("service_name"), j["anomaly_score"].alias("anomaly_score"), j["anomaly_flag"].alias("anomaly_flag"),
                j["candidate_flag"].alias("candidate_flag"), j["iforest_label"].alias("iforest_label"),
                F.timestamp_micros(j["scored_us"]).alias("scored_at"), F.timestamp_micros(j["generated_us"]).alias("generated_at"),
                j["queue_length"].alias("queue_length"), j["event_id"].alias("event_id"),
            ),
        ).alias(col)

    return kept.select("event_id", *[back(c) for c in SNAP.values()])


def stream_enriched(signals: DataFrame, profiles: DataFrame, **options) -> DataFrame:
    """Enriched anomaly events on a stream of signals (static profile table)."""
    return enrich(stream_snapshots(signals), profiles, **options)


def _write_batches(stream: DataFrame, base: str, checkpoint: str, step: Callable[[DataFrame, DataFrame | None], DataFrame], after: Callable) -> StreamingQuery:
    """Write ``step(batch, state)`` and the state ``after(batch, rows, state)`` of every batch below ``base``."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, state = (f"{base}/{kind}/batch_id={{}}" for kind in ("rows", "state"))
        # Batches are numbered from 0 without gaps, and start when the one before is done.
        before = spark.read.parquet(state.format(number - 1)) if number else None
        with shuffles_freed(spark):
            step(batch, before).write.mode("overwrite").parquet(rows.format(number))
            done = spark.read.parquet(rows.format(number))
            after(batch, done, before).coalesce(1).write.mode("overwrite").parquet(state.format(number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, base: str) -> DataFrame:
    """The rows of all batches."""
    return spark.read.option("basePath", f"{base}/rows").parquet(f"{base}/rows").drop("batch_id", "ordinal", "ordinal_count")


def write_signals(
    scored: DataFrame, base: str, checkpoint: str, *, min_flag_window: int = C.MIN_FLAG_WINDOW, buffer: int = BUFFER,
    keys: Sequence[str] = ("service_name",), **options,
) -> StreamingQuery:
    """Run the detector over what the stream has; a batch is spread over all tasks, whatever its keys."""
    keys, limit = tuple(keys), buffer_size(min_flag_window, buffer)

    def step(batch, before):
        return signals_after(batch, before, min_flag_window=min_flag_window, buffer=buffer, keys=keys, **options)

    return _write_batches(scored, base, checkpoint, step, lambda batch, rows, before: last_flags(rows, before, limit, keys))


def write_enriched(signals: DataFrame, profiles: DataFrame, base: str, checkpoint: str, *, scope: str = "source_node", **options) -> StreamingQuery:
    """Run snapshots and correlation over what the stream of signals has (static profile table)."""

    def step(batch, before):
        return enrich(snapshots(batch, scope=scope, before=before), profiles, **options)

    return _write_batches(signals, base, checkpoint, step, lambda batch, rows, before: latest(batch, before, scope=scope))


def stream_incidents(enriched: DataFrame) -> DataFrame:
    """Incident rows on a stream of enriched events: a stateless projection."""
    return incidents(enriched)


def stream_freshness(signals: DataFrame) -> DataFrame:
    """Running decisions, mean and largest freshness per service (update or complete mode)."""
    return signals.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("decisions"), F.avg("decision_freshness_ms").alias("mean_freshness_ms"),
        F.max("decision_freshness_ms").alias("max_freshness_ms"),
    )
