"""Exact ordinals and ordered windows over hot keys.

A window partitioned by a service alone sends a third of all rows to one task.
Here the order key is cut into slices first, ranks are taken per slice, and a
small table of slice sizes turns them into global ranks.  Windows that look back
run over the same groups and take what lies before a group from another small
table, so that rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from faultline.functions.scalars import count_at_most

SLICES = 64
SLICE_BYTES = 128 << 20
MAX_SLICES = 10_000
SLICE_ROWS = 500_000
BLOCK = 100_000


def tie_key(event_id: Column) -> Column:
    """Uniform tie-break; lets a hot instant be split by its leading hex digits."""
    return F.md5(event_id.cast("string"))


def slices_for(df: DataFrame) -> int:
    """Slices at most, so that one holds about ``SLICE_BYTES`` by the optimizer's size estimate; balance only, ranks do not depend on it."""
    # Estimates multiply along joins and may have any number of digits, so the rounded text form is read.
    number, unit = df._jdf.queryExecution().optimizedPlan().stats().simpleString().split(",")[0].split("=")[1].split()
    size = min(float(number) * 1024 ** ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB").index(unit), float(SLICE_BYTES * MAX_SLICES))
    return max(SLICES, int(size // SLICE_BYTES))


#: Columns of the group a row is ordered in: its key, a slice of the order key, a part of a hot instant.
GROUP = ("_key", "_slice", "_sub")


def sliced(df: DataFrame, keys: Sequence[str], at: Column, event_id: Column, *, slices: int | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows with the columns of ``GROUP``: within a key, every row of a group stands before all of the next (by ``_slice``, ``_sub``).

    ``at`` is numeric and ordered in its own type; only the cut points are
    doubles, which keeps ids beyond 2^53 apart.  Cut points come from an approximate quantile sketch;
    they steer balance only, any cut points give the same order.
    """
    keys = list(keys)
    most = slices or slices_for(df)
    probe = df.select(at.cast("double").alias("_at"))
    grid = F.array(*[F.lit(i / most) for i in range(1, most)])
    found = F.percentile_approx("_at", grid, max(1000, 4 * most))
    if not slices:
        # Size estimates may be far too large behind joins: the rows counted tell how many cut points are kept.
        every = F.expr(f"greatest(1L, {most} div greatest({SLICES}L, count(1) div {slice_rows}))")
        found = F.filter(found, lambda x, i: (i + 1) % every == 0)
    cuts = probe.agg(found.alias("c")).scalar()

    # Cut points that repeat mark instants holding more than one slice of rows:
    # those instants are split again by the leading hex digits of the tie key.
    return (
        df.withColumns({"_native": at, "_at": at.cast("double"), "_cuts": cuts, "_key": F.struct(F.lit(0).alias("_"), *keys)})
        .withColumn("_slice", F.expr(count_at_most("_cuts", "_at")))
        .withColumn("_hot", F.expr("_slice >= 2 and get(_cuts, _slice - 1) = _at and get(_cuts, _slice - 2) = _at"))
        .withColumn("_point", F.col("_at").cast(df.select(at.alias("a")).schema["a"].dataType))
        .withColumn(
            "_sub",
            # Values that only a double takes for the hot one stand before or after it.
            F.when(~F.coalesce("_hot", F.lit(False)), "9").when(F.expr("_native < _point"), "0").when(F.expr("_native > _point"), "2")
            .otherwise(F.concat(F.lit("1"), F.coalesce(F.substring(tie_key(event_id), 1, 2), F.lit("")))),  # null ids first
        )
        .drop("_hot", "_point", "_native", "_at", "_cuts")
    )


def group_offsets(keyed: DataFrame, total: str) -> DataFrame:
    """``GROUP``, rows of the key before the group as ``_off``, and all rows of the key: counted where the rows are read."""
    # Structs are equal where their keys are, null or not, so the sizes join without dealing the rows out again.
    sizes = keyed.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n"))
    over_key = W.partitionBy("_key")
    running = over_key.orderBy("_slice", "_sub").rowsBetween(W.unboundedPreceding, -1)
    return (
        sizes.withColumn("_off", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .withColumn(total, F.sum("_n").over(over_key))
        .drop("_n")
    )


def dealt(keyed: DataFrame, event_id: Column) -> DataFrame:
    """Rows shuffled to their groups, with ``_tie``: windows over ``GROUP`` and joins by it deal nothing out again."""
    # Bytes sort as their hex digits do; they are made where they are sorted, so the id alone is shuffled.
    return keyed.repartition(*GROUP).withColumn("_tie", F.unhex(tie_key(event_id)))


def with_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    at: Column,
    event_id: Column,
    *,
    ordinal: str = "ordinal",
    total: str = "ordinal_count",
    slices: int | None = None,
) -> DataFrame:
    """Zero-based rank per key ordered by (at, md5(id), id), plus the key's row count; see :func:`sliced` for ``at``."""
    keyed = sliced(df, keys, at, event_id, slices=slices)
    in_slice = W.partitionBy(*GROUP).orderBy(at, "_tie", event_id)
    ranked = dealt(keyed, event_id).withColumn("_rn", F.row_number().over(in_slice) - 1)
    return ranked.join(group_offsets(keyed, total), list(GROUP), "left").select(
        *df.columns,
        (F.col("_rn") + F.col("_off")).cast("long").alias(ordinal),
        F.col(total).cast("long").alias(total),
    )
