"""Results that caps, prefixes or doubles would spoil."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from faultline.functions.ordinals import with_ordinal
from faultline.functions.quantiles import long_quantiles
from faultline.functions.scalars import count_at_most
from faultline.operators import incidents as N


def test_ordinals_of_ids_beyond_double_precision(spark):
    ids = [(1 << 60) + i for i in range(8)] + [5, 6]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    got = {r.id: r.ordinal for r in with_ordinal(df, [], F.col("id"), F.col("id")).collect()}
    assert [got[i] for i in sorted(ids)] == list(range(10))


def test_ordinals_at_a_hot_value_between_neighbours(spark):
    """Most rows share one value whose double equals that of its neighbours."""
    hot = 1 << 60
    rows = [(hot, i) for i in range(4000)] + [(hot - 1, 9001), (hot + 1, 9002), (hot + 1, 9003)]
    df = spark.createDataFrame(rows, "at long, id long").repartition(4)
    got = {r.id: r.ordinal for r in with_ordinal(df, [], F.col("at"), F.col("id"), slices=64).collect()}
    assert got[9001] == 0 and {got[9002], got[9003]} == {4001, 4002}
    assert sorted(got.values()) == list(range(4003))


def test_bucket_search_has_no_largest_grid(spark):
    df = spark.range(0, 9000, 7).selectExpr("cast(id as double) / 3 as v", "transform(sequence(0, 2999), i -> cast(i as double)) as g")
    assert df.where(F.expr(count_at_most("g", "v")) != F.least(F.floor("v") + 1, F.lit(3000))).count() == 0
    empty = spark.sql("select cast(array() as array<double>) as g, 1D as v")
    assert empty.select(F.expr(count_at_most("g", "v"))).first()[0] == 0


def test_logs_are_filtered_before_the_limit(spark):
    start = datetime(2024, 1, 1)
    rows = [(f"e{i:03d}", "orders-api", start + timedelta(seconds=i), 0.5, i >= 90, False, ["r"], "normal") for i in range(100)]
    log = spark.createDataFrame(
        rows, "event_id string, service_name string, generated_at timestamp, anomaly_score double, anomaly_flag boolean, candidate_flag boolean, reason_codes array<string>, scenario_tag string"
    )
    got = N.query_logs(log, service_name="orders-api", severity="high", limit=5).collect()
    assert [r.event_id for r in got] == [f"e{i:03d}" for i in range(90, 95)]


def test_quantiles_with_nan(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(99)] + [("a", float("nan"))], "k string, value double")
    got = long_quantiles(df, ["k"], {"median": 0.5, "top": 0.99}).first()
    assert got.median == 49.5 and got.top != got.top
