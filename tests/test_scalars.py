"""Column helpers against plain Python."""

import random

from pyspark.sql import functions as F

from faultline.functions.scalars import two_places


def test_two_places_round_the_binary_value(spark):
    """Halves of the third decimal go by what the double holds (0.595 lies below it), exact ones to even."""
    rng = random.Random(5)
    xs = [0.595, 0.605, 0.125, 0.375, 0.625, 0.875, 0.005, 0.015, 0.0, 1.0, 0.995, 0.003906, 1e-9, 7.995]
    xs += [k / 1000 for k in range(5, 1000, 10)] + [round(rng.random(), 6) for _ in range(500)] + [rng.random() for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", F.expr(two_places("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got] == [(x, f"{x:.2f}") for x in xs]
