"""Column helpers used across operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def r6(col: Column) -> Column:
    return F.round(col, 6)


def safe_rate(num: Column, den: Column) -> Column:
    """Rounded ratio, 0 where the denominator is 0 or missing."""
    return F.when(den > 0, r6(num / den)).otherwise(F.lit(0.0))


def literal_array(values: Iterable) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(key: Column, table: Mapping) -> Column:
    """Small fixed lookup as a literal map; null for unknown keys."""

    def text(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        return f"{v!r}D" if isinstance(v, float) else repr(v)

    pairs = ", ".join(f"{text(k)}, {text(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def compact(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def micros(ts: Column) -> Column:
    """Epoch microseconds of a TIMESTAMP or TIMESTAMP_NTZ column."""
    return F.unix_micros(ts.cast("timestamp"))


def count_at_most(cuts: str, value: str) -> str:
    """SQL: how many elements of a sorted array of any size are at most ``value`` (binary search)."""
    steps = f"sequence(cast(floor(log2(greatest(size({cuts}), 1))) as int), 0, -1)"
    at = "p + shiftleft(1, e)"
    return f"aggregate({steps}, 0, (p, e) -> case when {at} <= size({cuts}) and get({cuts}, {at} - 1) <= {value} then {at} else p end)"


def two_places(value: str) -> str:
    """SQL: a double from 0 up to 8 as text with two decimals, rounded from its exact binary value (ties to even), as C's printf does.

    ``format_string`` rounds the shortest decimal text instead: 0.595, which is stored a little lower, would give 0.60 and not 0.59.
    """
    # In units of 2^-60 such a double is a whole number; what is lost below that lies far from any tie.
    scaled = f"cast(cast({value} * {1 << 60}D as bigint) as decimal(19, 0)) * 100"
    low, rest = f"({scaled}) div {1 << 60}BD", f"({scaled}) % {1 << 60}BD"
    up = f"case when {rest} > {1 << 59}BD or ({rest} = {1 << 59}BD and ({low}) % 2 = 1) then 1 else 0 end"
    return f"cast(cast((({low}) + {up}) / 100BD as decimal(20, 2)) as string)"


def linear_quantile(sorted_values: Column, q: float) -> Column:
    """Interpolated quantile of a short sorted array column (0 when empty)."""
    n = F.size(sorted_values)
    pos = F.lit(float(q)) * (n - 1)
    low = F.floor(pos).cast("int")
    high = F.least(low + 1, n - 1)
    a = F.get(sorted_values, low)
    b = F.get(sorted_values, high)
    return F.when(n == 0, F.lit(0.0)).otherwise(a + (b - a) * (pos - low))
