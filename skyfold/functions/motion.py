"""Camera motion: speed over a session's moves, smoothed rates, and how they are shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parsecs that light travels in a second (fixed value).
LIGHT = 9.716e-9


def speeds(moves: DataFrame, keys: Sequence[str], at: str, order: str, x: str, y: str, z: str) -> DataFrame:
    """Adds speed: the distance from the session's move before over the seconds since; NULL for the first and without time."""
    w = W.partitionBy(*keys).orderBy(at, order)
    step = F.sqrt(sum((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in (x, y, z)))
    now = F.unix_micros(F.col(at).cast("timestamp"))
    seconds = now - F.lag(now).over(w)
    return moves.withColumn("speed", step / F.nullif(seconds, F.lit(0)) * 1e6)


def smoothed(values: Column, keep: float = 0.9) -> Column:
    """The last exponential mean of an array of values in order: the first, then keep of the mean and the rest of the new."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda m, v: F.when(m.isNull(), v).otherwise(m * keep + v * (1 - keep)))


def speed_text(pc_per_second: Column) -> Column:
    """In multiples of the speed of light, with k, M, G for thousands, millions, billions."""
    c = pc_per_second / LIGHT
    show = lambda k, unit: F.format_string(f"%.2f {unit}", c / k)
    return F.when(c < 1e3, show(1.0, "c")).when(c < 1e6, show(1e3, "kc")).when(c < 1e9, show(1e6, "Mc")).otherwise(show(1e9, "Gc"))


def slider(t: Column, low: float = -3.0, high: float = 6.0) -> Column:
    """A slider's place in [0, 1] to a value on a logarithmic scale between powers of ten."""
    return F.pow(F.lit(10.0), F.lit(low) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * (high - low))
