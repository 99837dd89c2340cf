"""Star positions, light, quality and colour as columns. All arithmetic is in double precision; missing is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floor of the parallax error (mas), quality that a star needs, solar magnitude in G, zero points.
ERROR_FLOOR, MIN_QUALITY, SUN_G = 0.010, 5.0, 4.67


def d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def finite(c: Column) -> Column:
    """True for numbers, false for NULL, NaN and infinities."""
    return F.coalesce(F.abs(c) < float("inf"), F.lit(False))


def half_extent(min_quality: float = MIN_QUALITY) -> float:
    """Half the side of the cube (pc) that holds every star of that quality: the farthest has the floor's error."""
    return 1000.0 / (min_quality * ERROR_FLOOR)


def positive_parallax(parallax: Column) -> Column:
    """Kept at ingestion: present and not zero or below. NaN stays, and fails the quality test later."""
    return parallax.isNotNull() & ~(parallax <= 0)


def parallax_quality(parallax: Column, error: Column) -> Column:
    """Parallax over its error (at least the floor); NULL unless both are finite and positive."""
    ok = finite(parallax) & finite(error) & (parallax > 0) & (error > 0)
    return F.when(ok, parallax / F.greatest(error, F.lit(ERROR_FLOOR)))


def cartesian(ra: Column, dec: Column, parallax: Column) -> tuple[Column, Column, Column]:
    """x, y, z in parsecs."""
    dist, a, b = 1000.0 / parallax, F.radians(ra), F.radians(dec)
    return dist * F.cos(b) * F.cos(a), dist * F.cos(b) * F.sin(a), dist * F.sin(b)


def luminosity(parallax: Column, mag: Column) -> Column:
    """In units of the sun's, from parallax (mas) and apparent magnitude; NULL unless finite and positive."""
    absolute = mag - 5 * F.log10(1000.0 / parallax / 10)
    lum = F.pow(F.lit(10.0), (F.lit(SUN_G) - absolute) / 2.5)
    return F.when(finite(parallax) & (parallax > 0) & finite(mag), F.when(finite(lum) & (lum > 0), lum))


def _mix(t: Column, a: tuple, b: tuple, lo: float, width: float) -> list[Column]:
    return [x + (y - x) * (t - lo) / width for x, y in zip(a, b)]


#: The colour ramp's stops, blue, white, yellow and red.
RAMP = (0.6, 0.7, 1.0), (1.0, 0.95, 0.9), (1.0, 0.85, 0.4), (1.0, 0.3, 0.1)


def colour(bp_rp: Column) -> list[Column]:
    """Red, green, blue for a colour index, from blue over white and yellow to red; white where it is missing."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (bp_rp + 0.5) / 3.5))
    blue, white, yellow, red = RAMP
    low, mid, high = _mix(t, blue, white, 0.0, 0.33), _mix(t, white, yellow, 0.33, 0.33), _mix(t, yellow, red, 0.66, 0.34)
    return [F.when(~finite(bp_rp), 1.0).when(t < 0.33, a).when(t < 0.66, b).otherwise(c) for a, b, c in zip(low, mid, high)]


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def tone(v: Column) -> Column:
    """Light to a byte: compressed, gamma 2.2."""
    return F.least(F.lit(255), half_up(255 * F.pow(v / (1 + v), F.lit(1 / 2.2)))).cast("int")
