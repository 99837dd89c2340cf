"""Stars to pixels: projection, splats, additive light, bytes, and the comparison of two images. An image is a sparse relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions.astro import colour, finite, half_up, tone
from skyfold.functions.camera import Camera, default_exposure

# The least radius of a splat, the fall of its light, the side of a tile, the byte above which a pixel is bright,
# and how an image passes: the ratio of light, how far that of bright pixels may be from 1, the error of a tile and the share of tiles.
SPLAT_FLOOR, FALLOFF, TILE, BRIGHT = 0.8, 4.0, 64, 127
FLUX_RATIO, BRIGHT_OFF, TILE_ERROR, TILE_SHARE = (0.9, 1.1), 0.05, 0.05, 0.8


def rasterize(stars: DataFrame, camera: Camera, exposure: float | None = None, max_radius: float = 1.0, least: float = 0.0) -> DataFrame:
    """Rows (x, y, r, g, b): the light that falls on each pixel. Stars need x, y, z, luminosity, bp_rp.

    Splats are at most (2 * ceil(max_radius) + 1) squared pixels; their sums are partly made before the shuffle. least:
    what of a star falls on a pixel is left out below this light.
    """
    exposure = default_exposure(camera) if exposure is None else exposure
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    lit_up = stars.where(finite(F.col("luminosity").cast("double")) & (F.col("luminosity") > 0) & camera.sees_point(x, y, z))
    on = lit_up.withColumns(camera.project(x, y, z)).where("depth > 0")
    brightness = F.col("luminosity").cast("double") / F.greatest(F.col("ref") * F.col("ref"), F.lit(0.01)) * exposure
    on = on.select("sx", "sy", brightness.alias("light"), *[c.alias(n) for n, c in zip(("cr", "cg", "cb"), colour(F.col("bp_rp").cast("double")))])
    on = on.withColumn("radius", F.least(F.greatest(F.col("light"), F.lit(SPLAT_FLOOR)), F.lit(float(max_radius)))).withColumn("ir", F.ceil("radius").cast("int"))
    on = on.withColumns({"px": half_up(F.col("sx")), "py": half_up(F.col("sy"))})
    side = F.sequence(-F.col("ir"), F.col("ir"))
    splat = on.withColumn("dx", F.explode(side)).withColumn("dy", F.explode(side))
    splat = splat.withColumns({"x": F.col("px") + F.col("dx"), "y": F.col("py") + F.col("dy")}).where(F.col("x").between(0, camera.width - 1) & F.col("y").between(0, camera.height - 1))
    near = (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / (F.col("radius") * F.col("radius"))
    value = F.col("light") * F.exp(-FALLOFF * near)
    if least > 0:
        splat = splat.where(value >= least)
    return splat.groupBy("x", "y").agg(*[F.sum(F.col(c) * value).alias(n) for c, n in (("cr", "r"), ("cg", "g"), ("cb", "b"))])


def tonemap(light: DataFrame) -> DataFrame:
    return light.select("x", "y", *[tone(F.col(c)).alias(c) for c in "rgb"])


def compare(exact: DataFrame, fast: DataFrame, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Of two byte images: one row of figures with their verdicts, and the tiles with their root mean square error.

    Pixels that an image lacks are black; tiles that both lack have no error.
    """
    one = exact.select("x", "y", *[F.col(c).alias(f"e{c}") for c in "rgb"])
    two = fast.select("x", "y", *[F.col(c).alias(f"f{c}") for c in "rgb"])
    both = one.join(two, ["x", "y"], "full_outer").na.fill(0)
    square = sum(((F.col(f"e{c}") - F.col(f"f{c}")) / 255) * ((F.col(f"e{c}") - F.col(f"f{c}")) / 255) for c in "rgb")
    tx, ty = (F.floor(F.col(a) / TILE) * TILE for a in "xy")
    pixels = F.least(F.lit(TILE), width - F.col("tx")) * F.least(F.lit(TILE), height - F.col("ty"))
    tiles = both.groupBy(tx.alias("tx"), ty.alias("ty")).agg(F.sum(square).alias("sq")).select("tx", "ty", F.sqrt(F.col("sq") / (3 * pixels)).alias("rmse"))
    n = -(-width // TILE) * -(-height // TILE)
    fails = tiles.agg(F.count_if(F.col("rmse") >= TILE_ERROR).alias("bad"))
    flux = lambda p: F.sum(F.col(f"{p}r") + F.col(f"{p}g") + F.col(f"{p}b"))
    bright = lambda p: F.count_if(F.greatest(f"{p}r", f"{p}g", f"{p}b") > BRIGHT)
    sums = both.agg(flux("e").alias("exact_flux"), flux("f").alias("fast_flux"), bright("e").alias("exact_bright"), bright("f").alias("fast_bright")).crossJoin(fails)
    out = sums.select(
        "exact_flux", "fast_flux", "exact_bright", "fast_bright",
        (F.col("fast_flux") / F.greatest("exact_flux", F.lit(1))).alias("flux_ratio"),
        (F.col("fast_bright") / F.greatest("exact_bright", F.lit(1))).alias("bright_ratio"),
        ((n - F.col("bad")) / n).alias("passing"),
    )
    return out.withColumns({
        "flux_ok": F.col("flux_ratio").between(*FLUX_RATIO), "bright_ok": F.abs(F.col("bright_ratio") - 1) <= BRIGHT_OFF, "tiles_ok": F.col("passing") >= TILE_SHARE,
    }), tiles


def difference(exact: DataFrame, fast: DataFrame) -> DataFrame:
    """Four times the absolute difference of each channel, at most 255; pixels without one are left out."""
    both = exact.alias("e").join(fast.alias("f"), ["x", "y"], "full_outer")
    out = both.select("x", "y", *[F.least(F.lit(255), 4 * F.abs(F.coalesce(F.col(f"e.{c}"), F.lit(0)) - F.coalesce(F.col(f"f.{c}"), F.lit(0)))).alias(c) for c in "rgb"])
    return out.where("r + g + b > 0")
