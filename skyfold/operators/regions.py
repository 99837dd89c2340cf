"""Points in regions and points near points, by crossing parity.

A region's edges are binned into strips of latitude (and tiles along the strip), before anything is joined; points are
joined to the edges binned where they lie; eastward rays from a point are tested against these edges, and the edges that
a ray crosses are counted by point and region. An odd count is inside. The boundary is closed: a point on an edge or a
vertex lies in the region.

Points near points are points in the octagons around other points, and the exact distance holds what comes out to the
circle. Bins then have a third direction, in which a region is as long as the circle is wide.

Defined cases: points or vertices with a null or NaN coordinate or a null identifier don't count; null keys form a
group; repeated points and repeated pairs come out once; regions with fewer than three vertices contain what lies on
their edges; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import cos, pi, radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyfold.common import Scratch, maybe_broadcast


def _finite(*cols: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf")) for c in cols])


def _bin(value: Column, width: float | Column) -> Column:
    return F.floor(value / (width if isinstance(width, Column) else F.lit(width))).cast("long")


def crossing_parity(tests: DataFrame, px: Column, py: Column, by: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    """The pairs of a point and a region whose point lies in the region, of rows that have a point and one edge of the region.

    tests: edges as __no (unique in the region), x1, y1, x2, y2. An edge that comes several times with a point, as
    repeated points have it, counts once. by: columns that tell a pair. keep: aggregates to carry along. Only crossed or
    touched edges are shuffled, so AQE may split the join before.
    """
    rows = tests.withColumns({"__px": px, "__py": py})
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("__px", "__py", "x1", "y1", "x2", "y2"))
    side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
    crosses = ((y1 <= y) & (y2 > y) & (side > 0)) | ((y2 <= y) & (y1 > y) & (side < 0))
    on_edge = (side == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    met = rows.withColumns({"__crosses": crosses, "__on": on_edge}).where(F.col("__crosses") | F.col("__on"))
    one = met.groupBy(*by, "__no").agg(F.max("__crosses").cast("int").alias("__crosses"), F.max("__on").alias("__on"), *keep)
    kept = [c for c in one.columns if c not in (*by, "__no", "__crosses", "__on")]
    found = one.groupBy(*by).agg(F.sum("__crosses").alias("__crosses"), F.max("__on").alias("__on"), *[F.min(c).alias(c) for c in kept])
    return found.where(F.col("__on") | (F.col("__crosses") % 2 == 1)).drop("__crosses", "__on")


def points_in_regions(points: DataFrame, regions: DataFrame, ident: str, px: str, py: str, region: str, seq: str, vx: str, vy: str, strip: float, tile: float, wrap: float | None = None) -> DataFrame:
    """Rows (ident, region): the points in each region, both in the plane of (px, py).

    regions: one row per vertex, in the order of seq; the last joins the first. strip and tile: sizes of the smallest
    bins along y and x. Longer edges and edges of wider regions go to coarser bins, each twice the size of the one before,
    so that an edge has a handful of rows whatever its length; points meet the edges of all sizes that occur. wrap: the
    full turn of x (360 for degrees); points are brought into it, and regions across the seam are met from both sides. A
    region on the sky must not contain a pole.
    """
    scratch = Scratch(points.sparkSession)
    p = points.where(_finite(px, py) & F.col(ident).isNotNull()).select(F.col(ident).alias("__p"), F.col(px).cast("double").alias("__x"), F.col(py).cast("double").alias("__y"))
    if wrap:
        p = p.withColumn("__x", F.pmod("__x", F.lit(float(wrap))))
    v = regions.where(_finite(vx, vy) & F.col(region).isNotNull()).select(F.col(region).alias("__r"), F.col(seq).alias("__s"), F.col(vx).cast("double").alias("x1"), F.col(vy).cast("double").alias("y1"))
    w = W.partitionBy("__r").orderBy("__s", "x1", "y1")
    e = v.withColumns({"__no": F.row_number().over(w), "x2": F.lead("x1").over(w), "y2": F.lead("y1").over(w)})
    ends = v.groupBy("__r").agg(F.min(F.struct("__s", "x1", "y1")).alias("__f"), F.min("x1").alias("__xmin"), F.max("x1").alias("__xmax"))
    e = e.join(ends, "__r").withColumns({"x2": F.coalesce("x2", "__f.x1"), "y2": F.coalesce("y2", "__f.y1")}).drop("__f", "__s")
    if wrap:
        e = e.withColumn("__turn", F.explode(F.sequence((F.floor(F.col("__xmin") / wrap)).cast("int"), F.floor(F.col("__xmax") / wrap).cast("int"))))
        for c in ("x1", "x2", "__xmin", "__xmax"):
            e = e.withColumn(c, F.col(c) - F.col("__turn") * wrap)
    else:
        e = e.withColumn("__turn", F.lit(0))
    # A ray that starts west of the region doesn't count, so an edge matters from the region's west end to its own east end.
    e = e.withColumn("__east", F.greatest("x1", "x2")).drop("__xmax")
    reach = F.greatest(F.abs(F.col("y2") - F.col("y1")) / strip, (F.col("__east") - F.col("__xmin")) / tile, F.lit(1.0))
    e = e.withColumn("__level", F.ceil(F.log2(reach)).cast("int")).withColumn("__scale", F.pow(F.lit(2.0), F.col("__level")))
    e = e.withColumn("__sy", F.explode(F.sequence(_bin(F.least("y1", "y2"), strip * F.col("__scale")), _bin(F.greatest("y1", "y2"), strip * F.col("__scale")))))
    e = e.withColumn("__sx", F.explode(F.sequence(_bin(F.col("__xmin"), tile * F.col("__scale")), _bin(F.col("__east"), tile * F.col("__scale"))))).drop("__scale")
    edges = maybe_broadcast(e, scratch)
    levels = [r["__level"] for r in edges.select("__level").distinct().collect()]  # sizes of bins, each twice another: some dozens at most
    p = p.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels]))) if levels else p.withColumn("__level", F.lit(0))
    scale = F.pow(F.lit(2.0), F.col("__level"))
    p = p.withColumns({"__sx": _bin(F.col("__x"), tile * scale), "__sy": _bin(F.col("__y"), strip * scale)})
    tests = p.join(edges, ["__level", "__sx", "__sy"]).where(F.col("__x").between(F.col("__xmin"), F.col("__east")))
    found = crossing_parity(tests, F.col("__x"), F.col("__y"), ["__p", "__r", "__x", "__y", "__turn"])
    return found.select(F.col("__p").alias(ident), F.col("__r").alias(region)).distinct()


#: Corners of an octagon around a circle of radius 1 with a flat top, a hair wider, so that the circle's own boundary lies inside.
_CORNERS = [((1 + 1e-9) * cos((2 * k + 1) * pi / 8) / cos(pi / 8), (1 + 1e-9) * sin((2 * k + 1) * pi / 8) / cos(pi / 8)) for k in range(8)]
#: Its edges; a ray along the strip never crosses the flat ones.
_EDGES = [(n, a, b) for n, (a, b) in enumerate(zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1])) if abs(a[1] - b[1]) > 1e-6]


def _edge_bits(cx: Column, cy: Column, radius: float, width: float, sx: Column, sy: Column) -> Column:
    """Which edges of the octagon around (cx, cy) belong to a bin: those in its strip that a ray from its tile may cross."""
    bits = F.lit(0)
    for n, a, b in _EDGES:
        low, high = sorted((a[1], b[1]))
        here = (sy >= _bin(cy + low * radius, width)) & (sy <= _bin(cy + high * radius, width)) & (sx <= _bin(cx + max(a[0], b[0]) * radius, width))
        bits = bits + F.when(here, 1 << n).otherwise(0)
    return bits


def _edges_of(bits: Column, cx: Column, cy: Column, radius: float) -> Column:
    """The binned edges as an array of structs."""
    made = [F.when(bits.bitwiseAND(F.lit(1 << n)) != 0, F.struct(
        F.lit(n).alias("__no"), (cx + a[0] * radius).alias("x1"), (cy + a[1] * radius).alias("y1"), (cx + b[0] * radius).alias("x2"), (cy + b[1] * radius).alias("y2"),
    )) for n, a, b in _EDGES]
    return F.array_compact(F.array(*made))


def in_octagons(points: DataFrame, keys: Sequence[str], ident: str, stored: Sequence[str], position: Callable[[str], tuple[Column, Column, Column]], radius: float, cells: float = 10) -> DataFrame:
    """Rows (__k0.., __p, __q, __d): points p < q of a group with p in the octagon around q, and their distance in space.

    The octagon lies in the plane of (x, z), z being the latitude; along y a region is the circle's width. stored: the
    columns that a row keeps through the shuffles; position(prefix) makes x, y, z of them. cells: the width of a bin in radii.
    """
    width, reach = radius * cells, radius * (1 + 1e-6)
    names = [f"__k{i}" for i in range(len(keys))]
    one = points.where(_finite(*stored) & F.col(ident).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(ident).alias("__id"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(stored)])
    one = one.distinct()
    kept = [f"__c{i}" for i in range(len(stored))]
    placed = one.withColumns(dict(zip(("x", "y", "z"), position("__c"))))
    cell = lambda a, b, c: F.xxhash64(*names, a, b, c).alias("__cell")
    here = placed.select(cell(*[_bin(F.col(c), width) for c in "xyz"]), *names, F.col("__id").alias("__p"), *[F.col(c).alias(f"__p{i}") for i, c in enumerate(kept)])
    # The edges of every octagon, binned: a row for each bin that has any, saying which.
    over = lambda c: F.sequence(_bin(F.col(c) - reach, width), _bin(F.col(c) + reach, width))
    bins = placed.withColumn("__sy", F.explode(over("z"))).withColumn("__sx", F.explode(over("x"))).withColumn("__third", F.explode(over("y")))
    bins = bins.withColumn("__bits", _edge_bits(F.col("x"), F.col("z"), radius, width, F.col("__sx"), F.col("__sy"))).where("__bits <> 0")
    binned = bins.select(cell(F.col("__sx"), F.col("__third"), F.col("__sy")), *[F.col(n).alias(f"__r{n}") for n in names], F.col("__id").alias("__q"), *[F.col(c).alias(f"__q{i}") for i, c in enumerate(kept)], "__bits")
    # Positions are made again from what was stored, as their digits would be most of what is shuffled.
    p, q = position("__p"), position("__q")
    on = [here["__cell"] == binned["__cell"], F.col("__p") < F.col("__q"), *[F.col(n).eqNullSafe(F.col(f"__r{n}")) for n in names], *[F.abs(a - b) <= reach for a, b in zip(p, q)]]
    met = here.join(binned, reduce(lambda a, b: a & b, on)).drop(binned["__cell"])
    met = met.withColumns({"__d": F.sqrt(sum((a - b) * (a - b) for a, b in zip(p, q))), "__x": p[0], "__y": p[2]})
    # The positions tell the pairs too: an identifier stored at several places is as many points.
    by = [*names, "__p", "__q", *[f"__{s}{i}" for s in "pq" for i in range(len(kept))]]
    tests = met.select(*by, "__d", "__x", "__y", F.inline(_edges_of(F.col("__bits"), q[0], q[2], radius)))
    return crossing_parity(tests, F.col("__x"), F.col("__y"), by, [F.min("__d").alias("__d")]).select(*names, "__p", "__q", "__d")


def _pairs(inside: DataFrame, keys: Sequence[str], ident: str, radius: float) -> DataFrame:
    """Of the pairs in octagons, those in the circle: exact, in double precision."""
    names = [f"__k{i}" for i in range(len(keys))]
    near = inside.where(F.col("__d") <= radius).groupBy(*names, "__p", "__q").agg(F.min("__d").alias("distance"))
    return near.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("__p").alias(f"{ident}_a"), F.col("__q").alias(f"{ident}_b"), "distance")


def near_pairs(points: DataFrame, keys: Sequence[str], ident: str, x: str, y: str, z: str, radius: float, cells: float = 10) -> DataFrame:
    """Rows (keys, <ident>_a, <ident>_b, distance): pairs of different points of a group at most radius apart, a < b."""
    place = lambda c: tuple(F.col(f"{c}{i}").cast("double") for i in range(3))
    return _pairs(in_octagons(points, keys, ident, [x, y, z], place, radius, cells), keys, ident, radius)


def near_on_sky(points: DataFrame, keys: Sequence[str], ident: str, ra: str, dec: str, arcsec: float, cells: float = 10) -> DataFrame:
    """As near_pairs, on the sky: ra and dec in degrees, any full turn; distance in arc seconds along the great circle.

    The search runs over unit vectors, whose latitude axis is z, so neither the poles nor the seam at 0 degrees are special.
    """

    def unit(c: str) -> tuple[Column, Column, Column]:
        a, d = F.radians(F.pmod(F.col(f"{c}0").cast("double"), F.lit(360.0))), F.radians(F.col(f"{c}1").cast("double"))
        return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)

    chord = 2 * sin(radians(arcsec / 3600) / 2) * (1 + 1e-9)
    found = _pairs(in_octagons(points, keys, ident, [ra, dec], unit, chord, cells), keys, ident, chord)
    angle = F.degrees(2 * F.asin(F.col("distance") / 2)) * 3600
    return found.withColumn("distance", angle).where(F.col("distance") <= arcsec * (1 + 1e-10))
