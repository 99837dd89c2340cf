"""Queries on views: what a camera sees, level-of-detail cuts, images and their comparison."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.common import Scratch, table
from skyfold.functions.astro import RAMP
from skyfold.functions.camera import Camera, default_exposure, galactic_view
from skyfold.functions.motion import speeds
from skyfold.operators import octree as T
from skyfold.operators import raster as R
from skyfold.plans import tree
from skyfold.sources.labels import faded
from skyfold.streaming.cache import cache_answers, message_events
from skyfold.streaming.views import accepted_views, view_events

INSIDE = Camera(eye=(0.0, 0.0, 0.0), direction=(-0.05, -0.87, -0.48), upward=(0.0, 0.0, 1.0), width=192, height=108, fov=60.0, far=5000.0)
ASIDE = replace(INSIDE, eye=(3000.0, 0.0, 0.0))
#: The whole cube from the galactic north, a quarter of full HD along each side.
ABOVE = galactic_view(tree.HALF, 480, 270)
#: Nodes below so many pixels end a cut, and are merged into what a client draws at once; the views are small, so the latter is, too.
PIXELS, MERGE_PIXELS = 16.0, 32.0
#: Limits of a client, smaller than a real one's so that they matter on small tables: bytes of a batch, free slots, points of a chunk.
BATCH_BYTES, SLOTS, CHUNK_POINTS = 1 << 14, 4, 2048


def views(spark: SparkSession, sf: str, *cameras: Camera) -> list[DataFrame]:
    """The node table with what each camera makes of each node, written once for the walks that follow."""
    nodes, scratch = tree.nodes(spark, sf), Scratch(spark)
    return [scratch.write(T.with_view(nodes, c, tree.HALF, PIXELS), f"viewed-{i}") for i, c in enumerate(cameras)]


def viewed(spark: SparkSession, sf: str, camera: Camera = INSIDE) -> DataFrame:
    return views(spark, sf, camera)[0]


def frustum_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return viewed(spark, sf).where(f"depth = {tree.DEPTH} and seen").select("dataset", "prefix", "point_count")


def lod_cut(spark: SparkSession, sf: str) -> DataFrame:
    return T.lod_cut(viewed(spark, sf), tree.KEYS).select("dataset", "depth", "prefix", "point_count")


def wanted_nodes(spark: SparkSession, sf: str) -> DataFrame:
    found = T.wanted_nodes(viewed(spark, sf), tree.KEYS)
    return found.select("dataset", "depth", "prefix", "point_first", "point_count", F.round("priority", 6).alias("priority"))


def fetch_batches(spark: SparkSession, sf: str) -> DataFrame:
    found = T.fetch_batches(T.wanted_nodes(viewed(spark, sf), tree.KEYS), tree.KEYS, 20, BATCH_BYTES)
    return found.withColumn("priority", F.round("priority", 6))


def _missing(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes wanted 3,000 pc aside, nodes wanted inside, and those of the latter that a client with the former lacks."""
    scratch = Scratch(spark)
    before, after = (scratch.write(T.wanted_nodes(v, tree.KEYS), f"wanted-{i}") for i, v in enumerate(views(spark, sf, ASIDE, INSIDE)))
    return before, after, after.join(before.select("dataset", "depth", "prefix"), ["dataset", "depth", "prefix"], "left_anti")


def fetch_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """What a client that has the nodes of the view 3,000 pc aside asks for first when it moves to the view inside."""
    found = T.next_fetches(T.fetch_batches(_missing(spark, sf)[2], tree.KEYS, 20, BATCH_BYTES), tree.KEYS, SLOTS)
    return found.withColumn("priority", F.round("priority", 6))


def load_state(spark: SparkSession, sf: str) -> DataFrame:
    """After such a move, while the first requests are on their way: nodes that are there, in flight, and wanted."""
    before, after, missing = _missing(spark, sf)
    asked = T.next_fetches(T.fetch_batches(missing, tree.KEYS, 20, BATCH_BYTES), tree.KEYS, SLOTS)
    span = missing.join(asked.select("dataset", "first", "points"), "dataset").where("point_first >= first and point_first < first + points")  # at most SLOTS rows a tree
    return T.load_progress(after, before, span, tree.KEYS)


def _chunks(spark: SparkSession, sf: str, *cameras: Camera) -> list[DataFrame]:
    """Chunks of views drawn from the nodes of the view aside."""
    aside, *seen = views(spark, sf, ASIDE, *cameras)
    have = Scratch(spark).write(T.wanted_nodes(aside, tree.KEYS), "have")
    return [T.chunks(v, have, tree.KEYS, MERGE_PIXELS, CHUNK_POINTS) for v in seen]


def chunk_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, INSIDE)[0]


def chunk_updates(spark: SparkSession, sf: str) -> DataFrame:
    """What changes on the screen from the view aside to the view inside before anything is fetched."""
    return T.changed_chunks(*_chunks(spark, sf, ASIDE, INSIDE), tree.KEYS)


def cache_delta(spark: SparkSession, sf: str) -> DataFrame:
    """From the view inside to the same view from 3,000 pc aside: nodes to fetch, keep and evict, and their points."""
    before, after = views(spark, sf, INSIDE, ASIDE)
    delta = T.cache_delta(T.wanted_nodes(after, tree.KEYS), T.wanted_nodes(before, tree.KEYS), tree.KEYS)
    sized = delta.join(before.select("dataset", "depth", "prefix", "point_count"), ["dataset", "depth", "prefix"])
    return sized.groupBy("dataset", "action").agg(F.count("*").alias("nodes"), F.sum("point_count").alias("points"))


def camera_speeds(spark: SparkSession, sf: str) -> DataFrame:
    """Speed between the views of a session."""
    e = table(spark, sf, "events")
    moves = view_events(e, "ts")
    found = speeds(moves, ["session"], "ts", "seq", "ex", "ey", "ez").where("speed is not null")
    return found.select("seq", "session", F.round("speed", 6).alias("speed"))


def _cut_points(spark: SparkSession, sf: str, camera: Camera) -> DataFrame:
    """The points of the cut's nodes; only these are sampled."""
    cut = Scratch(spark).write(T.lod_cut(viewed(spark, sf, camera), tree.KEYS).select("dataset", "depth", "prefix", "n", "point_count"), "cut")
    return T.all_points(tree.stars(spark, sf), tree.KEYS, "leaf", "source_id", tree.DEPTH, None, only=cut)


def cut_points(spark: SparkSession, sf: str) -> DataFrame:
    return _cut_points(spark, sf, INSIDE).groupBy("dataset", "depth").agg(F.count("*").alias("points"), F.round(F.sum("luminosity"), 2).alias("light"))


def _rounded(light: DataFrame) -> DataFrame:
    return light.select("x", "y", *[F.round(c, 6).alias(c) for c in "rgb"])


def render_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.rasterize(tree.stars(spark, sf), ABOVE))


def render_inside(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.rasterize(tree.stars(spark, sf), INSIDE, exposure=1e-3))


def render_fast(spark: SparkSession, sf: str) -> DataFrame:
    return R.tonemap(R.rasterize(_cut_points(spark, sf, ABOVE), ABOVE))


def tonemapped(spark: SparkSession, sf: str) -> DataFrame:
    return R.tonemap(R.rasterize(tree.stars(spark, sf), ABOVE))


def _images(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The images of all stars and of the cut, written once: at most a row for each pixel."""
    scratch = Scratch(spark)
    return scratch.write(tonemapped(spark, sf), "exact"), scratch.write(render_fast(spark, sf), "fast")


def image_compare(spark: SparkSession, sf: str) -> DataFrame:
    """The view from the cut against the view from all stars."""
    report, _ = R.compare(*_images(spark, sf), ABOVE.width, ABOVE.height)
    return report


def worst_tiles(spark: SparkSession, sf: str) -> DataFrame:
    _, tiles = R.compare(*_images(spark, sf), ABOVE.width, ABOVE.height)
    return tiles.withColumn("rmse", F.round("rmse", 9)).orderBy(F.desc("rmse"), "tx", "ty").limit(5)


def image_difference(spark: SparkSession, sf: str) -> DataFrame:
    return R.difference(*_images(spark, sf))


def labels_fade(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the brightest star of each file, faded with the distance from the camera."""
    s = tree.stars(spark, sf).join(table(spark, sf, "canonical_rows").select("source_id", "input_name").distinct(), "source_id")
    best = s.groupBy("input_name").agg(F.max(F.struct("luminosity", "source_id", "x", "y", "z")).alias("s"))
    shown = faded(best.select("input_name", "s.x", "s.y", "s.z"), (0.0, 0.0, 0.0), 1200.0, 1600.0)
    return shown.select("input_name", F.round("alpha", 6).alias("alpha")).where("alpha > 0")


def view_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    """The camera moves with each user's events; views that moved too little since the last accepted one are dropped."""
    return accepted_views(view_events(table(spark, sf, "events")), tree.HALF)


def cache_states(spark: SparkSession, sf: str) -> DataFrame:
    """What clients ask for, evict and hold while messages come in."""
    return cache_answers(message_events(table(spark, sf, "events")), SLOTS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (cache_states, frustum_leaves, lod_cut, wanted_nodes, fetch_batches, fetch_schedule, load_state, chunk_merge, chunk_updates, cut_points, render_exact, render_inside, render_fast, tonemapped, image_compare, worst_tiles, image_difference, labels_fade, cache_delta, camera_speeds, view_hysteresis)
}


def _seen(c: Camera) -> str:
    return " AND ".join("(" + " + ".join(f"({n!r}) * {a}{'1' if n >= 0 else '0'}" for a, n in zip("xyz", p[:3])) + f" + ({p[3]!r})) >= 0" for p in c.planes())


def _footprint(c: Camera) -> str:
    if c.half_width:
        return f"(x1 - x0) / 2 * {c.width / c.half_width!r}"
    from math import atan

    dist = "sqrt(" + " + ".join(f"power(({a}0 + {a}1) / 2 - ({e!r}), 2)" for a, e in zip("xyz", c.eye)) + ")"
    return f"(x1 - x0) / 2 / greatest({dist}, (x1 - x0) / 2) * {c.height / (2 * atan(c.scale[1]))!r}"


def _viewed(c: Camera) -> str:
    """SQL: nodes with seen, footprint, terminal, and whether an ancestor is terminal."""
    return f"""{tree.NODES}, x AS (SELECT *, {tree.BOXES} FROM t), v0 AS (SELECT *, {_seen(c)} AS seen, {_footprint(c)} AS footprint FROM x),
v AS (SELECT *, child_mask = 0 OR (footprint < {PIXELS} AND point_count > 0) AS terminal FROM v0),
stopped AS (SELECT DISTINCT a.dataset, a.depth, a.prefix FROM v a, range({tree.DEPTH}) r(d) JOIN v b ON b.dataset = a.dataset AND b.depth = d AND b.prefix = a.prefix >> (3 * (a.depth - d))::INT WHERE d < a.depth AND b.terminal),
o AS (SELECT v.* FROM v LEFT JOIN stopped USING (dataset, depth, prefix) WHERE stopped.depth IS NULL),
cut AS (SELECT * FROM o WHERE terminal AND point_count > 0 AND seen)"""


_WANTED = f"""{_viewed(INSIDE)}, w AS (SELECT * FROM o WHERE point_count > 0 AND (terminal OR EXISTS (SELECT 1 FROM o b WHERE b.terminal AND b.point_count > 0 AND b.dataset = o.dataset AND b.depth > o.depth AND b.prefix >> (3 * greatest(b.depth - o.depth, 0))::INT = o.prefix)))"""


def _wanted_from(c: Camera) -> str:
    """SQL: the wanted nodes of a camera as a subquery."""
    return f"""(WITH {_viewed(c)} SELECT * FROM o WHERE point_count > 0 AND (terminal OR EXISTS (SELECT 1 FROM o b WHERE b.terminal AND b.point_count > 0 AND b.dataset = o.dataset
  AND b.depth > o.depth AND b.prefix >> (3 * greatest(b.depth - o.depth, 0))::INT = o.prefix)))"""


def _batches(rows: str) -> str:
    """SQL: greedy batches of adjoining nodes of rows; the last CTE is batches."""
    cap = BATCH_BYTES // 20
    return f"""g AS (SELECT *, coalesce((lag(point_first + point_count) OVER a <> point_first)::INT, 1) AS gap FROM {rows} WINDOW a AS (PARTITION BY dataset ORDER BY point_first, depth)),
e AS (SELECT *, sum(gap) OVER (PARTITION BY dataset ORDER BY point_first, depth) AS run FROM g),
nth AS MATERIALIZED (SELECT dataset, run, point_first, point_count, footprint, row_number() OVER (PARTITION BY dataset, run ORDER BY point_first, depth) AS i FROM e),
walk AS (SELECT *, 0 AS batch, point_count AS held FROM nth WHERE i = 1 UNION ALL
  SELECT n.*, CASE WHEN w.held + n.point_count > {cap} THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.held + n.point_count > {cap} THEN n.point_count ELSE w.held + n.point_count END
  FROM walk w JOIN nth n ON n.dataset = w.dataset AND n.run = w.run AND n.i = w.i + 1),
batches AS (SELECT dataset, min(point_first) AS first, sum(point_count)::BIGINT AS points, count(*) AS nodes, round(max(footprint), 6) AS priority, max(footprint) AS exact FROM walk GROUP BY dataset, run, batch)"""


_MISSING = f"before_ AS {_wanted_from(ASIDE)}, after_ AS {_wanted_from(INSIDE)}, missing AS (SELECT a.* FROM after_ a ANTI JOIN before_ b USING (dataset, depth, prefix))"


def _chunks_sql(c: Camera) -> str:
    """SQL: chunks_, of the view of c drawn from the nodes wanted aside."""
    up = lambda a, b: f"{a}.dataset = {b}.dataset AND {a}.prefix >> (3 * greatest({a}.depth - {b}.depth, 0))::INT = {b}.prefix"
    return f"""have AS {_wanted_from(ASIDE)}, {_viewed(c)},
x0 AS (SELECT o.*, h.n IS NOT NULL AS got FROM o LEFT JOIN have h USING (dataset, depth, prefix) WHERE o.terminal AND o.point_count > 0),
sums AS (SELECT dataset, d::INT AS depth, prefix >> (3 * (depth - d))::INT AS prefix, count(*) AS total, count(*) FILTER (got) AS cached, sum(point_count)::BIGINT AS pts,
  coalesce(sum(point_count) FILTER (got), 0)::BIGINT AS cp, coalesce(sum(node) FILTER (got), 0)::BIGINT AS token FROM x0, range({tree.DEPTH + 1}) r(d) WHERE d <= depth GROUP BY ALL),
stops AS (SELECT dataset, depth, prefix FROM v WHERE (terminal OR footprint < {MERGE_PIXELS}) AND child_mask <> 0),
walked AS (SELECT v.dataset, v.depth, v.prefix, terminal OR footprint < {MERGE_PIXELS} AS stop, coalesce(total, 0) AS total, coalesce(cached, 0) AS cached, coalesce(pts, 0) AS pts, coalesce(cp, 0) AS cp, coalesce(token, 0) AS token
  FROM v LEFT JOIN sums USING (dataset, depth, prefix) WHERE NOT EXISTS (SELECT 1 FROM stops q WHERE q.depth < v.depth AND {up('v', 'q')})),
st AS (SELECT w.*, NOT EXISTS (SELECT 1 FROM walked b WHERE b.stop AND b.total <> b.cached AND b.depth >= w.depth AND {up('b', 'w')}) AND (stop OR pts <= {CHUNK_POINTS}) AS whole FROM walked w),
br AS (SELECT s.*, EXISTS (SELECT 1 FROM st k WHERE k.dataset = s.dataset AND k.depth = s.depth + 1 AND k.prefix >> 3 = s.prefix AND NOT k.whole) AS broken FROM st s),
chunks_ AS (SELECT s.dataset, s.depth, s.prefix, s.cached AS nodes, s.cp AS points, s.token FROM br s LEFT JOIN br p ON p.dataset = s.dataset AND p.depth = s.depth - 1 AND p.prefix = s.prefix >> 3
  WHERE s.cp > 0 AND ((NOT s.whole AND (s.stop OR NOT s.broken)) OR (s.whole AND (s.depth = 0 OR p.broken))))"""


def _light(c: Camera, rows: str, exposure: float) -> str:
    """SQL: light per pixel of the stars in rows, as CTEs ending in h."""
    rel = {a: f"({a} - ({e!r}))" for a, e in zip("xyz", c.eye)}
    dot = lambda v: "(" + " + ".join(f"{rel[a]} * ({k!r})" for a, k in zip("xyz", v)) + ")"
    w, h = c.scale
    by = "depth" if c.fov else "1"
    inside = " AND ".join("(" + " + ".join(f"({n!r}) * {a}" for a, n in zip("xyz", p[:3])) + f" + ({p[3]!r})) >= 0" for p in c.planes())

    def ramp(i: int) -> str:
        blue, white, yellow, red = (s[i] for s in RAMP)
        return f"""CASE WHEN bp_rp IS NULL OR NOT isfinite(bp_rp) THEN 1.0 WHEN t < 0.33 THEN {blue} + ({white} - {blue}) * (t - 0.0) / 0.33
    WHEN t < 0.66 THEN {white} + ({yellow} - {white}) * (t - 0.33) / 0.33 ELSE {yellow} + ({red} - {yellow}) * (t - 0.66) / 0.34 END"""

    return f"""j AS (SELECT *, {dot(c.forward)} AS depth FROM (SELECT x, y, z, luminosity, bp_rp FROM {rows}) WHERE {inside}),
q AS (SELECT floor(({dot(c.right)} / ({by} * {w!r}) * 0.5 + 0.5) * {c.width} + 0.5)::BIGINT AS px, floor((1 - ({dot(c.up)} / ({by} * {h!r}) * 0.5 + 0.5)) * {c.height} + 0.5)::BIGINT AS py,
  luminosity / greatest(power({'depth' if c.fov else repr(float(c.half_width))}, 2), 0.01) * {exposure!r} AS light, bp_rp, greatest(0.0, least(1.0, (bp_rp + 0.5) / 3.5)) AS t FROM j WHERE depth > 0),
i AS (SELECT *, least(greatest(light, 0.8), 1.0) AS radius, {ramp(0)} AS cr, {ramp(1)} AS cg, {ramp(2)} AS cb FROM q),
f AS (SELECT px + a.d AS x, py + b.d AS y, light * exp(-4.0 * (a.d * a.d + b.d * b.d) / (radius * radius)) AS v, cr, cg, cb FROM i, (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b),
h AS (SELECT x, y, sum(cr * v) AS r, sum(cg * v) AS g, sum(cb * v) AS b FROM f WHERE x BETWEEN 0 AND {c.width - 1} AND y BETWEEN 0 AND {c.height - 1} GROUP BY ALL)"""


_ROUND = "SELECT x, y, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM h"
_BYTES = "SELECT x, y, " + ", ".join(f"least(255, floor(255 * power({c} / (1 + {c}), 1 / 2.2) + 0.5))::INT AS {c}" for c in "rgb") + " FROM h"
_S = tree.NODES.split(", c AS (")[0]


def _cut_points_sql(c: Camera) -> str:
    """SQL: pts, the points of the cut."""
    return f"""{_viewed(c)}, {tree.SAMPLED_ROWS}, u AS (SELECT dataset, depth, prefix, x, y, z, luminosity * n / budget AS luminosity, bp_rp FROM b
  UNION ALL SELECT dataset, {tree.DEPTH}, leaf, x, y, z, luminosity, bp_rp FROM s), pts AS (SELECT u.* FROM u JOIN cut USING (dataset, depth, prefix))"""


_FAST = f"fast AS (WITH {_light(ABOVE, 'pts', default_exposure(ABOVE))} {_BYTES})"
_EXACT = f"exact AS (WITH {_light(ABOVE, 's', default_exposure(ABOVE))} {_BYTES})"
_TILES = -(-ABOVE.width // R.TILE) * -(-ABOVE.height // R.TILE)
_BOTH = f"""{_cut_points_sql(ABOVE)}, {_FAST}, {_EXACT}, both_ AS (SELECT coalesce(e.x, a.x) AS x, coalesce(e.y, a.y) AS y, {', '.join(f'coalesce(e.{k}, 0) AS e{k}, coalesce(a.{k}, 0) AS a{k}' for k in 'rgb')}
  FROM exact e FULL JOIN fast a ON e.x = a.x AND e.y = a.y),
tiles AS (SELECT x // 64 * 64 AS tx, y // 64 * 64 AS ty, sqrt(sum(power((er - ar) / 255, 2) + power((eg - ag) / 255, 2) + power((eb - ab) / 255, 2))
  / (3 * least(64, {ABOVE.width} - x // 64 * 64) * least(64, {ABOVE.height} - y // 64 * 64))) AS rmse FROM both_ GROUP BY x // 64 * 64, y // 64 * 64)"""

SQL: dict[str, str] = {
    "frustum_leaves": f"WITH {_viewed(INSIDE)} SELECT dataset, prefix, point_count FROM v WHERE depth = {tree.DEPTH} AND seen",
    "lod_cut": f"WITH {_viewed(INSIDE)} SELECT dataset, depth, prefix, point_count FROM cut",
    "wanted_nodes": f"WITH {_WANTED} SELECT dataset, depth, prefix, point_first, point_count, round(footprint, 6) AS priority FROM w",
    "fetch_batches": f"WITH RECURSIVE {_WANTED}, {_batches('w')} SELECT dataset, first, points, nodes, priority FROM batches",
    "fetch_schedule": f"""WITH RECURSIVE {_MISSING}, {_batches('missing')}
SELECT dataset, first, points, nodes, priority, i AS order FROM (SELECT *, (row_number() OVER (PARTITION BY dataset ORDER BY exact DESC, first))::INT AS i FROM batches) WHERE i <= {SLOTS}""".replace("AS order FROM", 'AS "order" FROM'),
    "load_state": f"""WITH RECURSIVE {_MISSING}, {_batches('missing')},
asked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY exact DESC, first) AS i FROM batches) WHERE i <= {SLOTS})
SELECT a.dataset, count(*) FILTER (b.n IS NOT NULL) AS cached, count(*) FILTER (b.n IS NULL AND EXISTS (SELECT 1 FROM asked q WHERE q.dataset = a.dataset AND a.point_first >= q.first AND a.point_first < q.first + q.points)) AS in_flight, count(*) AS total
FROM after_ a LEFT JOIN before_ b USING (dataset, depth, prefix) GROUP BY 1""",
    "chunk_merge": f"WITH {_chunks_sql(INSIDE)} SELECT * FROM chunks_",
    "chunk_updates": f"""WITH a AS (WITH {_chunks_sql(ASIDE)} SELECT * FROM chunks_), b AS (WITH {_chunks_sql(INSIDE)} SELECT * FROM chunks_)
SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.depth, b.depth) AS depth, coalesce(a.prefix, b.prefix) AS prefix, CASE WHEN b.token IS NULL THEN 'drop' ELSE 'send' END AS action, coalesce(b.points, 0) AS points
FROM a FULL JOIN b ON a.dataset = b.dataset AND a.depth = b.depth AND a.prefix = b.prefix WHERE a.token IS DISTINCT FROM b.token""",
    "cut_points": f"WITH {_cut_points_sql(INSIDE)} SELECT dataset, depth, count(*) AS points, round(sum(luminosity), 2) AS light FROM pts GROUP BY ALL",
    "render_fast": f"WITH {_cut_points_sql(ABOVE)}, {_FAST} SELECT * FROM fast",
    "image_compare": f"""WITH {_BOTH}, f AS (SELECT sum(er + eg + eb)::BIGINT AS exact_flux, sum(ar + ag + ab)::BIGINT AS fast_flux, count(*) FILTER (greatest(er, eg, eb) > 127) AS exact_bright,
  count(*) FILTER (greatest(ar, ag, ab) > 127) AS fast_bright, ({_TILES} - (SELECT count(*) FROM tiles WHERE rmse >= 0.05)) / {_TILES} AS passing FROM both_)
SELECT *, fast_flux / greatest(exact_flux, 1) AS flux_ratio, fast_bright / greatest(exact_bright, 1) AS bright_ratio, fast_flux / greatest(exact_flux, 1) BETWEEN 0.9 AND 1.1 AS flux_ok,
  abs(fast_bright / greatest(exact_bright, 1) - 1) <= 0.05 AS bright_ok, passing >= 0.8 AS tiles_ok FROM f""",
    "worst_tiles": f"WITH {_BOTH} SELECT tx, ty, round(rmse, 9) AS rmse FROM tiles ORDER BY tiles.rmse DESC, tx, ty LIMIT 5",
    "image_difference": f"WITH {_BOTH} SELECT * FROM (SELECT x, y, " + ", ".join(f"least(255, 4 * abs(e{k} - a{k})) AS {k}" for k in "rgb") + " FROM both_) WHERE r + g + b > 0",
    "camera_speeds": """WITH v AS (SELECT user_id AS session, event_id AS seq, ts, coalesce(value, 0) * 20 AS ex, coalesce(value, 0) * (coalesce(length(event_type), 0) % 7 - 3) AS ey FROM events),
m AS (SELECT *, sqrt(power(ex - lag(ex) OVER w, 2) + power(ey - lag(ey) OVER w, 2)) AS step, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS us FROM v WINDOW w AS (PARTITION BY session ORDER BY ts, seq))
SELECT seq, session, round(step / us * 1e6, 6) AS speed FROM m WHERE us <> 0""",
    "cache_delta": f"""WITH a AS {_wanted_from(ASIDE)}, b AS {_wanted_from(INSIDE)}
SELECT coalesce(a.dataset, b.dataset) AS dataset, CASE WHEN b.n IS NULL THEN 'fetch' WHEN a.n IS NULL THEN 'evict' ELSE 'keep' END AS action, count(*) AS nodes, sum(coalesce(a.point_count, b.point_count))::BIGINT AS points
FROM a FULL JOIN b ON a.dataset = b.dataset AND a.depth = b.depth AND a.prefix = b.prefix GROUP BY ALL""",
    "render_exact": f"WITH {_S}, {_light(ABOVE, 's', default_exposure(ABOVE))} {_ROUND}",
    "render_inside": f"WITH {_S}, {_light(INSIDE, 's', 1e-3)} {_ROUND}",
    "tonemapped": f"WITH {_S}, {_light(ABOVE, 's', default_exposure(ABOVE))} {_BYTES}",
    "labels_fade": f"""WITH {_S}, n AS (SELECT DISTINCT source_id, input_name FROM canonical_rows),
m AS (SELECT input_name, arg_max([x, y, z], [luminosity, source_id::DOUBLE]) AS p FROM s JOIN n USING (source_id) GROUP BY 1),
f AS (SELECT input_name, round(1 - least(greatest((sqrt(p[1] * p[1] + p[2] * p[2] + p[3] * p[3]) - 1200) / 400, 0.0), 1.0), 6) AS alpha FROM m)
SELECT * FROM f WHERE alpha > 0""",
}
