"""Queries on the octree: counts, samples, layout, searches. One tree per data set; a node has as many samples as the data set's reservoir."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.common import table
from skyfold.functions import astro as A
from skyfold.functions import morton as M
from skyfold.functions.hashing import FIRST, SECOND, STEP
from skyfold.operators import octree as T

KEYS, DEPTH, SAMPLE, HALF = ["dataset"], 7, 256, A.half_extent()
CODE_DEPTH = 9
LOW, HIGH, CENTRE, RADIUS = (-300.0, -400.0, -200.0), (350.0, 250.0, 500.0), (100.0, -50.0, 20.0), 400.0


def stars(spark: SparkSession, sf: str) -> DataFrame:
    """Each star once, with light, in its leaf; where no cell is stored, it follows from the position."""
    lit = A.finite(A.d("luminosity")) & (F.col("luminosity") > 0)
    p = table(spark, sf, "points").where(lit).select("dataset", "source_id", *[A.d(c).alias(c) for c in ("x", "y", "z", "luminosity", "bp_rp")], "morton")
    p = M.with_cell(p, "__code", "x", "y", "z", HALF, CODE_DEPTH).withColumn("morton", F.coalesce("morton", "__code")).drop("__code")
    return p.where("morton is not null").distinct().withColumn("leaf", M.prefix_at(F.col("morton"), CODE_DEPTH, DEPTH))


def budget(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of a node, by data set."""
    return table(spark, sf, "reservoirs").groupBy("dataset").agg(F.max("capacity").alias("k"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return T.layout(stars(spark, sf), KEYS, "leaf", DEPTH, budget(spark, sf))


def level_counts(spark: SparkSession, sf: str) -> DataFrame:
    return T.level_counts(stars(spark, sf), KEYS, "leaf", DEPTH)


def child_masks(spark: SparkSession, sf: str) -> DataFrame:
    return T.child_masks(level_counts(spark, sf), KEYS)


def node_layout(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf)


def node_sample(spark: SparkSession, sf: str) -> DataFrame:
    return T.samples(stars(spark, sf), KEYS, "leaf", "source_id", DEPTH, budget(spark, sf)).select("dataset", "depth", "prefix", "source_id", "n")


def root_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sample of the root over all data sets."""
    return T.root_sample(stars(spark, sf), "source_id", SAMPLE).select("dataset", "source_id")


def flux_conservation(spark: SparkSession, sf: str) -> DataFrame:
    """Light of each level's samples, boosted, beside the light of the stars that they stand for."""
    s = stars(spark, sf)
    kept = T.samples(s, KEYS, "leaf", "source_id", DEPTH, budget(spark, sf)).groupBy("dataset", "depth").agg(F.sum(F.col("luminosity") * F.col("boost")).alias("sampled"), F.count("*").alias("samples"))
    light = s.groupBy("dataset", "leaf").agg(F.sum("luminosity").alias("light"), F.count("*").alias("stars")).withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1))))
    cells = light.groupBy("dataset", "depth", F.call_function("shiftright", "leaf", (3 * (DEPTH - F.col("depth"))).cast("int")).alias("prefix")).agg(F.sum("light").alias("light"), F.sum("stars").alias("stars"))
    true = cells.join(budget(spark, sf), "dataset").where("stars > k and k > 0").groupBy("dataset", "depth").agg(F.sum("light").alias("light"))
    return kept.join(true, ["dataset", "depth"]).select("dataset", "depth", "samples", F.round("sampled", 2).alias("sampled"), F.round("light", 2).alias("light"))


def point_table(spark: SparkSession, sf: str) -> DataFrame:
    """Points stored per level: all stars in leaves, boosted samples above."""
    p = T.all_points(stars(spark, sf), KEYS, "leaf", "source_id", DEPTH, budget(spark, sf))
    return p.groupBy("dataset", "depth").agg(F.count("*").alias("points"), F.countDistinct("prefix").alias("nodes"), F.round(F.sum("luminosity"), 2).alias("light"))


def point_places(spark: SparkSession, sf: str) -> DataFrame:
    """The places of each node's points in the point table: the node table's ranges, made from the points themselves."""
    p = T.with_places(T.all_points(stars(spark, sf), KEYS, "leaf", "source_id", DEPTH, budget(spark, sf)), KEYS, DEPTH, "source_id")
    return p.groupBy("dataset", "depth", "prefix").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("points"))


def subtree_counts(spark: SparkSession, sf: str) -> DataFrame:
    return T.subtree_counts(nodes(spark, sf), KEYS)


def box_query(spark: SparkSession, sf: str) -> DataFrame:
    return T.box_query(table(spark, sf, "points"), "morton", CODE_DEPTH, HALF, LOW, HIGH).select("dataset", "source_id").distinct()


def box_cells(spark: SparkSession, sf: str) -> DataFrame:
    leaves = T.leaf_counts(stars(spark, sf), KEYS, "leaf")
    return T.cells_in_box(leaves, HALF, DEPTH, LOW, HIGH)


def radius_query(spark: SparkSession, sf: str) -> DataFrame:
    found = T.radius_query(table(spark, sf, "points"), "morton", CODE_DEPTH, HALF, CENTRE, RADIUS)
    return found.select("dataset", "source_id", F.round("distance", 6).alias("distance")).distinct()


def sphere_cells(spark: SparkSession, sf: str) -> DataFrame:
    return T.cells_meeting_sphere(level_counts(spark, sf), HALF, CENTRE, RADIUS)


def stored_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The stored node table against the tree that its leaves imply: masks and links that don't hold."""
    n = table(spark, sf, "nodes").distinct()
    kids = n.where("depth > 0").groupBy("dataset", (F.col("depth") - 1).alias("depth"), F.shiftright("prefix", 3).alias("prefix")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("prefix").bitwiseAND(F.lit(7).cast("long")).cast("int"))).alias("mask"), F.min("node").alias("first"))
    both = n.where("depth < 9").join(kids, ["dataset", "depth", "prefix"], "left")
    return both.where(~F.col("mask").eqNullSafe(F.col("child_mask")) | ~F.col("first").eqNullSafe(F.col("first_child"))).select("dataset", "node", "depth", "prefix")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (level_counts, child_masks, node_layout, node_sample, root_sample, flux_conservation, point_table, point_places, subtree_counts, box_query, box_cells, radius_query, sphere_cells, stored_nodes)
}

_CELL_OF = " + ".join(f"(((j{a} >> {k}) & 1) << {3 * k + i})" for k in range(CODE_DEPTH) for i, a in enumerate("xyz"))
_STARS = f"""coded AS (SELECT *, {", ".join(f"CASE WHEN abs({a}::DOUBLE) <= {HALF} THEN least({(1 << CODE_DEPTH) - 1}, floor(({a}::DOUBLE + {HALF}) / {2 * HALF} * {1 << CODE_DEPTH}))::BIGINT END AS j{a}" for a in "xyz")}
  FROM points WHERE isfinite(luminosity) AND luminosity > 0),
s AS (SELECT *, morton >> {3 * (CODE_DEPTH - DEPTH)} AS leaf FROM (SELECT DISTINCT dataset, source_id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, luminosity::DOUBLE AS luminosity, bp_rp::DOUBLE AS bp_rp,
  coalesce(morton, {_CELL_OF}) AS morton FROM coded) WHERE morton IS NOT NULL)"""
COUNTS = f"""{_STARS}, cap AS (SELECT dataset, max(capacity)::BIGINT AS budget FROM reservoirs GROUP BY 1),
c AS (SELECT c0.*, coalesce(budget, 0) AS budget FROM (SELECT dataset, d::INT AS depth, leaf >> (3 * ({DEPTH} - d))::INT AS prefix, count(*) AS n, sum(luminosity) AS light FROM s, range({DEPTH + 1}) r(d) GROUP BY ALL) c0
  LEFT JOIN cap USING (dataset))"""
_MASKS = "k AS (SELECT dataset, depth - 1 AS depth, prefix >> 3 AS prefix, bit_or((1 << (prefix & 7)::INT)::INT) AS child_mask FROM c WHERE depth > 0 GROUP BY ALL)"
NODES = f"""{COUNTS}, {_MASKS},
n0 AS (SELECT c.dataset, c.depth, c.prefix, n, coalesce(child_mask, 0) AS child_mask, CASE WHEN c.depth = {DEPTH} THEN n WHEN n > budget THEN budget ELSE 0 END AS point_count,
  c.prefix << (3 * ({DEPTH} - c.depth)) AS pre, (c.prefix >> 3) << (3 * ({DEPTH} - c.depth + 1)) AS up FROM c LEFT JOIN k USING (dataset, depth, prefix)),
n1 AS (SELECT *, coalesce(sum(point_count) OVER (PARTITION BY dataset ORDER BY pre, depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS point_first,
  row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN depth = 0 THEN -1 ELSE up END, depth, prefix) - 1 AS node FROM n0),
t AS (SELECT a.dataset, a.node, a.depth, a.prefix, a.n, a.child_mask, coalesce((SELECT min(b.node) FROM n1 b WHERE b.dataset = a.dataset AND b.depth = a.depth + 1 AND b.prefix >> 3 = a.prefix), 0) AS first_child,
  a.point_first, a.point_count FROM n1 a)"""


def mixed(rows: str, x: str, name: str) -> str:
    """SQL: rows with the splitmix64 of column x as name."""
    p = "18446744073709551616::UHUGEINT"
    a = f"SELECT *, ((({x})::UHUGEINT + {STEP}::UHUGEINT) % {p})::UBIGINT AS m1 FROM {rows}"
    b = f"SELECT *, ((xor(m1, m1 >> 30)::UHUGEINT * {FIRST}::UHUGEINT) % {p})::UBIGINT AS m2 FROM ({a})"
    c = f"SELECT *, ((xor(m2, m2 >> 27)::UHUGEINT * {SECOND}::UHUGEINT) % {p})::UBIGINT AS m3 FROM ({b})"
    return f"(SELECT * EXCLUDE (m1, m2, m3), xor(m3, m3 >> 31) AS {name} FROM ({c}))"


_SEEDED = mixed(f"(SELECT * FROM c WHERE n > budget AND budget > 0 AND depth < {DEPTH})", "xor(prefix::UBIGINT, depth::UBIGINT << 56)", "seed")
_HASHED = mixed(f"(SELECT s.*, g.depth, g.prefix, g.n, g.budget, g.seed FROM s JOIN {_SEEDED} g ON s.dataset = g.dataset AND s.leaf >> (3 * ({DEPTH} - g.depth))::INT = g.prefix)", "xor(source_id::UBIGINT, seed)", "h")
SAMPLED_ROWS = f"b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, depth, prefix ORDER BY h, source_id) AS r FROM {_HASHED}) WHERE r <= budget)"
_SAMPLED = f"{COUNTS}, {SAMPLED_ROWS}"
_ROOT = mixed("(SELECT * FROM s, " + mixed("(SELECT 0 AS zero)", "zero", "seed") + " z)", "xor(source_id::UBIGINT, seed)", "h")
_BOX = " AND ".join(f"{a}::DOUBLE BETWEEN {lo} AND {hi}" for a, lo, hi in zip("xyz", LOW, HIGH))
_DIST = "sqrt(" + " + ".join(f"power({a}::DOUBLE - {c}, 2)" for a, c in zip("xyz", CENTRE)) + ")"
CELL = {a: " + ".join(f"(((prefix >> {3 * k + j}) & 1) << {k})" for k in range(DEPTH)) for j, a in enumerate("xyz")}
BOXES = ", ".join(f"-{HALF} + ({CELL[a]}) * {2 * HALF} / power(2, depth) AS {a}0, -{HALF} + (({CELL[a]}) + 1) * {2 * HALF} / power(2, depth) AS {a}1" for a in "xyz")
_GAPS = " + ".join(f"power(greatest({a}0 - {c}, {c} - {a}1, 0), 2)" for a, c in zip("xyz", CENTRE))

SQL: dict[str, str] = {
    "level_counts": f"WITH {COUNTS} SELECT dataset, depth, prefix, n FROM c",
    "child_masks": f"WITH {COUNTS}, {_MASKS} SELECT * FROM k",
    "node_layout": f"WITH {NODES} SELECT * FROM t",
    "node_sample": f"WITH {_SAMPLED} SELECT dataset, depth, prefix, source_id, n FROM b",
    "root_sample": f"WITH {_STARS} SELECT dataset, source_id FROM {_ROOT} ORDER BY h, source_id LIMIT {SAMPLE}",
    "flux_conservation": f"""WITH {_SAMPLED}, l AS (SELECT dataset, depth, sum(light) AS light FROM c WHERE n > budget AND budget > 0 GROUP BY ALL)
SELECT dataset, depth, count(*) AS samples, round(sum(luminosity * n / budget), 2) AS sampled, round(max(l.light), 2) AS light FROM b JOIN l USING (dataset, depth) GROUP BY ALL""",
    "point_table": f"""WITH {_SAMPLED}, u AS (SELECT dataset, depth, prefix, luminosity * n / budget AS l FROM b UNION ALL SELECT dataset, {DEPTH}, leaf, luminosity FROM s)
SELECT dataset, depth, count(*) AS points, count(DISTINCT prefix) AS nodes, round(sum(l), 2) AS light FROM u GROUP BY ALL""",
    "point_places": f"WITH {NODES} SELECT dataset, depth, prefix, point_first AS first, point_first + point_count - 1 AS last, point_count AS points FROM t WHERE point_count > 0",
    "subtree_counts": f"WITH {NODES} SELECT dataset, d::INT AS depth, prefix >> (3 * (depth - d))::INT AS prefix, sum(point_count)::BIGINT AS subtree_points FROM t, range({DEPTH + 1}) r(d) WHERE d <= depth GROUP BY ALL",
    "box_query": f"SELECT DISTINCT dataset, source_id FROM points WHERE {_BOX}",
    "box_cells": f"WITH {COUNTS}, x AS (SELECT *, {BOXES} FROM c WHERE depth = {DEPTH}) SELECT dataset, prefix, n FROM x WHERE {' AND '.join(f'{a}1 >= {lo} AND {a}0 <= {hi}' for a, lo, hi in zip('xyz', LOW, HIGH))}",
    "radius_query": f"SELECT DISTINCT dataset, source_id, round({_DIST}, 6) AS distance FROM points WHERE {_DIST} <= {RADIUS}",
    "sphere_cells": f"WITH {COUNTS}, x AS (SELECT *, {BOXES} FROM c) SELECT dataset, depth, prefix, n FROM x WHERE {_GAPS} <= {RADIUS * RADIUS}",
    "stored_nodes": """WITH n AS (SELECT DISTINCT * FROM nodes), k AS (SELECT dataset, depth - 1 AS depth, prefix >> 3 AS prefix, bit_or((1 << (prefix & 7)::INT)::INT) AS mask, min(node) AS first FROM n WHERE depth > 0 GROUP BY ALL)
SELECT n.dataset, node, n.depth, n.prefix FROM n LEFT JOIN k USING (dataset, depth, prefix) WHERE n.depth < 9 AND (mask IS DISTINCT FROM child_mask OR first IS DISTINCT FROM first_child)""",
}
