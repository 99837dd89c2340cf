"""Queries of the numbered problems that belong to the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.common import table
from skyfold.operators.regions import near_on_sky, near_pairs, points_in_regions
from skyfold.operators.skew import count_beside
from skyfold.sources.csv_lines import parse_lines


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return parse_lines(table(spark, sf, "raw_lines")).where("reason is not null").select("line_id", "reason")


def p2_rows(spark: SparkSession, sf: str) -> DataFrame:
    return parse_lines(table(spark, sf, "raw_lines")).drop("input_name")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    space = near_pairs(table(spark, sf, "points"), ["dataset"], "source_id", "x", "y", "z", 0.1)
    sky = near_on_sky(table(spark, sf, "canonical_rows"), ["dataset"], "source_id", "ra", "dec", 2.0)
    pair = ["source_id_a", "source_id_b"]
    return space.select(F.lit("position").alias("space"), *pair).unionByName(sky.select(F.lit("sky").alias("space"), *pair)).distinct()


def p3_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The stars within a diamond of a degree around the first star of each file."""
    stars = table(spark, sf, "canonical_rows").select("input_name", "source_id", "ra", "dec")
    first = stars.groupBy("input_name").agg(F.min(F.struct("source_id", F.pmod(F.col("ra").cast("double"), F.lit(360.0)).alias("ra"), F.col("dec").cast("double").alias("dec"))).alias("s"))
    corners = F.array(*[F.struct(F.lit(i).alias("seq"), (F.col("s.ra") + dx).alias("vx"), (F.col("s.dec") + dy).alias("vy")) for i, (dx, dy) in enumerate([(1, 0), (0, 1), (-1, 0), (0, -1)])])
    diamonds = first.select("input_name", F.inline(corners))
    return points_in_regions(stars.select("source_id", "ra", "dec"), diamonds, "source_id", "ra", "dec", "input_name", "seq", "vx", "vy", 0.5, 1.0, 360.0)


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    leaves = table(spark, sf, "nodes").where("depth = 9").distinct().select(F.col("prefix").alias("morton"), "point_count")
    return count_beside(table(spark, sf, "points"), leaves, "morton", "source_id", "point_count", n="stars")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).where("stars <> point_count").select("morton")


def p6_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_rows, p3_found, p3_regions, p6_found, p6_cells)}

_F = r'(?:"(?:[^"]|"")*"|[^",]*)'
_N = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN]"
_WANTED = ("ra", "dec", "parallax", "parallax_error", "phot_g_mean_mag", "bp_rp")
_MAYBE = ("parallax", "phot_g_mean_mag", "bp_rp")
_PICK = "trim(CASE WHEN starts_with(fs[list_position(hs, '{0}')], '\"') THEN replace(substr(fs[list_position(hs, '{0}')], 2, len(fs[list_position(hs, '{0}')]) - 2), '\"\"', '\"') ELSE fs[list_position(hs, '{0}')] END) AS {0}"
_PARSED = f"""WITH whole AS (SELECT * FROM raw_lines WHERE NOT starts_with(line, '#') AND trim(line) <> ''),
h AS (SELECT input_name, min(line_no) AS first, min_by(line, line_no) AS header FROM whole GROUP BY 1),
d AS (SELECT line_id, line, string_split(header, ',') AS hs, regexp_full_match(line, '{_F}(?:,{_F})*') AS quoted,
  regexp_extract_all(',' || line, ',({_F})', 1) AS fs FROM whole JOIN h USING (input_name) WHERE line_no > first),
v AS (SELECT line_id, quoted, len(fs) = len(hs) AS counted, {', '.join(_PICK.format(c) for c in ('source_id', *_WANTED))} FROM d),
r AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT counted THEN 'column_count'
  WHEN NOT regexp_full_match(source_id, '[0-9]+') OR try_cast(source_id AS BIGINT) IS NULL
  OR {' OR '.join(f"NOT (regexp_full_match({c}, '{_N}')" + (f" OR {c} IN ('', 'null')" if c in _MAYBE else '') + ')' for c in _WANTED)} THEN 'invalid_value' END AS reason FROM v)"""
_CHORD = "2 * degrees(asin(least(1, sqrt(power(a.ux - b.ux, 2) + power(a.uy - b.uy, 2) + power(a.uz - b.uz, 2)) / 2))) * 3600 <= 2"
_COUNTS = """WITH p AS (SELECT morton, count(DISTINCT source_id) AS stars FROM points WHERE morton IS NOT NULL GROUP BY 1),
n AS (SELECT prefix AS morton, sum(point_count)::BIGINT AS c FROM (SELECT DISTINCT * FROM nodes WHERE depth = 9) GROUP BY 1),
c AS (SELECT coalesce(p.morton, n.morton) AS morton, coalesce(stars, 0) AS stars, coalesce(c, 0) AS point_count FROM p FULL JOIN n ON p.morton = n.morton)"""

SQL: dict[str, str] = {
    "p2_found": f"{_PARSED}\nSELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p2_rows": f"{_PARSED}\nSELECT line_id, CASE WHEN reason IS NULL THEN source_id::BIGINT END AS source_id, "
    + ", ".join(f"CASE WHEN reason IS NULL THEN try_cast({c} AS DOUBLE) END AS {c}" for c in _WANTED) + ", reason FROM r",
    # SQL finds candidates over a grid with its eight or 26 neighbours.
    "p3_found": f"""WITH p AS (SELECT DISTINCT dataset, source_id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, floor(x)::BIGINT AS i, floor(y)::BIGINT AS j, floor(z)::BIGINT AS k FROM points),
s AS (SELECT DISTINCT dataset, source_id, cos(radians("dec"::DOUBLE)) * cos(radians(ra::DOUBLE)) AS ux, cos(radians("dec"::DOUBLE)) * sin(radians(ra::DOUBLE)) AS uy, sin(radians("dec"::DOUBLE)) AS uz FROM canonical_rows),
g AS (SELECT *, floor(ux * 1e4)::BIGINT AS i, floor(uy * 1e4)::BIGINT AS j, floor(uz * 1e4)::BIGINT AS k FROM s),
o AS (SELECT a.range - 1 AS di, b.range - 1 AS dj, c.range - 1 AS dk FROM range(3) a, range(3) b, range(3) c)
SELECT DISTINCT 'position' AS space, a.source_id AS source_id_a, b.source_id AS source_id_b FROM (SELECT * FROM p, o) a
  JOIN p b ON a.dataset = b.dataset AND a.i + di = b.i AND a.j + dj = b.j AND a.k + dk = b.k
  WHERE a.source_id < b.source_id AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) <= 0.1
UNION ALL SELECT DISTINCT 'sky', a.source_id, b.source_id FROM (SELECT * FROM g, o) a
  JOIN g b ON a.dataset = b.dataset AND a.i + di = b.i AND a.j + dj = b.j AND a.k + dk = b.k
  WHERE a.source_id < b.source_id AND {_CHORD}""",
    "p3_regions": """WITH s AS (SELECT DISTINCT source_id, input_name, ra::DOUBLE - 360 * floor(ra::DOUBLE / 360) AS ra, "dec"::DOUBLE AS d FROM canonical_rows),
f AS (SELECT input_name, min_by(ra, source_id) AS cra, min_by(d, source_id) AS cd FROM s GROUP BY 1)
SELECT DISTINCT s.source_id, f.input_name FROM s JOIN f ON s.d BETWEEN f.cd - 1 AND f.cd + 1
WHERE least(abs(s.ra - f.cra), 360 - abs(s.ra - f.cra)) + abs(s.d - f.cd) <= 1""",
    "p6_found": f"{_COUNTS}\nSELECT morton FROM c WHERE stars <> point_count",
    "p6_cells": f"{_COUNTS}\nSELECT morton, stars, point_count FROM c",
}
