"""Queries on ingestion: counts, quality, positions, the ingestion log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.common import Scratch, table
from skyfold.functions import astro as A
from skyfold.functions import morton as M
from skyfold.functions.camera import galactic_axes
from skyfold.operators import manifest as L
from skyfold.sources import binary

HALF, DEPTH = A.half_extent(), 7


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Stored rows with their measured fields in double precision."""
    rows = table(spark, sf, "canonical_rows")
    return rows.withColumns({c: A.d(c) for c in ("ra", "dec", "parallax", "parallax_error", "phot_g_mean_mag", "bp_rp")})


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that pass the quality test, with position, light and leaf cell (NULL outside of the cube)."""
    rows = canonical(spark, sf)
    q = A.parallax_quality(F.col("parallax"), F.col("parallax_error"))
    good = rows.withColumn("quality", q).where(F.col("quality") >= A.MIN_QUALITY)
    x, y, z = A.cartesian(F.col("ra"), F.col("dec"), F.col("parallax"))
    good = good.withColumns({"x": x, "y": y, "z": z, "luminosity": A.luminosity(F.col("parallax"), F.col("phot_g_mean_mag"))})
    return M.with_cell(good, "leaf", "x", "y", "z", HALF, DEPTH)


def in_cube() -> Column:
    """Has a leaf. Said of the coordinates, as a filter on the leaf would repeat its bits at the scan."""
    ok = F.lit(True)
    for c in "xyz":
        ok = ok & (F.abs(c) <= HALF)
    return ok


def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = canonical(spark, sf)
    finite_q = A.parallax_quality(F.col("parallax"), F.col("parallax_error"))
    return rows.groupBy("input_name").agg(
        F.count("*").alias("seen"), F.count_if(A.positive_parallax(F.col("parallax"))).alias("positive"), F.count_if(finite_q >= A.MIN_QUALITY).alias("good")
    )


def quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    return positions(spark, sf).groupBy("source_id").agg(F.round(F.max("quality"), 6).alias("quality"))


def quality_hist(spark: SparkSession, sf: str) -> DataFrame:
    rows = canonical(spark, sf)
    q = A.parallax_quality(F.col("parallax"), F.col("parallax_error"))
    return rows.groupBy(F.least(F.floor(q), F.lit(100)).alias("bucket")).agg(F.count("*").alias("n"))


def cartesian(spark: SparkSession, sf: str) -> DataFrame:
    return positions(spark, sf).select("source_id", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in "xyz"]).distinct()


def luminosity(spark: SparkSession, sf: str) -> DataFrame:
    return positions(spark, sf).where("luminosity is not null").groupBy("source_id").agg(F.round(F.max(F.log10("luminosity")), 6).alias("log_luminosity"))


def morton_cells(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf).where(in_cube())
    i = M.deinterleave("leaf", DEPTH)
    return p.select("source_id", "leaf", *[c.alias(n) for c, n in zip(i, ("ix", "iy", "iz"))]).distinct()


def octant_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Stars and light by octant: scan, quality, positions, cells, one aggregation."""
    p = positions(spark, sf).where(in_cube() & F.col("luminosity").isNotNull())
    return p.groupBy(M.prefix_at(F.col("leaf"), DEPTH, 1).alias("octant")).agg(F.count("*").alias("n"), F.round(F.sum("luminosity"), 2).alias("light"))


def build_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counted in this order: quality, cube, light."""
    p = positions(spark, sf)
    lit = F.col("luminosity").isNotNull()
    return p.groupBy("dataset").agg(
        F.count("*").alias("passed"), F.count_if(F.col("leaf").isNull()).alias("out_of_bounds"), F.count_if(F.col("leaf").isNotNull() & lit).alias("in_bounds"),
        F.bit_or(F.when(F.col("leaf").isNotNull() & lit, F.call_function("shiftleft", F.lit(1), M.prefix_at(F.col("leaf"), DEPTH, 1).cast("int")))).alias("octants"),
    )


def galactic_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Stars on a map of 64 by 64 cells seen from the galactic north."""
    p = positions(spark, sf).where(in_cube())
    right, up = galactic_axes()
    gx, gy = (sum(F.col(c) * k for c, k in zip("xyz", axis)) for axis in (right, up))
    col, row = F.floor((gx / HALF + 1) * 0.5 * 64), F.floor((1 - (gy / HALF + 1) * 0.5) * 64)
    return p.groupBy(col.alias("col"), row.alias("row")).agg(F.count("*").alias("n"))


def binary_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored row through the 32-byte format and back; missing values are NaN there."""
    rows = table(spark, sf, "canonical_rows").select(*binary.CANONICAL)
    back = binary.decode_canonical(binary.encode_canonical(rows))
    return back.groupBy("source_id").agg(F.count("*").alias("n"), *[F.max(F.coalesce(F.nanvl(A.d(c), F.lit(None).cast("double")), F.lit(-9.0))).alias(c) for c in binary.CANONICAL[1:]])


def log_entries(spark: SparkSession, sf: str) -> DataFrame:
    return L.latest(table(spark, sf, "sources"))


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """Different stars of each file that are stored, all and with positive parallax."""
    rows = table(spark, sf, "canonical_rows").where("source_id is not null").select("dataset", "input_name", "source_id", A.positive_parallax(F.col("parallax")).alias("ok"))
    stars = rows.groupBy("dataset", "input_name", "source_id").agg(F.max("ok").alias("ok"))
    return stars.groupBy("dataset", "input_name").agg(F.count("*").alias("rows_found"), F.count_if("ok").alias("positive_found"))


def to_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The work of a rerun: files whose entry isn't finished, lacks its checksum or doesn't hold the stars that are stored."""
    holds = log_entries(spark, sf).where("ingestion_finished_at is not null and source_bulk_md5 is not null")
    both = _stored(spark, sf).join(holds.select("dataset", "input_name", "rows_written"), ["dataset", "input_name"], "left")
    return both.where(~F.col("rows_written").eqNullSafe(F.col("positive_found"))).select("dataset", "input_name", F.col("rows_found").alias("rows"))


def checksum_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """URLs that the log knows with several checksums or none."""
    return L.checksums(table(spark, sf, "sources"))


def layout_check(spark: SparkSession, sf: str) -> DataFrame:
    """Stars that are there against the rows that the log says were written."""
    return L.validate(_stored(spark, sf), log_entries(spark, sf), ["dataset", "input_name"])


def shard_assign(spark: SparkSession, sf: str) -> DataFrame:
    return L.shards(log_entries(spark, sf).select("dataset", "input_name"), ["dataset", "input_name"], 7)


def progress(spark: SparkSession, sf: str) -> DataFrame:
    return L.progress(log_entries(spark, sf))


def trusted_files(spark: SparkSession, sf: str) -> DataFrame:
    """The log's URLs as a manifest against its checksums as a checksum list: names, md5, and what doesn't fit."""
    s = log_entries(spark, sf)
    lines = s.select(F.concat(F.coalesce(F.concat("source_bulk_md5", F.lit("\t")), F.lit("")), "source_bulk_url").alias("value"))
    sums = s.where("source_bulk_md5 is not null").select(F.concat("source_bulk_md5", F.lit("  "), "input_name").alias("value"))
    return L.trusted(L.manifest_lines(lines), L.checksum_lines(sums)).select("input_name", "md5", "mismatch", "missing")


def part_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Every file's rows in the 32-byte format, a part a day: rows by the parts' sizes, and whether all parts are whole."""
    rows = table(spark, sf, "canonical_rows").groupBy("input_name", F.to_date("ingested_at").alias("day")).agg((F.count("*") * binary.ROW.itemsize).alias("length"))
    return L.part_rows(rows, binary.ROW.itemsize)


def new_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files first seen after the first third of the days of ingestion."""
    rows = table(spark, sf, "canonical_rows").select(F.col("input_name").alias("name"), F.to_date("ingested_at").alias("day"))
    ends = rows.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    cut = F.broadcast(ends.select(F.date_add("a", F.floor(F.datediff("b", "a") / 3).cast("int")).alias("cut")))  # one row
    return L.new_names(rows.join(cut, F.col("day") <= F.col("cut"), "left_semi"), rows)


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of each file's name and the directory that it belongs in, with the number of its parts."""
    s = log_entries(spark, sf)
    return s.select("dataset", "input_name", L.canonical_directory(F.col("input_name")).alias("directory"), L.input_name(F.col("source_bulk_url")).alias("url_name"), F.size("canonical_parts").alias("parts"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (ingest_counts, quality_filter, quality_hist, cartesian, luminosity, morton_cells, octant_counts, build_stats, galactic_projection, binary_round_trip, to_ingest, checksum_conflicts, layout_check, shard_assign, progress, trusted_files, part_sizes, new_files, file_names)
}

_C = """c AS (SELECT *, CASE WHEN isfinite(parallax) AND isfinite(parallax_error) AND parallax > 0 AND parallax_error > 0
    THEN parallax::DOUBLE / greatest(parallax_error::DOUBLE, 0.01) END AS q FROM canonical_rows)"""
_P = f"""{_C}, g AS (SELECT *, 1000.0 / parallax::DOUBLE AS dist FROM c WHERE q >= 5),
p AS (SELECT *, dist * cos(radians("dec"::DOUBLE)) * cos(radians(ra::DOUBLE)) AS x, dist * cos(radians("dec"::DOUBLE)) * sin(radians(ra::DOUBLE)) AS y, dist * sin(radians("dec"::DOUBLE)) AS z,
  CASE WHEN isfinite(phot_g_mean_mag) THEN power(10.0::DOUBLE, (4.67 - (phot_g_mean_mag::DOUBLE - 5 * log10(dist / 10))) / 2.5) END AS lum0 FROM g),
l AS (SELECT *, CASE WHEN isfinite(lum0) AND lum0 > 0 THEN lum0 END AS luminosity,
  CASE WHEN abs(x) <= 20000 AND abs(y) <= 20000 AND abs(z) <= 20000 THEN true ELSE false END AS inside,
  least(127, floor((x + 20000) / 40000 * 128)::BIGINT) AS ix, least(127, floor((y + 20000) / 40000 * 128)::BIGINT) AS iy, least(127, floor((z + 20000) / 40000 * 128)::BIGINT) AS iz FROM p),
m AS (SELECT *, CASE WHEN inside THEN {' + '.join(f'(((i{a} >> {k}) & 1) << {3 * k + j})' for k in range(7) for j, a in enumerate('xyz'))} END AS leaf FROM l)"""
_R, _U = galactic_axes()
_LOG = """e AS (SELECT *, len(canonical_parts) AS parts FROM sources QUALIFY row_number() OVER (PARTITION BY dataset, input_name
  ORDER BY ingestion_started_at DESC NULLS LAST, source_bulk_url DESC NULLS LAST, source_bulk_md5 DESC NULLS LAST, ingestion_finished_at DESC NULLS LAST, rows_written DESC NULLS LAST) = 1)"""
_STORED = """t AS (SELECT dataset, input_name, count(*) AS rows_found, count(*) FILTER (ok) AS positive_found FROM
  (SELECT dataset, input_name, source_id, bool_or(parallax IS NOT NULL AND NOT (parallax <= 0)) AS ok FROM canonical_rows WHERE source_id IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""

SQL: dict[str, str] = {
    "ingest_counts": f"WITH {_C} SELECT input_name, count(*) AS seen, count(*) FILTER (parallax IS NOT NULL AND NOT (parallax <= 0)) AS positive, count(*) FILTER (q >= 5) AS good FROM c GROUP BY 1",
    "quality_filter": f"WITH {_C} SELECT source_id, round(max(q), 6) AS quality FROM c WHERE q >= 5 GROUP BY 1",
    "quality_hist": f"WITH {_C} SELECT CASE WHEN q IS NULL THEN 100 ELSE least(floor(q), 100)::BIGINT END AS bucket, count(*) AS n FROM c GROUP BY 1",
    "cartesian": f"WITH {_P} SELECT DISTINCT source_id, round(x, 4) + 0.0::DOUBLE AS x, round(y, 4) + 0.0::DOUBLE AS y, round(z, 4) + 0.0::DOUBLE AS z FROM p",
    "luminosity": f"WITH {_P} SELECT source_id, round(max(log10(luminosity)), 6) AS log_luminosity FROM m WHERE luminosity IS NOT NULL GROUP BY 1",
    "morton_cells": f"WITH {_P} SELECT DISTINCT source_id, leaf, ix, iy, iz FROM m WHERE inside",
    "octant_counts": f"WITH {_P} SELECT leaf >> 18 AS octant, count(*) AS n, round(sum(luminosity), 2) AS light FROM m WHERE inside AND luminosity IS NOT NULL GROUP BY 1",
    "build_stats": f"""WITH {_P} SELECT dataset, count(*) AS passed, count(*) FILTER (NOT inside) AS out_of_bounds, count(*) FILTER (inside AND luminosity IS NOT NULL) AS in_bounds,
  bit_or((1 << (leaf >> 18)::INT)::INT) FILTER (inside AND luminosity IS NOT NULL) AS octants FROM m GROUP BY 1""",
    "galactic_projection": f"""WITH {_P} SELECT floor(((x * {_R[0]!r} + y * {_R[1]!r} + z * {_R[2]!r}) / 20000 + 1) * 0.5 * 64)::BIGINT AS col,
  floor((1 - ((x * {_U[0]!r} + y * {_U[1]!r} + z * {_U[2]!r}) / 20000 + 1) * 0.5) * 64)::BIGINT AS row, count(*) AS n FROM m WHERE inside GROUP BY 1, 2""",
    "binary_round_trip": "SELECT source_id, count(*) AS n, "
    + ", ".join(f"max(CASE WHEN {c} IS NULL OR isnan({c}) THEN -9.0 ELSE {c}::DOUBLE END) AS {c.strip(chr(34))}" for c in ("ra", '"dec"', "parallax", "parallax_error", "phot_g_mean_mag", "bp_rp"))
    + " FROM canonical_rows GROUP BY 1",
    "to_ingest": f"""WITH {_LOG}, {_STORED} SELECT t.dataset, t.input_name, rows_found AS rows FROM t LEFT JOIN
  (SELECT * FROM e WHERE ingestion_finished_at IS NOT NULL AND source_bulk_md5 IS NOT NULL) e ON e.dataset = t.dataset AND e.input_name = t.input_name WHERE e.rows_written IS DISTINCT FROM positive_found""",
    "checksum_conflicts": """SELECT source_bulk_url, count(DISTINCT source_bulk_md5) AS checksums FROM sources GROUP BY 1 HAVING count(DISTINCT source_bulk_md5) <> 1""",
    "layout_check": f"""WITH {_LOG}, {_STORED}
SELECT coalesce(t.dataset, e.dataset) AS dataset, coalesce(t.input_name, e.input_name) AS input_name, coalesce(rows_found, 0) AS rows_found, coalesce(positive_found, 0) AS positive_found, coalesce(rows_written, 0) AS rows_written,
  coalesce(positive_found, 0) = coalesce(rows_written, 0) AS valid FROM t FULL JOIN e ON t.dataset = e.dataset AND t.input_name = e.input_name""",
    "shard_assign": f"WITH {_LOG} SELECT dataset, input_name, ((row_number() OVER (ORDER BY dataset, input_name) - 1) % 7)::INT AS shard FROM e",
    "progress": f"""WITH {_LOG}, x AS (SELECT *, ingestion_finished_at IS NOT NULL AS done, ingestion_finished_at IS NOT NULL AND (source_bulk_md5 IS NULL OR coalesce(rows_written < rows_with_positive_parallax, false)) AS failed FROM e)
SELECT dataset, count(*) AS files, count(*) FILTER (done AND NOT failed) AS succeeded, count(*) FILTER (failed) AS failed, count(*) FILTER (NOT done) AS running,
  sum(rows_written)::BIGINT AS rows_written, min(ingestion_started_at) AS first_start, max(ingestion_finished_at) AS last_finish FROM x GROUP BY 1""",
    "trusted_files": f"WITH {_LOG} SELECT input_name, max(source_bulk_md5) OVER (PARTITION BY input_name) AS md5, coalesce(source_bulk_md5 <> max(source_bulk_md5) OVER (PARTITION BY input_name), false) AS mismatch, max(source_bulk_md5) OVER (PARTITION BY input_name) IS NULL AS missing FROM e",
    "part_sizes": "SELECT input_name, count(*) AS rows_found, true AS whole FROM canonical_rows GROUP BY 1",
    "new_files": """WITH d AS (SELECT min(ingested_at::DATE) AS a, max(ingested_at::DATE) AS b FROM canonical_rows), c AS (SELECT a + ((b - a) // 3)::INT AS cut FROM d)
SELECT DISTINCT input_name AS name FROM canonical_rows WHERE input_name IS NOT NULL AND input_name NOT IN (SELECT input_name FROM canonical_rows, c WHERE ingested_at::DATE <= cut AND input_name IS NOT NULL)""",
    "file_names": f"""WITH {_LOG} SELECT dataset, input_name, 'canonical/' || CASE WHEN starts_with(input_name, 'GaiaSource_') AND ends_with(input_name, '.csv.gz') THEN substr(input_name, 12, len(input_name) - 18) ELSE input_name END AS directory,
  trim(list_last(string_split(source_bulk_url, '/'))) AS url_name, parts::INT AS parts FROM e""",
}
