"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.common import Scratch, table
from skyfold.llm.leaks import find_leaks
from skyfold.llm.packing import pack
from skyfold.llm.percentiles import combine, percentiles, summarize
from skyfold.llm.permanent_numbers import NumberStore
from skyfold.llm.reservoir import reservoir_sample
from skyfold.llm.splitting import split_texts
from skyfold.llm.top_items import top_items

SHARES = (0.25, 0.5, 0.75, 0.9, 0.99)
#: The share of the stars that the stable sample takes.
STABLE_RATE = 0.05
#: Tokens in a container, and of a piece and its overlap.
CONTAINER, PIECE, OVERLAP = 2048, 512, 64


def _measures() -> dict[str, F.Column]:
    g, e = F.col("phot_g_mean_mag"), F.col("parallax_error")
    return {"phot_g_mean_mag": F.when(g.between(0, 25), g), "parallax_error": F.when((e > 0) & (e < float("inf")), e)}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "canonical_rows").select("input_name", "phot_g_mean_mag", "parallax_error")
    found = percentiles(rows, ["input_name"], _measures(), {"phot_g_mean_mag": [0.5], "parallax_error": [0.9]})
    bound = F.when(F.col("field") == "phot_g_mean_mag", 19.0).otherwise(0.6)
    return found.where(F.col("value") > bound).select("input_name").distinct()


def p1_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "canonical_rows").select("input_name", "phot_g_mean_mag", "parallax_error")
    found = percentiles(rows, ["input_name"], _measures(), {f: SHARES for f in _measures()})
    return found.select("input_name", "field", "p", "value", "n")


def p1_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of the whole from summaries made per day, of 50 values each; off by two percent of rank at most."""
    rows = table(spark, sf, "canonical_rows").select("input_name", F.to_date("ingested_at").alias("day"), "phot_g_mean_mag", "parallax_error")
    days = summarize(rows, ["input_name"], ["day"], _measures(), 50)
    return combine(days, ["input_name"], SHARES).select("input_name", "field", "p", "value", "n")


def _leaf_stars(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "points").select("dataset", "morton", "luminosity", "source_id")
    return points.where(F.col("morton").isNotNull() & ~F.isnan("luminosity") & (F.abs("luminosity") < float("inf")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    best = top_items(_leaf_stars(spark, sf), ["dataset", "morton"], "luminosity", "source_id", 6)
    # A sixth star tells the cells that have more than five.
    more = best.groupBy("dataset", "morton").agg(F.max("rank").alias("most"), F.collect_list(F.when(F.col("rank") <= 5, F.col("source_id"))).alias("ids"))
    return more.where("most = 6").select("dataset", "morton", F.explode("ids").alias("source_id"))


def p4_top(spark: SparkSession, sf: str) -> DataFrame:
    return top_items(_leaf_stars(spark, sf), ["dataset", "morton"], "luminosity", "source_id", 5)


def p5_sample(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "points").select("dataset", "source_id")
    return reservoir_sample(points, table(spark, sf, "reservoirs"), ["dataset"], distinct_by="source_id")


def p5_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return p5_sample(spark, sf).groupBy("dataset").agg(F.countDistinct("source_id").alias("stars"), F.max("population").alias("population"))


def p7_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Stars arrive in two loads, the batches before the last one and then that; the second numbers only what is new."""
    points = table(spark, sf, "points").select("dataset", "source_id", "batch")
    seeds = table(spark, sf, "reservoirs")
    last = points.agg(F.max("batch")).first()[0]
    store = NumberStore(spark, Scratch(spark).root, ["dataset"], "source_id")
    if last is not None:
        store.insert(points.where(F.col("batch") < last), seeds, "batch")
    store.insert(points.where(F.col("batch").isNull() | (F.col("batch") >= F.lit(last))), seeds, "batch")
    thresholds = seeds.select("dataset").distinct().withColumn("threshold", F.lit(STABLE_RATE))
    return store.sample(thresholds).select("dataset", "source_id", "u")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' texts, spread over all cores where their files give fewer partitions, as reading texts is what takes long."""
    texts = table(spark, sf, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return texts.repartition(cores, "doc_id") if texts.rdd.getNumPartitions() < cores else texts


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_texts(spark, sf), "doc_id", "text", CONTAINER)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are."""
    per = p8_pack(spark, sf).groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return per.agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * CONTAINER)).alias("fill"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """A window without any edit is a run of twelve words of the item."""
    return p9_leaks(spark, sf).where("edits = 0").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(_texts(spark, sf), table(spark, sf, "benchmark"), "doc_id", "item_id")


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_texts(_texts(spark, sf), "doc_id", "text", PIECE, OVERLAP)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_percentiles, p1_combined, p4_found, p4_top, p5_sample, p5_sizes, p7_sample, p8_pack, p8_fill, p9_found, p9_leaks, p10_pieces)
}

_MEASURES = """SELECT input_name, 'phot_g_mean_mag' AS field, phot_g_mean_mag::DOUBLE AS v FROM canonical_rows WHERE phot_g_mean_mag BETWEEN 0 AND 25
  UNION ALL SELECT input_name, 'parallax_error', parallax_error::DOUBLE FROM canonical_rows WHERE parallax_error > 0 AND isfinite(parallax_error)"""
_LEAF_STARS = """SELECT dataset, morton, source_id, max(luminosity) AS luminosity FROM points
  WHERE morton IS NOT NULL AND isfinite(luminosity) AND source_id IS NOT NULL GROUP BY ALL"""

SQL: dict[str, str] = {
    "p1_found": f"""WITH m AS ({_MEASURES})
SELECT input_name FROM m GROUP BY input_name
HAVING quantile_disc(v, 0.5) FILTER (field = 'phot_g_mean_mag') > 19.0 OR quantile_disc(v, 0.9) FILTER (field = 'parallax_error') > 0.6""",
    "p1_percentiles": f"""WITH m AS ({_MEASURES}), q AS (
  SELECT input_name, field, count(*) AS n, quantile_disc(v, {list(SHARES)}) AS vs FROM m GROUP BY ALL)
SELECT input_name, field, unnest({list(SHARES)}::DOUBLE[]) AS p, unnest(vs) AS value, n FROM q""",
    # The value at each fiftieth of a file's day, with the rows since the one before; then nearest ranks by running weight.
    "p1_combined": f"""WITH m AS (SELECT * FROM (SELECT input_name, ingested_at::DATE AS day, 'phot_g_mean_mag' AS field, phot_g_mean_mag::DOUBLE AS v FROM canonical_rows WHERE phot_g_mean_mag BETWEEN 0 AND 25)
  UNION ALL SELECT input_name, ingested_at::DATE, 'parallax_error', parallax_error::DOUBLE FROM canonical_rows WHERE parallax_error > 0 AND isfinite(parallax_error)),
o AS (SELECT *, row_number() OVER (PARTITION BY input_name, day, field ORDER BY v) AS k, count(*) OVER (PARTITION BY input_name, day, field) AS c FROM m),
t AS (SELECT DISTINCT input_name, day, field, greatest(1, (c - floor(c - (i / 50.0::DOUBLE) * c))::BIGINT) AS k FROM (SELECT DISTINCT input_name, day, field, c FROM o), range(1, 51) r(i)),
w AS (SELECT o.input_name, o.field, o.v, o.k - coalesce(lag(o.k) OVER (PARTITION BY o.input_name, o.day, o.field ORDER BY o.k), 0) AS w
  FROM o JOIN t ON t.input_name IS NOT DISTINCT FROM o.input_name AND t.day IS NOT DISTINCT FROM o.day AND t.field = o.field AND t.k = o.k),
u AS (SELECT *, (sum(w) OVER (PARTITION BY input_name, field ORDER BY v))::BIGINT AS upto, (sum(w) OVER (PARTITION BY input_name, field))::BIGINT AS n FROM w)
SELECT input_name, field, p, min(v) AS value, n FROM u, (SELECT unnest({list(SHARES)}::DOUBLE[]) AS p) s
WHERE upto >= greatest(1, (n - floor(n - p * n))::BIGINT) GROUP BY input_name, field, p, n""",
    "p4_found": f"""WITH s AS ({_LEAF_STARS}), r AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY dataset, morton) AS n FROM s WINDOW w AS (PARTITION BY dataset, morton ORDER BY luminosity DESC, source_id))
SELECT dataset, morton, source_id FROM r WHERE n > 5 AND k <= 5""",
    "p4_top": f"""WITH s AS ({_LEAF_STARS}), r AS (
  SELECT *, (row_number() OVER (PARTITION BY dataset, morton ORDER BY luminosity DESC, source_id))::INT AS rank FROM s)
SELECT dataset, morton, source_id, luminosity, rank FROM r WHERE rank <= 5""",
    "p5_sizes": """SELECT p.dataset, least(max(r.capacity), count(DISTINCT source_id))::BIGINT AS stars, count(DISTINCT source_id) AS population
FROM points p JOIN reservoirs r USING (dataset) GROUP BY p.dataset""",
    "p7_sample": f"""WITH s AS (SELECT DISTINCT dataset, source_id FROM points WHERE source_id IS NOT NULL),
u AS (SELECT s.*, ('0x' || substr(md5(coalesce(r.seed, 0) || ':' || s.dataset || ':' || s.source_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM s JOIN reservoirs r ON s.dataset = r.dataset)
SELECT dataset, source_id, u FROM u WHERE u < {STABLE_RATE}""",
}
