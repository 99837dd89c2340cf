"""Named places: one JSON object of name to [x, y, z]."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.sources.listing import read_optional


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, x, y, z); a missing file has none, and places without three numbers are left out."""
    text = read_optional(lambda: spark.read.text(path, wholetext=True), "value string")
    rows = text.select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("name", "at")).where(F.size("at") == 3)
    return rows.select("name", *[F.col("at")[i].alias(a) for i, a in enumerate("xyz")])


def faded(labels: DataFrame, eye: tuple[float, float, float], near: float, far: float) -> DataFrame:
    """Labels with alpha: 1 up to near, 0 from far on; those at 0 are left out."""
    dist = F.sqrt(sum((F.col(a) - e) * (F.col(a) - e) for a, e in zip("xyz", eye)))
    alpha = 1 - F.least(F.greatest((dist - near) / (far - near), F.lit(0.0)), F.lit(1.0))
    return labels.withColumn("alpha", alpha).where("alpha > 0")
