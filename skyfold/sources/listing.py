"""What a data root holds: files, data sets, byte ranges, bucket listings."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import reduce
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALID_NAME = r"^[A-Za-z0-9_-]+$"


def list_files(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """Rows (path, length) of all files below root whose name ends so, with paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    where = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    relative = F.expr(f"substring_index(path, '{where}', -1)")
    return files.select(relative.alias("path"), "length").where(F.endswith("path", F.lit(suffix)))


def dataset_names(spark: SparkSession, root: str, file: str) -> DataFrame:
    """Names of the directories that hold `file`, valid ones only, in order; the first is the default."""
    parts = F.split("path", "/")
    found = list_files(spark, root, file).where((F.size(parts) == 2) & (parts[1] == file))
    return found.select(parts[0].alias("name")).where(valid_name(F.col("name"))).distinct().orderBy("name")


def valid_name(name: Column) -> Column:
    return name.rlike(VALID_NAME)


def name_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Names, one a line; blank lines are dropped."""
    return lines.select(F.trim(text).alias("name")).where(F.length("name") > 0)


def read_range(path: str, first: int, last: int) -> bytes:
    """Bytes first to last, both included, as a ranged request has them; the end is cut at the file's. Nothing else is read."""
    if first < 0 or last < first:
        raise ValueError(f"no range: {first}-{last}")
    with open(path, "rb") as f:
        f.seek(first)
        return f.read(last - first + 1)


def bucket_listing(pages: DataFrame, text: str = "value", suffix: str = ".csv.gz") -> DataFrame:
    """Keys of all pages of an XML bucket listing that end so."""
    keys = F.transform(F.expr(f"xpath({text}, '//*[local-name()=\"Key\"]/text()')"), lambda k: F.trim(k))
    return pages.select(F.explode(keys).alias("key")).where(F.endswith("key", F.lit(suffix))).distinct()


def next_markers(pages: DataFrame, text: str = "value") -> DataFrame:
    """Of pages that say that the listing goes on, the marker of the next: the one that they name, or else their last key."""
    get = lambda tag: F.trim(F.expr(f"xpath_string({text}, '//*[local-name()=\"{tag}\"]/text()')"))
    last = F.element_at(F.expr(f"xpath({text}, '//*[local-name()=\"Key\"]/text()')"), -1)
    named = F.nullif(get("NextMarker"), F.lit(""))
    return pages.where(F.lower(get("IsTruncated")) == "true").select(F.coalesce(named, F.trim(last)).alias("marker"))


def listing_pages(spark: SparkSession, fetch: Callable[[str | None], str]) -> DataFrame:
    """All pages (value) of a listing: fetch(marker) gives a page's text, first without a marker, until one says that it is the last.

    Pages come one after the other, as each names the next, and hold a thousand keys; a marker that repeats raises ValueError.
    """
    pages, marker, seen = [], None, set()
    while True:
        page = spark.createDataFrame([(fetch(marker),)], "value string")
        pages.append(page)
        following = next_markers(page).first()
        if following is None or following.marker is None:
            return reduce(DataFrame.unionByName, pages)
        marker = following.marker
        if marker in seen:
            raise ValueError(f"the listing repeats marker {marker}")
        seen.add(marker)


def read_optional(read: Callable[[], DataFrame], schema: str) -> DataFrame:
    """What read() gives, or no rows of schema where its path is missing."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return SparkSession.getActiveSession().createDataFrame([], schema)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A job's state documents, one JSON object a file; none where the path is missing."""
    return read_optional(lambda: spark.read.schema(schema).json(path, multiLine=True), schema)


def run_name(seconds: float | None = None) -> str:
    return md5(str(int(time.time() if seconds is None else seconds)).encode()).hexdigest()[:7]


def object_prefix(path: Column, mount: str) -> Column:
    """The path below the mount; NULL for any other."""
    return F.when(F.startswith(path, F.lit(mount)), F.substring(path, len(mount) + 1, 1 << 30))


def settings(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines key=value to (key, value); others are dropped."""
    parts = F.split(text, "=", 2)
    return lines.where(F.contains(F.col(text), F.lit("="))).select(F.trim(parts[0]).alias("key"), parts[1].alias("value"))
