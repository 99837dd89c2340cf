"""Catalogue files (CSV, plain or gzip, with comment lines) as rows and rejects."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.common import Scratch
from skyfold.sources.csv_lines import STAR_COLUMNS, parse_lines


def read_catalogue(spark: SparkSession, path: str, columns: dict[str, str] = STAR_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of all files under path: input_name and the wanted columns by header name; input_name, line, reason.

    The files are read and parsed once, into a written table that both results come from.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    order = F.monotonically_increasing_id()
    # Only the first block of a file holds its header; later blocks come after it whichever task reads them.
    number = order + F.when(F.col("_metadata.file_block_start") > 0, F.lit(1 << 62)).otherwise(F.lit(0)).cast("long")
    lines = text.select(order.alias("line_id"), F.col("_metadata.file_name").alias("input_name"), number.alias("line_no"), F.col("value").alias("line"))
    scratch = Scratch(spark)
    lines = scratch.write(lines, "lines")
    parsed = scratch.write(parse_lines(lines, columns=columns), "parsed")
    rejects = parsed.where("reason is not null").select("line_id", "input_name", "reason").join(lines.select("line_id", "line"), "line_id")
    return parsed.where("reason is null").drop("reason", "line_id"), rejects.select("input_name", "line", "reason")


def _md5_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums = []
        for path in b.column(0).to_pylist():
            with open(unquote(urlparse(path).path), "rb") as f:
                sums.append(hashlib.file_digest(f, "md5").hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.string())], names=["path", "length", "md5"])


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Rows (input_name, md5, length) of all files under path; on a mounted file system tasks read them piece by piece, else each is a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if urlparse(path).scheme in ("", "file"):
        files = files.select("path", "length").repartition(spark.sparkContext.defaultParallelism).mapInArrow(_md5_of, "path string, length long, md5 string")
    else:
        files = files.select("path", "length", F.md5("content").alias("md5"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("input_name"), "md5", "length")
