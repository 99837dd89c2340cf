"""The ingestion log as text, one record a file: a first line that names the format, then lines `key: value`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a record in their order, with their types; a list's members are separated by commas.
FIELDS = {
    "source_bulk_url": "string", "source_bulk_md5": "string", "input_name": "string", "canonical_directory": "string", "canonical_parts": "array<string>",
    "ingestion_started_at": "string", "ingestion_finished_at": "string", "rows_seen": "long", "rows_with_positive_parallax": "long", "rows_written": "long",
}


def encode_metadata(log: DataFrame, first_line: str) -> DataFrame:
    """Rows (canonical_directory, value): each entry's record. A null value is an empty text, which isn't a number for a count."""
    shown = [F.concat_ws(",", c) if kind.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c, kind in FIELDS.items()]
    lines = [F.concat(F.lit(f"{c}: "), v) for c, v in zip(FIELDS, shown)]
    return log.select("canonical_directory", F.concat_ws("\n", F.lit(first_line), *lines).alias("value"))


def decode_metadata(texts: DataFrame, first_line: str, text: str = "value") -> DataFrame:
    """Typed records of whole texts. A text with another first line, without some field, or with a count that isn't a number is left out."""
    pairs = F.filter(F.split(F.col(text), "\n"), lambda x: F.contains(x, F.lit(": ")) | F.endswith(x, F.lit(":")))
    # Of repeated fields the last counts.
    found = F.aggregate(pairs, F.create_map().cast("map<string, string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != _key(x)), F.create_map(_key(x), _value(x))))
    rows = texts.where(F.substring_index(F.col(text), "\n", 1) == first_line).select(found.alias("m"))
    typed = []
    for c, kind in FIELDS.items():
        v = F.try_element_at("m", F.lit(c))
        if kind == "long":
            v = F.when(F.trim(v).rlike("^[0-9]+$"), F.trim(v).try_cast("long"))
        elif kind.startswith("array"):
            v = F.when(v.isNotNull(), F.filter(F.transform(F.split(v, ","), F.trim), lambda x: x != ""))
        typed.append(v.alias(c))
    return rows.select(*typed).na.drop(subset=list(FIELDS))


def _key(line: Column) -> Column:
    return F.trim(F.substring_index(line, ":", 1))


def _value(line: Column) -> Column:
    return F.trim(F.substring(line, F.length(F.substring_index(line, ":", 1)) + 2, F.length(line)))


def write_metadata(log: DataFrame, path: str, first_line: str) -> None:
    """A text file in a folder for each canonical directory; a directory that is written again has only its new record."""
    out = encode_metadata(log, first_line)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("canonical_directory").text(path)


def read_metadata(spark: SparkSession, path: str, first_line: str) -> DataFrame:
    """The typed records of all text files under path; those that can't be decoded are skipped."""
    return decode_metadata(spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True), first_line)
