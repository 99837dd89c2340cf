"""The ingestion log as a relation: what is done, what is open, whether it is whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyfold.common import Scratch, maybe_broadcast, with_place


def input_name(url: Column) -> Column:
    """The last segment of a path or URL."""
    return F.trim(F.element_at(F.split(url, "/"), -1))


def canonical_directory(name: Column) -> Column:
    """The directory of a file's rows; prefix and suffix of the survey's file names are dropped only together."""
    return F.concat(F.lit("canonical/"), F.regexp_replace(name, r"^GaiaSource_(.*)\.csv\.gz$", "$1"))


def manifest_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines `md5<tab>input` or `input` to (input, expected_md5); blank lines are dropped."""
    t = F.trim(F.col(text))
    parts = F.split(t, "\t", 2)
    both = F.size(parts) == 2
    rows = lines.where(F.length(t) > 0)
    return rows.select(F.trim(F.when(both, parts[1]).otherwise(parts[0])).alias("input"), F.when(both, F.trim(parts[0])).alias("expected_md5"))


def checksum_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines `md5  file name` to (input_name, md5)."""
    found = lines.select(F.regexp_extract(text, r"^\s*([0-9a-fA-F]{32})\s+\*?(.+?)\s*$", 1).alias("md5"), F.regexp_extract(text, r"^\s*([0-9a-fA-F]{32})\s+\*?(.+?)\s*$", 2).alias("input_name"))
    return found.where(F.length("md5") == 32)


def latest(log: DataFrame, keys: Sequence[str] = ("dataset", "input_name"), by: str = "ingestion_started_at") -> DataFrame:
    """The entry of each file that was started last, whole; of several started together the greatest in its other columns."""
    rest = [c for c in log.columns if c not in (*keys, by)]
    one = log.groupBy(*keys).agg(F.max(F.struct(by, *rest)).alias("__e"))
    return one.select(*keys, *[F.col(f"__e.{c}").alias(c) for c in (by, *rest)])


def open_work(inputs: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inputs without a finished entry."""
    return inputs.join(done.select(*on).distinct(), list(on), "left_anti")


def checksums(log: DataFrame) -> DataFrame:
    return log.groupBy("source_bulk_url").agg(F.countDistinct("source_bulk_md5").alias("checksums")).where("checksums <> 1")


def trusted(inputs: DataFrame, sums: DataFrame) -> DataFrame:
    """Inputs with the checksum of their name; mismatch tells those that expected another, missing those that have none."""
    out = inputs.withColumn("input_name", input_name(F.col("input"))).join(maybe_broadcast(sums.groupBy("input_name").agg(F.max("md5").alias("md5"))), "input_name", "left")
    return out.withColumns({"mismatch": F.coalesce(F.col("expected_md5") != F.col("md5"), F.lit(False)), "missing": F.col("md5").isNull()})


def with_checksums(inputs: DataFrame, sums: DataFrame) -> DataFrame:
    """Inputs (input, expected_md5) with the checksum list's md5 expected; an input that the list lacks fails the job."""
    lacks = F.concat(F.lit("missing checksum for "), F.col("input_name"))
    return trusted(inputs, sums).select("input", F.when(F.col("missing"), F.raise_error(lacks)).otherwise(F.col("md5")).alias("expected_md5"))


def all_inputs(spark: SparkSession, named: Sequence[str], manifest: DataFrame | None = None) -> DataFrame:
    """Inputs named one by one and those of a manifest, numbered from 0 in this order; ValueError if there are none."""
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(named)], "__n long, input string").withColumn("expected_md5", F.lit(None).cast("string"))
    if manifest is not None:
        rows = rows.unionByName(manifest.select("input", "expected_md5").withColumn("__n", F.monotonically_increasing_id() + len(named)))
    if rows.isEmpty():
        raise ValueError("no inputs: name some or give a manifest")
    return rows.select("input", "expected_md5", F.col("__n").alias("number"))


def new_names(before: DataFrame, after: DataFrame, name: str = "name") -> DataFrame:
    """Names that came since, such as those of jobs just started; null names don't count."""
    return after.select(name).where(F.col(name).isNotNull()).distinct().join(before.select(name), name, "left_anti")


def part_rows(parts: DataFrame, row_bytes: int = 32) -> DataFrame:
    """Rows in each file's parts (columns input_name, length), and whether every part is a whole number of rows."""
    return parts.groupBy("input_name").agg(F.sum(F.floor(F.col("length") / row_bytes)).alias("rows_found"), F.min(F.col("length") % row_bytes == 0).alias("whole"))


def validate(found: DataFrame, log: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that are there beside the rows that the log says were written; only those with positive parallax are."""
    both = found.join(log.select(*on, "rows_written"), list(on), "full_outer")
    cols = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("rows_found", "positive_found", "rows_written")}
    return both.select(*on, *[c.alias(n) for n, c in cols.items()], (cols["positive_found"] == cols["rows_written"]).alias("valid"))


def shards(inputs: DataFrame, order: Sequence[str], count: int) -> DataFrame:
    """Round robin over the sorted inputs."""
    if count < 1:
        raise ValueError("count must be at least 1")
    return with_place(inputs, order, "__place").withColumn("shard", (F.col("__place") % count).cast("int")).drop("__place")


def progress(log: DataFrame) -> DataFrame:
    """Files by state, and what they wrote. Failed: finished without a checksum or with fewer rows than it should have kept."""
    done = F.col("ingestion_finished_at").isNotNull()
    failed = done & (F.col("source_bulk_md5").isNull() | F.coalesce(F.col("rows_written") < F.col("rows_with_positive_parallax"), F.lit(False)))
    return log.groupBy("dataset").agg(
        F.count("*").alias("files"), F.count_if(done & ~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.count_if(~done).alias("running"), F.sum("rows_written").alias("rows_written"),
        F.min("ingestion_started_at").alias("first_start"), F.max("ingestion_finished_at").alias("last_finish"),
    )


def execution_states(executions: DataFrame, doc: str = "json") -> DataFrame:
    """State of job executions from their status documents: succeeded, failed, or running; pending tasks are what is left."""
    status = "spec struct<taskCount: long>, status struct<succeededCount: long, runningCount: long, failedCount: long, logUri: string, conditions: array<struct<type: string, status: string, message: string>>>"
    e = executions.withColumn("__e", F.from_json(doc, status))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    completed = F.get(F.filter("__e.status.conditions", lambda c: c["type"] == "Completed"), F.lit(0))
    state = F.when(completed["status"] == "True", "succeeded").when(completed["status"].isNull() | (completed["status"] == "Unknown"), "running").otherwise("failed")
    s, r, f = n("__e.status.succeededCount"), n("__e.status.runningCount"), n("__e.status.failedCount")
    return e.select(*executions.columns, state.alias("state"), s.alias("succeeded"), r.alias("running"), f.alias("failed"), F.greatest(n("__e.spec.taskCount") - s - r - f, F.lit(0)).alias("pending"))


#: An entry of the log that ingest() keeps: one per file. load tells where the file's rows are.
ENTRY = "input_name string, md5 string, url string, load long, rows_seen long, rows_written long, ingestion_started_at timestamp, ingestion_finished_at timestamp"


def _versions(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the complete folders name=k under path."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{name}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def stored_log(spark: SparkSession, log_path: str) -> DataFrame:
    """The log's newest version: one entry per file."""
    versions = _versions(spark, log_path, "version")
    return spark.read.schema(ENTRY).parquet(f"{log_path}/version={versions[-1]}") if versions else spark.createDataFrame([], ENTRY)


def stored_rows(spark: SparkSession, rows_path: str, log_path: str) -> DataFrame:
    """The rows that the log's entries stand for; what an older entry wrote is no longer seen."""
    log = stored_log(spark, log_path)
    loads = _versions(spark, rows_path, "load")
    if not loads:
        raise ValueError(f"nothing was stored in {rows_path} yet")
    rows = spark.read.option("basePath", rows_path).parquet(*[f"{rows_path}/load={k}" for k in loads])
    return rows.join(maybe_broadcast(log.select("input_name", F.col("load").cast("int").alias("load"))), ["input_name", "load"], "left_semi").drop("load")


def _content(rows: DataFrame) -> Column:
    """A checksum of rows in any order, for files that come without one."""
    h = F.xxhash64(*rows.columns)
    return F.md5(F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))))


def ingest(spark: SparkSession, rows: DataFrame, rows_path: str, log_path: str, sums: DataFrame | None = None) -> int:
    """Store the rows with positive parallax of files whose entry in the log doesn't hold; the number of files stored.

    An entry holds if name, checksum and (where sums has it) URL are the file's and as many rows are stored as it says.
    sums: input_name, md5 and maybe url; without it, or for a file that it lacks, the checksum is made from the rows.
    Every load has a folder of its own; the new version of the log, with one entry per file, is written last and is the
    commit, so stale rows of a file disappear even where its new content keeps none, and a load that broke off counts for
    nothing.
    """
    scratch = Scratch(spark)
    names = rows.where(F.col("input_name").isNotNull())
    positive = F.col("parallax").isNotNull() & ~(F.col("parallax") <= 0)
    files = names.groupBy("input_name").agg(F.count(F.lit(1)).alias("rows_seen"), F.count_if(positive).alias("rows_written"), _content(names).alias("__own"))
    given = sums.groupBy("input_name").agg(*[F.max(c).alias(f"__{c}") for c in ("md5", "url") if c in sums.columns]) if sums is not None else None
    if given is not None:
        files = files.join(given, "input_name", "left")
    have = [c for c in ("__md5", "__url") if c in files.columns]
    files = files.select("input_name", "rows_seen", "rows_written", F.coalesce(*[F.col(c) for c in have if c == "__md5"], "__own").alias("md5"), (F.col("__url") if "__url" in have else F.lit(None).cast("string")).alias("url"))
    log = stored_log(spark, log_path)
    loads = _versions(spark, rows_path, "load")
    if loads:
        there = stored_rows(spark, rows_path, log_path).groupBy("input_name").agg(F.count(F.lit(1)).alias("__there"))
        old = log.join(there, "input_name", "left").where(F.col("rows_written") == F.coalesce("__there", F.lit(0))).select("input_name", F.col("md5").alias("__m"), F.col("url").alias("__u"))
        same = (files["input_name"] == old["input_name"]) & files["md5"].eqNullSafe(F.col("__m")) & (files["url"].isNull() | files["url"].eqNullSafe(F.col("__u")))
        files = files.join(old, same, "left_anti")
    load = (loads[-1] if loads else -1) + 1
    now = F.current_timestamp()
    entries = files.select("input_name", "md5", "url", F.lit(load).cast("long").alias("load"), "rows_seen", "rows_written", now.alias("ingestion_started_at"), now.alias("ingestion_finished_at"))
    entries = scratch.write(entries, "entries", files=F.count(F.lit(1)))
    stored = scratch.seen.get("files", 0)
    if not stored:
        return 0
    work = names.where(positive).join(maybe_broadcast(entries.select("input_name"), scratch), "input_name", "left_semi")
    work.write.mode("overwrite").partitionBy("input_name").parquet(f"{rows_path}/load={load}")
    version = max(_versions(spark, log_path, "version"), default=-1) + 1
    kept = log.join(entries.select("input_name"), "input_name", "left_anti")
    kept.unionByName(entries).write.mode("overwrite").parquet(f"{log_path}/version={version}")
    return stored
