"""The ingestion log: what counts as stored, and what a rerun does."""

import pytest
from pyspark.sql import functions as F

from skyfold.common import Scratch, clear_scratch, maybe_broadcast, row_bytes, with_place
from skyfold.operators import manifest as L
from skyfold.sources import metadata

ROWS = "input_name string, source_id long, parallax double"


def content(spark, *ids, name="f", parallax=1.0):
    return spark.createDataFrame([(name, i, parallax) for i in ids], ROWS)


@pytest.mark.parametrize("listed", [True, False])
def test_content_that_changes_back_and_forth(spark, listed):
    root = Scratch(spark).root
    a, b, none = content(spark, 1), content(spark, 2, 3), content(spark, 4, parallax=-1.0)
    other = content(spark, 9, name="g")

    def run(rows, md5):
        sums = spark.createDataFrame([("f", md5), ("g", "gg")], "input_name string, md5 string") if listed else None
        n = L.ingest(spark, rows.unionByName(other), f"{root}/rows", f"{root}/log", sums)
        found = L.stored_rows(spark, f"{root}/rows", f"{root}/log")
        return n, sorted(r.source_id for r in found.where("input_name = 'f'").collect()), found.where("input_name = 'g'").count()

    assert run(a, "aa") == (2, [1], 1)
    assert run(a, "aa") == (0, [1], 1)  # nothing is done twice
    assert run(b, "bb") == (1, [2, 3], 1)
    assert run(a, "aa") == (1, [1], 1)  # an entry of old doesn't count
    assert run(none, "cc") == (1, [], 1)  # no stale rows
    assert run(none, "cc") == (0, [], 1)
    log = {r.input_name: r.rows_written for r in L.stored_log(spark, f"{root}/log").collect()}
    assert log == {"f": 0, "g": 1}
    clear_scratch(spark)


def test_files_that_lost_rows_are_stored_again(spark):
    root = Scratch(spark).root
    rows = content(spark, *range(10))
    assert L.ingest(spark, rows, f"{root}/rows", f"{root}/log") == 1
    few = spark.read.parquet(f"{root}/rows/load=0").where("source_id < 7")
    few.write.mode("overwrite").partitionBy("input_name").parquet(f"{root}/other")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(jvm.Path(f"{root}/rows/load=0"), True)
    fs.rename(jvm.Path(f"{root}/other"), jvm.Path(f"{root}/rows/load=0"))
    assert L.ingest(spark, rows, f"{root}/rows", f"{root}/log") == 1
    assert L.stored_rows(spark, f"{root}/rows", f"{root}/log").count() == 10


def test_urls_count_where_they_are_given(spark):
    root = Scratch(spark).root
    rows = content(spark, 1)
    sums = lambda url: spark.createDataFrame([("f", "aa", url)], "input_name string, md5 string, url string")
    assert [L.ingest(spark, rows, f"{root}/r", f"{root}/l", sums(u)) for u in ("x/f", "x/f", "y/f")] == [1, 0, 1]


def test_latest_entry_is_one_run_s(spark):
    log = spark.createDataFrame([("d", "f", 1, 5, "old"), ("d", "f", 2, 3, None), ("d", "f", None, 9, "never")], "dataset string, input_name string, ingestion_started_at int, rows_written int, md5 string")
    assert [tuple(r) for r in L.latest(log).select("ingestion_started_at", "rows_written", "md5").collect()] == [(2, 3, None)]


def test_inputs_and_checksums(spark):
    manifest = L.manifest_lines(spark.createDataFrame([("0" * 32 + "\thttps://h/b.csv.gz",)], "value string"))
    both = L.all_inputs(spark, ["file:///d/a.csv.gz"], manifest)
    assert [(r.input, r.expected_md5) for r in both.orderBy("number").collect()] == [("file:///d/a.csv.gz", None), ("https://h/b.csv.gz", "0" * 32)]
    for none in (None, manifest.limit(0)):
        with pytest.raises(ValueError):
            L.all_inputs(spark, [], none)
    sums = spark.createDataFrame([("a.csv.gz", "1" * 32)], "input_name string, md5 string")
    assert L.with_checksums(both.where("input like '%a.csv.gz'"), sums).first().expected_md5 == "1" * 32
    with pytest.raises(Exception, match="missing checksum for b.csv.gz"):
        L.with_checksums(both, sums).collect()
    names = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    assert [r.name for r in L.new_names(names("a", None), names("a", "b", "b", None)).collect()] == ["b"]


def test_places_follow_the_order_whatever_the_partitions(spark):
    rows = [(k, i * 7919 % 1000, i) for k in ("a", None) for i in range(1000)] + [("hot", 1, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long, id long").repartition(7)
    for r in with_place(df, ["v", "id"], "place", ["k"]).groupBy("k").agg(F.collect_list(F.struct("place", "v", "id")).alias("x")).collect():
        x = sorted(r.x)
        assert [p.place for p in x] == list(range(len(x))) and [(p.v, p.id) for p in x] == sorted((p.v, p.id) for p in x)
    assert {r.shard for r in L.shards(df, ["k", "v", "id"], 3).where("k = 'a'").collect()} == {0, 1, 2}
    assert with_place(df.limit(0), ["v"], "place").count() == 0


def test_parts_are_whole_rows(spark):
    parts = spark.createDataFrame([("f", 64), ("f", 32), ("g", 33)], "input_name string, length long")
    assert {(r.input_name, r.rows_found, r.whole) for r in L.part_rows(parts).collect()} == {("f", 3, True), ("g", 1, False)}


def test_metadata_round_trip(spark, tmp_path):
    entry = ("https://h/f.csv.gz", "ab" * 16, "f.csv.gz", "canonical/f", ["part-000.bin", "part-001.bin"], "2026-01-01T00:00:00Z", "2026-01-01T01:00:00Z", 10, 8, 8)
    log = spark.createDataFrame([entry, (*entry[:2], "g", "canonical/g", [], "x: y", *entry[6:])], ", ".join(f"{c} {t}" for c, t in metadata.FIELDS.items()))
    path = str(tmp_path / "log")
    metadata.write_metadata(log, path, "RECORD 1")
    (tmp_path / "log" / "bad.txt").write_text("RECORD 1\nsource_bulk_url: x\n")
    (tmp_path / "log" / "other.txt").write_text("RECORD 2\n")
    got = metadata.read_metadata(spark, path, "RECORD 1")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, log.collect()))
    text = metadata.encode_metadata(log, "RECORD 1").first().value
    again = spark.createDataFrame([(text.replace("rows_seen: 10", "rows_seen: ten"),), (text,)], "value string")
    assert metadata.decode_metadata(again, "RECORD 1").count() == 1


def test_broadcasts_count_bytes(spark):
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 10_000).alias("t"), F.array_repeat(F.lit(1), 100).alias("a"))
    hint = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hint(maybe_broadcast(rows)) and not hint(maybe_broadcast(rows, max_bytes=500_000)) and not hint(maybe_broadcast(rows, max_rows=99))
    assert maybe_broadcast(rows.limit(0)).count() == 0
    odd = spark.createDataFrame([([("abc", [1, 2])], {"k": "value"}, None)], "a array<struct<s: string, n: array<int>>>, m map<string, string>, t string")
    assert odd.select(row_bytes(odd).alias("n")).first().n == 16 + (16 + (8 + 19 + 32)) + (16 + 17) + (16 + 21) + 16
