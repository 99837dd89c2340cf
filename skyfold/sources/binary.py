"""Fixed-width binary records: canonical rows (32 bytes) and index files. Missing values are NaN there and NULL in tables.

An index file is one file with a header, all nodes and all points. As records have a fixed width, a record's number is
its place in the file: tasks write and read their own byte ranges of it. The file must be on a file system that all
executors have mounted.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANONICAL = ["source_id", "ra", "dec", "parallax", "parallax_error", "phot_g_mean_mag", "bp_rp"]
# The records' layouts, all little-endian, and the index file's header.
ROW = np.dtype([("source_id", "<i8"), *[(c, "<f4") for c in CANONICAL[1:]]])
NODE = np.dtype([("child_mask", "u1"), ("pad", "V3"), ("first_child", "<u4"), ("point_first", "<u4"), ("point_count", "<u4"), ("reserved", "<u4")])
POINT = np.dtype([(c, "<f4") for c in ("x", "y", "z", "luminosity", "bp_rp")])
MAGIC, VERSION, HEADER = b"STRCLD\0\0", 1, 32
ROWS_DDL = "source_id long, " + ", ".join(f"{c} float" for c in CANONICAL[1:])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = np.zeros(b.num_rows, ROW)
        for i, c in enumerate(CANONICAL):
            out[c] = b.column(i).fill_null(0 if i == 0 else float("nan")).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([b.num_rows], pa.int64())], names=["content", "rows"])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0).to_pylist():
            if len(content) % ROW.itemsize:
                raise ValueError(f"{len(content)} bytes are not whole rows of {ROW.itemsize}")
            rows = np.frombuffer(content, ROW)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c]), from_pandas=False) for c in CANONICAL], names=CANONICAL)


def encode_canonical(rows: DataFrame) -> DataFrame:
    """Blocks (content, rows) of 32-byte records, made where the rows are."""
    return rows.select(*CANONICAL).mapInArrow(_encode, "content binary, rows long")


def decode_canonical(blocks: DataFrame, content: str = "content") -> DataFrame:
    """Rows of blocks or of whole files (the binaryFile source); missing values stay NaN."""
    return blocks.select(content).mapInArrow(_decode, ROWS_DDL)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    return decode_canonical(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast(t)) for c, t in df.dtypes if t in ("float", "double")})


def _columns(kind: np.dtype) -> list[str]:
    return [c for c in kind.names if c not in ("pad", "reserved")]


def _write_records(path: str, kind: np.dtype, offset: int):
    """Rows (number, the record's columns) to their places in the file; gives the number of rows. Writing again does no harm."""
    names = _columns(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, rows = os.open(path, os.O_WRONLY), 0
        try:
            for b in batches:
                at = b.column(0).to_numpy()
                out = np.zeros(b.num_rows, kind)
                for i, c in enumerate(names, 1):
                    out[c] = b.column(i).fill_null(float("nan") if kind[c].kind == "f" else 0).to_numpy(zero_copy_only=False)
                order = np.argsort(at, kind="stable")
                at, out = at[order], out[order]
                ends = np.flatnonzero(np.append(np.diff(at) != 1, True)) + 1 if len(at) else []
                for a, z in zip(np.concatenate([[0], ends[:-1]]).astype(int) if len(at) else [], ends):  # stretches that adjoin
                    os.pwrite(file, out[a:z].tobytes(), offset + int(at[a]) * kind.itemsize)
                rows += b.num_rows
        finally:
            os.close(file)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    return run


def write_index(nodes: DataFrame, points: DataFrame, path: str, depth: int, half: float) -> None:
    """One index file from node rows (numbered by node) and point rows (numbered by place), both from 0 without gaps.

    Tasks write their rows where they belong; the file gets its name when all are in. Numbers that repeat or leave gaps
    raise ValueError.
    """
    totals = []
    for df, number in ((nodes, "node"), (points, "place")):
        n, different, least, most = df.agg(F.count(F.lit(1)), F.count_distinct(number), F.min(number), F.max(number)).first()
        if n and (different, least, most) != (n, 0, n - 1):
            raise ValueError(f"{number} must number the rows from 0 to {n - 1}")
        totals.append(n)
    n, m = totals
    partial = f"{path}.partial-{uuid.uuid4().hex[:8]}"
    with open(partial, "wb") as f:
        f.write(struct.pack("<8sHBBfIQ4x", MAGIC, VERSION, depth, 0, half, n, m))
        f.truncate(HEADER + n * NODE.itemsize + m * POINT.itemsize)
    for df, number, kind, offset, total in ((nodes, "node", NODE, HEADER, n), (points, "place", POINT, HEADER + n * NODE.itemsize, m)):
        kept = df.select(F.col(number).cast("long"), *_columns(kind))
        written = kept.mapInArrow(_write_records(partial, kind, offset), "rows long").agg(F.sum("rows")).first()[0] or 0
        if written != total:
            raise ValueError(f"{written} rows were written instead of {total}")
    os.replace(partial, path)


def read_header(path: str) -> dict:
    """depth, half_extent, nodes and points of an index file, from its first bytes; bad magic, version or size raise ValueError."""
    with open(path, "rb") as f:
        raw = f.read(HEADER)
        size = f.seek(0, os.SEEK_END)
    if len(raw) < HEADER:
        raise ValueError("shorter than a header")
    magic, version, depth, _, half, n, m = struct.unpack("<8sHBBfIQ4x", raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"magic {magic!r}, version {version}")
    if size != HEADER + n * NODE.itemsize + m * POINT.itemsize:
        raise ValueError("the size doesn't fit the header's counts")
    return {"depth": depth, "half_extent": half, "nodes": n, "points": m}


def _read_records(path: str, kind: np.dtype, offset: int, end: int, step: int, number: str):
    names = _columns(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in b.column(0).to_pylist():
                n = min(step, end - first)
                with open(path, "rb") as f:
                    f.seek(offset + first * kind.itemsize)
                    rows = np.frombuffer(f.read(n * kind.itemsize), kind)
                cols = [pa.array(np.arange(first, first + n))]
                cols += [pa.array(np.ascontiguousarray(rows[c]).astype(np.float32 if kind[c].kind == "f" else np.int64), from_pandas=False) for c in names]
                yield pa.RecordBatch.from_arrays(cols, names=[number, *names])

    return run


def read_nodes(spark: SparkSession, path: str, step: int = 65_536) -> DataFrame:
    """The nodes of an index file (node, child_mask, first_child, point_first, point_count); its points aren't read."""
    n = read_header(path)["nodes"]
    rows = spark.range(0, n, step).mapInArrow(_read_records(path, NODE, HEADER, n, step, "node"), "node long, " + ", ".join(f"{c} long" for c in _columns(NODE)))
    return rows.withColumn("child_mask", F.col("child_mask").cast("int"))


def read_points(spark: SparkSession, path: str, first: int = 0, count: int | None = None, step: int = 65_536) -> DataFrame:
    """Points of an index file (place, x, y, z, luminosity, bp_rp): `count` of them from place `first` on, or all; only their bytes are read."""
    head = read_header(path)
    end = head["points"] if count is None else min(head["points"], first + count)
    if first < 0 or (count is not None and count < 0):
        raise ValueError("first and count can't be negative")
    offset = HEADER + head["nodes"] * NODE.itemsize
    rows = spark.range(first, max(first, end), step).mapInArrow(_read_records(path, POINT, offset, end, step, "place"), "place long, " + ", ".join(f"{c} float" for c in _columns(POINT)))
    return nan_to_null(rows)


def read_index(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """Header, nodes and points of an index file."""
    return read_header(path), read_nodes(spark, path), read_points(spark, path)
