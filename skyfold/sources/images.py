"""Images as relations (x, y, r, g, b) of bytes: PPM in, PPM and PNG out."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _header(raw: bytes) -> tuple[int, int, int]:
    """Width, height and where the pixels begin."""
    words, at = [], 0
    while len(words) < 4:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while not raw[end : end + 1].isspace():
            end += 1
            if end >= len(raw):
                raise ValueError("no header")
        words.append(raw[at:end])
        at = end
    if words[0] != b"P6" or words[3] != b"255":
        raise ValueError(f"not P6 with a maximum of 255: {words}")
    w, h = int(words[1]), int(words[2])
    if len(raw) != at + 1 + w * h * 3:
        raise ValueError("the size doesn't fit the header")
    return w, h, at + 1


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0).to_pylist():
            w, h, at = _header(raw)
            rgb = np.frombuffer(raw, np.uint8, w * h * 3, at).reshape(-1, 3).astype(np.int32)
            i = np.arange(w * h, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i % w), pa.array(i // w), *[pa.array(np.ascontiguousarray(rgb[:, c])) for c in range(3)]], names=["x", "y", "r", "g", "b"])


def read_ppm(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_pixels, "x int, y int, r int, g int, b int")


def _dense(image: DataFrame, width: int, height: int) -> np.ndarray:
    """The image on the driver: width * height pixels at most, whatever the number of stars behind it."""
    out = np.zeros((height, width, 3), np.uint8)
    inside = image.where(f"x between 0 and {width - 1} and y between 0 and {height - 1}").groupBy("x", "y").agg({"r": "max", "g": "max", "b": "max"})
    p = inside.select("x", "y", "max(r)", "max(g)", "max(b)").toPandas()
    out[p["y"], p["x"]] = p[["max(r)", "max(g)", "max(b)"]].to_numpy(np.uint8)
    return out


def write_ppm(image: DataFrame, path: str, width: int, height: int) -> None:
    with open(path, "wb") as f:
        f.write(b"P6\n%d %d\n255\n" % (width, height) + _dense(image, width, height).tobytes())


def write_png(image: DataFrame, path: str, width: int, height: int) -> None:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = _dense(image, width, height).reshape(height, -1)
    raw = np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes()
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
