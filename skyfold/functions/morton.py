"""Cells of an octree over the cube [-half, half] in all axes. A cell is (depth, prefix); a child adds three bits."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 10


def axis_index(v: Column, half: float, depth: int) -> Column:
    """Cell number along an axis; NULL outside. Values that rounding would push past the end stay in the last cell."""
    scale = 1 << depth
    return F.when(F.abs(v) <= half, F.least(F.lit(scale - 1), F.floor((v + half) / (2 * half) * scale))).cast("long")


def interleave(x: str, y: str, z: str, depth: int) -> Column:
    """Bit k of columns x, y, z becomes bit 3k, 3k + 1, 3k + 2."""
    bits = [f"shiftleft(shiftright(`{c}`, {k}) & 1L, {3 * k + axis})" for k in range(depth) for axis, c in enumerate((x, y, z))]
    return F.expr(" | ".join(bits))


def deinterleave(code: str, depth: int) -> tuple[Column, Column, Column]:
    """The three cell numbers of a column of codes."""
    return tuple(F.expr(" | ".join(f"shiftleft(shiftright(`{code}`, {3 * k + axis}) & 1L, {k})" for k in range(depth))) for axis in range(3))


def with_cell(df: DataFrame, name: str, x: str, y: str, z: str, half: float, depth: int) -> DataFrame:
    """df with the Morton code of the leaf cell; NULL if a coordinate is outside or missing.

    Cell numbers are columns of their own first, so that their bits don't repeat the arithmetic.
    """
    parts = ["__ix", "__iy", "__iz"]
    df = df.withColumns({p: axis_index(F.col(c), half, depth) for p, c in zip(parts, (x, y, z))})
    return df.withColumn(name, interleave(*parts, depth)).drop(*parts)


def axis_cells(low: float, high: float, first: float, last: float, depth: int) -> tuple[int, int]:
    """Numbers of the first and last of 2^depth cells of [first, last] that [low, high] meets; cells that it only touches count."""
    n = 1 << depth
    scale = n / (last - first)
    return max(0, ceil((low - first) * scale) - 1), min(n - 1, floor((high - first) * scale))


def prefix_at(code: Column, leaf_depth: int, depth: int) -> Column:
    return F.shiftright(code, 3 * (leaf_depth - depth))


def with_bounds(df: DataFrame, half: float, depth: str = "depth", prefix: str = "prefix", max_depth: int = MAX_DEPTH) -> DataFrame:
    """df with the box of each cell: x0, y0, z0, x1, y1, z1."""
    side = F.lit(2 * half) / F.pow(F.lit(2.0), F.col(depth))
    df = df.withColumns({f"{a}0": F.lit(-half) + i * side for a, i in zip("xyz", deinterleave(prefix, max_depth))})
    return df.withColumns({f"{a}1": F.col(f"{a}0") + side for a in "xyz"})


def box() -> dict[str, Column]:
    """The columns that with_bounds adds."""
    return {f"{a}{e}": F.col(f"{a}{e}") for a in "xyz" for e in "01"}
