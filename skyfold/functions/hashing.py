"""The splitmix64 finalizer over columns, inside generated code.

Sums and products are taken mod 2^64 in 32- and 16-bit parts, as plain ones would overflow; each step is a column of its
own, so that later ones refer to it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The increment and the two multipliers.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_LOW = 0xFFFFFFFF


# Expressions are texts, so that each step is parsed once instead of being built call by call.
def _low(c: str) -> str:
    return f"(({c}) & {_LOW}L)"


def _high(c: str) -> str:
    return f"shiftrightunsigned({c}, 32)"


def _join(low: str, high: str) -> str:
    """high * 2^32 + low mod 2^64, for parts of less than 2^62."""
    return f"(shiftleft(({high}) + {_high(low)}, 32) | {_low(low)})"


def wrapping_add(c: str, k: int) -> str:
    return _join(f"{_low(c)} + {k & _LOW}L", f"{_high(c)} + {k >> 32}L")


def wrapping_multiply(c: str, k: int) -> str:
    a, b = _low(c), _high(c)
    k0, k1, k2, k3 = (f"{(k >> (16 * i)) & 0xFFFF}L" for i in range(4))
    mid = f"shiftleft({a} * {k1}, 16)"
    high = f"{_high(f'{a} * {k0}')} + {_high(mid)} + {_low(f'{a} * {k2}')} + {_low(f'shiftleft({a} * {k3}, 16)')} + {_low(f'{b} * {k0}')} + {_low(f'shiftleft({b} * {k1}, 16)')}"
    return _join(f"{_low(f'{a} * {k0}')} + {_low(mid)}", high)


def _folded(c: str, bits: int) -> str:
    return f"({c} ^ shiftrightunsigned({c}, {bits}))"


def with_splitmix64(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the hash of a long as a signed long of the same bits; unsigned_order sorts it as unsigned."""
    at = f"`{name}`"
    df = df.withColumn(name, value.cast("long")).withColumn(name, F.expr(wrapping_add(at, STEP)))
    for bits, k in ((30, FIRST), (27, SECOND)):
        df = df.withColumn(name, F.expr(_folded(at, bits))).withColumn(name, F.expr(wrapping_multiply(at, k)))
    return df.withColumn(name, F.expr(_folded(at, 31)))


def unsigned_order(c: Column) -> Column:
    """A long that sorts as the unsigned reading of c does."""
    return c.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def with_node_seed(df: DataFrame, name: str, depth: str = "depth", prefix: str = "prefix") -> DataFrame:
    """The seed of an octree node: its prefix with the depth in the top byte, hashed."""
    return with_splitmix64(df, name, F.col(prefix).cast("long").bitwiseXOR(F.shiftleft(F.col(depth).cast("long"), 56)))
