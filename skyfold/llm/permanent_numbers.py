"""Samples that stay the same over reruns, partitionings and growing data, by permanent random numbers.

A store keeps one uniform number per identifier, given at first sight: new identifiers are those that an anti-join with
the store leaves, and only they are appended. The sample is every identifier whose number is below its group's threshold;
the ledger of thresholds only ever rises. Numbers come from a keyed hash of seed, group and identifier, so a lost store
could be rebuilt, and persisting them keeps old choices should the hash or the seeds change. A store has one writer at a
time; compact() puts its loads together.

Defined cases: null identifiers get no number; null keys form a group; an identifier that occurs more than once, in one
piece or in several, has one number, with the lowest piece of its first load; a group that `seeds` doesn't list, or whose
seed is null, has seed 0; an empty piece appends nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.common import join_nulls, maybe_broadcast

BITS = 52


def keyed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by colons; null parts are the text `null`."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long") / F.lit(float(1 << BITS))


class NumberStore:
    """Permanent numbers of identifiers under a folder that all executors share: numbers/gen=g/load=k and thresholds.

    The highest generation with a complete first load holds; compact() makes the next one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], ident: str):
        self.spark, self.path, self.keys, self.ident = spark, path.rstrip("/"), list(keys), ident
        self.generation = self.loads = 0
        fs, root = self._fs(f"{self.path}/numbers")
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        self.generation = max((g for n in names if n.startswith("gen=") and self._complete(g := int(n[4:]), 0)), default=0)
        # A load counts once it is complete; the next insert overwrites one that broke off.
        while self._complete(self.generation, self.loads):
            self.loads += 1

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _folder(self, generation: int, load: int) -> str:
        return f"{self.path}/numbers/gen={generation}/load={load}"

    def _complete(self, generation: int, load: int) -> bool:
        fs, mark = self._fs(f"{self._folder(generation, load)}/_SUCCESS")
        return fs.exists(mark)

    def numbers(self, schema: str | None = None) -> DataFrame | None:
        """keys, ident, first_piece, u; None before the first insert."""
        if not self.loads:
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(*[self._folder(self.generation, k) for k in range(self.loads)])

    def insert(self, piece: DataFrame, seeds: DataFrame, arrived: str, seed: str = "seed") -> None:
        """Give numbers to identifiers of piece that the store doesn't have yet. arrived: a column that orders pieces."""
        names = [*self.keys, self.ident]
        fresh = piece.where(F.col(self.ident).isNotNull()).groupBy(*names).agg(F.min(arrived).alias("first_piece"))
        known = self.numbers()
        if known is not None:
            other = known.select(*[F.col(c).alias(f"__r_{c}") for c in names])
            on = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in self.keys] + [F.col(self.ident) == F.col(f"__r_{self.ident}")]
            fresh = fresh.join(other, on, "left_anti")
        seeds = seeds.groupBy(*self.keys).agg(F.min(seed).alias("__seed"))
        fresh = join_nulls(fresh, maybe_broadcast(seeds), self.keys, "left")
        u = keyed_uniform(F.coalesce("__seed", F.lit(0)), *[F.col(c) for c in names])
        # No number is written twice: a load is a folder of its own, and a repeated insert finds nothing new.
        fresh.select(*names, "first_piece", u.alias("u")).write.mode("overwrite").parquet(self._folder(self.generation, self.loads))
        self.loads += 1

    def compact(self) -> None:
        """Put all numbers into one load of a new generation, and then drop the old one. Results that read it must have been stored."""
        known = self.numbers()
        if known is None or self.loads == 1:
            return
        known.write.mode("overwrite").parquet(self._folder(self.generation + 1, 0))
        fs, old = self._fs(f"{self.path}/numbers/gen={self.generation}")
        self.generation, self.loads = self.generation + 1, 1
        fs.delete(old, True)

    def raise_thresholds(self, thresholds: DataFrame) -> DataFrame:
        """Ledger the thresholds (keys, threshold) and return, per group, the highest one so far."""
        path = f"{self.path}/thresholds"
        thresholds.select(*self.keys, F.col("threshold").cast("double").alias("threshold")).write.mode("append").parquet(path)
        return self.spark.read.parquet(path).groupBy(*self.keys).agg(F.max("threshold").alias("threshold"))

    def sample(self, thresholds: DataFrame) -> DataFrame:
        """keys, ident, first_piece, u of all identifiers below the group's threshold, which never falls below an earlier one."""
        now = self.raise_thresholds(thresholds)
        known = self.numbers()
        if known is None:
            raise ValueError("nothing was inserted yet")
        return join_nulls(known, maybe_broadcast(now), self.keys).where("u < threshold").drop("threshold")
