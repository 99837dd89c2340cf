"""Per-key results when a few keys hold most rows.

Heavy keys are detected in a sample. Their rows are joined with a broadcast of the few rows that concern them and spread
by a second column; all other keys go through one ordinary shuffle by key; the two results are united. No row is
dropped: a heavy key that the sample misses is treated as an ordinary one, a light key that it names as a heavy one.

Defined cases: rows with a null key or a null identifier don't count; a key that only one side has comes out, with 0 for
the other, and so does a key without any identifier, heavy or not; repeated identifiers count once per key; null measures count as 0; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of the sample on; so there are at most 1 / SHARE heavy keys.
SHARE = 0.005
SAMPLE = 0.05


def heavy_keys(df: DataFrame, key: str, share: float = SHARE, sample: float = SAMPLE, seed: int = 7) -> DataFrame:
    """The keys with at least `share` of a sample's rows, at most 1 / share of them by that."""
    counts = df.select(F.col(key)).where(F.col(key).isNotNull()).sample(sample, seed).groupBy(key).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    most = counts.where(F.col("__n") >= max(2, share * total)).orderBy(F.desc("__n"), key).limit(int(1 / share)).collect()
    names = [x[key] for x in most]
    return df.sparkSession.createDataFrame([(x,) for x in names], df.select(key).schema)


def count_beside(facts: DataFrame, dims: DataFrame, key: str, ident: str, measure: str, heavy: DataFrame | None = None, n: str = "n") -> DataFrame:
    """Rows (key, n, measure) for every key of either side: the number of different ident in facts and dims' sum of measure."""
    heavy = heavy_keys(facts, key) if heavy is None else heavy
    # Null identifiers stay, as a key that has no others comes out too; count(ident) passes over them.
    rows = facts.select(key, ident).where(F.col(key).isNotNull())
    sums = dims.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(F.coalesce(F.col(measure), F.lit(0))).alias(measure))
    few = F.broadcast(heavy)
    # Heavy: the few keys are broadcast, and the identifiers spread the rows; at most 1 / share counts meet as many sums.
    many = rows.join(few, key, "left_semi").groupBy(key, ident).agg(F.lit(1).alias("__one")).groupBy(key).agg(F.count(ident).alias(n))
    hot = many.join(sums.join(few, key, "left_semi"), key, "full_outer")
    # The rest: one shuffle by key serves the removal of repeats, the count and the join.
    rest = rows.join(few, key, "left_anti").repartition(key).groupBy(key, ident).agg(F.lit(1).alias("__one")).groupBy(key).agg(F.count(ident).alias(n))
    cold = rest.join(sums.join(few, key, "left_anti"), key, "full_outer")
    out = hot.select(key, n, measure).unionByName(cold.select(key, n, measure))
    return out.select(key, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in (n, measure)])
