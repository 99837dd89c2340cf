"""The N highest items of every group.

Every partition keeps a bounded heap of the best N items per group and hands on only those; after a shuffle by group the
heaps are merged. A group of any size thus sends at most N rows each time that a partition hands on its heaps: at its
end, and before it where so many groups occur that more than half of HOLD_ROWS rows stay.

Order: score descending, then identifier ascending. Defined cases: rows whose score is null or NaN or whose identifier
is null don't count; infinite scores do; null keys form a group; an identifier that occurs several times in a group
counts once, with its best score; an empty table gives an empty result; other columns are ignored, so their names may
clash with anything.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOLD_ROWS = 262_144


def _changes(t: pa.Table, names: list[str]) -> np.ndarray:
    """True where a row differs from the one before in any of the columns; nulls are equal."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for n in names:
        code = pc.fill_null(t[n].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def _bounded_heap(keys: list[str], n: int):
    order = [(k, "ascending") for k in keys]

    def best(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return t
        t = t.sort_by([*order, ("__id", "ascending"), ("__score", "descending")])
        t = t.filter(pa.array(_changes(t, [*keys, "__id"])))
        t = t.sort_by([*order, ("__score", "descending"), ("__id", "ascending")])
        new = _changes(t, keys) if keys else np.arange(t.num_rows) == 0
        at = np.arange(t.num_rows)
        start = np.maximum.accumulate(np.where(new, at, 0))
        return t.filter(pa.array(at - start < n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, rows = [], 0
        for b in batches:
            heap.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= HOLD_ROWS:
                kept = best(pa.concat_tables(heap).combine_chunks())
                heap, rows = [kept], kept.num_rows
                if rows > HOLD_ROWS // 2:  # so many groups that holding on would only grow: the merge takes over
                    yield from kept.to_batches()
                    heap, rows = [], 0
        if heap:
            yield from best(pa.concat_tables(heap).combine_chunks()).to_batches()

    return run


def top_items(df: DataFrame, keys: Sequence[str], score: str, ident: str, n: int, rank: str = "rank") -> DataFrame:
    """Rows (keys, ident, score, rank), rank from 1, of the best n items of each group; see the module."""
    if n < 1:
        raise ValueError("n must be at least 1")
    keys = list(keys)
    if len({*keys, score, ident, rank}) != len(keys) + 3:
        raise ValueError("keys, score, ident and rank need different names")
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(m) for k, m in zip(keys, names)], F.col(score).alias("__score"), F.col(ident).alias("__id"))
    rows = rows.where(F.col("__score").isNotNull() & F.col("__id").isNotNull())
    if df.schema[score].dataType.typeName() in ("float", "double"):
        rows = rows.where(~F.isnan("__score"))
    heaps = rows.mapInArrow(_bounded_heap(names, n), rows.schema)
    merged = (heaps.repartition(*names) if names else heaps).groupBy(*names, "__id").agg(F.max("__score").alias("__score"))
    w = W.partitionBy(*names).orderBy(F.desc("__score"), F.asc("__id"))
    merged = merged.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n)
    return merged.select(*[F.col(m).alias(k) for k, m in zip(keys, names)], F.col("__id").alias(ident), F.col("__score").alias(score), F.col("__rank").alias(rank))
