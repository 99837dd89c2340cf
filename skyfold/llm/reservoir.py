"""Uniform samples of fixed size per group, from rows whose number isn't known beforehand.

Every partition runs skip-based reservoir sampling (Li's Algorithm L) per group while it counts the rows. The reservoirs
are merged by drawing, for each group, how many of the sample come from each partition (multivariate hypergeometric in
the partitions' counts) and keeping so many of that partition's reservoir, which is in random order.

Reservoirs are written once before the merge, so counts and items agree even if an executor is lost. The result is a
function of the seed and of the rows' order; a sample that doesn't depend on order is in permanent_numbers.

Defined cases: null keys form a group; groups that have no row in `sizes`, or whose capacity is null or below 1, give no
rows; a null seed is 0; with fewer rows than the capacity all come out; an empty table gives an empty result. distinct_by
makes each identifier count once per group; rows with a null identifier then don't count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.common import Scratch, join_nulls, maybe_broadcast


def _stream(seed: int, key: tuple, *more: int) -> np.random.Generator:
    """Random numbers of their own for every seed (whatever its sign), group and purpose."""
    return np.random.default_rng([abs(seed), int(seed < 0), *more, *repr(key).encode()])


class _Reservoir:
    """Algorithm L over positions: offer() takes a run of rows and touches only those that enter."""

    def __init__(self, capacity: int, rng: np.random.Generator):
        self.k, self.rng, self.seen, self.items = capacity, rng, 0, []
        self.w, self.next = 1.0, -1

    def _skip(self) -> None:
        self.w *= np.exp(np.log(self.rng.random() or 5e-324) / self.k)
        self.next += int(np.floor(np.log(self.rng.random() or 5e-324) / np.log1p(-min(self.w, 1 - 1e-16)))) + 1

    def offer(self, rows: np.ndarray) -> list[int]:
        """Take a run of row numbers; returns those that entered."""
        start, free = self.seen, self.k - len(self.items)
        entered = rows[:free].tolist()
        self.items += entered
        self.seen += len(rows)
        if self.next < 0 and len(self.items) == self.k:
            self.next = self.k - 1
            self._skip()
        while 0 <= self.next < self.seen:
            entered.append(int(rows[self.next - start]))
            self.items[self.rng.integers(self.k)] = entered[-1]
            self._skip()
        return entered


def _sample_partition(keys: list[str]):
    """One reservoir per group of this partition: rows (columns, __part, __n, __order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple, _Reservoir] = {}
        rows: dict[tuple, dict[int, tuple[list[int], pa.RecordBatch]]] = {}
        for nth, b in enumerate(batches):
            code = np.zeros(b.num_rows, np.int64)
            for k in keys:
                d = b.column(b.schema.get_field_index(k)).dictionary_encode()
                code = np.unique(code * (len(d.dictionary) + 1) + d.indices.fill_null(-1).to_numpy(zero_copy_only=False) + 1, return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            bounds = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1], True]) if len(order) else []
            for a, z in zip(bounds[:-1], bounds[1:]):
                at = order[a:z]
                first = b.slice(int(at[0]), 1).to_pylist()[0]
                key = tuple(first[k] for k in keys)
                if key not in held:
                    held[key] = _Reservoir(first["__capacity"], _stream(first["__seed"], key, 0, part))
                    rows[key] = {}
                r = held[key]
                entered = r.offer(nth * (1 << 32) + at)
                if entered:
                    rows[key][nth] = (entered, b.take(pa.array([x & 0xFFFFFFFF for x in entered])))
                if sum(len(ids) for ids, _ in rows[key].values()) > 4 * r.k + 10_000:  # forget rows that have left again
                    stay = set(r.items)
                    rows[key] = {j: ([x for x in ids if x in stay], kept.filter(pa.array([x in stay for x in ids]))) for j, (ids, kept) in rows[key].items()}
        for key, r in held.items():
            items = r.rng.permutation(np.array(r.items, np.int64))
            pieces, rank = [], []
            for nth, (ids, kept) in rows[key].items():
                where = {int(x): j for j, x in enumerate(ids)}
                mine = [(pos, where[int(x)]) for pos, x in enumerate(items) if x >> 32 == nth]
                if mine:
                    pieces.append(kept.take(pa.array([j for _, j in mine])))
                    rank += [pos for pos, _ in mine]
            t = pa.Table.from_batches(pieces)
            extra = [("__part", np.full(t.num_rows, part, np.int32)), ("__n", np.full(t.num_rows, r.seen, np.int64)), ("__order", np.array(rank, np.int64))]
            for n, v in extra:
                t = t.append_column(n, pa.array(v))
            yield from t.combine_chunks().to_batches()

    return run


def _hypergeometric(keys: list[str]):
    """How many of the sample come from each partition; one row per partition of a group."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__part")
        rng = _stream(int(pdf["__seed"].iloc[0]), tuple(pdf[k].iloc[0] for k in keys), 1, len(pdf))
        n = pdf["__n"].to_numpy(np.int64)
        take, left, want = [], int(n.sum()), min(int(pdf["__capacity"].iloc[0]), int(n.sum()))
        for x in n:
            rest = left - int(x)
            got = want if rest == 0 else int(_draw_one(rng, int(x), rest, want))
            take.append(got)
            left, want = rest, want - got
        return pdf[[*keys, "__part"]].assign(__take=np.array(take, np.int64))

    return draw


def _draw_one(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """numpy's draw is limited to a billion of either kind; beyond that, the draws are made one by one."""
    if sample == 0:
        return 0
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    got = 0
    for i in range(sample):
        got += rng.random() * (good + bad - i) < good - got
    return got


def reservoir_sample(df: DataFrame, sizes: DataFrame, keys: Sequence[str], distinct_by: str | None = None, capacity: str = "capacity", seed: str = "seed") -> DataFrame:
    """A uniform sample of `capacity` rows of each group: the columns of df and population (rows, or identifiers, of the group).

    sizes has one row per group: keys, capacity, seed; of several rows for a group the largest capacity holds.
    With distinct_by the result has only keys and distinct_by, as duplicates may differ elsewhere.
    """
    keys = list(keys)
    scratch = Scratch(df.sparkSession)
    if distinct_by:
        df = df.select(*keys, distinct_by).where(F.col(distinct_by).isNotNull()).distinct()
    if "population" in df.columns:
        raise ValueError("a column is named population")
    setup = sizes.groupBy(*keys).agg(F.max(F.col(capacity).cast("long")).alias("__capacity"), F.coalesce(F.min(F.col(seed).cast("long")), F.lit(0)).alias("__seed")).where("__capacity >= 1")
    rows = join_nulls(df, maybe_broadcast(setup), keys)
    out = T.StructType([*rows.schema, T.StructField("__part", T.IntegerType()), T.StructField("__n", T.LongType()), T.StructField("__order", T.LongType())])
    held = scratch.write(rows.mapInArrow(_sample_partition(keys), out), "reservoirs")
    counts = held.groupBy(*keys, "__part").agg(F.first("__n").alias("__n"), F.first("__capacity").alias("__capacity"), F.first("__seed").alias("__seed"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    draws = counts.groupBy(*keys).applyInPandas(_hypergeometric(keys), f"{kinds}, __part int, __take long")
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("population"))
    draws = join_nulls(draws, total, keys)
    kept = join_nulls(held, maybe_broadcast(scratch.write(draws, "draws")), [*keys, "__part"]).where("__order < __take")
    return kept.select(*df.columns, "population")
