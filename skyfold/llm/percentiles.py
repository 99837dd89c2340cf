"""Percentiles per group by distributed multi-select.

Values stay where they were read, as sorted blocks of one group each. In a round every block proposes its local median
of each open range, and of the range's halves and quarters, and the weighted medians of the proposals become pivots.
Then every block counts its values below, at and above each pivot; the counts' sums tell a rank's value, or the part
between two pivots where it lies, and all else is ruled out. Ranks of one range share its pivots and counts. Only
proposals and counts are shuffled. Every group goes through rounds until a rank is found or at most CUTOFF values of its
range are left, which are gathered and read off; so the result is exact (nearest rank: the smallest value that at least
the share p of the values doesn't exceed).

Defined cases: null and NaN values don't count; infinities do, as the ends of the order; null keys form a group; a group
without values has no row; repeated rows and ties count each; an empty table gives an empty result; columns other than
keys and fields are ignored. Key names that begin with two underscores, and keys named field or p, raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyfold.common import BROADCAST_BYTES, BROADCAST_ROWS, Scratch, join_nulls, row_bytes

#: Values of a range that are read off once a round has narrowed it.
CUTOFF = 1024
FLUSH_ROWS = 262_144
#: Halvings of a range that give the local proposals: medians of the range, its halves and its quarters.
HALVINGS = 3
PIVOTS = (1 << HALVINGS) - 1


def _check_keys(keys: Sequence[str]) -> None:
    if bad := [k for k in keys if k.startswith("__") or k in ("field", "p")]:
        raise ValueError(f"reserved key names: {bad}")


def _ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def sorted_blocks(df: DataFrame, keys: Sequence[str], fields: Mapping[str, Column], weight: Column | None = None) -> DataFrame:
    """Blocks (keys, field, __vals ascending, __wts, __n) made where the rows are, without a shuffle. Blocks of parts may be united."""
    _check_keys(keys)
    names = list(fields)
    cols = [F.col(k) for k in keys] + [c.cast("double").alias(f"__f_{n}") for n, c in fields.items()]
    cols += [(weight if weight is not None else F.lit(1)).cast("long").alias("__w")]
    weighted = weight is not None

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        for n in names:
            t = whole.select([*keys, f"__f_{n}", "__w"]).rename_columns([*keys, "__v", "__w"])
            t = t.filter(pc.and_(pc.fill_null(pc.invert(pc.is_nan(t["__v"])), False), pc.greater(t["__w"], 0)))
            if not t.num_rows:
                continue
            t = t.sort_by("__v")
            if not keys:
                t = t.append_column("__all", pa.array(np.zeros(t.num_rows, np.int8)))
            g = t.group_by([*keys] if keys else ["__all"], use_threads=False).aggregate([("__v", "list"), ("__w", "list"), ("__w", "sum")])
            out = {k: g[k] for k in keys} | {"field": pa.array([n] * g.num_rows), "__vals": g["__v_list"], "__wts": g["__w_list"] if weighted else pa.nulls(g.num_rows, pa.list_(pa.int64())), "__n": g["__w_sum"]}
            yield from pa.table(out).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= FLUSH_ROWS:
                yield from flush(held)
                held, rows = [], 0
        if held:
            yield from flush(held)

    schema = ", ".join(filter(None, [_ddl(df, keys), "field string, __vals array<double>, __wts array<bigint>, __n bigint"]))
    return df.select(*cols).mapInArrow(run, schema)


class _Blocks:
    """The blocks of a batch laid end to end, with the ranges that concern each: pair i is block pair_block[i] and a range."""

    def __init__(self, b: pa.RecordBatch):
        self.batch = b
        vals = self.column("__vals")
        self.values, self.starts = vals.flatten().to_numpy(), np.concatenate([[0], np.cumsum(vals.value_lengths().to_numpy().astype(np.int64))])
        wts = self.column("__wts")
        self.weights = None if wts.null_count == len(wts) else wts.flatten().to_numpy()
        self.cum = None if self.weights is None else np.concatenate([[0], np.cumsum(self.weights)])
        n = self.column("__rng").value_lengths().to_numpy().astype(np.int64)
        self.block = np.repeat(np.arange(b.num_rows), n)
        lo, hi = (self.column(c).flatten().to_numpy() for c in ("__lo", "__hi"))
        # The values of a pair are those between its range's ends, both left out; NaN is no end.
        self.a = np.where(np.isnan(lo), self.starts[self.block], self.search(self.block, lo, "right"))
        self.z = np.where(np.isnan(hi), self.starts[self.block + 1], self.search(self.block, hi, "left"))

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def search(self, block: np.ndarray, wanted: np.ndarray, side: str) -> np.ndarray:
        """np.searchsorted in many blocks at once: where each wanted value belongs in its block."""
        low, high = self.starts[block].copy(), self.starts[block + 1].copy()
        while (busy := np.flatnonzero(low < high)).size:
            mid = (low[busy] + high[busy]) >> 1
            v = self.values[mid]
            after = v <= wanted[busy] if side == "right" else v < wanted[busy]
            low[busy] = np.where(after, mid + 1, low[busy])
            high[busy] = np.where(after, high[busy], mid)
        return low

    def weight(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return z - a if self.cum is None else self.cum[z] - self.cum[a]

    def keyed(self, keys: Sequence[str], pairs: np.ndarray, cols: dict[str, pa.Array]) -> pa.RecordBatch:
        at = pa.array(self.block[pairs])
        own = [self.column(k).take(at) for k in [*keys, "field"]]
        return pa.RecordBatch.from_arrays([*own, self.column("__rng").flatten().take(pa.array(pairs)), *cols.values()], names=[*keys, "field", "__rng", *cols])


def _list_of(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _propose(keys: Sequence[str]):
    """Per block and range, the local medians of the range and of its parts, with the weight of the block's values there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Blocks(b)
            pairs = np.flatnonzero(x.a < x.z)
            a, n = x.a[pairs][:, None], (x.z - x.a)[pairs][:, None]
            at = a + n * np.arange(1, PIVOTS + 1)[None, :] // (PIVOTS + 1)
            yield x.keyed(keys, pairs, {"__w": pa.array(x.weight(x.a[pairs], x.z[pairs])), "__m": _list_of(x.values[at])})

    return run


def _count_three_ways(keys: Sequence[str]):
    """Per block and range: the weight below and at each pivot, within the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Blocks(b)
            pivots = x.column("__pivots").flatten().flatten().to_numpy()
            pairs = np.flatnonzero(x.a < x.z)
            each = np.repeat(pairs, PIVOTS)
            mine = pivots.reshape(-1, PIVOTS)[pairs].ravel()
            p, q = x.search(x.block[each], mine, "left"), x.search(x.block[each], mine, "right")
            below, at = x.weight(x.a[each], np.maximum(p, x.a[each])), x.weight(p, q)
            own = {"__pivots": _list_of(pivots.reshape(-1, PIVOTS)[pairs])}
            yield x.keyed(keys, pairs, own | {"__lt": _list_of(below.reshape(-1, PIVOTS)), "__eq": _list_of(at.reshape(-1, PIVOTS))})

    return run


def _cut_out(keys: Sequence[str]):
    """Per block and range the values (and weights) in the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Blocks(b)
            pairs = np.flatnonzero(x.a < x.z)
            n = (x.z - x.a)[pairs]
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
            at = np.arange(ends[-1]) + np.repeat(x.a[pairs] - ends[:-1], n)
            offsets = pa.array(ends, pa.int32())
            wts = pa.nulls(len(pairs), pa.list_(pa.int64())) if x.weights is None else pa.ListArray.from_arrays(offsets, pa.array(x.weights[at]))
            yield x.keyed(keys, pairs, {"__vals": pa.ListArray.from_arrays(offsets, pa.array(x.values[at])), "__wts": wts})

    return run


def _trim(keys: Sequence[str], names: Sequence[str]):
    """The blocks without the values that no range of their group holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Blocks(b)
            keep = np.zeros(len(x.values) + 1, np.int64)
            np.add.at(keep, x.a, 1)
            np.add.at(keep, np.maximum(x.a, x.z), -1)
            stays = np.cumsum(keep)[:-1] > 0
            n = np.add.reduceat(np.append(stays, False), x.starts[:-1]) if b.num_rows else np.zeros(0, np.int64)
            n = np.where(x.starts[1:] > x.starts[:-1], n, 0)
            rows = np.flatnonzero(n)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n[rows])]), pa.int32())
            wts = pa.nulls(len(rows), pa.list_(pa.int64())) if x.weights is None else pa.ListArray.from_arrays(offsets, pa.array(x.weights[stays]))
            weight = np.concatenate([[0], np.cumsum(stays if x.weights is None else np.where(stays, x.weights, 0))])
            own = [x.column(k).take(pa.array(rows)) for k in [*keys, "field"]]
            total = pa.array((weight[x.starts[1:]] - weight[x.starts[:-1]])[rows])
            yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(offsets, pa.array(x.values[stays])), wts, total], names=list(names))

    return run


def _read_off(keys: Sequence[str]):
    """The wanted values of what is left of each range: rows (keys, field, p, value, rank, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c))
            vals, wts, ranks = (get(c) for c in ("__vals", "__wts", "__rank"))
            n, m = vals.value_lengths().to_numpy().astype(np.int64), ranks.value_lengths().to_numpy().astype(np.int64)
            v, row = vals.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), n)
            order = np.lexsort((v, row))
            w = np.ones(len(v), np.int64) if len(wts.flatten()) != len(v) else wts.flatten().to_numpy()[order]
            cum = np.cumsum(w)
            starts = np.concatenate([[0], np.cumsum(n)])[:-1]
            before = np.concatenate([[0], cum])[starts]
            at = np.repeat(np.arange(b.num_rows), m)
            # Running weights rise through all rows, so one search serves them all.
            found = v[order][np.searchsorted(cum, before[at] + ranks.flatten().to_numpy(), "left")]
            own = [get(k).take(pa.array(at)) for k in [*keys, "field"]]
            yield pa.RecordBatch.from_arrays([*own, get("p").flatten(), pa.array(found), get("rank").flatten(), get("n").take(pa.array(at))], names=[*keys, "field", "p", "value", "rank", "n"])

    return run


def select_ranks(blocks: DataFrame, keys: Sequence[str], shares: Mapping[str, Sequence[float]], scratch: Scratch | None = None) -> DataFrame:
    """Exact percentiles of sorted_blocks: rows (keys, field, p, value, rank, n) for each group, field and share p.

    The state has one row per open range of a group: its ends, the weight in it and the ranks that are sought in it.
    """
    spark = blocks.sparkSession
    scratch = scratch or Scratch(spark)
    keys = list(keys)
    names = [*keys, "field"]
    kddl = "".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}, " for k in keys)
    rddl = f"{kddl}field string, __rng bigint, "
    out = f"{kddl}field string, p double, value double, rank bigint, n bigint"
    blocks, stored = scratch.write(blocks, "blocks-0"), "blocks-0"

    def met(state: DataFrame, few: bool, *more: str) -> DataFrame:
        """The blocks with the ranges of their groups, as arrays."""
        cols = ["__rng", "__lo", "__hi", *more]
        ranges = state.groupBy(*names).agg(F.collect_list(F.struct(*cols)).alias("__s"))
        ranges = ranges.select(*names, *[F.col(f"__s.{c}").alias(c) for c in cols])
        return join_nulls(blocks, F.broadcast(ranges) if few else ranges, names)

    def middle(at: int) -> Column:
        """The weighted median of the proposals; the largest where it lies between two infinities."""
        value = F.get("__m", F.lit(at))
        m = F.percentile(value, F.lit(0.5), F.col("__w"))
        return F.coalesce(F.nanvl(m, F.lit(None).cast("double")), F.max(value))

    n = F.sum("__n")
    wanted = F.coalesce(F.lit(None).cast("array<double>"), *[F.when(F.col("field") == f, F.array(*[F.lit(float(p)) for p in ps]).cast("array<double>")) for f, ps in shares.items()])
    groups = blocks.groupBy(*names).agg(n.alias("n")).withColumn("__p", wanted).where("size(__p) > 0")
    rank = lambda p: F.greatest(F.lit(1), (F.col("n") - F.floor(F.col("n") - p * F.col("n"))).cast("long"))
    sought = F.transform("__p", lambda p: F.struct(p.alias("p"), rank(p).alias("rank"), rank(p).alias("__rank")))
    nan = F.lit(float("nan"))
    state = groups.select(*names, F.lit(1).cast("long").alias("__rng"), nan.alias("__lo"), nan.alias("__hi"), F.col("n").alias("__left"), "n", sought.alias("__sought"))
    size = lambda df, some=F.lit(True), n="": {f"ranges{n}": F.count_if(some), f"bytes{n}": F.coalesce(F.sum(F.when(some, row_bytes(df))), F.lit(0)), f"left{n}": F.coalesce(F.sum(F.when(some, F.col("__left"))), F.lit(0))}
    fits = lambda ranges, held: ranges <= BROADCAST_ROWS and held + ranges * 8 * PIVOTS <= BROADCAST_BYTES
    busy = scratch.write(state, "state-0", **size(state))
    seen = {"ranges": 0, "bytes": 0, "left": 0} | scratch.seen
    ready, found, k, held, done = [], [], 0, seen["left"], dict.fromkeys(("ranges", "bytes", "left"), 0)
    while seen["ranges"]:
        k += 1
        few = fits(seen["ranges"], seen["bytes"])
        votes = met(busy, few).mapInArrow(_propose(keys), rddl + "__w bigint, __m array<double>")
        pivots = votes.groupBy(*names, "__rng").agg(F.array(*[middle(i) for i in range(PIVOTS)]).alias("__pivots"))
        aimed = join_nulls(busy.select(*names, "__rng", "__lo", "__hi"), F.broadcast(pivots) if few else pivots, [*names, "__rng"])
        counts = met(aimed, few, "__pivots").mapInArrow(_count_three_ways(keys), rddl + "__pivots array<double>, __lt array<bigint>, __eq array<bigint>")
        sums = counts.groupBy(*names, "__rng").agg(F.first("__pivots").alias("__pivots"), *[F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(PIVOTS)]).alias(c) for c in ("__lt", "__eq")])
        one = join_nulls(sums, F.broadcast(busy) if few else busy, [*names, "__rng"]).select("*", F.explode("__sought").alias("__s"))
        # The first pivot with as many values at or below it: the rank is that pivot, or lies just before it.
        one = one.withColumn("__le", F.zip_with("__lt", "__eq", lambda x, y: x + y)).withColumn("__at", F.size(F.filter("__le", lambda x: x < F.col("__s.__rank"))))
        here, before = F.col("__at"), F.col("__at") - 1
        passed = F.when(here > 0, F.get("__le", before)).otherwise(0)
        hit = (here < PIVOTS) & (F.get("__lt", here) < F.col("__s.__rank"))
        one = one.select(
            *names, "n", F.col("__rng").alias("__old"), here.alias("__at"), F.col("__s.p").alias("p"), F.col("__s.rank").alias("rank"), F.when(hit, F.get("__pivots", here)).alias("value"),
            F.when(here > 0, F.get("__pivots", before)).otherwise(F.col("__lo")).alias("__lo"), F.when(here < PIVOTS, F.get("__pivots", here)).otherwise(F.col("__hi")).alias("__hi"),
            (F.when(here < PIVOTS, F.get("__lt", here)).otherwise(F.col("__left")) - passed).alias("__left"), (F.col("__s.__rank") - passed).alias("__rank"),
        )
        # A rank lies in one range only, so the least one names the range. A found value is a range of its own, with nothing left.
        parts = one.groupBy(*names, "__old", "__at", F.col("value").isNotNull().alias("__hit")).agg(
            F.min("rank").alias("__rng"), *[F.first(c).alias(c) for c in ("value", "__lo", "__hi", "__left", "n")], F.collect_list(F.struct("p", "rank", "__rank")).alias("__sought"))
        parts = parts.select(*names, "__rng", "__lo", "__hi", F.when(~F.col("__hit"), F.col("__left")).alias("__left"), "n", "__sought", "value")
        small = F.col("__left") <= CUTOFF
        parts = scratch.write(parts, f"state-{k}", **size(parts, ~small), **size(parts, small, "_done"))
        seen = dict.fromkeys(seen, 0) | scratch.seen
        found.append(parts.where("__left is null").select(*names, "value", "n", F.inline("__sought")).select(*names, "p", "value", "rank", "n"))
        ready.append(parts.where(small).drop("value"))
        busy = parts.where(~small).drop("value")
        done = {c: done[c] + seen.get(f"{c}_done", 0) for c in done}
        if seen["ranges"] and (seen["left"] + done["left"]) * 4 < held:
            everything = reduce(DataFrame.unionByName, [*ready, busy])
            few = fits(seen["ranges"] + done["ranges"], seen["bytes"] + done["bytes"])
            blocks = scratch.write(met(everything, few).mapInArrow(_trim(keys, blocks.columns), blocks.schema), f"blocks-{k}")
            scratch.drop(stored)
            stored, held = f"blocks-{k}", seen["left"] + done["left"]
    if not found:
        return spark.createDataFrame([], out)
    last = reduce(DataFrame.unionByName, ready)
    left = met(last, fits(done["ranges"], done["bytes"])).mapInArrow(_cut_out(keys), rddl + "__vals array<double>, __wts array<bigint>")
    left = left.groupBy(*names, "__rng").agg(F.flatten(F.collect_list("__vals")).alias("__vals"), F.flatten(F.collect_list(F.coalesce("__wts", F.array().cast("array<bigint>")))).alias("__wts"))
    read = join_nulls(left, last.select(*names, "__rng", "n", *[F.col(f"__sought.{c}").alias(c) for c in ("p", "rank", "__rank")]), [*names, "__rng"])
    read = read.select(*names, "__vals", "__wts", "__rank", "p", "rank", "n").mapInArrow(_read_off(keys), out)
    return reduce(DataFrame.unionByName, [*found, read])


def percentiles(df: DataFrame, keys: Sequence[str], fields: Mapping[str, Column], shares: Mapping[str, Sequence[float]]) -> DataFrame:
    """Exact percentiles per group, see the module: rows (keys, field, p, value, rank, n)."""
    return select_ranks(sorted_blocks(df, keys, fields), keys, shares)


def summarize(df: DataFrame, keys: Sequence[str], part: Sequence[str], fields: Mapping[str, Column], points: int = 50) -> DataFrame:
    """For each group and part (a day, a dataset), at most `points` values at evenly spaced ranks with the rows each stands for.

    Summaries of different parts can be united and read by combine(); a rank is then off by at most one part in `points`
    of all rows, as each kept value stands for at most that share of its part.
    """
    all_keys = [*keys, *part]
    found = percentiles(df, all_keys, fields, {f: [(i + 1) / points for i in range(points)] for f in fields})
    # Of equal ranks (parts with fewer rows than points) one is kept; a value stands for the ranks since the one before.
    once = found.repartition(*all_keys, "field").groupBy(*all_keys, "field", "rank").agg(F.first("value").alias("value"))
    w = W.partitionBy(*all_keys, "field").orderBy("rank")
    return once.select(*all_keys, "field", "value", (F.col("rank") - F.coalesce(F.lag("rank").over(w), F.lit(0))).alias("weight"))


def combine(summaries: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Percentiles of the whole from united summaries of its parts, by the same selection over weighted values."""
    blocks = sorted_blocks(summaries.withColumnRenamed("field", "of"), [*keys, "of"], {"value": F.col("value")}, F.col("weight"))
    return select_ranks(blocks, [*keys, "of"], {"value": shares}).drop("field").withColumnRenamed("of", "field")
