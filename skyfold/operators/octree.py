"""The octree as relations: nodes keyed by (keys, depth, prefix), samples of inner nodes, layout, and queries over cells.

A tree is built from counts, not by recursion: one shuffle counts the leaves, and all levels above follow from them.
Keys (such as the data set) come first in every table, so many trees are built at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.common import Scratch, maybe_broadcast, with_place
from skyfold.functions import morton as M
from skyfold.functions.camera import Camera
from skyfold.functions.hashing import unsigned_order, with_node_seed, with_splitmix64

#: Layout offsets are summed within the cells of this depth first, so that no task sees a whole tree.
BLOCK_DEPTH = 3


def leaf_counts(stars: DataFrame, keys: Sequence[str], leaf: str) -> DataFrame:
    return stars.groupBy(*keys, F.col(leaf).alias("prefix")).agg(F.count("*").alias("n"))


def level_counts(stars: DataFrame, keys: Sequence[str], leaf: str, depth: int) -> DataFrame:
    """Rows (keys, depth, prefix, n): the stars of every non-empty cell of every level."""
    up = leaf_counts(stars, keys, leaf).select(*keys, "prefix", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    return up.groupBy(*keys, "depth", _shift("prefix", 3 * (depth - F.col("depth"))).alias("prefix")).agg(F.sum("n").alias("n"))


def _shift(c: Column | str, bits: Column) -> Column:
    """Right shift by a column of bits."""
    return F.call_function("shiftright", F.col(c) if isinstance(c, str) else c, bits.cast("int"))


def child_masks(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, depth, prefix, child_mask) of the inner nodes: bit c is set if child c has stars."""
    child = F.col("prefix").bitwiseAND(F.lit(7).cast("long")).cast("int")
    below = counts.where("depth > 0").select(*keys, (F.col("depth") - 1).alias("depth"), F.shiftright("prefix", 3).alias("prefix"), F.call_function("shiftleft", F.lit(1), child).alias("bit"))
    return below.groupBy(*keys, "depth", "prefix").agg(F.bit_or("bit").alias("child_mask"))


def _sum_before(df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of value over all earlier rows of the same keys: within a block by a window, plus the blocks before."""
    df = df.withColumn("__b", block)
    inner = W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "__b").agg(F.sum(value).alias("__v")).select(*keys, "__b", F.coalesce(F.sum("__v").over(outer), F.lit(0)).alias("__before"))
    out = df.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(totals, [*keys, "__b"])
    return out.withColumn(name, F.col("__in") + F.col("__before")).drop("__b", "__in", "__before")


def _with_budget(df: DataFrame, keys: Sequence[str], k: int | DataFrame) -> DataFrame:
    """df with __k, how many samples a node of its tree has: a number for all trees, or rows (keys, k), one a tree."""
    if isinstance(k, int):
        return df.withColumn("__k", F.lit(k).cast("long"))
    budget = k.groupBy(*keys).agg(F.max("k").cast("long").alias("__k"))
    return df.join(maybe_broadcast(budget), list(keys), "left").withColumn("__k", F.coalesce("__k", F.lit(0).cast("long")))


def layout(stars: DataFrame, keys: Sequence[str], leaf: str, depth: int, k: int | DataFrame) -> DataFrame:
    """The node table: keys, node, depth, prefix, n, child_mask, first_child, point_first, point_count.

    Points lie in preorder; a leaf has all its stars, an inner node k samples if it covers more than k stars, else none.
    k: a number, or rows (keys, k); a tree without a row has no samples.
    Nodes are numbered by the preorder of their parents, so that the children of a node are contiguous; the root is 0.
    Counts and the table itself are written, as an index is: the walks over it read it many times.
    """
    keys, scratch = list(keys), Scratch(stars.sparkSession)
    counts = scratch.write(_with_budget(level_counts(stars, keys, leaf, depth), keys, k), "counts")
    nodes = counts.join(child_masks(counts, keys), [*keys, "depth", "prefix"], "left").withColumn("child_mask", F.coalesce("child_mask", F.lit(0)))
    nodes = nodes.withColumn("point_count", F.when(F.col("depth") == depth, F.col("n")).when(F.col("n") > F.col("__k"), F.col("__k")).otherwise(0).cast("long")).drop("__k")
    pre = F.call_function("shiftleft", F.col("prefix"), (3 * (depth - F.col("depth"))).cast("int"))
    nodes = nodes.withColumn("__pre", pre).withColumn("__up", F.call_function("shiftleft", F.shiftright("prefix", 3), (3 * (depth - F.col("depth") + 1)).cast("int")))
    far = 3 * max(0, depth - BLOCK_DEPTH)
    nodes = _sum_before(nodes, keys, F.shiftright("__pre", far), ["__pre", "depth"], F.col("point_count"), "point_first")
    nodes = nodes.withColumn("__up", F.when(F.col("depth") > 0, F.col("__up")).otherwise(F.lit(-1).cast("long")))
    nodes = _sum_before(nodes, keys, F.shiftright("__up", far), ["__up", "depth", "prefix"], F.lit(1), "node")
    nodes = scratch.write(nodes.drop("__pre", "__up"), "nodes")
    first = nodes.where("depth > 0").groupBy(*keys, (F.col("depth") - 1).alias("depth"), F.shiftright("prefix", 3).alias("prefix")).agg(F.min("node").alias("first_child"))
    nodes = nodes.join(first, [*keys, "depth", "prefix"], "left").withColumn("first_child", F.coalesce("first_child", F.lit(0)))
    return nodes.select(*keys, "node", "depth", "prefix", "n", "child_mask", "first_child", "point_first", "point_count")


def samples(stars: DataFrame, keys: Sequence[str], leaf: str, ident: str, depth: int, k: int | DataFrame | None, only: DataFrame | None = None) -> DataFrame:
    """For every inner node with more than k stars, the k whose hash under the node's seed is smallest, ties by ident.

    Adds depth, prefix, n and boost (n / k): light times boost keeps the node's total light in expectation. Ranks are
    limited before the shuffle, so a node sends at most k stars per task. k as in layout(). only: rows of the node table
    whose samples are wanted, where not all are; they say how many each has, and k isn't needed.
    """
    keys = list(keys)
    ids = [*keys, "depth", "prefix"]
    if only is None:
        counts = _with_budget(level_counts(stars, keys, leaf, depth).where(F.col("depth") < depth), keys, k).where("n > __k and __k > 0")
    else:
        counts = only.where((F.col("depth") < depth) & (F.col("point_count") > 0)).select(*ids, "n", F.col("point_count").alias("__k")).distinct()
    scratch = Scratch(stars.sparkSession)
    counts = maybe_broadcast(with_node_seed(counts, "__seed"), scratch, levels=F.collect_set("depth"), most=F.max("__k"))
    levels = sorted(scratch.seen.get("levels") or [0])  # a number per level of the tree
    up = stars.withColumn("depth", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("prefix", _shift(leaf, 3 * (depth - F.col("depth"))))
    # A star meets its big ancestors only; small nodes have no sample.
    rows = up.join(counts, ids)
    rows = with_splitmix64(rows, "__h", F.col(ident).bitwiseXOR(F.col("__seed"))).withColumn("__h", unsigned_order(F.col("__h")))
    w = W.partitionBy(*ids).orderBy("__h", ident)
    # The largest budget as a number lets the ranks be limited in each task; each tree's own follows.
    best = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= int(scratch.seen.get("most") or 1)).where(F.col("__r") <= F.col("__k"))
    return best.withColumn("boost", F.col("n") / F.col("__k")).drop("__h", "__r", "__seed", "__k")


def root_sample(stars: DataFrame, ident: str, k: int) -> DataFrame:
    """The sample of one tree's root, without a window: a bounded sort."""
    root = stars.withColumns({"__d": F.lit(0), "__p": F.lit(0).cast("long")})
    rows = with_splitmix64(with_node_seed(root, "__seed", "__d", "__p"), "__h", F.col(ident).bitwiseXOR(F.col("__seed")))
    return rows.withColumn("__h", unsigned_order(F.col("__h"))).orderBy("__h", ident).limit(k).drop("__h", "__seed", "__d", "__p")


def all_points(stars: DataFrame, keys: Sequence[str], leaf: str, ident: str, depth: int, k: int | DataFrame | None, light: str = "luminosity", only: DataFrame | None = None) -> DataFrame:
    """The point table: every star in its leaf, and the boosted samples of the inner nodes. only: as in samples()."""
    leaves = stars.withColumns({"depth": F.lit(depth), "prefix": F.col(leaf)})
    if only is not None:
        wanted = only.where(F.col("depth") == depth).select(*keys, "prefix").distinct()
        leaves = leaves.join(maybe_broadcast(wanted), [*keys, "prefix"], "left_semi").select(*leaves.columns)
    inner = samples(stars, keys, leaf, ident, depth, k, only).withColumn(light, F.col(light) * F.col("boost")).drop("boost", "n")
    return leaves.unionByName(inner)


def preorder(depth: int) -> list[Column]:
    """What a tree's points are sorted by: along the curve, a node's own before those below it."""
    return [F.call_function("shiftleft", F.col("prefix"), (3 * (depth - F.col("depth"))).cast("int")), F.col("depth")]


def with_places(points: DataFrame, keys: Sequence[str], depth: int, ident: str) -> DataFrame:
    """The point table with place: the number of each point of its tree in preorder, by ident within a node.

    A node's points are those from point_first on, point_count of them. A node of any size is spread over tasks.
    """
    return with_place(points, [*preorder(depth), ident], "place", keys)


def write_points(points: DataFrame, path: str, keys: Sequence[str], depth: int, ident: str, files: int | None = None) -> None:
    """Clustered for cell queries: a folder per depth, range-partitioned and sorted along the curve, ident last so that no cell is one task."""
    curve, _ = preorder(depth)
    by = ["depth", *keys, "__o", ident]
    ordered = points.withColumn("__o", curve)
    ordered = ordered.repartitionByRange(files, *by) if files else ordered.repartitionByRange(*by)
    ordered.sortWithinPartitions(*by).drop("__o").write.partitionBy("depth").parquet(path)


def ancestors(nodes: DataFrame, keys: Sequence[str], self_too: bool = False) -> DataFrame:
    """Every node with each of its ancestors: keys, depth, prefix and adepth, aprefix."""
    some = nodes if self_too else nodes.where("depth > 0")
    last = F.col("depth") if self_too else F.col("depth") - 1
    up = some.withColumn("adepth", F.explode(F.sequence(F.lit(0), last)))
    return up.withColumn("aprefix", _shift("prefix", 3 * (F.col("depth") - F.col("adepth"))))


def subtree_counts(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, depth, prefix, subtree_points): points stored at a node and below it."""
    up = ancestors(nodes.select(*keys, "depth", "prefix", "point_count"), keys, self_too=True)
    return up.groupBy(*keys, F.col("adepth").alias("depth"), F.col("aprefix").alias("prefix")).agg(F.sum("point_count").alias("subtree_points"))


def with_view(nodes: DataFrame, camera: Camera, half: float, pixels: float) -> DataFrame:
    """Adds seen (the box meets the view), footprint (pixels) and terminal (a leaf, or small and sampled)."""
    out = M.with_bounds(nodes, half).withColumns({"seen": camera.sees_box(M.box()), "footprint": camera.footprint(M.box())}).drop(*M.box())
    return out.withColumn("terminal", (F.col("child_mask") == 0) | ((F.col("footprint") < pixels) & (F.col("point_count") > 0)))


def lod_cut(viewed: DataFrame, keys: Sequence[str], seen_only: bool = True) -> DataFrame:
    """The nodes at which a walk from the root stops: terminal, with points, and below no other terminal node."""
    keys = list(keys)
    ends = viewed.where("terminal and point_count > 0" + (" and seen" if seen_only else ""))
    stops = viewed.where("terminal and child_mask <> 0").select(*keys, F.col("depth").alias("adepth"), F.col("prefix").alias("aprefix"))
    # All ancestors count, not just the parent: below a terminal node the next ones may have no points.
    below = ancestors(ends.select(*keys, "depth", "prefix"), keys).join(maybe_broadcast(stops), [*keys, "adepth", "aprefix"], "left_semi")
    return ends.join(below.select(*keys, "depth", "prefix").distinct(), [*keys, "depth", "prefix"], "left_anti")


def wanted_nodes(viewed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a client loads: the cut, wherever it looks, and the sampled nodes passed on the way; priority is the footprint."""
    keys = list(keys)
    cut = lod_cut(viewed, keys, seen_only=False)
    way = ancestors(cut.select(*keys, "depth", "prefix"), keys, self_too=True).select(*keys, F.col("adepth").alias("depth"), F.col("aprefix").alias("prefix")).distinct()
    return viewed.where("point_count > 0").join(way, [*keys, "depth", "prefix"], "left_semi").withColumn("priority", F.col("footprint"))


def _greedy(keys: Sequence[str], cap: int):
    """A number for each row's batch: rows of a run, in order, until the next one would pass the cap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, batch, held = None, 0, 0
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in [*keys, "__run"]]
            out = []
            for *key, n in zip(*cols, b.column(b.schema.get_field_index("point_count")).to_pylist()):
                if key != at:
                    at, batch, held = key, 0, n
                elif held + n > cap:
                    batch, held = batch + 1, n
                else:
                    held += n
                out.append(batch)
            yield b.append_column("__batch", pa.array(out, pa.int64()))

    return run


def fetch_batches(wanted: DataFrame, keys: Sequence[str], point_bytes: int, most_bytes: int) -> DataFrame:
    """Wanted nodes whose points adjoin are read together: keys, first, points, nodes, priority of each batch.

    A batch takes the next node of its run as long as it stays within most_bytes; a larger node is a batch of its own.
    Runs are found by a window, and each is walked in order by one task, in Arrow batches.
    """
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy("point_first", "depth")
    gap = F.coalesce((F.lag(F.col("point_first") + F.col("point_count")).over(w) != F.col("point_first")).cast("int"), F.lit(1))
    rows = wanted.select(*keys, "point_first", "depth", "point_count", "priority").withColumn("__gap", gap).withColumn("__run", F.sum("__gap").over(w)).drop("__gap")
    ordered = rows.repartition(*keys, "__run").sortWithinPartitions(*keys, "__run", "point_first", "depth")
    rows = ordered.mapInArrow(_greedy(keys, most_bytes // point_bytes), T.StructType([*rows.schema, T.StructField("__batch", T.LongType())]))
    return rows.groupBy(*keys, "__run", "__batch").agg(
        F.min("point_first").alias("first"), F.sum("point_count").alias("points"), F.count("*").alias("nodes"), F.max("priority").alias("priority")
    ).drop("__run", "__batch")


def next_fetches(batches: DataFrame, keys: Sequence[str], slots: int) -> DataFrame:
    """The batches that a client asks for now: by falling priority, as many of each tree as it has free slots; order from 1."""
    w = W.partitionBy(*keys).orderBy(F.desc("priority"), "first")
    return batches.withColumn("order", F.row_number().over(w)).where(F.col("order") <= slots)


def code_ranges(low: Sequence[float], high: Sequence[float], half: float, depth: int, most: int = 64) -> list[tuple[int, int]]:
    """At most `most` ranges of leaf codes, both ends included, that hold every cell meeting the box low..high; coarse where it is large.

    Cells that the box cuts are divided, the largest first, until they would be too many; ranges that adjoin are joined.
    """
    cells, whole = [(0, 0, (-half,) * 3)], []
    while cells:
        d, code, corner = cells[0]
        side = 2 * half / (1 << d)
        if d == depth or len(cells) + len(whole) + 7 > most or all(lo <= c and c + side <= hi for c, lo, hi in zip(corner, low, high)):
            whole.append((d, code))
            cells.pop(0)
            continue
        cells.pop(0)
        for child in range(8):
            at = tuple(c + side / 2 * ((child >> axis) & 1) for axis, c in enumerate(corner))
            if all(c <= hi and c + side / 2 >= lo for c, lo, hi in zip(at, low, high)):
                cells.append((d + 1, code << 3 | child, at))
    out: list[tuple[int, int]] = []
    for a, z in sorted((code << 3 * (depth - d), ((code + 1) << 3 * (depth - d)) - 1) for d, code in whole):
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def box_query(stars: DataFrame, code: str, depth: int, half: float, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Stars with low <= (x, y, z) <= high.

    Ranges of codes of the cells that the box meets reach the scan, which skips row groups of a table in the order of
    the curve (write_points); stars without a code are looked at one by one.
    """
    inside = reduce(lambda a, b: a & b, [F.col(c).cast("double").between(lo, hi) for c, lo, hi in zip("xyz", low, high)])
    # Stored codes come from single precision, so the cells are those that a hair larger box meets.
    hair = half * 1e-6
    ranges = code_ranges([v - hair for v in low], [v + hair for v in high], half, depth)
    near = reduce(lambda a, b: a | b, [F.col(code).between(a, z) for a, z in ranges], F.col(code).isNull())
    return stars.where(near & inside)


def cells_in_box(cells: DataFrame, half: float, depth: int, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Leaf cells (prefix) that the box meets or touches, by their numbers along each axis."""
    ranges = [M.axis_cells(lo, hi, -half, half, depth) for lo, hi in zip(low, high)]
    inside = reduce(lambda a, b: a & b, [c.between(*r) for c, r in zip(M.deinterleave("prefix", depth), ranges)])
    return cells.where(inside)


def radius_query(stars: DataFrame, code: str, depth: int, half: float, centre: Sequence[float], radius: float) -> DataFrame:
    """Stars within radius of centre, those at exactly the radius included; pruned as box_query, then exact."""
    box = box_query(stars, code, depth, half, [c - radius for c in centre], [c + radius for c in centre])
    sq = reduce(lambda a, b: a + b, [(F.col(a).cast("double") - c) * (F.col(a).cast("double") - c) for a, c in zip("xyz", centre)])
    return box.withColumn("distance", F.sqrt(sq)).where(F.col("distance") <= radius)


def cells_meeting_sphere(nodes: DataFrame, half: float, centre: Sequence[float], radius: float) -> DataFrame:
    """Nodes whose box comes within radius of centre."""
    gaps = [F.greatest(F.col(f"{a}0") - c, c - F.col(f"{a}1"), F.lit(0.0)) for a, c in zip("xyz", centre)]
    return M.with_bounds(nodes, half).where(reduce(lambda a, b: a + b, [F.pow(g, F.lit(2.0)) for g in gaps]) <= radius * radius).drop(*M.box())


def cache_delta(wanted: DataFrame, cached: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a client does with its nodes when the view changes: rows (keys, depth, prefix, action) with fetch, keep or evict."""
    ids = [*keys, "depth", "prefix"]
    new, old = (df.select(*ids).distinct().withColumn(c, F.lit(1)) for df, c in ((wanted, "__new"), (cached, "__old")))
    action = F.when(F.col("__old").isNull(), "fetch").when(F.col("__new").isNull(), "evict").otherwise("keep")
    return new.join(old, ids, "full_outer").select(*ids, action.alias("action"))


def load_progress(wanted: DataFrame, cached: DataFrame, pending: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, cached, in_flight, total): how many of the wanted nodes are there, and how many are on their way."""
    ids = [*keys, "depth", "prefix"]
    mark = lambda df, c: df.select(*ids).distinct().withColumn(c, F.lit(1))
    state = wanted.select(*ids).distinct().join(mark(cached, "__c"), ids, "left").join(mark(pending, "__p"), ids, "left")
    return state.groupBy(*keys).agg(F.count("__c").alias("cached"), F.count(F.when(F.col("__c").isNull(), F.col("__p"))).alias("in_flight"), F.count("*").alias("total"))


def cached_cut(cut: DataFrame, cached: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For every node the nodes of the cut at and below it: total, cached, their points and the sum of the cached nodes' numbers."""
    ids = [*keys, "depth", "prefix"]
    mine = cut.join(cached.select(*ids).distinct().withColumn("__c", F.lit(1)), ids, "left")
    up = ancestors(mine, keys, self_too=True)
    own = F.col("__c").isNotNull()
    return up.groupBy(*keys, F.col("adepth").alias("depth"), F.col("aprefix").alias("prefix")).agg(
        F.count("*").alias("total"), F.count("__c").alias("cached"), F.sum("point_count").alias("points"),
        F.coalesce(F.sum(F.when(own, F.col("point_count"))), F.lit(0)).alias("cached_points"), F.coalesce(F.sum(F.when(own, F.col("node"))), F.lit(0)).alias("token"),
    )


def chunks(viewed: DataFrame, cached: DataFrame, keys: Sequence[str], merge_pixels: float, most_points: int) -> DataFrame:
    """What a client draws: cached nodes of the cut, merged into chunks (keys, depth, prefix, nodes, points, token) named by a node.

    A walk stops at the ends of the cut and at inner nodes below merge_pixels. Such a node is whole if all of the cut
    below it is cached; otherwise what is cached there is a chunk. A larger node is whole if all its children are and
    they have at most most_points together; with more, it is a chunk itself; and where some child isn't whole, each child
    that is becomes a chunk. A whole root is one. Points only grow upwards, so this needs no walk: a larger node is whole
    just if it has at most most_points and everything at which the walk stops below it is whole.
    """
    keys, scratch = list(keys), Scratch(viewed.sparkSession)
    ids, up = [*keys, "depth", "prefix"], [*keys, "adepth", "aprefix"]
    end = F.col("terminal") | (F.col("footprint") < merge_pixels)
    # Nodes that the walk reaches: no ancestor ends it.
    ends = viewed.where(end & (F.col("child_mask") != 0)).select(*keys, F.col("depth").alias("adepth"), F.col("prefix").alias("aprefix"))
    below = ancestors(viewed.select(*ids), keys).join(maybe_broadcast(ends, scratch), up, "left_semi").select(*ids).distinct()
    sums = cached_cut(lod_cut(viewed, keys, seen_only=False), cached, keys)
    walked = viewed.select(*ids, end.alias("end"), "terminal").join(below, ids, "left_anti").join(sums, ids, "left").na.fill(0, ["total", "cached", "points", "cached_points", "token"])
    walked = scratch.write(walked.withColumn("full", F.col("total") == F.col("cached")), "walked")
    short = ancestors(walked.where("end and not full").select(*ids), keys, self_too=True).select(*keys, F.col("adepth").alias("depth"), F.col("aprefix").alias("prefix")).distinct()
    state = walked.join(short.withColumn("__short", F.lit(True)), ids, "left")
    state = scratch.write(state.withColumn("whole", F.col("__short").isNull() & (F.col("end") | (F.col("points") <= most_points))).drop("__short"), "state")
    broken = state.where("not whole and depth > 0").select(*keys, (F.col("depth") - 1).alias("depth"), F.shiftright("prefix", 3).alias("prefix")).distinct().withColumn("__broken", F.lit(True))
    state = state.join(broken, ids, "left")
    parents = state.where("__broken").select(*keys, (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("__up"))
    of_parent = state.withColumn("__up", F.shiftright("prefix", 3)).join(parents, [*keys, "depth", "__up"], "left_semi").where("whole")
    alone = state.where("(not whole and end) or (not whole and not end and __broken is null) or (whole and depth = 0)")
    out = alone.select(*ids, "cached", "cached_points", "token").unionByName(of_parent.select(*ids, "cached", "cached_points", "token"))
    return out.where("cached_points > 0").select(*ids, F.col("cached").alias("nodes"), F.col("cached_points").alias("points"), "token")


def changed_chunks(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From one frame to the next: chunks to send, as they are new or have another token, and chunks to drop."""
    ids = [*keys, "depth", "prefix"]
    a, b = before.select(*ids, F.col("token").alias("__old")), after.select(*ids, F.col("token").alias("__new"), "points")
    both = a.join(b, ids, "full_outer").where(~F.col("__old").eqNullSafe(F.col("__new")))
    return both.select(*ids, F.when(F.col("__new").isNull(), "drop").otherwise("send").alias("action"), F.coalesce("points", F.lit(0)).alias("points"))
