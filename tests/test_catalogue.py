"""The reference's own test cases and the set-based operators against literal ones."""

import math
import random
import struct

import numpy as np
import pytest
from helpers import agree
from pyspark.sql import functions as F

from skyfold.common import Scratch
from skyfold.functions import astro as A
from skyfold.functions import morton as M
from skyfold.functions import motion
from skyfold.functions.camera import Camera, cross, dot, galactic_axes, galactic_view, unit
from skyfold.functions.hashing import FIRST, SECOND, STEP, with_splitmix64
from skyfold.operators import manifest as L
from skyfold.operators import octree as T
from skyfold.operators import raster as R
from skyfold.plans import ingest, tree, views
from skyfold.sources import binary, images, labels, listing
from skyfold.sources.csv_files import file_checksums, read_catalogue
from skyfold.streaming import cache
from skyfold.streaming.views import VIEW, accepted_view_stream, accepted_views, view_events


@pytest.mark.parametrize("name", [*ingest.SQL, *tree.SQL])
def test_query_agrees_with_sql(spark, sf, duck, name):
    q, s = (ingest.QUERIES, ingest.SQL) if name in ingest.SQL else (tree.QUERIES, tree.SQL)
    agree(spark, sf, duck, q[name], s[name])


@pytest.mark.parametrize("name", list(views.SQL))
def test_view_agrees_with_sql(spark, sf, duck, name):
    agree(spark, sf, duck, views.QUERIES[name], views.SQL[name])


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_quality(spark):
    q = lambda p, e: A.parallax_quality(F.lit(p).cast("double"), F.lit(e).cast("double"))
    r = one(spark, a=q(1.0, 0.001), b=q(1.0, 0.2), c=q(-1.0, 0.2), d=q(1.0, None), e=q(float("nan"), 1.0), f=q(1.0, float("inf")), g=q(0.0, 1.0))
    assert r.a == pytest.approx(100) and r.b == pytest.approx(5) and all(r[k] is None for k in "cdefg")


def test_positions_and_light(spark):
    x, y, z = A.cartesian(F.lit(90.0), F.lit(0.0), F.lit(100.0))
    r = one(spark, x=x, y=y, z=z, l=A.luminosity(F.lit(100.0), F.lit(4.67)), n=A.luminosity(F.lit(100.0), F.lit(None).cast("double")), m=A.luminosity(F.lit(-1.0), F.lit(4.0)))
    assert (r.x, r.y, r.z) == pytest.approx((0, 10, 0), abs=1e-9) and r.l == pytest.approx(1.0) and r.n is None and r.m is None


def test_colour_and_tone(spark):
    c = lambda v: F.array(*A.colour(F.lit(v).cast("double")))
    r = one(spark, blue=c(-9.0), red=c(9.0), none=c(None), nan=c(float("nan")), t=A.tone(F.lit(1.0)), big=A.tone(F.lit(1e12)), zero=A.tone(F.lit(0.0)))
    assert list(r.blue) == [0.6, 0.7, 1.0] and list(r.red) == pytest.approx([1.0, 0.3, 0.1]) and list(r.none) == list(r.nan) == [1, 1, 1]
    assert (r.t, r.big, r.zero) == (math.floor(255 * 0.5 ** (1 / 2.2) + 0.5), 255, 0)


def test_morton_round_trip(spark):
    cells = [(3, 17, 42), (127, 126, 125), (0, 0, 0), (1023, 1023, 1023)]
    df = spark.createDataFrame(cells, "x long, y long, z long").withColumn("m", M.interleave("x", "y", "z", 10))
    for r in df.select("*", *[c.alias(n) for c, n in zip(M.deinterleave("m", 10), ("a", "b", "c"))]).collect():
        assert (r.a, r.b, r.c) == (r.x, r.y, r.z)


def test_cells_and_their_boxes(spark):
    edge = math.nextafter(20000.0, 0)
    pts = [(0.0, 0.0, 0.0), (edge, -20000.0, 20000.0), (20000.1, 0.0, 0.0), (float("nan"), 0.0, 0.0), (None, 0.0, 0.0)]
    df = M.with_cell(spark.createDataFrame(pts, "x double, y double, z double"), "leaf", "x", "y", "z", 20000.0, 7)
    rows = M.with_bounds(df.withColumn("depth", F.lit(7)), 20000.0, "depth", "leaf").collect()
    assert [r.leaf is None for r in rows] == [False, False, True, True, True]
    for r in rows[:2]:
        assert all(r[f"{a}0"] <= r[a] <= r[f"{a}1"] for a in "xyz")


def test_stored_cells_follow_from_positions(spark, sf):
    p = spark.read.parquet(f"{sf}/points.parquet").where("morton is not null")
    again = M.with_cell(p.withColumns({c: A.d(c) for c in "xyz"}), "code", "x", "y", "z", A.half_extent(), 9)
    assert again.where("code <> morton").count() <= 0.001 * p.count()


def mix(x):
    m = (1 << 64) - 1
    x = (x + STEP) & m
    x = ((x ^ (x >> 30)) * FIRST) & m
    x = ((x ^ (x >> 27)) * SECOND) & m
    return x ^ (x >> 31)


def test_splitmix_equals_plain_integers(spark):
    rng = random.Random(0)
    values = [0, 1, -1, (1 << 63) - 1, -(1 << 63)] + [rng.getrandbits(64) - (1 << 63) for _ in range(500)]
    got = with_splitmix64(spark.createDataFrame([(v,) for v in values], "v long"), "h", F.col("v")).collect()
    assert all(r.h % (1 << 64) == mix(r.v % (1 << 64)) for r in got)


STARS = "k string, source_id long, x double, y double, z double, luminosity double, bp_rp double, leaf long"


def test_sample_keeps_light_and_small_nodes_have_none(spark):
    df = spark.createDataFrame([("a", i, 0.0, 0.0, 0.0, 1.0, 0.0, 0) for i in range(1000)] + [("b", i, 0.0, 0.0, 0.0, 2.0, 0.0, 0) for i in range(10)], STARS)
    got = T.samples(df, ["k"], "leaf", "source_id", 1, 50)
    r = got.groupBy("k", "depth").agg(F.count("*").alias("n"), F.sum(F.col("luminosity") * F.col("boost")).alias("l")).collect()
    assert [(x.k, x.depth, x.n, x.l) for x in r] == [("a", 0, 50, 1000.0)]
    seed = mix(0)
    want = sorted(range(1000), key=lambda i: mix(i ^ seed))[:50]
    assert {x.source_id for x in got.collect()} == set(want)
    again = T.samples(df.repartition(7), ["k"], "leaf", "source_id", 1, 50)
    assert {x.source_id for x in again.collect()} == set(want)


def test_small_tree(spark):
    at = [(-5, -5, -5), (5, -5, -5), (-5, 5, -5), (5, 5, 5)]
    df = M.with_cell(spark.createDataFrame([("t", i, *map(float, p), 1.0, 0.0, 0) for i, p in enumerate(at)], STARS).drop("leaf"), "leaf", "x", "y", "z", 10.0, 1)
    n = T.layout(df, ["k"], "leaf", 1, 2).orderBy("node").collect()
    assert len(n) == 5 and bin(n[0].child_mask).count("1") == 4 and n[0].point_count == 2 and [x.point_count for x in n[1:]] == [1] * 4
    assert T.all_points(df, ["k"], "leaf", "source_id", 1, 2).count() == 6


def walk(stars, depth, k):
    """A literal recursive build: node rows in order of number."""
    nodes, cursor = [[0, 0, 0, 0, 0, 0]], [0]

    def visit(i, d, prefix, mine):
        count = len(mine) if d == depth else (k if len(mine) > k else 0)
        nodes[i][:2], nodes[i][4:] = [d, prefix], [cursor[0], count]
        cursor[0] += count
        if d < depth:
            kids = [(c, [s for s in mine if (s >> (3 * (depth - d - 1))) & 7 == c]) for c in range(8)]
            kids = [(c, s) for c, s in kids if s]
            nodes[i][2:4] = [sum(1 << c for c, _ in kids), len(nodes)]
            first = len(nodes)
            nodes.extend([0] * 6 for _ in kids)
            for n, (c, s) in enumerate(kids):
                visit(first + n, d + 1, prefix << 3 | c, s)

    visit(0, 0, 0, stars)
    return nodes


def test_layout_equals_the_recursive_walk(spark):
    rng = random.Random(4)
    leaves = [rng.choice([rng.randrange(8**5), rng.randrange(64)]) for _ in range(300)]
    df = spark.createDataFrame([("t", i, 0.0, 0.0, 0.0, 1.0, 0.0, m) for i, m in enumerate(leaves)], STARS)
    got = T.layout(df, ["k"], "leaf", 5, 4).orderBy("node").collect()
    assert [[r.depth, r.prefix, r.child_mask, r.first_child, r.point_first, r.point_count] for r in got] == walk(leaves, 5, 4)
    assert [r.node for r in got] == list(range(len(got)))
    assert T.layout(df.limit(0), ["k"], "leaf", 5, 4).count() == 0


def test_cut_equals_the_recursive_walk(spark):
    rng = random.Random(9)
    leaves = [rng.choice([rng.randrange(8**4), rng.randrange(64)]) for _ in range(400)]
    df = spark.createDataFrame([("t", i, 0.0, 0.0, 0.0, 1.0, 0.0, m) for i, m in enumerate(leaves)], STARS)
    nodes = T.layout(df, ["k"], "leaf", 4, 6).cache()
    for cam in (Camera((30.0, -20.0, 5.0), (-1.0, 0.5, 0.1), (0.0, 0.0, 1.0), 200, 100, fov=50.0), galactic_view(100.0, 64, 64)):
        viewed = T.with_view(nodes, cam, 100.0, 30.0).cache()
        by = {(r.depth, r.prefix): r for r in viewed.collect()}
        cut, wanted = set(), set()

        def visit(d, p, culled):
            r = by.get((d, p))
            if r is None or (culled and not r.seen):
                return
            if r.terminal:
                if r.point_count:
                    (cut if culled else wanted).add((d, p))
                return
            if not culled and r.point_count:
                wanted.add((d, p))
            for c in range(8):
                visit(d + 1, p << 3 | c, culled)

        visit(0, 0, True)
        visit(0, 0, False)
        assert {(r.depth, r.prefix) for r in T.lod_cut(viewed, ["k"]).collect()} == cut
        assert {(r.depth, r.prefix) for r in T.wanted_nodes(viewed, ["k"]).collect()} == wanted
        subtree = {(r.depth, r.prefix): r.subtree_points for r in T.subtree_counts(nodes, ["k"]).collect()}
        assert subtree[0, 0] == sum(r.point_count for r in by.values())


def test_batches_join_adjoining_nodes(spark):
    rows = [("t", 3, 0, 10, 1.0), ("t", 3, 10, 5, 3.0), ("t", 3, 20, 5, 2.0), ("t", 3, 25, 90, 1.0), ("t", 3, 115, 20, 1.0), ("t", 3, 135, 300, 0.5), ("t", 3, 435, 1, 0.1)]
    df = spark.createDataFrame(rows, "k string, depth int, point_first long, point_count long, priority double")
    batches = T.fetch_batches(df, ["k"], 1, 100)
    got = sorted((r["first"], r.points, r.nodes, r.priority) for r in batches.collect())
    assert got == [(0, 15, 2, 3.0), (20, 95, 2, 2.0), (115, 20, 1, 1.0), (135, 300, 1, 0.5), (435, 1, 1, 0.1)]
    first = sorted((r.order, r["first"]) for r in T.next_fetches(batches, ["k"], 3).collect())
    assert first == [(1, 0), (2, 20), (3, 115)]
    assert T.fetch_batches(df.limit(0), ["k"], 1, 100).count() == 0


def test_batches_equal_the_greedy_loop(spark):
    rng = random.Random(3)
    rows = []
    for k in "ab":
        at = 0
        for _ in range(300):
            at += rng.choice([0, 0, 0, 7])
            n = rng.randrange(1, 60)
            rows.append((k, 1, at, n, rng.random()))
            at += n
    want = []
    for k in "ab":
        held = []
        for _, _, at, n, p in [r for r in rows if r[0] == k] + [("", 0, -1, 0, 0)]:
            if held and (at != held[-1][0] + held[-1][1] or sum(x[1] for x in held) + n > 100):
                want.append((k, held[0][0], sum(x[1] for x in held), len(held), max(x[2] for x in held)))
                held = []
            held.append((at, n, p))
    df = spark.createDataFrame(rows, "k string, depth int, point_first long, point_count long, priority double").repartition(5)
    assert sorted((r.k, r["first"], r.points, r.nodes, r.priority) for r in T.fetch_batches(df, ["k"], 20, 2000).collect()) == sorted(want)


def test_progress_and_changes(spark):
    node = lambda *p: spark.createDataFrame([("t", 3, x) for x in p], "k string, depth int, prefix long")
    r = T.load_progress(node(1, 2, 3, 4), node(1, 9), node(1, 2, 8), ["k"]).first()
    assert (r.cached, r.in_flight, r.total) == (1, 1, 4)
    chunk = lambda *p: spark.createDataFrame([("t", 3, x, t, n) for x, t, n in p], "k string, depth int, prefix long, token long, points long")
    got = {(r.prefix, r.action, r.points) for r in T.changed_chunks(chunk((1, 5, 2), (2, 6, 2), (3, 7, 2)), chunk((2, 6, 2), (3, 8, 4), (4, 9, 1)), ["k"]).collect()}
    assert got == {(1, "drop", 0), (3, "send", 4), (4, "send", 1)}


@pytest.mark.parametrize("seed", range(4))
def test_chunks_equal_the_recursive_walk(spark, seed):
    rng = random.Random(seed)
    leaves = [rng.choice([rng.randrange(8**4), rng.randrange(64)]) for _ in range(500)]
    df = spark.createDataFrame([("t", i, 0.0, 0.0, 0.0, 1.0, 0.0, m) for i, m in enumerate(leaves)], STARS)
    cam = Camera((30.0, -20.0, 5.0), (-1.0, 0.5, 0.1), (0.0, 0.0, 1.0), 200, 100, fov=50.0)
    viewed = Scratch(spark).write(T.with_view(T.layout(df, ["k"], "leaf", 4, 6), cam, 100.0, 12.0), "viewed")
    by = {(r.depth, r.prefix): r for r in viewed.collect()}
    share = (1.0, 0.97, 0.8, 0.0)[seed]
    cached = {x for x in by if rng.random() < share}
    merge, most, out = 60.0, 40, {}

    def cut(d, p):
        r = by.get((d, p))
        if r is None:
            return []
        if r.terminal:
            return [(d, p)] if r.point_count else []
        return [x for c in range(8) for x in cut(d + 1, p << 3 | c)]

    points = lambda nodes: sum(by[x].point_count for x in nodes)

    def emit(name, nodes):
        if points(nodes):
            out[name] = (len(nodes), points(nodes), sum(by[x].node for x in nodes))

    def walk(d, p):
        r = by[d, p]
        mine = cut(d, p)
        if r.terminal or r.footprint < merge:
            have = [x for x in mine if x in cached]
            if len(have) == len(mine):
                return mine
            emit((d, p), have)
            return None
        kids = {(d + 1, p << 3 | c): walk(d + 1, p << 3 | c) for c in range(8) if (d + 1, p << 3 | c) in by}
        if any(v is None for v in kids.values()):
            for name, v in kids.items():
                if v is not None:
                    emit(name, v)
            return None
        if points(mine) > most:
            emit((d, p), mine)
            return None
        return mine

    whole = walk(0, 0)
    if whole is not None:
        emit((0, 0), whole)
    have = spark.createDataFrame([("t", d, p) for d, p in cached] or [("t", 99, 0)], "k string, depth int, prefix long")
    got = {(r.depth, r.prefix): (r.nodes, r.points, r.token) for r in T.chunks(viewed, have, ["k"], merge, most).collect()}
    assert got == out and (out or not cached)


def test_box_reads_only_its_part_of_clustered_points(spark, tmp_path):
    rng = random.Random(1)
    rows = [("t", i, *[rng.uniform(-100, 100) for _ in range(3)], 1.0, 0.0) for i in range(20_000)] + [("t", 90_000 + i, 1.0, 2.0, 3.0, 1.0, 0.0) for i in range(5)]
    df = M.with_cell(spark.createDataFrame(rows, STARS.replace(", leaf long", "")), "prefix", "x", "y", "z", 100.0, 5).withColumn("depth", F.lit(5))
    df = df.withColumn("prefix", F.when(F.col("source_id") < 90_000, F.col("prefix")))  # the last stars have no code
    path = str(tmp_path / "points")
    T.write_points(df, path, ["k"], 5, "source_id", 16)
    low, high = (-20.0, -30.0, 10.0), (5.0, 0.0, 40.0)
    found = T.box_query(spark.read.parquet(path), "prefix", 5, 100.0, low, high)
    want = {r[1] for r in rows if all(a <= v <= b for a, v, b in zip(low, r[2:5], high))}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ids = found.select("source_id")
        assert {r.source_id for r in ids.collect()} == want and want
        plan = ids._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        scan = plan.collectLeaves().head()
        read = scan.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(want) <= read < 0.6 * len(rows)
    near = T.radius_query(spark.read.parquet(path), "prefix", 5, 100.0, (1.0, 2.0, 3.0), 9.0)
    assert {r.source_id for r in near.collect()} == {r[1] for r in rows if math.dist(r[2:5], (1, 2, 3)) <= 9.0} >= {90_000, 90_004}


def test_code_ranges_hold_every_cell_of_the_box():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.uniform(-12, 12) for _ in range(3)] for _ in range(2))
        low, high = [min(x) for x in zip(a, b)], [max(x) for x in zip(a, b)]
        ranges = T.code_ranges(low, high, 10.0, 4, most=rng.choice([1, 9, 64]))
        assert ranges == sorted(ranges) and len(ranges) <= 64
        cell = lambda v: min(15, int((v + 10) / 20 * 16))
        for _ in range(40):
            p = [rng.uniform(max(lo, -10), min(hi, 10)) if lo <= 10 and hi >= -10 and max(lo, -10) <= min(hi, 10) else None for lo, hi in zip(low, high)]
            if None not in p:
                code = sum(((cell(v) >> k) & 1) << (3 * k + axis) for axis, v in enumerate(p) for k in range(4))
                assert any(lo <= code <= hi for lo, hi in ranges)


def test_budgets_by_tree(spark):
    df = spark.createDataFrame([(k, i, 0.0, 0.0, 0.0, 1.0, 0.0, i % 8) for k in ("a", "b", "c") for i in range(100)], STARS)
    stars = df.withColumnRenamed("k", "t")
    budget = spark.createDataFrame([("a", 10), ("b", 70)], "t string, k int")
    root = {r.t: r.point_count for r in T.layout(stars, ["t"], "leaf", 1, budget).where("depth = 0").collect()}
    assert root == {"a": 10, "b": 70, "c": 0}
    kept = {r.t: (r.n, r.light) for r in T.samples(stars, ["t"], "leaf", "source_id", 1, budget).groupBy("t").agg(F.count("*").alias("n"), F.sum(F.col("luminosity") * F.col("boost")).alias("light")).collect()}
    assert kept == {"a": (10, pytest.approx(100)), "b": (70, pytest.approx(100))}
    only = spark.createDataFrame([("b", 0, 0, 100, 70), ("b", 1, 3, 13, 13)], "t string, depth int, prefix long, n long, point_count long")
    some = T.all_points(stars, ["t"], "leaf", "source_id", 1, None, only=only).groupBy("t", "depth").count().collect()
    assert {(r.t, r.depth, r["count"]) for r in some} == {("b", 0, 70), ("b", 1, 13)}


def test_cameras():
    right, up = galactic_axes()
    assert dot(right, up) == pytest.approx(0, abs=1e-12)
    with pytest.raises(ValueError):
        unit((0.0, 0.0, 0.0))
    with pytest.raises(ValueError):
        Camera((0, 0, 0), (0, 0, 1), (0, 1, 0), 10, 10)
    cam = Camera((1.0, 2.0, 3.0), (0.2, 1.0, -0.3), (0.0, 0.0, 1.0), 100, 50, fov=70.0, far=100.0)
    assert cross(cam.right, cam.forward) == pytest.approx(cam.up)
    ahead = tuple(e + 5 * f for e, f in zip(cam.eye, cam.forward))
    assert all(dot(p[:3], ahead) + p[3] >= 0 for p in cam.planes())
    assert any(dot(p[:3], tuple(e - 5 * f for e, f in zip(cam.eye, cam.forward))) + p[3] < 0 for p in cam.planes())


def test_splat_adds_light_like_a_loop(spark):
    rng = random.Random(2)
    rows = [("t", i, rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-9, 9), rng.choice([0.1, 5.0, 0.0]), rng.choice([None, 0.5, 2.0]), 0) for i in range(200)]
    cam = Camera((0.0, 0.0, 20.0), (0.0, 0.0, -1.0), (0.0, 1.0, 0.0), 40, 30, fov=60.0)
    got = {(r.x, r.y): (r.r, r.g, r.b) for r in R.rasterize(spark.createDataFrame(rows, STARS), cam, 20.0, 2.0).collect()}
    want = {}
    for _, _, x, y, z, lum, bp, _ in rows:
        if lum > 0 and all(dot(p[:3], (x, y, z)) + p[3] >= 0 for p in cam.planes()):
            d = 20 - z
            h = cam.scale[1]
            sx, sy = (x / (d * h * 40 / 30) * 0.5 + 0.5) * 40, (1 - (y / (d * h) * 0.5 + 0.5)) * 30
            light = lum / max(d * d, 0.01) * 20
            radius = min(max(light, 0.8), 2.0)
            for dy in range(-math.ceil(radius), math.ceil(radius) + 1):
                for dx in range(-math.ceil(radius), math.ceil(radius) + 1):
                    at = (math.floor(sx + 0.5) + dx, math.floor(sy + 0.5) + dy)
                    if 0 <= at[0] < 40 and 0 <= at[1] < 30:
                        want[at] = want.get(at, 0) + light * math.exp(-4 * (dx * dx + dy * dy) / radius**2)
    assert set(got) == set(want)
    white = {k for k, v in got.items() if v[0] == v[1] == v[2]}
    assert white and all(got[k][0] == pytest.approx(want[k]) for k in white)


def test_images_round_trip_and_compare(spark, tmp_path):
    img = spark.createDataFrame([(0, 0, 255, 0, 10), (69, 65, 1, 2, 3)], "x int, y int, r int, g int, b int")
    for write, name in ((images.write_ppm, "a.ppm"), (images.write_png, "a.png")):
        write(img, str(tmp_path / name), 70, 66)
    back = images.read_ppm(spark, str(tmp_path / "a.ppm"))
    assert {tuple(r) for r in back.where("r + g + b > 0").collect()} == {(0, 0, 255, 0, 10), (69, 65, 1, 2, 3)} and back.count() == 70 * 66
    assert (tmp_path / "a.png").read_bytes()[:8] == b"\x89PNG\r\n\x1a\n"
    report, tiles = R.compare(img, img, 70, 66)
    r = report.first()
    assert (r.exact_flux, r.fast_flux, r.exact_bright, r.passing, r.tiles_ok) == (271, 271, 1, 1.0, True)
    report, tiles = R.compare(img, img.where("x = 0"), 70, 66)
    worst = tiles.orderBy(F.desc("rmse")).first()
    assert (worst.tx, worst.ty) == (64, 64) and worst.rmse == pytest.approx(math.sqrt((1 + 4 + 9) / 255**2 / (3 * 6 * 2)))
    assert {tuple(r) for r in R.difference(img, img.where("x = 0")).collect()} == {(69, 65, 4, 8, 12)}
    (tmp_path / "bad.ppm").write_bytes(b"P6\n2 2\n65535\n" + b"0" * 24)
    with pytest.raises(Exception, match="255"):
        images.read_ppm(spark, str(tmp_path / "bad.ppm")).count()


def test_binary_formats(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.5, -2.5, 4.5, 0.25, 12.3, None), (2, 9.5, 8.5, 7.5, 0.5, 13.4, 1.25)], binary.ROWS_DDL)
    content = b"".join(bytes(r.content) for r in binary.encode_canonical(rows.coalesce(1)).collect())
    assert len(content) == 64 and struct.unpack("<q6f", content[32:]) == pytest.approx((2, 9.5, 8.5, 7.5, 0.5, 13.4, 1.25))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part-000.bin").write_bytes(content)
    back = binary.nan_to_null(binary.read_canonical(spark, str(tmp_path / "d")))
    assert sorted(back.collect()) == sorted(rows.collect(), key=lambda r: r.source_id)
    (tmp_path / "d" / "part-001.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole rows"):
        binary.read_canonical(spark, str(tmp_path / "d")).count()
    nodes = spark.createDataFrame([(0, 3, 1, 0, 2), (1, 0, 0, 2, 1), (2, 0, 0, 3, 1)], "node long, child_mask int, first_child long, point_first long, point_count long")
    points = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.5, 0.5), (1, -1.0, -2.0, -3.0, 2.5, None), (2, 0.0, 0.0, 0.0, 1.0, 1.5), (3, 5.0, 5.0, 5.0, 7.0, 2.0)], "place long, x float, y float, z float, luminosity float, bp_rp float")
    path = str(tmp_path / "tree.bin")
    binary.write_index(nodes, points, path, 5, 1234.5)
    head, n, p = binary.read_index(spark, path)
    assert head == {"depth": 5, "half_extent": 1234.5, "nodes": 3, "points": 4}
    assert sorted(n.collect()) == sorted(nodes.collect()) and {tuple(r) for r in p.collect()} == {tuple(r) for r in points.collect()}
    assert [r.place for r in binary.read_points(spark, path, 1, 2, step=1).orderBy("place").collect()] == [1, 2] and binary.read_points(spark, path, 3, 99).count() == 1
    assert binary.read_nodes(spark, path, step=2).orderBy("node").collect() == nodes.orderBy("node").collect()
    with pytest.raises(ValueError, match="number the rows"):
        binary.write_index(nodes.where("node <> 1"), points, str(tmp_path / "gap.bin"), 5, 1234.5)
    binary.write_index(nodes.limit(0), points.limit(0), str(tmp_path / "empty.bin"), 5, 1.0)
    assert binary.read_points(spark, str(tmp_path / "empty.bin")).count() == 0 == binary.read_nodes(spark, str(tmp_path / "empty.bin")).count()
    for bad in (b"BOGUSMAG" + b"\0" * 24, b"short", open(path, "rb").read() + b"x"):
        (tmp_path / "bad.bin").write_bytes(bad)
        with pytest.raises(ValueError):
            binary.read_index(spark, str(tmp_path / "bad.bin"))


def test_catalogue_files(spark, tmp_path):
    import gzip

    a = "source_id,ra,dec,parallax,parallax_error,phot_g_mean_mag,bp_rp\n1,0,0,100,1,12.5,0.3\n2,90,0,0.2,0.1,13.5,\n3,0,0,,0.2,14.5,1.1\n4,0,0,-1,0.3,15.5,1.2\n"
    b = "# %ECSV 1.0\n# delimiter: ','\nsource_id,note,ra,dec,parallax,parallax_error,phot_g_mean_mag,bp_rp\n1,x,0,0,100,2,12.1,null\n2,y,1,2,null,3,13.2,0.5\n"
    for name, text in (("GaiaSource_000-001.csv.gz", a), ("GaiaSource_002-003.csv.gz", b)):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)
    import hashlib

    sums = {r.input_name: (r.md5, r.length) for r in file_checksums(spark, str(tmp_path)).collect()}
    assert sums == {f.name: (hashlib.md5(f.read_bytes()).hexdigest(), f.stat().st_size) for f in tmp_path.iterdir()} and len(sums) == 2
    rows, rejects = read_catalogue(spark, str(tmp_path))
    counts = {r.input_name: (r.seen, r.positive) for r in rows.groupBy("input_name").agg(F.count("*").alias("seen"), F.count_if(A.positive_parallax(F.col("parallax"))).alias("positive")).collect()}
    assert counts == {"GaiaSource_000-001.csv.gz": (4, 2), "GaiaSource_002-003.csv.gz": (2, 1)} and rejects.count() == 0
    assert rows.where("source_id = 2 and bp_rp is null").count() == 1
    root = Scratch(spark).root
    first = L.ingest(spark, rows, f"{root}/rows", f"{root}/log")
    assert first == 2 and L.ingest(spark, rows, f"{root}/rows", f"{root}/log") == 0
    assert spark.read.parquet(f"{root}/rows").count() == 3


def test_manifests_and_states(spark):
    lines = spark.createDataFrame([("  a" * 8 + "\thttps://h/x.csv.gz",), ("file:///d/y.csv.gz ",), ("   ",)], "value string")
    got = {(r.input, r.expected_md5 is not None) for r in L.manifest_lines(lines).collect()}
    assert got == {("https://h/x.csv.gz", True), ("file:///d/y.csv.gz", False)}
    sums = L.checksum_lines(spark.createDataFrame([("0" * 32 + "  x.csv.gz",), ("junk",)], "value string"))
    t = {r.input_name: (r.md5, r.mismatch) for r in L.trusted(L.manifest_lines(lines), sums).collect()}
    assert t == {"x.csv.gz": ("0" * 32, True), "y.csv.gz": (None, False)}
    doc = '{"spec":{"taskCount":10},"status":{"succeededCount":%d,"failedCount":1,"conditions":[{"type":"Completed","status":"%s"}]}}'
    states = L.execution_states(spark.createDataFrame([("a", doc % (9, "True")), ("b", doc % (3, "Unknown")), ("c", doc % (3, "False")), ("d", "{}")], "name string, json string")).collect()
    assert [(r.name, r.state, r.pending) for r in states] == [("a", "succeeded", 0), ("b", "running", 6), ("c", "failed", 6), ("d", "running", 0)]


def test_labels(spark, tmp_path):
    (tmp_path / "labels.json").write_text('{"Sun": [0, 0, 0], "Near": [0, 13.0, 0], "Far": [99, 0, 0]}')
    got = labels.read_labels(spark, str(tmp_path / "labels.json"))
    faded = {r.name: r.alpha for r in labels.faded(got, (0.0, 0.0, 0.0), 12.0, 16.0).collect()}
    assert faded == {"Sun": 1.0, "Near": pytest.approx(0.75)}
    assert labels.read_labels(spark, str(tmp_path / "missing.json")).count() == 0


def test_views_in_batch_and_stream_agree(spark, sf, tmp_path):
    v = view_events(spark.read.parquet(f"{sf}/events.parquet"))
    batch = {(r.session, r.seq) for r in accepted_views(v, 20000.0).collect()}
    assert 0 < len(batch) < v.count()
    ordered = v.orderBy("seq").toPandas()
    for k, part in enumerate(np.array_split(np.arange(len(ordered)), 3)):
        spark.createDataFrame(ordered.iloc[part], VIEW).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    got = set()
    for k in range(3):
        stream = spark.readStream.schema(VIEW + ", k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("k")
        if k == 0:
            q = accepted_view_stream(stream, 20000.0).writeStream.format("memory").queryName("views_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
            q.processAllAvailable()
            q.stop()
            got = {(r.session, r.seq) for r in spark.sql("select * from views_out").collect()}
    assert got == batch


def test_listings(spark, tmp_path):
    for name in ("b-1", "a", "bad name", "empty"):
        (tmp_path / name / "sub").mkdir(parents=True)
        (tmp_path / name / "sub" / "tree.bin").write_bytes(b"x")
        if name != "empty":
            (tmp_path / name / "tree.bin").write_bytes(b"0123456789")
    assert [r.name for r in listing.dataset_names(spark, str(tmp_path), "tree.bin").collect()] == ["a", "b-1"]
    assert {(r.path, r.length) for r in listing.list_files(spark, str(tmp_path), "a/tree.bin").collect()} == {("a/tree.bin", 10)}
    assert listing.read_range(str(tmp_path / "a" / "tree.bin"), 2, 4) == b"234" and listing.read_range(str(tmp_path / "a" / "tree.bin"), 8, 99) == b"89"
    with pytest.raises(ValueError):
        listing.read_range(str(tmp_path / "a" / "tree.bin"), 4, 2)
    page = '<L xmlns="urn:x"><Contents><Key>g/a.csv.gz</Key></Contents><Contents><Key>g/b.txt</Key></Contents></L>'
    assert [r.key for r in listing.bucket_listing(spark.createDataFrame([(page,)], "value string")).collect()] == ["g/a.csv.gz"]
    more = lambda keys, tail: "<L>" + "".join(f"<Contents><Key> {k} </Key></Contents>" for k in keys) + tail + "</L>"
    site = {None: more(["a.csv.gz", "b.csv.gz"], "<IsTruncated>true</IsTruncated>"), "b.csv.gz": more(["c.txt"], "<IsTruncated>true</IsTruncated><NextMarker>m</NextMarker>"), "m": more(["d.csv.gz"], "<IsTruncated>false</IsTruncated>")}
    assert sorted(r.key for r in listing.bucket_listing(listing.listing_pages(spark, site.__getitem__)).collect()) == ["a.csv.gz", "b.csv.gz", "d.csv.gz"]
    with pytest.raises(ValueError):
        listing.listing_pages(spark, lambda marker: site[None])
    assert listing.run_name(0) == "cfcd208"
    lines = spark.createDataFrame([(" a ",), ("",), ("k=v=w",)], "value string")
    assert [r.name for r in listing.name_lines(lines).collect()] == ["a", "k=v=w"] and [tuple(r) for r in listing.settings(lines).collect()] == [("k", "v=w")]
    r = one(spark, a=listing.object_prefix(F.lit("/mnt/disk/x/y"), "/mnt/disk/"), b=listing.object_prefix(F.lit("/tmp/x"), "/mnt/disk/"))
    assert (r.a, r.b) == ("x/y", None)


def test_motion(spark):
    df = spark.createDataFrame([("s", i, f"2026-01-01 00:00:0{t}", float(x)) for i, (t, x) in enumerate([(0, 0), (2, 6), (2, 9), (3, 9)])], "k string, n int, t string, x double")
    df = df.withColumns({"t": F.to_timestamp("t"), "y": F.lit(0.0), "z": F.lit(0.0)})
    assert [r.speed for r in motion.speeds(df, ["k"], "t", "n", "x", "y", "z").orderBy("n").collect()] == [None, 3.0, None, 0.0]
    r = one(spark, m=motion.smoothed(F.array(F.lit(10.0), F.lit(20.0))), a=motion.speed_text(F.lit(motion.LIGHT * 2)), b=motion.speed_text(F.lit(motion.LIGHT * 5e6)), s=motion.slider(F.lit(0.5)))
    assert r.m == pytest.approx(11.0) and (r.a, r.b) == ("2.00 c", "5.00 Mc") and r.s == pytest.approx(10**1.5)


def test_index_file_of_a_whole_tree(spark, sf, tmp_path):
    """Build, write, read: ranges of the file are the nodes' points."""
    one = tree.stars(spark, sf).where("dataset = '77cb2300'")
    k = tree.budget(spark, sf)
    nodes = T.layout(one, ["dataset"], "leaf", tree.DEPTH, k)
    points = T.with_places(T.all_points(one, ["dataset"], "leaf", "source_id", tree.DEPTH, k), ["dataset"], tree.DEPTH, "source_id")
    path = str(tmp_path / "tree.bin")
    binary.write_index(nodes, points, path, tree.DEPTH, tree.HALF)
    head, back, _ = binary.read_index(spark, path)
    assert head["nodes"] == nodes.count() and head["points"] == points.count() == back.agg(F.sum("point_count")).first()[0]
    for r in back.where("point_count > 0").orderBy(F.desc("point_count"), "node").limit(3).collect():
        at = nodes.where(F.col("node") == r.node).first()
        mine = points.where((F.col("depth") == at.depth) & (F.col("prefix") == at.prefix)).orderBy("source_id").collect()
        got = binary.read_points(spark, path, r.point_first, r.point_count).orderBy("place").collect()
        assert [np.float32(p.x) for p in mine] == [np.float32(p.x) for p in got] and len(got) == r.point_count


def test_cache_in_batch_and_stream_agree(spark, sf, tmp_path):
    messages = cache.message_events(spark.read.parquet(f"{sf}/events.parquet"))
    batch = {(r.session, r.seq): (list(r.fetch), list(r.evicted), r.stale, r.cached, r.in_flight, r.total) for r in cache.cache_answers(messages, 5).collect()}
    assert any(v[0] for v in batch.values()) and any(v[1] for v in batch.values()) and all(v[4] <= 5 for v in batch.values())
    ordered = messages.orderBy("seq").toPandas()
    for k, part in enumerate(np.array_split(np.arange(len(ordered)), 3)):
        spark.createDataFrame(ordered.iloc[part], cache.MESSAGE).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema(cache.MESSAGE + ", k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("k")
    q = cache.cache_stream(stream, 5).writeStream.format("memory").queryName("answers").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.session, r.seq): (list(r.fetch), list(r.evicted), r.stale, r.cached, r.in_flight, r.total) for r in spark.sql("select * from answers").collect()}
    assert got == batch


def test_stale_replies_change_nothing():
    state, fetch, *_ = cache.step(cache.EMPTY, "wanted", 1, [5, 3, 9, 5], 2)
    assert fetch == [5, 3] and state == (1, [], [5, 3], [5, 3, 9])
    same, fetch, evicted, stale = cache.step(state, "reply", 0, [5], 2)
    assert same == state and fetch == [] and stale
    state, fetch, evicted, stale = cache.step(state, "reply", 1, [5, 77], 2)
    assert state == (1, [5], [3, 9], [5, 3, 9]) and fetch == [9] and not stale
    state, fetch, evicted, _ = cache.step(state, "wanted", 1, [9, 4], 2)
    assert evicted == [5] and state[1] == [] and fetch == []
    state, *_ = cache.step(state, "wanted", 2, [1], 2)
    assert state == (2, [], [1], [1])


def test_cells_that_a_range_meets(spark):
    assert [M.axis_cells(1, 1, 0, 2, 1)] * 3 == [(0, 1)] * 3  # touching both
    assert M.axis_cells(0.1, 0.2, 0, 2, 1) == (0, 0) and M.axis_cells(-5, 9, 0, 2, 3) == (0, 7) and M.axis_cells(0.5, 0.75, 0, 2, 3) == (1, 3)


def test_state_documents(spark, tmp_path):
    schema = "name string, counts struct<done: long>"
    (tmp_path / "a.json").write_text('{\n "name": "a",\n "counts": {"done": 3}\n}')
    assert [(r.name, r.counts.done) for r in listing.read_state(spark, str(tmp_path), schema).collect()] == [("a", 3)]
    assert listing.read_state(spark, str(tmp_path / "missing"), schema).count() == 0


def test_faint_parts_of_splats_are_left_out(spark):
    df = spark.createDataFrame([("t", 1, 0.0, 0.0, 0.0, 1.0, 0.5, 0)], STARS)
    cam = Camera((0.0, 0.0, 20.0), (0.0, 0.0, -1.0), (0.0, 1.0, 0.0), 40, 30, fov=60.0)
    n = lambda least: R.rasterize(df, cam, 20.0, 1.0, least).count()
    assert n(0.0) == 9 > n(1e-3) >= 1 and n(1e9) == 0
