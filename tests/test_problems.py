import math
import random

import pytest
from helpers import agree
from pyspark.sql import functions as F

from skyfold.operators.regions import near_on_sky, near_pairs, points_in_regions
from skyfold.operators.skew import count_beside, heavy_keys
from skyfold.plans import catalogue
from skyfold.operators import regions as regions_module
from skyfold.operators.regions import in_octagons
from skyfold.sources import csv_lines
from skyfold.sources.csv_lines import diagnose, parse_lines, split_fields


@pytest.mark.parametrize("name", [n for n in catalogue.SQL if n not in ("p2_rows", "p3_found")])
def test_query_agrees_with_sql(spark, sf, duck, name):
    agree(spark, sf, duck, catalogue.QUERIES[name], catalogue.SQL[name])


def test_near_pairs_match_brute_force(spark):
    rng = random.Random(1)
    rows = [("a" if i % 3 else None, i, rng.random(), rng.random(), rng.random()) for i in range(300)]
    rows += rows[:5] + [("a", 900, None, 0.0, 0.0), ("a", 901, float("nan"), 0.0, 0.0), ("a", None, 0.5, 0.5, 0.5)]
    rows += [("e", 1, 0.0, 0.0, 0.0), ("e", 2, 0.125, 0.0, 0.0), ("e", 3, 0.0, 0.0, 0.0)]  # exactly on the bound; the same place
    df = spark.createDataFrame(rows, "k string, id long, x double, y double, z double").withColumn("distance", F.lit(1))
    got = {(r.k, r.id_a, r.id_b) for r in near_pairs(df, ["k"], "id", "x", "y", "z", 0.125).collect()}
    good = [r for r in set(rows) if r[1] is not None and all(v is not None and not math.isnan(v) for v in r[2:])]
    want = {(a[0], a[1], b[1]) for a in good for b in good if a[0] == b[0] and a[1] < b[1] and math.dist(a[2:], b[2:]) <= 0.125}
    assert got == want and ("e", 1, 2) in want


def test_near_pairs_of_a_point_stored_at_two_places(spark):
    # One place is in the octagon around the other star, one in a corner of its box.
    near, corner = (0.55, 0.5, 0.5), (0.62, 0.5, 0.62)
    rows = [("a", 1, 0.5, 0.5, 0.5), ("a", 2, *near), ("a", 2, *corner), ("b", 2, 0.5, 0.5, 0.5), ("b", 1, *near), ("b", 1, *corner)]
    df = spark.createDataFrame(rows, "k string, id long, x double, y double, z double")
    got = [(r.k, r.id_a, r.id_b, round(r.distance, 9)) for r in near_pairs(df, ["k"], "id", "x", "y", "z", 0.125).collect()]
    assert sorted(got) == [("a", 1, 2, 0.05), ("b", 1, 2, 0.05)]


def test_near_on_sky_at_pole_and_seam(spark):
    rows = [("d", 1, 0.0001, 10.0), ("d", 2, 359.9999, 10.0), ("d", 3, 10.0, 89.9999), ("d", 4, 190.0, 89.9999), ("d", 5, 370.0, 89.9999), ("x", 6, 10.0, 89.9999)]
    df = spark.createDataFrame(rows, "k string, id long, ra double, dec double")
    got = {(r.id_a, r.id_b) for r in near_on_sky(df, ["k"], "id", "ra", "dec", 1.0).collect()}
    assert got == {(1, 2), (3, 4), (3, 5), (4, 5)}
    assert near_on_sky(df.limit(0), ["k"], "id", "ra", "dec", 1.0).count() == 0


def test_regions_are_closed_and_may_be_concave(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    regions = spark.createDataFrame([("r", i, float(x), float(y)) for i, (x, y) in enumerate(ring)] + [("none", 0, None, 1.0)], "r string, s int, vx double, vy double")
    cases = {1: (0, 0), 2: (2, 0), 3: (2, 1), 4: (2, 2), 5: (1, 1), 6: (3.9, 3.5), 7: (4, 2), 8: (5, 1), 9: (-1, 0), 10: (2, 0.5), 11: (-1, 1)}
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in cases.items()] * 2 + [(99, None, 1.0)], "id long, px double, py double")
    got = {r.id for r in points_in_regions(pts, regions, "id", "px", "py", "r", "s", "vx", "vy", 0.5, 1.0).collect()}
    assert got == {1, 2, 3, 5, 6, 7, 10}


def test_region_across_the_seam(spark):
    ring = [(359, -1), (361, -1), (361, 1), (359, 1)]
    regions = spark.createDataFrame([("r", i, float(x), float(y)) for i, (x, y) in enumerate(ring)], "r string, s int, vx double, vy double")
    pts = spark.createDataFrame([(1, 359.5, 0.0), (2, 0.5, 0.0), (3, -0.5, 0.0), (4, 2.0, 0.0), (5, 720.5, 0.5)], "id long, px double, py double")
    assert {r.id for r in points_in_regions(pts, regions, "id", "px", "py", "r", "s", "vx", "vy", 0.5, 1.0, 360).collect()} == {1, 2, 3, 5}


def test_counts_with_a_key_that_holds_most_rows(spark):
    rows = [(1, i % 700) for i in range(3000)] + [(k, k) for k in range(2, 60)] + [(None, 1), (5, None)]
    facts = spark.createDataFrame(rows, "key long, id long").withColumn("n", F.lit(0))
    dims = spark.createDataFrame([(1, 10), (1, None), (2, 3), (777, 4), (None, 9), (778, None)], "key long, w long")
    heavy = heavy_keys(facts, "key", 0.1, 0.5)
    assert [r.key for r in heavy.collect()] == [1]
    got = {r.key: (r.n, r.w) for r in count_beside(facts, dims, "key", "id", "w", heavy).collect()}
    want = {1: (700, 10), 2: (1, 3), 777: (0, 4), 778: (0, 0)} | {k: (1, 0) for k in range(3, 60)}
    assert got == want
    assert count_beside(facts.limit(0), dims, "key", "id", "w").count() == 4
    assert count_beside(facts, dims.limit(0), "key", "id", "w").count() == 59


def test_keys_without_identifiers_come_out(spark):
    rows = [(1, None)] * 50 + [(2, None)] * 50 + [(3, 7), (4, None), (5, None), (5, 8)]
    facts = spark.createDataFrame(rows, "key long, id long")
    dims = spark.createDataFrame([(1, 10), (5, 2), (6, 3), (7, 4)], "key long, w long")
    want = {1: (0, 10), 2: (0, 0), 3: (1, 0), 4: (0, 0), 5: (1, 2), 6: (0, 3), 7: (0, 4)}
    # Only dims has 6 and neither side 8; what is called heavy doesn't change the result.
    for heavy in ([1, 2, 6, 8], [5, 4], []):
        named = spark.createDataFrame([(k,) for k in heavy], "key long")
        got = [(r.key, r.n, r.w) for r in count_beside(facts, dims, "key", "id", "w", named).collect()]
        assert sorted(got) == sorted((k, *v) for k, v in want.items())


def test_strict_rules():
    assert split_fields('a,"b,""c""",') == ["a", 'b,"c"', ""]
    for bad in ('"a', 'a"b', '"a"b,c', 'x,"y" ,z', '"a""'):
        assert split_fields(bad) is None
    header = ["source_id", "ra"]
    kinds = {"source_id": "whole", "ra": "number"}
    for line, reason in {"1,2": None, " 1 , NaN ": None, "1": "column_count", "-1,2": "invalid_value", "9223372036854775808,2": "invalid_value", "9223372036854775807,+1.5e-3": None, "1,": "invalid_value", "1,inf": "invalid_value", "1,1.2.3": "invalid_value", "000000000000000000000012,.5": None, "１,2": "invalid_value", "1,-nan": "invalid_value"}.items():
        assert diagnose(line, header, kinds)[0] == reason, line
    assert diagnose("1,2", ["source_id", "x"], kinds)[0] == "missing_column"


def test_lines_in_blocks_equal_lines_alone(spark):
    rng = random.Random(3)
    odd = ['"1"', "x", "", "null", " 2.5 ", '"3', "1e5", "+4", "NaN", "inf", '5"', "NULL", "-.5", "1e999", "é", "a\rb"]
    lines = [(0, "f", 1, "# note"), (1, "f", 2, "source_id,ra,dec,parallax,parallax_error,phot_g_mean_mag,bp_rp"), (2, "f", 3, " "), (3, "g", 1, "ra"), (4, "g", 2, "1"), (5, "h", None, "1,2"), (6, None, 1, "ra"), (7, None, 2, None)]
    good = ["7", "1.5", "2", "3", "0.1", "12", "0.5"]
    for i in range(10, 1500):
        f = list(good)
        if rng.random() < 0.1:
            f[rng.randrange(7)] = rng.choice(odd)
        if rng.random() < 0.02:
            f.append("9")
        lines.append((i, "f", i, ",".join(f)))
    df = spark.createDataFrame(lines, "line_id long, input_name string, line_no long, line string").withColumn("reason", F.lit("own"))
    got = {r.line_id: r for r in parse_lines(df).collect()}
    header = lines[1][3].split(",")
    for i, f, no, line in lines[8:]:
        reason, values = diagnose(line, header, {k: v for k, v in zip(header, ["whole", "number", "number", "maybe", "number", "maybe", "maybe"])})
        assert got[i].reason == reason, line
        assert str([got[i][h] for h in header]) == str(values)
    assert got[4].reason == "missing_column" and got[5].reason == "no_header" and len(got) == 1490 + 2
    assert parse_lines(df.limit(0)).count() == 0


def test_regions_reach_a_degree(spark, tmp_path):
    rows = [("f", 1, 0.2, 10.0), ("f", 2, 0.7, 10.4), ("f", 3, 359.4, 9.9), ("f", 4, 0.8, 10.5), ("g", 5, 0.2, 10.95), ("g", 6, 1.25, 10.0)]
    spark.createDataFrame(rows, "input_name string, source_id long, ra double, dec double").write.parquet(f"{tmp_path}/canonical_rows.parquet")
    got = {(r.source_id, r.input_name) for r in catalogue.QUERIES["p3_regions"](spark, str(tmp_path)).collect()}
    assert got == {(1, "f"), (2, "f"), (3, "f"), (5, "f"), (1, "g"), (5, "g")}


def test_few_lines_are_diagnosed_alone(sf, duck, monkeypatch):
    """The fast path takes all but the bad lines; a block that fails in spite of the tests is bisected to single lines."""
    lines = duck.sql("""WITH w AS (SELECT * FROM raw_lines WHERE NOT starts_with(line, '#') AND trim(line) <> ''),
h AS (SELECT input_name, min(line_no) AS first, min_by(line, line_no) AS header FROM w GROUP BY 1)
SELECT line_id, input_name, line, header FROM w JOIN h USING (input_name) WHERE line_no > first""").to_arrow_table()
    calls = {"diagnose": 0, "_convert": 0}

    def counted(name):
        plain = getattr(csv_lines, name)

        def call(*args):
            calls[name] += 1
            return plain(*args)

        monkeypatch.setattr(csv_lines, name, call)

    for name in calls:
        counted(name)
    out = [b.column("reason").to_pylist() for b in csv_lines._parse(csv_lines.STAR_COLUMNS)(iter(lines.combine_chunks().to_batches()))]
    bad = sum(r is not None for rows in out for r in rows)
    assert sum(map(len, out)) == lines.num_rows and 0 < bad <= calls["diagnose"] <= 2 * bad
    assert calls["_convert"] > 2  # whole numbers that are too large pass the tests and fail the conversion


def test_bisection_leaves_only_bad_lines_alone():
    rng = random.Random(1)
    for size in (0, 1, 2, 77, 1000):
        bad, alone = {i for i in range(size) if rng.random() < 0.03}, []
        parts = [(a, z) for a, z, _ in csv_lines._bisect(size, lambda a, z: None if bad & set(range(a, z)) else True, alone)]
        assert set(alone) == bad and sorted([i for a, z in parts for i in range(a, z)] + alone) == list(range(size))


def _stars_in_a_box(spark):
    rng = random.Random(6)
    rows = [("a", i, rng.random(), rng.random(), rng.random()) for i in range(400)]
    return rows, spark.createDataFrame(rows, "k string, id long, x double, y double, z double")


def test_parity_decides_which_points_are_in_octagons(spark, monkeypatch):
    rows, df = _stars_in_a_box(spark)
    place = lambda c: tuple(F.col(f"{c}{i}") for i in range(3))
    found = lambda: {(r["__p"], r["__q"]) for r in in_octagons(df, ["k"], "id", ["x", "y", "z"], place, 0.125).collect()}

    def inside(dx, dz, r=0.125 * (1 + 1e-9)):  # eight half planes
        return all(dx * math.cos(k * math.pi / 4) + dz * math.sin(k * math.pi / 4) <= r for k in range(8))

    box = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and abs(a[3] - b[3]) <= 0.125 and max(abs(a[2] - b[2]), abs(a[4] - b[4])) <= 0.125}
    want = {(p, q) for p, q in box if inside(rows[p][2] - rows[q][2], rows[p][4] - rows[q][4])}
    assert found() == want < box
    # Without its western edges, an octagon would take in its western corners; without the eastern ones, no point is inside.
    edges = regions_module._EDGES
    monkeypatch.setattr(regions_module, "_EDGES", [e for e in edges if max(e[1][0], e[2][0]) > 0])
    assert want < found() <= box
    monkeypatch.setattr(regions_module, "_EDGES", [e for e in edges if min(e[1][0], e[2][0]) < 0])
    assert not want & found()


def test_edges_of_any_length_meet_their_points(spark):
    """Edges and regions of very different sizes, against the crossing rule in a loop."""
    rng = random.Random(3)
    rings = {f"r{n}": [(c[0] + size * rng.uniform(0.2, 1) * math.cos(t), c[1] + size * rng.uniform(0.2, 1) * math.sin(t)) for t in sorted(rng.uniform(0, 6.28) for _ in range(3 + n % 6))] for n, size in enumerate([0.1, 1, 30, 300, 5, 2000]) for c in [(rng.uniform(-5, 5), rng.uniform(-5, 5))]}
    regions = spark.createDataFrame([(r, i, x, y) for r, ring in rings.items() for i, (x, y) in enumerate(ring)], "r string, s int, vx double, vy double")
    pts = [(i, rng.gauss(0, 10 ** rng.uniform(-1, 3)), rng.gauss(0, 10 ** rng.uniform(-1, 3))) for i in range(800)]

    def inside(x, y, ring):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        return odd

    want = {(i, r) for i, x, y in pts for r, ring in rings.items() if inside(x, y, ring)}
    df = spark.createDataFrame(pts + pts[:50], "id long, px double, py double")
    got = {(x.id, x.r) for x in points_in_regions(df, regions, "id", "px", "py", "r", "s", "vx", "vy", 0.5, 1.0).collect()}
    assert got == want and len(want) > 100
    assert points_in_regions(df, regions.limit(0), "id", "px", "py", "r", "s", "vx", "vy", 0.5, 1.0).count() == 0
