import datetime
import math
import os
import random
from collections import Counter, defaultdict

import pytest
from helpers import agree
from pyspark.sql import functions as F

from skyfold.common import Scratch
from skyfold.llm import percentiles as P
from skyfold.llm import queries as Q
from skyfold.llm.permanent_numbers import NumberStore
from skyfold.llm.reservoir import reservoir_sample
from skyfold.llm.top_items import top_items


@pytest.mark.parametrize("name", list(Q.SQL))
def test_query_agrees_with_sql(spark, sf, duck, name):
    agree(spark, sf, duck, Q.QUERIES[name], Q.SQL[name])


def nearest_rank(values, p):
    v = sorted(values)
    return v[max(1, len(v) - math.floor(len(v) - p * len(v))) - 1]


def test_percentiles_by_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(P, "CUTOFF", 8)
    rng = random.Random(5)
    rows = [("big", rng.gauss(0, 1)) for _ in range(3000)] + [("ties", float(i % 3)) for i in range(500)] + [(None, float(i)) for i in range(40)]
    rows += [("one", 1.0), ("inf", float("inf")), ("inf", float("-inf")), ("inf", 0.0), ("none", None), ("none", float("nan"))]
    rows += [("both", s * float("inf")) for s in (1, -1) for _ in range(40)] + [("huge", v) for v in (-1.7e308, 1.7e308) for _ in range(30)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("value", F.lit("clash")).repartition(5)
    ps = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r.g, r.p): r.value for r in P.percentiles(df, ["g"], {"v": F.col("v")}, {"v": ps}).collect()}
    by = defaultdict(list)
    for g, v in rows:
        if v is not None and not math.isnan(v):
            by[g].append(v)
    assert got == {(g, p): nearest_rank(v, p) for g, v in by.items() for p in ps}
    assert P.percentiles(df.limit(0), ["g"], {"v": F.col("v")}, {"v": ps}).count() == 0
    with pytest.raises(ValueError):
        P.percentiles(df.withColumnRenamed("g", "p"), ["p"], {"v": F.col("v")}, {"v": ps})


@pytest.mark.parametrize("cutoff", [0, 10, 10_000])
def test_weighted_groups_of_either_size(spark, monkeypatch, cutoff):
    """Every rank is found by rounds alone, or what a round has left is read off."""
    monkeypatch.setattr(P, "CUTOFF", cutoff)
    rng = random.Random(8)
    rows = [(g, float(rng.randrange(30)), rng.randrange(4)) for g in range(12) for _ in range(g * g)]
    df = spark.createDataFrame(rows, "g int, v double, w int").repartition(3)
    shares = {"v": [0.01, 0.5, 0.99], "unwanted": [], "absent": [0.5]}
    blocks = P.sorted_blocks(df, ["g"], {"v": F.col("v"), "unwanted": F.col("v"), "unnamed": F.col("v")}, F.col("w"))
    got = {(r.g, r.field, r.p): (r.value, r.n) for r in P.select_ranks(blocks, ["g"], shares).collect()}
    by = defaultdict(list)
    for g, v, w in rows:
        by[g] += [v] * w
    assert got == {(g, "v", p): (nearest_rank(v, p), len(v)) for g, v in by.items() if v for p in shares["v"]}
    assert P.select_ranks(blocks, ["g"], {}).count() == 0


def test_summaries_of_days_combine(spark, monkeypatch):
    monkeypatch.setattr(P, "CUTOFF", 16)
    rng = random.Random(6)
    rows = [("a", d, rng.expovariate(1) + d) for d in range(6) for _ in range(rng.randrange(3, 800))]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    points = 20
    s = P.summarize(df, ["g"], ["day"], {"v": F.col("v")}, points)
    assert s.groupBy("day").count().agg(F.max("count")).first()[0] <= points
    assert s.agg(F.sum("weight")).first()[0] == len(rows)
    values = sorted(r[2] for r in rows)
    for r in P.combine(s, ["g"], [0.1, 0.5, 0.9]).collect():
        rank = sum(v <= r.value for v in values)
        assert r.n == len(rows) and abs(rank - r.p * len(rows)) <= len(rows) / points + 1


def test_combined_percentiles_of_files(spark, tmp_path):
    rng = random.Random(8)
    rows = [("f", datetime.datetime(2024, 1, 1 + d), 10 + rng.random() * d, rng.expovariate(1) + 0.01) for d in range(5) for _ in range(rng.randrange(30, 400))]
    spark.createDataFrame(rows, "input_name string, ingested_at timestamp, phot_g_mean_mag double, parallax_error double").write.parquet(f"{tmp_path}/canonical_rows.parquet")
    got = {(r.field, r.p): r for r in Q.QUERIES["p1_combined"](spark, str(tmp_path)).collect()}
    assert set(got) == {(f, p) for f in ("phot_g_mean_mag", "parallax_error") for p in Q.SHARES}
    for (f, p), r in got.items():
        rank = sum(x[2 if f == "phot_g_mean_mag" else 3] <= r.value for x in rows)
        assert r.n == len(rows) and abs(rank - p * len(rows)) <= 0.02 * len(rows) + 5


def test_top_items_edge_cases(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(6)), rng.randrange(200)) for _ in range(3000)]
    rows += [("c", None, 1), ("c", float("nan"), 2), ("d", float("inf"), 3), ("d", 1.0, None), ("d", float("-inf"), 4)]
    df = spark.createDataFrame(rows, "g string, s double, id long").withColumn("rank", F.lit("x")).repartition(6)
    best = defaultdict(dict)
    for g, s, i in rows:
        if s is not None and not math.isnan(s) and i is not None:
            best[g][i] = max(s, best[g].get(i, s))
    want = {(g, i, k + 1) for g, m in best.items() for k, (i, s) in enumerate(sorted(m.items(), key=lambda x: (-x[1], x[0]))[:4])}
    got = {(r.g, r.id, r["rank"]) for r in top_items(df, ["g"], "s", "id", 4).collect()}
    assert got == want
    assert top_items(df.limit(0), ["g"], "s", "id", 4).count() == 0


def test_reservoir_is_uniform_and_whole(spark):
    rows = [("a", i) for i in range(60)] + [("b", i) for i in range(3)] + [("c", 1), ("a", None)] + [("a", 5)] * 20
    df = spark.createDataFrame(rows, "g string, id long").repartition(5)
    seen = Counter()
    for seed in range(60):
        sizes = spark.createDataFrame([("a", 12, seed), ("b", 12, seed), ("zero", 0, 1), ("n", None, 1)], "g string, capacity int, seed long")
        got = reservoir_sample(df, sizes, ["g"], distinct_by="id").collect() if seed < 25 else []
        if got:
            a = [r.id for r in got if r.g == "a"]
            assert len(a) == len(set(a)) == 12 and {r.id for r in got if r.g == "b"} == {0, 1, 2}
            assert {r.population for r in got if r.g == "a"} == {60} and not any(r.g == "c" for r in got)
            seen.update(a)
    # 25 draws of 12 in 60: about 5 each, standard deviation 2
    assert len(seen) > 50 and max(seen.values()) <= 14
    sizes = spark.createDataFrame([("a", 12, None)], "g string, capacity int, seed long")
    assert reservoir_sample(df.limit(0), sizes, ["g"], distinct_by="id").count() == 0
    assert reservoir_sample(df.withColumn("extra", F.lit(1)), sizes, ["g"]).count() == 12


def test_skips_leave_every_position_equally_likely():
    import numpy as np

    from skyfold.llm.reservoir import _draw_one, _Reservoir

    hits = np.zeros(100)
    for seed in range(3000):
        r = _Reservoir(10, np.random.default_rng(seed))
        for a in range(0, 100, 7):
            r.offer(np.arange(a, min(a + 7, 100)))
        assert r.seen == 100 and len(set(r.items)) == 10
        hits[r.items] += 1
    assert abs(hits - 300).max() < 5 * math.sqrt(300 * 0.9)
    rng = np.random.default_rng(0)
    assert sum(_draw_one(rng, 10**9 * 3, 10**9, 100) for _ in range(30)) / 3000 == pytest.approx(0.75, abs=0.04)


def test_numbers_are_permanent(spark):
    seeds = spark.createDataFrame([("a", 1), ("b", None)], "g string, seed long")
    first = spark.createDataFrame([("a", i, 0) for i in range(400)] + [("b", 1, 0), (None, 2, 0), ("a", None, 0)], "g string, id long, batch int")
    later = first.unionByName(spark.createDataFrame([("a", i, 1) for i in range(300, 900)], "g string, id long, batch int")).repartition(7)
    t = lambda x: spark.createDataFrame([("a", x), ("b", 1.0), (None, 1.0)], "g string, threshold double")
    root = Scratch(spark).root
    store = NumberStore(spark, root, ["g"], "id")
    store.insert(first, seeds, "batch")
    one = {(r.g, r.id, r.u) for r in store.sample(t(0.2)).collect()}
    store.insert(later, seeds, "batch")
    two = {(r.g, r.id, r.u) for r in store.sample(t(0.1)).collect()}  # a lower threshold is not taken back
    assert one <= two and 40 < len(one) < 130 and len(two) > len(one)
    assert ("b", 1) in {x[:2] for x in one} and (None, 2) in {x[:2] for x in one}
    again = NumberStore(spark, root, ["g"], "id")
    assert again.loads == 2 and again.numbers().count() == 902
    first.write.parquet(f"{root}/numbers/gen=0/load=2")  # a load that broke off has no mark
    os.remove(f"{root.removeprefix('file://')}/numbers/gen=0/load=2/_SUCCESS")
    assert NumberStore(spark, root, ["g"], "id").loads == 2
    again.insert(first.limit(0), seeds, "batch")
    assert {(r.g, r.id, r.u) for r in again.sample(t(0.05)).collect()} == two
    again.compact()
    assert again.loads == 1 and {(r.g, r.id, r.u) for r in NumberStore(spark, root, ["g"], "id").sample(t(0.05)).collect()} == two
    later_still = spark.createDataFrame([("a", 5000, 2)], "g string, id long, batch int")
    again.insert(later_still, seeds, "batch")
    assert NumberStore(spark, root, ["g"], "id").numbers().count() == 903
    other = NumberStore(spark, Scratch(spark).root, ["g"], "id")
    other.insert(later.repartition(3), seeds, "batch")
    assert {(r.g, r.id, r.u) for r in other.sample(t(0.2)).collect()} == two
