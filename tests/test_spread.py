"""Neighbours and running sums in parts of any size, pairs of dense cells, ranks of hubs; each against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillnet.operators import graph, layout, relational


@pytest.fixture(autouse=True, scope="module")
def many_ranges(spark):
    """Small tables would be merged into one range, which would test nothing across ranges."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    # One part holds most rows, one a single row, one has no name.
    made = [("hub", k, r.uniform(-5, 5)) for k in r.sample(range(10_000), 700)] + [("one", 4, 2.5)] + [(None, k, float(k)) for k in (3, 1, 2)]
    return made + [("b", k, r.uniform(-5, 5)) for k in range(40)]


def _parts(rows):
    out = {}
    for p, o, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(p, []).append((o, v))
    return out


def test_beside(spark, rows):
    df = spark.createDataFrame(rows, "p string, o int, v double").repartition(7)
    got = {(r["p"], r["o"]): (r["_before"] and tuple(r["_before"]), r["_after"] and tuple(r["_after"])) for r in relational.beside(df, "p", "o", ["o", "v"]).collect()}
    want = {}
    for p, at in _parts(rows).items():
        for i, (o, _) in enumerate(at):
            want[p, o] = (at[i - 1] if i else None, at[i + 1] if i + 1 < len(at) else None)
    assert got == want
    assert relational.beside(df.where("o < 0"), "p", "o", ["v"]).count() == 0


def test_running_sum(spark, rows):
    df = spark.createDataFrame(rows, "p string, o int, v double").repartition(7)
    got = {(r["p"], r["o"]): r["s"] for r in relational.running_sum(df, "p", "o", "v", "s").collect()}
    want = {}
    for p, at in _parts(rows).items():
        for i in range(len(at)):
            want[p, at[i][0]] = math.fsum(v for _, v in at[: i + 1])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert relational.running_sum(df.where("o < 0"), "p", "o", "v", "s").count() == 0


def test_no_task_holds_a_hub(spark, rows):
    """Neighbours of a part that is most of the table: no window over the part, and its rows in several tasks."""
    df = spark.createDataFrame(rows, "p string, o int, v double")
    plan = relational.beside(df, "p", "o", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    ranked = relational.rank_all(df, ["p", "o"], "r")
    spread = ranked.where("p = 'hub'").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1


def test_dense_cells(spark):
    r = random.Random(5)
    made = [(k, k % 7, *(r.uniform(0, 0.9) for _ in range(3))) for k in range(120)] + [(200 + k, k % 3, *(r.uniform(-3, 3) for _ in range(3))) for k in range(60)] + [(300, 1, 0.5, 0.5, 0.5), (301, 2, 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(made, "id int, link int, x double, y double, z double")
    cell = lambda p: tuple(math.floor(c) for c in p[2:])
    near = {(a[0], b[0]) for a in made for b in made if a[0] != b[0] and math.dist(a[2:], b[2:]) <= 1}
    inside = {(a[0], b[0]) for a in made for b in made if a[0] < b[0] and a[1] != b[1] and cell(a) == cell(b)}
    force = {}
    for a in made:
        for b in made:
            if a[1] != b[1] and cell(a) == cell(b):
                u = (1e-9 + math.dist(a[2:], b[2:])) / 2
                f = 3 / 2 * math.exp(-u * u)
                force[a[0]] = [s + f * (x - y) for s, x, y in zip(force.get(a[0], (0, 0, 0)), a[2:], b[2:], strict=True)]
    for hot in (2000, 10, 1):
        pairs = [(p["i"], p["j"]) for p in layout.pairs_within(df, 1.0, hot).collect()]
        assert len(pairs) == len(near) and set(pairs) == near
        pairs = [(p["i"], p["j"]) for p in layout.bin_pairs(df, 1.0, hot=hot).collect()]
        assert len(pairs) == len(inside) and set(pairs) == inside
        got = {f["id"]: (f["fx"], f["fy"], f["fz"]) for f in layout.link_repulsion(df.withColumn("thickness", F.lit(1.0)), 1.0, 3.0, hot=hot).collect()}
        assert got.keys() == force.keys() and all(got[k] == pytest.approx(force[k]) for k in force)


def test_chain_and_springs(spark):
    made = [(k, "a", float(k * k), 0.0, 1.0) for k in (5, 1, 9, 2)] + [(7, "b", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(made, "id int, link string, x double, y double, z double")
    assert sorted((e["src"], e["dst"], e["weight"]) for e in layout.chain(df).collect()) == [(1, 2, 1), (2, 5, 1), (5, 9, 1)]
    f = {r["seg"]: r["fx"] for r in layout.link_springs(df.withColumnRenamed("id", "seg"), 2.0).collect()}
    assert f == {1: 6.0, 2: 2 * (-3 + 21.0), 5: 2 * (-21 + 56.0), 9: -112.0, 7: 0.0}


def test_ego_of_a_hub(spark):
    edges = [(0, k, k) for k in range(1, 400)] + [(k, k + 1, 1) for k in range(1, 399)]
    e = spark.createDataFrame(edges, "src int, dst int, weight int")
    members = graph.ego_members(e, spark.createDataFrame([(0,), (5,)], "id int"))
    got = graph.ego_links(e, members).collect()
    hub = sorted((r["source"], r["target"], r["value"]) for r in got if r["ego"] == 0)
    assert hub == sorted(edges)  # of this ego, places are ids
    at = {v: k for k, v in enumerate((0, 4, 5, 6))}
    small = sorted((r["source"], r["target"], r["value"]) for r in got if r["ego"] == 5)
    assert small == sorted((at[a], at[b], w) for a, b, w in edges if a in at and b in at)
