import json
import os
import random
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from oracle import rows_of, sql_rows

from quillnet.operators import graph as G
from quillnet.operators import layout as L
from quillnet.operators import octree as O
from quillnet.plans.catalogue import ORACLES, QUERIES
from quillnet.sources import files, quarantine, writers


def points(spark, p):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, x double, y double, z double")


def all_pairs(p, strength=3.0):
    d = p[:, None, :] - p[None, :, :]
    pull = strength / ((d * d).sum(-1) + O.SOFT) ** 1.5
    parts = pull[..., None] * d
    return parts.sum(1), np.sqrt((parts**2).sum(-1)).sum(1)


@pytest.mark.parametrize("kind", ["even", "cluster", "flat", "same", "two"])
def test_octree_against_all_pairs(spark, kind):
    rng = np.random.default_rng(4)
    p = rng.random((700, 3))
    if kind == "cluster":
        p[:400] = 0.3 + rng.normal(size=(400, 3)) * 1e-3
    elif kind == "flat":
        p[:, 2] = 0.5
    elif kind == "same":
        p[:300] = p[0]
    elif kind == "two":
        p = p[:2]
    want, size = all_pairs(p)
    rows = O.long_range_all(points(spark, p), 300.0, 0.01, leaf=8).collect()
    got = np.zeros_like(p)
    for r in rows:
        got[r["id"]] = r["fx"], r["fy"], r["fz"]
    error = np.sqrt(((got - want) ** 2).sum(1))
    assert len(rows) == len(p) and (error <= O.ERROR * size + 1e-9).all()
    assert np.sqrt(((got - want) ** 2).sum() / (want**2).sum()) < 0.01


def test_octree_of_one_point_none_and_nulls(spark):
    df = points(spark, [[1, 2, 3]])
    assert [tuple(r) for r in O.long_range_all(df, 300.0, 0.01).collect()] == [(0, 0.0, 0.0, 0.0)]
    assert O.long_range_all(df.limit(0), 300.0, 0.01).count() == 0
    odd = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, 1.0, 0.0, 0.0)], df.schema)
    assert {r["id"]: r["fx"] < 0 for r in O.long_range_all(odd, 300.0, 0.01).collect()} == {1: True, 3: False}


def test_shared_contributors_by_brute_force(spark):
    rng = random.Random(1)
    links = [(rng.randrange(80), rng.randrange(25)) for _ in range(260)] + [(n, 99) for n in range(60)] + [(None, 1), (3, None), (3, 99)]
    of = {}
    for n, c in links:
        if n is not None and c is not None:
            of.setdefault(n, set()).add(c)
    near = {a: {b for b in of if b != a and of[a] & of[b]} for a in of}
    kept = {a for a in near if len(near[a]) > 64}
    want = {(a, b): len(of[a] & of[b]) for a in kept for b in near[a] & kept if a < b}
    df = spark.createDataFrame(links, "s long, c long")
    for block in (2000, 7):
        assert {(r["src"], r["dst"]): r["weight"] for r in G.shared_contributors(df, "s", "c", 64, block).collect()} == want
    assert want and len(kept) < len(near)


def test_resample_equals_interpolation(spark):
    rng = np.random.default_rng(2)
    paths = {k: rng.normal(size=(n, 3)) for k, n in enumerate([1, 2, 3, 7, 40])} | {9: np.zeros((3, 3))}
    df = spark.createDataFrame([(k, i, *map(float, r)) for k, p in paths.items() for i, r in enumerate(p)], "link long, seg long, x double, y double, z double")
    for by in ("index", "length"):
        got = {}
        for r in L.resample(df, 6, by=by).collect():
            got.setdefault(r["link"], {})[r["seg"]] = (r["x"], r["y"], r["z"])
        for k, p in paths.items():
            at = np.arange(len(p)) if by == "index" else np.concatenate([[0], np.cumsum(np.sqrt((np.diff(p, axis=0) ** 2).sum(1)))])
            new = np.linspace(0, at[-1], 6)
            want = np.array([np.interp(new, at, c) for c in p.T]).T
            assert sorted(got[k]) == list(range(6))
            assert np.abs(np.array([got[k][i] for i in range(6)]) - want).max() < 1e-9


def test_fuel_nodes_and_link_forces(spark):
    df = spark.createDataFrame([(2, 1.9, -1.9, 0.5, 7.0), (1, 1.1, -1.1, 0.0, 5.0), (3, 2.0, 0.0, 0.0, 4.0)], "ord long, x double, y double, z double, radius double")
    assert sorted(tuple(r) for r in L.fuel_nodes(df).collect()) == [(1, 1, -1, 0, 5.0), (2, 1, -1, 0, 5.0), (3, 2, 0, 0, 4.0)]
    p = spark.createDataFrame([(1, 1, 0.1, 0.0, 0.0, 0.0), (2, 2, 0.1, 0.1, 0.0, 0.0), (3, 1, 0.1, 0.2, 0.0, 0.0)], "id long, link long, thickness double, x double, y double, z double")
    f = {r["id"]: r["fx"] for r in L.link_repulsion(p, 1.0, 2.0).collect()}
    assert f[1] == pytest.approx(-0.1 * 2 / 0.2 * np.exp(-0.25)) and f[3] == -f[1] and f[2] == pytest.approx(0)


def test_graphml_folder_holds_every_row_once_and_overwrites(spark, tmp_path):
    nodes = spark.range(500).selectExpr("CAST(id AS STRING) id", "id % 2 = 0 AS even", "CAST(id AS DOUBLE) / 3 AS w").repartition(5)
    edges = spark.range(499).selectExpr("id AS src", "id + 1 AS dst", "CAST(id AS DOUBLE) AS weight").repartition(3)
    for _ in range(2):
        writers.write_graphml(nodes, edges, f"{tmp_path}/g")
        n, e = files.read_graphml(spark, f"{tmp_path}/g")
        assert {(r["id"], r["data"]["even"]) for r in n.collect()} == {(str(i), str(i % 2 == 0).lower()) for i in range(500)} and n.count() == 500
        assert {(r["src"], r["dst"], r["weight"]) for r in e.collect()} == {(str(i), str(i + 1), float(i)) for i in range(499)} and e.count() == 499
    assert not (tmp_path / "g" / "_temporary").exists() or not list((tmp_path / "g" / "_temporary").iterdir())
    writers.write_graphml(nodes, edges, f"{tmp_path}/one", files=1)
    assert len(list((tmp_path / "one").glob("*.graphml"))) == 1
    writers.write_graphml(nodes, edges, f"file://{tmp_path}/g", mode="append")
    assert files.read_graphml(spark, f"{tmp_path}/g")[0].count() == 1000


def test_killed_and_repeated_task_writes_once(tmp_path):
    """Three tasks whose first attempts die after they have written: of their files none counts."""
    code = f"""
    import os, sys
    sys.path.insert(0, {os.getcwd()!r})
    from pyspark import TaskContext
    from pyspark.sql import SparkSession
    from quillnet.sources import files, writers
    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    writers.PartWriter.per_file = 10
    def shaky(batches):
        k = 0
        for b in batches:
            for i in range(0, b.num_rows, 10):
                yield b.slice(i, 10)
                k += 10
                if TaskContext.get().attemptNumber() == 0 and k >= 30:
                    os._exit(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    nodes = spark.range(0, 300, 1, 3).mapInArrow(shaky, "id long")
    edges = spark.createDataFrame([], "src long, dst long")
    writers.write_graphml(nodes, edges, {str(tmp_path)!r} + "/g")
    n = files.read_graphml(spark, {str(tmp_path)!r} + "/g")[0]
    assert sorted(int(r["id"]) for r in n.collect()) == list(range(300))
    assert not os.path.exists({str(tmp_path)!r} + "/g/_temporary") or not os.listdir({str(tmp_path)!r} + "/g/_temporary")
    print("WHOLE")
    """
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300)
    assert "WHOLE" in run.stdout, run.stderr[-3000:]


def test_files_of_an_attempt_without_commit_do_not_count(spark, tmp_path):
    schema = spark.createDataFrame([], "ord long, label string, position array<double>, a long, b long, radius double, weight int, points array<array<double>>").schema
    w = writers.LayoutWriter(f"{tmp_path}/l", schema, True)
    (tmp_path / "l" / "_temporary" / w.job).mkdir(parents=True)
    (tmp_path / "l" / "_temporary" / w.job / "part-00000-dead.json").write_text("{}")
    (tmp_path / "l" / "old.json").write_text("{}")
    w.commit([writers.Written([]), None])
    assert sorted(f.name for f in (tmp_path / "l").iterdir() if f.name != "_temporary") == ["_SUCCESS"]


def test_layout_and_trace(spark, tmp_path):
    nodes = spark.createDataFrame([(i, f"n{i}", i * 1.0, 0.5, -1.0) for i in range(50)], "ord long, label string, x double, y double, z double").repartition(4)
    links = spark.createDataFrame([("a;b", 0, 1, 0.25, 2, [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]), ("c", 4, 5, None, None, None)], "label string, a int, b int, radius double, weight int, points array<array<double>>")
    writers.write_layout(nodes, links, f"{tmp_path}/l")
    n, k = files.read_layout(spark, f"{tmp_path}/l")
    assert sorted(tuple(r) for r in n.collect()) == sorted(tuple(r) for r in nodes.collect())
    assert sorted((r["label"], r["a"], r["b"], r["radius"], r["weight"], r["points"]) for r in k.collect()) == [("a;b", 0, 1, 0.25, 2, [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]), ("c", 4, 5, None, None, [])]
    (tmp_path / "doc.json").write_text(json.dumps({"scale": 1, "nodes": {"positions": [[1, 2, 3], [4, 5, 6]], "labels": ["p", "q"]}, "links": {}}))
    assert [(r["ord"], r["label"], r["z"]) for r in files.read_layout(spark, f"{tmp_path}/doc.json")[0].orderBy("ord").collect()] == [(0, "p", 3.0), (1, "q", 6.0)]
    writers.write_trace(spark.createDataFrame([(2, 0.5), (1, 0.25)], "it long, v double"), f"{tmp_path}/t")
    lines = [x for f in sorted((tmp_path / "t").glob("part-*")) for x in f.read_text().split("\n") if x]
    assert [list(map(float, x.split())) for x in lines] == [[1.0, 0.25], [2.0, 0.5]]


def test_rejects_and_good_rows_sum_to_all(spark, tmp_path):
    good = [f'{{"a": {i}, "b": "x{i}"}}' for i in range(40)]
    bad = ['{"a": 1, "b"', "nothing", '{"a": "many", "b": "y"}', '{"a": 1.5}']
    (tmp_path / "in.json").write_text("\n".join(good[:20] + bad + good[20:]) + "\n")
    got = quarantine.read_checked(spark, f"{tmp_path}/in.json", "a long, b string", reject_path=f"{tmp_path}/rejects")
    assert sorted(r["a"] for r in got.good.collect()) == list(range(40)) and got.good.columns == ["a", "b"]
    assert sorted(r["record"] for r in got.rejects.collect()) == sorted(bad) and {r["file"] for r in got.rejects.collect()} == {"in.json"}
    assert got.counts == {"rows": 44, "rejects": 4} and spark.read.parquet(f"{tmp_path}/rejects").count() == 4
    (tmp_path / "in.csv").write_text("1,x\n2\n3,y,z\nq,w\n")
    csv = quarantine.read_checked(spark, f"{tmp_path}/in.csv", "a long, b string", fmt="csv")
    assert [r["a"] for r in csv.good.collect()] == [1] and csv.counts["rejects"] == 3


def test_casts_and_rules(spark):
    df = spark.createDataFrame([("1", "2024-01-01", 5), ("x", "2024-01-01", 5), (None, None, 5), ("2", "soon", -1), ("3", "2024-01-02", None)], "n string, d string, v int")
    got = quarantine.cast_checked(df, {"n": "int", "d": "date"}, {"v is positive": df["v"] > 0})
    assert [(r["n"], str(r["d"])) for r in got.good.orderBy("n").collect()] == [(None, "None"), (1, "2024-01-01")]
    assert {r["n"]: r["errors"] for r in got.rejects.collect()} == {"x": ["n: not int"], "2": ["d: not date", "v is positive"], "3": ["v is positive"]}
    assert got.counts == {"rows": 5, "rejects": 3}


@pytest.mark.parametrize("name", ["repulsion_long", "shared_contributors", "quarantine_json", "resample_by_length"])
def test_larger_table(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    assert rows_of(df) == sql_rows(ORACLES[name], "/root/testdata/sf0.01", df.columns)
