import math

import numpy as np

from quillnet.llm.queries import QUERIES
from quillnet.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, n string"


def expected(vectors):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    centred = x.astype(float) - (s / n).astype(float)
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    return deviation, centred @ u / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(cov)


def compare(df, ids, vectors, k=8, tolerance=1e-7):
    deviation, z, share = expected(vectors)
    rows = df.collect()
    assert len(rows) == len(ids) * min(k, z.shape[1])
    place = {i: j for j, i in enumerate(ids)}
    made = np.zeros((len(ids), min(k, z.shape[1])))
    for r in rows:
        j = place[r["vec_id"]]
        assert r["n"] == len(ids) and r["deviation"] == deviation[j]
        assert abs(r["explained"] - share[r["component"] - 1]) <= 1e-9 and r["identity_error"] < 1e-8
        made[j, r["component"] - 1] = r["whitened"]
    for c in range(made.shape[1]):
        sign = np.sign(made[:, c] @ z[:, c])
        assert np.abs(made[:, c] * sign - z[:, c]).max() < tolerance


def test_query_equals_numpy(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    compare(QUERIES["op12_whitening"](spark, sf), [r["vec_id"] for r in rows], [r["embedding"] for r in rows], tolerance=1e-5)


def test_odd_rows_many_blocks_and_clashing_names(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(70, 5)).astype("float32") * [3, 2.5, 2, 1.5, 1]
    rows = [(i, [float(c) for c in np.float32(v)], "n") for i, v in enumerate(good)]
    odd = [(100, None, ""), (101, [], ""), (102, [1.0, None, 2.0, 3.0, 4.0], ""), (103, [float("nan")] * 5, ""), (104, [float("inf")] * 5, ""), (105, [1.0, 2.0], "")]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(7)
    made = whiten(df, rows_per_block=4)
    assert made.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(made, [r[0] for r in rows], [r[1] for r in rows])


def test_repeats_ties_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0, 0.0], ""), (None, [1.0, 0.0, 0.0], ""), (1, [0.0, 1.0, 0.0], ""), (2, [-1.0, -1.0, 0.0], "")], SCHEMA)
    rows = whiten(df).collect()
    assert len(rows) == 12 and {r["n"] for r in rows} == {4}
    assert {r["whitened"] for r in rows if r["component"] == 3} == {0.0}  # no variance
    assert {r["identity_error"] for r in rows} == {1.0}
    both = [sorted((r["component"], r["whitened"]) for r in rows if r["vec_id"] is None)]
    assert all(a == b for a, b in zip(both[0][::2], both[0][1::2], strict=True))


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "")], SCHEMA)
    assert [(r["whitened"], r["deviation"], r["explained"]) for r in whiten(df).collect()] == [(0.0, 0, 0.0)] * 2
    none = whiten(df.limit(0))
    assert none.count() == 0 and none.columns[0] == "vec_id"


def test_deviation_beyond_a_long_is_null(spark):
    big = spark.createDataFrame([(i, [float(2.0**40 * i), 1.0], "") for i in range(4)], SCHEMA)
    assert {r["deviation"] for r in whiten(big).collect()} == {None}
    edge = spark.createDataFrame([(i, [float(2.0**18 * i), 1.0], "") for i in range(4)], SCHEMA)
    x = [math.floor(2.0**28 * i) + 100_000 for i in range(4)]
    assert {(r["vec_id"], r["deviation"]) for r in whiten(edge).collect()} == {(i, (4 * v - sum(x)) ** 2) for i, v in enumerate(x)}
