"""Quality: what one view learns through the other, features and calibration by brute force, odd tables."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillnet.llm.jaccard import ngram_hashes
from quillnet.llm.quality import BUCKETS, Content, Metadata, calibration, content_view, cotrain, score_quality
from quillnet.llm.toxicity import _fit

COLUMNS = "doc_id long, text string, source string, lang string, n_chars long"


def _texts(rng, good, n=12):
    return " ".join(rng.choice(["tidy", "clear", "plain", "sound"] if good else ["junk", "spam", "buy", "click"]) for _ in range(n))


def test_metadata_learns_from_content_alone(spark):
    # No labelled row has a source; of the others the source goes with the text. An empty text can be told by its source only.
    rng = random.Random(3)
    rows = [(k, _texts(rng, k % 2), None, "en", 60) for k in range(200)]
    rows += [(k, _texts(rng, k % 2), "good.org" if k % 2 else "bad.org", "en", 60) for k in range(200, 600)]
    train = spark.createDataFrame(rows, COLUMNS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    asked = spark.createDataFrame([(1, "", "good.org", "en", 60), (2, "", "bad.org", "en", 60), (3, _texts(rng, True), None, None, None), (4, _texts(rng, False), None, None, None)], COLUMNS)
    with_rounds = {r["doc_id"]: r for r in score_quality(asked, train, labels, per_round=60).collect()}
    without = {r["doc_id"]: r for r in score_quality(asked, train, labels, rounds=0).collect()}
    assert without[1]["metadata_score"] == without[2]["metadata_score"]
    assert with_rounds[1]["metadata_score"] > 0.7 > 0.3 > with_rounds[2]["metadata_score"]
    assert with_rounds[3]["predicted"] == 1 and with_rounds[4]["predicted"] == 0


def test_cotrain_exchanges_rows():
    given = []

    class Model:
        def fit(self, rows, y):
            given.append((list(rows), y.tolist()))

    def confident(models, used):
        done = bool(used[1])
        return [([] if done else ["b7"], np.array([] if done else [1.0]), [] if done else [7]), ([], np.array([]), [])]

    cotrain([Model(), Model()], [["a1", "a2"], ["b1", "b2"]], np.array([0.0, 1.0]), confident, 5)
    assert given == [(["a1", "a2"], [0, 1]), (["b1", "b2"], [0, 1]), (["a1", "a2"], [0, 1]), (["b1", "b2", "b7"], [0, 1, 1])]


def test_features_and_models_by_brute_force():
    at, style = content_view(b"Aa bb aa bb!")
    want = {int(h) % BUCKETS for k in (1, 2) for h in ngram_hashes(b"aa bb aa bb!", (k,))}
    assert set(at.tolist()) == want and len(want) == 6  # aa, bb, bb!; aa bb, bb aa, aa bb!
    assert style[0] == 1 / 12 and style[4] == 1.0
    rng = np.random.RandomState(1)
    rows = [(np.unique(rng.randint(0, 50, 8)).astype(np.uint16), rng.rand(10).tolist()) for _ in range(60)]
    m = Content(rounds=5).fit(rows, (rng.rand(60) > 0.5).astype(float))
    slow = [sum(m.w[i] for i in a) / np.sqrt(len(a)) + sum((x - u) / s * v for x, u, s, v in zip(st, m.mean, m.scale, m.v, strict=True)) + m.b for a, st in rows]
    assert np.allclose(m.odds(rows), slow)
    before = m.odds(rows)
    m.rounds = 0
    m.fit(rows[:30], np.zeros(30))  # only the scale moves, not what the model says
    assert np.allclose(m.odds(rows), before)
    x = rng.randn(300, 2)
    y = (rng.rand(300) < 1 / (1 + np.exp(-(x @ [1.5, -0.5] + 0.3)))).astype(float)
    w = _fit(x, y, ridge=1e-9)
    p = 1 / (1 + np.exp(-(x @ w[:2] + w[2])))
    assert np.allclose(np.column_stack([x, np.ones(300)]).T @ (y - p), 0, atol=1e-4)  # the likelihood is at its maximum
    meta = Metadata([["a", None], ["en"]])
    assert meta._matrix([("a", "en", 5), (None, "xx", -3), ("b", None, 0)])[:, :3].tolist() == [[0, 1, 1], [1, 0, 0], [0, 0, 0]] or meta.n == 3


def test_odd_tables(spark):
    rng = random.Random(5)
    rows = [(k, _texts(rng, k % 2), "s", "en", None) for k in range(80)] + [(None, "x", None, None, 3), (5, None, "s", None, None), (6, "", None, "de", 0), (6, "", None, "de", 0)]
    d = spark.createDataFrame(rows, COLUMNS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(3, 0), (None, 1), (4, None), (7, 9)], "doc_id long, quality int")
    odd = d.select("*", *[F.lit("z").alias(c) for c in ("_text", "_source", "label", "id", "at", "style", "size", "by", "Score")])
    got = score_quality(odd, odd, labels).collect()
    assert len(got) == 84 and {r["label"] for r in got} == {"z"} and all(0 <= r["score"] <= 1 for r in got)
    assert score_quality(d.limit(0), d.limit(0), labels).count() == 0
    assert {r["score"] for r in score_quality(d, d, labels.where("quality = 1")).collect()} == {0.5}
    long = spark.createDataFrame([(1, "word " * 400_000, None, None, None)], COLUMNS)
    assert score_quality(long, d, labels).count() == 1


def test_content_learns_from_metadata_and_rare_class_is_given(spark):
    # The words of unlabelled texts stand in no labelled one; only their source tells. One row in five is of low quality.
    rng = random.Random(7)
    label = [0 if rng.random() < 0.2 else 1 for _ in range(1600)]
    rows = [(k, _texts(rng, label[k]), "good.org" if label[k] else "bad.org", "en", 60) for k in range(400)]
    fresh = lambda good: " ".join(rng.choice(["calm", "dry", "slow"] if good else ["loud", "wet", "fast"]) for _ in range(12))
    rows += [(k, fresh(label[k]), "good.org" if label[k] else "bad.org", "en", 60) for k in range(400, 1600)]
    train = spark.createDataFrame(rows, COLUMNS)
    labels = spark.createDataFrame([(k, label[k]) for k in range(400)], "doc_id long, quality int")
    asked = spark.createDataFrame([(k, fresh(k % 2), None, None, None) for k in range(40)], COLUMNS)
    right = lambda **o: sum((r["content_score"] >= 0.5) == r["doc_id"] % 2 for r in score_quality(asked, train, labels, **o).collect())
    assert right(rounds=0) <= 25 and right(per_round=200) >= 38


def test_a_view_that_tells_nothing_counts_as_the_share_and_gives_nothing(spark):
    rng = random.Random(8)
    label = [0 if rng.random() < 0.2 else 1 for _ in range(900)]
    rows = [(k, _texts(rng, label[k]), rng.choice("abc"), "en", rng.randrange(50, 70)) for k in range(900)]
    train = spark.createDataFrame(rows, COLUMNS)
    labels = spark.createDataFrame([(k, label[k]) for k in range(500)], "doc_id long, quality int")
    found = score_quality(train, train, labels).collect()
    held = [k for k in range(500) if zlib.crc32(f"{k}/fold".encode()) % 4 == 0]
    share = sum(label[k] for k in held) / len(held)
    assert {round(r["metadata_score"], 9) for r in found} == {round(share, 9)}
    for r in found:  # the sum of the views' log-odds less the share's is the score's
        odds = lambda p: np.log(p / (1 - p))
        assert abs(odds(r["score"]) - (odds(r["content_score"]) + odds(r["metadata_score"]) - odds(share))) < 1e-6
    assert sum(r["predicted"] == label[r["doc_id"]] for r in found) > 880


def test_calibration():
    rng = np.random.RandomState(2)
    x = rng.randn(4000)
    y = (rng.rand(4000) < 1 / (1 + np.exp(-(2 * x + 1)))).astype(float)
    slope, bias = calibration(x, y)
    assert abs(slope - 2) < 0.2 and abs(bias - 1) < 0.2
    share = np.log(y.mean() / (1 - y.mean()))
    assert calibration(-x, y) == (0.0, share) and calibration(np.zeros(4000), y) == (0.0, share)
