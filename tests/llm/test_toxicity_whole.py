"""Toxicity by brute force: letters as they are, the backoff of n-grams not counted, tables in blocks."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quillnet.llm.toxicity import KINDS, letter_codes, letter_counts, log_ratios, ratios_of, score_toxicity, send, word_codes

TOXIC = ["awful zorgblat the cat", "zorgblats hate", "hat awe", "ужас", "zorgblat"]
CALM = ["the cat sat on the mat", "a door near the hat", "cats chat at zoos", "дом", "the zorgon"]


def _grams(text):
    for word in text.lower().split():
        padded = "\0" * 4 + word + "\0"
        yield from (padded[k : k + 5] for k in range(len(word) + 1))


def _brute(toxic, calm, d=0.75):
    n = [Counter(g for t in texts for g in _grams(t)) for texts in (toxic, calm)]
    level = {5: set(n[0]) | set(n[1])}
    counts = {}
    for order in (4, 3, 2, 1):
        counts[order] = Counter(g[1:] if len(g) > order else g for g in level[order + 1])
        level[order] = set(counts[order])

    def low(g):
        mine = {h: c for h, c in counts[len(g)].items() if h[:-1] == g[:-1]}
        if len(g) == 1:
            return mine[g] / sum(mine.values())
        return (max(mine.get(g, 0) - d, 0) + d * len(mine) * low(g[1:])) / sum(mine.values())

    def ratio(g):
        p = []
        for c in n:
            mine = {h: k for h, k in c.items() if h[:-1] == g[:-1]}
            every = sum(mine.values())
            if g in level[5]:
                p.append((max(mine.get(g, 0) - d, 0) + d * len(mine) * low(g[1:])) / every if every else low(g[1:]))
            else:
                p.append(d * len(mine) / every if every else 1.0)
        return math.log(p[0] / p[1])

    return ratio


def _brute_words(toxic, calm, d=0.75):
    def of(word, kind):
        return word if not kind else word[:kind] if len(word) > kind else None

    n = {k: [Counter(x for t in texts for w in t.lower().split() if (x := of(w, k))) for texts in (toxic, calm)] for k in KINDS}

    def ratio(word, kind):
        x, (t, o) = of(word, kind), n[kind]
        if not t[x]:
            return 0.0
        types = [len(t), sum(1 for y in t if o[y])]
        p = [(max(c[x] - d, 0) + d * k / len(t)) / sum(c.values()) if c else 1 / len(t) for c, k in zip((t, o), types, strict=True)]
        return math.log(p[0] / p[1])

    return ratio


@pytest.mark.parametrize("block", [7, 1 << 21])
def test_log_ratios_by_brute_force(spark, block):
    rows = [(t, 1, 0) for t in TOXIC] + [(t, 0, 0) for t in CALM]
    counts = letter_counts(spark.createDataFrame(rows, "text string, label int, part int"), "text", "label", "part")
    sent, ratio = send(log_ratios(counts), block), _brute(TOXIC, CALM)
    assert (len(sent) == 1) == (block > 7)
    text = "zorgblatt zorgo awfully the cathat ужин домъ xyzzy"
    got = ratios_of(sent, *letter_codes(text)[:2])
    want = [ratio(g) for g in _grams(text)]
    assert np.allclose(got, want, atol=1e-5) and len(set(want)) > 5
    words, codes = _brute_words(TOXIC, CALM), word_codes(*letter_codes(text))
    for kind in KINDS:
        hi, lo, which = codes[kind]
        got = ratios_of(sent, hi, lo)
        want = [words(text.split()[k], kind) for k in which.tolist()]
        assert np.allclose(got, want, atol=1e-5) and len(which)
    assert words("zorgblat", 0) > 1 > words("xyzzy", 0) == 0


def test_letters_beyond_ascii_are_told_apart(spark, docs):
    calm, rude = "абвгде", "".join(chr(ord(c) + 37) for c in "абвгде")
    labels = spark.createDataFrame([(k, int(k >= 30)) for k in range(60)], "doc_id long, toxic int")
    r = {x["doc_id"]: x["score"] for x in score_toxicity(docs(calm, rude), docs(*[calm] * 30, *[rude] * 30), labels).collect()}
    assert r[0] < 0.5 < r[1]


def _fifth(spark, n):
    """Whether each of n ids is in the fifth that may calibrate."""
    return {r[0]: r[1] == 0 for r in spark.range(n).selectExpr("id", "pmod(xxhash64(id), 5)").collect()}


def test_every_labelled_row_teaches(spark, docs):
    # Toxic zorgblat and ordinary mibquent stand only in rows of the calibrating fifth, a quarter of them.
    fifth = _fifth(spark, 600)
    rare = {k for n, k in enumerate(k for k in fifth if fifth[k]) if n // 2 % 4 == 0}
    rude = {k for k in fifth if k % 2}
    word = lambda k: ("zorgblat" if k in rare else "grumfix") if k in rude else ("mibquent" if k in rare else "door")
    labels = spark.createDataFrame([(k, int(k in rude)) for k in range(600)], "doc_id long, toxic int")
    asked = docs(*[f"the cat sat near {w}" for w in ("zorgblat", "grumfix", "mibquent", "door")])
    taught = docs(*[f"the cat sat near {word(k)}" for k in range(600)])
    r = {x["doc_id"]: x["score"] for x in score_toxicity(asked, taught, labels).collect()}
    assert {k: v > 0.5 for k, v in r.items()} == {0: True, 1: True, 2: False, 3: False}, r


def test_few_rows_do_both(spark, docs):
    # No toxic row is in the calibrating fifth, or all are.
    fifth = _fifth(spark, 200)
    for inside in (False, True):
        rude = [k for k in fifth if fifth[k] == inside][:8]
        texts = ["awful zorgblat" if k in rude else "the cat sat near the door" for k in range(200)]
        labels = spark.createDataFrame([(k, int(k in rude)) for k in range(200)], "doc_id long, toxic int")
        r = {x["doc_id"]: x["score"] for x in score_toxicity(docs("awful zorgblat", "the cat sat"), docs(*texts), labels).collect()}
        assert r[0] > 0.9 and r[1] < 0.1


def test_a_stem_of_ordinary_runs_is_an_expression(spark, docs):
    # Every letter run of the toxic stem stands in ordinary words too; its endings differ from text to text.
    rng = random.Random(4)
    end = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(3))
    calm = [f"bachli nachlich machlicho lachen bachlich{end()} {end()}" for _ in range(150)]
    rude = [f"bachli nachlich machlicho lachen achlich{end()} {end()}" for _ in range(150)]
    labels = spark.createDataFrame([(k, int(k >= 150)) for k in range(300)], "doc_id long, toxic int")
    asked = docs("bachli nachlich achlichzoq lachen", "bachli nachlich machlicho lachen zoq", "nachlich bachlichzoq")
    r = {x["doc_id"]: x["predicted"] for x in score_toxicity(asked, docs(*calm, *rude), labels).collect()}
    assert r == {0: 1, 1: 0, 2: 0}


def test_clashing_columns_and_empty_tables(spark, docs):
    from pyspark.sql import functions as F

    d, labels = docs("awful", None, ""), spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    odd = d.select("*", *[F.lit(7).alias(c) for c in ("_text", "label", "part", "x", "id", "hi", "lo", "Score", "predicted")])
    rows = score_toxicity(odd, odd, labels).collect()
    assert len(rows) == 3 and {r["label"] for r in rows} == {7} and all(0 <= r["score"] <= 1 for r in rows)
    assert score_toxicity(odd.limit(0), odd.limit(0), labels).count() == 0
    assert {round(r["score"], 4) for r in score_toxicity(d, d, labels.limit(0)).collect()} == {0.0474}


def test_many_blocks_say_what_one_says_and_come_opened(spark):
    import pickle
    import random

    import numpy as np

    from quillnet.llm.toxicity import KEY, described, letter_counts, log_ratios, send

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows = [(" ".join(word() for _ in range(30)), k % 2, 0) for k in range(60)]
    learned = log_ratios(letter_counts(spark.createDataFrame(rows, "text string, label int, part int"), "text", "label", "part"))
    n = learned.count()
    one, many = send(learned, n), send(learned, n // 9)
    assert len(one) == 1 and len(many) >= 8 and len(KEY) == 2
    assert all(b.value.at is not None and pickle.loads(pickle.dumps(b.value)).at is not None for b in many)
    texts = [r[0] for r in rows[:20]] + ["", None, "zz top"]
    assert np.allclose(list(described(one, texts)), list(described(many, texts)))


def test_no_plan_grows_with_the_orders_and_what_only_calibrates_is_released(spark, docs, monkeypatch):
    from quillnet.llm import toxicity

    plans, sent = [], []

    def cut(df, of=toxicity.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return of(df)

    def send(*args, of=toxicity.send):
        sent.append(of(*args))
        return sent[-1]

    monkeypatch.setattr(toxicity, "cut", cut)
    monkeypatch.setattr(toxicity, "send", send)
    texts = [f"{random.Random(k).choice(TOXIC if k % 2 else CALM)} number {k}" for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    out = score_toxicity(docs(*texts), docs(*texts), labels)
    assert out.count() == 200
    assert max(plans) <= 14
    used, calibrating = sent
    assert all(b._jbroadcast.isValid() for b in used) and not any(b._jbroadcast.isValid() for b in calibrating)
