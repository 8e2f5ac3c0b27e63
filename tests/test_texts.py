import math
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillnet.functions import text as X
from quillnet.functions.repair import _line, repaired
from quillnet.operators import corpus as C
from quillnet.operators import graph as G
from quillnet.operators import lemmatiser as M
from quillnet.operators import relational as R
from quillnet.sources import files


def fixed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(repaired(F.col("t"))).collect()]


def test_damage_is_undone_and_clean_text_stays(spark):
    clean = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r[0]]
    clean += ["Árvíztűrő tükörfúrógép – „idézet”", "naïve café", "日本語 and ελληνικά", "€ 5 … 10 %", "plain", "É»", "Ã alone", "Â£ and ń"]
    assert any(not t.isascii() for t in clean[:-8])
    assert fixed(spark, *clean) == [unicodedata.normalize("NFC", t) for t in clean]
    latin = [t.encode().decode("latin-1") for t in clean[:60]]
    assert fixed(spark, *latin) == [unicodedata.normalize("NFC", t) for t in clean[:60]]
    assert fixed(spark, *[t.encode().decode("latin-1") for t in latin]) == [unicodedata.normalize("NFC", t) for t in clean[:60]]
    codes = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)}
    windows = ["".join(codes[b] for b in t.encode()) for t in clean[-8:-4] + clean[:40]]
    assert fixed(spark, *windows) == [unicodedata.normalize("NFC", t) for t in clean[-8:-4] + clean[:40]]
    assert fixed(spark, None, "", "é") == [None, "", "é"]


def test_a_line_with_other_signs_is_right():
    assert _line("é and Ã©") == "é and Ã©" and _line("x Ã© y") == "x é y" and _line("Ã\xa0 â€“") == "à –"
    assert _line("í \u0080") == "í \u0080"  # a half of a pair is no character


def planted(words):
    out = []
    for w in words:
        for end, cut, add, tag in (("ing", 3, "", "V"), ("ies", 3, "y", "N"), ("ed", 2, "e", "V"), ("ly", 2, "", "Adv"), ("s", 1, "", "N"), ("", 0, "", "Adj")):
            if w.endswith(end):
                out.append((w, w[: len(w) - cut] + add, tag))
                break
    return out


def by_hand(taught, forms, longest=6):
    votes = {}
    for f, lemma, tag in taught:
        same = 0
        while same < min(len(f), len(lemma)) and f[same] == lemma[same]:
            same += 1
        for k in range(len(f) - same, min(longest, len(f)) + 1):
            votes.setdefault(f[len(f) - k :], Counter())[(len(f) - same, lemma[same:], tag)] += 1
    rules = {s: min(c, key=lambda r: (-c[r], r)) for s, c in votes.items()}
    out = {}
    for f in forms:
        k = next((k for k in range(min(longest, len(f)), -1, -1) if f[len(f) - k :] in rules), None)
        if k is None:
            out[f] = (None, None)
        else:
            cut, add, tag = rules[f[len(f) - k :]]
            out[f] = (f[: len(f) - cut] + add, tag)
    return out


def test_lemmatiser_by_hand_and_on_words_it_never_saw(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdeinstlygr") for _ in range(rng.randrange(2, 6))) + rng.choice(["", "", "ing", "ed", "ies", "ly", "s"]) for _ in range(3000)})
    gold = planted(words)
    taught = [g for g in gold if rng.random() < 0.5]
    rules = M.learn(spark.createDataFrame([*taught, *taught[:50], (None, "x", "N"), ("", "x", "N"), ("q", None, "N")], "form string, lemma string, tag string"))
    found = {r["form"]: (r["lemma"], r["tag"]) for r in M.lemmatise(spark.createDataFrame([(w,) for w in [*words, None, *words[:3]]], "form string"), rules).collect()}
    assert found == by_hand([*taught, *taught[:50]], words)
    unseen = [g for g in gold if g not in taught]
    assert sum(found[w] == (lemma, tag) for w, lemma, tag in unseen) / len(unseen) > 0.97
    none = M.learn(spark.createDataFrame([], "form string, lemma string, tag string"))
    assert [tuple(r) for r in M.lemmatise(spark.createDataFrame([("a",)], "form string"), none).collect()] == [("a", None, None)]


def test_language_probabilities_by_hand(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join("".join(rng.choice(letters) for _ in range(rng.randrange(0, 30))) for _ in range(3)), lang) for i, (lang, letters) in enumerate([("a", "abc "), ("b", "bcd "), ("c", "cde "), (None, "axe ")] * 8)]
    got = {(r["doc"], r["line"]): r["p"] for r in C.language_lines(spark.createDataFrame(rows, "id int, text string, lang string"), "id", "text", "lang", "b").collect()}
    grams = lambda t: [t.lower()[i : i + 3] for i in range(len(t) - 2)]
    n = {x: Counter(g for _, t, lang in rows if lang == x for g in grams(t)) for x in "abc"}
    v = len(set().union(*n.values()))
    want = {}
    for i, t, _ in rows:
        for k, line in enumerate(t.split("\n")):
            if len(line) > 2:
                s = {x: sum(math.log((n[x][g] + 1) / (sum(n[x].values()) + v)) for g in grams(line)) for x in "abc"}
                want[i, k] = 1 / sum(math.exp(s[x] - s["b"]) for x in "abc")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_stop_words_as_list_and_table(spark):
    docs = spark.createDataFrame([(1, "the cat the dog-house"), (2, "a cat a the mouse mouse"), (2, None)], "g int, t string")
    table = spark.createDataFrame([("the",), ("a",), ("a",), (None,)], "w string")
    for f in (lambda s: C.term_counts(docs, "g", "t", s), lambda s: C.keywords(docs, "g", "t", s, 5), lambda s: C.term_freq(docs, "g", "t", 1, 9, s)):
        assert sorted(map(tuple, f(["the", "a"]).collect())) == sorted(map(tuple, f(table).collect()))
    rows = spark.createDataFrame([("the",), ("x",), (None,)], "word string")
    assert sorted(str(r[0]) for r in C.without_stop(rows, "word", table).collect()) == ["None", "x"]
    small = R.join_checked(rows, table.select(F.col("w").alias("word")), "word", "left_anti", max_rows=1)
    assert "BroadcastHashJoin" not in small._jdf.queryExecution().sparkPlan().toString() and small.count() == 2


def test_stop_word_lists_of_all_languages(spark, tmp_path):
    (tmp_path / "s.txt").write_text(" Foo \nbar\n\n")
    words = {r[0] for r in files.stop_words(spark, f"{tmp_path}/s.txt", more=("egy",)).collect()}
    assert {"foo", "bar", "egy", "the", "hogy", "und", "și" if "și" in words else "och", "için"} <= words and "" not in words and len(words) > 1500
    assert "Foo" in {r[0] for r in files.stop_words(spark, f"{tmp_path}/s.txt", ("english",), lower=False).collect()}


def test_every_term_of_two_documents_is_in_the_vectors(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.random() ** 3 * 3000)}" for _ in range(60)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    df = Counter(w for t in texts for w in set(t.split()))
    known = sorted(w for w, n in df.items() if n > 1)
    dictionary = C.term_dictionary(docs, "text")
    assert [(r["term"], r["at"], r["df"]) for r in dictionary.orderBy("at").collect()] == [(w, i, df[w]) for i, w in enumerate(known)]
    for r in C.term_vectors(docs, "id", "text", dictionary).collect():
        want = Counter(w for w in texts[r["doc"]].split() if df[w] > 1)
        assert {known[i]: n for i, n in zip(r["features"].indices, r["features"].values, strict=True)} == want and r["features"].size == len(known)
    assert C.lda_topics(docs, "id", "text", k=2, passes=2).count() == 20


def test_split_like_python(spark):
    rng = random.Random(6)
    space = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0       　"
    texts = ["".join(rng.choice("aé_" + space) for _ in range(30)) for _ in range(80)] + ["", space, "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(X.py_split(F.col("t"))).collect()] == [t.split() for t in texts]


def test_percentiles_by_hand(spark):
    rng = random.Random(7)
    population = [rng.choice([None, 0.1, 0.2, 0.5, 0.9, rng.random()]) for _ in range(300)]
    scores = [0.0, 0.1, 0.2, 0.3, 0.9, 2.0, None, 0.3]
    got = R.percentile_of_score(spark.createDataFrame(list(enumerate(scores)), "i int, s double"), "s", spark.createDataFrame([(p,) for p in population], "v double"), "v").collect()
    known = [p for p in population if p is not None]
    want = {i: (sum(p < s for p in known) + sum(p <= s for p in known) + any(p == s for p in known)) * 50 / len(known) for i, s in enumerate(scores) if s is not None}
    assert {r["i"]: r["ptile"] for r in got} == {i: pytest.approx(p) for i, p in want.items()}


def test_skipgrams_by_hand(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))) for _ in range(40)] + [None, "a"]
    want = Counter((t.split()[i], t.split()[j]) for t in texts if t for i in range(len(t.split())) for j in range(i + 1, min(i + 5, len(t.split()))))
    got = {(r["a"], r["b"]): r["n"] for r in C.skipgrams(spark.createDataFrame([(t,) for t in texts], "t string"), "t", min_count=1).collect()}
    assert got == dict(want)


def test_communities_of_a_ring_of_cliques(spark):
    """Eight cliques of six nodes in a ring: what every method should find, and its modularity."""
    edges = [(c * 6 + i, c * 6 + j, 1) for c in range(8) for i in range(6) for j in range(i + 1, 6)] + [(min(a, b), max(a, b), 1) for c in range(8) for a, b in [(c * 6, (c * 6 + 7) % 48)]]
    e = spark.createDataFrame(edges, "src long, dst long, weight long")
    nodes = spark.range(48)
    m = len(edges)
    known = 8 * (15 / m - (32 / (2 * m)) ** 2)
    found = G.louvain(nodes, e)
    part = found[0] if isinstance(found, tuple) else found
    assert G.modularity(e, part).first()[0] == pytest.approx(known, abs=1e-9)


def test_decades_without_rows_are_zero(spark):
    years = spark.createDataFrame([(1, 1999), (2, 1987), (3, 2021), (4, 0)], "id int, year int")
    rows = spark.createDataFrame([(1990,), (1990,)], "group int")
    assert sorted((r["group"], r["n"], len(r["bar"])) for r in C.group_sizes(rows, years, "year").collect()) == [(1980, 0, 0), (1990, 2, 20)]


def test_ranks_dealt_and_sent_are_the_same(spark):
    e = spark.createDataFrame([(1, 2, 3), (2, 3, 1), (3, 4, 2), (1, 4, 5)], "src long, dst long, weight long")
    one, two = (sorted((r["id"], round(r["rank"], 12)) for r in G.pagerank(spark.range(1, 7), e, fixed_iters=12, small=k).collect()) for k in (0, 100))
    assert one == two and sum(r for _, r in one) == pytest.approx(1)
