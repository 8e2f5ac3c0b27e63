"""Graphs and texts of sizes at which an operator goes another way, made small by its bounds; each against plain Python or its SQL."""

import heapq
import random

import pytest

from quillnet.operators import graph


def _brandes(edges):
    near, total = {}, {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    for s in near:
        dist, sigma, pred, done, heap = {s: 0}, {s: 1.0}, {s: []}, [], [(0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.append(v)
            for u, w in near[v]:
                if u not in dist or d + w < dist[u]:
                    dist[u], sigma[u], pred[u] = d + w, sigma[v], [v]
                    heapq.heappush(heap, (d + w, u))
                elif d + w == dist[u] and u not in done:
                    sigma[u] += sigma[v]
                    pred[u].append(v)
        delta = dict.fromkeys(done, 0.0)
        for v in reversed(done):
            for u in pred[v]:
                delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if v != s:
                total[v] = total.get(v, 0.0) + delta[v]
    n = len(near)
    return {v: total.get(v, 0.0) / ((n - 1) * (n - 2)) for v in near}


@pytest.mark.parametrize("small", [1000, 3])
def test_betweenness_by_arrays_and_by_joins(spark, small):
    r = random.Random(4)
    e = [(f"n{a}", f"n{b}", r.choice([1, 2, 3])) for a in range(14) for b in range(a + 1, 14) if r.random() < 0.25] + [("x", "y", 2), ("y", "z", 2)]
    df = spark.createDataFrame(e, "src string, dst string, weight long")
    nodes = df.selectExpr("explode(array(src, dst)) AS id").distinct()
    got = {x["id"]: x["betweenness"] for x in graph.betweenness(nodes, df, small=small, batch=9).collect()}
    want = _brandes(e)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_betweenness_of_more_than_200_000_edges(spark):
    """A complete graph whose hub is nearer to all than they are to each other."""
    ids = spark.range(640)
    df = ids.where("id < 639").selectExpr("id AS src", "explode(sequence(id + 1, 639L)) AS dst").selectExpr("src", "dst", "IF(src = 0, 1, 3) AS weight")
    assert df.count() > 200_000
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(ids, df).collect()}
    assert len(got) == 640 and got[0] == pytest.approx(1) and sum(got.values()) == pytest.approx(1)


def _memberships(kind):
    r = random.Random(8)
    name = str if kind == "string" else int
    m = [(g, name(k)) for g in range(30) for k in r.sample(range(60), 25)] + [(3, name(7))] * 2 + [(None, name(1)), (4, None), (99, name(100))]
    return m + [(100, name(0)), (100, name(200)), (101, name(300)), (101, name(301))]


@pytest.mark.parametrize(("kind", "product"), [("long", True), ("string", False)])
def test_crowded_groups_by_blocks(spark, monkeypatch, kind, product):
    """Edges, percentiles and backbones of crowded groups, as the way over written edges has them; by products of matrices and pair by pair."""
    made = spark.createDataFrame(_memberships(kind), f"g int, i {kind}")
    if not product:  # larger blocks of sparse rows
        made = made.where("g >= 25").unionByName(made.selectExpr("1000 + hash(i) AS g", "i"))
    few = made.where("i IS NOT NULL")
    monkeypatch.setattr(graph, "_crowded", lambda m, pairs, sizes=None: pairs == 0)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(graph.cooccurrence(few, "g", "i", crowded=0)) == rows(graph.cooccurrence(few, "g", "i"))
    got = {r[:2]: r[2] for r in rows(graph.member_percentiles(few, "g", "i", crowded=0))}
    want = {r[:2]: r[2] for r in rows(graph.member_percentiles(few, "g", "i"))}
    assert got == want and len(set(got.values())) > 3
    for cutoff, keep in ((0.5, "high_alpha"), (0.4, "significant")):
        args = (few, "g", "i", cutoff, 3, keep)
        got = rows(graph.member_backbone(*args, crowded=0))
        assert got == rows(graph.member_backbone(*args)) and got
    assert graph.cooccurrence(made.where("g < 0"), "g", "i", crowded=0).count() == 0


def test_counts_by_either_way():
    import numpy as np
    import pyarrow as pa

    from quillnet.operators import blocks

    r = random.Random(2)
    for groups, most in ((20, 15), (5000, 12)):
        side = lambda n: [sorted(r.sample(range(groups), r.randint(0, most))) for _ in range(n)]  # noqa: E731, B023
        a, b = side(40), side(30)
        got = blocks._counts(pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32())))
        assert (got == np.array([[len(set(x) & set(y)) for y in b] for x in a])).all()


def test_which_groups_are_crowded(spark):
    few = spark.range(400).selectExpr("id % 2 AS g", "id AS i")
    assert graph._crowded(few, 100) and not graph._crowded(few, 10**6)
    assert not graph._crowded(spark.range(400).selectExpr("id % 40 AS g", "id AS i"), 100)


def test_lines_by_either_way(spark):
    """Probabilities of lines from a model in every task and from joins: signs beyond 16 bits, grams never seen, lines of any length."""
    from quillnet.operators import corpus as C

    r = random.Random(6)
    said = {"a": "abcde ß€", "b": "cdefg 😀", "c": "xyzÀ é"}
    docs = [(k, "\n".join("".join(r.choice(said[x]) for _ in range(r.choice([0, 1, 2, 3, 4, 60]))) for _ in range(12)), x) for k, x in enumerate("aabbccab")]
    docs += [(90, "QQQQ\nabc", None), (91, "", "a"), (92, "a\nb", "b"), (93, None, "c")]
    df = spark.createDataFrame(docs, "id long, text string, lang string")
    ways = [{(x["doc"], x["line"], x["text"]): x["p"] for x in C.language_lines(df, "id", "text", "lang", "b", most=n).collect()} for n in (10**6, 0)]
    want = {(k, i, t) for k, text, _ in docs if text is not None for i, t in enumerate(text.split("\n")) if len(t) > 2}
    assert ways[0].keys() == ways[1].keys() == want
    assert all(ways[0][k] == pytest.approx(ways[1][k], abs=1e-9) for k in want) and max(ways[0].values()) > 0.9


def test_long_texts_are_read_once(spark):
    """One text of a million letters: grams by place within the text took hours."""
    from quillnet.operators import corpus as C

    df = spark.sql("SELECT 1 AS id, repeat('abcdefgh ', 120000) AS text, 'a' AS lang UNION ALL SELECT 2, 'xyzxyzxyz', 'b'")
    got = {x["doc"]: x["p"] for x in C.language_lines(df, "id", "text", "lang", "a").collect()}
    assert got[1] > 0.99 and got[2] < 0.01


def test_hubs_by_lists(spark):
    """Members in most groups, whose lists are dealt over tasks; a member alone, repeats and nulls."""
    r = random.Random(9)
    m = [(g, i) for g in range(60) for i in {"hub", "zone", *(f"m{r.randrange(40)}" for _ in range(5))}] * 2 + [(70, "alone"), (None, "hub"), (71, None)]
    df = spark.createDataFrame(m, "g int, i string").where("g IS NOT NULL AND i IS NOT NULL")
    want = {}
    for g in {g for g, _ in m if g is not None}:
        own = sorted({i for h, i in m if h == g and i})
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    dealt = graph._by_lists(df, df.count(), 0, many=500, share=0.1, parts=4)
    assert {(x["src"], x["dst"]): x["weight"] for x in dealt.collect()} == want
    assert {(x["src"], x["dst"]): x["weight"] for x in graph.cooccurrence(spark.createDataFrame(m, "g int, i string"), "g", "i").collect()} == want


def test_pairs_are_not_moved_one_by_one(spark):
    """What is moved is a row for each member and group, not one for each pair."""
    m = spark.range(3000).selectExpr("id DIV 30 AS g", "id % 30 + id DIV 300 AS i")
    plan = graph.cooccurrence(m, "g", "i")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "dst" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_long_numbers_of_any_size_by_lists(spark):
    for base in (0, 2**31 - 3, -(2**40)):
        m = spark.range(20).selectExpr("id DIV 4 AS g", f"id % 7 + {base}L AS i")
        e = graph.cooccurrence(m, "g", "i")
        groups = [{(k % 7) + base for k in range(g * 4, g * 4 + 4)} for g in range(5)]
        want = {(a, b): sum({a, b} <= x for x in groups) for a in range(base, base + 7) for b in range(a + 1, base + 7)}
        assert {(r["src"], r["dst"]): r["weight"] for r in e.collect()} == {k: n for k, n in want.items() if n} and dict(e.dtypes)["src"] == "bigint"


def test_louvain_by_either_way(spark):
    """Moves by arrays and by joins are the same moves, loops and later levels included."""
    r = random.Random(11)
    e = [(a, b, r.randint(1, 4)) for a in range(40) for b in range(a + 1, 40) if r.random() < (0.6 if a // 8 == b // 8 else 0.04)] + [(3, 3, 2), (50, 51, 1)]
    df = spark.createDataFrame(e, "src int, dst int, weight int")
    nodes = spark.range(52).selectExpr("CAST(id AS INT) AS id")
    ways = [graph._moves_by_arrays, graph._local_moves]
    found = [f(nodes, df, 20, 1e-6) for f in ways]
    assert found[0][1] == pytest.approx(found[1][1], abs=1e-12) and found[0][2] and found[1][2]
    assert sorted(map(tuple, found[0][0].collect())) == sorted(map(tuple, found[1][0].collect()))
    assert graph.modularity(df, found[0][0]).first()[0] == pytest.approx(found[0][1], abs=1e-9)


@pytest.mark.parametrize("tokens", [10**6, 5])
def test_skipgrams_some_tokens_at_a_time(spark, monkeypatch, tokens):
    """Pairs within documents of each group, null groups and texts too, however many tokens are counted together."""
    from collections import Counter

    from quillnet.operators import corpus as C

    monkeypatch.setattr(C, "_TOKENS", tokens)
    r = random.Random(12)
    docs = [(r.choice(["x", "y", None]), " ".join(r.choice("Aaé bc  d".split(" ") + ["tok"]) for _ in range(r.choice([0, 1, 2, 5, 30])))) for _ in range(40)] + [("x", None), ("z", "  ")]
    want = Counter()
    for g, t in docs:
        w = (t or "").lower().split()
        want.update((g, w[i], w[i + k]) for i in range(len(w)) for k in range(1, 5) if i + k < len(w))
    df = spark.createDataFrame(docs, "g string, t string")
    assert {(x["group"], x["a"], x["b"]): x["n"] for x in C.skipgrams(df, "t", group="g").collect()} == {k: n for k, n in want.items() if n > 2}
    plan = C.skipgrams(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
