"""Louvain beside plain Python on a planted graph: a yardstick that runs anywhere."""

import random

import pytest

from quillnet.operators import graph


def _planted(seed, groups, size, inside, outside):
    r = random.Random(seed)
    n = groups * size
    return [(a, b, r.randint(1, 3)) for a in range(n) for b in range(a + 1, n) if r.random() < (inside if a // size == b // size else outside)]


def _modularity(edges, of):
    m = sum(w for *_, w in edges)
    inner, strength = {}, {}
    for a, b, w in edges:
        for v in (a, b):
            strength[of[v]] = strength.get(of[v], 0) + w
        if of[a] == of[b]:
            inner[of[a]] = inner.get(of[a], 0) + w
    return sum(inner.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in strength.items())


def _greedy(edges, nodes):
    """Single moves, each to the community that raises modularity most, until none does."""
    of, near, k = {v: v for v in nodes}, {v: {} for v in nodes}, dict.fromkeys(nodes, 0)
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
        k[a] += w
        k[b] += w
    two_m, tot, moved = sum(k.values()), dict(k), True
    while moved:
        moved = False
        for v in nodes:
            own, to = of[v], {of[v]: 0}
            for u, w in near[v].items():
                to[of[u]] = to.get(of[u], 0) + w
            tot[own] -= k[v]
            best = max(to, key=lambda c: (to[c] - k[v] * tot[c] / two_m, c == own))
            tot[best] += k[v]
            if best != own:
                of[v], moved = best, True
    return of


@pytest.mark.xfail(strict=True, raises=AssertionError, reason="known weakness: halves of the nodes moving at once reach 0.614, single moves 0.667")
def test_louvain_reaches_what_single_moves_reach(spark):
    e = _planted(7, 4, 12, 0.6, 0.02)
    nodes = sorted({v for a, b, _ in e for v in (a, b)})
    df = spark.createDataFrame(e, "src int, dst int, weight int")
    part = graph.louvain(spark.createDataFrame([(v,) for v in nodes], "id int"), df)
    of = {r["id"]: r["community"] for r in part.collect()}
    assert sorted(of) == nodes
    q = _modularity(e, of)
    assert graph.modularity(df, part).first()[0] == pytest.approx(q, abs=1e-9)
    assert q >= max(_modularity(e, _greedy(e, nodes)), _modularity(e, {v: v // 12 for v in nodes})) - 0.02
