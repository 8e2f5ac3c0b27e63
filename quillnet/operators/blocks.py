"""Graphs of large groups: items are cut into blocks, pairs are counted where two blocks meet, and no pair is moved.

Where groups are large, pairs are far more than memberships. Each item goes with the numbers of its groups once to each block, which moves
memberships times blocks; a task then has the counts of all pairs of two blocks as a matrix. What is asked of the graph (edges, how often a
weight stands at a node, edges with a score) is taken from the matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.operators.relational import join_checked, rank_all
from quillnet.session import cut

#: Cells of a matrix that are looked at together, and pairs that are made together.
STRIP = 1_000_000


def blocked(members: DataFrame, block: int = 3000) -> tuple[DataFrame, int]:
    """((i, at): each item with the sorted numbers of its groups, how many blocks). members: distinct (g, i)."""
    numbers = cut(rank_all(members.select("g").distinct(), ["g"], "_r").select("g", (F.col("_r") - 1).cast("int").alias("n")))
    items = cut(join_checked(members, numbers, "g", "inner").groupBy("i").agg(F.sort_array(F.collect_list("n")).alias("at")))
    least = round((8 * items.sparkSession.sparkContext.defaultParallelism) ** 0.5)  # four cells a core
    return items, max(1, -(-items.count() // block), least)


def _flat(lists):
    """Row numbers and values of a column of lists."""
    import numpy as np
    import pyarrow as pa

    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _counts(left, right):
    """How many groups row i of left and row j of right share, as a matrix. Groups that only one side has count nothing."""
    import numpy as np

    (r, g), (s, h), shape = _flat(left), _flat(right), (len(left), len(right))
    g, h = g.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)
    both = np.intersect1d(g, h)
    r, g = r[np.isin(g, both)], np.searchsorted(both, g[np.isin(g, both)])
    s, h = s[np.isin(h, both)], np.searchsorted(both, h[np.isin(h, both)])
    many = np.bincount(h, minlength=len(both))
    pairs = int(many[g].sum())
    if pairs * 100 > shape[0] * shape[1] * len(both):  # a product of matrices is quicker where a hundredth of its cells is full
        total = np.zeros(shape, np.float32)
        for k in range(0, len(both), 2048):
            a, b = np.zeros((shape[0], min(2048, len(both) - k)), np.float32), np.zeros((shape[1], min(2048, len(both) - k)), np.float32)
            for m, rows, cols in ((a, r, g), (b, s, h)):
                on = (cols >= k) & (cols < k + 2048)
                m[rows[on], cols[on] - k] = 1
            total += a @ b.T
        return total.astype(np.int32)
    total = np.zeros(shape[0] * shape[1], np.int32)
    s, first = s[np.argsort(h, kind="stable")], np.concatenate([[0], np.cumsum(many)])
    size = many[g]
    ends = np.cumsum(size)
    k = 0
    while k < len(g):
        z = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + STRIP, side="right")))
        n = size[k:z]
        at = np.arange(n.sum()) + np.repeat(first[g[k:z]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        np.add.at(total, np.repeat(r[k:z], n) * shape[1] + s[at], 1)
        k = z
    return total.reshape(shape)


class Cell:
    """Two blocks, the items of both in the order of their ids, and how many groups each pair shares."""

    def __init__(self, table):
        import numpy as np

        table = table.sort_by("i").combine_chunks()
        own, p, q = (table[c].to_numpy() for c in ("own", "p", "q"))
        self.table, self.ids, self.same = table, table["i"].combine_chunks(), bool(p[0] == q[0])
        self.rows = np.flatnonzero(own == p)
        self.columns = self.rows if self.same else np.flatnonzero(own != p)
        at = table["at"].combine_chunks()
        self.counts = _counts(at.take(_array(self.rows)), at.take(_array(self.columns)))
        self.top = int(self.counts.max(initial=0)) + 1

    def pairs(self) -> Iterator[tuple]:
        """(places of the ends that come first in ``ids``, of those that come last, weights), some at a time."""
        import numpy as np

        step = max(1, STRIP // max(1, len(self.columns)))
        for k in range(0, len(self.rows), step):
            i, j = np.nonzero(self.counts[k : k + step])
            x, y, w = self.rows[k + i], self.columns[j], self.counts[k + i, j]
            if self.same:
                once = x < y
                yield x[once], y[once], w[once]
            else:
                yield np.minimum(x, y), np.maximum(x, y), w

    def scores(self, name: str) -> Callable:
        """(places, weights) -> scores, which stand in the column ``name`` as arrays of struct<w, x> in the order of w."""
        import numpy as np

        row, flat = _flat(self.table[name])
        w, x = flat.field("w").to_numpy(zero_copy_only=False), flat.field("x").to_numpy(zero_copy_only=False)
        if self.top * len(self.ids) <= 8 * STRIP:
            wide = np.full((len(self.ids), self.top), np.nan)
            low = w < self.top
            wide[row[low], w[low]] = x[low]
            return lambda place, weight: wide[place, weight]
        base = int(max(self.top, w.max(initial=0) + 1))
        keys = row * base + w
        return lambda place, weight: x[np.searchsorted(keys, place * base + weight)]

    def tally(self, places, weights=None):
        """(place, weight, n) of what is given, or (place, n)."""
        import numpy as np

        if weights is None:
            n = np.bincount(places, minlength=len(self.ids))
            return np.flatnonzero(n), n[n > 0]
        keys = places * self.top + weights
        if self.top * len(self.ids) <= 8 * STRIP:
            n = np.bincount(keys)
            found = np.flatnonzero(n)
            n = n[found]
        else:
            found, n = np.unique(keys, return_counts=True)
        return found // self.top, found % self.top, n


def _array(x):
    import pyarrow as pa

    return pa.array(x)


def _meet(items: DataFrame, parts: int, schema: str, take: Callable) -> DataFrame:
    """What ``take`` makes of every two blocks: a cell to columns. items: (i, at, and what take needs of each item)."""
    import pyarrow as pa

    def each(batches):
        cell = Cell(pa.Table.from_batches(list(batches)))
        for columns in take(cell):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    each.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    names = [c.rsplit(" ", 1)[0].strip() for c in schema.split(", ")]
    own = F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int")
    dealt = items.withColumn("own", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.select(*items.columns, "own", F.least("own", "_o").alias("p"), F.greatest("own", "_o").alias("q"))
    return dealt.withColumn("cell", F.col("p") * parts + F.col("q")).repartition(parts * (parts + 1) // 2, "cell").groupBy("cell").applyInArrow(each, schema)


def edges(items: DataFrame, parts: int) -> DataFrame:
    """(src, dst, weight) of all pairs that share a group."""

    def take(cell):
        for x, y, w in cell.pairs():
            yield cell.ids.take(_array(x)), cell.ids.take(_array(y)), w.astype("int64")

    kind = dict(items.dtypes)["i"]
    return _meet(items, parts, f"src {kind}, dst {kind}, weight long", take)


def weights(items: DataFrame, parts: int) -> DataFrame:
    """(id, weight, n): how many edges of each weight a node has."""

    def take(cell):
        for x, y, w in cell.pairs():
            for end in (x, y):
                place, weight, n = cell.tally(end, w)
                yield cell.ids.take(_array(place)), weight, n

    return _meet(items, parts, f"id {dict(items.dtypes)['i']}, weight long, n long", take).groupBy("id", "weight").agg(F.sum("n").alias("n"))


def _scored(items: DataFrame, scores: DataFrame) -> DataFrame:
    """items with an array of struct<w, x>: the score x of the edges of weight w whose later end an item is. scores: (id, weight, x)."""
    of = scores.groupBy(F.col("id").alias("i")).agg(F.sort_array(F.collect_list(F.struct(F.col("weight").cast("long").alias("w"), F.col("x").cast("double").alias("x")))).alias("s"))
    return cut(items.join(of, "i"))


def scored(items: DataFrame, parts: int, scores: DataFrame, name: str) -> DataFrame:
    """(src, dst, name): edges with the score that their later end has for their weight."""

    def take(cell):
        of = cell.scores("s")
        for x, y, w in cell.pairs():
            yield cell.ids.take(_array(x)), cell.ids.take(_array(y)), of(y, w)

    kind = dict(items.dtypes)["i"]
    return _meet(_scored(items, scores), parts, f"src {kind}, dst {kind}, {name} double", take)


def backbone(items: DataFrame, parts: int, scores: DataFrame, low: float, high: float, min_degree: int) -> DataFrame:
    """(src, dst, weight) of the edges whose score is from low to high, less those at nodes that then have fewer than min_degree."""
    with_scores = _scored(items, scores)

    def kept(cell):
        of = cell.scores("s")
        for x, y, w in cell.pairs():
            score = of(y, w)
            ok = (score >= low) & (score <= high)
            yield x[ok], y[ok], w[ok]

    def degrees(cell):
        for x, y, _ in kept(cell):
            for end in (x, y):
                place, n = cell.tally(end)
                yield cell.ids.take(_array(place)), n

    def last(cell):
        stay = cell.table["stay"].to_numpy()
        for x, y, w in kept(cell):
            both = stay[x] & stay[y]
            yield cell.ids.take(_array(x[both])), cell.ids.take(_array(y[both])), w[both].astype("int64")

    kind = dict(items.dtypes)["i"]
    many = _meet(with_scores, parts, f"id {kind}, n long", degrees).groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_degree)
    stay = with_scores.join(many.select(F.col("id").alias("i"), F.lit(True).alias("stay")), "i", "left").withColumn("stay", F.coalesce("stay", F.lit(False)))
    return _meet(cut(stay), parts, f"src {kind}, dst {kind}, weight long", last)
