"""Embedding near-duplicates: an epsilon grid order join.

Cosine c between unit vectors is a distance of sqrt(2 - 2c), so a cosine threshold is a radius epsilon. Vectors are projected
on the leading principal dimensions of the table, their grid cells of side epsilon give the order, and the order is cut
into blocks of a bounded number of rows, which grow with the table up to BLOCK_ROWS and BLOCK_BYTES: a block is sent to each block
that it may meet, so larger blocks mean fewer copies. Two blocks are joined only if their cells in the first dimension are neighbours
(an equi-join on cells) and their boxes lie within epsilon in every projected dimension. Inside a pair of blocks, both
intervals are halved again and again; a pair of intervals whose boxes are further apart than epsilon is skipped, and small
ones are compared in double precision.

Copies of a vector are one row with a count. What leaves a pair of blocks is one row for each vector at most: how many
vectors it links there, and the smallest id of its component there. All pairs are never written out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import BlobReader, fresh, map_batches
from quillnet.operators.components import connected_components
from quillnet.session import cut

LEAF = 128
BLOCK_ROWS, BLOCK_BYTES = 4096, 4_000_000


def _unit(raw: bytes) -> np.ndarray:
    v = np.frombuffer(raw, "<f8")
    return v / math.sqrt(float(np.dot(v, v)))


def _valid(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, key, vec) of the rows that can link; vec: doubles, little-endian."""

    def read(batches):
        for batch in batches:
            b = BlobReader(batch)
            rows = []
            vectors = b.keep(["v"])[0]
            flat, ends = vectors.flatten(), np.cumsum(np.nan_to_num(pc.list_value_length(vectors).to_numpy(zero_copy_only=False))).astype(int)
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component is a NaN
            for i, label, start, end in zip(b.list("id"), b.list("label"), np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                a = values[start:end].astype("<f8")
                if not np.isfinite(a).all() or not a.any():
                    continue
                a = a / np.abs(a).max() if not np.isfinite(np.dot(a, a)) or np.dot(a, a) < 1e-200 else a
                raw = (a + 0.0).tobytes()
                rows.append((i, label, len(a), hashlib.blake2b(raw, digest_size=16).digest(), raw))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["id", "label", "dim", "key", "vec"]
            )

    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("v")
    )
    return map_batches(rows, read, "id long, label string, dim int, key binary, vec binary")


def _axes(reps: DataFrame, n_axes: int) -> dict[int, np.ndarray]:
    """Leading principal axes for each vector length, from sums over all rows (dim squared numbers each)."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            b = BlobReader(batch)
            by: dict[int, list] = {}
            for d, raw in zip(b.list("dim"), b.list("vec"), strict=True):
                by.setdefault(d, []).append(_unit(raw))
            for d, vs in by.items():
                x = np.column_stack([np.ones(len(vs)), np.array(vs)])
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m.size, d), pa.int32()), pa.array(np.arange(m.size)), pa.array(m.ravel())], ["dim", "i", "s"]
            )

    found: dict[int, np.ndarray] = {}
    for r in map_batches(reps.select("dim", "vec"), sums, "dim int, i long, s double").groupBy("dim", "i").agg(F.sum("s").alias("s")).collect():
        found.setdefault(r["dim"], np.zeros((r["dim"] + 1) ** 2))[r["i"]] = r["s"]
    axes = {}
    for d, flat in found.items():
        m = flat.reshape(d + 1, d + 1)
        mean = m[0, 1:] / m[0, 0]
        _, vectors = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        axes[d] = vectors[:, ::-1][:, : min(n_axes, d)].copy()
    return axes


def _apart(lo_a, hi_a, lo_b, hi_b) -> float:
    """Distance between two boxes."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(np.sqrt((gap * gap).sum()))


def _interval_join(a, pa_, b, pb, threshold: float, eps: float, links: np.ndarray, at: int = 0, bt: int = 0) -> None:
    """Marks in links the pairs of rows of a and b that reach the threshold."""
    if _apart(pa_.min(0), pa_.max(0), pb.min(0), pb.max(0)) > eps:
        return
    if len(a) <= LEAF and len(b) <= LEAF:
        links[at : at + len(a), bt : bt + len(b)] = a @ b.T >= threshold
        return
    for x, px, i in ((a, pa_, at),) if len(a) <= LEAF else ((a[: len(a) // 2], pa_[: len(a) // 2], at), (a[len(a) // 2 :], pa_[len(a) // 2 :], at + len(a) // 2)):
        for y, py, j in ((b, pb, bt),) if len(b) <= LEAF else ((b[: len(b) // 2], pb[: len(b) // 2], bt), (b[len(b) // 2 :], pb[len(b) // 2 :], bt + len(b) // 2)):
            _interval_join(x, px, y, py, threshold, eps, links, i, j)


def _roots(links: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id in each row's component of a block pair."""
    root_a, root_b = ids_a.copy(), ids_b.copy()
    seen = np.zeros(len(ids_a), bool)
    for start in range(len(ids_a)):
        if seen[start]:
            continue
        rows, cols = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        edge = np.zeros(len(ids_a), bool)
        edge[start] = True
        while edge.any():
            rows |= edge
            reached = links[edge].any(0) & ~cols
            if same:
                edge = reached & ~rows
                cols |= reached
            else:
                cols |= reached
                edge = links[:, reached].any(1) & ~rows
        seen |= rows
        least = min(ids_a[rows].min(), ids_b[cols].min()) if cols.any() else ids_a[rows].min()
        root_a[rows] = least
        root_b[cols] = least
    return (root_a, root_a) if same else (root_a, root_b)


def embedding_links(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    n_axes: int = 6,
    block_rows: int | None = None,
    rows_per_task: int = 50_000,
) -> DataFrame:
    """Adds n_links, component_id and kept to every row of vectors; only rows of one label are compared.

    n_links: other rows whose cosine is threshold or more. component_id: smallest id reachable by links. kept: whether
    that is the row's own id. A null or zero vector, one with a null or non-finite component, a null label: no links, its
    own component. A null id: no links, null component and kept. Vectors of different lengths never link. Rows with
    the same id are one node of a component, and other vectors to each other. An empty table gives no rows. Columns that bear
    a new name are replaced, others may have any name. block_rows: by default a 32nd of the different vectors, between 256 and
    BLOCK_ROWS, and at most BLOCK_BYTES of them.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    rows = cut(_valid(vectors, id_col, vec_col, label_col))
    same = ["label", "dim", "key"]
    classes = cut(
        rows.groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    )
    axes = vectors.sparkSession.sparkContext.broadcast(_axes(classes, n_axes))

    def project(batches):
        for batch in batches:
            b = BlobReader(batch)
            spots, cells = [], []
            for raw in b.list("vec"):
                v = _unit(raw)
                p = v @ axes.value[len(v)]
                spots.append(p.astype("<f8").tobytes())
                cells.append(np.floor(p / eps).astype(int).tolist())
            yield pa.RecordBatch.from_arrays(
                [*b.keep(["label", "dim", "rep", "copies", "vec"]), pa.array(spots, pa.binary()), pa.array(cells, pa.list_(pa.int32()))],
                ["label", "dim", "rep", "copies", "vec", "spot", "cell"],
            )

    n = classes.count()
    widest = max(axes.value, default=1)
    block_rows = block_rows or min(BLOCK_ROWS, max(256, n // 32), max(16, BLOCK_BYTES // (8 * widest)))

    def block_up(batches):
        from pyspark import TaskContext

        task, k, held = TaskContext.get().partitionId(), 0, []

        def block(part, k):
            p = np.array([np.frombuffer(r[5], "<f8") for r in part])
            data = (
                [(task << 32) + k], [part[0][0]], [part[0][1]],
                [np.array([r[2] for r in part], "<i8").tobytes()], [np.array([r[3] for r in part], "<i8").tobytes()],
                [b"".join(r[4] for r in part)], [p.tobytes()], [p.min(0).tolist()], [p.max(0).tolist()],
            )
            f8 = pa.list_(pa.float64())
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), f8, f8)
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(data, kinds, strict=True)],
                ["block", "label", "dim", "ids", "copies", "vecs", "spots", "lo", "hi"],
            )

        for batch in batches:
            b = BlobReader(batch)
            for row in zip(*(b.list(c) for c in ("label", "dim", "rep", "copies", "vec", "spot")), strict=True):
                if held and (len(held) >= block_rows or held[0][:2] != row[:2]):
                    yield block(held, k)
                    k, held = k + 1, []
                held.append(row)
        if held:
            yield block(held, k)

    order = ["label", "dim", "cell", "rep"]
    grid = map_batches(
        classes, project, "label string, dim int, rep long, copies long, vec binary, spot binary, cell array<int>"
    )
    blocks = cut(
        map_batches(
            grid.repartitionByRange(max(1, -(-n // rows_per_task)), *order).sortWithinPartitions(*order),
            block_up,
            "block long, label string, dim int, ids binary, copies binary, vecs binary, spots binary, lo array<double>, hi array<double>",
        )
    )
    meta = blocks.select("block", "label", "dim", "lo", "hi").withColumn("c0", F.floor(F.col("lo")[0] / eps)).withColumn("c1", F.floor(F.col("hi")[0] / eps))
    left = meta.withColumn("cell", F.explode(F.sequence("c0", "c1"))).alias("a")
    right = meta.withColumn("cell", F.explode(F.sequence(F.col("c0") - 1, F.col("c1") + 1))).alias("b")
    near = F.expr(f"""forall(sequence(0, size(a.lo) - 1), i -> a.lo[i] - b.hi[i] <= {eps!r} and b.lo[i] - a.hi[i] <= {eps!r})""")
    on = (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.cell") == F.col("b.cell"))
    pairs = (
        left.join(right, on & (F.col("a.block") <= F.col("b.block")) & near)
        .select(F.col("a.block").alias("a"), F.col("b.block").alias("b"))
        .distinct()
    )
    payload = ["ids", "copies", "vecs", "spots"]
    side = lambda s: blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in payload], *(["dim"] if s == "a" else []))

    def compare(batches):
        for batch in batches:
            b = BlobReader(batch)
            cols = [b.list(c) for c in ("a", "b", "dim", *[f"{c}_{s}" for s in "ab" for c in payload])]
            for ka, kb, d, ia, ca, va, sa, ib, cb, vb, sb in zip(*cols, strict=True):
                ia, ca, ib, cb = (np.frombuffer(x, "<i8") for x in (ia, ca, ib, cb))
                va, vb = (np.frombuffer(x, "<f8").reshape(-1, d) for x in (va, vb))
                va, vb = (v / np.sqrt((v * v).sum(1, keepdims=True)) for v in (va, vb))
                sa, sb = np.frombuffer(sa, "<f8").reshape(len(ia), -1), np.frombuffer(sb, "<f8").reshape(len(ib), -1)
                links = np.zeros((len(ia), len(ib)), bool)
                _interval_join(va, sa, vb, sb, threshold, eps, links)
                if ka == kb:
                    links |= links.T
                    np.fill_diagonal(links, False)
                n_a, n_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
                for at in range(0, len(ia), 512):
                    m = links[at : at + 512].astype(np.float64)
                    n_a[at : at + 512] = m @ cb
                    n_b += (ca[at : at + 512] @ m).astype(np.int64)
                root_a, root_b = _roots(links, ia, ib, ka == kb)
                ids, ns, roots = (ia, n_a, root_a) if ka == kb else map(np.concatenate, ((ia, ib), (n_a, n_b), (root_a, root_b)))
                on = ns > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ns[on]), pa.array(roots[on])], ["rep", "n", "root"])

    found = cut(
        map_batches(pairs.join(side("a"), "a").join(side("b"), "b"), compare, "rep long, n long, root long")
    )
    # A class is known by its smallest id and its content; ids that repeat with other contents share a node.
    per_rep = found.groupBy("rep").agg(F.sum("n").alias("_n"))
    edges = found.select(F.col("rep").alias("src"), F.col("root").alias("dst")).unionByName(
        rows.join(classes.where("copies > 1").select(*same, "rep"), same).select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    )
    component = connected_components(edges)
    member = (
        rows.select("id", *same)
        .join(classes.select(*same, "rep", "copies"), same)
        .join(per_rep, "rep", "left")
        .groupBy("id")
        .agg(F.max(F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    )
    keep = [c for c in vectors.columns if c.lower() not in ("n_links", "component_id", "kept")]
    one, two, linked, least = (fresh(vectors, c) for c in ("_id", "_cid", "_links", "_component"))
    member = member.select(F.col("id").alias(one), F.col("_links").alias(linked))
    component = component.select(F.col("id").alias(two), F.col("component").alias(least))
    out = vectors.select(*keep).join(member, F.col(id_col) == F.col(one), "left")
    out = out.join(component, F.col(id_col) == F.col(two), "left")
    comp = F.coalesce(least, F.col(id_col).cast("long"))
    return out.select(
        *keep,
        F.coalesce(linked, F.lit(0)).cast("long").alias("n_links"),
        comp.alias("component_id"),
        (comp == F.col(id_col)).alias("kept"),
    )
