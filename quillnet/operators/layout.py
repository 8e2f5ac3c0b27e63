"""Layouts: points (id, x, y, z), forces between them, spatial bins, step control, convergence and geometry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillnet.operators.relational import beside, join_checked, running_sum
from quillnet.session import cut

XYZ = ("x", "y", "z")


def _delta(a: str, b: str) -> list[Column]:
    return [(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")).alias(f"d{c}") for c in XYZ]


def cells(points: DataFrame, size: float, shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """points with the exact cell (cx, cy, cz) of a shifted cubic grid."""
    return points.select("*", *[F.floor(F.col(c) / size + s).alias(f"c{c}") for c, s in zip(XYZ, shift, strict=True)])


CELL = ["cx", "cy", "cz"]


def dealt(a: DataFrame, b: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """a and b with a column _part. Where a cell holds more than ``hot`` rows of a, these are dealt over parts, and to each of them go
    the cell's rows of b; so the pairs of a dense cell are made by many tasks."""
    large = cut(a.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("_parts")).where("_parts > 1"))
    if not large.limit(1).count():
        return a.withColumn("_part", F.lit(0)), b.withColumn("_part", F.lit(0))
    parts = F.coalesce("_parts", F.lit(1))
    left = join_checked(a, large, CELL, "left").withColumn("_part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("_parts")
    right = join_checked(b, large, CELL, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left, right


def pairs_within(points: DataFrame, size: float, hot: int = 2000) -> DataFrame:
    """Ordered pairs (i, j, dx, dy, dz, d) at most ``size`` apart, met through neighbouring cells."""
    a = cells(points, size)
    around = F.explode(F.array(*[F.struct(*[(F.col(f"c{c}") + o).alias(f"c{c}") for c, o in zip(XYZ, (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    b = a.select("id", *XYZ, around.alias("cell")).select("id", *XYZ, "cell.*")
    a, b = dealt(a.select("id", *XYZ, *CELL), b, hot)
    j = a.alias("a").join(b.alias("b"), [*CELL, "_part"]).where("a.id <> b.id")
    d = j.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), *_delta("a", "b"))
    return d.withColumn("d", F.sqrt(sum(F.col(f"d{c}") * F.col(f"d{c}") for c in XYZ))).where(F.col("d") <= size)


def bin_pairs(points: DataFrame, size: float, link: str = "link", hot: int = 2000) -> DataFrame:
    """Pairs i < j of one cell that belong to different links."""
    p = cells(points, size).select("id", F.col(link).alias("l"), *CELL)
    a, b = dealt(p, p, hot)
    j = a.alias("a").join(b.alias("b"), [*CELL, "_part"]).where((F.col("a.l") != F.col("b.l")) & (F.col("a.id") < F.col("b.id")))
    return j.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"))


def multi_link_bins(points: DataFrame, size: float, link: str = "link") -> DataFrame:
    return cells(points, size).groupBy("cx", "cy", "cz").agg(F.count_distinct(link).alias("links"), F.count(F.lit(1)).alias("points")).where("links > 1")


def forces(pairs: DataFrame, factor: Column) -> DataFrame:
    """(id, fx, fy, fz): the sum over pairs of factor times the displacement."""
    return pairs.groupBy(F.col("i").alias("id")).agg(*[F.sum(factor * F.col(f"d{c}")).alias(f"f{c}") for c in XYZ])


def repulsion(pairs: DataFrame, amplitude: float, power: float, radius: float) -> DataFrame:
    u = F.col("d") / radius
    return forces(pairs, amplitude * F.pow(u, power - 2) * F.exp(-F.pow(u, power)) / radius)


def long_range(pairs: DataFrame, amplitude: float, c: float, dims: int = 3) -> DataFrame:
    return forces(pairs, c * amplitude / F.pow(F.pow(F.col("d"), dims - 1) + 1e-3, dims / (dims - 1)))


def springs(points: DataFrame, edges: DataFrame, k: float) -> DataFrame:
    both = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), "weight").unionByName(edges.select(F.col("dst").alias("i"), F.col("src").alias("j"), "weight"))
    j = both.join(points.select(F.col("id").alias("i"), F.struct(*XYZ).alias("a")), "i").join(points.select(F.col("id").alias("j"), F.struct(*XYZ).alias("b")), "j")
    return forces(j.select("i", "weight", *_delta("a", "b")), -k * F.col("weight"))


def link_springs(points: DataFrame, k: float) -> DataFrame:
    """Forces on polyline points (link, seg, x, y, z) from the points beside them."""
    there = lambda side, c: F.coalesce(F.col(f"{side}.{c}") - F.col(c), F.lit(0.0))
    pull = [(k * (there("_before", c) + there("_after", c))).alias(f"f{c}") for c in XYZ]
    return beside(points.select("link", "seg", *XYZ), "link", "seg", list(XYZ)).select("link", "seg", *pull)


def end_forces(link_forces: DataFrame, ends: DataFrame) -> DataFrame:
    """Forces of link ends (link, seg -> id) gathered at their nodes."""
    return link_forces.join(ends, ["link", "seg"]).groupBy("id").agg(*[F.sum(f"f{c}").alias(f"f{c}") for c in XYZ])


def damped(f: Column, dt: Column | float, r: float) -> Column:
    return r * F.asinh(dt * f / r)


def step(points: DataFrame, force: DataFrame, dt: float, r: float) -> DataFrame:
    j = points.join(force, "id", "left")
    return j.select("id", *[(F.col(c) + damped(F.coalesce(f"f{c}", F.lit(0.0)), dt, r)).alias(c) for c in XYZ])


def adaptive_dt(force: DataFrame, dt: float, ct: float) -> DataFrame:
    """One row: dt halved above ct / fmax, doubled below twice that."""
    top = F.max(F.sqrt(sum(F.col(f"f{c}") * F.col(f"f{c}") for c in XYZ)))
    lim = F.col("fmax")
    return force.agg(top.alias("fmax")).select("fmax", F.when(dt > ct / lim, dt / 2).when(dt < 2 * ct / lim, dt * 2).otherwise(dt).alias("dt"))


def noise(points: DataFrame, it: int, t0: float, ce: float, seed: int) -> DataFrame:
    s = t0 * float(np.exp(-it / ce))
    return points.select("id", *[(F.col(c) + F.randn(seed + k) * s).alias(c) for k, c in enumerate(XYZ)])


def link_length(points: DataFrame, edges: DataFrame) -> DataFrame:
    j = edges.join(points.select(F.col("id").alias("src"), F.struct(*XYZ).alias("a")), "src").join(points.select(F.col("id").alias("dst"), F.struct(*XYZ).alias("b")), "dst")
    d = j.select("weight", *_delta("a", "b"))
    return d.agg(F.sum(F.sqrt(sum(F.col(f"d{c}") * F.col(f"d{c}") for c in XYZ)) * F.col("weight")).alias("length"))


def chain(points: DataFrame, link: str = "link") -> DataFrame:
    """(src, dst, weight): edges from each point to the next id of its link."""
    found = beside(points.select("id", link), link, "id", ["id"])
    return found.select(F.col("id").alias("src"), F.col("_after.id").alias("dst"), F.lit(1).alias("weight")).where("dst is not null")


def simulate(points: DataFrame, edges: DataFrame, rounds: int = 5, k: float = 0.01, amplitude: float = 1.0, radius: float = 1.0, reach: float = 3.0, dt: float = 0.1, ct: float = 0.1) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Points after some rounds of short repulsion and springs, and the trace (round, total length)."""
    trace = []
    points = cut(points.select("id", *XYZ))
    for it in range(rounds):
        f = repulsion(pairs_within(points, reach * radius), amplitude, 2.0, radius).unionByName(springs(points, edges, k))
        f = cut(f.groupBy("id").agg(*[F.sum(f"f{c}").alias(f"f{c}") for c in XYZ]))
        dt = adaptive_dt(f, dt, ct).first()["dt"] or dt
        points = cut(step(points, f, dt, radius))
        trace.append((it, float(link_length(points, edges).first()[0] or 0.0)))
    return points, trace


def polyline(links: DataFrame, segs: int) -> DataFrame:
    """(link, seg, x, y, z): evenly spaced points from (x1, y1, z1) to (x2, y2, z2)."""
    p = links.select("*", F.explode(F.sequence(F.lit(0), F.lit(segs - 1))).alias("seg"))
    t = F.col("seg") / (segs - 1)
    return p.select("link", "seg", *[(F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * t).alias(c) for c in XYZ])


def resample(path: DataFrame, n: int, by: str = "index", link: str = "link", seg: str = "seg") -> DataFrame:
    """(link, seg, x, y, z): each path as n points, evenly spaced by its numbering or, by="length", along its length.

    Each piece between two neighbouring points yields the new points that fall on it, so no path is gathered. Points are taken in
    order of ``seg``. A path of one point is that point n times.
    """
    rows = path.select(F.col(link).alias("link"), F.col(seg).alias("_seg"), *XYZ)
    nxt = {c: F.col(f"_after.{c}") for c in XYZ}
    last = F.col("_after").isNull()
    gap = F.sqrt(sum((nxt[c] - F.col(c)) * (nxt[c] - F.col(c)) for c in XYZ)) if by == "length" else F.when(~last, 1.0)
    pieces = beside(rows, "link", "_seg", ["_seg", *XYZ]).select("link", "_seg", *XYZ, *[nxt[c].alias(f"_{c}") for c in XYZ], F.coalesce(gap, F.lit(0.0)).alias("_gap"), last.alias("_last"))
    at = running_sum(pieces, "link", "_seg", "_gap", "_to").withColumn("_from", F.col("_to") - F.col("_gap"))
    whole = at.groupBy("link").agg(F.max("_to").alias("_all"))
    step = F.col("_all") / (n - 1)
    # A new point on the border of two pieces belongs to the second; the path's end to its last point.
    first = F.when(F.col("_all") == 0, 0).otherwise(F.ceil(F.col("_from") / step - 1e-9))
    after = F.when(F.col("_last"), n).when(F.col("_all") == 0, 0).otherwise(F.least(F.ceil(F.col("_to") / step - 1e-9), F.lit(n - 1)))
    points = at.join(whole, "link").withColumn("_a", first.cast("int")).withColumn("_b", after.cast("int")).withColumn("_a", F.when(F.col("_last"), F.least("_a", F.lit(n - 1))).otherwise(F.col("_a")))
    made = points.where("_b > _a").withColumn("seg", F.explode(F.sequence("_a", F.col("_b") - 1)))
    t = F.greatest(F.least(F.try_divide(F.col("seg") * step - F.col("_from"), F.col("_gap")), F.lit(1.0)), F.lit(0.0))
    return made.select("link", "seg", *[F.when(F.col("_last") | (F.col("_gap") == 0), F.col(c)).otherwise(F.col(c) + (F.col(f"_{c}") - F.col(c)) * t).alias(c) for c in XYZ])


def link_repulsion(points: DataFrame, size: float, amplitude: float, power: float = 2.0, link: str = "link", thickness: str = "thickness", hot: int = 2000) -> DataFrame:
    """(id, fx, fy, fz) of points (id, link, thickness, x, y, z): short repulsion between points of one cell that belong to different links."""
    p = cells(points, size).select("id", F.col(link).alias("l"), F.col(thickness).alias("t"), *XYZ, *CELL)
    a, b = dealt(p, p, hot)
    j = a.alias("a").join(b.alias("b"), [*CELL, "_part"]).where("a.l <> b.l")
    d = j.select(F.col("a.id").alias("i"), (F.col("a.t") + F.col("b.t")).alias("t"), *_delta("a", "b"))
    u = (F.lit(1e-9) + F.sqrt(sum(F.col(f"d{c}") * F.col(f"d{c}") for c in XYZ))) / F.col("t")
    return forces(d, amplitude * F.pow(u, power - 2) / F.col("t") * F.exp(-F.pow(u, power)))


def fuel_nodes(nodes: DataFrame, radius: str = "radius") -> DataFrame:
    """(ord, x, y, z, radius) with coordinates cut to whole numbers; of nodes that fall on one place all have the first one's radius."""
    whole = nodes.select("ord", *[F.col(c).cast("long").alias(c) for c in XYZ], F.col(radius).alias("r"))
    first = whole.groupBy(*XYZ).agg(F.min_by("r", "ord").alias("radius"))
    return whole.join(first, list(XYZ)).select("ord", *XYZ, "radius")


def spheres(points: DataFrame, radius: Column) -> DataFrame:
    """(id, x, y, z, r): the sphere of each node."""
    return points.select("id", *XYZ, radius.alias("r"))


def to_segments(segments: DataFrame, attributes: DataFrame, link: str = "link") -> DataFrame:
    """Segments with the attributes of their link on each of them."""
    return segments.join(attributes, link)


def cylinders(links: DataFrame) -> DataFrame:
    """Midpoint, length and direction of the cylinder along each link."""
    d = [F.col(f"{c}2") - F.col(f"{c}1") for c in XYZ]
    dist = F.sqrt(sum(x * x for x in d))
    return links.select("link", *[((F.col(f"{c}1") + F.col(f"{c}2")) / 2).alias(c) for c in XYZ], dist.alias("length"), F.atan2(d[1], d[0]).alias("phi"), F.acos(d[2] / dist).alias("theta"))


def lattice(spark, n: int, dims: int = 3) -> tuple[DataFrame, DataFrame]:
    """Grid of n^dims points and its unit edges."""
    p = spark.range(n**dims).select("id", *[(F.floor(F.col("id") / n**k) % n).alias(c) for k, c in zip(range(dims), XYZ, strict=False)])
    edges = [p.where(F.col(c) < n - 1).select(F.col("id").alias("src"), (F.col("id") + n**k).alias("dst")) for k, c in zip(range(dims), XYZ, strict=False)]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return p, out.withColumn("weight", F.lit(1))


def trace_gradient(trace: DataFrame, it: str = "it", value: str = "v", part: str | None = None) -> DataFrame:
    """First and second difference of log value over log iteration: central, one-sided at the ends."""
    w = (W.partitionBy(part) if part else W.partitionBy(F.lit(0))).orderBy(it)
    y = F.log(value)
    rows = trace.withColumn("_y", y)
    d = lambda c: F.when(F.lag(c).over(w).isNull(), F.lead(c).over(w) - F.col(c)).when(F.lead(c).over(w).isNull(), F.col(c) - F.lag(c).over(w)).otherwise((F.lead(c).over(w) - F.lag(c).over(w)) / 2)
    return rows.withColumn("d1", d("_y")).withColumn("d2", d("d1")).drop("_y")


def converged(gradient: DataFrame, tol: float, part: str | None = None) -> DataFrame:
    """Whether the mean first difference, and those of both halves, stay within the tolerance."""
    keys = [part] if part else []
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    rows = gradient.withColumn("_h", F.ntile(2).over(w.orderBy("it")))
    mean = lambda h: F.avg(F.when(F.col("_h") == h, F.col("d1")))
    out = rows.groupBy(*keys).agg(F.avg("d1").alias("grad"), F.avg("d2").alias("curve"), mean(1).alias("first"), mean(2).alias("second"))
    return out.withColumn("converged", (F.abs("grad") < tol) & (F.abs("first") < 2 * tol) & (F.abs("second") < 2 * tol))


def spring_layout(edges: DataFrame, group: str, dims: int = 2, rounds: int = 50, seed: int = 42, max_nodes: int = 5000) -> DataFrame:
    """(group, id, pos): Fruchterman-Reingold for each (bounded) group of edges (group, src, dst, weight)."""

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["src"]) | set(pdf["dst"]))
        if len(ids) > max_nodes:
            raise ValueError(f"a group of {len(ids)} nodes; lay out its backbone, or use simulate()")
        at = {v: k for k, v in enumerate(ids)}
        a = np.zeros((len(ids), len(ids)))
        i, j = pdf["src"].map(at), pdf["dst"].map(at)
        a[i, j] = a[j, i] = pdf["weight"]
        pos = np.random.RandomState(seed).rand(len(ids), dims)
        k, t = np.sqrt(1 / len(ids)), 0.1
        for r in range(rounds):
            delta = pos[:, None] - pos[None]
            dist = np.maximum(np.sqrt((delta**2).sum(-1)), 0.01)
            move = (delta * (k * k / dist**2 - a * dist / k)[..., None]).sum(1)
            size = np.maximum(np.sqrt((move**2).sum(-1, keepdims=True)), 0.01)
            pos += move * t * (1 - r / rounds) / size
        return pd.DataFrame({group: pdf[group].iloc[0], "id": ids, "pos": list(pos)})

    kinds = dict(edges.dtypes)
    return edges.groupBy(group).applyInPandas(lay, f"{group} {kinds[group]}, id {kinds['src']}, pos array<double>")


def ellipsoid_forces(segments: DataFrame, size: float, amplitude: float = 1.0, flat: float = 0.25, max_bin: int = 5000) -> DataFrame:
    """(id, fx, fy, fz) between segments (id, link, x, y, z, tx, ty, tz) of one cell: distances are short across and long along a segment."""

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_bin:
            raise ValueError(f"{len(pdf)} segments in one cell; take smaller cells")
        p, t = pdf[list(XYZ)].to_numpy(), pdf[["tx", "ty", "tz"]].to_numpy()
        t = t / np.maximum(np.sqrt((t * t).sum(1, keepdims=True)), 1e-12)
        metric = np.eye(3)[None] - (1 - flat) * t[:, :, None] * t[:, None, :]
        d = p[:, None] - p[None]
        g = metric[:, None] + metric[None]
        r2 = np.einsum("ijk,ijkl,ijl->ij", d, g, d)
        other = pdf["link"].to_numpy()[:, None] != pdf["link"].to_numpy()[None]
        f = (amplitude * np.exp(-r2) * other)[..., None] * np.einsum("ijkl,ijl->ijk", g, d)
        f = f.sum(1)
        return pd.DataFrame({"id": pdf["id"], "fx": f[:, 0], "fy": f[:, 1], "fz": f[:, 2]})

    kind = dict(segments.dtypes)["id"]
    return cells(segments, size).groupBy("cx", "cy", "cz").applyInPandas(lay, f"id {kind}, fx double, fy double, fz double")
