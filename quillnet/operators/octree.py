"""Long-range forces over all points: an octree of cells, far cells as one body each, near ones by pairs.

Levels are rows: a cell is (level, cx, cy, cz), level k cuts the points' box into 8^k cells, and only cells with points exist. A point meets,
at each level, the cells that are children of its parent's neighbours but no neighbours of its own: at most 189, each as
one body of its count, centre and second moments. What is left, its own leaf and the 26 around it, it meets point by point.

The tree is as deep as it must be for every leaf to hold at most ``leaf`` different points, so a dense cluster deepens the tree
and not the pairs. With second moments a cell is wrong by the third power of its radius over its distance only: against the sum over all pairs
the error of a force is within ``ERROR`` of the sum of the magnitudes of its parts (tested on even, clustered and flat points).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillnet.session import cut

XYZ = ("x", "y", "z")
CELL = ["level", "cx", "cy", "cz"]
SOFT = 1e-3
ERROR = 0.02
DEEPEST = 20


def _unit(points: DataFrame) -> DataFrame:
    """points (id, x, y, z) with their places ux, uy, uz in the box, from 0 to 1."""
    box = points.agg(*[F.min(c).alias(f"_{c}") for c in XYZ], F.greatest(*[F.max(c) - F.min(c) for c in XYZ], F.lit(1e-12)).alias("_side"))
    return points.join(F.broadcast(box)).select("id", *XYZ, *[((F.col(c) - F.col(f"_{c}")) / F.col("_side")).alias(f"u{c}") for c in XYZ])


def _cell(axis: str, level: Column) -> Column:
    parts = F.pow(F.lit(2.0), level)
    return F.least(F.floor(F.col(f"u{axis}") * parts), (parts - 1).cast("long")).cast("long").alias(f"c{axis}")


def _at(unit: DataFrame, first: int, last: int) -> DataFrame:
    level = F.col("level")
    return unit.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("level")).select("id", *XYZ, "level", *[_cell(c, level) for c in XYZ])


def depth(unit: DataFrame, leaf: int) -> int:
    """The first level whose cells all hold at most ``leaf`` different points; DEEPEST if none does."""
    bodies = unit.select(*XYZ, *[f"u{c}" for c in XYZ]).distinct().withColumn("id", F.lit(0))
    fullest = _at(bodies, 0, DEEPEST).groupBy(*CELL).count().groupBy("level").agg(F.max("count").alias("n")).where(F.col("n") <= leaf)
    return fullest.agg(F.coalesce(F.min("level"), F.lit(DEEPEST))).first()[0]


def _around(cells: DataFrame, shift: int) -> DataFrame:
    """cells with the keys (kx, ky, kz) of the cells around them, and their own, ``shift`` levels up."""
    steps = F.array(*[F.struct(*[(F.shiftright(f"c{c}", shift) + o).alias(f"k{c}") for c, o in zip(XYZ, (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    return cells.select("*", F.explode(steps).alias("_k")).select(*cells.columns, "_k.*")


def bodies(at: DataFrame) -> DataFrame:
    """Cells as bodies: n, mean and second moments (population) of their points."""
    moments = [F.var_pop(c).alias(f"m{c}{c}") for c in XYZ] + [F.covar_pop(a, b).alias(f"m{a}{b}") for a, b in (("x", "y"), ("x", "z"), ("y", "z"))]
    return at.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"b{c}") for c in XYZ], *moments)


def interactions(cells: DataFrame) -> DataFrame:
    """Each cell's key with the bodies that it meets as a whole: children of its parent's neighbours that are not its own."""
    own = _around(cells.select(*CELL), 1)
    keys = [F.shiftright(f"c{c}", 1).alias(f"k{c}") for c in XYZ]
    other = cells.select("level", *keys, *[F.col(f"c{c}").alias(f"o{c}") for c in XYZ], "n", *[c for c in cells.columns if c[0] in "bm"])
    apart = F.greatest(*[F.abs(F.col(f"c{c}") - F.col(f"o{c}")) for c in XYZ]) > 1
    return own.join(other, ["level", "kx", "ky", "kz"]).where(apart).drop("kx", "ky", "kz", "ox", "oy", "oz")


def far_force(strength: float) -> list[Column]:
    """The force on (x, y, z) of a body, to second order."""
    d = {c: F.col(c) - F.col(f"b{c}") for c in XYZ}
    m = lambda a, b: F.col("m" + "".join(sorted((a, b))))
    q = sum(d[c] * d[c] for c in XYZ) + SOFT
    g, g1, g2 = F.pow(q, -1.5), -1.5 * F.pow(q, -2.5), 3.75 * F.pow(q, -3.5)
    turned = {a: sum(m(a, b) * d[b] for b in XYZ) for a in XYZ}
    trace, s = sum(m(c, c) for c in XYZ), sum(turned[c] * d[c] for c in XYZ)
    return [(strength * F.col("n") * (d[c] * g + 2 * turned[c] * g1 + d[c] * trace * g1 + 2 * d[c] * s * g2)).alias(f"f{c}") for c in XYZ]


def long_range_all(points: DataFrame, amplitude: float, c: float, leaf: int = 16) -> DataFrame:
    """(id, fx, fy, fz): for each point the sum over all others of c * amplitude * delta / (d^2 + 0.001)^1.5, as the octree gives it.

    Points at one place do not move each other. Points with a null coordinate have no force and exert none.
    """
    unit = cut(_unit(points.select("id", *XYZ).where(" AND ".join(f"{a} IS NOT NULL" for a in XYZ))))
    last, strength = depth(unit, leaf), c * amplitude
    leaves = cut(_at(unit, last, last))
    heavy = leaves.groupBy(*CELL, *XYZ).agg(F.count(F.lit(1)).alias("n")).select("level", *[F.col(f"c{a}").alias(f"k{a}") for a in XYZ], "n", *[F.col(a).alias(f"b{a}") for a in XYZ])
    delta = {a: F.col(a) - F.col(f"b{a}") for a in XYZ}
    pull = strength * F.col("n") / F.pow(sum(d * d for d in delta.values()) + SOFT, 1.5)
    near = _around(leaves, 0).join(heavy, ["level", "kx", "ky", "kz"]).select("id", *[(pull * delta[a]).alias(f"f{a}") for a in XYZ])
    total = [F.sum(f"f{a}").alias(f"f{a}") for a in XYZ]
    parts = near.groupBy("id").agg(*total)
    if last >= 2:
        at = cut(_at(unit, 2, last))
        met = interactions(cut(bodies(at)))
        far = at.select("id", *XYZ, *CELL).join(met, CELL).select("id", *far_force(strength))
        parts = parts.unionByName(far.groupBy("id").agg(*total)).groupBy("id").agg(*total)
    return parts
