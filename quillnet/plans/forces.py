"""Registered queries of long-range forces over all points, paths and links; the SQL builds the same octree."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillnet.operators import layout as L
from quillnet.operators import octree as O
from quillnet.plans.catalogue import _P, _chain, _f, _points, query

_LEAF = 16
_AXES = "xyz"
_BOX = ", ".join(f"min({c}) AS {c}0" for c in _AXES) + ", greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z), 1e-12::DOUBLE) AS side"
_CELLS = ", ".join(f"least(floor(({c} - {c}0) / side * pow(2.0::DOUBLE, level)), pow(2.0::DOUBLE, level) - 1)::BIGINT AS c{c}" for c in _AXES)
_MOMENTS = ", ".join([f"avg({c}) AS u{c}" for c in _AXES] + [f"var_pop({c}) AS m{c}{c}" for c in _AXES] + [f"covar_pop({a}, {b}) AS m{a}{b}" for a, b in ("xy", "xz", "yz")])
_M = lambda a, b: "m" + "".join(sorted(a + b))
_TURNED = ", ".join(f"({' + '.join(f'{_M(a, b)} * d{b}' for b in _AXES)}) AS t{a}" for a in _AXES)
_FAR = ", ".join(f"sum(3 * n * (d{c} * pow(q, -1.5) - 3 * t{c} * pow(q, -2.5) - 1.5 * d{c} * trace * pow(q, -2.5) + 7.5 * d{c} * s * pow(q, -3.5))) AS f{c}" for c in _AXES)

#: f (id, fx, fy, fz): amplitude 300, c 0.01.
_LONG = _P + f""", box AS (SELECT {_BOX} FROM p),
k AS MATERIALIZED (SELECT id, x, y, z, level, {_CELLS} FROM p, box, range(0, {O.DEEPEST + 1}) r(level)),
dep AS (SELECT coalesce(min(level) FILTER (n <= {_LEAF}), {O.DEEPEST}) AS deep FROM (SELECT level, max(n) AS n FROM (SELECT level, cx, cy, cz, count(DISTINCT (x, y, z)) AS n FROM k GROUP BY ALL) GROUP BY level)),
o AS (SELECT i, j, l FROM range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(l)),
c AS MATERIALIZED (SELECT level, cx, cy, cz, count(*) AS n, {_MOMENTS} FROM k, dep WHERE level BETWEEN 2 AND deep GROUP BY ALL),
met AS (SELECT a.level, a.cx, a.cy, a.cz, s.* EXCLUDE (level, cx, cy, cz) FROM c a, o JOIN c s ON s.level = a.level AND s.cx >> 1 = (a.cx >> 1) + i AND s.cy >> 1 = (a.cy >> 1) + j AND s.cz >> 1 = (a.cz >> 1) + l
        WHERE greatest(abs(a.cx - s.cx), abs(a.cy - s.cy), abs(a.cz - s.cz)) > 1),
g AS (SELECT id, n, x - ux AS dx, y - uy AS dy, z - uz AS dz, mxx, myy, mzz, mxy, mxz, myz FROM k JOIN met USING (level, cx, cy, cz)),
h AS (SELECT *, dx * dx + dy * dy + dz * dz + 0.001::DOUBLE AS q, mxx + myy + mzz AS trace, {_TURNED} FROM g),
far AS (SELECT id, {_FAR} FROM (SELECT *, tx * dx + ty * dy + tz * dz AS s FROM h) GROUP BY id),
leaf AS MATERIALIZED (SELECT k.* FROM k, dep WHERE level = deep),
v AS (SELECT a.id, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz FROM leaf a, o JOIN leaf b ON b.cx = a.cx + i AND b.cy = a.cy + j AND b.cz = a.cz + l),
near AS (SELECT id, {", ".join(f"sum(3 / pow(dx * dx + dy * dy + dz * dz + 0.001::DOUBLE, 1.5::DOUBLE) * d{c}) AS f{c}" for c in _AXES)} FROM v GROUP BY id),
f AS (SELECT id, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM (SELECT * FROM far UNION ALL SELECT * FROM near) GROUP BY id)"""


def _force(points):
    return O.long_range_all(points, 300.0, 0.01, leaf=_LEAF)


@query(_LONG + " SELECT id, round(fx, 5) AS fx, round(fy, 5) AS fy, round(fz, 5) AS fz FROM f")
def repulsion_long(spark, d):
    return _f(_force(_points(spark, d)), 5)


@query(_LONG + " SELECT p.id, round(x + asinh(0.01::DOUBLE * coalesce(fx, 0)), 6) AS x, round(y + asinh(0.01::DOUBLE * coalesce(fy, 0)), 6) AS y, round(z + asinh(0.01::DOUBLE * coalesce(fz, 0)), 6) AS z FROM p LEFT JOIN f USING (id)")
def damped_step(spark, d):
    p = _points(spark, d)
    return _f(L.step(p, _force(p), 0.01, 1.0))


@query(_LONG + ", m AS (SELECT max(sqrt(fx * fx + fy * fy + fz * fz)) AS fmax FROM f) SELECT round(fmax, 5) AS fmax, CASE WHEN 0.1::DOUBLE > 0.1::DOUBLE / fmax THEN 0.05::DOUBLE WHEN 0.1::DOUBLE < 0.2::DOUBLE / fmax THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS dt FROM m")
def adaptive_dt(spark, d):
    return _f(L.adaptive_dt(_force(_points(spark, d)), 0.1, 0.1), 5)


@query(_P + """, c AS (SELECT id, link, x, y, z, 0.01::DOUBLE * (1 + id % 3) AS t, floor(x / 0.1::DOUBLE) AS cx, floor(y / 0.1::DOUBLE) AS cy, floor(z / 0.1::DOUBLE) AS cz FROM p),
j AS (SELECT a.id, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, a.t + b.t AS t FROM c a JOIN c b USING (cx, cy, cz) WHERE a.link <> b.link),
u AS (SELECT *, (1e-9::DOUBLE + sqrt(dx * dx + dy * dy + dz * dz)) / t AS u FROM j)
SELECT id, round(sum(300 / t * exp(-u * u) * dx), 6) + 0.0::DOUBLE AS fx, round(sum(300 / t * exp(-u * u) * dy), 6) + 0.0::DOUBLE AS fy, round(sum(300 / t * exp(-u * u) * dz), 6) + 0.0::DOUBLE AS fz FROM u GROUP BY id""")
def link_repulsion(spark, d):
    p = _points(spark, d).withColumn("thickness", 0.01 * (1 + F.col("id") % 3))
    return _f(L.link_repulsion(p, 0.1, 300.0))


@query(_P + """, s AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY link) AS n FROM p), k AS (SELECT DISTINCT link, n, k, k * (n - 1) / 8.0::DOUBLE AS t FROM s, range(9) r(k))
SELECT k.link, k::INT AS seg, round(a.x + (b.x - a.x) * (t - floor(t)), 6) AS x, round(a.y + (b.y - a.y) * (t - floor(t)), 6) AS y, round(a.z + (b.z - a.z) * (t - floor(t)), 6) AS z
FROM k JOIN s a ON a.link = k.link AND a.i = floor(t) JOIN s b ON b.link = k.link AND b.i = least(floor(t) + 1, k.n - 1)""")
def resample_paths(spark, d):
    """Every label's points as a path of nine points."""
    return _f(L.resample(_points(spark, d).withColumnRenamed("id", "seg"), 9))


@query(_P + """, s AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0) AS g FROM p WINDOW w AS (PARTITION BY link ORDER BY id)),
c AS (SELECT *, sum(g) OVER (PARTITION BY link ORDER BY i) AS pos, sum(g) OVER (PARTITION BY link) AS n FROM s),
q AS (SELECT link, x, y, z, pos, n, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, lead(pos) OVER w AS pos2 FROM c WINDOW w AS (PARTITION BY link ORDER BY i))
SELECT link, k::INT AS seg, round(x + coalesce((x2 - x) * (k * n / 4.0::DOUBLE - pos) / (pos2 - pos), 0), 6) AS x, round(y + coalesce((y2 - y) * (k * n / 4.0::DOUBLE - pos) / (pos2 - pos), 0), 6) AS y,
round(z + coalesce((z2 - z) * (k * n / 4.0::DOUBLE - pos) / (pos2 - pos), 0), 6) AS z FROM q, range(5) r(k) WHERE CASE WHEN k = 4 THEN pos2 IS NULL ELSE k * n / 4.0::DOUBLE >= pos AND k * n / 4.0::DOUBLE < pos2 END""")
def resample_by_length(spark, d):
    return _f(L.resample(_points(spark, d).withColumnRenamed("id", "seg"), 5, by="length"))


@query(_P + ", w AS (SELECT id, trunc(x * 20)::BIGINT AS x, trunc(y * 20)::BIGINT AS y, trunc(z * 20)::BIGINT AS z, 0.5::DOUBLE + id % 7 AS r FROM p) SELECT id AS ord, x, y, z, round(first_value(r) OVER (PARTITION BY x, y, z ORDER BY id), 6) AS radius FROM w")
def fuel_nodes(spark, d):
    p = _points(spark, d).select(F.col("id").alias("ord"), *[(F.col(c) * 20).alias(c) for c in L.XYZ], (0.5 + F.col("id") % 7).alias("radius"))
    return _f(L.fuel_nodes(p))
