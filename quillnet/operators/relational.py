"""Deduplication, integrity, scaling and ranking of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_wins(df: DataFrame, key: Column, order: str, value: str | None = None, exclude: str | None = None) -> DataFrame:
    """(key, value of the first row in order); keys that contain ``exclude`` are left out."""
    rows = df.select(key.alias("key"), F.col(order).alias("_o"), F.col(value or order).alias("value"))
    if exclude:
        rows = rows.where(~F.col("key").contains(exclude))
    return rows.groupBy("key").agg(F.min_by("value", "_o").alias("value"))


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def assert_unique(df: DataFrame, *cols: str) -> DataFrame:
    """df, if no key repeats."""
    if df.groupBy(*cols).count().where("count > 1").limit(1).count():
        raise ValueError(f"repeated keys in {cols}")
    return df


def referential_filter(links: DataFrame, *dims: tuple[str, DataFrame, str]) -> DataFrame:
    """Links whose foreign keys all exist."""
    for fk, dim, pk in dims:
        links = links.join(dim.select(F.col(pk).alias(fk)), fk, "left_semi")
    return links


def get_or_create(target: DataFrame, incoming: DataFrame, key: str, id_col: str) -> DataFrame:
    """target with the incoming keys that it lacks; new ids follow the largest one in key order.

    Ranks come from per-range counts, so that no task sees all new keys.
    """
    new = incoming.select(key).where(F.col(key).isNotNull()).distinct().join(target.select(key), key, "left_anti")
    top = target.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    ranked = rank_all(new, [key], "_rank")
    made = ranked.join(F.broadcast(top)).select((F.col("_top") + F.col("_rank")).cast("long").alias(id_col), key)
    return target.select(F.col(id_col).cast("long").alias(id_col), key).unionByName(made)


def insert_if_absent(links: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """links and the incoming rows whose keys it lacks, one for each key. Null keys are keys like others."""
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    new = incoming.select(*links.columns).alias("a").join(links.select(*keys).alias("b"), same, "left_anti")
    rest = [c for c in links.columns if c not in keys]
    once = new.groupBy(*keys).agg(*[F.min(c).alias(c) for c in rest]) if rest else new.distinct()
    return links.unionByName(once.select(*links.columns))


def dedup_edges(edges: DataFrame, *cols: str) -> DataFrame:
    """One row for each combination of the given columns (all by default), weight included."""
    return edges.dropDuplicates(list(cols or edges.columns))


def spread(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, lo, hi, mean, std, largest): population standard deviation and largest absolute value of each column."""
    one = lambda c: F.struct(
        F.lit(c).alias("name"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.max(F.abs(c)).alias("largest")
    )
    return df.agg(F.array(*[one(c) for c in cols]).alias("_s")).select(F.inline("_s"))


def rank_all(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers from 1 over the whole table: a range sort, ranks inside each range, and a small table of offsets."""
    parts = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    from quillnet.session import cut

    parts = cut(parts)
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_i", inside).join(F.broadcast(sizes), "_p").withColumn(name, (F.col("_i") + F.col("_before")).cast("long")).drop("_p", "_i", "_before")


def beside(df: DataFrame, part: str, order: str, cols: list[str]) -> DataFrame:
    """df with _before and _after: structs of cols from the rows before and after in each part, null at its ends.

    Rows are ranked over the whole table and meet by rank, so that a part of any size is spread over all tasks. A null part is a part like
    others; rows that tie in ``order`` stand in any order. An empty table stays empty.
    """
    from quillnet.session import cut

    at = ranked = cut(rank_all(df, [part, order], "_r"))
    near = lambda k, name: ranked.select((F.col("_r") + k).alias("_r"), F.col(part).alias("_q"), F.struct(*cols).alias(name))
    for k, name in ((1, "_before"), (-1, "_after")):
        at_k, other = at.alias("a"), near(k, name).alias("b")
        at = at_k.join(other, (F.col("a._r") == F.col("b._r")) & F.col(f"a.{part}").eqNullSafe(F.col("b._q")), "left").select("a.*", f"b.{name}")
    return at.drop("_r")


def running_sum(df: DataFrame, part: str, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of value up to each row of its part: sums inside key ranges, and those of the ranges before."""
    from quillnet.session import cut

    rows = cut(df.repartitionByRange(part, order).withColumn("_p", F.spark_partition_id()))
    sums = rows.groupBy(part, "_p").agg(F.sum(value).alias("_s"))
    earlier = W.partitionBy(part).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col(part).alias("_q"), F.col("_p").alias("_o"), F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s"))
    inside = F.sum(value).over(W.partitionBy(part, "_p").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    both = rows.withColumn("_i", inside).join(sums, F.col(part).eqNullSafe(F.col("_q")) & (F.col("_p") == F.col("_o")))
    return both.withColumn(name, F.col("_i") + F.col("_s")).drop("_p", "_i", "_s", "_q", "_o")


def minmax(df: DataFrame, cols: list[str], lo: float, hi: float) -> DataFrame:
    """Columns scaled to [lo, hi] over the table; a constant column becomes lo."""
    ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(ends))
    for c in cols:
        a, z = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(c, F.when(z > a, (F.col(c) - a) / (z - a) * (hi - lo) + lo).otherwise(F.lit(float(lo))))
    return out.drop(*[f"_{n}_{c}" for c in cols for n in ("lo", "hi")])


def _histogram(df: DataFrame, col: str) -> DataFrame:
    """Distinct values with counts and the number of smaller ones, in two levels: no task holds the whole table."""
    h = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return rank_sum(h)


def rank_sum(h: DataFrame) -> DataFrame:
    from quillnet.session import cut

    parts = cut(h.repartitionByRange("v").withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.sum("n").alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_p").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(sizes), "_p").select(
        "v", "n", (F.col("_in") + F.col("_before")).alias("less")
    )


def quantiles_nearest(df: DataFrame, col: str, num: int = 10) -> DataFrame:
    """(k, value): num evenly spaced quantiles from 0 to 1, each the value of the nearest rank (ties to even)."""
    h = _histogram(df, col)
    total = h.agg(F.sum("n").alias("_all"))
    ks = df.sparkSession.range(num).select(F.col("id").cast("int").alias("k")).join(F.broadcast(total))
    at = ks.select("k", F.bround(F.col("k") / (num - 1) * (F.col("_all") - 1), 0).cast("long").alias("_at"))
    return h.join(F.broadcast(at), (F.col("_at") >= F.col("less")) & (F.col("_at") < F.col("less") + F.col("n"))).select("k", F.col("v").alias("value"))


def percentile(n: str) -> Column:
    """(smaller + not larger + 1 if any is equal) * 50 / size of the population, from ``less``, the number of equal values and ``_all``."""
    return (F.col("less") * 2 + F.col(n) + F.when(F.col(n) > 0, 1).otherwise(0)) * 50.0 / F.col("_all")


def percentile_of_score(scores: DataFrame, score: str, population: DataFrame, value: str) -> DataFrame:
    """scores with ptile: (smaller + not larger + 1 if any is equal) * 50 / size of the population."""
    own = population.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.lit(1).cast("long").alias("n"))
    asked = scores.where(F.col(score).isNotNull()).select(F.col(score).alias("v"), F.lit(0).cast("long").alias("n"))
    # Values of both sides are counted and ranked together, once; those that only scores have count nothing.
    at = rank_sum(own.unionByName(asked).groupBy("v").agg(F.sum("n").alias("n"))).withColumnRenamed("v", score)
    total = population.where(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("_all"))
    return scores.join(at, score).join(F.broadcast(total)).withColumn("ptile", percentile("n")).drop("less", "n", "_all")


def join_checked(big: DataFrame, small: DataFrame, on: str | list[str], how: str, max_rows: int = 400_000) -> DataFrame:
    """big joined with small, which goes to all tasks if it has at most max_rows rows; else both are dealt by key."""
    few = small.limit(max_rows + 1).count() <= max_rows
    return big.join(F.broadcast(small) if few else small, on, how)


def top_k(df: DataFrame, k: int, by: list[Column], partition: list[str] | None = None) -> DataFrame:
    if not partition:
        return df.orderBy(*by).limit(k)
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*partition).orderBy(*by))).where(F.col("_k") <= k).drop("_k")
