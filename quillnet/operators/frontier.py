"""What can be reached from seeds over links: rounds that join only what the last round has found.

What was seen is a table of its own for each round. A bitmap of it, built and tested with DataFrame functions, lets keys pass that
are surely new; only the others meet the exact anti join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.session import cut

#: Bits of the bitmap: 32 KB to 2 MB. With more keys it lets fewer pass, and the anti join does the rest.
LEAST_BITS, MOST_BITS = 18, 24


def bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """One row (bits array<long>) with a bit set at the hash of each key."""
    at = keys.select(F.pmod(F.xxhash64(key), F.lit(1 << bits)).alias("at")).distinct()
    words = at.groupBy((F.shiftright("at", 6)).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("b"))
    filled = F.map_from_entries(F.collect_list(F.struct("w", "b")))
    return words.agg(filled.alias("m")).select(F.transform(F.sequence(F.lit(0), F.lit((1 << bits - 6) - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("bits"))


def surely_new(keys: DataFrame, key: str, held: DataFrame, bits: int) -> DataFrame:
    """keys with ``_new``: true where the bitmap shows that the key was never set."""
    at = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    word = F.element_at(F.col("bits"), (F.shiftright(at, 6) + 1).cast("int"))
    bit = F.shiftright(word, 0).bitwiseAND(F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(`{key}`), {1 << bits}) & 63 AS INT))"))
    return keys.join(F.broadcast(held)).withColumn("_new", bit == 0).drop("bits")


def reach(seeds: DataFrame, edges: DataFrame, key: str = "id", src: str = "src", dst: str = "dst", stop: DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
    """(key, depth): everything that links lead to from the seeds, with the number of the round that found it; seeds have 0.

    Keys in ``stop`` are never visited, not even as seeds; nulls neither. Each round's table is written; a round joins the edges
    with the delta of the last one only.
    """
    column = seeds.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    barred = stop.select(F.col(stop.columns[0]).alias(key)).distinct() if stop is not None else None
    if barred is not None:
        column = column.join(barred, key, "left_anti")
    seen = delta = cut(column.withColumn("depth", F.lit(0)))
    steps = cut(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("_s"), F.col(dst).alias(key)).distinct())
    total = seen.count()
    for k in range(1, max_rounds + 1):
        found = steps.join(delta.select(F.col(key).alias("_s")), "_s").select(key).distinct()
        if barred is not None:
            found = found.join(barred, key, "left_anti")
        bits = min(MOST_BITS, max(LEAST_BITS, (16 * total).bit_length()))
        marked = cut(surely_new(found, key, bitmap(seen, key, bits), bits))
        new = marked.where("_new").select(key).unionByName(marked.where(~F.col("_new")).select(key).join(seen.select(key), key, "left_anti"))
        delta = cut(new.withColumn("depth", F.lit(k)))
        more = delta.count()
        if not more:
            break
        seen, total = seen.unionByName(delta), total + more
    return seen
