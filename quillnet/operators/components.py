"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.session import cut, discard


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges (src > dst)."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    large = (
        both.join(least, "src").where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    ).distinct()
    low = large.groupBy("src").agg(F.min("dst").alias("m"))
    return (
        large.join(low, "src")
        .select(F.explode(F.array("src", "dst")).alias("src"), F.col("m").alias("dst"))
        .where(F.col("src") > F.col("dst"))
        .distinct()
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """(id, component) for every end of an edge; component is the smallest id reachable.

    Self-loops and null ends link nothing; an id that has no other edge is not returned. Hubs are met by partial minima
    and joins that adaptive execution can split, never by gathering a group. Every round is written to the shared folder.
    """
    a, b = F.col(src), F.col(dst)
    now = cut(
        edges.where(a != b).select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).distinct()
    )
    before = _state(now)
    for _ in range(max_rounds):
        last, now = now, cut(_stars(now))
        discard(last)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("dst").alias("id")).distinct()
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
