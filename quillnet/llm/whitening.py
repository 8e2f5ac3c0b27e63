"""Embedding whitening with MLlib's BlockMatrix.

1. Entries become integers, so that the count and the sums of the table are exact, and rows get consecutive numbers.
2. The centred rows make an IndexedRowMatrix, cut into blocks of ``rows_per_block`` rows. The block matrix, transposed and multiplied with
   itself, is the scatter; the middle dimension of that product is split, so that no task gets all blocks.
3. The scatter has as many entries as the square of the dimension. It goes to the driver, where eigh gives the components.
4. The block matrix times the whitening matrix (components over the square roots of their eigenvalues) projects all rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark import SparkContext, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import fresh
from quillnet.session import cut

NEW = ("component", "n", "deviation", "whitened", "explained", "identity_error")
#: A component whose eigenvalue is below this share of the trace has no variance.
NO_VARIANCE = 1e-12
_MASK = (1 << 33) - 1


class Fitted(NamedTuple):
    """n rows, exact sums of each dimension, eigenvalues in falling order, components as columns, the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def matrix(self, k: int) -> np.ndarray:
        """Dimensions times k: components over the roots of their eigenvalues; zeros where there is no variance."""
        e = self.values[:k]
        live = e > NO_VARIANCE * self.trace
        return self.components[:, :k] * np.where(live, 1 / np.sqrt(np.where(live, e, 1)), 0)


def integer_vectors(vectors: DataFrame, vec_col: str, carry: list[str], scale: int, shift: int, names: tuple[str, str]) -> DataFrame:
    """carry, x (floor(scale * c) + shift of each entry) and a consecutive number; rows without a valid vector are dropped.

    Valid: not null, no null or non-finite entry, and as long as most are (of lengths that are as common, the greatest).
    """
    x, number = names
    c = F.col(vec_col)
    fine = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    whole = F.transform(c, lambda e: F.floor(e.cast("double") * scale).cast("long") + shift)
    kept = vectors.where(F.coalesce(fine, F.lit(False)) & (F.size(c) > 0)).select(*carry, whole.alias(x))
    # The running number is written, not computed again: scans may be cut into tasks anew.
    kept = cut(kept.withColumn(number, F.monotonically_increasing_id()))
    lengths = kept.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if lengths:
        kept = kept.where(F.size(x) == lengths[0]["d"])
    place = F.shiftright(number, 33).alias("task")
    tasks = kept.groupBy(place).agg(F.count(F.lit(1)).alias("rows"), F.max(F.col(number).bitwiseAND(F.lit(_MASK))).alias("last")).orderBy("task").collect()
    ends = np.cumsum([r["last"] + 1 for r in tasks])  # one number for each task of the scan; a vector of another length leaves a row of zeros
    spark = vectors.sparkSession
    starts = spark.createDataFrame([(r["task"], int(e) - r["last"] - 1) for r, e in zip(tasks, ends, strict=True)], "task long, start long")
    numbered = kept.withColumn("task", F.shiftright(number, 33)).join(F.broadcast(starts), "task")
    return numbered.select(*carry, x, (F.col("start") + F.col(number).bitwiseAND(F.lit(_MASK))).alias(number))


def centred_blocks(rows: DataFrame, x: str, number: str, n: int, sums: list[int], height: int, rows_per_block: int) -> BlockMatrix:
    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = F.zip_with(F.col(x), mean, lambda a, m: a.cast("double") - m)
    indexed = rows.select(F.col(number).alias("index"), array_to_vector(centred).alias("vector"))
    indexed = MLUtils.convertVectorColumnsFromML(indexed, "vector")
    return IndexedRowMatrix(indexed, height, len(sums)).toBlockMatrix(rows_per_block, len(sums))


def scatter(blocks: BlockMatrix, splits: int) -> np.ndarray:
    """blocks transposed times blocks; the rows of blocks, the middle dimension of the product, are dealt to splits tasks."""
    turned = blocks.transpose()
    made = turned._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, turned.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def project(blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """(index, vector): each row of blocks times matrix."""
    d, k = matrix.shape
    one = SparkContext.getOrCreate().parallelize([((0, 0), Matrices.dense(d, k, matrix.ravel(order="F").tolist()))], 1)
    rows = blocks.multiply(BlockMatrix(one, d, k)).toIndexedRowMatrix()
    return callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)


def _deviation(x: str, n: int, sums: list[int], largest: int) -> Column:
    """Sum of (n * x - S)^2 over the dimensions, as long; null where that is more than a long holds."""
    total = F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums])
    wide = F.aggregate(
        F.zip_with(F.col(x), total, lambda a, s: F.try_subtract(F.try_multiply(a.cast("decimal(38,0)"), F.lit(n).cast("decimal(20,0)")), s)),
        F.lit(0).cast("decimal(38,0)"),
        lambda s, v: F.try_add(s, F.try_multiply(v.cast("decimal(19,0)"), v.cast("decimal(19,0)"))).cast("decimal(38,0)"),
    ).try_cast("long")
    if n * largest >= 1 << 62:
        return wide
    narrow = F.zip_with(F.col(x), F.array(*[F.lit(s).cast("long") for s in sums]), lambda a, s: a * F.lit(n).cast("long") - s)
    about = F.aggregate(narrow, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    exact = F.aggregate(narrow, F.lit(0).cast("long"), lambda s, v: s + v * v)
    return F.when(about < 9e18, exact).otherwise(wide)


def fit(rows: DataFrame, x: str, number: str, rows_per_block: int) -> tuple[Fitted, BlockMatrix, int, int] | None:
    """What the table's integer vectors teach, its centred blocks, their height and the largest entry; None of an empty table."""
    each = rows.select(F.posexplode(x).alias("at", "v")).groupBy("at").agg(
        F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.count(F.lit(1)).alias("n"), F.max(F.abs("v")).alias("largest")
    )
    found = each.orderBy("at").collect()
    if not found:
        return None
    n, sums, largest = found[0]["n"], [int(r["s"]) for r in found], max(r["largest"] for r in found)
    height = rows.agg(F.max(number)).first()[0] + 1
    blocks = centred_blocks(rows, x, number, n, sums, height, rows_per_block).persist(StorageLevel.MEMORY_AND_DISK)
    splits = max(1, min(-(-height // rows_per_block), rows.sparkSession.sparkContext.defaultParallelism * 4, 4096))
    v = scatter(blocks, splits) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")
    return Fitted(n, sums, values[order], vectors[:, order], float(np.trace(v))), blocks, height, largest


def _identity_error(z: DataFrame, k: int, n: int) -> float:
    """Largest absolute entry of the covariance of z less the identity."""
    means = z.agg(*[F.sum(F.col("z")[i]).alias(f"m{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    centred = [F.col("z")[i] - F.lit(means[i] / n) for i in range(k)]
    got = z.agg(*[F.sum(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return float(max(abs(got[m] / n - (i == j)) for m, (i, j) in enumerate(pairs)))


def whiten(
    vectors: DataFrame,
    n_components: int = 8,
    vec_col: str = "embedding",
    carry: list[str] | None = None,
    scale: int = 1024,
    shift: int = 100_000,
    rows_per_block: int = 1024,
) -> DataFrame:
    """One row for each valid vector and component: carry, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, hold a null or non-finite entry or are not as long as most are dropped. A component without variance
    (fewer rows or dimensions than components, constant columns) has whitened 0, and then identity_error is 1, as measured.
    deviation is null where a long can't hold it. With fewer dimensions than n_components there are as many components as
    dimensions. Repeated rows and null ids are rows each; an empty table gives no rows. Columns named like new ones are replaced.
    """
    carry = [c for c in (vectors.columns if carry is None else carry) if c.lower() not in NEW and c != vec_col]
    x, number = fresh(vectors, "_x"), fresh(vectors, "_number")
    rows = integer_vectors(vectors, vec_col, carry, scale, shift, (x, number))
    fitted = fit(rows, x, number, rows_per_block)
    if fitted is None:
        kinds = dict(zip(NEW, ("int", "long", "long", "double", "double", "double"), strict=True))
        return rows.select(*carry, *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])
    found, blocks, height, largest = fitted
    k = min(n_components, len(found.sums))
    z = cut(project(blocks, found.matrix(k)).select(F.col("index").alias(number), vector_to_array("vector").alias("z")))
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)
    live = rows.select(*carry, number, _deviation(x, found.n, found.sums, largest).alias("deviation"))
    # Numbers that no row bears are rows of zeros in the blocks.
    error = _identity_error(z if found.n == height else z.join(rows.select(number), number, "left_semi"), k, found.n)
    share = F.array(*[F.lit(float(e / found.trace) if found.trace > 0 else 0.0) for e in found.values[:k]])
    out = live.join(z, number).select(*carry, "deviation", F.posexplode("z").alias("_at", "whitened"))
    return out.select(
        *carry,
        (F.col("_at") + 1).alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share[F.col("_at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
