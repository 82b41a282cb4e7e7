"""Whitening of embeddings with MLlib's block matrices.

Vectors are put on an integer grid first (``x = floor(scale * c) + offset``), so that sums and
deviations are exact.  The fit list is every distinct grid vector once.  Its rows are numbered,
centred on the exact mean and indexed into a ``BlockMatrix`` A of ``rows_per_block`` rows a
block; ``A^T A``, its middle dimension cut so that every task multiplies a few blocks and sums
of small matrices are all that meets, is the scatter matrix.  That one matrix (dimension
squared, whatever the number of rows) comes to the driver for ``eigh``; a block
multiplication by the whitening matrix projects the rows, and the covariance of what comes
out is measured by another product.  The driver also holds the block numbers, a pair of
integers for every ``rows_per_block`` rows.

Rows whose vector is null or empty, holds nulls, NaN, infinities or entries beyond 2**46, or is
shorter than the longest vector are dropped.  Rows that share an id are separate rows; a null id
is kept as it is.  Equal vectors count once in the fit and get equal results.  Only components
whose eigenvalue is above 1e-10 of the largest exist: one distinct vector alone, or an
empty table, gives no rows.  ``deviation`` is null where a long cannot hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import kept
from pagelake.operators.ordered import number_rows

#: Beyond this an entry cannot be put on the grid exactly.
MOST = float(1 << 46)
#: Eigenvalues below this part of the largest are noise of rounding.
LEAST = 1e-10
ROWS_PER_BLOCK = 4096
#: Blocks that one task of the scatter product multiplies.
BLOCKS_PER_SPLIT = 16

OUT = "vec_id, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Fit:
    """What whitening needs to know of the fit list; its size follows the dimension only."""

    n: int
    whole: list[int]  # floor of the mean, per dimension
    left: list[int]  # sum - n * whole
    values: np.ndarray  # kept eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float


def on_grid(v: Column, scale: int, offset: int) -> Column:
    return F.transform(v, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("bigint"))


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= MOST))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine, F.lit(False))


def block_matrix(rows: DataFrame, n: int, dim: int, rows_per_block: int) -> BlockMatrix:
    """Rows ``(no, v)``, numbered from 0, as a matrix one block wide."""
    vectors = rows.select(F.col("no").cast("bigint").alias("no"), array_to_vector("v").alias("v"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), n, dim).toBlockMatrix(rows_per_block, dim)


def scatter(a: BlockMatrix, rows_per_block: int) -> np.ndarray:
    """``A^T A`` as a local matrix. The splits of the middle dimension keep the blocks from meeting in one task."""
    splits = max(1, -(-a.numRows() // (rows_per_block * BLOCKS_PER_SPLIT)))
    product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def centred(x: Column, n: int, whole: list[int], left: list[int]) -> Column:
    """x minus the mean: exact but for the mean's fraction."""
    parts = F.lit([r / n for r in left])
    return F.zip_with(F.zip_with(x, F.lit(whole).cast("array<bigint>"), lambda a, b: (a - b).cast("double")), parts, lambda a, b: a - b)


def deviation(x: Column, n: int, whole: list[int], left: list[int]) -> Column:
    """Sum of ``(n * x - S) ** 2``, exact; null where a long cannot hold it."""
    big = "decimal(38,0)"
    steps = F.zip_with(
        F.zip_with(x, F.lit(whole).cast("array<bigint>"), lambda a, b: (a - b).cast(big)),
        F.lit(left).cast(f"array<{big}>"),
        lambda a, r: (a * F.lit(n).cast("decimal(18,0)")).cast(big) - r,
    )
    total = F.aggregate(steps, F.lit(0).cast(big), lambda acc, s: F.try_add(acc, F.try_multiply(s, s).cast(big)).cast(big))
    return total.try_cast("bigint")


def fit(rows: DataFrame, n: int, dim: int, rows_per_block: int = ROWS_PER_BLOCK) -> Fit:
    """The mean and the kept principal components of rows ``(no, x)``."""
    sums = rows.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
    total = {r["i"]: int(r["s"]) for r in sums.collect()}  # one row for every dimension
    whole = [total[i] // n for i in range(dim)]
    left = [total[i] - n * whole[i] for i in range(dim)]
    a = block_matrix(rows.select("no", centred(F.col("x"), n, whole, left).alias("v")), n, dim, rows_per_block)
    covariance = scatter(a, rows_per_block) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(values[0], 0.0) * LEAST
    return Fit(n, whole, left, values[real], vectors[:, real], float(np.trace(covariance)))


def project(rows: DataFrame, model: Fit, components: int, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``(no, w)``: centred rows times the whitening matrix."""
    dim, k = model.vectors.shape[0], min(components, len(model.values))
    a = block_matrix(rows.select("no", centred(F.col("x"), model.n, model.whole, model.left).alias("v")), model.n, dim, rows_per_block)
    weights = model.vectors[:, :k] / np.sqrt(model.values[:k])
    sc = rows.sparkSession.sparkContext
    m = BlockMatrix(sc.parallelize([((0, 0), DenseMatrix(dim, k, weights.ravel("F").tolist()))], 1), dim, k, dim, k)
    found = a.multiply(m).toIndexedRowMatrix()
    frame = callMLlibFunc("getIndexedRows", found._java_matrix_wrapper._java_model)
    return frame.select(F.col("index").alias("no"), vector_to_array("vector").alias("w"))


def identity_error(w: DataFrame, n: int, k: int, rows_per_block: int = ROWS_PER_BLOCK) -> float:
    """The largest entry by which the covariance of rows ``(no, w)`` departs from the identity."""
    means = {r["i"]: r["m"] for r in w.select(F.posexplode("w").alias("i", "c")).groupBy("i").agg(F.avg("c").alias("m")).collect()}
    middle = F.zip_with("w", F.lit([means[i] for i in range(k)]), lambda a, b: a - b)
    covariance = scatter(block_matrix(w.select("no", middle.alias("v")), n, k, rows_per_block), rows_per_block) / n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = 16, id_col: str = "vec_id", vector: str = "embedding",
           scale: int = 64, offset: int = 1_000_000, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """One row for every usable vector and component; see the head of this module."""
    v = F.col(vector)
    rows = embeddings.where(usable(v)).select(F.col(id_col).alias("vec_id"), on_grid(v, scale, offset).alias("x"))
    spark, id_type = rows.sparkSession, rows.schema["vec_id"].dataType
    dim = rows.agg(F.max(F.size("x"))).first()[0]
    nothing = spark.createDataFrame([], T.StructType([T.StructField("vec_id", id_type), *T.StructType.fromDDL(OUT.split(", ", 1)[1]).fields]))
    if dim is None:
        return nothing
    digest = [F.xxhash64("x").alias("h"), F.xxhash64(F.lit(1), "x").alias("g")]
    rows = rows.where(F.size("x") == dim)
    listed = number_rows(rows.select("x").distinct(), [F.xxhash64("x")], "no").withColumn("no", F.col("no") - 1)
    n = listed.count()
    model = fit(listed, n, dim, rows_per_block)
    k = min(components, len(model.values))
    if not k:
        return nothing
    w = kept(project(listed, model, components, rows_per_block))
    error = identity_error(w, n, k, rows_per_block)
    facts = listed.select("no", *digest, deviation(F.col("x"), n, model.whole, model.left).alias("deviation")).join(w, "no").drop("no")
    found = rows.select("vec_id", *digest).join(facts, ["h", "g"])
    shares = F.lit((model.values[:k] / model.trace).tolist())
    return found.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
