"""Whitening of embeddings by their principal components.

Entries become whole numbers x = floor(scale * c), so everything up to the covariance's products is exact: n * x - S,
with n vectors of sums S in the fit list, is a whole number, and a row of it over n is a centred row rounded once.
The fit list holds each distinct x once, so copies (a third of the table, say) don't bend the covariance; they are
brought together before the shuffle. Its centred rows make an MLlib RowMatrix, whose Gramian is summed in a tree over
the executors and divided by n. The driver solves a matrix of dimension by dimension, and no more than that comes to
it; components go out by broadcast, and rows are whitened in batches. How white the result is, is measured from the
whitened fit list, by Spark's centred covariances.

Edge cases: rows whose vector is null, or holds null or non-finite entries, are left out, and so are those of an empty
vector. Vectors of another length than the commonest (of several the smallest) have no place in the fit: their rows
have null deviation and whitened. Repeated rows and repeated or null keys: a row of output each. Entries beyond 64 bits
saturate; a deviation beyond 64 bits is null. Components without variance (eigenvalue under dimension * 2^-52 of the
largest) aren't returned, so vectors that are all equal, one vector, and an empty table give no rows. Of an
eigenvector's signs the one in which its largest entry (the first of several) is positive. Equal eigenvalues: any basis.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, quoted

SCHEMA = "vec_id {key}, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Products of whole numbers stay in 64 bits below this.
SAFE = 1 << 62


def whole(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, x) of the usable rows."""
    c = quoted(vector)
    bad = lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))
    rows = vectors.filter(c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, bad))
    return rows.select(quoted(key).alias("vec_id"), F.transform(c, lambda v: F.floor(v.cast("double") * scale)).alias("x"))


def matrix(lists: pa.Array | pd.Series) -> np.ndarray:
    """Rows of equal length."""
    return np.stack(lists.to_numpy(zero_copy_only=False) if isinstance(lists, pa.Array) else lists.to_numpy())


def multiples(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in 64 bits where they hold it, else as Python's whole numbers."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0))) if x.size else 0
    if largest * n + max(map(abs, sums)) < SAFE:
        return x.astype(np.int64) * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(m: np.ndarray) -> list[int | None]:
    """Sums of squares by row; None beyond 64 bits."""
    largest = int(np.abs(m).max(initial=0))
    if largest * largest * m.shape[1] < SAFE:
        return (m * m).sum(axis=1).tolist()
    out = (m.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in out]


def totals(fit: DataFrame) -> list[tuple[int, int, int]]:
    """(length, number of vectors, dimension's sum) by length and dimension, in order: partial sums by task and length,
    then one small aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            x = batch.column(0)
            sizes = x.value_lengths().to_numpy()
            for size in np.unique(sizes).tolist():
                m = matrix(x.filter(pa.array(sizes == size)))
                high, low = m >> 32, m & 0xFFFFFFFF  # sums of a batch's halves fit in 64 bits
                n, old = known.get(size, (0, np.zeros(size, object)))
                known[size] = n + len(m), old + high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)
        for size, (n, sums) in known.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([str(int(s)) for s in sums])], names=["size", "k", "n", "s"])

    parts = fit.select("x").mapInArrow(run, "size int, k int, n long, s string")
    total = parts.groupBy("size", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    # the commonest length alone comes to the driver: a row for each of its dimensions
    best = total.filter("k = 0").orderBy(F.desc("n"), "size").limit(1).collect()
    if not best:
        return []
    rows = total.filter(F.col("size") == best[0]["size"]).collect()
    return [(r["size"], r["n"], int(r["s"])) for r in sorted(rows, key=lambda r: r["k"])]


def components(spark: SparkSession, fit: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors by row, of the fit list's covariance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                c = multiples(matrix(batch.column(0)), n, sums).astype(float) / n
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), c.shape[1]).cast(pa.list_(pa.float64()))], names=["c"])

    rows = fit.mapInArrow(run, "c array<double>").select(array_to_vector("c").alias("v"))
    gramian = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), n, len(sums)).computeGramianMatrix()
    values, vectors = np.linalg.eigh(gramian.toArray() / n)
    values, vectors = values[::-1], vectors.T[::-1]
    return values, vectors * np.where(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: int = 4, scale: int = 256) -> DataFrame:
    """A row for each usable row of `vectors` and each of the first `keep` components: vec_id (the key), component from
    1, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    schema = SCHEMA.format(key=vectors.schema[key].dataType.simpleString())
    rows = whole(vectors, key, vector, scale)
    fit = cut(rows.select("x").distinct(), "whitening-fit")
    known = totals(fit)
    if not known:
        return spark.createDataFrame([], schema)
    size, n, sums = known[0][0], known[0][1], [s for *_, s in known]
    fit = fit.filter(F.size("x") == size)
    values, directions = components(spark, fit, n, sums)
    count = int((values[: max(0, keep)] > max(values[0], 0.0) * size * 2.0**-52).sum())
    if not count:
        return spark.createDataFrame([], schema)
    plan = spark.sparkContext.broadcast((directions[:count] / np.sqrt(values[:count])[:, None], values[:count] / values.sum()))

    def white(x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        m = multiples(x, n, sums)
        return m.astype(float) / n @ plan.value[0].T, squares(m)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame(white(matrix(batch["x"]))[0], columns=[f"w{k}" for k in range(count)])

    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    spread = fit.mapInPandas(fitted, ", ".join(f"w{k} double" for k in range(count))).agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(spread[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fits, part in batch.groupby(batch["x"].map(len) == size):
                w, deviation = white(matrix(part["x"])) if fits else (np.full((len(part), count), np.nan), [None] * len(part))
                whitened = pd.array(w.ravel(), "Float64")
                if not fits:
                    whitened[:] = pd.NA
                yield pd.DataFrame({
                    "vec_id": part["vec_id"].repeat(count).array, "component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(part)), "n": n,
                    "deviation": pd.array(deviation, "Int64").repeat(count), "whitened": whitened, "explained": np.tile(plan.value[1], len(part)), "identity_error": error,
                })

    return rows.mapInPandas(run, schema)
