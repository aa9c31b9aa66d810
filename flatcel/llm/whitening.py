"""Embedding whitening by a weighted multiplicity covariance.

Entries are put on an integer grid, so that equal vectors are equal bit by bit and sums are
exact. Identical grid vectors are grouped first; a distinct vector enters the fit once, with
its count (or one) as weight. Covariances are partial matrix products inside the tasks, of
vectors centred by exact integers; only matrices of dimension x dimension leave a task, whatever
the number of rows. Every distinct vector is whitened once and joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flatcel.operators.skew import join_unique
from flatcel.session import cut_lineage

SCALE, SHIFT = 1024, 100_000
# Entries beyond this are set to it: products with the number of vectors must stay integers.
LARGEST = float(1 << 40)
COMPONENTS = 8
# An eigenvalue below this share of the trace is no variance, only rounding.
NO_VARIANCE = 1e-13
CELLS = 1 << 20  # matrix cells handled at once inside a task


def grid_vector(vector: Column) -> Column:
    """floor(1024 c) + 100000 of every entry c, as longs."""
    return F.transform(
        vector,
        lambda c: F.floor(F.least(F.greatest(SCALE * c.cast("double"), F.lit(-LARGEST)), F.lit(LARGEST))) + F.lit(SHIFT),
    )


def _usable(vector: Column) -> Column:
    """Null, empty and partly null or non-finite vectors are out."""
    limit = F.lit(float("inf"))
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == limit))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def _matrix(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a batch as integer matrices of bounded size."""
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    step = max(1, CELLS // dim)
    for at in range(0, len(flat), step):
        yield at, flat[at : at + step]


def _centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """n x - S exactly: as longs where they hold it, as Python integers otherwise."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 61:
        return x * n - sums.astype("int64")
    return x.astype(object) * n - sums


def _moments(distinct: DataFrame, dim: int, project) -> np.ndarray:
    """Weighted second moments of the rows that ``project`` makes of integer matrices: one partial
    product a task, added up row by row. The sum has a fixed size, so the driver may take it."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            weights = batch.column("w").to_numpy(zero_copy_only=False)
            for at, x in _matrix(batch, dim):
                z = project(x)
                part = (z * weights[at : at + len(x), None]).T @ z
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "row": pa.array(list(total))})

    parts = distinct.mapInArrow(partial, "i int, row array<double>")

    def add(tables: pa.Table) -> pa.Table:
        rows = tables.column("row").combine_chunks()
        total = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).sum(axis=0)
        return pa.table({"i": tables.column("i")[:1], "row": pa.array([total])})

    rows = parts.groupBy("i").applyInArrow(add, "i int, row array<double>").collect()
    return np.array([r.row for r in sorted(rows, key=lambda r: r.i)])


def whiten(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, weights: str = "count"
) -> DataFrame:
    """One row per usable row of ``df`` and component (from 1, by falling variance): id, component,
    n (weight of the fit), deviation (sum over dimensions of (n x - S)^2), whitened, explained,
    identity_error.

    ``weights``: "count" fits all vectors, "one" every distinct vector once. Rows whose vector is
    null, empty, or holds a null or non-finite entry are dropped; so are vectors whose length is not
    the most frequent one (of equally frequent ones the longest). Entries beyond 2^30 count as 2^30.
    Repeated rows and ids each get their own result, null ids too. Components without variance (too
    few distinct vectors, constant or dependent dimensions) are left out; an empty table gives no
    rows. A deviation past 64 bits is null. A component's sign makes its greatest entry positive.
    Columns besides id and vector are not read, whatever their names.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights must be 'count' or 'one'")
    id_type = df.schema[id_col].dataType.simpleString()
    schema = (
        f"{id_col} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    empty = df.sparkSession.createDataFrame([], schema)
    rows = df.select(F.col(id_col).alias("__row"), F.col(vector_col).alias("__v")).where(_usable(F.col("__v")))
    rows = rows.select("__row", grid_vector(F.col("__v")).alias("x"))
    # The content hash stands for the vector, so rows travel without it.
    rows = rows.withColumn("h", F.unhex(F.sha2(F.to_json("x"), 256)))
    distinct = cut_lineage(rows.groupBy("h").agg(F.any_value("x").alias("x"), F.count(F.lit(1)).alias("copies")))
    lengths = distinct.groupBy(F.size("x").alias("dim")).agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("k"))
    common = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return empty
    dim, n = common.dim, common.n if weights == "count" else common.k
    weight = F.col("copies") if weights == "count" else F.lit(1)
    fit = distinct.where(F.size("x") == dim).select("h", "x", "copies", weight.cast("double").alias("w"))
    exact = fit.select(F.posexplode("x").alias("i", "c"), F.col("w").cast("decimal(20,0)").alias("w"))
    sums = {r.i: int(r.s) for r in exact.groupBy("i").agg(F.sum(F.col("c") * F.col("w")).alias("s")).collect()}
    sums = np.array([sums[i] for i in range(dim)], dtype=object)

    def centre(x: np.ndarray) -> np.ndarray:
        return (_centred(x, sums, n) / n).astype("float64")

    cov = _moments(fit.select("x", "w"), dim, centre) / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > NO_VARIANCE * np.trace(cov)]
    if not order:
        return empty
    axes = vectors[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(len(order))])
    axes = axes / np.sqrt(values[order])
    explained = [float(v) for v in values[order] / np.trace(cov)]
    error = _moments(fit.select("x", "w"), dim, lambda x: centre(x) @ axes) / n - np.eye(len(order))
    error = float(np.abs(error).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrix(batch, dim):
                t = _centred(x, sums, n)
                if t.dtype == object or int(np.abs(t).max(initial=0)) ** 2 * dim >= 1 << 63:
                    far = (t.astype(object) ** 2).sum(axis=1)
                    far = [int(v) if v < 1 << 63 else None for v in far]
                else:
                    far = (t * t).sum(axis=1)
                z = ((t / n).astype("float64") @ axes).reshape(-1)
                ends = np.arange(0, len(z) + 1, len(order), dtype="int32")
                yield pa.RecordBatch.from_pydict(
                    {
                        "h": batch.column("h").slice(at, len(x)),
                        "deviation": pa.array(far, pa.int64()),
                        "z": pa.ListArray.from_arrays(pa.array(ends), pa.array(z)),
                        "copies": batch.column("copies").slice(at, len(x)),
                    }
                )

    white = fit.select("h", "x", "copies").mapInArrow(project, "h binary, deviation long, z array<double>, copies long")
    both = join_unique(rows.where(F.size("x") == dim).select("__row", "h"), white, ["h"], "copies")
    return both.select(
        F.col("__row").alias(id_col), "deviation", F.posexplode("z").alias("__k", "whitened")
    ).select(
        id_col, (F.col("__k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, explained)), F.col("__k") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
