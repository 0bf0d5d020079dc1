"""Embedding whitening: leading components of a table of vectors, found without ever forming their covariance.

An entry c becomes the integer x = floor(scale * c) + shift, so that sums are exact: one pass gives the count n and the
sums S of every dimension, and n * x - S is an exactly centred vector.  The covariance V (divisor n) is met only in
products with a block of vectors: a pass computes X'(XQ) / n over the centred rows, partial sums meet by dimension, and
the driver holds what is as large as a few vectors.

*Block Lanczos.*  The block is orthogonalised against the whole basis, twice.  Directions that vanish (a breakdown: the
Krylov space is exhausted) are replaced by seeded random ones, so that further copies of an eigenvalue are found.  It ends
when the residuals |V y - e y| of the leading Ritz pairs, measured by a pass of their own, are under ``tolerance`` times
the largest eigenvalue, or when the basis has all dimensions.

The trace of V is the sum of the rows' squared deviations, so explained shares need no other eigenvalue.

Defined cases: a null vector, or one with null or non-finite entries, is left out; so is one whose length is not the
most common one (of lengths that tie, the longest).  Repeated rows and null ids each count and are returned.  A component
without variance (fewer independent rows than components, equal rows) can't be whitened and isn't returned; an empty
table returns none.  Entries too large for exact 64-bit sums raise an ArithmeticError.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

_DEVIATION = pa.decimal128(38, 0)


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """``_id, _x``: the vectors with nothing but finite entries, as integers, all of the most common length."""
    entry = F.col("_v")
    told = table.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    finite = F.forall(entry, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c))
    clean = told.where(entry.isNotNull() & (F.size(entry) > 0) & finite)
    length = clean.groupBy(F.size(entry).alias("_length")).count().orderBy(F.desc("count"), F.desc("_length")).first()
    clean = clean.where(F.size(entry) == (length["_length"] if length else 0))
    if clean.where(F.exists(entry, lambda c: F.abs(c * scale) > 2.0**52)).limit(1).count():
        raise ArithmeticError("an entry is too large to be an exact integer")
    return clean.select("_id", F.transform(entry, lambda c: F.floor(c * scale) + F.lit(shift)).alias("_x"))


def _rows(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as an (n, dimensions) array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def dimension_sums(vectors: DataFrame) -> tuple[int, list[int], int]:
    """Rows, the exact sum of each dimension, and the largest distance of any entry from 0."""

    def partial(batches):
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0))
                if float(np.abs(x).max()) * len(x) >= 2.0**62:
                    raise ArithmeticError("entries are too large for exact sums")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(x.shape[1])), pa.array(x.sum(axis=0)), pa.array(np.abs(x).max(axis=0)), pa.array(np.full(x.shape[1], len(x)))],
                    names=["at", "total", "largest", "n"],
                )

    parts = vectors.select("_x").mapInArrow(partial, "at long, total long, largest long, n long")
    found = parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("largest").alias("largest"), F.sum("n").alias("n")).collect()
    if not found:
        return 0, [], 0
    found.sort(key=lambda r: r["at"])
    return found[0]["n"], [int(r["total"]) for r in found], max(r["largest"] for r in found)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def covariance_product(vectors: DataFrame, n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """V as an operator on a block: one pass over the vectors; what a task adds up is as large as the block."""
    spark = vectors.sparkSession

    def times(block: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((block, np.array(sums)))
        width = block.shape[1]

        def partial(batches):
            q, s = shared.value
            total = np.zeros_like(q)
            for batch in batches:
                if batch.num_rows:
                    x = _centred(_rows(batch.column(0)), n, s)
                    total += x.T @ (x @ q)
            columns = [pa.array(np.ascontiguousarray(total[:, k])) for k in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), *columns], names=["at", *[f"v{k}" for k in range(width)]])

        parts = vectors.select("_x").mapInArrow(partial, "at long, " + ", ".join(f"v{k} double" for k in range(width)))
        found = parts.groupBy("at").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(width)]).collect()
        shared.destroy()
        out = np.empty_like(block)
        for row in found:
            out[row["at"]] = row[1:]
        return out / n

    return times


def _orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal block beside ``basis`` that spans what ``block`` adds to it; lost directions restart at random."""
    out = np.zeros((len(block), 0))
    for column in block.T:
        if basis.shape[1] + out.shape[1] == len(block):
            break
        floor = 1e-12 * scale
        while True:
            held = np.hstack([basis, out])
            for _ in range(2):
                column = column - held @ (held.T @ column)
            size = np.linalg.norm(column)
            if size > floor:
                column = column / size
                column = column - held @ (held.T @ column)
                out = np.hstack([out, (column / np.linalg.norm(column))[:, None]])
                break
            column, floor = rng.standard_normal(len(block)), 1e-8
    return out


def block_lanczos(
    times: Callable[[np.ndarray], np.ndarray], dimensions: int, wanted: int, block: int = 16, tolerance: float = 1e-13, seed: int = 11
) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest eigenvalues of a symmetric operator, falling, their unit vectors, and the passes it took."""
    rng = np.random.default_rng(seed)
    block, wanted = min(max(block, wanted), dimensions), min(wanted, dimensions)
    basis, image, passes = np.zeros((dimensions, 0)), np.zeros((dimensions, 0)), 0
    new = _orthonormal(rng.standard_normal((dimensions, block)), basis, 1.0, rng)
    while True:
        product = times(new)
        passes += 1
        basis, image = np.hstack([basis, new]), np.hstack([image, product])
        small = basis.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1][:wanted], inner[:, ::-1][:, :wanted]
        vectors = basis @ inner
        scale = max(abs(values[0]), np.finfo(float).tiny)
        told = np.linalg.norm(image @ inner - vectors * values, axis=0)
        if basis.shape[1] == dimensions:
            break
        if (told <= tolerance * scale).all():
            passes += 1
            if (np.linalg.norm(times(vectors) - vectors * values, axis=0) <= 10 * tolerance * scale).all():
                break
        new = _orthonormal(product, basis, scale, rng)
    return values, vectors, passes


def whiten_embeddings(
    table: DataFrame,
    components: int = 8,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    shift: int = 100_000,
    block: int = 16,
) -> DataFrame:
    """A row for each vector and component: id, ``component`` (from 1), ``n``, ``deviation`` (exact, decimal), ``whitened``,
    ``explained``, ``eigenvalue``, ``identity_error``."""
    spark = table.sparkSession
    scratch = Scratch(spark)
    vectors = scratch.write(integer_vectors(table, id_col, vector_col, scale, shift))
    n, sums, largest = dimension_sums(vectors)
    d = len(sums)
    schema = "component int, n long, deviation decimal(38,0), whitened double, explained double, eigenvalue double, identity_error double"
    id_type = table.schema[id_col].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, {schema}")
    if 2 * n * largest >= 2**62:
        raise ArithmeticError("entries are too large for exact deviations")
    exact = d * (2 * n * largest) ** 2 < 2**62  # else deviations are summed as Python's integers
    values, axes, _ = block_lanczos(covariance_product(vectors, n, sums), d, components, block)
    held = values > d * np.finfo(float).eps * max(values[0], 0.0)
    values, axes = values[held], axes[:, held]
    if not held.any():
        return spark.createDataFrame([], f"`{id_col}` {id_type}, {schema}")
    shared = spark.sparkContext.broadcast((np.array(sums), axes / np.sqrt(values)))

    def project(batches):
        s, to = shared.value
        for batch in batches:
            if batch.num_rows:
                gap = n * _rows(batch.column(1)) - s
                squares = (gap * gap).sum(axis=1) if exact else [sum(g * g for g in row) for row in gap.tolist()]
                flat = pa.array(((gap / n) @ to).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(gap) + 1, dtype=np.int32) * to.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squares).cast(_DEVIATION) if exact else pa.array(squares, _DEVIATION), lists], names=["_id", "_deviation", "_w"])

    wide = scratch.write(vectors.mapInArrow(project, f"_id {id_type}, _deviation decimal(38,0), _w array<double>"))
    k = len(values)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = [F.col("_w")[i] for i in range(k)]
    told = wide.agg(F.sum(F.col("_deviation").cast("double")).alias("deviation"), *[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max([0.0, *(abs(told[f"c{i}_{j}"] - (i == j)) for i, j in pairs)])
    trace = told["deviation"] / n / n / n
    of = F.array([F.lit(float(e)) for e in values])
    return wide.select(F.col("_id").alias(id_col), "_deviation", F.posexplode("_w").alias("_at", "_value")).select(
        id_col,
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.col("_deviation").alias("deviation"),
        F.col("_value").alias("whitened"),
        (F.get(of, F.col("_at")) / F.lit(trace)).alias("explained"),
        F.get(of, F.col("_at")).alias("eigenvalue"),
        F.lit(float(error)).alias("identity_error"),
    )
