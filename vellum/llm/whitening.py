"""Whitening of embeddings from exact integer cross-products.

Entries become whole numbers (``SCALE`` times the entry, rounded down). A block of
distinct vectors is shifted by its own least entry per dimension, and each bit plane of
each dimension is packed across the rows into words. The cross-product of two
dimensions is the sum of AND-popcounts of their planes, weighted by powers of two; the
shifts and the sums restore the unshifted product. All of this is exact, so blocks can
be added in any order. The driver sees one row of products per dimension: it centres
them as whole numbers, n times the products less the product of the sums, and only then
divides, so no digits are lost before ``eigh``.

Distinct vectors are found by grouping their canonical bytes, which counts repeated
vectors on the map side. Tasks hold one block of rows and one square of the dimensions;
their squares are added per dimension by a shuffle, so the driver's part does not grow
with rows.

Rows with a null vector, or a null or non-finite entry, are dropped. Vectors shorter
than the longest are filled up with zeros; if all are empty there are no components and
no rows. Entries beyond the range of long are cut to it; a deviation beyond it is null.
A component without spread (fewer distinct vectors than dimensions) is zero for every
row and does not count for the identity error. Null and repeated ids are rows of their
own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import durable

SCALE = 256
COMPONENTS = 4
BLOCK = 4096
LONG = 2**63 - 1
#: Bytes of one exact product: entries, rows and all.
WIDE = 24
#: Below this share of the largest eigenvalue a component has no spread.
NO_SPREAD = 1e-13

PRODUCTS = "dim int, n long, total binary, products binary"
MOMENTS = "n long, mean array<double>, scatter array<double>"
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vectors: np.ndarray) -> np.ndarray:
    """Whole numbers of finite doubles; beyond the range of long the nearest end of it."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * SCALE)
    inside = np.abs(scaled) < 2.0**63
    return np.where(inside, np.where(inside, scaled, 0).astype(np.int64), np.where(scaled < 0, -LONG, LONG))


def rows_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """(rows, dims) whole numbers of a batch of valid lists, short ones filled up with zeros."""
    lists = batch["vector"]
    values = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return whole(values.reshape(len(lengths), dims))
    filled = np.zeros((len(lengths), dims))
    filled[np.arange(dims) < lengths[:, None]] = values
    return whole(filled)


def to_bytes(row: np.ndarray) -> bytes:
    """Canonical bytes: the narrowest width that holds the whole vector, and its entries."""
    for width in ("<i2", "<i4", "<i8"):
        if (narrow := row.astype(width)).astype(np.int64).tobytes() == row.tobytes():
            return width[-1].encode() + narrow.tobytes()
    raise AssertionError


def from_bytes(packed: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(p, f"<i{chr(p[0])}", offset=1) for p in packed], np.int64)


def cross_products(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of all pairs of columns, as Python integers, by popcounts of bit planes."""
    n, dims = x.shape
    least = [int(v) for v in x.min(axis=0)]
    shifted = x.astype(np.uint64) - np.array([v % 2**64 for v in least], np.uint64)  # modulo 2**64: right where the difference fits
    planes = max(1, int(shifted.max()).bit_length())
    words = -(-n // 64)
    bits = np.zeros((planes, dims, words * 64), np.uint8)
    for b in range(planes):
        bits[b, :, :n] = ((shifted >> np.uint64(b)) & np.uint64(1)).T
    packed = np.packbits(bits, axis=2).view(np.uint64)
    fits = 2 * planes + n.bit_length() < 63
    products = np.zeros((dims, dims), np.int64 if fits else object)
    for i in range(dims):
        for a in range(planes):
            if not packed[a, i].any():
                continue
            common = np.bitwise_count(packed[:, i:] & packed[a, i]).sum(axis=2, dtype=np.int64)  # (planes, dims from i on)
            if fits:
                products[i, i:] += ((common << np.arange(planes)[:, None]).sum(axis=0)) << a
            else:
                products[i, i:] += sum(row.astype(object) << (a + b) for b, row in enumerate(common))
    upper = products.astype(object)
    upper = np.triu(upper) + np.triu(upper, 1).T
    sums = np.array([int(v) for v in shifted.astype(object).sum(axis=0)] if not fits else shifted.sum(axis=0).tolist(), object)
    shift = np.array(least, object)
    return upper + np.outer(sums, shift) + np.outer(shift, sums) + n * np.outer(shift, shift)


def _wide(values) -> bytes:
    return b"".join(int(v).to_bytes(WIDE, "little", signed=True) for v in values)


def _narrow(raw: bytes) -> np.ndarray:
    return np.array([int.from_bytes(raw[k : k + WIDE], "little", signed=True) for k in range(0, len(raw), WIDE)], object)


def blocks(batches):
    """Vectors of at most ``BLOCK`` rows at a time."""
    held: list[bytes] = []
    for batch in batches:
        held += batch["packed"].to_pylist()
        while len(held) >= BLOCK:
            yield from_bytes(held[:BLOCK])
            held = held[BLOCK:]
    if held:
        yield from_bytes(held)


def task_products(batches):
    """One row per dimension for the task: its exact products with all dimensions, and its sum."""
    n, total, products = 0, 0, 0
    for x in blocks(batches):
        n += len(x)
        total = total + x.astype(object).sum(axis=0)
        products = products + cross_products(x)
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([_wide([t]) for t in total]), pa.array([_wide(row) for row in products])],
            ["dim", "n", "total", "products"])


def add_products(table: pa.Table) -> pa.Table:
    total = sum(_narrow(t)[0] for t in table["total"].to_pylist())
    products = sum(_narrow(p) for p in table["products"].to_pylist())
    return pa.table({"dim": table["dim"][:1], "n": [sum(table["n"].to_pylist())], "total": [_wide([total])], "products": [_wide(products)]})


def components(n: int, sums: list[int], products: list[np.ndarray], wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, vectors as columns, trace) of the covariance, largest first; entries are centred as whole numbers before the division."""
    dims = len(sums)
    covariance = np.array([[(n * int(products[i][j]) - sums[i] * sums[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:wanted].copy(), vectors[:, ::-1][:, :wanted].copy()
    values[values <= NO_SPREAD * max(values[0], 0)] = 0
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)  # the largest entry is positive
    return values, vectors, float(math.fsum(np.diag(covariance)))


class Fit:
    """What every task needs: the number of fitted vectors, their sums, and the components."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.trace = n, sums, values, trace
        self.axes = vectors / np.sqrt(np.where(values > 0, values, 1)) * (values > 0)
        self.largest = max(map(abs, sums), default=0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times each vector less the sums, exact: int64 where that holds it, else Python integers."""
        largest = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
        exact = np.int64 if self.n * largest + self.largest <= LONG else object
        return self.n * x.astype(exact) - np.array(self.sums, exact)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.axes

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        if centred.dtype != object and centred.size and int(np.abs(centred).max()) ** 2 * centred.shape[1] <= LONG:
            return (centred * centred).sum(axis=1).tolist()
        return [d if (d := sum(int(v) ** 2 for v in row)) <= LONG else None for row in centred]


def _moments(fit):
    """Per task: rows, means and co-moments of the whitened vectors, centred block by block and then merged."""
    def run(batches):
        n, mean, scatter = 0, 0, 0
        for x in blocks(batches):
            n, mean, scatter = merged((n, mean, scatter), moments(fit.value.whitened(fit.value.centred(x))))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([scatter.ravel().tolist()])], ["n", "mean", "scatter"])

    return run


def moments(white: np.ndarray):
    mean = white.mean(axis=0)
    return len(white), mean, (white - mean).T @ (white - mean)


def merged(a, b):
    if not a[0]:
        return b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _add_moments(table: pa.Table) -> pa.Table:
    state = (0, 0, 0)
    for row in table.to_pylist():
        mean = np.array(row["mean"])
        state = merged(state, (row["n"], mean, np.array(row["scatter"]).reshape(len(mean), len(mean))))
    return pa.table({"n": [state[0]], "mean": [state[1].tolist()], "scatter": [state[2].ravel().tolist()]})


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component; see the module for what each column is."""
    spark = rows.sparkSession
    vector = F.col(vector_column).cast("array<double>")
    usable = vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    left = rows.where(usable).select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"))
    dims = left.agg(F.max(F.size("vector"))).first()[0] or 0
    if not dims:
        return spark.createDataFrame([], WHITENED)

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([to_bytes(x) for x in rows_of(batch, dims)], pa.binary())], ["packed"])

    distinct = durable(left.select("vector").mapInArrow(packed, "packed binary").distinct())
    squares = distinct.mapInArrow(task_products, PRODUCTS).groupBy("dim").applyInArrow(add_products, PRODUCTS).orderBy("dim").collect()  # one row per dimension
    n, sums = squares[0]["n"], [int(_narrow(r["total"])[0]) for r in squares]
    fit = Fit(n, sums, *components(n, sums, [_narrow(r["products"]) for r in squares], wanted))
    shared = spark.sparkContext.broadcast(fit)

    # sums of a few numbers per task, added in two steps
    per_task = distinct.mapInArrow(_moments(shared), MOMENTS).withColumn("some", F.spark_partition_id() % 64)
    state = (0, 0, 0)
    for row in per_task.groupBy("some").applyInArrow(lambda t: _add_moments(t.drop(["some"])), MOMENTS).collect():
        mean = np.array(row["mean"])
        state = merged(state, (row["n"], mean, np.array(row["scatter"]).reshape(len(mean), len(mean))))
    spread = fit.values > 0
    off = np.abs(state[2] / n - np.eye(len(spread)))[spread][:, spread]
    error = float(off.max()) if off.size else 0.0

    def project(batches):
        fit = shared.value
        share = [float(v / fit.trace) if fit.trace > 0 else 0.0 for v in fit.values]
        names = [x.split()[0] for x in WHITENED.split(", ")]
        for batch in batches:
            centred = fit.centred(rows_of(batch, dims))
            white, apart, many = fit.whitened(centred), fit.deviations(centred), len(share)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array([v for v in batch["vec_id"].to_pylist() for _ in range(many)], pa.int64()), pa.array(list(range(1, many + 1)) * rows, pa.int32()),
                pa.array([fit.n] * (rows * many), pa.int64()), pa.array([d for d in apart for _ in range(many)], pa.int64()), pa.array(white.ravel()),
                pa.array(share * rows, pa.float64()), pa.array([error] * (rows * many), pa.float64())], names)

    return left.mapInArrow(project, WHITENED)
