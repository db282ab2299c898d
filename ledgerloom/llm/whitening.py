"""Whitening of embeddings with exact second moments from bit planes.

1. Entries become integers. Tasks shift each dimension by its least value in a block of rows and pack the bit planes of the shifted integers,
   one word for 64 rows. A cross-product of two dimensions is the sum of the common bits of their planes, weighted by powers of two.
2. Sums over blocks are undone of their shift and added up in Spark, a row for each pair of dimensions and limb; only these d * (d + 1) / 2 sums go to the driver.
3. The scatter is centred as integers, n * sum(x y) - sum(x) sum(y), before it becomes floating point and is decomposed.
4. Each row is centred and projected in its task; the covariance of what is returned is measured in one more pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

STEP, SHIFT = 64, 1_000_000  #: an entry c is floor(STEP * c) + SHIFT
MOST = 32  #: components returned
ROWS = 16_384  #: rows of a block
LIMIT = 1 << 62  #: larger entries count as this, smaller than -LIMIT as -LIMIT
LEAST = 1e-11  #: share of the largest eigenvalue below which one can't be told from rounding
_LIMBS, _BITS = 5, 40  #: exact sums travel as so many limbs of so many bits


def whole(entries: np.ndarray) -> np.ndarray:
    """The integers of a matrix of finite entries."""
    x = np.floor(entries.astype(np.float64) * STEP)
    return np.clip(x, -float(LIMIT), float(LIMIT)).astype(np.int64) + SHIFT


def planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of a matrix of integers from 0 (rows, dimensions): words of 64 rows by plane, and each plane's dimension and bit."""
    bits = [int(m).bit_length() for m in u.max(0)] if len(u) else [0] * u.shape[1]
    dims, which = np.repeat(np.arange(u.shape[1]), bits), np.concatenate([np.arange(b) for b in bits] or [[]]).astype(np.int64)
    padded = np.zeros((-(-len(u) // 64) * 64, u.shape[1]), np.int64)
    padded[: len(u)] = u
    words = np.zeros((len(dims), len(padded) // 64), np.uint64)
    for k, (d, b) in enumerate(zip(dims, which)):
        words[k] = np.packbits((padded[:, d] >> b & 1).astype(np.uint8), bitorder="little").view(np.uint64)
    return words, dims, which


def cross_products(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums of each dimension and, for i <= j, of the products of dimensions i and j (element j - i of list i), exact, of a matrix of integers."""
    n, d = x.shape
    least = x.min(0)
    words, dims, which = planes((x - least).astype(np.int64))
    shift = [int(v) for v in least]
    ones = np.bitwise_count(words).sum(1, dtype=np.int64).tolist()
    sums = [0] * d
    for k, c in zip(zip(dims.tolist(), which.tolist()), ones):
        sums[k[0]] += c << k[1]
    starts = np.searchsorted(dims, np.arange(d + 1)).tolist()
    narrow = 2 * int(which.max(initial=0)) + len(x).bit_length() + 1 < 57  # a row's sum over 64 planes of a dimension fits 63 bits
    products = []
    for i in range(d):
        to, bits = dims[starts[i] :] - i, which[starts[i] :]
        row = np.zeros(d - i, np.int64 if narrow else object)
        for p in range(starts[i], starts[i + 1]):
            common = np.bitwise_count(words[starts[i] :] & words[p]).sum(1, dtype=np.int64)
            np.add.at(row, to, common << bits + which[p] if narrow else np.array([c << int(b) for c, b in zip(common.tolist(), bits + which[p])], object))
        products.append([int(v) for v in row])
        for j in range(i, d):  # of x instead of x - least
            products[i][j - i] += shift[i] * sums[j] + shift[j] * sums[i] + n * shift[i] * shift[j]
    return [s + n * m for s, m in zip(sums, shift)], products


def _limbs(v: int) -> list[int]:
    """v as limbs of _BITS bits, the last one with the sign."""
    return [*((v >> _BITS * k) & ((1 << _BITS) - 1) for k in range(_LIMBS - 1)), v >> _BITS * (_LIMBS - 1)]


def _matrix(column, d: int) -> np.ndarray:
    """The entries of a batch's lists of d numbers."""
    return np.asarray(pc.list_flatten(column).to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


def fit_list(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int, int]:
    """The remaining rows (id, v), how many they are, and their dimension.

    Rows go whose vector is null or has null or non-finite entries, and those whose length isn't the one that most of the others have (of equally
    many, the greater). Rows may repeat; ids may be null. n and the dimension are 0 where nothing remains or all vectors are empty.
    """
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(v.isNotNull() & ~odd)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d, n = (sizes[0]["d"], sizes[0]["count"]) if sizes else (0, 0)
    return rows.where(F.size("v") == d), n if d else 0, d


def moments(rows: DataFrame, d: int) -> tuple[list[int], list[list[int]], list[int], list[int]]:
    """Exact sums, cross-products, least and greatest integers over rows (id, v) of d entries."""

    def run(batches):
        sums, products, low, high = [0] * d, [[0] * (d - i) for i in range(d)], None, None
        for x in _blocks(batches, d):
            s, p = cross_products(x)
            sums = [a + b for a, b in zip(sums, s)]
            products = [[a + b for a, b in zip(u, v)] for u, v in zip(products, p)]
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is None:
            return
        found = [(i, -1, sums[i], int(low[i]), int(high[i])) for i in range(d)] + [(i, i + k, v, 0, 0) for i in range(d) for k, v in enumerate(products[i])]
        limbs = [_limbs(v) for _, _, v, _, _ in found]
        cols = [[f[0] for f in found], [f[1] for f in found], [f[3] for f in found], [f[4] for f in found], *([x[k] for x in limbs] for k in range(_LIMBS))]
        yield pa.record_batch([pa.array(c, pa.int32() if k < 2 else pa.int64()) for k, c in enumerate(cols)], ["i", "j", "low", "high", *(f"l{k}" for k in range(_LIMBS))])

    parts = rows.select("v").mapInArrow(run, "i int, j int, low long, high long, " + ", ".join(f"l{k} long" for k in range(_LIMBS)))
    total = parts.groupBy("i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"), *(F.sum(f"l{k}").alias(f"l{k}") for k in range(_LIMBS)))
    sums, low, high, products = [0] * d, [0] * d, [0] * d, [[0] * (d - i) for i in range(d)]
    for r in total.collect():  # d * (d + 3) / 2 rows
        value = sum(r[f"l{k}"] << _BITS * k for k in range(_LIMBS))
        if r["j"] < 0:
            sums[r["i"]], low[r["i"]], high[r["i"]] = value, r["low"], r["high"]
        else:
            products[r["i"]][r["j"] - r["i"]] = value
    return sums, products, low, high


def _blocks(batches, d: int):
    """Matrices of integers of about ROWS rows each."""
    held, size = [], 0
    for batch in pieces(batches):
        held.append(_matrix(batch.column("v"), d))
        size += len(held[-1])
        if size >= ROWS:
            yield whole(np.concatenate(held))
            held, size = [], 0
    if size:
        yield whole(np.concatenate(held))


class Whitening:
    """What rows need: n, exact sums, the components as columns over the square root of their eigenvalues, and their shares of the trace."""

    def __init__(self, n: int, sums: list[int], products: list[list[int]], low: list[int], high: list[int], most: int = MOST):
        d = len(sums)
        self.n, self.sums = n, sums
        scatter = np.zeros((d, d))
        square = n * n
        for i in range(d):
            for k, v in enumerate(products[i]):
                scatter[i, i + k] = scatter[i + k, i] = (n * v - sums[i] * sums[i + k]) / square  # exact integers, one rounding
        values, vectors = np.linalg.eigh(scatter) if d else (np.zeros(0), np.zeros((0, 0)))
        values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
        keep = values > LEAST * values[0] if len(values) and values[0] > 0 else np.zeros(len(values), bool)
        vectors = vectors[:, keep] * np.where(np.take_along_axis(vectors[:, keep], np.abs(vectors[:, keep]).argmax(0)[None], 0) < 0, -1.0, 1.0) if keep.any() else vectors[:, keep]
        self.values, self.components = values[keep], vectors
        self.scaled = vectors / np.sqrt(self.values)
        trace = np.trace(scatter)
        self.explained = self.values / trace if trace else self.values
        self.floor = np.array([s // n for s in sums], np.int64) if n else np.zeros(d, np.int64)
        self.rest = np.array([(s % n) / n for s in sums]) if n else np.zeros(d)
        self.remainder = [s % n for s in sums] if n else []
        far = max((max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(low, high, sums)), default=0)
        self.fits = d * far * far < 1 << 63

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.floor) - self.rest) @ self.scaled

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sums of squares of n * x - S, exact; None where one is no signed 64-bit integer."""
        if self.fits:
            c = self.n * (x - self.floor) - np.array(self.remainder, np.int64)
            return (c * c).sum(1).tolist()
        out = []
        for row in (x - self.floor).tolist():
            v = sum((self.n * a - r) ** 2 for a, r in zip(row, self.remainder))
            out.append(v if v < 1 << 63 else None)
        return out


def _identity_error(rows: DataFrame, model: Whitening, d: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, over all rows."""
    k = len(model.values)

    def run(batches):
        z, zz = np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches, d):
            w = model.whitened(x)
            z, zz = z + w.sum(0), zz + w.T @ w
        i, j = np.triu_indices(k)
        yield pa.record_batch([pa.array(np.r_[np.arange(k), i].astype(np.int32)), pa.array(np.r_[np.full(k, -1), j].astype(np.int32)), pa.array(np.r_[z, zz[i, j]])], ["i", "j", "s"])

    total = rows.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # of MOST components
    mean = {r["i"]: r["s"] / model.n for r in total if r["j"] < 0}
    return max(abs(r["s"] / model.n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in total if r["j"] >= 0)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST) -> DataFrame:
    """The id, component, n, deviation, whitened, explained and identity_error of each remaining vector (see fit_list()) and component.

    Components are numbered from 1 by falling eigenvalue, `most` at most; each has its largest entry positive. Those with less than LEAST of the largest eigenvalue,
    constant dimensions among them, have nothing to be scaled by and are left out; where none is left (one vector, equal vectors) and for an
    empty table there is no row. deviation is null where it is no signed 64-bit integer. Entries beyond LIMIT / STEP count as that. Other columns are ignored.
    """
    rows, n, d = fit_list(vectors, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = Whitening(n, *moments(rows, d), most) if n else None
    k = len(model.values) if model else 0
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    error = _identity_error(rows, model, d)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for batch in pieces(batches, 2 << 20):
            x = whole(_matrix(batch.column("v"), d))
            w, m = model.whitened(x), len(x)
            each = np.repeat(np.arange(m), k)
            cols = [batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(model.deviation(x), pa.int64()).take(pa.array(each)), pa.array(w.ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))]
            yield pa.record_batch(cols, names)

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector, for up to 32 components."""
    return whiten(table(spark, sf_dir, "embeddings"))
