"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become whole numbers (256 times each entry, rounded down); each distinct one is fitted
once. The leading eigenvectors of the fit list's covariance V are found without ever forming V:

1. One pass gives the number n of fitted vectors and the sum of each dimension.
2. A block Q of ``BLOCK`` random orthonormal columns is multiplied by V in a distributed pass: every
   task centres its rows, adds up XᵀXQ, and sends one number per cell of the product, which Spark sums.
3. Rayleigh-Ritz: the eigenvectors of QᵀVQ turn Q towards eigenvectors of V. The smallest Ritz value
   is the cut: a Chebyshev polynomial that stays small on [0, cut] is applied to Q by its three-term
   recurrence, one pass a degree, which damps the unwanted part of the spectrum. V has no
   eigenvalue below 0, so that interval leaves none out. Its degree is bounded, so that
   the largest eigenvalue doesn't drown the others in rounding. QR makes the block orthonormal again.
4. This is repeated until certified: the residuals |Vq - eq| of the wanted pairs are below
   ``TOLERANCE`` of the largest eigenvalue, hence each is that close to an eigenvalue; or they have
   stopped to fall and are below ``ENOUGH``. A block of random columns has a part in every eigenvector, so none is passed over.
5. A last pass over the fit list measures the whitened covariance against the identity.

The driver holds matrices of (dimensions x BLOCK), never rows. Vectors are stored as packed whole
numbers, in two bytes an entry where that suffices, since every pass reads them again.

Defined cases: a null vector and one with null, infinite or NaN entries is dropped; so is one whose
length isn't that of most rows (of equally frequent lengths the largest counts), and an empty one. Null ids
stay. Repeated vectors count once in the fit, and each row is returned. There are as many components as V has
eigenvalues above rounding, four at most: none for a single distinct vector or an empty table. Entries beyond a
long's range are set to its ends; a deviation beyond it is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readalike.llm.shipping import with_package
from readalike.sources.store import Store

COMPONENTS = 4
BLOCK = 32
SCALE = 256
SEED = 13
TOLERANCE = 2.0**-43
ENOUGH = 2.0**-36
GAIN = 2e8           # the filter's largest gain over its gain at the cut
LOWEST, HIGHEST = 3, 16  # degrees of the filter
LEAST_SHARE = 1e-12  # of the largest eigenvalue: what is below is rounding

_CELL = "cell int, value double"
_OUT = ("vec_id long, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double")


@dataclass
class Fit:
    """What all tasks need: the size of the fit list, its sums, and how vectors are packed."""
    n: int
    sums: np.ndarray
    largest: int
    kind: str

    @property
    def mean(self) -> np.ndarray:
        return np.array([int(s) / self.n for s in self.sums])


@dataclass
class Whitening:
    """Eigenvalues in falling order, their unit eigenvectors as columns, and the measured errors."""
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int
    identity_error: float


def whole_numbers(vectors: DataFrame, store: Store) -> DataFrame:
    """(vec_id, x): the rows that count, as stored arrays of longs."""
    entries = F.col("embedding").cast("array<double>")

    def finite(e: Column) -> Column:
        return e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))

    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("e")).filter(
        F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", finite))
    points = store.write(usable.select("vec_id", F.transform("e", lambda e: F.floor(e * SCALE)).alias("x")))
    length = points.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return points.filter(F.size("x") == (length.d if length else 0))


def fit_list(points: DataFrame, store: Store) -> tuple[DataFrame, Fit]:
    """The distinct vectors, packed, with their number and sums."""
    distinct = store.write(points.select("x").distinct())
    per_place = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"),
        F.max("v").alias("high"), F.min("v").alias("low")).orderBy("i").collect()
    n = per_place[0].n if per_place else 0
    largest = max((max(abs(r.high), abs(r.low)) for r in per_place), default=0)
    kind = next(k for k in ("<i2", "<i4", "<i8") if largest < 1 << (8 * int(k[2]) - 1) or k == "<i8")
    fit = Fit(n, np.array([int(r.s) for r in per_place], object), largest, kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = as_matrix(batch.column("x"), len(fit.sums)).astype(fit.kind)
            yield pa.RecordBatch.from_pydict({"x": pa.array([r.tobytes() for r in rows], pa.binary())})

    return store.write(with_package(distinct).mapInArrow(pack, "x binary")), fit


def as_matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def centred(column: pa.Array, kind: str, mean: np.ndarray) -> np.ndarray:
    """Packed vectors of one Arrow column less the mean, as doubles."""
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]].view(kind)
    return flat.reshape(len(column), len(mean)).astype(np.float64) - mean


def summed(packed: DataFrame, fit: Fit, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of ``part``, a matrix for each batch of centred rows."""
    mean, kind = fit.mean, fit.kind

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(centred(batch.column("x"), kind, mean))
        yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size, dtype=np.int32), "value": total.ravel()})

    cells = packed.mapInArrow(add, _CELL).groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(shape[0] * shape[1])
    for r in cells:
        out[r.cell] = r.value
    return out.reshape(shape)


def covariance_times(packed: DataFrame, fit: Fit, block: np.ndarray) -> np.ndarray:
    """VQ: one pass over the fit list."""
    return summed(packed, fit, lambda c: c.T @ (c @ block), block.shape) / fit.n


def filtered(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, product: np.ndarray,
             cut: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of [0, cut] in V times the block; ``product`` is V times the block."""
    half = cut / 2.0
    before, now = block, (product - half * block) / half
    for _ in range(degree - 1):
        before, now = now, 2.0 * (times(now) - half * now) / half - before
        size = np.linalg.norm(now, axis=0)
        before, now = before / size, now / size
    return now


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Largest eigenvalues and unit eigenvectors of V, which only ``times`` knows; the worst residual; the passes."""
    block = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, min(d, max(BLOCK, wanted)))))[0]
    passes, history = 0, []
    while True:
        product = times(block)
        passes += 1
        inner = block.T @ product
        values, turn = np.linalg.eigh((inner + inner.T) / 2.0)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        largest = values[0]
        if largest <= 0:
            return values[:0], block[:, :0], 0.0, passes
        worst = np.linalg.norm(product[:, :wanted] - block[:, :wanted] * values[:wanted], axis=0).max() / largest
        history.append(worst)
        stalled = len(history) > 3 and worst > 0.5 * min(history[:-3])
        if worst <= TOLERANCE or (stalled and worst <= ENOUGH) or block.shape[1] == d:
            kept = values[:wanted] > LEAST_SHARE * largest
            return values[:wanted][kept], block[:, :wanted][:, kept], float(worst), passes
        # A cut of 0 would leave no interval to damp: the block then holds all of V's range.
        cut = max(values[-1], LEAST_SHARE * largest)
        degree = int(np.clip(np.log(GAIN) / np.arccosh(max(2.0 * largest / cut - 1.0, 1.0 + 1e-9)), LOWEST, HIGHEST))
        block = np.linalg.qr(filtered(times, block, product, cut, degree))[0]
        passes += degree - 1


def whitening(packed: DataFrame, fit: Fit, components: int = COMPONENTS) -> Whitening:
    """The fitted transform: projection on each eigenvector over the root of its eigenvalue."""
    values, vectors, residual, passes = leading(
        lambda block: covariance_times(packed, fit, block), len(fit.sums), components)
    trace = float(summed(packed, fit, lambda c: np.array([[(c * c).sum()]]), (1, 1))[0, 0]) / fit.n
    error = 0.0
    if len(values):
        scaled = vectors / np.sqrt(values)
        k = len(values)
        # The last row holds the sums, so that the whitened rows are centred to the last digit as well.
        sums = summed(packed, fit, lambda c: np.vstack([(c @ scaled).T @ (c @ scaled), (c @ scaled).sum(axis=0)[None]]),
                      (k + 1, k)) / fit.n
        error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())
    return Whitening(values, vectors, trace, residual, passes, error)


def deviations(x: np.ndarray, fit: Fit) -> pa.Array:
    """Exact sum over the dimensions of (n x - S) squared; null beyond a long."""
    most = fit.n * fit.largest + max(abs(int(s)) for s in fit.sums)
    if len(fit.sums) * most * most < 1 << 63:
        apart = fit.n * x - fit.sums.astype(np.int64)
        return pa.array((apart * apart).sum(axis=1))
    apart = fit.n * x.astype(object) - fit.sums
    return pa.array([v if v < 1 << 63 else None for v in (int(s) for s in (apart * apart).sum(axis=1))], pa.int64())


def whitened(points: DataFrame, fit: Fit, found: Whitening) -> DataFrame:
    """One row per vector and component."""
    k, mean = len(found.values), fit.mean
    scaled = found.vectors / np.sqrt(found.values)
    explained = found.values / found.trace if k else found.values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = as_matrix(batch.column("x"), len(fit.sums))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(rows),
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows),
                "n": np.full(len(rows), fit.n),
                "deviation": deviations(x, fit).take(rows),
                "whitened": ((x - mean) @ scaled).ravel(),
                "explained": np.tile(explained, batch.num_rows),
                "identity_error": np.full(len(rows), found.identity_error)})

    return with_package(points).mapInArrow(project, _OUT)


def whiten(vectors: DataFrame, store: Store, components: int = COMPONENTS) -> DataFrame:
    """Whitened leading components of every vector of (vec_id, embedding)."""
    points = whole_numbers(vectors, store)
    packed, fit = fit_list(points, store)
    found = Whitening(np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0, 0.0) if not fit.n else whitening(packed, fit, components)
    return whitened(points, fit, found)
