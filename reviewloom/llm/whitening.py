"""Embedding whitening by Chan merging.

Each partition of the table gives the count, the local mean and the centred
scatter of its vectors; the pairwise merge formula adds them up in a tree
reduction, so the driver gets one matrix. Its eigenvectors are found there, and
every vector is projected on them over the square root of the eigenvalue. A second
pass over all vectors gathers the moments of the whitened vectors in the same way
and tells by how much their covariance differs from the identity.

Vectors are held as integers, floor(``SCALE`` * c) + ``SHIFT``, so their counts and sums are
exact; the moments are doubles, centred before anything is multiplied.

Nulls and odd input: a null vector and one with null, NaN or infinite entries, or with an
entry too large for a 64-bit integer, is dropped; so is one of another dimension than most of the others have
(of equally frequent ones the greatest), as is an empty one. Repeated rows and null ids are rows like any other.
A component without variance (below ``FLAT`` of the greatest, or all, as for a single vector) can't be
whitened and has no rows. An empty table gives an empty result. Other columns are not read.
A deviation beyond a 64-bit integer is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shared import beside

#: An entry c becomes the integer floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries whose integer fits 64 bits with room to spare are below this.
LARGEST = 2.0**51
#: Share of the greatest variance below which a component has none.
FLAT = 1e-12
#: Rows that are worked on at a time.
ROWS = 4096


@dataclass
class Moments:
    """Of some vectors: how many, their exact sums (if they are integers), their mean (of integers, less ``SHIFT``) and centred scatter."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        # The shift goes first: the smaller the mean, the more of its bits are right.
        small = x - SHIFT if x.dtype == np.int64 else x
        mean = small.mean(axis=0)
        centred = small - mean
        sums = x.sum(axis=0, dtype=object) if x.dtype == np.int64 and np.abs(x).max() > 2**50 else x.sum(axis=0)
        return Moments(len(x), [int(s) for s in sums] if x.dtype == np.int64 else [], mean, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        """Chan's formula: the scatters add up, and the distance of the means counts n * m / (n + m) times."""
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.mean + apart * (other.n / n), scatter)


@dataclass
class Whitener:
    """What is fitted: count, exact sums, and for each component (a row) its direction, variance and share of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variance: np.ndarray
    explained: np.ndarray

    @staticmethod
    def fit(m: Moments, most: int) -> Whitener:
        values, vectors = np.linalg.eigh(m.scatter / m.n)
        values, vectors = values[::-1], vectors[:, ::-1]
        kept = int((values[:most] > max(values[0] * FLAT, 0)).sum())
        total = float(np.trace(m.scatter / m.n))
        return Whitener(m.n, m.sums, vectors[:, :kept].T.copy(), values[:kept].copy(), values[:kept] / total if kept else values[:0])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """The integer vectors, centred and projected, a column for each component."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return ((x - whole) - rest) @ self.components.T / np.sqrt(self.variance)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - sums) squared, exact; null beyond 64 bits."""
        far = self.n * (x - np.array([s / self.n for s in self.sums]))
        if (self.n * np.abs(x).max() < 2**62) and max(map(abs, self.sums)) < 2**62 and (far**2).sum(axis=1).max() < 2**61:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [e if e < 2**63 else None for e in exact]


def _integers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a usable vector, and these as integers."""
    rows = np.flatnonzero(np.asarray(pa.compute.equal(pa.compute.list_value_length(vectors), width).fill_null(False)))
    flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), width)
    good = (np.abs(flat) < LARGEST).all(axis=1)  # NaN, which nulls are too, compares as false
    return rows[good], np.floor(flat[good] * SCALE).astype(np.int64) + SHIFT


def _moments(df: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray]) -> Moments | None:
    """Moments of ``of`` the integer vectors of ``df``: a partition at a time, then merged in a tree."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                _, x = _integers(b.column("vector").slice(start, ROWS), width)
                if len(x):
                    m = Moments.of(of(x))
                    done = m if done is None else done.merged(m)
        if done is not None:
            sums = pa.array([[str(s) for s in done.sums]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([done.n]), sums, pa.array([done.mean.tobytes()]), pa.array([done.scatter.tobytes()])], ["n", "sums", "mean", "scatter"])

    def read(r) -> Moments:
        mean = np.frombuffer(r["mean"])
        return Moments(r["n"], [int(s) for s in r["sums"]], mean, np.frombuffer(r["scatter"]).reshape(len(mean), len(mean)))

    parts = df.mapInArrow(local, "n long, sums array<string>, mean binary, scatter binary").rdd.map(read)
    return parts.treeReduce(lambda a, b: a if b is None else b if a is None else a.merged(b))


def whiten(df: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each usable vector's first ``most`` components.

    ``n``: vectors fitted on, all that are usable; ``deviation``: the squared distance from their mean in n-ths, exact; ``explained``: the component's
    share of the variance; ``identity_error``: the largest entry of the whitened vectors' covariance less the identity.
    """
    spark = df.sparkSession
    names = [beside(id_col, c) for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")]
    kind = df.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {names[0]} int, {names[1]} long, {names[2]} long, {names[3]} double, {names[4]} double, {names[5]} double"
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    usable = F.forall("vector", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    rows = rows.where((F.size("vector") > 0) & usable)
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    top = widths.agg(F.max(F.struct("n", "width"))["width"]).first()[0]
    model, error = None, 0.0
    if top is not None:
        vectors = rows.select("vector")
        model = Whitener.fit(_moments(vectors, top, lambda x: x), most)
        if len(model.variance):
            second = _moments(vectors, top, model.whitened)
            error = float(np.abs(second.scatter / second.n - np.eye(len(model.variance))).max())
    if model is None or not len(model.variance):
        return spark.createDataFrame([], schema)
    fitted = model

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(fitted.variance)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                at, x = _integers(b.column("vector"), top)
                if not len(at):
                    continue
                ids = b.column("id").take(pa.array(np.repeat(at, many)))
                deviation = pa.array([d for d in fitted.deviations(x) for _ in range(many)], pa.int64())
                cells = [
                    ids,
                    pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * many, fitted.n)),
                    deviation,
                    pa.array(fitted.whitened(x).ravel()),
                    pa.array(np.tile(fitted.explained, len(at))),
                    pa.array(np.full(len(at) * many, error)),
                ]
                yield pa.RecordBatch.from_arrays(cells, [id_col, *names])

    return rows.mapInArrow(project, schema)
