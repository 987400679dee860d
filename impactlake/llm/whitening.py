"""Embedding whitening: a compensated covariance, its eigenvectors, and the vectors on them with unit variance.

Entries are read as x = floor(scale * c) + shift, as longs.  Their sums are exact, so the mean is a whole
number and a fraction, and a centred entry is known as an unevaluated sum of two doubles (high and low
part).  Products of centred entries are split without error (TwoProduct by halves of the mantissa), summed without error (TwoSum) in a
tree over the rows of a block and then block after block, all in double-double.  Tasks hand on high and low parts in chunks of
cells, which are merged in double-double in two rounds; what reaches the driver is one number pair a pair of dimensions,
whatever the table.  There the covariance is brought to tridiagonal form and solved by divide and conquer (LAPACK's syevd, which is
what numpy's eigh calls), and the eigenvectors are refined against high and low parts in extended precision.

Rows whose vector is null, empty, or holds null or non-finite entries take no part and are not returned.  Vectors of another length are a
space of their own with their own fit.  A component without variance (rank below the dimension, or rows that are all equal) has null for its
whitened values, and identity_error leaves it out; explained is null where nothing varies.  Repeated rows and
ids, null ids too, all count and all come back.  Entries beyond a long and deviations beyond a long are errors that name the row.  An
empty table gives no rows.  Other columns pass through `whiten` unless they bear the name of an added one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import extra_columns, read, ship, tidy

SCALE, SHIFT = 1024.0, 100000
CELLS = 1 << 17  # products worked on at once
CHUNK = 1 << 12  # cells in a row that tasks hand on
SALTS = 32  # tasks that merge a chunk in the first round
HALF = 134217729.0  # 2^27 + 1 parts a double's mantissa
LONG = 1 << 63

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and its rounding error."""
    s = a + b
    v = s - a
    return s, (a - (s - v)) + (b - v)


def halves(a: np.ndarray) -> Pair:
    t = HALF * a
    hi = t - (t - a)
    return hi, a - hi


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a * b and its rounding error."""
    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def plus(a: Pair, b: Pair) -> Pair:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    e = e + t
    s, e = s + e, e - ((s + e) - s)
    e = e + f
    hi = s + e
    return hi, e - (hi - s)


class Products:
    """Sums over rows of the products of all pairs of their entries, in double-double."""

    def __init__(self, dim: int):
        self.left, self.right = np.triu_indices(dim)
        self.sum: Pair = (np.zeros(len(self.left)), np.zeros(len(self.left)))
        self.rows = max(1, CELLS // max(1, len(self.left)))

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """hi, lo: rows x dim."""
        for at in range(0, len(hi), self.rows):
            h, low = hi[at : at + self.rows], lo[at : at + self.rows]
            up, down = halves(h)
            a, al, b, bl = up[:, self.left], down[:, self.left], up[:, self.right], down[:, self.right]
            p = h[:, self.left] * h[:, self.right]
            e = ((a * b - p) + a * bl + al * b) + al * bl
            e += h[:, self.left] * low[:, self.right] + low[:, self.left] * h[:, self.right]
            while len(p) > 1:
                odd = (p[-1:], e[-1:]) if len(p) % 2 else None
                half = len(p) // 2
                p, e = plus((p[:half], e[:half]), (p[half : 2 * half], e[half : 2 * half]))
                if odd:
                    p, e = (np.concatenate(x) for x in ((p, odd[0]), (e, odd[1])))
            self.sum = plus(self.sum, (p[0], e[0]))


def vectors(batch: pa.RecordBatch, at: int) -> np.ndarray:
    """A list column, all of one length and finite, as rows x dim of doubles."""
    column = batch.column(at)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def entries(batch: pa.RecordBatch, at: int, ids: int, scale: float, shift: int) -> np.ndarray:
    """The entries as longs."""
    y = np.floor(scale * vectors(batch, at))
    if not (np.abs(y) < LONG - 2 * abs(shift) - 1024).all():
        bad = np.flatnonzero(~(np.abs(y) < LONG - 2 * abs(shift) - 1024).all(axis=1))[0]
        raise ValueError(f"row {batch.column(ids)[bad].as_py()}: an entry beyond a long")
    return y.astype(np.int64) + shift


MERGED = "chunk int, hi array<double>, lo array<double>"


def products(rows: DataFrame, dim: int, points: Callable[[pa.RecordBatch], Pair]) -> Pair:
    """The sum over all rows of the products of all pairs of `points`, as two dim x dim matrices (high and low parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, some = Products(dim), False
        for batch in batches:
            if batch.num_rows:
                acc.add(*points(batch))
                some = True
        if some:
            salt = TaskContext.get().partitionId() % SALTS
            for c, at in enumerate(range(0, len(acc.left), CHUNK)):
                hi, lo = (x[at : at + CHUNK] for x in acc.sum)
                yield pa.RecordBatch.from_arrays([pa.array([salt], pa.int32()), pa.array([c], pa.int32()), pa.array([hi.tolist()]), pa.array([lo.tolist()])], names=["salt", "chunk", "hi", "lo"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Pair] = {}
        for batch in batches:
            for c, h, low in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2))):
                got = np.asarray(h.values), np.asarray(low.values)
                held[c] = plus(held[c], got) if c in held else got
        for c, (h, low) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([h.tolist()]), pa.array([low.tolist()])], names=["chunk", "hi", "lo"])

    first = rows.mapInArrow(tidy(run), f"salt int, {MERGED}").repartition("chunk", "salt").select("chunk", "hi", "lo").mapInArrow(tidy(merge), MERGED)
    table = first.repartition("chunk").mapInArrow(tidy(merge), MERGED).orderBy("chunk").toArrow()  # dim x (dim + 1) / 2 cells
    left, right = np.triu_indices(dim)
    out = []
    for name in ("hi", "lo"):
        full = np.zeros((dim, dim))
        cells = np.concatenate([np.asarray(x.values) for x in table.column(name)] or [np.zeros(len(left))])
        full[left, right] = cells
        full[right, left] = cells
        out.append(full)
    return out[0], out[1]


@dataclass
class Space:
    """The fit of all vectors of one length."""

    dim: int
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # eigenvectors as columns
    trace: float
    varies: int  # how many of the eigenvalues are above the rounding of the largest


def eigen(hi: np.ndarray, lo: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of the symmetric matrix hi + lo, refined in extended precision (each round squares the error)."""
    _, x = np.linalg.eigh(hi)
    x = x[:, ::-1].astype(np.longdouble)
    full = hi.astype(np.longdouble) + lo
    values = np.zeros(len(hi))
    for _ in range(rounds):
        r = np.eye(len(hi), dtype=np.longdouble) - x.T @ x
        s = x.T @ (full @ x)
        values = np.diag(s) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > 2 * (np.abs(s - np.diag(values)).max() + np.abs(values).max() * np.abs(r).max())
        x = x + x @ np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(float), x[:, order].astype(float)


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a whole vector."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return df.where(F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, fine))


def _centred(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, Pair]:
    """The mean as whole numbers, what is left of each sum, and that share of n as a double-double."""
    whole = [s // n for s in sums]
    rest = [s - q * n for s, q in zip(sums, whole)]
    hi = [r / n for r in rest]
    lo = [float(Fraction(r, n) - Fraction(h)) for r, h in zip(rest, hi)]
    return np.array(whole, np.int64), np.array(rest, object), (np.array(hi), np.array(lo))


def around(x: np.ndarray, whole: np.ndarray, share: Pair) -> Pair:
    """x minus the mean, as a double-double."""
    hi, lo = two_sum((x - whole).astype(float), -share[0])
    return two_sum(hi, lo - share[1])


def fit(df: DataFrame, vector: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> list[Space]:
    """The covariance of all vectors (divisor n), by length, and its eigenvectors."""
    ship(df.sparkSession)
    rows = usable(df.select(F.col(vector).alias("v")), "v").withColumn("id", F.lit("of the fit"))
    out = []
    for dim, n in rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():  # a row a length
        own = rows.where(F.size("v") == dim)

        def run(batches: Iterator[pa.RecordBatch], dim: int = dim) -> Iterator[pa.RecordBatch]:
            total = np.zeros(dim, object)
            for batch in batches:
                if batch.num_rows:
                    x = entries(batch, 0, 1, scale, shift)
                    # halves of the bits: their sums cannot overflow in a batch
                    total = total + (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(t) for t in total], pa.string())], names=["at", "total"])

        sums = [int(r["total"]) for r in own.mapInArrow(tidy(run), "at int, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("at").collect()]
        whole, _, share = _centred(n, sums)
        hi, lo = products(own, dim, lambda batch, whole=whole, share=share: around(entries(batch, 0, 1, scale, shift), whole, share))
        v, rest = hi / n, np.zeros_like(hi)
        p, e = two_product(v, np.full_like(v, float(n)))
        rest = ((hi - p) - e + lo) / n
        values, axes = eigen(v, rest)
        trace = float(np.trace(v) + np.trace(rest))
        varies = int((values > values.max(initial=0) * dim * 2.0**-50).sum()) if trace > 0 else 0
        out.append(Space(dim, n, sums, values, axes, trace, varies))
    return out


def _projected(x: np.ndarray, space: Space, whole: np.ndarray, share: Pair, k: int) -> np.ndarray:
    hi, lo = around(x, whole, share)
    return (hi @ space.axes[:, :k] + lo @ space.axes[:, :k]) / np.sqrt(space.values[:k])


def identity_error(df: DataFrame, spaces: list[Space], components: int, vector: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> dict[int, float | None]:
    """By length: the largest absolute entry of the covariance of the whitened values minus the identity."""
    rows = usable(df.select(F.col(vector).alias("v")), "v").withColumn("id", F.lit("of the fit"))
    out: dict[int, float | None] = {}
    for space in spaces:
        k = min(components, space.varies)
        if not k:
            out[space.dim] = None
            continue
        whole, _, share = _centred(space.n, space.sums)

        def points(batch: pa.RecordBatch, space=space, whole=whole, share=share, k: int = k) -> Pair:
            w = _projected(entries(batch, 0, 1, scale, shift), space, whole, share, k)
            hi = np.column_stack([np.ones(len(w)), w])  # the first row of the products holds the sums: what their mean is off zero is taken off
            return hi, np.zeros_like(hi)

        hi, lo = products(rows.where(F.size("v") == space.dim), k + 1, points)
        g = (hi + lo) / space.n
        out[space.dim] = float(np.abs(g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) - np.eye(k)).max())
    return out


def whiten(df: DataFrame, spaces: list[Space], components: int = 8, vec_id: str = "vec_id", vector: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """The rows with a whole vector, with n, deviation (the sum of (n * x - S)^2, exact), whitened (an array, null where a component does not vary)
    and explained (an array: shares of the trace)."""
    ship(df.sparkSession)
    added = {"n": T.LongType(), "deviation": T.LongType(), "whitened": T.ArrayType(T.DoubleType()), "explained": T.ArrayType(T.DoubleType())}
    keep = [c for c in extra_columns(df, set(added)) if c not in (vec_id, vector)]
    own = usable(df.select(*keep, vec_id, vector), vector)
    ids, at = len(keep), len(keep) + 1
    schema = T.StructType([*own.schema.fields, *(T.StructField(c, t) for c, t in added.items())])
    shared = df.sparkSession.sparkContext.broadcast({s.dim: s for s in spaces})  # dim x (dim + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = {d: _centred(s.n, s.sums) for d, s in shared.value.items()}
        for batch in batches:
            lengths = np.asarray(batch.column(at).value_lengths())
            for dim in np.unique(lengths).tolist():
                some = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                space, (whole, rest, share) = shared.value[dim], centres[dim]
                x = entries(some, at, ids, scale, shift)
                far = x - whole
                if (float(np.abs(far).max()) + 1) * space.n * dim**0.5 < 2**31:  # no square and no sum of squares beyond a long
                    deviation = ((space.n * far - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    deviation = ((space.n * far.astype(object) - rest) ** 2).sum(axis=1).tolist()
                    for i, d in enumerate(deviation):
                        if d >= LONG:
                            raise ValueError(f"row {some.column(ids)[i].as_py()}: a deviation beyond a long")
                k = min(components, dim)
                w = _projected(x, space, whole, share, min(k, space.varies))
                none = [None] * (k - w.shape[1])
                told = [v / space.trace if space.trace > 0 else None for v in space.values[:k].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array([space.n] * len(x), pa.int64()), pa.array(deviation, pa.int64()), pa.array([v + none for v in w.tolist()], pa.list_(pa.float64())), pa.array([told] * len(x), pa.list_(pa.float64()))],
                    names=schema.names,
                )

    return own.mapInArrow(tidy(run), schema)


def op13_whitening(spark: SparkSession, sf_dir: str, components: int = 8) -> DataFrame:
    """Every vector on the first eight components."""
    table = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    spaces = fit(table)
    errors = identity_error(table, spaces, components)
    error = F.lit(None).cast("double")
    for dim, e in errors.items():
        error = F.when(F.size("embedding") == dim, F.lit(e)).otherwise(error)
    wide = whiten(table, spaces, components).withColumn("identity_error", error.cast("double"))
    return wide.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "one")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "one.whitened", "one.explained", "identity_error"
    )


QUERIES = {"op13_whitening": op13_whitening}
