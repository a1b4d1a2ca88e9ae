"""Embedding whitening on principal components found by FEAST contour integration.

Entries become integers (floor(SCALE * c) + OFFSET), so every sum over the rows is an exact integer: counts, sums and centred
products are the same whatever the partitions, and the covariance is their correctly rounded quotient.
Its size is dimensions x dimensions whatever the data; only it reaches the driver.

FEAST: inertia counts (signs of the pivots of V - t) bracket the wanted eigenvalues and cut the spectrum in gaps into
intervals of a few eigenvalues each. For an interval, the quadrature of the resolvent along a circle around it -
one complex shifted solve a node - projects a random subspace onto the interval's eigenvectors; Rayleigh-Ritz extracts
them; the step is repeated until the residuals are at rounding. The number found must equal the inertia's count, so none is missed.

The rows are then projected where they lie, and the covariance of the projections is measured over all rows again.

Defined cases: rows whose vector is null, or has a null, NaN or infinite entry or one beyond 2**31 in size, are dropped; so are empty
vectors, and vectors of another length than the most frequent one (of lengths that tie, the larger); repeated rows and null ids count as they are; components
whose eigenvalue is zero but for rounding don't exist, so constant data give no rows; eigenvectors of equal eigenvalues are any basis; a component's largest entry
(the first of those) is positive; a deviation beyond a long is null; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import written

#: Fixed values of the integer form of an entry, and components.
SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Entries beyond it would not fit the integers.
HUGE = float(1 << 31)
#: Rows multiplied at once.
ROWS = 1 << 12
#: Quadrature nodes on the upper half circle, most eigenvalues of an interval (but for clusters), most steps, relative residual.
NODES, SLICE, STEPS, RESIDUAL = 12, 16, 60, 1e-13
SEED = 13


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all of them are finite and not huge."""
    entry = lambda c: F.coalesce(F.abs(c.cast("double")) <= HUGE, F.lit(False)) & ~F.isnan(c)
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, entry), F.lit(False))


def integers(vector: pa.Array) -> np.ndarray:
    """rows x dimensions of floor(SCALE * c) + OFFSET."""
    flat = vector.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(vector), -1) + OFFSET


def gram(c: np.ndarray) -> np.ndarray:
    """Exact products of integer rows summed up, dimensions x dimensions, as Python integers where 64 bits don't do."""
    largest = int(np.abs(c).max()) if c.size else 0
    if largest * largest * len(c) < 1 << 53:  # all sums are exact in doubles
        f = c.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    o = c.astype(object)
    return o.T @ o


def moments(rows: DataFrame) -> tuple[int, list[int]]:
    """(number, sums by dimension) of the vectors of the most frequent length."""
    schema = "size int, place int, n long, total string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            size = batch.column(0).to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                x = integers(batch.column(1).filter(pa.array(size == d)))
                own = sums.setdefault(d, [0, np.zeros(d, dtype=object)])
                own[0] += len(x)
                own[1] = own[1] + x.sum(axis=0).astype(object)
        for d, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(t) for t in total])],
                                             names=["size", "place", "n", "total"])

    parts = rows.select("size", "vector").mapInArrow(run, schema)
    summed = written(parts.groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")), "moments", narrow=True)
    most = summed.filter("place = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not most:
        return 0, []
    own = summed.filter(F.col("size") == most[0]["size"]).collect()  # a row for each dimension
    return int(most[0]["n"]), [int(r["total"]) for r in sorted(own, key=lambda r: r["place"])]


def products(rows: DataFrame, middle: np.ndarray) -> list[list[int]]:
    """Sums over all rows of the products of two entries less ``middle``."""
    dims = len(middle)
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                total = total + gram(integers(batch.column(0).slice(at, ROWS)) - middle)
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array([str(t) for t in total[upper]])], names=["i", "j", "total"])

    parts = rows.select("vector").mapInArrow(run, "i int, j int, total string")
    summed = parts.groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [[0] * dims for _ in range(dims)]
    for r in summed.collect():  # dimensions x dimensions, whatever the rows
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = int(r["total"])
    return out


def positive_count(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix: the signs of its pivots, of order one and two, fully pivoted."""
    a = a.copy()
    count = 0
    while len(a):
        n = len(a)
        d = np.abs(np.diagonal(a))
        i = int(d.argmax())
        off = np.abs(a)
        off[np.arange(n), np.arange(n)] = 0
        r, c = divmod(int(off.argmax()), n)
        if d[i] == 0 and off[r, c] == 0:
            return count
        pivot = [i] if d[i] >= 0.64 * off[r, c] else [r, c]
        rest = np.setdiff1d(np.arange(n), pivot)
        block, side = a[np.ix_(pivot, pivot)], a[np.ix_(rest, pivot)]
        # the eigenvalues of a pivot of order two have opposite signs
        count += 1 if len(pivot) == 2 else int(block[0, 0] > 0)
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return count


def above(v: np.ndarray, t: float) -> int:
    """Number of eigenvalues over t."""
    return positive_count(v - t * np.eye(len(v)))


def bracket(v: np.ndarray, m: int, top: float) -> tuple[float, float]:
    """(low, high] that holds the m-th largest eigenvalue, to about 2**-26 of ``top``, by inertia counts."""
    low, high = -top, top
    while high - low > top * 2.0 ** -26:
        mid = (low + high) / 2
        low, high = (mid, high) if above(v, mid) >= m else (low, mid)
    return low, high


def cuts(v: np.ndarray, wanted: int, top: float) -> list[tuple[float, int]]:
    """Falling points in gaps of the spectrum, with the number of eigenvalues over each; the last has ``wanted`` or more over it."""
    found: list[tuple[float, int]] = []
    done = 0
    while done < wanted:
        m = min(done + SLICE, wanted)
        while m < len(v):  # past clusters
            low, high = bracket(v, m, top)[0], bracket(v, m + 1, top)[1]
            if low > high:
                break
            m += 1
        t = (low + high) / 2 if m < len(v) else -top
        found.append((t, m))
        done = m
    return found


def feast(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of v in (low, high), rising, and their unit eigenvectors."""
    dims = len(v)
    size = min(dims, count + max(4, count // 2))
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    middle, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(0.5j * np.pi * (nodes + 1))  # of the upper half circle; the lower one gives the conjugates
    q = np.random.Generator(np.random.PCG64(SEED)).standard_normal((dims, size))
    norm = np.abs(v).sum(axis=1).max()
    best = None
    for _ in range(STEPS):
        p = np.zeros_like(q)
        for z, w in zip(turn, weights):
            p += w / 2 * (radius * z * np.linalg.solve((middle + radius * z) * np.eye(dims) - v, q)).real
        basis = np.linalg.qr(p)[0]
        ritz, s = np.linalg.eigh(basis.T @ v @ basis)
        q = basis @ s
        inside = (ritz > low) & (ritz < high)
        if inside.sum() == count:
            u, e = q[:, inside], ritz[inside]
            off = np.linalg.norm(v @ u - u * e, axis=0).max() / norm
            if best is not None and off >= best[0] / 2 and best[0] <= RESIDUAL:
                return best[1], best[2]  # at rounding: it falls no more
            if best is None or off < best[0]:
                best = off, e, u
    if best is not None and best[0] <= RESIDUAL:
        return best[1], best[2]
    raise ArithmeticError(f"the inertia counts {count} eigenvalues in ({low}, {high}); the projection didn't settle on them")


def extracted(v: np.ndarray, low: float, high: float, over: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``feast``, of an interval with ``over`` eigenvalues above it. Where a circle much wider than the gaps at its ends doesn't
    part the wanted eigenvalues from those beyond, each side of the widest gap within gets a circle of its own, and so on."""
    try:
        return feast(v, low, high, count)
    except ArithmeticError:
        places = [bracket(v, m, 1.0) for m in range(over + 1, over + count + 1)]  # falling
        parts = [(u, e) for e, u in _split(v, low, high, places)]
    q = np.linalg.qr(np.concatenate([u for u, _ in parts], axis=1))[0]  # circles by themselves leave rounding between the parts
    e, s = np.linalg.eigh(q.T @ v @ q)
    return e, q @ s


def _split(v: np.ndarray, low: float, high: float, places: list[tuple[float, float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(eigenvalues, vectors) by parts of the interval whose eigenvalues lie in ``places``."""
    gaps = [a[0] - b[1] for a, b in zip(places, places[1:])]
    least, most = places[-1][0], places[0][1]
    # no wider than its eigenvalues and the nearer end ask for
    margin = max(most - least, min(least - low, high - most))
    try:
        return [feast(v, max(low, least - margin), min(high, most + margin), len(places))]
    except ArithmeticError:
        if not gaps or max(gaps) <= 0:
            raise
    at = int(np.argmax(gaps)) + 1
    t = (places[at - 1][0] + places[at][1]) / 2
    return _split(v, t, high, places[:at]) + _split(v, low, t, places[at:])


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of up to ``most`` of the largest eigenvalues, falling, that aren't zero but for rounding."""
    top = float(np.abs(v).sum(axis=1).max()) * 1.0001  # no eigenvalue is larger
    if not top > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    unit = v / top
    wanted = min(most, above(unit, len(v) * 2.0 ** -50))
    values, vectors, high, over = [], [], 1.0, 0
    for low, m in cuts(unit, wanted, 1.0):
        e, u = extracted(unit, low, high, over, m - over)
        values.append(e[::-1])
        vectors.append(u[:, ::-1])
        high, over = low, m
    if not values:
        return np.zeros(0), np.zeros((len(v), 0))
    e, u = np.concatenate(values)[:wanted] * top, np.concatenate(vectors, axis=1)[:, :wanted]
    lead = np.abs(u).argmax(axis=0)
    return e, u * np.sign(u[lead, np.arange(wanted)])


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per remaining input row and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    valid = rows.select(rows[id_col].alias("id"), rows[vector_col].alias("vector")).filter(usable(F.col("vector"))).withColumn("size", F.size("vector"))
    n, sums = moments(valid)
    kind = dict(valid.dtypes)["id"]
    empty = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], empty)
    dims = len(sums)
    fit = valid.filter(F.col("size") == dims)
    middle = np.array([round(s / n) for s in sums], dtype=np.int64)
    cross = products(fit, middle)
    rest = [s - n * int(m) for s, m in zip(sums, middle)]  # sums of the entries less middle
    v = np.array([[(n * cross[i][j] - rest[i] * rest[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    e, u = components(v, most)
    if not len(e):
        return spark.createDataFrame([], empty)
    weights = u / np.sqrt(e)
    shift = np.array([r / n for r in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        off = np.array(rest, dtype=object)
        small = max(abs(r) for r in rest)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                c = integers(part.column(1)) - middle
                y = (c - shift) @ weights
                if (n * int(np.abs(c).max()) + small) ** 2 * dims < 1 << 63:
                    deviation = ((n * c - off.astype(np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    deviation = [d if d < 1 << 63 else None for d in ((n * c.astype(object) - off) ** 2).sum(axis=1)]
                z = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation, pa.int64()), z], names=["id", "deviation", "z"])

    placed = written(fit.select("id", "vector").mapInArrow(run, f"id {kind}, deviation long, z array<double>"), "whitened")
    error = identity_error(placed, len(e), n)
    numbers = F.array(*(F.lit(float(x)) for x in e / np.trace(v)))
    out = placed.select(F.col("id").alias(id_col), "deviation", F.posexplode("z").alias("place", "whitened"))
    return out.select(id_col, (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.element_at(numbers, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(placed: DataFrame, k: int, n: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, measured over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total += np.concatenate([y.T @ y, y.sum(axis=0)[None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["place", "total"])

    found = placed.select("z").mapInArrow(run, "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
    total = np.zeros((k + 1) * k)
    for r in found.collect():  # (components + 1) x components rows
        total[r["place"]] = r["total"]
    total = total.reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
