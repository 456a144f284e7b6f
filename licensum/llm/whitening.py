"""Embedding whitening: blockwise QR of centred rows, Householder bidiagonal form, dqds, twisted factorisations."""

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from licensum.llm.common import stored

#: Entries beyond this times 1 / ``scale`` are no exact doubles any more; such vectors count as not finite.
LARGEST = 2**53
#: Triangles that one task makes into one.
MERGED = 32
EPS = float(np.finfo(np.float64).eps)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of a bidiagonal B with r = U B V', and the unit vectors of the reflections that make V."""
    a = np.array(r, np.float64)
    d = a.shape[1]
    right = []
    for i in range(d):
        u = _reflection(a[i:, i])
        a[i:, i:] -= 2 * np.outer(u, u @ a[i:, i:])
        if i < d - 1:
            v = _reflection(a[i, i + 1 :])
            a[i:, i + 1 :] -= 2 * np.outer(a[i:, i + 1 :] @ v, v)
            right.append(v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _reflection(x: np.ndarray) -> np.ndarray:
    """The unit vector u for which x - 2 u (u . x) has only its first entry."""
    top = np.abs(x).max(initial=0.0)
    if top == 0:
        return np.zeros_like(x)
    u = x / top
    u[0] += np.copysign(np.linalg.norm(u), u[0])
    return u / np.linalg.norm(u)


def squares(q: np.ndarray, e: np.ndarray) -> list[float]:
    """The squared singular values of a bidiagonal matrix, falling; q and e are the squares of its diagonals.

    Differential qd steps with shifts: none ever subtracts, except the shift, so small values keep their relative accuracy. A
    shift that would make an entry negative is taken back and quartered. A part ends where an entry of e is negligible.
    """
    found: list[float] = []
    parts = [(list(map(float, q)), list(map(float, e)), 0.0)]
    while parts:
        q, e, moved = parts.pop()
        shift, failed = 0.0, 0
        while q:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (moved + q[i]) or e[i] <= EPS * EPS * q[i + 1]), None)
            if len(q) == 1:
                found.append(max(q[0] + moved, 0.0))
                break
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], moved))
                q, e, shift = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            done = _qd_step(q, e, shift)
            if done is None:
                failed += 1
                shift = shift / 4 if failed < 4 else 0.0
                continue
            q, e, least = done
            moved, failed = moved + shift, 0
            # The smaller value of the last two rows is an estimate from above, the least pivot one of what may be taken.
            half, product = (q[-2] + e[-1] + q[-1]) / 2, q[-2] * q[-1]
            low = product / (half + max(half * half - product, 0.0) ** 0.5) if product > 0 else 0.0
            shift = min(low, least) * (1 - 4 * EPS) if least > 0 else 0.0
    return sorted(found, reverse=True)


def _qd_step(q: list[float], e: list[float], shift: float):
    """The next q and e and the least pivot; None if the shift is too large."""
    d = least = q[0] - shift
    new_q, new_e = [], []
    for i, x in enumerate(e):
        if d < 0:
            return None
        pivot = d + x
        new_q.append(pivot)
        ratio = q[i + 1] / pivot if pivot > 0 else 0.0
        new_e.append(x * ratio)
        d = (d * ratio if pivot > 0 else q[i + 1]) - shift
        least = min(least, d)
    if d < 0:
        return None
    return [*new_q, d], new_e, least


class Twisted:
    """Factorisations of B'B - value from the top and from the bottom that meet in the row where they agree best."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float):
        d, tiny = len(a), EPS * EPS * (float(np.abs(a).max(initial=0.0)) + 1e-290)
        a = np.where(np.abs(a) < tiny, tiny, a)
        square, low = a * a, b / a[:-1]
        self.down, self.pivots, s = np.zeros(d), np.zeros(d), np.zeros(d)
        s[0] = -value
        for i in range(d):
            self.pivots[i] = self._safe(s[i] + square[i], value)
            if i < d - 1:
                self.down[i] = square[i] * low[i] / self.pivots[i]
                s[i + 1] = self.down[i] * low[i] * s[i] - value
        self.up, self.below, p = np.zeros(d), np.zeros(d), np.zeros(d)
        p[-1] = square[-1] - value
        for i in range(d - 2, -1, -1):
            self.below[i + 1] = self._safe(square[i] * low[i] ** 2 + p[i + 1], value)
            ratio = square[i] / self.below[i + 1]
            self.up[i], p[i] = low[i] * ratio, p[i + 1] * ratio - value
        gamma = s + p + value
        self.at = int(np.argmin(np.abs(gamma)))
        self.meet = self._safe(gamma[self.at], value)

    @staticmethod
    def _safe(x: float, value: float) -> float:
        least = EPS * EPS * abs(value) + 1e-290
        return x if abs(x) > least else least

    def vector(self) -> np.ndarray:
        """What solves all rows of (B'B - value) z = 0 but the one where the factorisations meet."""
        z = np.zeros(len(self.down))
        z[self.at] = 1
        return self._spread(z)

    def _spread(self, z: np.ndarray) -> np.ndarray:
        for i in range(self.at - 1, -1, -1):
            z[i] -= self.down[i] * z[i + 1]
        for i in range(self.at, len(z) - 1):
            z[i + 1] -= self.up[i] * z[i]
        return z / np.linalg.norm(z)

    def solve(self, y: np.ndarray) -> np.ndarray:
        """The direction of the z with (B'B - value) z = y."""
        y = y.copy()
        for i in range(self.at):
            y[i + 1] -= self.down[i] * y[i]
        for i in range(len(y) - 1, self.at, -1):
            y[i - 1] -= self.up[i - 1] * y[i]
        pivots = np.concatenate([self.pivots[: self.at], [self.meet], self.below[self.at + 1 :]])
        return self._spread(y / pivots)


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` largest eigenvalues of r'r that are not nought in double precision, and their unit vectors (columns).

    The entry of a vector that is largest by amount is positive. Vectors of values that lie close together are made
    orthogonal to each other between steps of inverse iteration, so equal values give some orthogonal basis.
    """
    d = r.shape[1]
    top = float(np.abs(r).max(initial=0.0))
    if top == 0:
        return np.zeros(0), np.zeros((d, 0))
    a, b, right = bidiagonal(r / top)
    values = squares(a * a, b * b)
    values = [v for v in values[:most] if v > (EPS * d) ** 2 * values[0]]
    out: list[np.ndarray] = []
    for i, value in enumerate(values):
        near = [out[j] for j in range(i) if values[j] - value < 1e-3 * values[j]]
        if not near:
            out.append(Twisted(a, b, value).vector())
            continue
        # A little beside the value, so that all directions of equal values grow alike.
        twisted, z = Twisted(a, b, value * (1 - 16 * EPS)), np.random.default_rng(i).standard_normal(d)
        for step in range(6):
            z = z if step == 0 else twisted.solve(z)
            for other in near * 2:
                z = z - other * (other @ z)
            z /= np.linalg.norm(z)
        out.append(z)
    vectors = np.array(out).T
    for i in range(len(right) - 1, -1, -1):
        vectors[i + 1 :] -= 2 * np.outer(right[i], right[i] @ vectors[i + 1 :])
    largest = np.abs(vectors).argmax(axis=0)
    return np.array(values) * top * top, vectors * np.sign(vectors[largest, np.arange(len(values))])


@dataclass(frozen=True)
class Fit:
    """Number and sums of the different vectors, largest amount of an entry, eigenvalues, directions, trace."""

    n: int
    sums: list[int]
    largest: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums, self.largest)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sums of the squares of n * x - sums; None beyond a long."""
        most = 2 * self.n * self.largest
        if most * most * max(len(self.sums), 1) < 2**63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        about = ((self.centred(x) * self.n) ** 2).sum(axis=1)
        return [sum((self.n * v - s) ** 2 for v, s in zip(row.tolist(), self.sums, strict=True)) if size < 2**63 * (1 - 1e-9) else None for row, size in zip(x, about, strict=True)]


def centred(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """x - sums / n, from exact integers where they fit a long."""
    if 2 * n * largest < 2**62:
        return (n * x - np.array(sums, np.int64)) / n
    return x - np.array([s / n for s in sums])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of longs as a matrix; all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _quantised(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, pa.Array]:
    """Which rows have a whole finite vector, and the entries of those as longs."""
    vectors = batch.column(batch.num_columns - 1).cast(pa.list_(pa.float64()))
    sizes = np.array([n or 0 for n in vectors.value_lengths().to_pylist()], np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False) * scale
    ends = np.cumsum(sizes)
    wrong = np.concatenate([[0], np.cumsum(~(np.abs(np.nan_to_num(flat, nan=np.inf)) < LARGEST))])
    good = (sizes > 0) & (wrong[ends] == wrong[ends - sizes])
    longs = np.floor(flat[np.repeat(good, sizes)]).astype(np.int64)
    return good, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[good])]), pa.int32()), pa.array(longs))


def _run_distinct(scale, batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([_quantised(batch, scale)[1]], ["x"])


def _run_sums(batches):
    """Sums of the upper and lower parts of the entries, so that no sum leaves a long."""
    high = low = None
    n = largest = 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            n, largest = n + len(x), max(largest, int(np.abs(x).max()))
            high = (x >> 26).sum(axis=0) + (0 if high is None else high)
            low = (x & (2**26 - 1)).sum(axis=0) + (0 if low is None else low)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([largest]), pa.array([high.tolist()]), pa.array([low.tolist()])], ["n", "largest", "high", "low"])


def _triangle(blocks):
    """The triangle of all blocks under each other."""
    r = None
    for block in blocks:
        r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["r"])


def _run_rows(n, sums, largest, batches):
    return _triangle(centred(_matrix(b.column(0)), n, sums, largest) for b in batches if b.num_rows)


def _run_triangles(d, batches):
    return _triangle(np.array(row).reshape(-1, d) for b in batches for row in b.column(0).to_pylist())


def _run_products(fit, batches):
    """Sums of the whitened rows and of their products."""
    sums = None
    for batch in batches:
        if batch.num_rows:
            w = fit.whitened(_matrix(batch.column(0)))
            own = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
            sums = own if sums is None else sums + own
    if sums is not None:
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], ["sums"])


def _run_output(fit, scale, error, batches):
    shares, most = fit.values / fit.trace, len(fit.values)
    for batch in batches:
        good, x = _quantised(batch, scale)
        rows, ids = _matrix(x), batch.column(0).filter(pa.array(good))
        w, dev = (fit.whitened(rows), fit.deviations(rows)) if len(rows) else (np.zeros((0, most)), [])
        each = np.repeat(np.arange(len(rows)), most)
        columns = [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), len(rows))), pa.array([fit.n] * len(each), pa.int64())]
        columns += [pa.array(dev, pa.int64()).take(pa.array(each)), pa.array(w.ravel()), pa.array(np.tile(shares, len(rows))), pa.array([error] * len(each), pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def _summed(rows: DataFrame, column: str, kind) -> list:
    """The sums of an array column by place; as many numbers come to the driver as an array has."""
    found = rows.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    return [kind(r.v) for r in sorted(found, key=lambda r: r.i)]


def fit(distinct: DataFrame, most: int) -> Fit | None:
    """What whitening needs to know of the different vectors (a stored frame with the array ``x``); None without any.

    Each task reduces its centred rows to one triangle, batch by batch; triangles are reduced by the dozens in tasks until one is
    left, which comes to the driver: its size is the square of the dimension and does not grow with the rows.
    """
    parts = stored(distinct.mapInArrow(_run_sums, "n long, largest long, high array<long>, low array<long>"))
    total = parts.agg(F.sum("n").alias("n"), F.max("largest").alias("largest")).first()
    if not total.n:
        return None
    sums = [(h << 26) + v for h, v in zip(_summed(parts, "high", int), _summed(parts, "low", int), strict=True)]
    schema = "r array<double>"
    triangles = stored(distinct.mapInArrow(partial(_run_rows, total.n, sums, total.largest), schema))
    while (left := triangles.count()) > 1:
        triangles = stored(triangles.coalesce(-(-left // MERGED)).mapInArrow(partial(_run_triangles, len(sums)), schema))
    r = np.array(triangles.first().r).reshape(-1, len(sums))
    r = np.vstack([r, np.zeros((len(sums) - len(r), len(sums)))])
    values, vectors = directions(r, most)
    # Squares of the entries of the triangle add up to n times the trace; the directions belong to the covariance.
    return Fit(total.n, sums, total.largest, values / total.n, vectors, float((r * r).sum()) / total.n)


def whiten(rows: DataFrame, *, most: int = 4, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row of ``rows`` and component.

    Entries c become floor(``scale`` * c). Covariances are those of the different vectors, n of them, with divisor n; a component
    is a unit eigenvector, numbered by falling eigenvalue. whitened is the centred vector along it over the root of the
    eigenvalue, explained the eigenvalue's share of the trace, deviation the exact sum of the squares of n * x - sums (NULL beyond a
    long), identity_error how far the covariance of whitened is from the identity, at most.

    Vectors that are NULL or empty or hold NULL, NaN, infinite or too large entries (2^53 / ``scale``) have no rows.
    Components without variance are left out, so a table of equal vectors gives no rows, like an empty one. Repeated
    rows count once for the covariance and are returned each. Vectors of different lengths are an error.
    """
    slim = rows.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    distinct = slim.select("v").mapInArrow(partial(_run_distinct, scale), "x array<long>").distinct()
    distinct = stored(distinct)
    lengths = distinct.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors of different lengths, {lengths[0]} to {lengths[1]}")
    found = fit(distinct, most)
    kind = rows.schema[id_column].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], schema)
    return slim.mapInArrow(partial(_run_output, found, scale, identity_error(distinct, found)), schema)


def identity_error(distinct: DataFrame, found: Fit) -> float:
    """The largest amount of an entry of the covariance of the whitened vectors minus the identity."""
    k = len(found.values)
    sums = np.array(_summed(distinct.mapInArrow(partial(_run_products, found), "sums array<double>"), "sums", float)) / found.n
    return float(np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k)).max())
