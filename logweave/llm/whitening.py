"""Whitening of embeddings by an exact eigendecomposition of their integer scatter.

Components are fixed-point integers, so n^2 times the covariance is an integer matrix and known exactly. Its characteristic
polynomial is computed modulo many primes, for each by reduction to Hessenberg form and the recurrence for its minors, and
put together by the Chinese remainder theorem. A symmetric matrix has real roots only, for which the sign changes of the
shifted polynomial's coefficients count the roots above the shift exactly (Budan and Fourier); bisection with these counts
isolates the largest roots and refines them far beyond double precision. Their null spaces come from inverse iteration in
decimal arithmetic of 160 digits.

Spark sums over the vectors (bounded by the dimension squared) and deals out the primes and the roots.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 1024
SHIFT = 100_000
LIMIT = 1 << 62
LIMB = 60
BATCH = 8192
DIGITS = 160
SAME_BITS = 200  # roots nearer than this part of the trace count as one
ROOT_BITS = 300  # precision to which a root is refined
MOST_DIMENSIONS = 2048

Ints = list[list[int]]


@dataclass(frozen=True)
class Whitener:
    """n, sums and the components of a fit; components hold (unit vector, eigenvalue, share of the trace)."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: list[float]
    explained: list[float]


# Sums over the vectors


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(LIMIT // SCALE)))), F.lit(False))
    return vectors.select("vec_id", v.alias("v")).where(fine)


def _numbers(column: pa.Array, d: int) -> np.ndarray:
    """The batch's vectors as integers, one in a row."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) * SCALE).astype(np.int64) + SHIFT


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _moments(z: np.ndarray) -> np.ndarray:
    """Sum of the rows' outer products, exactly: in doubles where all sums stay below 2^53, else in integers of any size."""
    if _largest(z) ** 2 * len(z) < 1 << 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    z = z.astype(object)
    return z.T @ z


def _exact(vectors: DataFrame, d: int, cells: int, part: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Sums over all vectors of the `cells` integers that `part` makes of a batch; each task gives one row for each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, object)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                total = total + part(_numbers(batch.column(0).slice(at, BATCH), d))
        whole = [int(v) for v in total]
        limbs = [pa.array([Decimal(v) for v in x], pa.decimal128(38, 0)) for x in ([v >> LIMB for v in whole], [v & (1 << LIMB) - 1 for v in whole])]
        yield pa.RecordBatch.from_arrays([pa.array(range(cells), pa.int32()), *limbs], ["cell", "high", "low"])

    rows = vectors.select("v").mapInArrow(run, "cell int, high decimal(38,0), low decimal(38,0)")
    out = [0] * cells
    for r in rows.groupBy("cell").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        out[r.cell] = (int(r.high) << LIMB) + int(r.low)
    return out


def scatter(vectors: DataFrame, d: int) -> tuple[int, list[int], Ints]:
    """n, sums and n^2 times the covariance of the vectors' integers; they are centred at the rounded means before multiplying."""
    *sums, n = _exact(vectors, d, d + 1, lambda x: np.append(x.astype(object).sum(0), len(x)))
    if not n:
        return 0, sums, []
    centre = [round(Fraction(s, n)) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    upper = np.triu_indices(d)
    flat = _exact(vectors, d, len(upper[0]), lambda x: _moments(x - np.array(centre, np.int64))[upper])
    m = [[0] * d for _ in range(d)]
    for i, j, v in zip(*(u.tolist() for u in upper), flat, strict=True):
        m[i][j] = m[j][i] = n * v - rest[i] * rest[j]
    return n, sums, m


# The characteristic polynomial


def _primes(product: int) -> list[int]:
    """Primes below 2^31 in falling order until their product exceeds `product`."""
    out, p, known = [], (1 << 31) + 1, 1
    while known <= product:
        p -= 2
        if all(p % q for q in (3, 5, 7, 11, 13)) and all(_strong(p, a) for a in (2, 3, 5, 7)):
            out.append(p)
            known *= p
    return out


def _strong(p: int, a: int) -> bool:
    """Whether p passes the strong test to base a; the bases 2, 3, 5 and 7 leave no composite below 3 215 031 751."""
    odd = p - 1
    twos = (odd & -odd).bit_length() - 1
    x = pow(a, odd >> twos, p)
    return x in (1, p - 1) or any((x := x * x % p) == p - 1 for _ in range(twos - 1))


def hessenberg(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Similar matrices of Hessenberg form; a holds one matrix for each prime of p."""
    a, d, each = a.copy(), a.shape[1], np.arange(len(p))
    q, r = p[:, None], p[:, None, None]
    for k in range(1, d - 1):
        at = k + (a[:, k:, k - 1] != 0).argmax(1)  # a pivot other than 0, each modulus its own
        a[each, at], a[each, k] = a[each, k], a[each, at]
        a[each, :, at], a[each, :, k] = a[each, :, k], a[each, :, at]
        inverse = np.array([pow(int(x), -1, int(m)) if x else 0 for x, m in zip(a[:, k, k - 1], p, strict=True)], np.int64)
        u = a[:, k + 1 :, k - 1] * inverse[:, None] % q
        a[:, k + 1 :] = (a[:, k + 1 :] - u[:, :, None] * a[:, k, None] % r) % r
        a[:, :, k] = (a[:, :, k] + (a[:, :, k + 1 :] * u[:, None] % r).sum(2)) % q
    return a


def minors(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients, lowest first, of the characteristic polynomial of each Hessenberg matrix."""
    d, q = h.shape[1], p[:, None]
    poly = np.zeros((d + 1, len(p), d + 1), np.int64)
    poly[0, :, 0] = 1
    for k in range(d):
        new = np.zeros((len(p), d + 1), np.int64)
        new[:, 1:] = poly[k, :, :-1]
        new = (new - h[:, k, k, None] * poly[k]) % q
        below = np.ones(len(p), np.int64)
        for i in range(k - 1, -1, -1):
            below = below * h[:, i + 1, i] % p
            new = (new - (h[:, i, k] * below % p)[:, None] * poly[i]) % q
        poly[k + 1] = new
    return poly[d]


def _modular(m: Ints, primes: list[int]) -> np.ndarray:
    p, whole = np.array(primes, np.int64), np.array(m, object)
    return minors(hessenberg(np.stack([(whole % q).astype(np.int64) for q in primes]), p), p)


def characteristic(spark: SparkSession, m: Ints) -> list[int]:
    """Integer coefficients, lowest first, of det(x - m) for a symmetric m without negative roots; primes are dealt over tasks."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))  # Maclaurin: none is larger
    primes = _primes(2 * bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            for at in range(0, len(own), 16):
                part = own[at : at + 16]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(_modular(m, part).tolist(), pa.list_(pa.int64()))], ["p", "residues"])

    tasks = max(1, min(len(primes) // 8, spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    product = math.prod(primes)
    out = [0] * (d + 1)
    for r in dealt.mapInArrow(run, "p long, residues array<bigint>").collect():
        rest = product // r.p
        unit = rest * pow(rest, -1, r.p)
        out = [o + unit * x for o, x in zip(out, r.residues, strict=True)]
    return [(o + product // 2) % product - product // 2 for o in out]


# Its largest roots


class Roots:
    """Roots of a polynomial that are all real, by exact counts."""

    def __init__(self, poly: list[int]) -> None:
        self.poly = poly

    def _scaled(self, bits: int) -> list[int]:
        """Coefficients of the polynomial whose roots are 2^bits times as large."""
        d = len(self.poly) - 1
        return [c << bits * (d - i) for i, c in enumerate(self.poly)]

    def above(self, at: int, bits: int) -> int:
        """How many roots, each as often as it occurs, are above at / 2^bits."""
        c = self._scaled(bits)
        for i in range(len(c) - 1):
            for j in range(len(c) - 2, i - 1, -1):
                c[j] += at * c[j + 1]
        signs = [x > 0 for x in c if x]
        return sum(a != b for a, b in zip(signs, signs[1:], strict=False))

    def sign(self, at: int, bits: int) -> int:
        """Sign of the polynomial at at / 2^bits."""
        value = 0
        for i, c in enumerate(self.poly[::-1]):
            value = value * at + (c << bits * i)
        return (value > 0) - (value < 0)

    def largest(self, wanted: int, most: int) -> list[tuple[Fraction, int]]:
        """The largest positive roots and how often they occur, until `wanted` are found; none is above `most`."""
        top = max(1, most).bit_length()
        wanted = min(wanted, self.above(0, 0))
        found: list[tuple[Fraction, int]] = []
        have = 0
        # (low, high, bits, roots above low, roots above high): roots in (low, high] / 2^bits; the highest is on top.
        stack = [(0, 1 << top, 0, self.above(0, 0), 0)]
        while stack and have < wanted:
            low, high, bits, n_low, n_high = stack.pop()
            n = n_low - n_high
            if not n:
                continue
            if n == 1 and low:
                found.append((self._refined(low, high, bits), 1))
                have += 1
            elif high - low == 1 and bits >= SAME_BITS - top and low and low.bit_length() > SAME_BITS:
                found.append((Fraction(2 * low + 1, 2 << bits), n))
                have += n
            else:
                if high - low == 1:
                    low, high, bits = 2 * low, 2 * high, bits + 1
                middle = (low + high) // 2
                n_middle = self.above(middle, bits)
                stack += [(low, middle, bits, n_low, n_middle), (middle, high, bits, n_middle, n_high)]
        return found

    def _refined(self, low: int, high: int, bits: int) -> Fraction:
        """The only root in (low, high] / 2^bits to a relative 2^-ROOT_BITS; between its ends the sign changes once."""
        if not (end := self.sign(high, bits)):
            return Fraction(high, 1 << bits)
        while high - low > 1 or low.bit_length() <= ROOT_BITS:
            if high - low == 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            s = self.sign(middle, bits)
            if not s:
                return Fraction(middle, 1 << bits)
            low, high = (low, middle) if s == end else (middle, high)
        return Fraction(2 * low + 1, 2 << bits)


# Their null spaces


def null_space(m: Ints, root: Fraction, size: int) -> np.ndarray:
    """`size` orthonormal vectors, one in a row, of m's null space at this root, by inverse iteration."""
    d = len(m)
    with localcontext() as c:
        c.prec, c.Emin, c.Emax = DIGITS, -999_999, 999_999
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        a = np.array([[Decimal(v) - (shift if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(m)], object)
        tiny = max(abs(v) for v in a.flat) * Decimal(10) ** (10 - DIGITS) + Decimal(10) ** -DIGITS
        order = np.arange(d)
        for k in range(d):
            at = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            a[[k, at]], order[[k, at]] = a[[at, k]], order[[at, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            for i in range(k + 1, d):
                a[i, k] /= a[k, k]
                a[i, k + 1 :] -= a[i, k] * a[k, k + 1 :]
        random = np.random.default_rng(d)
        basis = [np.array([Decimal(int(v)) for v in random.integers(-999, 1000, d)], object) for _ in range(size)]
        for _ in range(3):
            solved: list[np.ndarray] = []
            for b in basis:
                x = b[order]
                for i in range(d):
                    x[i] -= (a[i, :i] * x[:i]).sum() if i else 0
                for i in range(d - 1, -1, -1):
                    x[i] = (x[i] - ((a[i, i + 1 :] * x[i + 1 :]).sum() if i < d - 1 else 0)) / a[i, i]
                x = x / max(abs(v) for v in x)
                for _ in range(2):
                    for y in solved:
                        x = x - (x * y).sum() * y
                solved.append(x / (x * x).sum().sqrt())
            basis = solved
        return np.array([[float(v) for v in x] for x in basis])


def _vectors(spark: SparkSession, m: Ints, roots: list[tuple[Fraction, int]]) -> np.ndarray:
    """Unit eigenvectors in the order of the roots, a root to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, above, below, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = null_space(m, Fraction(int(above), int(below)), size)
                yield pa.RecordBatch.from_arrays([pa.array([k] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(found.tolist(), pa.list_(pa.float64()))], ["k", "i", "v"])

    rows = [(k, str(r.numerator), str(r.denominator), size) for k, (r, size) in enumerate(roots)]
    dealt = spark.createDataFrame(rows, "k int, above string, below string, size int").repartition(len(rows))
    return np.array([r.v for r in sorted(dealt.mapInArrow(run, "k int, i int, v array<double>").collect(), key=lambda r: (r.k, r.i))])


# The operator


def fit(vectors: DataFrame, components: int = 8) -> Whitener | None:
    """The first `components` principal components of all usable rows of vectors (embedding); None without any.

    Usable are vectors that are not null, hold neither nulls nor non-finite numbers nor any of 2^52 or more, and have the
    commonest length (the greater of two). Components of eigenvalue 0 cannot be whitened and are left out, so there may be
    fewer. Roots closer together than 2^-200 of the trace count as one that occurs several times, for which any orthonormal
    vectors of its space serve. At most 2048 dimensions: the driver holds a matrix of them.
    """
    rows = _usable(vectors)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = length[0].d if length else 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions, at most {MOST_DIMENSIONS} are supported")
    if not d:
        return None
    n, sums, m = scatter(rows.where(F.size("v") == d), d)
    trace = sum(m[i][i] for i in range(d))
    if not trace:
        return None
    spark = vectors.sparkSession
    roots = Roots(characteristic(spark, m)).largest(components, trace)
    values = [r for r, size in roots for _ in range(size)][:components]
    found = _vectors(spark, m, roots)[: len(values)]
    return Whitener(n, sums, found, [float(v / n**2) for v in values], [float(v / trace) for v in values])


def _projected(x: np.ndarray, w: Whitener) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - sums as exact integers, whitened coordinates) of integer vectors."""
    small = (_largest(x) + 1) * w.n + max(abs(s) for s in w.sums) < 1 << 62
    y = x * w.n - np.array(w.sums, np.int64) if small else x.astype(object) * w.n - np.array(w.sums, object)
    return y, y.astype(np.float64) / w.n @ w.vectors.T / np.sqrt(np.array(w.values))


def _deviation(y: np.ndarray) -> list[int | None]:
    """Sum of each row's squares; None where it is no long."""
    if y.dtype != object and _largest(y) ** 2 * y.shape[1] < 1 << 63:
        return (y * y).sum(1).tolist()
    y = y.astype(object)
    return [v if v < 1 << 63 else None for v in (y * y).sum(1)]


def identity_error(vectors: DataFrame, w: Whitener) -> float:
    """Largest entry, without its sign, of the whitened rows' covariance less the identity, from one pass over all rows."""
    d, k = len(w.sums), len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                z = _projected(_numbers(batch.column(0).slice(at, BATCH), d), w)[1]
                total += np.append(z.sum(0), z.T @ z)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["cell", "value"])

    rows = _usable(vectors).where(F.size("v") == d).select("v").mapInArrow(run, "cell int, value double")
    total = np.zeros(k + k * k)
    for r in rows.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        total[r.cell] = r.value / w.n
    return float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row of vectors (vec_id,
    embedding; other columns are not looked at) and component, numbered from 1 by falling eigenvalue. See fit().

    deviation is the sum of squares of n * x - sums, null where that is no long. Repeated rows are fitted and returned as often
    as they occur, a null vec_id is kept. Where no component has an eigenvalue above 0 (empty table, one row, equal rows) the
    result is empty.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit(vectors, components)
    if w is None:
        return spark.createDataFrame([], schema)
    error, d, k = identity_error(vectors, w), len(w.sums), len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                y, z = _projected(_numbers(part.column(1), d), w)
                rows = np.repeat(np.arange(len(z)), k)
                columns = [
                    part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))), pa.array(np.full(len(rows), w.n)),
                    pa.array(_deviation(y), pa.int64()).take(pa.array(rows)), pa.array(z.reshape(-1)), pa.array(np.tile(w.explained, len(z))), pa.array(np.full(len(rows), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _usable(vectors).where(F.size("v") == d).mapInArrow(run, schema)
