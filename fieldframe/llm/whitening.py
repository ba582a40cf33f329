"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

Entries become integers, so n times the sum of products less the product of sums is an integer
matrix M, n * n times the covariance, summed exactly by Spark. Its characteristic polynomial comes
from Hessenberg reductions modulo many primes and the Chinese remainder theorem. All its roots are
real and not negative, so the sign changes of the polynomial shifted to a point count the roots
above the point exactly, with multiplicity, and bisection isolates them; each is then narrowed by
exact signs. Components span the null spaces of M less each root, by inverse iteration with
decimals of many digits. What the driver holds grows with the dimensions alone.
"""

from __future__ import annotations

import decimal
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.llm.batches import common_width

SCALE, SHIFT = 64, 1_000_000
#: Most components; bits of a root beyond the largest one's; digits and rounds of inverse iteration.
COMPONENTS, ROOT_BITS, DIGITS, ROUNDS = 32, 192, 160, 4
#: Products of rows whose entries are smaller are exact as doubles, in so many rows at a time.
SMALL, ROWS = 1 << 20, 1 << 12
LIMB = 40
LONG = 1 << 63


def grid(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(floor(SCALE * entry) as int64, row numbers) of the vectors that take part.

    A vector takes part if it has ``width`` entries, none null, all finite and within 62 bits on
    the grid; a zero vector does.
    """
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) == width) if width else np.zeros(0, np.int64)
    if not len(rows):
        return np.zeros((0, width), np.int64), rows
    flat = pc.fill_null(column.take(pa.array(rows)).flatten().cast(pa.float64()), float("nan"))
    scaled = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).reshape(len(rows), width))
    good = (np.abs(scaled) < float(1 << 62)).all(axis=1)
    return scaled[good].astype(np.int64), rows[good]


def _moments(width: int, vector: str):
    """Exact count, sums and sums of products of a task's vectors, cut into limbs: (i, j, limb, value)."""
    def summed(batches):
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            values, _ = grid(batch.column(vector), width)
            small = (np.abs(values) < SMALL).all(axis=1)
            n += len(values)
            for at in range(0, len(values), ROWS):
                part, fits = values[at:at + ROWS], small[at:at + ROWS]
                exact = part[fits].astype(np.float64)
                sums = sums + exact.sum(axis=0).astype(np.int64).astype(object)
                products = products + (exact.T @ exact).astype(np.int64).astype(object)
                if not fits.all():
                    wide = part[~fits].astype(object)
                    sums, products = sums + wide.sum(axis=0), products + wide.T @ wide
        found = [(-1, -1, n), *((i, -1, s) for i, s in enumerate(sums)), *((i, j, products[i, j]) for i in range(width) for j in range(i, width))]
        rows = []
        for i, j, value in found:
            value, limb = int(value), 0
            sign, value = (-1, -value) if value < 0 else (1, value)
            while value:
                rows.append((i, j, limb, sign * (value & (1 << LIMB) - 1)))
                value, limb = value >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "limb", "value"])
    return summed


@dataclass
class Moments:
    """Exact moments of the vectors on the grid."""

    n: int
    sums: list[int]
    matrix: list[list[int]]  # n * sum of products - product of sums


def moments(df: DataFrame, vector: str, width: int) -> Moments:
    """At most (width + 1) * (width + 2) / 2 sums, of a few limbs each, reach the driver."""
    parts = df.select(vector).mapInArrow(_moments(width, vector), "i int, j int, limb int, value long")
    total: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect():
        total[r.i, r.j] = total.get((r.i, r.j), 0) + (r.value << LIMB * r.limb)
    n, sums = total.get((-1, -1), 0), [total.get((i, -1), 0) for i in range(width)]
    matrix = [[n * total.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    return Moments(n, sums, matrix)


def primes(bits: int) -> list[int]:
    """The largest primes below 2**31 whose product has more than so many bits."""
    def prime(n: int) -> bool:
        d, r = n - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for a in (2, 3, 5, 7):  # enough below 3.2e9
            x = pow(a, d, n)
            if x in (1, n - 1):
                continue
            for _ in range(r - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
        return True

    out, have, n = [], 0.0, (1 << 31) - 1
    while have <= bits:
        if prime(n):
            out.append(n)
            have += math.log2(n) - 1e-6
        n -= 2
    return out


def polynomials_modulo(matrix: list[list[int]], mods: np.ndarray) -> np.ndarray:
    """Coefficients, lowest first, of det(x - matrix) modulo each prime below 2**31."""
    d, many = len(matrix), len(mods)
    p = mods.astype(np.int64)
    a = np.array([[[x % int(m) for x in row] for row in matrix] for m in p], np.int64).reshape(many, d, d)
    every, p1, p2 = np.arange(many), p[:, None], p[:, None, None]
    for k in range(d - 2):
        pivot = k + 1 + np.argmax(a[:, k + 1:, k] != 0, axis=1)
        rows = a[every, pivot].copy()
        a[every, pivot], a[:, k + 1] = a[:, k + 1].copy(), rows
        columns = a[every, :, pivot].copy()
        a[every, :, pivot], a[:, :, k + 1] = a[:, :, k + 1].copy(), columns
        # a column without a pivot is reduced already: its factors are all zero
        inverse = np.array([pow(int(x), -1, int(m)) if x else 0 for x, m in zip(a[:, k + 1, k], p)], np.int64)
        factor = a[:, k + 2:, k] * inverse[:, None] % p1
        a[:, k + 2:] = (a[:, k + 2:] - factor[:, :, None] * a[:, None, k + 1] % p2) % p2
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2:] * factor[:, None, :] % p2).sum(axis=2)) % p1
    poly = np.zeros((many, d + 1, d + 1), np.int64)
    poly[:, 0, 0] = 1
    for k in range(1, d + 1):
        poly[:, k, 1:] = poly[:, k - 1, :-1]
        poly[:, k] = (poly[:, k] - a[:, k - 1, k - 1, None] * poly[:, k - 1] % p1) % p1
        below = np.ones(many, np.int64)
        for i in range(k - 1, 0, -1):
            below = below * a[:, i, i - 1] % p
            poly[:, k] = (poly[:, k] - (a[:, i - 1, k - 1] * below % p)[:, None] * poly[:, i - 1] % p1) % p1
    return poly[:, d]


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients, lowest first, of det(x - matrix), matrix symmetric without negative eigenvalues."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # a sum of products of k roots is largest where all roots are equal
    bound = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    mods = primes(bound.bit_length() + 2)

    def reduced(batches):
        for batch in batches:
            found = polynomials_modulo(matrix, batch.column("p").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(list(found), pa.list_(pa.int64()))], ["p", "rest"])

    tasks = min(len(mods), 4 * spark.sparkContext.defaultParallelism)
    rests = spark.createDataFrame([(p,) for p in mods], "p long").repartition(tasks).mapInArrow(reduced, "p long, rest array<long>").collect()
    product = math.prod(mods)
    out = [0] * (d + 1)
    for r in rests:
        cofactor = product // r.p
        weight = cofactor * pow(cofactor, -1, r.p)
        for k, x in enumerate(r.rest):
            out[k] += x * weight
    return [x % product if 2 * (x % product) <= product else x % product - product for x in out]


def above(poly: list[int], a: int, f: int) -> int:
    """Number of roots above a / 2**f, with multiplicity, of a polynomial with real roots only."""
    d = len(poly) - 1
    shifted = [c << f * (d - k) for k, c in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            shifted[k] += a * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def sign(poly: list[int], a: int, f: int) -> int:
    """Sign of the polynomial at a / 2**f."""
    value = 0
    for steps, c in enumerate(reversed(poly)):
        value = value * a + (c << f * steps)
    return (value > 0) - (value < 0)


def isolate(poly: list[int]) -> list[tuple[int, int, int]]:
    """(a, f, m), largest first: m positive roots in (a, a + 1] / 2**f; with m > 1 they agree to the last bit kept."""
    zeros = next(k for k, c in enumerate(poly) if c)
    poly = poly[zeros:]
    top = max(abs(c) for c in poly).bit_length() // max(1, len(poly) - 1) + 1
    while above(poly, 1 << top, 0):
        top += 1
    out: list[tuple[int, int, int]] = []
    work = [(0, -top, len(poly) - 1, 0)] if len(poly) > 1 else []
    while work:
        a, f, low, high = work.pop()  # roots above a and above a + 1
        if low == high:
            continue
        if f >= 0 and low - high == 1 or f >= max(0, ROOT_BITS - top):
            out.append((a, f, low - high))
            continue
        middle = above(poly, 2 * a + 1, f + 1) if f >= 0 else above(poly, (2 * a + 1) << -f - 1, 0)
        work += [(2 * a, f + 1, low, middle), (2 * a + 1, f + 1, middle, high)]
    return out


def narrow(poly: list[int], a: int, f: int, bits: int) -> tuple[int, int]:
    """The single root in (a, a + 1] / 2**f as (a, f) with f of at least ``bits``, by exact signs."""
    zeros = next(k for k, c in enumerate(poly) if c)
    poly = poly[zeros:]
    while f < bits:
        end = sign(poly, a + 1, f)
        if not end:
            return (a + 1) << bits - f, bits
        middle = sign(poly, 2 * a + 1, f + 1)
        a, f = (2 * a + 1 if middle * end < 0 else 2 * a), f + 1
    return a, f


def null_space(matrix: list[list[int]], root: Decimal, many: int) -> list[list[float]]:
    """``many`` orthogonal unit vectors that the matrix stretches by ``root``, by inverse iteration."""
    with decimal.localcontext() as context:
        context.prec = DIGITS
        d = len(matrix)
        a = np.array([[Decimal(x) for x in row] for row in matrix], object)
        a[range(d), range(d)] -= root
        tiny = max(Decimal(1), root) * Decimal(10) ** (20 - DIGITS)
        order = []
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(a[i, k]))
            order.append(best)
            a[[k, best]] = a[[best, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            for i in range(k + 1, d):
                if a[i, k]:
                    a[i, k] /= a[k, k]
                    a[i, k + 1:] -= a[i, k] * a[k, k + 1:]
        draw = random.Random(d)
        vectors = [np.array([Decimal(draw.gauss(0, 1)) for _ in range(d)], object) for _ in range(many)]
        for _ in range(ROUNDS):
            solved: list[np.ndarray] = []
            for x in vectors:
                x = x.copy()
                for k, best in enumerate(order):
                    x[[k, best]] = x[[best, k]]
                for k in range(d):
                    x[k + 1:] -= a[k + 1:, k] * x[k]
                for k in range(d - 1, -1, -1):
                    x[k] /= a[k, k]
                    x[:k] -= a[:k, k] * x[k]
                for _ in range(2):
                    for y in solved:
                        x = x - y * (x @ y)
                    x = x / (x @ x).sqrt()
                solved.append(x)
            vectors = solved
        out = []
        for x in vectors:
            top = max(range(d), key=lambda i: abs(x[i]))
            out.append([float(v if x[top] > 0 else -v) for v in x])
        return out


@dataclass
class Components:
    """Unit eigenvectors of the covariance as columns, by falling eigenvalue, and their shares of its trace."""

    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray


def components(spark: SparkSession, found: Moments, most: int = COMPONENTS) -> Components:
    """Components with positive eigenvalues, ``most`` at most; one task per root computes its vectors."""
    d = len(found.sums)
    trace = sum(found.matrix[i][i] for i in range(d))
    if not trace:
        return Components(np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    common = math.gcd(*(x for row in found.matrix for x in row))
    matrix = [[x // common for x in row] for row in found.matrix]
    poly = characteristic(spark, matrix)
    wanted, have = [], 0
    for number, (a, f, m) in enumerate(isolate(poly)):
        if have < most:
            wanted.append((number, str(a), f, m))
        have += m

    def solved(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, f = int(r["a"]), r["f"]
                if r["m"] == 1:
                    a, f = narrow(poly, a, f, max(f, ROOT_BITS - (trace // common).bit_length()) + 64)
                with decimal.localcontext() as context:
                    context.prec = DIGITS
                    root = (Decimal(a) + Decimal("0.5")) / Decimal(1 << f)
                rows += [(r["number"], k, str(root), v) for k, v in enumerate(null_space(matrix, root, r["m"]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()),
                                              pa.array([r[3] for r in rows], pa.list_(pa.float64()))], ["number", "k", "root", "vector"])

    tasks = spark.createDataFrame(wanted, "number int, a string, f int, m int").repartition(len(wanted), "number")
    rows = sorted(tasks.mapInArrow(solved, "number int, k int, root string, vector array<double>").collect(), key=lambda r: (r.number, r.k))[:most]
    with decimal.localcontext() as context:
        context.prec = DIGITS
        roots = [Decimal(r.root) * common for r in rows]
        return Components(np.array([r.vector for r in rows]).T, np.array([float(x / (found.n * found.n)) for x in roots]), np.array([float(x / trace) for x in roots]))


def _centred(values: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * value - sum, exact."""
    bound = (int(np.abs(values).max(initial=0)) + 1) * n + max(map(abs, sums.tolist()), default=0)
    if bound < LONG:
        return values * np.int64(n) - sums.astype(np.int64)
    return values.astype(object) * n - sums


def _projected(values: np.ndarray, n: int, sums: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n * value - sum, coordinates of value - mean along the scaled components)."""
    exact = _centred(values, n, sums)
    return exact, (exact / n).astype(np.float64) @ turn


def _deviations(exact: np.ndarray) -> list[int | None]:
    """Sums of squares by row, exact; null beyond a long."""
    if exact.dtype != object and int(np.abs(exact).max(initial=0)) ** 2 * max(1, exact.shape[1]) < LONG:
        return (exact * exact).sum(axis=1).tolist()
    wide = exact.astype(object)
    return [x if x < LONG else None for x in map(int, (wide * wide).sum(axis=1))]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every vector that takes part and component.

    Vectors that are null or hold null or non-finite entries take no part, nor do those whose
    length is not the most frequent one (the smaller of two), or that do not fit the grid of
    longs. Components with eigenvalue zero have no unit variance to be scaled to and are left out:
    without vectors, or with equal ones only, there are no rows. Equal eigenvalues share a space,
    and any orthogonal basis of it is returned. Rows are independent, so repeated and null keys
    give rows each. A deviation beyond a long is null.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"))
    shape = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = common_width(rows, "_vector")
    found = moments(rows, "_vector", width) if width else Moments(0, [], [])
    basis = components(spark, found, most) if found.n else Components(np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    many = len(basis.values)
    if not many:
        return spark.createDataFrame([], shape)
    turn, n, sums = basis.vectors / np.sqrt(basis.values), found.n, np.array(found.sums, object)

    def covered(batches):
        first, second = np.zeros(many), np.zeros((many, many))
        for batch in batches:
            for part in _parts(batch):
                values, _ = grid(part.column("_vector"), width)
                if len(values):
                    shown = _projected(values, n, sums, turn)[1]
                    first += shown.sum(axis=0)
                    second += shown.T @ shown
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(many, dtype=np.int32), many + 1)), pa.array(np.tile(np.arange(-1, many, dtype=np.int32), many)),
                                          pa.array(np.column_stack((first, second)).ravel())], ["i", "j", "value"])

    shares = rows.select("_vector").mapInArrow(covered, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    total = {(r.i, r.j): r.value / n for r in shares}
    # coordinates are centred on the exact mean before they are multiplied; what is left of theirs is taken off here
    error = max(abs(total[i, j] - total[i, -1] * total[j, -1] - (i == j)) for i in range(many) for j in range(many))

    def whitened(batches):
        for batch in batches:
            for part in _parts(batch):
                values, at = grid(part.column("_vector"), width)
                if not len(values):
                    continue
                exact, shown = _projected(values, n, sums, turn)
                size = len(values) * many
                each = pa.array(np.repeat(np.arange(len(values)), many))
                yield pa.RecordBatch.from_arrays([
                    part.column("_key").take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(values))),
                    pa.array(np.full(size, n, np.int64)), pa.array(_deviations(exact), pa.int64()).take(each), pa.array(shown.ravel()),
                    pa.array(np.tile(basis.shares, len(values))), pa.array(np.full(size, error)),
                ], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(whitened, shape)
