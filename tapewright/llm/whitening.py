"""Whitening of embeddings through the exact characteristic polynomial of their integer scatter matrix.

Components of a vector become integers, so that n times the sum of products less the product of sums is an integer matrix:
n squared times the covariance. Its characteristic polynomial is found modulo many primes, by reduction to Hessenberg
form, and put together by Chinese remainders. All its roots are real, so the sign changes of its coefficients after a
shift count the roots above a point exactly; bisection isolates them to ``BITS`` bits. Each component spans the null space of the
matrix less its root, by inverse iteration in long integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import partitions, table

STEPS = 64  # integer steps of one unit of a component
COMPONENTS = 32
BITS = 192  # of a root, relative to the trace
WORK = 384  # bits behind the point in inverse iteration
LARGE = 1 << 62  # integers of larger size are no longs any more: such vectors take no part
LIMB = 20
BLOCK = 4096  # rows that one product takes: with limbs of 20 bits its sums are exact in doubles


# --- the fit list and its exact moments


def fit_list(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and ``vector`` (array of double) of the rows that take part: no null, NaN or infinite entry, none beyond a long.

    The vectors' size is that of most rows (the smaller one at a tie); rows of another size and empty vectors go as well.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(LARGE // STEPS)))
    rows = rows.filter((F.size("vector") > 0) & whole)
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.filter(F.size("vector") == (size[0]["size"] if size else 0))


def steps_of(column: pa.Array, dims: int) -> np.ndarray:
    """floor(64 c) of each component as a long; the constant that the contract adds changes no covariance."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(STEPS * flat).astype(np.int64).reshape(-1, dims)


def products(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of columns, as Python integers."""
    dims = x.shape[1]
    total = np.zeros((dims, dims), object)
    for at in range(0, len(x), BLOCK):
        rows = x[at : at + BLOCK]
        top = int(max(rows.max(), -rows.min()))
        if top * top * len(rows) < 1 << 53:
            wide = rows.astype(np.float64)
            total += (wide.T @ wide).astype(np.int64).astype(object)
            continue
        limbs = [(rows >> LIMB * k & (1 << LIMB) - 1 if k < 3 else rows >> LIMB * k).astype(np.float64) for k in range(4)]
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return total


def moments(rows: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """Count, sums and sums of products of the whole fit list. Partitions send one row for each entry; Spark adds these up."""
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, prods = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            x = steps_of(batch.column("vector"), dims)
            if len(x):
                n += len(x)
                prods += products(x)
                sums += sum((x[at : at + BLOCK].astype(object).sum(0) if np.abs(x).max() > 1 << 40 else x[at : at + BLOCK].sum(0).astype(object)) for at in range(0, len(x), BLOCK))
        if n:
            entries = [n, *sums, *prods[upper]]
            kind = pa.decimal128(38, 0)
            high = [Decimal(int(e) >> 60) for e in entries]
            low = [Decimal(int(e) & (1 << 60) - 1) for e in entries]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(entries)), pa.int32()), pa.array(high, kind), pa.array(low, kind)], ["entry", "high", "low"]
            )

    parts = rows.select("vector").mapInArrow(run, "entry int, high decimal(38,0), low decimal(38,0)")
    got = parts.groupBy("entry").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    entries = {r.entry: (int(r.high) << 60) + int(r.low) for r in got}
    if not entries:
        return 0, [0] * dims, np.zeros((dims, dims), object)
    prods = np.zeros((dims, dims), object)
    for k, (i, j) in enumerate(zip(*upper, strict=True)):
        prods[i, j] = prods[j, i] = entries[1 + dims + k]
    return entries[0], [entries[1 + k] for k in range(dims)], prods


# --- characteristic polynomial


def is_prime(n: int) -> bool:
    """Exact below 3e9 with these four bases."""
    if n < 2 or n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if n == base or x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_below(top: int, count: int) -> list[int]:
    out, n = [], top
    while len(out) < count:
        n -= 1
        if is_prime(n):
            out.append(n)
    return out


def polynomials_mod(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients (constant first) of det(x - matrix) modulo each prime, all primes at once."""
    d, b = len(matrix), len(primes)
    p = np.array(primes, np.int64)
    p2, p3 = p[:, None], p[:, None, None]
    h = np.array([[[v % q for v in row] for row in matrix] for q in primes], np.int64)
    for k in range(d - 2):
        found = h[:, k + 1 :, k] != 0
        pivot = found.argmax(1) + k + 1
        for i in np.flatnonzero(pivot != k + 1):  # the same exchange of rows and columns
            j = pivot[i]
            h[i, [k + 1, j]] = h[i, [j, k + 1]]
            h[i, :, [k + 1, j]] = h[i, :, [j, k + 1]]
        head = h[:, k + 1, k]
        inverse = np.array([pow(int(v), -1, q) if v else 0 for v, q in zip(head, primes, strict=True)], np.int64)
        u = h[:, k + 2 :, k] * inverse[:, None] % p2
        h[:, k + 2 :, :] = (h[:, k + 2 :, :] - u[:, :, None] * h[:, k + 1, None, :] % p3) % p3
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * u[:, None, :] % p3).sum(2)) % p2
    polys = np.zeros((b, d + 1, d + 1), np.int64)
    polys[:, 0, 0] = 1
    for k in range(d):
        factors = np.zeros((b, k + 1), np.int64)
        factors[:, k] = h[:, k, k]
        chain = np.ones(b, np.int64)
        for i in range(k - 1, -1, -1):
            chain = chain * h[:, i + 1, i] % p
            factors[:, i] = h[:, i, k] * chain % p
        less = (factors[:, :, None] * polys[:, : k + 1, :] % p3).sum(1)
        polys[:, k + 1, 1:] = polys[:, k, :-1]
        polys[:, k + 1] = (polys[:, k + 1] - less) % p2
    return polys[:, d]


def characteristic(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients (constant first) of det(x - matrix) of a positive semidefinite integer matrix.

    The k-th symmetric function of its roots is at most C(d, k) (trace / d)^k, which tells how many primes are enough; one
    more proves the result. Tasks take some primes each.
    """
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_below(1 << 31, (2 * bound).bit_length() // 30 + 2)
    parts = min(len(primes), 2 * max(partitions(spark), 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for at in range(0, len(ids), 16):
                own = ids[at : at + 16]
                found = polynomials_mod(matrix, [primes[i] for i in own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array(found.tolist(), pa.list_(pa.int64()))], ["id", "residues"]
                )

    got = spark.range(0, len(primes), 1, parts).mapInArrow(run, "id long, residues array<long>").collect()
    residues = {r.id: r.residues for r in got}
    modulus, coefficients = 1, [0] * (d + 1)
    for i, q in enumerate(primes[:-1]):
        inverse = pow(modulus, -1, q)
        coefficients = [c + modulus * ((r - c) * inverse % q) for c, r in zip(coefficients, residues[i], strict=True)]
        modulus *= q
    coefficients = [c - modulus if 2 * c > modulus else c for c in coefficients]
    last = len(primes) - 1
    if [c % primes[last] for c in coefficients] != list(residues[last]):
        raise ArithmeticError("the polynomial needs more primes than its bound says: the matrix is not positive semidefinite")
    return coefficients


# --- roots


def roots_above(coefficients: list[int], point: int) -> int:
    """How many roots of a polynomial with real roots only are greater than ``point``: Descartes' rule after a shift."""
    c = list(coefficients)
    d = len(c) - 1
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += point * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(coefficients: list[int], trace: int, count: int, bits: int = BITS) -> tuple[list[int], int]:
    """The ``count`` largest positive roots by falling size, each as the least integer at or above root * 2^shift, and shift.

    The grid has ``bits`` bits below the trace. Roots that share a cell of the grid come out equal.
    """
    zeros = next(i for i, c in enumerate(coefficients) if c)
    own = coefficients[zeros:]
    d = len(own) - 1
    shift = max(0, bits - trace.bit_length())
    scaled = [c << shift * (d - k) for k, c in enumerate(own)]

    def sign(point: int) -> int:
        value = 0
        for c in reversed(scaled):
            value = value * point + c
        return (value > 0) - (value < 0)

    found: list[int] = []
    # (low, high, roots above low, roots above high): the roots between are those in (low, high], the highest range first.
    open_ranges = [(0, trace << shift, d, 0)]
    while open_ranges and len(found) < min(count, d):
        low, high, above_low, above_high = open_ranges.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if high - low == 1:
            found += [high] * inside
            continue
        middle = (low + high) // 2
        if inside == 1:  # the sign tells on which side of the middle the root lies
            s = sign(middle)
            beyond = s != 0 and s == (-1) ** (above_high + 1)
            open_ranges.append((middle, high, above_low, above_high) if beyond else (low, middle, above_low, above_high))
            continue
        above = roots_above(scaled, middle)
        open_ranges += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return found[:count], shift


# --- components


def null_vectors(matrix: list[list[int]], count: int, work: int = WORK) -> list[list[int]]:
    """``count`` orthonormal vectors (as integers over 2^work) that a nearly singular symmetric matrix maps nearest to zero.

    Inverse iteration: one elimination with row exchanges in fixed point, then three solutions, orthonormalised each time.
    """
    d = len(matrix)
    one = 1 << work
    top = max(abs(v) for row in matrix for v in row) or 1
    a = np.array([[(v << work) // top for v in row] for row in matrix], object)
    order, factors = list(range(d)), np.zeros((d, d), object)
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        if best != k:
            a[[k, best]], factors[[k, best]] = a[[best, k]], factors[[best, k]]
            order[k], order[best] = order[best], order[k]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < d:
            m = (a[k + 1 :, k] << work) // a[k, k]
            factors[k + 1 :, k] = m
            a[k + 1 :, k:] -= m[:, None] * a[k, k:][None, :] >> work

    def solved(v: list[int]) -> list[int]:
        y = [v[i] for i in order]
        for k in range(d):
            y[k] -= sum((factors[k, j] * y[j] >> work for j in range(k)), 0)
        for k in range(d - 1, -1, -1):
            rest = y[k] - sum((a[k, j] * y[j] >> work for j in range(k + 1, d)), 0)
            y[k] = (rest << work) // a[k, k]
        return y

    def orthonormal(vectors: list[list[int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for v in vectors:
            size = max(abs(x) for x in v) or 1
            v = [(x << work) // size for x in v]
            for _ in range(2):
                for u in out:
                    dot = sum(x * y for x, y in zip(u, v, strict=True)) >> work
                    v = [x - (dot * y >> work) for x, y in zip(v, u, strict=True)]
                norm = math.isqrt(sum(x * x for x in v)) or 1
                v = [(x << work) // norm for x in v]
            out.append(v)
        return out

    # Different powers of a fixed generator: no start vector is likely to miss a component.
    vectors = [[one * (pow(7, (i + 1) * (c + 2), 10007) - 5003) // 5003 for i in range(d)] for c in range(count)]
    for _ in range(3):
        vectors = orthonormal([solved(v) for v in vectors])
    return vectors


@dataclass
class Whitening:
    """What the fit list gives: count, sums of the integer vectors, eigenvalues and unit eigenvectors of their covariance."""

    n: int
    sums: list[int]
    values: list[float] = field(default_factory=list)
    vectors: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))  # one row for each component
    explained: list[float] = field(default_factory=list)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Whitening of ``rows`` (``key`` and ``vector`` as from ``fit_list``). The driver sees sums, polynomial and components only."""
    spark = rows.sparkSession
    first = rows.select(F.size("vector").alias("size")).first()
    dims = first["size"] if first else 0
    n, sums, prods = moments(rows, dims)
    scatter = [[int(n * prods[i, j] - sums[i] * sums[j]) for j in range(dims)] for i in range(dims)]
    trace = sum(scatter[i][i] for i in range(dims))
    if not trace:
        return Whitening(n, sums)
    common = math.gcd(*(v for row in scatter for v in row))
    small = [[v // common for v in row] for row in scatter]
    roots, shift = largest_roots(characteristic(spark, small), trace // common, components)
    groups = [(k, roots.count(k)) for k in dict.fromkeys(roots)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                root, times = groups[i]
                shifted = [[(v << shift) - (root if r == c else 0) for c, v in enumerate(row)] for r, row in enumerate(small)]
                found = [[x / (1 << WORK) for x in v] for v in null_vectors(shifted, times)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * times, pa.int64()), pa.array(range(times), pa.int32()), pa.array(found, pa.list_(pa.float64()))],
                    ["id", "turn", "vector"],
                )

    got = spark.range(0, len(groups), 1, len(groups)).mapInArrow(run, "id long, turn int, vector array<double>").collect()
    vectors = np.array([r.vector for r in sorted(got, key=lambda r: (r.id, r.turn))])
    largest = np.abs(vectors).argmax(1)
    vectors *= np.sign(vectors[np.arange(len(vectors)), largest])[:, None]
    values = [root * common / (n * n << shift) for root in roots]
    return Whitening(n, sums, values, vectors, [root * common / (trace << shift) for root in roots])


# --- whitened rows


def centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n x - S, exact: as longs where these hold them and their squares' sums, else as Python integers."""
    top = model.n * int(max(x.max(), -x.min())) + max(map(abs, model.sums))
    if top * top * x.shape[1] < 1 << 62:
        return model.n * x - np.array(model.sums, np.int64)
    return model.n * x.astype(object) - np.array(model.sums, object)


def projected(c: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened values of centred rows, one column for each component."""
    wide = (c / model.n).astype(np.float64)
    return wide @ model.vectors.T / np.sqrt(np.array(model.values))


def _added(rows: DataFrame, model: Whitening, size: int, entries) -> np.ndarray:
    """Sums over all rows of ``entries(whitened rows)``; partitions send one row for each entry."""
    dims = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += entries(projected(centred(steps_of(batch.column("vector"), dims), model), model))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["entry", "value"])

    got = rows.select("vector").mapInArrow(run, "entry int, value double").groupBy("entry").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for r in got:
        out[r.entry] = r.value
    return out


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on all of them."""
    k = len(model.values)
    if not k:
        return 0.0
    mean = _added(rows, model, k, lambda w: w.sum(0)) / model.n
    covariance = _added(rows, model, k * k, lambda w: ((w - mean).T @ (w - mean)).ravel()).reshape(k, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector that takes part and each component, by falling eigenvalue.

    ``key``, ``component`` (from 1), ``n``, ``deviation`` (sum over dimensions of (n x - S)^2, exact, a decimal: it leaves the
    range of longs at some hundred million rows), ``whitened``, ``explained`` and ``identity_error``. Null vectors, empty ones, ones
    with a null, NaN or infinite entry or one beyond a long, and ones of another size than most take no part. There are as
    many components as positive eigenvalues, ``components`` at most: where all vectors are equal, or none is left, the result
    is empty. Components of one eigenvalue are orthogonal vectors of its space. Null and repeated keys are kept, each row
    for itself; other columns play no part. The fit runs when the frame is built and reads the vectors three times.
    """
    rows = fit_list(vectors, key, vector)
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(rows, components)
    error = identity_error(rows, model)
    dims, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, BLOCK):
                part = batch.slice(at, BLOCK)
                c = centred(steps_of(part.column("vector"), dims), model)
                w = projected(c, model)
                rows_ = len(c)
                deviation = pa.array([Decimal(int(v)) for v in (c * c).sum(1)], pa.decimal128(38, 0))
                owner = pa.array(np.repeat(np.arange(rows_), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(owner),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)),
                        pa.array(np.full(rows_ * k, model.n)),
                        deviation.take(owner),
                        pa.array(w.ravel()),
                        pa.array(np.tile(model.explained, rows_)),
                        pa.array(np.full(rows_ * k, error)),
                    ],
                    [c.split()[0] for c in schema.split(", ")],
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def op13_exact_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on their 32 first components. A deviation beyond a long is null here; the operator has it."""
    out = whitened(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as long)"))
