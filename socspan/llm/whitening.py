"""Whitening of embeddings by components of the exact integer scatter.

Entries become whole numbers, so the scatter n * sum(x x') - S S' is an exact
integer matrix: n squared times the covariance. Tasks add up their rows'
products, Spark adds up the tasks, and from there on nothing grows with rows:

1. the characteristic polynomial, modulo one prime of 31 bits a task: the
   matrix is brought to Hessenberg form, whose polynomial follows by recurrence;
2. Chinese remaindering gives its integer coefficients;
3. a symmetric matrix has real roots only, so the sign changes of the
   polynomial shifted by a (Descartes) are exactly the roots above a: halving
   intervals isolates each root, and signs refine it to ROOT_BITS bits;
4. a component spans the null space of scatter minus root: inverse iteration
   on a fixed-point elimination of FRACTION_BITS bits, a root a task. Roots
   closer than any double tells apart are solved for together.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import embeddings_of, refuse, short_batches, written

SCALE = 64
OFFSET = 1_000_000  # of x; covariances and deviations don't depend on it, so sums are kept without it
COMPONENTS = 32
DIMS_MOST = 4096  # bound of the matrix that the driver holds; wider vectors are refused
ROOT_BITS = 140  # relative precision of a root
SAME_BITS = 70  # roots that agree to so many bits share one null space
FRACTION_BITS = 224  # fixed point of the elimination
LONG = 1 << 63
LIMB = 40  # bits of the parts in which Spark adds up large whole numbers
LIMBS = 5


class _Rows(NamedTuple):
    at: np.ndarray  # places in the batch
    x: np.ndarray  # entries less OFFSET, one row each


def quantised(vectors: pa.Array) -> list[_Rows]:
    """The usable vectors of a batch by length: not null, not empty, all entries there, finite, and small enough for a long."""
    offsets, there = np.asarray(vectors.offsets), np.asarray(vectors.is_valid())
    values = vectors.values.fill_null(math.nan).to_numpy(zero_copy_only=False).astype(float, copy=False)
    sizes, out = np.diff(offsets), []
    for d in np.unique(sizes[there & (sizes > 0)]):
        at = np.flatnonzero(there & (sizes == d))
        with np.errstate(over="ignore"):
            x = np.floor(SCALE * values[offsets[at][:, None] + np.arange(d)])
        fits = (np.abs(x) < LONG - 2 * OFFSET).all(axis=1)  # false for NaN and infinities
        if fits.any():
            out.append(_Rows(at[fits], x[fits].astype(np.int64)))
    return out


def products(x: np.ndarray) -> np.ndarray:
    """x' x in exact whole numbers: 16-bit parts are multiplied as doubles, which hold every sum of a batch."""
    parts = []
    while np.abs(x).max() > 0xFFFF:
        parts.append((x & 0xFFFF).astype(float))
        x = x >> 16
    parts.append(x.astype(float))
    return sum((a.T @ b).astype(np.int64).astype(object) << 16 * (i + j) for i, a in enumerate(parts) for j, b in enumerate(parts))


def _limbs(v: int) -> tuple[int, ...]:
    return *(v >> LIMB * k & (1 << LIMB) - 1 for k in range(LIMBS - 1)), v >> LIMB * (LIMBS - 1)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """A task's sums: dim, (i, j), and the number in LIMBS parts. Row -1 has sums of entries, (-1, -1) the number of vectors."""
    total: dict[int, list] = {}
    for batch in batches:
        for _, x in quantised(batch.column(0)):
            d = x.shape[1]
            if d > DIMS_MOST:
                raise ValueError(f"vectors of more than {DIMS_MOST} entries")
            t = total.setdefault(d, [0, np.zeros(d, object), np.zeros((d, d), object)])
            t[0] += len(x)
            t[1] = t[1] + x.astype(object).sum(axis=0)
            t[2] = t[2] + products(x)
    for d, (n, s, m) in total.items():
        rows = [(-1, -1, n), *((-1, j, v) for j, v in enumerate(s)), *((i, j, m[i, j]) for i in range(d) for j in range(i, d))]
        yield pa.RecordBatch.from_pandas(pd.DataFrame([(d, i, j, *_limbs(int(v))) for i, j, v in rows], columns=["dim", "i", "j", *(f"l{k}" for k in range(LIMBS))]).astype({"dim": "int32", "i": "int32", "j": "int32"}))


@dataclass
class Scatter:
    """Number of vectors, sums of each dimension and n squared times the covariance, in exact whole numbers (without OFFSET)."""

    n: int
    sums: np.ndarray
    matrix: np.ndarray


def scatter(vectors: DataFrame, column: str = "embedding") -> Scatter:
    """The scatter of a column of vectors, of those of the most frequent length (the longer of equally frequent ones).

    A task sends (d + 1)(d + 2) / 2 numbers whatever its rows, and the driver
    gets as many; d is at most DIMS_MOST.
    """
    short_batches(vectors.sparkSession)
    parts = ", ".join(f"l{k} long" for k in range(LIMBS))
    sums = vectors.select(F.col(column).cast("array<double>")).mapInArrow(_summed, f"dim int, i int, j int, {parts}").groupBy("dim", "i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)))
    sums = written(sums, "scatter")
    whole = lambda r: sum(r[f"l{k}"] << LIMB * k for k in range(LIMBS))
    most = sums.filter("i = -1 and j = -1").collect()
    if not most:
        return Scatter(0, np.zeros(0, object), np.zeros((0, 0), object))
    n, d = max((whole(r), r["dim"]) for r in most)
    s, m = np.zeros(d, object), np.zeros((d, d), object)
    for r in sums.filter((F.col("dim") == d) & (F.col("j") >= 0)).toLocalIterator():
        if r["i"] < 0:
            s[r["j"]] = whole(r)
        else:
            m[r["i"], r["j"]] = m[r["j"], r["i"]] = whole(r)
    return Scatter(n, s, n * m - np.outer(s, s))


def _is_prime(n: int) -> bool:
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):  # enough below 3,215,031,751
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(r - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below 2^31, as many as have a product of more than so many bits."""
    out, have, p = [], 0.0, (1 << 31) - 1
    while have <= bits:
        if _is_prime(p):
            out.append(p)
            have += math.log2(p) - 1e-9
        p -= 2
    return out


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t - m) modulo the prime p, that of t^0 first."""
    a = (m % p).astype(np.int64)
    n = len(a)
    for k in range(n - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not below.size:
            continue
        if at := int(below[0]):
            a[[k + 1, k + 1 + at]] = a[[k + 1 + at, k + 1]]
            a[:, [k + 1, k + 1 + at]] = a[:, [k + 1 + at, k + 1]]
        u = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - u[:, None] * a[k + 1]) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * u % p).sum(axis=1)) % p
    # Of each leading block of a Hessenberg matrix, from those of the smaller ones.
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    for k in range(n):
        weights, run = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(a[i, k]) * run % p
            run = run * int(a[i, i - 1]) % p if i else 0
        polys[k + 1, 1:] = polys[k, :-1]
        polys[k + 1] = (polys[k + 1] - (weights[:, None] * polys[: k + 1] % p).sum(axis=0)) % p
    return polys[n]


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Integer coefficients of det(t - m) for a symmetric m without negative roots, that of t^0 first; primes are shared out to tasks."""
    d, trace = len(m), int(np.trace(m))
    bound = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))  # of the sums of products of k roots
    found = primes(bound.bit_length() + 2)
    held = spark.sparkContext.broadcast(m)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"p": pdf["p"], "c": [polynomial_mod(held.value, int(p)).tolist() for p in pdf["p"]]})

    rows = spark.createDataFrame([(p,) for p in found], "p long").repartition(min(len(found), spark.sparkContext.defaultParallelism))
    out, product = [0] * (d + 1), 1
    for r in rows.mapInPandas(solve, "p long, c array<long>").collect():
        inverse = pow(product, -1, r["p"])
        out = [c + product * ((x - c) * inverse % r["p"]) for c, x in zip(out, r["c"], strict=True)]
        product *= r["p"]
    return [c - product if 2 * c > product else c for c in out]


class Root(NamedTuple):
    """A root as value / 2^shift, and how many roots it stands for."""

    value: int
    shift: int
    times: int


def _above(poly: list[int], a: int, shift: int) -> int:
    """How many roots of a polynomial with real roots only lie above a / 2^shift: sign changes after the shift by it."""
    d = len(poly) - 1
    c = [x << shift * (d - i) for i, x in enumerate(poly)]
    for low in range(d):
        for i in range(d - 1, low - 1, -1):
            c[i] += a * c[i + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], a: int, shift: int) -> int:
    d, v = len(poly) - 1, 0
    for i in range(d, -1, -1):
        v = v * a + (poly[i] << shift * (d - i))
    return (v > 0) - (v < 0)


def largest_roots(poly: list[int], most: int) -> list[Root]:
    """The largest positive roots of a polynomial with real roots >= 0 only, falling: at least `most` with their times, or all."""
    zeros = next(i for i, c in enumerate(poly) if c)
    poly = poly[zeros:]
    if len(poly) == 1:
        return []
    top = max(abs(poly[-2]).bit_length(), 1)  # the sum of the roots is below 2^top
    out: list[Root] = []
    todo = [(0, 1 << top, 0, len(poly) - 1, 0)]  # (low, high] over 2^shift, with the counts above either end
    while todo and sum(r.times for r in out) < most:
        low, high, shift, n_low, n_high = todo.pop()
        n = n_low - n_high
        if not n:
            continue
        if low and (n == 1 or (high - low) << SAME_BITS <= low):
            out.append(_refined(poly, low, high, shift) if n == 1 else Root(low + high, shift + 1, n))
            continue
        if high - low == 1:
            low, high, shift = 2 * low, 2 * high, shift + 1
        mid = (low + high) // 2
        n_mid = _above(poly, mid, shift)
        todo += [(low, mid, shift, n_low, n_mid), (mid, high, shift, n_mid, n_high)]
    return out


def _refined(poly: list[int], low: int, high: int, shift: int) -> Root:
    """The only root in (low, high] over 2^shift, to ROOT_BITS bits."""
    at_high = _sign(poly, high, shift)
    if not at_high:
        return Root(high, shift, 1)
    while (high - low) << ROOT_BITS > low:
        if high - low == 1:
            low, high, shift = 2 * low, 2 * high, shift + 1
        mid = (low + high) // 2
        s = _sign(poly, mid, shift)
        if not s:
            return Root(mid, shift, 1)
        low, high = (low, mid) if s == at_high else (mid, high)
    return Root(low + high, shift + 1, 1)


def null_space(m: np.ndarray, root: Root) -> np.ndarray:
    """root.times orthonormal doubles-precise rows that span the eigenspace of m at the root."""
    d, one = len(m), 1 << FRACTION_BITS
    a = np.array([[int(v) << FRACTION_BITS for v in row] for row in m], object)
    move = root.value << (FRACTION_BITS - root.shift) if root.shift <= FRACTION_BITS else root.value >> (root.shift - FRACTION_BITS)
    a[np.arange(d), np.arange(d)] -= move
    order, below = np.arange(d), np.zeros((d, d), object)
    for k in range(d):
        at = k + int(np.argmax(np.abs(a[k:, k])))
        if at != k:
            for x in (a, below, order):
                x[[k, at]] = x[[at, k]]
        if not a[k, k]:
            a[k, k] = 1  # singular to the last bit: the least step away
        if k + 1 < d:
            f = (a[k + 1 :, k] << FRACTION_BITS) // a[k, k]
            below[k + 1 :, k] = f
            a[k + 1 :, k:] -= (f[:, None] * a[k, k:]) >> FRACTION_BITS

    def solved(v: np.ndarray) -> np.ndarray:
        v = v[order].copy()
        for k in range(d):
            v[k + 1 :] -= (below[k + 1 :, k] * v[k]) >> FRACTION_BITS
        for k in range(d - 1, -1, -1):
            v[k] = (v[k] << FRACTION_BITS) // a[k, k]
            v[:k] -= (a[:k, k] * v[k]) >> FRACTION_BITS
        return v

    def unit(v: np.ndarray) -> np.ndarray:
        size = math.isqrt(int((v * v).sum()))
        return (v << FRACTION_BITS) // max(size, 1)

    draw = np.random.default_rng(d)
    basis = [np.array([int(x) << FRACTION_BITS - 20 for x in draw.integers(-(1 << 20), 1 << 20, d)], object) for _ in range(root.times)]
    for _ in range(4):
        done: list[np.ndarray] = []
        for v in basis:
            v = unit(solved(v))
            for _ in range(2):
                for w in done:
                    v = v - ((int((v * w).sum()) >> FRACTION_BITS) * w >> FRACTION_BITS)
                v = unit(v)
            done.append(v)
        basis = done
    for v in basis:
        off = np.abs(m.dot(v) - (root.value * v >> root.shift))
        if int(off.max()) << SAME_BITS - 10 > (root.value << FRACTION_BITS) >> root.shift:
            raise ArithmeticError("inverse iteration did not reach the null space")
    return np.array([[int(x) / one for x in v] for v in basis])


@dataclass
class Model:
    """What whitening needs: components as rows, their eigenvalues in x's covariance, and each one's share of the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Deviation (null where no long holds it) and whitened entries of rows of whole numbers."""
        most = max(self.n * int(np.abs(x).max(initial=0)), max((abs(int(v)) for v in self.sums), default=0))
        off = self.n * x - self.sums.astype(np.int64) if most < LONG >> 1 else self.n * x.astype(object) - self.sums
        if (2 * most) ** 2 * max(x.shape[1], 1) < LONG:
            deviation = (off * off).sum(axis=1).tolist()
        else:
            big = off.astype(object)
            deviation = [int(v) if v < LONG else None for v in (big * big).sum(axis=1)]
        return deviation, (off.astype(float) / self.n) @ self.components.T / np.sqrt(self.eigenvalues)


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Model:
    """The largest components of a column's vectors; as many as there are eigenvalues above zero, if those are fewer."""
    s = scatter(vectors, column)
    spark, m, d = vectors.sparkSession, s.matrix, len(s.sums)
    if not s.n or not any(m[i, i] for i in range(d)):
        return Model(s.n, s.sums, np.zeros((0, d)), np.zeros(0), np.zeros(0))
    common = math.gcd(*(int(v) for v in m.ravel()))
    m = m // common
    roots = largest_roots(characteristic_polynomial(spark, m), components)
    held = spark.sparkContext.broadcast((m, roots))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["k"]:
                yield pd.DataFrame({"k": [k], "rows": [json.dumps(null_space(held.value[0], held.value[1][k]).tolist())]})

    tasks = spark.createDataFrame([(k,) for k in range(len(roots))], "k int").repartition(min(len(roots), spark.sparkContext.defaultParallelism))
    rows = {r["k"]: json.loads(r["rows"]) for r in tasks.mapInPandas(solve, "k int, rows string").collect()}
    vectors_ = np.array([v for k in range(len(roots)) for v in rows[k]])[:components]
    values = [r for r in roots for _ in range(r.times)][:components]
    trace = int(np.trace(m))
    ratio = np.array([r.value / (trace << r.shift) for r in values])
    return Model(s.n, s.sums, vectors_, np.array([r.value * common / (s.n * s.n << r.shift) for r in values]), ratio)


_FOUND = T.StructType([T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])


def whiten(vectors: DataFrame, model: Model, column: str = "embedding") -> DataFrame:
    """The rows of vectors that can be whitened, with the struct _white (n, deviation, whitened: an array by component).

    Rows go whose vector is null, empty, holds null or non-finite entries or
    ones too large for a long, or has another length than the model's. Equal
    rows stay, each with the same result; a deviation that no long holds is
    null; a model of no vectors keeps no rows. A column _white is refused,
    all other columns are kept whatever their names.
    """
    refuse(vectors, "_white")
    short_batches(vectors.sparkSession)
    held = vectors.sparkSession.sparkContext.broadcast(model)
    struct = pa.struct([("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    @F.arrow_udf(_FOUND)
    def found(v: pa.Array) -> pa.Array:
        m, out = held.value, [None] * len(v)
        for at, x in quantised(v):
            if x.shape[1] == len(m.sums):
                deviation, z = m.apply(x)
                for i, a, b in zip(at.tolist(), deviation, z.tolist(), strict=True):
                    out[i] = {"n": m.n, "deviation": a, "whitened": b}
        return pa.array(out, struct)

    return vectors.withColumn("_white", found(F.col(column).cast("array<double>"))).filter(F.col("_white").isNotNull())


def identity_error(whitened: DataFrame) -> float:
    """The largest absolute entry of the covariance of _white.whitened minus the identity; 0 without components."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows and (z := np.array(batch.column(0).to_pylist(), float)).size:
                n, s, g = n + len(z), s + z.sum(axis=0), g + z.T @ z
        if n:
            k = len(s)
            i, j = (x.ravel() for x in np.indices((k + 1, k)))
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": np.vstack([g, s]).ravel(), "n": np.full((k + 1) * k, n)})

    sums = whitened.select("_white.whitened").mapInArrow(summed, "i int, j int, v double, n long").groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    if not sums:
        return 0.0
    k = max(r["j"] for r in sums) + 1
    g = np.zeros((k + 1, k))
    for r in sums:
        g[r["i"], r["j"]] = r["v"] / r["n"]
    return float(np.abs(g[:k] - np.outer(g[k], g[k]) - np.eye(k)).max())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's whitened entries, one row a component.

    The entries are centred exactly before they are projected, so the
    covariance of the result is taken from sums about zero and their mean.
    """
    vectors = embeddings_of(spark, sf_dir).select("vec_id", "embedding")
    model = fit(vectors)
    rows = whiten(vectors, model)
    error = identity_error(rows)
    share = F.array(*map(F.lit, model.explained.tolist())) if len(model.explained) else F.array().cast("array<double>")
    long = rows.select("vec_id", "_white.n", "_white.deviation", F.posexplode("_white.whitened").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
