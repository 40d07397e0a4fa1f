"""Embedding whitening by block Jacobi-Davidson.

The covariance is never formed. Every product with it is one pass over the vectors: a task centres
a block of rows X, adds up X'(XU) for a block U of directions, and only one small matrix a task (after
a second pass of sums, where there are many) reaches the driver. Per outer step the subspace is
solved by Rayleigh-Ritz; the open Ritz pairs' correction equations, projected against themselves and
all locked vectors, are solved by MINRES in lock-step, so that an inner step costs one pass for all
pairs. A pair is locked once its residual is at double precision; a full subspace restarts from its
best Ritz vectors.

Entries become integers floor(1024 c) + 100000, so sums, deviations and the trace are exact.

Defined results: rows whose vector is null, holds a null or non-finite entry, or has fewer entries
than the longest (the others are missing) are left out; a null or repeated vec_id is kept as it is;
there are as many components as dimensions if these are fewer; a component of no variance has
null whitened values and no part in identity_error (null if there is no other); a deviation beyond
64 bits is null; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows in a stored block, and matrices that reach the driver at once.
BLOCK_ROWS, AT_ONCE = 4096, 64
#: Inner steps a correction equation takes at most (a pass each: few steps and more outer ones need
#: the fewest passes), and the fall of its residual that ends it.
INNER, INNER_FALL = 4, 1e-3
#: A pair is locked when its residual is this small against the largest eigenvalue; one that no
#: longer falls (``STALLED`` outer steps) at the second bound is at the accuracy of the products.
LOCK, LOCK_STALLED, STALLED, OUTER = 1e-14, 1e-12, 3, 200


# ---- the eigensolver (driver side: dimensions x directions only) ---------------------------------


def _orthonormal(v: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal basis of what ``v`` adds to the orthonormal ``against``."""
    for _ in range(2):  # twice is enough
        v = v - against @ (against.T @ v)
        size = np.linalg.norm(v, axis=0)
        v = v[:, size > 1e-14] / size[size > 1e-14]
    if not v.shape[1]:
        return v
    q, r = np.linalg.qr(v)
    return q[:, np.abs(np.diag(r)) > 1e-10]


def corrections(product: Callable, theta: np.ndarray, u: np.ndarray, r: np.ndarray, locked: np.ndarray) -> np.ndarray:
    """Approximate t of (I - QQ')(A - theta I)(I - QQ') t = -r with t orthogonal to Q (the Ritz
    vectors u and the locked ones), one column a pair, by MINRES in lock-step."""
    q = np.concatenate([locked, u], axis=1)
    project = lambda x: x - q @ (q.T @ x)
    k = r.shape[1]
    v = project(-r)
    beta = np.linalg.norm(v, axis=0)
    start = beta.copy()
    live = beta > 0
    v = v / np.where(live, beta, 1.0)
    old_v, t = np.zeros_like(v), np.zeros_like(v)
    d, old_d = np.zeros_like(v), np.zeros_like(v)
    eta, cos, old_cos, sin, old_sin = beta.copy(), np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    last = np.zeros(k)
    for _ in range(INNER):
        if not live.any():
            break
        av = np.zeros_like(v)
        av[:, live] = product(v[:, live]) - theta[live] * v[:, live]
        av = project(av)
        alpha = (v * av).sum(0)
        new = av - alpha * v - last * old_v
        beta = np.linalg.norm(new, axis=0)
        delta = cos * alpha - old_cos * sin * last
        rho = np.hypot(delta, beta)
        rho2, rho3 = sin * alpha + old_cos * cos * last, old_sin * last
        safe = np.where(rho > 0, rho, 1.0)
        next_d = (v - rho3 * old_d - rho2 * d) / safe
        go = live & (rho > 0)
        c, s = np.where(go, delta / safe, 1.0), np.where(go, beta / safe, 0.0)
        t[:, go] += (c * eta * next_d)[:, go]
        eta = np.where(go, -s * eta, eta)
        old_d, d = d, next_d
        old_cos, cos, old_sin, sin = cos, c, sin, s
        live = go & (np.abs(eta) > INNER_FALL * start) & (beta > 1e-14 * np.abs(theta).max())
        old_v, v, last = v, new / np.where(beta > 0, beta, 1.0), beta
    return project(t)


def largest_pairs(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (falling) and unit eigenvectors of a symmetric positive
    semidefinite operator that is known by its products with blocks of columns."""
    wanted = min(wanted, dims)
    rng = np.random.default_rng(3)
    most = min(dims, max(6 * wanted, 20))
    locked, values = np.zeros((dims, 0)), []
    v = _orthonormal(rng.standard_normal((dims, min(dims, wanted + 2))), locked)
    av = product(v)
    best, stalled = math.inf, 0
    for _ in range(OUTER):
        h = v.T @ av
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        left = wanted - len(values)
        u, au = v @ y[:, :left], av @ y[:, :left]
        r = au - theta[:left] * u
        r -= locked @ (locked.T @ r)
        size, scale = np.linalg.norm(r, axis=0), max([*values[:1], theta[0], np.finfo(float).tiny])
        whole = v.shape[1] + locked.shape[1] >= dims
        stalled, best = (0, size.min()) if size.min() < 0.5 * best else (stalled + 1, best)
        bound = LOCK_STALLED if stalled >= STALLED or whole else LOCK
        fine = 0
        while fine < left and size[fine] <= bound * scale:
            fine += 1
        if fine:
            locked, values = np.concatenate([locked, u[:, :fine]], axis=1), [*values, *theta[:fine]]
            v, av = v @ y[:, fine:], av @ y[:, fine:]
            theta, u, r = theta[fine:], u[:, fine:], r[:, fine:]
            best, stalled = math.inf, 0
            if len(values) == wanted:
                break
        elif v.shape[1] + left > most:  # restart from the best directions
            keep = min(v.shape[1], max(2 * left, wanted + 2))
            v, av = v @ y[:, :keep], av @ y[:, :keep]
        t = corrections(product, theta[: r.shape[1]], u, r, locked)
        new = _orthonormal(t, np.concatenate([locked, v], axis=1))
        if not new.shape[1]:  # the subspace holds all that the corrections point to
            new = _orthonormal(rng.standard_normal((dims, 1)), np.concatenate([locked, v], axis=1))
        if new.shape[1]:
            v, av = np.concatenate([v, new], axis=1), np.concatenate([av, product(new)], axis=1)
    else:
        raise RuntimeError(f"{wanted - len(values)} of {wanted} eigenpairs did not reach double precision")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order]


# ---- Spark -------------------------------------------------------------------------------------


def integer_blocks(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Staged rows of up to ``BLOCK_ROWS`` vectors (ids, x as 64-bit integers), and the dimension."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    dims = good.agg(F.max(F.size("embedding")).alias("d")).collect()[0]["d"] or 0
    kind = dict(vectors.dtypes)["vec_id"]

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False)
                x = np.floor(x * SCALE).astype("<i8") + SHIFT
                ids = part.column(0)
                ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], ["ids", "x"])

    made = good.filter(F.size("embedding") == dims).mapInArrow(rows, f"ids array<{kind}>, x binary")
    return stage(made, "embedding-blocks"), dims


def _matrices(b: pa.RecordBatch, dims: int):
    for ids, raw in zip(b.column("ids"), b.column("x"), strict=True):
        yield ids.values, np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dims)


def summed(blocks: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray], shape: tuple, dtype: str) -> np.ndarray:
    """Sum over all blocks of ``of(x)``, an array of fixed ``shape``: one a task, added up in a
    second pass where there are more than ``AT_ONCE`` tasks."""

    def part(batches):
        total = np.zeros(shape, dtype)
        for b in batches:
            for _, x in _matrices(b, dims):
                total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(batches):
        total = np.zeros(shape, dtype)
        for b in batches:
            for m in b.column(0):
                total += np.frombuffer(m.as_buffer(), dtype).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = blocks.mapInArrow(part, "m binary")
    if blocks.rdd.getNumPartitions() > AT_ONCE:
        parts = parts.repartition(AT_ONCE).mapInArrow(add, "m binary")
    return sum((np.frombuffer(r["m"], dtype).reshape(shape) for r in parts.collect()), np.zeros(shape, dtype))


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: see the contract at the
    top; one row per vector and component."""
    kind = dict(vectors.dtypes)["vec_id"]
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    ddl = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    blocks, dims = integer_blocks(vectors)
    none = vectors.sparkSession.createDataFrame([], ddl)
    if not dims:
        return none
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)  # read once a product; the staged rows outlive executors
    first = summed(blocks, dims, lambda x: np.concatenate([[len(x)], x.sum(0)]), (dims + 1,), "<i8")
    n, sums = int(first[0]), first[1:]
    mean = sums / n
    square = summed(blocks, dims, lambda x: ((x - mean) ** 2).sum(), (), "<f8")
    trace = float(square) / n

    def product(u: np.ndarray) -> np.ndarray:
        def of(x):
            c = x - mean
            return c.T @ (c @ u)

        return summed(blocks, dims, of, u.shape, "<f8") / n

    k = min(components, dims)
    values, axes = largest_pairs(product, dims, k) if trace > 0 else (np.zeros(k), np.eye(dims)[:, :k])
    real = values > 1e-13 * max(trace, np.finfo(float).tiny)
    scaled = axes[:, real] / np.sqrt(values[real])
    error = None
    if real.any():
        white = summed(blocks, dims, lambda x: ((x - mean) @ scaled).sum(0), (int(real.sum()),), "<f8") / n

        def spread(x):
            w = (x - mean) @ scaled - white
            return w.T @ w

        cov = summed(blocks, dims, spread, (int(real.sum()),) * 2, "<f8") / n
        error = float(np.abs(cov - np.eye(len(cov))).max())
    explained = values / trace if trace > 0 else np.zeros(k)

    def rows(batches):
        for b in batches:
            for ids, x in _matrices(b, dims):
                w = np.full((len(x), k), np.nan)
                w[:, real] = (x - mean) @ scaled
                off = n * x - sums if n * int(np.abs(x).max()) < 2**62 else n * x.astype(object) - sums.astype(object)
                if float(np.abs(off).max()) ** 2 * dims < 2**62:
                    dev = pa.array((off**2).sum(1).astype(np.int64))
                else:
                    whole = (off.astype(object) ** 2).sum(1)
                    dev = pa.array([v if v < 2**63 else None for v in whole], pa.int64())
                at = pa.array(np.repeat(np.arange(len(x)), k))
                total = len(x) * k
                cols = [
                    ids.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(total, n)), dev.take(at),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(np.tile(explained, len(x))), pa.array([error] * total, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    out = stage(blocks.mapInArrow(rows, ddl), "whitened")
    blocks.unpersist()
    return out
