"""Whitening of embeddings by their leading principal components, found by a matrix-free Jacobi-Davidson method.

An entry c becomes x = floor(64 c) + 1000000. The covariance V of the x-vectors is never formed: a product V u is one pass over the
rows, in which every task centres its vectors ((n x - S) / n with exact integers n x - S) and adds up (x - m) ((x - m) . u) for a block of
vectors u at once. The search space is kept orthonormal on the driver; a Rayleigh-Ritz step gives Ritz pairs, the pairs whose
residual has reached double precision are locked from the largest on, and the others' projected correction equations
(1 - Q Q') (V - e) (1 - Q Q') t = -r, Q the locked vectors and the pairs at hand, are solved roughly by MINRES, all of a block in step, so
that an inner step is one pass for the block. The corrections extend the space, which restarts from its best pairs when it is full.

What the driver holds: the space (dimensions x at most four times the components asked for) and its products. Tasks send
their sums in slices of dimensions, which are added up by other tasks before they reach the driver.

Defined cases: vectors that are null or hold null, nan or infinite entries are dropped; so are those of another length than
most have (of equally many, the longer), and empty ones. Null vec_ids stay null; repeated rows count each and are returned each; components
without variance (beyond the rank: one row, equal rows) are not returned; equal eigenvalues have any basis of their space; an
empty table gives an empty result; columns beside vec_id and embedding are ignored. |64 c| must stay below 2 ** 53, and the exact deviation
in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK = 32  # pairs corrected at once
INNER = 6  # steps of MINRES at most
SLICE = 4096  # numbers of a task's sum in one row
TASK_BYTES = 32 << 20  # of vectors, in a task of a product
EPS = np.finfo(float).eps
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v: finite vectors of the most common length."""
    v = F.col("embedding").cast("array<double>")
    inf = float("inf")
    broken = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(inf)))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(v.isNotNull() & (F.size(v) > 0) & ~broken)
    sizes = kept.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    best = sizes.agg(F.max(F.struct("rows", "d"))["d"]).first()[0] or 0
    return kept.filter(F.size("v") == best)


def matrix(column: pa.Array) -> np.ndarray:
    """The x-vectors of a batch, one row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(len(column), -1)


def summed(rows: DataFrame, partial, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all batches of ``partial``, an array of that shape; slices are added up by tasks."""
    size = int(np.prod(shape))

    def work(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = partial(batch)
                total = own if total is None else total + own
        if total is not None:
            flat = total.ravel()
            cuts = range(0, size, SLICE)
            yield pa.record_batch([pa.array(list(cuts), pa.int64()), pa.array([flat[k : k + SLICE].tobytes() for k in cuts])], names=["at", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype=float) for x in table.column("sums"))
        return pa.table({"at": table.column("at").slice(0, 1), "sums": pa.array([total.tobytes()])})

    out = np.zeros(size)
    for at, sums in rows.mapInArrow(work, "at long, sums binary").groupBy("at").applyInArrow(added, "at long, sums binary").collect():
        out[at : at + SLICE] = np.frombuffer(sums, dtype=float)
    return out.reshape(shape)


class Covariance:
    """Products with the covariance of the rows' x-vectors. ``rows``: v."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("v")
        x = F.floor(F.col("c") * SCALE) + SHIFT
        sums = self.rows.select(F.posexplode("v").alias("i", "c")).groupBy("i").agg(F.sum(x).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
        self.n, self.d = (int(sums[0]["n"]), len(sums)) if sums else (0, 0)
        self.sums = np.array([int(r["s"]) for r in sums], dtype=np.int64)
        # many small partitions would cost a task each in every product
        cores = rows.sparkSession.sparkContext.defaultParallelism
        self.rows = self.rows.coalesce(max(cores, -(-self.n * self.d * 8 // TASK_BYTES)))

    def centred(self, column: pa.Array) -> np.ndarray:
        return deviations(column, self.n, self.sums) / self.n

    def product(self, u: np.ndarray) -> np.ndarray:
        n, sums = self.n, self.sums

        def partial(batch):
            c = deviations(batch.column(0), n, sums) / n
            return c.T @ (c @ u)

        return summed(self.rows, partial, u.shape) / n

    def trace(self) -> float:
        n, sums = self.n, self.sums
        return float(summed(self.rows, lambda batch: np.array([((deviations(batch.column(0), n, sums) / n) ** 2).sum()]), (1,))[0]) / n


def deviations(column: pa.Array, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact."""
    return n * matrix(column) - sums


def orthonormal(new: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the spaces; directions that add nothing go."""
    kept = []
    for column in new.T:
        norm = np.linalg.norm(column)
        if not norm:
            continue
        column = column / norm
        for _ in range(3):
            for space in (*spaces, *([np.array(kept).T] if kept else [])):
                column = column - space @ (space.T @ column)
            norm = np.linalg.norm(column)
            if norm < 1e-10:
                break
            column = column / norm
        else:
            kept.append(column)
    return np.array(kept).T if kept else new[:, :0]


def minres(product, shifts: np.ndarray, against: np.ndarray, b: np.ndarray, steps: int, rest: float) -> np.ndarray:
    """Rough solutions of (1 - Q Q') (A - shift) (1 - Q Q') t = b, column by column, with one block product a step."""

    def projected(v: np.ndarray) -> np.ndarray:
        return v - against @ (against.T @ v)

    b = projected(b)
    beta = np.linalg.norm(b, axis=0)
    size = beta.copy()
    v_old, v = np.zeros_like(b), b / np.where(beta > 0, beta, 1)
    x, w, w_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    c, s, c_old, s_old = np.ones(len(beta)), np.zeros(len(beta)), np.ones(len(beta)), np.zeros(len(beta))
    eta, beta = beta.copy(), np.zeros(len(beta))
    live = size > 0
    for _ in range(steps):
        if not live.any():
            break
        z = projected(product(v) - v * shifts)
        alpha = (v * z).sum(axis=0)
        z = z - v * alpha - v_old * beta
        after = np.linalg.norm(z, axis=0)
        # the last two rotations, then the one that takes ``after`` away
        rho3, middle = s_old * beta, c_old * beta
        rho2, bar = c * middle + s * alpha, c * alpha - s * middle
        rho1 = np.hypot(bar, after)
        go = live & (rho1 > 0)
        safe = np.where(rho1 > 0, rho1, 1)
        c_old, s_old, c, s = c, s, bar / safe, after / safe
        w_old, w = w, (v - w * rho2 - w_old * rho3) / safe
        x = x + np.where(go, c * eta, 0) * w
        eta = -s * eta
        live = go & (np.abs(eta) > rest * size) & (after > EPS * np.abs(shifts))
        v_old, v, beta = v, np.where(after > 0, z / np.where(after > 0, after, 1), 0), after
    return projected(x)


def leading(cov: Covariance, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns."""
    d = cov.d
    k = min(k, d)
    most = min(d, max(4 * k, 2 * k + 2 * BLOCK))
    q = orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, k + 4))))
    aq = cov.product(q)
    locked, values = np.zeros((d, 0)), []
    best, stuck = np.inf, 0
    while True:
        h = q.T @ aq
        ritz, s = np.linalg.eigh((h + h.T) / 2)
        ritz, s = ritz[::-1], s[:, ::-1]
        want = k - len(values)
        q, aq = q @ s, aq @ s
        u, au, theta = q[:, :want], aq[:, :want], ritz[:want]
        r = au - u * theta
        r = r - locked @ (locked.T @ r)
        norms = np.linalg.norm(r, axis=0)
        top = max([*values, *theta.tolist(), 0.0])
        close = norms <= 32 * EPS * top * np.sqrt(d)
        # a space that is whole has no corrections; a residual that no longer falls is at the products' own rounding
        whole = q.shape[1] + locked.shape[1] >= d
        worst = norms.max() if len(norms) else 0.0
        stuck = 0 if worst < 0.5 * best else stuck + 1
        best = min(best, worst)
        ready = want if whole or stuck > 8 and worst < 1e-10 * max(top, 1e-300) else int(np.argmin(close)) if not close.all() else want
        if ready:
            locked, values = np.hstack((locked, q[:, :ready])), values + theta[:ready].tolist()
            q, aq, best, stuck = q[:, ready:], aq[:, ready:], np.inf, 0
            u, theta, r, close = u[:, ready:], theta[ready:], r[:, ready:], close[ready:]
            if len(values) == k or whole:
                break
        if not q.shape[1]:
            q = orthonormal(np.random.default_rng(seed + len(values)).standard_normal((d, BLOCK)), locked)
            aq = cov.product(q)
            continue
        open_pairs = np.flatnonzero(~close)[:BLOCK]
        against = orthonormal(np.hstack((locked, u)))
        step = minres(cov.product, theta[open_pairs], against, -r[:, open_pairs], INNER, 0.05)
        if q.shape[1] + len(open_pairs) + locked.shape[1] > most:
            keep = max(len(theta) + 4, most - locked.shape[1] - 2 * BLOCK)
            q, aq = q[:, :keep], aq[:, :keep]
        new = orthonormal(step, locked, q)
        if not new.shape[1]:
            new = orthonormal(np.random.default_rng(seed + q.shape[1]).standard_normal((d, 1)), locked, q)
        q, aq = np.hstack((q, new)), np.hstack((aq, cov.product(new)))
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order]


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows = usable(rows)
    cov = Covariance(rows)
    n, sums = cov.n, cov.sums
    values, vectors = np.zeros(0), np.zeros((cov.d, 0))
    trace = cov.trace() if n else 0.0
    if trace > 0:
        values, vectors = leading(cov, components)
        real = values > 1e-12 * trace
        values, vectors = values[real], vectors[:, real]
    k = len(values)
    scaled = vectors / np.sqrt(values)

    def project(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        dev = deviations(column, n, sums)
        return dev, (dev / n) @ scaled

    def gram(batch: pa.RecordBatch) -> np.ndarray:
        _, y = project(batch.column(0))
        return np.vstack((y.T @ y, y.sum(axis=0)))

    error = 0.0
    if k:
        total = summed(cov.rows, gram, (k + 1, k)) / n
        error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    share = values / trace if k else values

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                m = piece.num_rows
                dev, y = project(piece.column(1))
                # one number at a time beyond 53 bits of a square, so that the sum is exact or an error
                exact = (dev**2).sum(axis=1) if np.abs(dev).max() < (1 << 31) // (2 * max(1, int(np.sqrt(dev.shape[1])))) else [int(sum(int(c) ** 2 for c in row)) for row in dev]
                yield pa.record_batch(
                    [
                        piece.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)), pa.array(np.repeat(np.array(exact, dtype=np.int64), k)), pa.array(y.ravel()),
                        pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("vec_id", "v").mapInArrow(work, SCHEMA)
