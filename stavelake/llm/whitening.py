"""Embedding whitening: blockwise QR, Householder bidiagonalisation, singular values by dqds, directions by twisted factorisations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .topk import whole_vector

EPS = float(np.finfo(np.float64).eps)
#: Entries beyond this, after scaling, stay at it.
MOST = 2.0**61
#: Partial results that one combining task takes in.
FAN = 16


# ---------------------------------------------------------------- on the driver, for one matrix of d x d


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) of the upper bidiagonal B = U^T r V, by Householder reflections from both sides."""
    a, d = r.astype(np.float64).copy(), r.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        top = np.abs(x).max(initial=0.0)
        if top == 0 or len(x) == 1:
            return np.zeros_like(x), 0.0
        h = x / top
        h[0] += np.copysign(np.sqrt(h @ h), h[0])
        return h, 2.0 / (h @ h)

    for k in range(d):
        h, tau = reflector(a[k:, k])
        a[k:, k:] -= np.outer(tau * h, h @ a[k:, k:])
        if k < d - 1:
            h, tau = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ h, tau * h)
            v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ h, tau * h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One differential quotient-difference step with a shift; None if the shift is above the least value."""
    new_q, new_e, d = np.empty_like(q), np.empty_like(e), q[0] - shift
    low = d
    for i in range(len(e)):
        if d < 0:
            return None
        new_q[i] = d + e[i]
        ratio = q[i + 1] / new_q[i] if new_q[i] else 0.0
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
        low = min(low, d)
    if d < 0 or not np.isfinite(d):
        return None
    new_q[-1] = d
    return new_q, new_e, max(low, 0.0)


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """All singular values of an upper bidiagonal matrix, falling, each to high relative accuracy.

    dqds on the squares (q, e): a step never subtracts but for the shift, and the shift stays under the least value, so
    small values keep their digits. Off-diagonal squares too small to matter split the matrix; the last value of a part
    is done when the one above it is negligible.
    """
    out, parts = [], [(np.asarray(diagonal, np.float64) ** 2, np.asarray(above, np.float64) ** 2, 0.0)]
    while parts:
        q, e, moved = parts.pop()
        if len(q) == 1:
            out.append(q[0] + moved)
            continue
        tiny = (EPS / 4) ** 2
        cut = np.flatnonzero(e <= tiny * (moved + np.minimum(q[:-1], q[1:])))
        if not len(cut):
            cut = np.flatnonzero(e <= tiny * moved)
        if len(cut):
            at = int(cut[-1])
            parts += [(q[: at + 1], e[:at], moved), (q[at + 1 :], e[at + 1 :], moved)]
            continue
        if q[0] < q[-1]:  # the large end first, so that the small values come out at the bottom
            q, e = _flipped(q, e)
        shift = _shift(q, e) if moved or q.min() > 0 else 0.0
        step = None
        for s in (shift, shift / 4, 0.0):
            step = _dqds_step(q, e, s)
            if step:
                parts.append((step[0], step[1], moved + s))
                break
        if step is None:
            raise ArithmeticError("the qd step broke down: entries are not finite")
    return np.sqrt(np.sort(np.array(out))[::-1])


def _flipped(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The qd array of the matrix read from its other end: same singular values."""
    # B reversed along both axes is lower bidiagonal; its transpose is upper with the squares in reverse order
    return q[::-1].copy(), e[::-1].copy()


def _shift(q: np.ndarray, e: np.ndarray) -> float:
    """A value just under the least eigenvalue of the last corner, and of every row by Gershgorin's bound."""
    down, up = np.sqrt(q[:-1] * e), q.copy()
    up[1:] += e  # B B^T's transpose: diagonal q_i + e_{i-1}
    radius = np.zeros_like(q)
    radius[:-1] += down
    radius[1:] += down
    bound = float((up - radius).min())
    a, b, c = up[-2], up[-1], q[-2] * e[-1]
    corner = (a * b - c) / ((a + b) / 2 + np.sqrt(max(0.0, ((a - b) / 2) ** 2 + c))) if a + b else 0.0
    return max(0.0, bound, 0.98 * min(corner, float(q.min())) if corner > 0 else 0.0)


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float, rank: int = 0) -> np.ndarray:
    """The eigenvector of B^T B for the eigenvalue `value`, by the twisted factorisation with the `rank`-th least pivot.

    A stationary qd transform from the top and a progressive one from the bottom meet at each row; where the remaining
    pivot is least, the vector is solved outward in both directions by products alone.
    """
    n = len(diagonal)
    peak = max(float(np.abs(diagonal).max()), float(np.abs(above).max(initial=0.0)), 1e-150)
    floor = EPS * EPS * peak * peak
    safe = lambda x: x if abs(x) > floor else -floor
    # B^T B = L D L^T with pivots q and multipliers b / a
    a = np.where(np.abs(diagonal) > EPS * EPS * peak, diagonal, EPS * EPS * peak)
    q, side, mult = a * a, a[:-1] * above, above / a[:-1]
    s, plus, top = np.empty(n), np.empty(n - 1), -value
    for i in range(n - 1):
        s[i] = top
        plus[i] = side[i] / safe(top + q[i])
        top = plus[i] * mult[i] * top - value
    s[n - 1] = top
    p, minus = np.empty(n), np.empty(n - 1)
    bottom = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        p[i + 1] = bottom
        pivot = safe(above[i] ** 2 + bottom)
        minus[i] = side[i] / pivot
        bottom = bottom * q[i] / pivot - value
    p[0] = bottom
    r = int(np.argsort(np.abs(s + p + value), kind="stable")[min(rank, n - 1)])
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -minus[i] * z[i]
    z /= np.abs(z).max()
    return z / np.sqrt(z @ z)


def right_directions(diagonal: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of an upper bidiagonal matrix, by falling value.

    The matrix is cut where an off-diagonal entry is negligible, so that the values of each part are simple. What
    rounding leaves of the vectors before it is taken out of each; one that has little left (values that agree to many
    digits) is solved again from the next pivot.
    """
    d = len(diagonal)
    scale = max(float(np.abs(diagonal).max(initial=0.0)), float(np.abs(above).max(initial=0.0)))
    cuts = [i + 1 for i in range(d - 1) if abs(above[i]) <= EPS * EPS * scale or abs(above[i]) <= EPS * 1e-3 * (abs(diagonal[i]) + abs(diagonal[i + 1]))]
    found = []
    for lo, hi in zip([0, *cuts], [*cuts, d]):
        own, off = diagonal[lo:hi], above[lo : hi - 1]
        values = singular_values(own, off)
        done: list[tuple[float, np.ndarray]] = []
        for value in values:
            mates = [z for _, z in done]
            best, left = None, -1.0
            for rank in range(hi - lo):
                z = twisted_vector(own, off, value**2, rank) if hi - lo > 1 else np.ones(1)
                for _ in range(2):
                    for m in mates:
                        z = z - (m @ z) * m
                norm = float(np.sqrt(z @ z))
                if norm > left:
                    best, left = z / max(norm, 1e-300), norm
                if norm > 0.1 or not mates:
                    break
            done.append((value, best))
        for value, z in done:
            whole = np.zeros(d)
            whole[lo:hi] = z
            found.append((value, whole))
    found.sort(key=lambda x: -x[0])
    return np.array([v for v, _ in found]), np.array([z for _, z in found]).T.reshape(d, len(found))


def principal_axes(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of a square matrix, by falling value."""
    top = float(np.abs(r).max(initial=0.0))
    if not top:
        return np.zeros(r.shape[1]), np.eye(r.shape[1])
    diagonal, above, v = bidiagonal(r / top)
    values, z = right_directions(diagonal, above)
    return values * top, v @ z


# ---------------------------------------------------------------- over the rows


def _numbers(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def combined(parts: DataFrame, width: int, join: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """One array from `parts(part, m)`, a written table of flat arrays: FAN at a time, level by level, in tasks.

    Each level is a written table; the driver reads one array. None without parts.
    """
    n = parts.count()

    def merge(batch: pa.Table) -> pa.Table:
        made = join([np.array(x.as_py(), np.float64).reshape(-1, width) for x in batch["m"]])
        return pa.table({"part": pa.array([batch["group"][0].as_py()], pa.int64()), "m": pa.array([made.ravel().tolist()], pa.list_(pa.float64()))})

    while n > 1:
        grouped = parts.withColumn("group", F.floor(F.col("part") / FAN))
        parts, n = stored(grouped.groupBy("group").applyInArrow(merge, "part long, m array<double>"), "combined"), -(-n // FAN)
    row = parts.first()
    return None if row is None else np.array(row.m, np.float64).reshape(-1, width)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """The few rows that tasks made, as a written table with parts numbered from 0."""
    made = stored(df.withColumn("task", F.spark_partition_id()), name)
    tasks = sorted(r.task for r in made.select("task").collect())
    number = made.sparkSession.createDataFrame([(t, i) for i, t in enumerate(tasks)] or [], "task int, part long")
    return made.join(F.broadcast(number), "task").select("part", "m")


def centred_triangle(fit: DataFrame, sums: np.ndarray, n: int) -> np.ndarray:
    """R of the QR factorisation of (n x - S) / n over all rows `x` of `fit`: blocks in tasks, then triangles by level."""
    d = len(sums)

    def fold(blocks: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.concatenate(blocks), mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                block = _numbers(batch.column("x").slice(at, 4096), d)
                r = fold([r, deviations(block, sums, n) / n])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["m"])

    parts = _numbered(fit.select("x").mapInArrow(run, "m array<double>"), "triangles")
    r = combined(parts, d, fold)
    square = np.zeros((d, d))
    if r is not None:
        square[: len(r)] = r
    return square


def deviations(block: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """n x - S, exact: in longs where they fit, else in whole numbers of any size."""
    peak = max(int(np.abs(block).max(initial=0)), 1)
    if n * peak < 2**62:
        return n * block - np.array([int(s) for s in sums], np.int64)
    return n * block.astype(object) - np.array([int(s) for s in sums], object)


def squares(dev: np.ndarray) -> list[int]:
    """Sums of squares by row, exact; past 64 bits they stay at the largest long."""
    peak = int(np.abs(dev).max(initial=0))
    if peak * peak * max(1, dev.shape[1]) < 2**62:
        return (dev.astype(np.int64) ** 2).sum(1).tolist()
    return [min(2**63 - 1, sum(int(v) ** 2 for v in row)) for row in dev]


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "x", components: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every row and component of vectors of longs.

    The fit list is each distinct vector once. Blocks of its centred rows are reduced to triangles by QR in tasks, and
    these to one of d x d, whatever the number of rows; its bidiagonal form gives the directions, which every row is
    projected on in one pass. Components come by falling variance; those with no variance (constant or dependent
    dimensions, fewer distinct vectors than dimensions) cannot be whitened and give no rows, so a single distinct vector
    gives none. All rows count, however often a vector repeats; a null id is kept. Vectors of another length than most
    rows have (of equally common ones the shortest) lie in another space and are left out, and so are null ones. Other
    columns are dropped. Empty tables give none. identity_error is the largest absolute entry of the covariance of the
    whitened fit list less the identity, measured in a pass of its own.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("x")).where("x is not null and size(x) > 0")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths.d
    rows = rows.where(F.size("x") == d)
    fit = stored(rows.select("x").distinct(), "fit")
    total = fit.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("decimal(19,0)")).alias(f"s{i}") for i in range(d)]).first()
    n, sums = total.n, np.array([int(total[f"s{i}"]) for i in range(d)], object)
    values, axes = principal_axes(centred_triangle(fit, sums, n))
    least = values.max(initial=0.0) * EPS * max(n, d) ** 0.5 * 8
    kept = [k for k in range(min(components, d)) if values[k] > least]
    if not kept:
        return spark.createDataFrame([], schema)
    variances = values**2 / n
    turn = axes[:, kept] / np.sqrt(variances[kept])
    explained = [float(v) for v in variances[kept] / variances.sum()]
    k = len(kept)

    def scatter(blocks: list[np.ndarray]) -> np.ndarray:
        """Rows (count), mean, and sum of outer products about the mean; parts are put together about their common mean."""
        count = sum(b[0, 0] for b in blocks)
        mean = sum(b[0, 0] * b[1] for b in blocks) / count
        return np.concatenate([np.full((1, k), count), mean[None], sum(b[2:] + b[0, 0] * np.outer(b[1] - mean, b[1] - mean) for b in blocks)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                w = (deviations(_numbers(batch.column("x"), d), sums, n) / n).astype(np.float64) @ turn
                mean = w.mean(0)
                own = np.concatenate([np.full((1, k), float(len(w))), mean[None], (w - mean).T @ (w - mean)])
                done = [scatter([*done, own])]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([done[0].ravel().tolist()], pa.list_(pa.float64()))], names=["m"])

    spread = combined(_numbered(fit.mapInArrow(measure, "m array<double>"), "scatters"), k, scatter)
    error = float(np.abs(spread[2:] / n - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                m = part.num_rows
                dev = deviations(_numbers(part.column("x"), d), sums, n)
                times = np.repeat(np.arange(m), k)
                made = [
                    part.column("id").take(pa.array(times)), pa.array(np.tile(np.array(kept, np.int32) + 1, m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array(squares(dev), pa.int64()).take(pa.array(times)), pa.array(((dev / n).astype(np.float64) @ turn).ravel()),
                    pa.array(np.tile(np.array(explained), m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(made, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema.replace(id_col, "id", 1)).withColumnRenamed("id", id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(whole_vector(F.col("embedding")))
    return whiten(rows.select("vec_id", F.transform("embedding", lambda c: F.floor(F.greatest(F.least(64 * c.cast("double"), F.lit(MOST)), F.lit(-MOST))) + 1_000_000).alias("x")))
