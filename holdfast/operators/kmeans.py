"""K-means with all starts and all numbers of clusters side by side.

Rows are counted by value first, so the work follows distinct points. Every pass reads the points once for all runs
(number of clusters, start) that still move: a task adds up its points per run and cluster in numpy, one aggregate
merges the tasks' sums, and the driver gets a row per run and cluster. Points are kept as blocks of bytes, so a pass hands
them to Python without taking rows apart. Starts are k-means++ draws by a hash of the
point, as a race of exponential times: the first k draws of a start are its k centres, so one sequence of draws serves
every k. Points of at most ``SENT_BYTES`` are sent to all executors instead, where a task takes a run to its end: a pass over few
points is mostly the start of a Spark job. Nothing hangs on partitions or on the order of rows but the last digits of sums, which are rounded away.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a block, and those whose distances to all centres a task holds at once.
SLICE = 2048
DIGITS = 11
#: Bytes of points that go to all executors at once, to have each run in one task.
SENT_BYTES = 1 << 27
_BLOCK = "n int, x binary, w binary, lot binary"

Run = tuple[int, int]


@dataclass
class Clusters:
    """Centres of one run, in the order of their coordinates, and the sum of squared distances to them."""

    centres: np.ndarray
    cost: float
    passes: int


def weighted_points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct points ``x`` (array) with the number of rows ``w`` and a hash ``lot``; rows with a null are left out."""
    cells = [F.col(c).cast("double") for c in columns]
    rows = df.select(F.array(*cells).alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    points = rows.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return points.withColumn("lot", F.xxhash64("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0])
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Points by centres; summed dimension by dimension, so a point's distances never hang on its neighbours."""
    out = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        d = x[:, j][:, None] - centres[:, j][None, :]
        out += d * d
    return out


def _mixed(lots: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from hashes."""
    u = np.uint64
    z = lots.view(u) + u((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> u(30))) * u(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> u(27))) * u(0x94D049BB133111EB)
    z ^= z >> u(31)
    return ((z >> u(12)).astype(float) + 0.5) / float(1 << 52)


def packed(points: DataFrame) -> DataFrame:
    """The points as blocks of at most ``SLICE``, their numbers as bytes; blocks stay as they are."""
    if points.columns == [f.split(" ")[0] for f in _BLOCK.split(", ")]:
        return points

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x, w, lots = _matrix(part.column(0)), part.column(1).to_numpy(), part.column(2).to_numpy()
                rows.append((len(x), x.tobytes(), w.tobytes(), lots.tobytes()))
            if rows:
                n, *blobs = zip(*rows, strict=True)
                columns = [pa.array(n, pa.int32()), *[pa.array(b, pa.binary()) for b in blobs]]
                yield pa.RecordBatch.from_arrays(columns, ["n", "x", "w", "lot"])

    return points.select("x", "w", "lot").mapInArrow(pack, _BLOCK)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, w, lots) of each block."""
    for batch in batches:
        for n, x, w, lots in zip(*[batch.column(i) for i in range(4)], strict=True):
            n = n.as_py()
            yield (
                np.frombuffer(x.as_buffer()).reshape(n, -1),
                np.frombuffer(w.as_buffer()),
                np.frombuffer(lots.as_buffer(), np.int64),
            )


def _passed(points: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(x, w, lots)`` over slices of the points; it gives columns of the schema."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in kernel(*part)], names)

    return packed(points).mapInArrow(run, schema)


class Nearest:
    """The nearest centre of points under many runs of one size: ``centres`` is runs by clusters by dimensions.

    Distances come from one product of matrices. Where rounding there could hide which centre is nearest, the
    distances of that point and run are summed again as ``squared_distances`` sums them, so the answer is the same.
    """

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        by_cluster = centres.transpose(1, 0, 2)  # clusters by runs by dimensions
        self.shape = by_cluster.shape[:2]
        self.flat = np.ascontiguousarray(by_cluster.reshape(-1, centres.shape[2]))
        with np.errstate(over="ignore"):
            self.lengths = (self.flat**2).sum(axis=1)
            self.reach = float(np.sqrt(self.lengths.max()))

    def of(self, x: np.ndarray) -> np.ndarray:
        """Runs by points; the lower cluster on a tie."""
        k, runs = self.shape
        with np.errstate(over="ignore", invalid="ignore"):
            d = self.flat @ x.T
            d *= -2
            d += self.lengths[:, None]
            d = d.reshape(k, runs, len(x))
            slack = 1e-15 * (8 + 4 * x.shape[1]) * (np.sqrt((x * x).sum(axis=1)) + self.reach) ** 2
            best, at = d[0].copy(), np.zeros((runs, len(x)), np.int64)
            for c in range(1, k):
                np.copyto(at, c, where=d[c] < best)
                np.minimum(best, d[c], out=best)
            best += slack
            # not "one is clearly the least": so what is not a number is looked at again, too
            run, point = np.nonzero((d > best).sum(axis=0) != k - 1)
        for low in range(0, len(run), SLICE):
            r, i = run[low : low + SLICE], point[low : low + SLICE]
            again = np.zeros((len(r), k))
            for j in range(x.shape[1]):
                gap = x[i, j][:, None] - self.centres[r, :, j]
                again += gap * gap
            at[r, i] = again.argmin(axis=1)
        return at


def starts(points: DataFrame, most: int, n_init: int, seed: int) -> list[np.ndarray]:
    """For each start a sequence of at most ``most`` different centres; one pass per draw for all starts.

    Draw j takes point x with probability in proportion to its rows times its squared distance to the draws before:
    each point runs for an exponential time of that rate, and the first to arrive is drawn.
    """
    chosen: list[list[list[float]]] = [[] for _ in range(n_init)]
    for j in range(most):
        so_far = [np.array(c) if c else None for c in chosen]

        def race(x: np.ndarray, w: np.ndarray, lots: np.ndarray, so_far=so_far, j=j) -> list:
            best = []
            for s, centres in enumerate(so_far):
                rate = w if centres is None else w * squared_distances(x, centres).min(axis=1)
                wait = -np.log(_mixed(lots, (seed + s) * 1000 + j + 1))
                with np.errstate(divide="ignore"):
                    time = np.where(rate > 0, wait / rate, np.inf)
                at = np.lexsort((lots, time))[0]
                best.append((s, float(time[at]), x[at].tolist()))
            return [list(c) for c in zip(*best, strict=True)]

        found = _passed(points, race, "start long, time double, x array<double>")
        found = found.groupBy("start").agg(F.min(F.struct("time", "x")).alias("best"))
        for row in found.collect():
            if row.best.time != float("inf"):
                chosen[row.start].append(row.best.x)
    return [np.array(c) for c in chosen]


def _sums(
    points: DataFrame, centres: dict[Run, np.ndarray], costs: bool = False
) -> dict[Run, tuple[np.ndarray, np.ndarray, float]]:
    """Per run: rows and sums of each cluster, and the cost if asked for; one pass and one aggregate for all runs."""
    runs = list(centres)
    sizes = [len(centres[r]) for r in runs]
    cuts = np.cumsum([0, *sizes])
    width = next(iter(centres.values())).shape[1]
    alike = {size: [i for i, s in enumerate(sizes) if s == size] for size in sizes}
    groups = [(size, own, Nearest(np.stack([centres[runs[i]] for i in own]))) for size, own in alike.items()]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per run and cluster for the whole task."""
        found = [np.zeros((size * len(own), width + 1)) for size, own, _ in groups]
        loss = np.zeros(cuts[-1])
        for x, w, _ in _slices(batches):
            weighed = np.concatenate([w[:, None], w[:, None] * x], axis=1)
            for total, (size, own, nearest) in zip(found, groups, strict=True):
                at = nearest.of(x)
                mine = at[None] == np.arange(size)[:, None, None]
                total += mine.reshape(-1, len(x)).astype(float) @ weighed
                for r, i in enumerate(own if costs else ()):
                    d = np.zeros(len(x))
                    for j in range(width):
                        gap = x[:, j] - nearest.centres[r, at[r], j]
                        d += gap * gap
                    loss[cuts[i] : cuts[i + 1]] += np.bincount(at[r], w * d, size)
        every = np.zeros((cuts[-1], width + 1))
        for total, (size, own, _) in zip(found, groups, strict=True):
            for r, part in enumerate(total.reshape(size, len(own), -1).transpose(1, 0, 2)):
                every[cuts[own[r]] : cuts[own[r] + 1]] = part
        number = np.repeat(np.arange(len(runs)), sizes)
        cluster = np.arange(cuts[-1]) - cuts[number]
        columns = [number, cluster, every[:, 0], list(every[:, 1:]), loss]
        if every[:, 0].any():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["run", "cluster", "n", "total", "cost"])

    schema = "run long, cluster long, n double, total array<double>, cost double"
    parts = packed(points).mapInArrow(add, schema)
    merged = parts.groupBy("run", "cluster").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(width)]
    )
    found = {r: (np.zeros(size), np.zeros((size, width)), 0.0) for r, size in zip(runs, sizes, strict=True)}
    loss = dict.fromkeys(runs, 0.0)
    for row in merged.collect():
        run = runs[row.run]
        found[run][0][row.cluster] = row.n
        found[run][1][row.cluster] = [row[f"t{j}"] for j in range(width)]
        loss[run] += row.cost
    return {r: (n, total, loss[r]) for r, (n, total, _) in found.items()}


def _moved(old: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The next centres, from the rows and sums of each cluster."""
    return np.where(n[:, None] > 0, np.round(total / np.maximum(n, 1)[:, None], DIGITS), old)


def _bytes(points: DataFrame) -> int:
    """Bytes of all points."""
    return packed(points).agg(F.sum(F.octet_length("x") + F.octet_length("w"))).first()[0] or 0


def _in_tasks(
    points: DataFrame, moving: dict[Run, np.ndarray], most_passes: int, tol: float
) -> tuple[dict[Run, np.ndarray], dict[Run, int]]:
    """The last centres and the passes of each run, worked out by a task each over points that all executors hold."""
    spark, width = points.sparkSession, next(iter(moving.values())).shape[1]
    # in an order of their own, so that sums do not hang on partitions
    blocks = sorted(_slices(packed(points).toArrow().to_batches()), key=lambda b: int(b[2].min()))
    x, w, _ = (np.concatenate(part) for part in zip(*blocks, strict=True))
    shared = spark.sparkContext.broadcast((x, w, moving))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, w, centres = shared.value
        for batch in batches:
            for k, start in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True):
                old, done, passes = centres[k, start], False, 0
                while not done:
                    nearest, size = Nearest(old[None]), len(old)
                    n, total = np.zeros(size), np.zeros((size, width))
                    for low in range(0, len(x), SLICE):
                        part = slice(low, low + SLICE)
                        at, own = nearest.of(x[part])[0], w[part]
                        n += np.bincount(at, own, size)
                        mine = (at == np.arange(size)[:, None]) * own
                        total += mine @ x[part]
                    new = _moved(old, n, total)
                    passes += 1
                    done = ((new - old) ** 2).sum() <= tol or passes >= most_passes
                    old = new
                columns = [pa.array([v]) for v in (k, start, passes, old.tobytes())]
                yield pa.RecordBatch.from_arrays(columns, ["k", "start", "passes", "centres"])

    # the longest runs first, each a partition
    keys = sorted(moving, reverse=True)
    tasks = spark.sparkContext.parallelize(keys, len(keys)).toDF("k long, start long")
    found = tasks.mapInArrow(run, "k long, start long, passes long, centres binary").collect()
    shared.destroy()
    still = {(r.k, r.start): np.frombuffer(r.centres).reshape(-1, width) for r in found}
    return still, {(r.k, r.start): r.passes for r in found}


def fit_all(
    points: DataFrame, ks: Sequence[int], n_init: int = 10, seed: int = 42, most_passes: int = 300, tol: float = 1e-4
) -> dict[int, Clusters]:
    """The run of least cost among ``n_init`` starts for each k; ``points`` as from ``weighted_points``, kept.

    A run stops once the squared moves of its centres add up to at most ``tol``. A cluster without rows stays
    where it is. With fewer distinct points than k there are as many clusters as points.
    """
    drawn = starts(points, max(ks), n_init, seed)
    moving = {(k, s): c[:k] for k in ks for s, c in enumerate(drawn) if len(c)}
    still: dict[Run, np.ndarray] = {}
    passes = dict.fromkeys(moving, 0)
    if moving and _bytes(points) <= SENT_BYTES:
        still, passes = _in_tasks(points, moving, most_passes, tol)
        moving = {}
    while moving:
        sums = _sums(points, moving)
        ahead = {}
        for run, old in moving.items():
            n, total, _ = sums[run]
            new = _moved(old, n, total)
            passes[run] += 1
            done = ((new - old) ** 2).sum() <= tol or passes[run] >= most_passes
            (still if done else ahead)[run] = new
        moving = ahead
    if not still:
        return {}
    costs = {run: cost for run, (_, _, cost) in _sums(points, still, costs=True).items()}
    out = {}
    for k in ks:
        best = min((r for r in still if r[0] == k), key=lambda r: (round(costs[r], 6), r))
        centres = still[best][np.lexsort(still[best].T[::-1])]
        out[k] = Clusters(centres, costs[best], passes[best])
    return out


def silhouettes(points: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette under squared Euclidean distance of each k's clusters, from moments: two passes for all k.

    The mean squared distance of a point to a cluster is ``|x|^2 - 2 x.m + q`` with the cluster's mean ``m`` and mean
    squared length ``q``; to its own cluster the point itself does not count. A row alone in its cluster has 0.
    """
    runs = {(k, 0): c for k, c in centres.items()}
    order = list(centres)

    def squares(x: np.ndarray, w: np.ndarray, lots: np.ndarray) -> list:
        out = []
        for k in order:
            at = squared_distances(x, centres[k]).argmin(axis=1)
            q = np.bincount(at, w * (x * x).sum(axis=1), len(centres[k]))
            out += [(k, c, v) for c, v in enumerate(q.tolist())]
        return [list(c) for c in zip(*out, strict=True)]

    sums = _sums(points, runs)
    lengths = _passed(points, squares, "k long, cluster long, q double").groupBy("k", "cluster").agg(F.sum("q").alias("q"))
    q = {k: np.zeros(len(c)) for k, c in centres.items()}
    for row in lengths.collect():
        q[row.k][row.cluster] = row.q
    moments = {k: (sums[k, 0][0], sums[k, 0][1], q[k]) for k in order}

    def score(x: np.ndarray, w: np.ndarray, lots: np.ndarray) -> list:
        out = []
        for k in order:
            n, total, length = moments[k]
            at = squared_distances(x, centres[k]).argmin(axis=1)
            mine = np.arange(len(x))
            own = (x * x).sum(axis=1)[:, None]
            dots = np.zeros((len(x), len(n)))
            for j in range(x.shape[1]):
                dots += x[:, j][:, None] * total[:, j][None, :]
            far = n[None, :] * own - 2 * dots + length[None, :]  # sums of squared distances
            there = np.maximum(n, 1)
            a = far[mine, at] / np.maximum(n[at] - 1, 1)
            mean = np.where(n[None, :] > 0, far / there[None, :], np.inf)
            mean[mine, at] = np.inf
            b = mean.min(axis=1)
            top = np.maximum(a, b)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.where((n[at] > 1) & (top > 0) & np.isfinite(b), (b - a) / top, 0.0)
            out.append((k, float((w * s).sum()), float(w.sum())))
        return [list(c) for c in zip(*out, strict=True)]

    found = _passed(points, score, "k long, s double, n double").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("s"))
    return {row.k: row.s for row in found.collect()}


def kept(points: DataFrame) -> DataFrame:
    """The points held for many passes; the caller gives them back by ``unpersist``."""
    return points.persist(StorageLevel.MEMORY_AND_DISK)


def nearest_sql(columns: Sequence[str], centres: np.ndarray) -> str:
    """SQL for the number of the nearest centre, the lower one on a tie."""
    parts = [
        " + ".join(f"(`{c}` - {float(v)!r}D) * (`{c}` - {float(v)!r}D)" for c, v in zip(columns, centre, strict=True))
        for centre in centres
    ]
    every = f"array({', '.join(parts)})"
    return f"cast(array_position({every}, array_min({every})) - 1 as int)"
