"""Yeo-Johnson power transform with the exponent of greatest likelihood, then standardised."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import isfinite

from pyspark import StorageLevel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.operators.ordered import long_values

COARSE = [-3.0 + 0.5 * i for i in range(15)]
WIDEST = 4096.0


def yeo_johnson(x: Column, exponent: Column) -> Column:
    near = 1e-9
    two = F.lit(2.0) - exponent
    upper = F.when(F.abs(exponent) < near, F.log1p(x)).otherwise(
        (F.pow(x + 1.0, exponent) - 1.0) / exponent
    )
    lower = F.when(F.abs(two) < near, -F.log1p(-x)).otherwise(-(F.pow(1.0 - x, two) - 1.0) / two)
    return F.when(x >= 0, upper).otherwise(lower)


def log_likelihoods(df: DataFrame, exponents: Mapping[str, Sequence[float]]) -> DataFrame:
    """(metric, exponent, n, log_likelihood) for every column and trial exponent in one pass."""
    return _likelihoods(_value_counts(df, list(exponents)), exponents)


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Equal values are transformed once: months, counts and cents collapse to their domain."""
    return long_values(df, [], columns).groupBy("metric", "value").agg(F.count(F.lit(1)).alias("w"))


def _likelihoods(counts: DataFrame, exponents: Mapping[str, Sequence[float]]) -> DataFrame:
    """The trials are a literal array per column; each task keeps three sums per trial."""
    trials = None
    for name, values in exponents.items():
        literal = F.array(*[F.lit(float(v)) for v in values])
        hit = F.col("metric") == name
        trials = F.when(hit, literal) if trials is None else trials.when(hit, literal)
    x, w = F.col("value"), F.col("w")
    rows = counts.select("metric", "value", "w", F.explode(trials).alias("exponent"))
    # Moments about the transformed mean: far exponents squeeze all values into a narrow band.
    middle = counts.groupBy("metric").agg((F.sum(w * x) / F.sum("w")).alias("middle"))
    rows = rows.join(F.broadcast(middle), "metric")  # one row per column
    exponent, middle = F.col("exponent"), F.col("middle")
    # in units of the middle's power, so that no digits are lost however far the exponent
    level = F.when(middle >= 0, F.log1p(middle)).otherwise(0.0)
    step = F.log1p(x) - level
    near = F.when(F.abs(exponent) < 1e-9, step).otherwise(F.expm1(exponent * step) / exponent)
    far = (yeo_johnson(x, exponent) - yeo_johnson(middle, exponent)) * F.exp(-exponent * level)
    rows = rows.withColumn("y", F.when((x >= 0) & (middle >= 0), near).otherwise(far)).withColumn("level", level)
    stats = rows.groupBy("metric", "exponent").agg(
        F.sum("w").alias("n"),
        F.sum(w * F.col("y")).alias("_y"),
        F.sum(w * F.col("y") * F.col("y")).alias("_yy"),
        F.sum(w * F.signum(x) * F.log1p(F.abs(x))).alias("_jac"),
        F.max("level").alias("_level"),
    )
    mean = F.col("_y") / F.col("n")
    spread = F.col("_yy") / F.col("n") - mean * mean
    usable = F.when(spread > 0, spread)  # a constant column has no likelihood
    scale = F.ln(usable) + 2.0 * F.col("exponent") * F.col("_level")
    likelihood = -F.col("n") / 2.0 * scale + (F.col("exponent") - 1.0) * F.col("_jac")
    return stats.select("metric", "exponent", "n", likelihood.alias("log_likelihood"))


def _sql(column: str, exponent: float) -> str:
    x = f"cast(`{column}` as double)"
    two = 2.0 - exponent
    upper = f"ln(1 + {x})" if abs(exponent) < 1e-9 else f"(pow({x} + 1, {exponent!r}D) - 1) / {exponent!r}D"
    lower = f"-ln(1 - {x})" if abs(two) < 1e-9 else f"-(pow(1 - {x}, {two!r}D) - 1) / {two!r}D"
    return f"case when {x} >= 0 then {upper} else {lower} end"


@dataclass
class FittedPower:
    exponents: dict[str, float]
    moments: dict[str, tuple[float, float]]

    def expressions(self, prefix: str = "pt__") -> dict[str, str]:
        return {
            f"{prefix}{c}": f"(({_sql(c, e)}) - {self.moments[c][0]!r}D) / {self.moments[c][1]!r}D"
            for c, e in self.exponents.items()
        }

    def stage(self, prefix: str = "pt__") -> SQLTransformer:
        picked = ", ".join(f"{sql} as `{name}`" for name, sql in self.expressions(prefix).items())
        return SQLTransformer(statement=f"select *, {picked} from __THIS__")


def _widen(counts: DataFrame, grid: dict[str, list[float]]) -> None:
    """Shift each column's first grid until its best trial is inside; only columns still open are tried again."""
    reach = {c: 4.0 for c in grid}
    open_ = set(grid)
    while open_:
        rows = _likelihoods(counts.where(F.col("metric").isin(*open_)), {c: grid[c] for c in open_}).collect()
        for c in sorted(open_):
            curve = sorted(
                (r.exponent, r.log_likelihood)
                for r in rows
                if r.metric == c and r.log_likelihood is not None and isfinite(r.log_likelihood)
            )
            best = max(curve, key=lambda p: p[1])[0] if curve else None
            if best is None or curve[0][0] < best < curve[-1][0] or reach[c] >= WIDEST:
                open_.discard(c)
                if best is not None:
                    grid[c] = [best + 0.5 * i for i in range(-3, 4)]
                continue
            reach[c] *= 2
            side = 1 if best >= curve[-1][0] else -1
            grid[c] = sorted(best + side * reach[c] * i / 16 for i in range(-2, 17))
            if reach[c] > 8:  # a wide grid is narrowed to halves before the steps below
                grid[c] = sorted({*grid[c], best - side * 0.5, best + side * 0.5})
    # wide grids end within one of their steps of the best; close in to a step of one half
    for c in grid:
        width = reach[c] / 16
        while width > 0.5:
            middle = grid[c][len(grid[c]) // 2]
            grid[c] = [middle + width * i / 8 for i in range(-16, 17)]
            rows = _likelihoods(counts.where(F.col("metric") == c), {c: grid[c]}).collect()
            best = max((r.log_likelihood, r.exponent) for r in rows if r.log_likelihood is not None)[1]
            width /= 8
            grid[c] = [best + max(width, 0.5) * i for i in range(-3, 4)]


def fit_power(df: DataFrame, columns: Sequence[str]) -> FittedPower:
    """Narrowing grids and a parabola through the last; each grid is one aggregate.

    The first grid moves on past its end while the best exponent lies on it, so the range is open. It doubles
    its reach each time, and a likelihood that still rises at ``WIDEST`` has no greatest value in doubles.
    """
    grid = {c: list(COARSE) for c in columns}
    best: dict[str, float] = {}
    counts = _value_counts(df, columns).persist(StorageLevel.MEMORY_AND_DISK)
    _widen(counts, grid)
    for step in (0.5, 0.05, 0.005):
        rows = _likelihoods(counts, grid).collect()  # columns x trials
        for c in columns:
            curve = sorted(
                (r.exponent, r.log_likelihood)
                for r in rows
                if r.metric == c and r.log_likelihood is not None
            )
            if not curve:
                best[c] = 1.0
                grid[c] = [1.0]
                continue
            at = max(range(len(curve)), key=lambda i: curve[i][1])
            best[c] = curve[at][0]
            if step == 0.005 and 0 < at < len(curve) - 1:
                (_, y0), (x1, y1), (_, y2) = curve[at - 1 : at + 2]
                bend = y0 - 2 * y1 + y2
                best[c] = x1 + (0.5 * step * (y0 - y2) / bend if bend else 0.0)
            grid[c] = [best[c] + (i - 10) * step / 10 for i in range(21)]
    counts.unpersist()
    aggregates = []
    for c in columns:
        y = F.expr(_sql(c, best[c]))
        aggregates += [F.avg(y).alias(f"m_{c}"), F.stddev_pop(y).alias(f"s_{c}")]
    row = df.agg(*aggregates).first()
    moments = {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}
    return FittedPower(best, moments)
