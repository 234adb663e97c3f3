"""Exact order statistics and running totals without sorting a whole group in one task.

Quantiles look only at a narrow band of values around each rank, which a sketch gives. Equal values are counted
first, which collapses a hot value to one row map-side. Approximate percentiles of the distinct values cut them into
even buckets. Totals per bucket give every bucket its offset, and the exact work happens inside single buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BUCKETS = 64
#: Size of a quantile sketch; its rank error is about 0.14 %.
SKETCH = 2000


def _bounds(value: str, buckets: int) -> Column:
    shares = [i / buckets for i in range(1, buckets)]
    return F.percentile_approx(value, shares, 10 * buckets)


def _bucket(value: Column, bounds: Column, buckets: int) -> Column:
    """Number of bounds below a value, by halving: a tree of comparisons of logarithmic depth."""

    def node(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.get(bounds, F.lit(middle)) < value, node(middle + 1, high)).otherwise(node(low, middle))

    return node(0, buckets - 1)


def long_values(df: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(groups, metric, value) rows of the non-null values of several numeric columns."""
    pairs = ", ".join(f"'{name}', cast(`{name}` as double)" for name in values)
    stacked = df.select(*groups, F.expr(f"stack({len(values)}, {pairs}) as (metric, value)"))
    return stacked.where(F.col("value").isNotNull())


def _bands(
    df: DataFrame, groups: Sequence[str], values: Sequence[str], probs: Sequence[float], sketch: int
) -> list[tuple]:
    """(groups, metric, p, lower rank, upper rank, share, low, high) from one sketch per group and column.

    The ranks lie between the values ``low`` and ``high`` but for a chance that a check of the counts rules out.
    """
    numbers = [F.when(F.isnan(c), float("inf")).otherwise(F.col(c)) for c in values]  # NaN is above all others
    found = []
    for i, number in enumerate(numbers):
        found += [F.kll_sketch_agg_double(number, F.lit(sketch)).alias(f"s{i}"), F.count(number).alias(f"n{i}")]
    sketches = df.groupBy(*groups).agg(*found)
    error = 3 * 2.296 / sketch**0.9723  # three times the sketch's rank error at 99 %
    cells = []
    for i in range(len(values)):
        n = F.col(f"n{i}")
        wide = n * error > 2  # a rank is at most two places off its share; of few rows all are kept
        for p in probs:
            ends = [
                F.when(wide, F.kll_sketch_get_quantile_double(f"s{i}", F.lit(share))) if 0 < share < 1 else F.lit(None)
                for share in (p - 2 * error, p + 2 * error)
            ]
            ends = [e.cast("double") for e in ends]
            cells.append(F.struct(n.alias("n"), ends[0].alias("low"), ends[1].alias("high")))
    out = []
    for row in sketches.select(*groups, F.array(*cells).alias("cells")).collect():  # a row per group
        for k, cell in enumerate(row.cells):
            if cell.n:
                i, j = divmod(k, len(probs))
                at = (cell.n - 1) * probs[j]
                lower = int(at)
                own = (lower, lower + (at > lower), at - lower, cell.low, cell.high)
                out.append((*row[: len(groups)], values[i], float(probs[j]), *own))
    return out


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    values: Sequence[str],
    probs: Sequence[float],
    buckets: int = BUCKETS,
    sketch: int = SKETCH,
) -> DataFrame:
    """Interpolated quantiles: rows (groups, metric, p, quantile). Two scans, and a shuffle of few values.

    The first scan makes a sketch per group and column and so a narrow band of values around each rank. The second
    counts what lies below a band and keeps only the values inside, which are then counted out exactly.
    Groups are closed sets such as labels or segments; rows with a null group are left out.
    """
    for name in groups:
        df = df.where(F.col(name).isNotNull())
    df = df.select(*groups, *[F.col(v).cast("double").alias(v) for v in values])
    keys = [*groups, "metric", "p"]
    own = "metric string, p double, _lower long, _upper long, _share double, _low double, _high double"
    schema = T.StructType([*[df.schema[g] for g in groups], *T.StructType.fromDDL(own).fields])
    rows = _bands(df, groups, values, [float(p) for p in probs], sketch)
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    arrow = to_arrow_schema(schema)
    # a local table: the optimizer knows its size
    bands = df.sparkSession.createDataFrame(
        pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), schema
    )
    near = long_values(df, groups, values).join(bands, [*groups, "metric"])
    low, high, value = F.col("_low"), F.col("_high"), F.col("value")
    near = near.where(high.isNull() | (value <= high) | (high == float("inf")))
    inside = F.when(low.isNull() | (value >= low), value)  # null: below the band
    counts = near.groupBy(*keys, "_lower", "_upper", "_share", inside.alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    under = F.sum(F.when(F.col("value").isNull(), F.col("_n")).otherwise(0)).alias("_under")
    spread = counts.groupBy(*keys).agg(under, F.sum("_n").alias("_upto"), _bounds("value", buckets).alias("_bounds"))
    # the condition names both sides, so that one count of the bands serves both
    missed = (F.col("_lower") < F.col("_under")) | (F.col("_upper") >= F.col("_upto"))
    missed = F.when(missed, F.raise_error(F.lit("a rank lies outside its band"))).otherwise(True)
    placed = counts.join(spread, keys).where(missed & (F.col("value").isNotNull() | (F.col("_under") < 0)))
    placed = placed.withColumn("_bucket", _bucket(F.col("value"), F.col("_bounds"), buckets)).drop("_bounds")

    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ["_lower", "_upper", "_share", "_under"]
    totals = placed.groupBy(*keys, "_bucket", *ranks).agg(F.sum("_n").alias("_in"))
    totals = totals.withColumn("_before", F.col("_under") + F.coalesce(F.sum("_in").over(before), F.lit(0)))
    within = Window.partitionBy(*keys, "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    held = totals.where("_lower < _before + _in and _upper >= _before").select(*keys, "_bucket", "_before")
    running = placed.join(held, [*keys, "_bucket"]).withColumn("_end", F.col("_before") + F.sum("_n").over(within))

    def at(rank: str) -> Column:
        """The value whose rows hold the rank."""
        return F.max(F.when((F.col(rank) < F.col("_end")) & (F.col(rank) >= F.col("_end") - F.col("_n")), F.col("value")))

    found = running.groupBy(*keys, "_share").agg(at("_lower").alias("_first"), at("_upper").alias("_last"))
    between = F.col("_first") + (F.col("_last") - F.col("_first")) * F.col("_share")
    return found.select(*keys, between.alias("quantile"))


def quantile_columns(quantiles: DataFrame, groups: Sequence[str], names: dict[float, str]) -> DataFrame:
    """Quantile rows to one row per group and metric with a column per probability."""
    picks = [
        F.max(F.when(F.col("p") == float(p), F.col("quantile"))).alias(name)
        for p, name in names.items()
    ]
    return quantiles.groupBy(*groups, "metric").agg(*picks)


def median_of(df: DataFrame, column: str) -> Column:
    """Exact median of a column, as a scalar subquery."""
    return exact_quantiles(df, [], [column], [0.5]).select("quantile").scalar()


def running_totals(
    counts: DataFrame,
    value: str,
    sums: Sequence[str],
    descending: bool = False,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Add ``cum_<name>`` over all rows in value order; ``counts`` has one row per value.

    Three steps read the counts; their exchange is the same in all, so they are worked out once.
    """
    spread = counts.agg(_bounds(value, buckets).alias("_bounds"))
    placed = counts.withColumn("_bounds", spread.scalar()).withColumn(
        "_bucket", _bucket(F.col(value), F.col("_bounds"), buckets)
    )
    order = F.desc if descending else F.asc
    totals = placed.groupBy("_bucket").agg(*[F.sum(s).alias(f"_in_{s}") for s in sums])
    # At most one row per bucket goes through the single window task and the broadcast.
    before = Window.orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket",
        *[F.coalesce(F.sum(f"_in_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
    )
    within = Window.partitionBy("_bucket").orderBy(order(value))
    within = within.rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.join(F.broadcast(offsets), "_bucket")
    for s in sums:
        summed = summed.withColumn(f"cum_{s}", F.sum(s).over(within) + F.col(f"_before_{s}"))
    return summed.select(*counts.columns, *[f"cum_{s}" for s in sums])
