"""Classifier evaluation from (label, score) rows: everything is derived from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.operators.ordered import running_totals

# Trial thresholds start, step and number.
FIRST_THRESHOLD, THRESHOLD_STEP, THRESHOLDS = 0.1, 0.05, 16


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def _f1(precision: Column, recall: Column) -> Column:
    return share(2.0 * precision * recall, precision + recall)


def confusion(df: DataFrame, label: str = "label", score: str = "churn_prob", cut: float = 0.5) -> DataFrame:
    """All four cells (label, prediction, n); a prediction is positive above the cut."""
    predicted = F.col(score) > cut
    counts = df.agg(
        *[
            F.count(F.when((F.col(label) == y) & (predicted == F.lit(bool(p))), 1)).alias(f"c{y}{p}")
            for y in (0, 1)
            for p in (0, 1)
        ]
    )
    cells = ", ".join(f"{y}, {p}, c{y}{p}" for y in (0, 1) for p in (0, 1))
    return counts.select(F.expr(f"stack(4, {cells}) as (label, prediction, n)"))


def score_counts(df: DataFrame, label: str = "label", score: str = "churn_prob") -> DataFrame:
    """Positives and negatives per distinct score."""
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).alias("score"))
        .agg(
            F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
        )
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "churn_prob") -> DataFrame:
    """Exact area under the ROC curve by rank sum; tied scores share half."""
    below = running_totals(score_counts(df, label, score), "score", ["neg"])
    return below.agg(_area().alias("roc_auc"))


def _area() -> Column:
    """Share of pairs won, over rows (pos, neg, cum_neg) per score in ascending order."""
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0))
    return F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg"))


def metrics(df: DataFrame, label: str = "label", score: str = "churn_prob", cut: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and ROC-AUC in one row, all from the counts per score."""
    below = running_totals(score_counts(df, label, score), "score", ["neg"])
    positive = F.col("score") > cut

    def total(name: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(name)).otherwise(0)), F.lit(0))

    counts = below.agg(
        total("pos", positive).alias("tp"),
        total("neg", positive).alias("fp"),
        total("pos", ~positive).alias("fn"),
        total("neg", ~positive).alias("tn"),
        _area().alias("roc_auc"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return counts.select(
        share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
        "roc_auc",
    )


def classification_report(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted means.

    ``cells`` are the four rows of ``confusion``.
    """
    n = F.col("n")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    y, p = F.col("label"), F.col("prediction")
    wide = None
    for value in (0, 1):
        part = cells.agg(
            total((y == value) & (p == value)).alias("hit"),
            total(p == value).alias("said"),
            total(y == value).alias("support"),
        ).withColumn("class", F.lit(str(value)))
        wide = part if wide is None else wide.unionByName(part)
    precision, recall = share(F.col("hit"), F.col("said")), share(F.col("hit"), F.col("support"))
    rows = wide.select(
        "class", precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"), "support"
    )
    names = ("precision", "recall", "f1")
    macro = rows.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(
        F.lit("macro avg").alias("class"), *names, "support"
    )
    weighted = rows.agg(
        *[share(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names],
        F.sum("support").alias("support"),
    ).select(F.lit("weighted avg").alias("class"), *names, "support")
    return rows.unionByName(macro).unionByName(weighted)


def _cumulated(df: DataFrame, label: str, score: str) -> tuple[DataFrame, Column, Column]:
    """(counts with running totals from the highest score, all positives, all negatives), from one scan."""
    counts = score_counts(df, label, score)
    one = counts.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))).scalar()
    return running_totals(counts, "score", ["pos", "neg"], descending=True), one["pos"], one["neg"]


def roc_points(df: DataFrame, label: str = "label", score: str = "churn_prob") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, highest first, from the origin (null threshold)."""
    summed, pos, neg = _cumulated(df, label, score)
    points = summed.select(
        F.col("score").alias("threshold"),
        share(F.col("cum_neg"), neg).alias("fpr"),
        share(F.col("cum_pos"), pos).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], points.schema)
    return origin.unionByName(points)


def pr_points(df: DataFrame, label: str = "label", score: str = "churn_prob") -> DataFrame:
    """(threshold, precision, recall) per distinct score, and the closing point (1, 0)."""
    summed, pos, _ = _cumulated(df, label, score)
    said = F.col("cum_pos") + F.col("cum_neg")
    points = summed.select(
        F.col("score").alias("threshold"),
        share(F.col("cum_pos"), said).alias("precision"),
        share(F.col("cum_pos"), pos).alias("recall"),
    )
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], points.schema)
    return end.unionByName(points)


def binned_curve(df: DataFrame, label: str = "label", score: str = "churn_prob", bins: int = 1000) -> DataFrame:
    """ROC and PR figures on evenly binned scores: at most ``bins`` rows for a plot."""
    lower = F.floor(F.col(score) * bins) / bins
    return _cumulated(df.withColumn(score, lower), label, score)[0]


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "churn_prob") -> DataFrame:
    """Precision, recall and F1 at each trial threshold (score >= threshold), best one marked.

    A row is counted once, under the highest threshold it passes; counts are then cumulated.
    """
    trials = [F.lit(FIRST_THRESHOLD) + F.lit(THRESHOLD_STEP) * i for i in range(THRESHOLDS)]
    passed = F.lit(0)
    for trial in trials:
        passed = passed + F.when(F.col(score) >= trial, 1).otherwise(0)
    truth = F.when(F.col(label) == 1, 1).otherwise(0)
    # At most 17 rows from here on.
    counts = df.groupBy((passed - 1).alias("idx")).agg(
        F.sum(truth).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    every = df.sparkSession.range(-1, THRESHOLDS).select(F.col("id").cast("int").alias("idx"))
    onward = Window.orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        every.join(F.broadcast(counts), "idx", "left")
        .na.fill(0, ["pos", "n"])
        .withColumn("tp", F.sum("pos").over(onward))
        .withColumn("said", F.sum("n").over(onward))
        .withColumn("all_pos", F.sum("pos").over(Window.partitionBy()))
        .where("idx >= 0")
    )
    precision, recall = share(F.col("tp"), F.col("said")), share(F.col("tp"), F.col("all_pos"))
    scored = summed.select(
        "idx",
        (F.lit(FIRST_THRESHOLD) + F.lit(THRESHOLD_STEP) * F.col("idx")).alias("threshold"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
    )
    rank = F.row_number().over(Window.orderBy(F.desc("f1"), "idx"))
    return scored.withColumn("best", rank == 1)
