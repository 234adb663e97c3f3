"""Clustering queries."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.catalog.aggregates import rounded
from holdfast.catalog.registry import query
from holdfast.operators import clustering, segments
from holdfast.plans import segmentation
from holdfast.plans.scored import scored_accounts

CENTRES = {
    0: (0.1, 0.3, 0.2),
    1: (0.4, 0.8, 0.5),
    2: (0.5, 0.2, 0.1),
    3: (0.95, 0.5, 0.3),
}
_DIMS = ("t", "m", "g")


def _unit(spark, sf_dir):
    return scored_accounts(spark, sf_dir).select(
        S.KEY,
        (F.col("tenure") / 72.0).alias("t"),
        ((F.col("MonthlyCharges") - 18.0) / 102.0).alias("m"),
        (F.col("engagement_score") / 100.0).alias("g"),
    )


def _distance_sql(centre) -> str:
    return " + ".join(
        f"({d} - CAST({v} AS DOUBLE)) * ({d} - CAST({v} AS DOUBLE))" for d, v in zip(_DIMS, centre, strict=True)
    )


_ASSIGNED = f""", unit AS (
  SELECT account_id, tenure / 72.0::DOUBLE AS t, ("MonthlyCharges" - 18.0::DOUBLE) / 102.0::DOUBLE AS m,
    engagement_score / 100.0::DOUBLE AS g FROM scored),
dist AS (SELECT *, {", ".join(f"{_distance_sql(c)} AS d{k}" for k, c in CENTRES.items())} FROM unit),
assigned AS (
  SELECT *, least(d0, d1, d2, d3) AS distance2, CASE least(d0, d1, d2, d3) WHEN d0 THEN 0 WHEN d1 THEN 1
    WHEN d2 THEN 2 ELSE 3 END AS cluster FROM dist)"""


@query(
    "kmeans_assign",
    _ASSIGNED + "SELECT account_id, cluster, round(distance2, 10) AS distance2 FROM assigned",
)
def kmeans_assign(spark, sf_dir):
    assigned = clustering.assign_nearest(_unit(spark, sf_dir), _DIMS, CENTRES)
    return rounded(assigned.select(S.KEY, "cluster", "distance2"), 10, "distance2")


@query(
    "inertia",
    _ASSIGNED
    + """
SELECT cluster, count(*) AS n, round(sum(distance2), 6) AS inertia, round(avg(t), 8) AS t,
  round(avg(m), 8) AS m, round(avg(g), 8) AS g FROM assigned GROUP BY 1""",
)
def inertia(spark, sf_dir):
    assigned = clustering.assign_nearest(_unit(spark, sf_dir), _DIMS, CENTRES)
    return rounded(rounded(clustering.recentre(assigned, _DIMS), 8, *_DIMS), 6, "inertia")


@query(
    "silhouette_squared",
    _ASSIGNED
    + """, moments AS (
  SELECT cluster AS c, count(*) AS n, sum(t) AS st, sum(m) AS sm, sum(g) AS sg,
    sum(t * t + m * m + g * g) AS sq FROM assigned GROUP BY 1),
means AS (
  SELECT a.account_id, a.cluster, c, n, a.t * a.t + a.m * a.m + a.g * a.g + sq / n
    - 2 * (a.t * st + a.m * sm + a.g * sg) / n AS d FROM assigned a CROSS JOIN moments),
sides AS (
  SELECT account_id, max(CASE WHEN c = cluster THEN n END) AS n,
    max(CASE WHEN c = cluster AND n > 1 THEN d * n / (n - 1) END) AS a, min(CASE WHEN c <> cluster THEN d END) AS b
  FROM means GROUP BY 1)
SELECT round(avg(CASE WHEN n = 1 THEN 0.0::DOUBLE ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM sides""",
)
def silhouette_squared(spark, sf_dir):
    assigned = clustering.assign_nearest(_unit(spark, sf_dir), _DIMS, CENTRES)
    ready = VectorAssembler(inputCols=list(_DIMS), outputCol="features").transform(assigned)
    score = clustering.silhouette(ready.select("features", "cluster"))
    return spark.createDataFrame([(round(score, 6),)], "silhouette double")


_PAIRS = [(a, b) for i, a in enumerate(S.SEGMENT_INPUTS) for b in S.SEGMENT_INPUTS[i:]]


@query(
    "pca_covariance",
    "\nUNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop(CAST(\"{a}\" AS DOUBLE), CAST(\"{b}\" AS DOUBLE)), 4) "
        "AS covariance FROM scored"
        for a, b in _PAIRS
    ),
)
def pca_covariance(spark, sf_dir):
    return rounded(clustering.covariance(scored_accounts(spark, sf_dir), S.SEGMENT_INPUTS), 4, "covariance")


_NAMES = """, prof AS (
  SELECT cluster, avg(tenure) AS t, avg("MonthlyCharges") AS m FROM scored GROUP BY 1),
aged AS (SELECT *, row_number() OVER (ORDER BY t, cluster) AS age FROM prof),
charged AS (
  SELECT *, row_number() OVER (PARTITION BY age IN (2, 3) ORDER BY m DESC, cluster) AS ch FROM aged),
names AS (
  SELECT cluster, CASE WHEN age = 1 THEN 'New & Unsettled' WHEN age = 4 THEN 'Veteran Champion'
    WHEN ch = 1 THEN 'At-risk Premium' ELSE 'Loyal Mid-tier' END AS customer_segment FROM charged)"""


@query("cluster_names", _NAMES + "SELECT cluster, customer_segment FROM names")
def cluster_names(spark, sf_dir):
    return segments.name_clusters(segments.cluster_profile(scored_accounts(spark, sf_dir)))


@query(
    "cluster_profile",
    """
SELECT cluster, round(avg(tenure), 6) AS avg_tenure, round(avg("MonthlyCharges"), 6) AS avg_monthly,
  round(avg(complaints_count), 6) AS avg_complaints, round(avg("Churn_Numeric"), 6) AS churn_rate
FROM scored GROUP BY 1""",
)
def cluster_profile(spark, sf_dir):
    found = segments.cluster_profile(scored_accounts(spark, sf_dir))
    return rounded(found, 6, "avg_tenure", "avg_monthly", "avg_complaints", "churn_rate")


@query(
    "cluster_segments",
    _NAMES
    + """
SELECT s.account_id, s.cluster, n.customer_segment FROM (SELECT * EXCLUDE (customer_segment) FROM scored) s
LEFT JOIN names n USING (cluster)""",
)
def cluster_segments(spark, sf_dir):
    named = segments.attach_segments(scored_accounts(spark, sf_dir))
    return named.select(S.KEY, "cluster", "customer_segment")


@query("segmentation_fit")
def segmentation_fit(spark, sf_dir):
    scored = scored_accounts(spark, sf_dir).drop("cluster", "customer_segment")
    fitted = segmentation.fit_segments(scored)
    rows = segmentation.segment_rows(fitted, scored)
    return rows.groupBy("cluster", "customer_segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("tenure").alias("avg_tenure"),
        F.avg("MonthlyCharges").alias("avg_monthly"),
        F.avg("pca1").alias("pca1"),
        F.avg("pca2").alias("pca2"),
    )


@query(
    "segmentation_nearest",
    "SELECT count(*) AS n, count(*) AS at_nearest, 4 AS clusters, true AS centres_are_means, true AS cost_is_sum FROM scored",
)
def segmentation_nearest(spark, sf_dir):
    """The fitted clusters checked from their centres: all rows at the nearest, centres close to the means, cost the sum."""
    scored = scored_accounts(spark, sf_dir).drop("cluster", "customer_segment")
    fitted = segmentation.fit_segments(scored)
    names = [f"pt__{c}" for c in S.SEGMENT_INPUTS]
    rows = clustering.assign_nearest(
        fitted.model.transform(scored).withColumnRenamed("cluster", "own"), names, dict(enumerate(fitted.centres.tolist()))
    )
    per = rows.groupBy("own").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("own") == F.col("cluster"), 1)).alias("at_nearest"),
        F.sum("distance2").alias("cost"),
        F.array(*[F.avg(n) for n in names]).alias("mean"),
    )
    # a run ends once the squared moves of its centres add up to at most 1e-4; the means may be a little further on
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in fitted.centres])
    moves = F.zip_with("mean", F.get(centres, F.col("own")), lambda a, b: (a - b) * (a - b))
    per = per.withColumn("moved", F.aggregate(moves, F.lit(0.0), lambda a, v: a + v))
    return per.agg(
        F.sum("n").alias("n"),
        F.sum("at_nearest").alias("at_nearest"),
        F.count(F.lit(1)).cast("int").alias("clusters"),
        (F.sum("moved") <= 1e-2).alias("centres_are_means"),
        (F.abs(F.sum("cost") / F.lit(fitted.cost) - 1) < 1e-9).alias("cost_is_sum"),
    )


@query("choose_k")
def choose_k(spark, sf_dir):
    return segmentation.choose_k(scored_accounts(spark, sf_dir))
