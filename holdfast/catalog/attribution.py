"""Driver queries: linear attributions of the scorecard, and a small tree ensemble."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.catalog.aggregates import rounded
from holdfast.catalog.registry import TERM_SQL, number, query
from holdfast.operators import attribution as A
from holdfast.operators import segments
from holdfast.operators.scorecard import DEFAULT_CARD
from holdfast.operators.treeshap import Node, TreeEnsemble, tree_attributions
from holdfast.plans.scored import scored_accounts

NAMES = list(DEFAULT_CARD.weights)


def _explained(spark, sf_dir):
    return A.linear_attributions(scored_accounts(spark, sf_dir), DEFAULT_CARD)


_MEANS = ", ".join(f"avg(CAST({TERM_SQL[n]} AS DOUBLE)) AS m{i}" for i, n in enumerate(NAMES))
_PHI = ", ".join(
    f"{number(DEFAULT_CARD.weights[n])} * (CAST({TERM_SQL[n]} AS DOUBLE) - m{i}) AS p{i}"
    for i, n in enumerate(NAMES)
)
_BASE = " + ".join(
    [number(DEFAULT_CARD.intercept)]
    + [f"{number(DEFAULT_CARD.weights[n])} * m{i}" for i, n in enumerate(NAMES)]
)
_LINEAR = f""", means AS (SELECT {_MEANS} FROM scored),
explained AS (SELECT s.*, {_PHI}, {_BASE} AS base_value FROM scored s CROSS JOIN means),
long AS ({" UNION ALL ".join(f"SELECT account_id, customer_segment, churn_prob, base_value, '{n}' AS feature, {i} AS pos, p{i} AS phi FROM explained" for i, n in enumerate(NAMES))})"""


@query(
    "linear_drivers",
    _LINEAR
    + "SELECT account_id, round(base_value, 8) AS base_value, "
    + ", ".join(f'round(p{i}, 8) AS "phi_{i}"' for i in range(len(NAMES)))
    + " FROM explained",
)
def linear_drivers(spark, sf_dir):
    parts = [F.round(F.col("phi")[i], 8).alias(f"phi_{i}") for i in range(len(NAMES))]
    return _explained(spark, sf_dir).select(S.KEY, F.round("base_value", 8).alias("base_value"), *parts)


@query("global_importance", _LINEAR + "SELECT feature, round(avg(abs(phi)), 8) AS mean_abs FROM long GROUP BY 1")
def global_importance(spark, sf_dir):
    return rounded(A.global_importance(_explained(spark, sf_dir), NAMES), 8, "mean_abs")


@query(
    "attribution_spread",
    _LINEAR
    + " UNION ALL ".join(
        f"SELECT feature, CAST({p} AS DOUBLE) AS p, round(quantile_cont(phi, {p}), 6) AS quantile FROM long GROUP BY 1"
        for p in (0.05, 0.5, 0.95)
    ),
)
def attribution_spread(spark, sf_dir):
    return rounded(A.attribution_spread(_explained(spark, sf_dir), NAMES), 6, "quantile")


@query(
    "segment_importance",
    _LINEAR + "SELECT customer_segment, feature, round(avg(abs(phi)), 8) AS mean_abs FROM long GROUP BY 1, 2",
)
def segment_importance(spark, sf_dir):
    return rounded(A.segment_importance(_explained(spark, sf_dir), NAMES), 8, "mean_abs")


@query(
    "segment_drivers",
    _LINEAR
    + """, strong AS (SELECT customer_segment, feature, avg(abs(phi)) AS v FROM long GROUP BY 1, 2)
SELECT customer_segment, feature, round(v, 8) AS mean_abs, CAST(row_number() OVER (
  PARTITION BY customer_segment ORDER BY v DESC, feature) AS INTEGER) AS position FROM strong QUALIFY position <= 3""",
)
def segment_drivers(spark, sf_dir):
    return rounded(A.segment_drivers(_explained(spark, sf_dir), NAMES, k=3), 8, "mean_abs")


@query(
    "playbook_drivers",
    _LINEAR
    + """, strong AS (SELECT customer_segment, feature, row_number() OVER (
    PARTITION BY customer_segment ORDER BY avg(abs(phi)) DESC, feature) AS place FROM long GROUP BY 1, 2),
named AS (SELECT customer_segment, place, list_transform(
    string_split(regexp_replace(regexp_replace(feature, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ', 'g'), ' '),
    lambda w: upper(w[1]) || lower(w[2:])) AS w FROM strong WHERE place <= 2)
SELECT customer_segment, string_agg(array_to_string(w, ' '), ', ' ORDER BY place) AS drivers FROM named GROUP BY 1""",
)
def playbook_drivers(spark, sf_dir):
    """The playbook with its drivers worked out from the attributions."""
    explained = _explained(spark, sf_dir)
    found = segments.playbook(explained, A.segment_drivers(explained, NAMES, k=2))
    return found.select("customer_segment", "drivers")


@query(
    "customer_top_drivers",
    _LINEAR
    + """
SELECT account_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY abs(phi) DESC, pos) AS INTEGER) AS position,
  feature, round(phi, 8) AS contribution,
  CASE WHEN phi > 0 THEN 'increases risk' ELSE 'decreases risk' END AS direction FROM long QUALIFY position <= 5""",
)
def customer_top_drivers(spark, sf_dir):
    ranked = A.top_drivers(_explained(spark, sf_dir), NAMES, k=5)
    rows = ranked.select(S.KEY, F.posexplode("drivers").alias("position", "d"))
    return rows.select(
        S.KEY,
        (F.col("position") + 1).alias("position"),
        "d.feature",
        F.round("d.contribution", 8).alias("contribution"),
        "d.direction",
    )


_VIEWS = {
    "tenure_by_contract": ("tenure", "tenure", "Contract", 6),
    "charges_by_internet": ("MonthlyCharges", "MonthlyCharges", "InternetService", 10),
    "engagement_by_complaints": ("engagement_score", "engagement_score", "complaints_count", 5),
    "tenure_by_charges": ("tenure", "tenure", "MonthlyCharges", 6),
}


def _colour_sql(column: str) -> str:
    if column == "MonthlyCharges":
        return 'CAST(CAST(floor("MonthlyCharges" / 10) AS INTEGER) AS VARCHAR)'
    return f'CAST("{column}" AS VARCHAR)'


@query(
    "dependence_bins",
    _LINEAR
    + " UNION ALL ".join(
        f"SELECT '{view}' AS chart, CAST(floor(CAST(\"{x}\" AS DOUBLE) / {w}) AS INTEGER) AS x_bin, "
        f"{_colour_sql(c)} AS colour, count(*) AS n, "
        f"sum(CAST(round(p{NAMES.index(f)} * 1e8::DOUBLE) AS BIGINT))::DOUBLE / (count(*)::DOUBLE * 1e8::DOUBLE) "
        "AS mean_attribution "
        "FROM explained GROUP BY 2, 3"
        for view, (f, x, c, w) in _VIEWS.items()
    ),
)
def dependence_bins(spark, sf_dir):
    explained = _explained(spark, sf_dir)
    out = None
    for view, (feature, x, colour, width) in _VIEWS.items():
        shade = F.floor(F.col(colour) / 10) if colour == "MonthlyCharges" else F.col(colour)
        points = A.dependence(explained, NAMES, feature, F.col(x).cast("double"), shade.cast("string"))
        rows = A.dependence_bins(points, width).withColumn("chart", F.lit(view))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "force_rows",
    _LINEAR
    + """, top AS (SELECT account_id FROM scored ORDER BY churn_prob DESC, account_id LIMIT 5)
SELECT account_id, churn_prob, round(base_value, 8) AS base_value, feature, round(phi, 8) AS contribution
FROM long WHERE account_id IN (SELECT account_id FROM top)""",
)
def force_rows(spark, sf_dir):
    rows = A.force_rows(_explained(spark, sf_dir), NAMES, S.KEY, k=5)
    return rounded(rows, 8, "base_value", "contribution")


# A hand-written ensemble over (tenure, MonthlyCharges, complaints_count).
YOUNG, CHEAP, DEAR, CALM, CROSS = 0.8, -0.3, 0.2, -0.1, 0.5


def _small_ensemble(df) -> TreeEnsemble:
    """Covers are counted on the data the trees are explained over."""
    old = F.col("tenure") > 24
    c = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(~old, 1)).alias("young"),
        F.count(F.when(old & (F.col("MonthlyCharges") <= 70), 1)).alias("cheap"),
        F.count(F.when(F.col("complaints_count") <= 1, 1)).alias("calm"),
    ).first()
    rest = Node(
        c.n - c.young,
        feature=1,
        threshold=70.0,
        left=Node(c.cheap, CHEAP),
        right=Node(c.n - c.young - c.cheap, DEAR),
    )
    ensemble = TreeEnsemble()
    ensemble.add(Node(c.n, feature=0, threshold=24.0, left=Node(c.young, YOUNG), right=rest))
    ensemble.add(
        Node(c.n, feature=2, threshold=1.0, left=Node(c.calm, CALM), right=Node(c.n - c.calm, CROSS))
    )
    return ensemble


@query(
    "tree_attributions_small",
    f""", covers AS (
  SELECT count(*)::DOUBLE AS n, count(CASE WHEN tenure <= 24 THEN 1 END)::DOUBLE AS young,
    count(CASE WHEN tenure > 24 AND "MonthlyCharges" <= 70 THEN 1 END)::DOUBLE AS cheap,
    count(CASE WHEN complaints_count <= 1 THEN 1 END)::DOUBLE AS calm FROM scored),
worth AS (
  SELECT account_id, young / n AS wy, 1 - young / n AS wo,
    cheap / (n - young) * ({CHEAP})::DOUBLE + (n - young - cheap) / (n - young) * ({DEAR})::DOUBLE AS old_mean,
    CASE WHEN "MonthlyCharges" <= 70 THEN ({CHEAP})::DOUBLE ELSE ({DEAR})::DOUBLE END AS by_charge, tenure,
    calm / n * ({CALM})::DOUBLE + (n - calm) / n * ({CROSS})::DOUBLE AS mood_mean,
    CASE WHEN complaints_count <= 1 THEN ({CALM})::DOUBLE ELSE ({CROSS})::DOUBLE END AS mood
  FROM scored CROSS JOIN covers),
games AS (
  SELECT *, wy * {YOUNG}::DOUBLE + wo * old_mean AS f0,
    CASE WHEN tenure <= 24 THEN {YOUNG}::DOUBLE ELSE old_mean END AS ft,
    wy * {YOUNG}::DOUBLE + wo * by_charge AS fc,
    CASE WHEN tenure <= 24 THEN {YOUNG}::DOUBLE ELSE by_charge END AS ftc FROM worth)
SELECT account_id, round(f0 + mood_mean, 8) AS base_value,
  round(0.5::DOUBLE * (ft - f0 + ftc - fc), 8) AS phi_tenure,
  round(0.5::DOUBLE * (fc - f0 + ftc - ft), 8) AS phi_charges,
  round(mood - mood_mean, 8) AS phi_complaints FROM games""",
)
def tree_attributions_small(spark, sf_dir):
    scored = scored_accounts(spark, sf_dir)
    x = F.array(*[F.col(c).cast("double") for c in ("tenure", "MonthlyCharges", "complaints_count")])
    explained = tree_attributions(scored.select(S.KEY, x.alias("x")), _small_ensemble(scored), "x")
    names = ("phi_tenure", "phi_charges", "phi_complaints")
    return explained.select(
        S.KEY,
        F.round("base_value", 8).alias("base_value"),
        *[F.round(F.col("phi")[i], 8).alias(n) for i, n in enumerate(names)],
    )
