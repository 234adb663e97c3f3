"""Account view at order grain over the driver tables.

One order is one account. Line items give behaviour, the customer gives the market segment. Both
sides of the joins are aggregated on the join key first: lines collapse map-side, a hot order or
customer never fans out, and the optimizer drops a join whose columns a query does not use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.sources.tables import table


def _yes(condition: Column) -> Column:
    return F.when(condition, "Yes").otherwise("No")


def as_of_date(spark: SparkSession, sf_dir: str) -> Column:
    """Latest order date, as a scalar subquery."""
    orders = table(spark, sf_dir, "orders")
    return orders.agg(F.max(F.to_date("o_orderdate"))).scalar()


def _line_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")

    def lines(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0)).cast("int")

    return line.groupBy(F.col("l_orderkey").alias(S.KEY)).agg(
        F.sum("l_quantity").alias("_usage"),
        F.count(F.lit(1)).cast("int").alias("_lines"),
        lines(F.col("l_returnflag") == "R").alias("_returned"),
        lines(F.col("l_returnflag") == "A").alias("_accepted"),
        lines(F.col("l_linestatus") == "O").alias("_open"),
    )


def accounts(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Raw account records with their key; see ``schema.account_schema``.

    ``orders`` may be a stream of orders; lines and customers are then joined as static tables.
    """
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    customer = table(spark, sf_dir, "customer")
    # The segment as a small number, so that the aggregate stays a hash aggregate.
    segment = F.col("c_mktsegment")
    line = F.when(segment.isin("AUTOMOBILE", "BUILDING"), 2).when(segment == "HOUSEHOLD", 1).otherwise(0)
    market = customer.groupBy(F.col("c_custkey").alias("_customer")).agg(F.max(line).alias("_market"))

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    signup = F.to_date("o_orderdate")
    months = F.floor(F.datediff(as_of_date(spark, sf_dir), signup) / 30).cast("int")
    base = orders.select(
        key.alias(S.KEY),
        cust.alias("_customer"),
        signup.alias("signup_date"),
        F.least(F.lit(72), months).alias("tenure"),
        _yes(F.col("o_orderstatus") == "F").alias("Churn"),
        (F.floor(1800 + 10200 * (F.col("o_totalprice") / 500000.0)) / 100.0).alias("MonthlyCharges"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Month-to-month")
        .when(F.col("o_orderpriority") == "5-LOW", "Two year")
        .otherwise("One year")
        .alias("Contract"),
        (key % 20).cast("int").alias("last_active_days"),
        F.when(cust % 5 == 0, 1).otherwise(0).alias("SeniorCitizen"),
        F.when(cust % 2 == 0, "Female").otherwise("Male").alias("gender"),
        _yes(cust % 3 == 0).alias("Partner"),
        _yes(cust % 4 == 0).alias("Dependents"),
        _yes(cust % 7 < 4).alias("PaperlessBilling"),
        F.when(key % 10 == 0, "No").otherwise("Yes").alias("PhoneService"),
        F.when(key % 10 == 0, "No phone service")
        .otherwise(_yes(key % 2 == 0))
        .alias("MultipleLines"),
        F.when(key % 4 == 0, S.DOMAINS["PaymentMethod"][0])
        .when(key % 4 == 1, S.DOMAINS["PaymentMethod"][1])
        .when(key % 4 == 2, S.DOMAINS["PaymentMethod"][2])
        .otherwise(S.DOMAINS["PaymentMethod"][3])
        .alias("PaymentMethod"),
    )
    joined = base.join(_line_activity(spark, sf_dir), S.KEY, "left").join(market, "_customer", "left")

    usage = F.coalesce("_usage", F.lit(0.0))
    lines = F.coalesce("_lines", F.lit(0))
    score = usage / 5 + 2 * lines - F.col("last_active_days")
    internet = (
        F.when(F.col("_market") == 2, "Fiber optic")
        .when(F.col("_market") == 1, "No")
        .otherwise("DSL")
    )
    account = F.col(S.KEY)
    taken = {
        "OnlineSecurity": account % 3 == 0,
        "OnlineBackup": account % 4 < 2,
        "DeviceProtection": account % 5 < 2,
        "TechSupport": account % 7 < 3,
        "StreamingTV": account % 2 == 0,
        "StreamingMovies": account % 11 < 5,
    }
    services = {
        name: F.when(internet == "No", "No internet service").otherwise(_yes(condition))
        for name, condition in taken.items()
    }
    full = joined.withColumns(
        {
            "InternetService": internet,
            **services,
            "TotalCharges": F.when(
                F.col("_lines").isNotNull(), F.col("MonthlyCharges") * F.col("tenure")
            ),
            "avg_monthly_usage": usage,
            "number_of_logins": lines,
            "complaints_count": F.coalesce("_returned", F.lit(0)),
            "customer_support_calls": F.coalesce("_accepted", F.lit(0)),
            "late_payments": F.coalesce("_open", F.lit(0)),
            "engagement_score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)),
        }
    )
    return full.select(*S.account_schema().fieldNames())


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
