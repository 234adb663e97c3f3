"""Account record: columns, domains, ranges and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "account_id"

# Allowed texts per column.
YES_NO = ("Yes", "No")
NET_SERVICE = ("No", "Yes", "No internet service")
DOMAINS: dict[str, tuple[str, ...]] = {
    "gender": ("Male", "Female"),
    "Partner": YES_NO,
    "Dependents": YES_NO,
    "PhoneService": YES_NO,
    "MultipleLines": ("No phone service", "No", "Yes"),
    "InternetService": ("DSL", "Fiber optic", "No"),
    "OnlineSecurity": NET_SERVICE,
    "OnlineBackup": NET_SERVICE,
    "DeviceProtection": NET_SERVICE,
    "TechSupport": NET_SERVICE,
    "StreamingTV": NET_SERVICE,
    "StreamingMovies": NET_SERVICE,
    "Contract": ("Month-to-month", "One year", "Two year"),
    "PaperlessBilling": YES_NO,
    "PaymentMethod": (
        "Electronic check",
        "Mailed check",
        "Bank transfer (automatic)",
        "Credit card (automatic)",
    ),
}

# Inclusive ranges.
RANGES: dict[str, tuple[float, float]] = {
    "SeniorCitizen": (0, 1),
    "tenure": (0, 72),
    "MonthlyCharges": (18.0, 120.0),
    "TotalCharges": (0.0, 10000.0),
}

INTERNET_SERVICES = (
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
)
MULTI_SERVICES = INTERNET_SERVICES[:4]

# What a behavioural column holds when the record leaves it out.
BEHAVIOUR_DEFAULTS: dict[str, int] = {
    "last_active_days": 15,
    "avg_monthly_usage": 50,
    "number_of_logins": 5,
    "complaints_count": 0,
    "customer_support_calls": 0,
    "late_payments": 0,
}

# Model inputs, numeric block then categorical block.
NUMERIC_INPUTS = (
    "tenure",
    "last_active_days",
    "SeniorCitizen",
    "MonthlyCharges",
    "TotalCharges",
    "avg_monthly_usage",
    "number_of_logins",
    "complaints_count",
    "customer_support_calls",
    "late_payments",
    "charges_per_month",
    "engagement_score",
)
CATEGORICAL_INPUTS = (
    "gender",
    "Partner",
    "Dependents",
    "PhoneService",
    "MultipleLines",
    "InternetService",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
    "Contract",
    "PaperlessBilling",
    "PaymentMethod",
    "tenure_group",
)
MODEL_INPUTS = NUMERIC_INPUTS + CATEGORICAL_INPUTS

# Clustering inputs.
SEGMENT_INPUTS = (
    "tenure",
    "MonthlyCharges",
    "TotalCharges",
    "avg_monthly_usage",
    "engagement_score",
    "complaints_count",
    "customer_support_calls",
)

TENURE_GROUPS = ("New", "Regular", "Loyal", "Veteran")
RISK_TIERS = ("Low", "Medium", "High", "Critical")

# Text shown per risk tier.
RECOMMENDATIONS: dict[str, str] = {
    "Critical": "Urgent: Personal retention call + 25% discount",
    "High": "Offer annual contract upgrade within 48 hours",
    "Medium": "Send targeted email with loyalty incentive",
    "Low": "Upsell opportunity — customer is stable",
}

NEW, AT_RISK, MID_TIER, VETERAN = (
    "New & Unsettled",
    "At-risk Premium",
    "Loyal Mid-tier",
    "Veteran Champion",
)

# Retention playbook (position, segment, drivers, action, urgency).
PLAYBOOK: tuple[tuple[int, str, str, str, str], ...] = (
    (
        1,
        AT_RISK,
        "Engagement Score, Tenure",
        "Proactive outreach from account managers with exclusive contract upgrade offers "
        "(20% loyalty discount).",
        "CRITICAL",
    ),
    (
        2,
        NEW,
        "Engagement Score, Month-to-month Contract",
        "Immediate onboarding check-in and 'first 90 days' rewards program to encourage "
        "long-term commitment.",
        "HIGH",
    ),
    (
        3,
        MID_TIER,
        "Engagement Score, Complaints Count",
        "Automated usage-based feature recommendations and proactive technical health checks.",
        "MEDIUM",
    ),
    (
        4,
        VETERAN,
        "Engagement Score, Tenure",
        "Invitation to VIP feedback panels and early access to new service rollouts "
        "(Low touch, high value).",
        "LOW",
    ),
)


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


def account_schema(money: T.DataType | None = None, date: T.DataType | None = None) -> T.StructType:
    """Raw account record. Pass string types to read dirty money and date text unharmed."""
    money = money or T.DoubleType()
    date = date or T.DateType()
    fields = [T.StructField(KEY, T.LongType())]
    fields += _text("gender")
    fields += [T.StructField("SeniorCitizen", T.IntegerType())]
    fields += _text(*[name for name in DOMAINS if name != "gender"])
    fields += [
        T.StructField("tenure", T.IntegerType()),
        T.StructField("MonthlyCharges", T.DoubleType()),
        T.StructField("TotalCharges", money),
        T.StructField("last_active_days", T.IntegerType()),
        T.StructField("avg_monthly_usage", T.DoubleType()),
        T.StructField("number_of_logins", T.IntegerType()),
        T.StructField("complaints_count", T.IntegerType()),
        T.StructField("customer_support_calls", T.IntegerType()),
        T.StructField("late_payments", T.IntegerType()),
        T.StructField("engagement_score", T.DoubleType()),
        T.StructField("signup_date", date),
        T.StructField("Churn", T.StringType()),
    ]
    return T.StructType(fields)


AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("prediction_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("input_json", T.StringType()),
        T.StructField("churn_result", T.BooleanType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("risk_tier", T.StringType()),
        T.StructField("clv_estimate", T.DoubleType()),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
