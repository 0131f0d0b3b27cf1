"""H* analytical views and I* analytics dataset over the scored frame.

All money sums go through integer cents recovered from the two-decimal
``order_value`` (exact), so totals do not depend on the summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as K
from ..functions.numeric import flag, round_half_up, share_pct, to_cents

# Fixed columns of the published high-risk view.
HIGH_COLUMNS = (
    "SalesOrderID", "CustomerID", "OrderDate", "order_value", "OnlineOrderFlag", "CreditCardID",
    "days_since_previous_order", "prior_order_count", "prior_avg_order_value", "amount_vs_customer_avg",
    "billing_city", "billing_state", "shipping_city", "shipping_state",
    "same_day_repeat_flag", "rapid_repeat_flag", "amount_spike_flag", "city_mismatch_flag",
    "state_mismatch_flag", "transaction_risk_score", "risk_dimension_count", "risk_level", "risk_reason",
)


def _cents():
    return to_cents("order_value")


def _avg_money(sum_cents: str, n: str):
    return round_half_up(F.col(sum_cents).cast("double") / (F.col(n) * 100).cast("double"), 2)


def _all_rows():
    # over an aggregated result of a few rows (one per level)
    return Window.partitionBy()


def top_risk(risk: DataFrame, n: int = 100) -> DataFrame:
    """Top n by score and ratio (id breaks ties)."""
    return risk.orderBy(F.col("transaction_risk_score").desc(),
                        F.col("amount_vs_customer_avg").desc_nulls_last(),
                        F.col("SalesOrderID").asc()).limit(n)


def risk_row_count(risk: DataFrame) -> DataFrame:
    """Rows of the risk view (equals the order count)."""
    return risk.agg(F.count(F.lit(1)).alias("total_transactions"))


def vw_high_risk_transactions(risk: DataFrame) -> DataFrame:
    """H2: High orders, 23 columns."""
    return (risk.where(F.col("risk_level") == K.LEVEL_HIGH).select(*HIGH_COLUMNS)
                .orderBy(F.col("transaction_risk_score").desc(), "SalesOrderID"))


def vw_risk_level_summary(risk: DataFrame) -> DataFrame:
    """H3: per level count, share, total, average and maximum of the rounded value."""
    g = risk.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.sum(_cents()).alias("_s"),
        F.count("order_value").alias("_n"), F.max(_cents()).alias("_mx"))
    total = F.sum("transaction_count").over(_all_rows())
    return g.select(
        "risk_level", "transaction_count",
        share_pct("transaction_count", total).alias("percentage_of_transactions"),
        round_half_up(F.col("_s").cast("double") / 100, 2).alias("total_order_value"),
        _avg_money("_s", "_n").alias("avg_order_value"),
        round_half_up(F.col("_mx").cast("double") / 100, 2).alias("max_order_value"),
    )


def vw_customer_risk_summary(risk: DataFrame) -> DataFrame:
    """H4: per customer totals, scores, level counts and flag sums."""
    g = risk.groupBy("CustomerID").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum(_cents()).alias("_s"), F.count("order_value").alias("_n"),
        F.max("transaction_risk_score").alias("max_transaction_risk_score"),
        F.sum("transaction_risk_score").alias("_ss"), F.count("transaction_risk_score").alias("_sn"),
        F.sum(flag(F.col("risk_level") == K.LEVEL_HIGH)).cast("bigint").alias("high_risk_transactions"),
        F.sum(flag(F.col("risk_level") == K.LEVEL_MEDIUM)).cast("bigint").alias("medium_risk_transactions"),
        F.sum("same_day_repeat_flag").cast("bigint").alias("same_day_repeat_count"),
        F.sum("rapid_repeat_flag").cast("bigint").alias("rapid_repeat_count"),
        F.sum("amount_spike_flag").cast("bigint").alias("amount_spike_count"),
        F.sum("city_mismatch_flag").cast("bigint").alias("city_mismatch_count"),
        F.sum("state_mismatch_flag").cast("bigint").alias("state_mismatch_count"),
    )
    return g.select(
        "CustomerID", "total_transactions",
        round_half_up(F.col("_s").cast("double") / 100, 2).alias("total_order_value"),
        _avg_money("_s", "_n").alias("avg_order_value"),
        "max_transaction_risk_score",
        round_half_up(F.col("_ss").cast("double") / F.col("_sn").cast("double"), 2)
        .alias("avg_transaction_risk_score"),
        "high_risk_transactions", "medium_risk_transactions",
        "same_day_repeat_count", "rapid_repeat_count", "amount_spike_count",
        "city_mismatch_count", "state_mismatch_count",
    )


def top_customers(summary: DataFrame, n: int = 100) -> DataFrame:
    """Customers by High count, maximum score, Medium count."""
    return summary.orderBy(F.col("high_risk_transactions").desc(),
                           F.col("max_transaction_risk_score").desc(),
                           F.col("medium_risk_transactions").desc(),
                           F.col("CustomerID").asc_nulls_first()).limit(n)


# ---------------------------------------------------------------- I*

def vw_fraud_analytics_dataset(risk: DataFrame, *more: str) -> DataFrame:
    """The 36-column analytics dataset (one row per order), and ``more`` of the frame's own columns."""
    one = F.lit(1)
    velocity = flag((F.col("same_day_repeat_flag") == one) | (F.col("rapid_repeat_flag") == one))
    geo = flag((F.col("city_mismatch_flag") == one) | (F.col("state_mismatch_flag") == one))
    lvl = F.col("risk_level")
    return risk.select(
        "SalesOrderID", "CustomerID", "OrderDate",
        F.year("OrderDate").alias("order_year"), F.month("OrderDate").alias("order_month"),
        F.date_format("OrderDate", "yyyy-MM").alias("order_year_month"),
        "order_value", "OnlineOrderFlag", "CreditCardID", "previous_order_date",
        "days_since_previous_order", "prior_order_count", "prior_avg_order_value",
        "amount_vs_customer_avg", "billing_city", "billing_state", "shipping_city", "shipping_state",
        "same_day_repeat_flag", "rapid_repeat_flag", "amount_spike_flag", "city_mismatch_flag",
        "state_mismatch_flag",
        velocity.alias("velocity_risk_flag"), geo.alias("geographic_mismatch_flag"),
        (F.col("same_day_repeat_flag") + F.col("rapid_repeat_flag") + F.col("amount_spike_flag") + geo)
        .alias("risk_flag_count"),
        "velocity_risk_points", "behavioural_risk_points", "geographic_risk_points",
        "transaction_risk_score", "risk_dimension_count", "risk_level", "risk_reason",
        flag(lvl == K.LEVEL_HIGH).alias("high_risk_flag"),
        flag(lvl.isin(K.LEVEL_HIGH, K.LEVEL_MEDIUM)).alias("flagged_transaction_flag"),
        F.when(lvl == K.LEVEL_HIGH, 3).when(lvl == K.LEVEL_MEDIUM, 2).otherwise(1).alias("risk_level_order"), *more,
    )


def dataset_total(ds: DataFrame) -> DataFrame:
    """Total rows of the dataset."""
    return ds.agg(F.count(F.lit(1)).alias("total_transactions"))


def dataset_levels(ds: DataFrame) -> DataFrame:
    """Rows per level, High first."""
    return (ds.groupBy("risk_level", "risk_level_order").agg(F.count(F.lit(1)).alias("transaction_count"))
              .orderBy(F.col("risk_level_order").desc()).select("risk_level", "transaction_count"))


# Fixed columns of the published preview.
PREVIEW_COLUMNS = (
    "SalesOrderID", "CustomerID", "OrderDate", "order_year", "order_month", "order_year_month",
    "order_value", "days_since_previous_order", "prior_order_count", "prior_avg_order_value",
    "amount_vs_customer_avg", "velocity_risk_flag", "geographic_mismatch_flag", "risk_flag_count",
    "transaction_risk_score", "risk_dimension_count", "risk_level", "risk_reason",
)


def investigation_preview(ds: DataFrame, n: int = 100) -> DataFrame:
    """I4: flagged orders by score, dimensions, ratio, value; first n."""
    return (ds.where(F.col("flagged_transaction_flag") == 1).select(*PREVIEW_COLUMNS)
              .orderBy(F.col("transaction_risk_score").desc(), F.col("risk_dimension_count").desc(),
                       F.col("amount_vs_customer_avg").desc_nulls_last(),
                       F.col("order_value").desc_nulls_last(), F.col("SalesOrderID").asc())
              .limit(n))


def flagged_volume(ds: DataFrame) -> DataFrame:
    """Flagged orders with the High / Medium split."""
    return ds.where(F.col("flagged_transaction_flag") == 1).agg(
        F.count(F.lit(1)).alias("flagged_transactions"),
        F.sum(flag(F.col("risk_level") == K.LEVEL_HIGH)).cast("bigint").alias("high_risk_transactions"),
        F.sum(flag(F.col("risk_level") == K.LEVEL_MEDIUM)).cast("bigint").alias("medium_risk_transactions"),
    )


def monthly_risk(ds: DataFrame) -> DataFrame:
    """Per month total, flagged, High and flagged rate."""
    g = ds.groupBy("order_year_month").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("flagged_transaction_flag").cast("bigint").alias("flagged_transactions"),
        F.sum("high_risk_flag").cast("bigint").alias("high_risk_transactions"),
    )
    return g.select("order_year_month", "total_transactions", "flagged_transactions",
                    "high_risk_transactions",
                    share_pct("flagged_transactions", "total_transactions").alias("flagged_transaction_rate")
                    ).orderBy("order_year_month")
