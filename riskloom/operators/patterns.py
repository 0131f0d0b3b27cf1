"""E* transaction timing and pattern analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.numeric import flag
from .baselines import _baseline_cols, customer_history, money2, order_value

# Fixed labels of the gap segments (published order).
GAP_SEGMENTS = ("First order", "Same day", "1-7 days", "8-30 days", "31-90 days", "More than 90 days")


def _timing(tx: DataFrame, cfg: RiskConfig | None) -> DataFrame:
    h = customer_history(tx.select("SalesOrderID", "CustomerID", "OrderDate", "TotalDue"), cfg,
                         with_max=False)
    return h.select("SalesOrderID", "CustomerID", "OrderDate", "previous_order_date",
                    "days_since_previous_order", order_value())


def transaction_timing(tx: DataFrame, cfg: RiskConfig | None = None) -> DataFrame:
    """Gap in calendar days to the customer's previous order."""
    return _timing(tx, cfg)


def gap_segment(gap) -> F.Column:
    g = F.col(gap) if isinstance(gap, str) else gap
    return (F.when(g.isNull(), GAP_SEGMENTS[0])
             .when(g == 0, GAP_SEGMENTS[1])
             .when(g.between(1, 7), GAP_SEGMENTS[2])
             .when(g.between(8, 30), GAP_SEGMENTS[3])
             .when(g.between(31, 90), GAP_SEGMENTS[4])
             .otherwise(GAP_SEGMENTS[5]))


def gap_distribution(tx: DataFrame, cfg: RiskConfig | None = None) -> DataFrame:
    """Orders per gap segment; first orders form their own segment."""
    t = _timing(tx, cfg)
    return (t.groupBy(gap_segment("days_since_previous_order").alias("order_gap_segment"))
             .agg(F.count(F.lit(1)).alias("transaction_count"))
             .orderBy(F.col("transaction_count").desc(), "order_gap_segment"))


def rapid_repeats(tx: DataFrame, cfg: RiskConfig | None = None) -> DataFrame:
    """Repeat orders within 7 days (same day included)."""
    cfg = cfg or RiskConfig()
    t = _timing(tx, cfg)
    return (t.where(F.col("previous_order_date").isNotNull()
                    & (F.col("days_since_previous_order") <= cfg.rapid_max_days))
             .orderBy("days_since_previous_order", "CustomerID", "OrderDate", "SalesOrderID"))


def _spike_cond(cfg: RiskConfig):
    return (F.col("prior_order_count") >= cfg.spike_min_prior) & (F.col("_ratio") >= cfg.spike_ratio)


def amount_spikes(tx: DataFrame, cfg: RiskConfig | None = None) -> DataFrame:
    """At least two prior orders and value >= 3x the prior average (unrounded)."""
    cfg = cfg or RiskConfig()
    h = customer_history(tx, cfg, with_max=False)
    return (h.where(_spike_cond(cfg))
             .select(*_baseline_cols(False), money2("_ratio").alias("amount_vs_customer_avg"))
             .orderBy(F.col("amount_vs_customer_avg").desc(), "SalesOrderID"))


def pattern_indicators(tx: DataFrame, cfg: RiskConfig | None = None) -> DataFrame:
    """E5: orders with gap 0-7 or a spike; here rapid means 0-7 days."""
    cfg = cfg or RiskConfig()
    h = customer_history(tx, cfg, with_max=False)
    gap = F.col("days_since_previous_order")
    fast = gap.between(0, cfg.rapid_max_days)
    spike = _spike_cond(cfg)
    out = h.where(fast | spike).select(
        "SalesOrderID", "CustomerID", "OrderDate", order_value(), "OnlineOrderFlag", "CreditCardID",
        "days_since_previous_order", "prior_order_count",
        money2("_prior_avg").alias("prior_avg_order_value"),
        money2("_ratio").alias("amount_vs_customer_avg"),
        flag(gap == 0).alias("same_day_repeat_flag"),
        flag(fast).alias("rapid_repeat_flag"),
        flag(spike).alias("amount_spike_flag"),
    )
    return out.orderBy(F.col("amount_spike_flag").desc(), F.col("same_day_repeat_flag").desc(),
                       F.col("rapid_repeat_flag").desc(), F.col("amount_vs_customer_avg").desc(),
                       "SalesOrderID")
