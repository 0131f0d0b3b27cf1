"""C4-C8 flags, points, score, level, reason; G* features and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as K
from ..config import RiskConfig
from ..functions.numeric import cents_to_money, flag, round_half_up, share_pct
from .baselines import customer_history, money2
from .geopay import city_mismatch, state_mismatch, with_locations

# Fixed columns of the published risk view.
RISK_COLUMNS = (
    "SalesOrderID", "CustomerID", "OrderDate", "order_value", "OnlineOrderFlag", "CreditCardID",
    "previous_order_date", "days_since_previous_order", "prior_order_count",
    "prior_avg_order_value", "amount_vs_customer_avg",
    "billing_city", "billing_state", "shipping_city", "shipping_state",
    "same_day_repeat_flag", "rapid_repeat_flag", "amount_spike_flag",
    "city_mismatch_flag", "state_mismatch_flag",
    "velocity_risk_points", "behavioural_risk_points", "geographic_risk_points",
    "transaction_risk_score", "risk_dimension_count", "risk_level", "risk_reason",
)
FLAG_COLUMNS = ("same_day_repeat_flag", "rapid_repeat_flag", "amount_spike_flag",
                "city_mismatch_flag", "state_mismatch_flag")


def features(tx: DataFrame, addr: DataFrame, cfg: RiskConfig | None = None,
             rapid_from: int | None = None, with_max: bool = False, state: DataFrame | None = None, deal=None) -> DataFrame:
    """History, deviation, geography and the five 0/1 flags.

    ``deal`` lays the rows out anew where they are narrowest (:func:`customer_history`).
    ``rapid_from`` is 1 for scoring and 0 for the pattern / feature extracts
    that count same-day orders as rapid as well.
    """
    cfg = cfg or RiskConfig()
    lo = cfg.rapid_min_days if rapid_from is None else rapid_from
    h = customer_history(tx, cfg, with_max=with_max, state=state, deal=deal)
    return history_features(h, addr, cfg, lo)


def history_features(history: DataFrame, addr: DataFrame, cfg: RiskConfig, rapid_from: int) -> DataFrame:
    """C3-C4 on a customer history: geography and the five flags."""
    h = with_locations(history, addr)
    gap = F.col("days_since_previous_order")
    return h.withColumns({
        "same_day_repeat_flag": flag(gap == 0),
        "rapid_repeat_flag": flag(gap.between(rapid_from, cfg.rapid_max_days)),
        "amount_spike_flag": flag((F.col("prior_order_count") >= cfg.spike_min_prior)
                                  & (F.col("_ratio") >= cfg.spike_ratio)),
        "city_mismatch_flag": city_mismatch(),
        "state_mismatch_flag": state_mismatch(),
    })


def level_of(score: Column, cfg: RiskConfig) -> Column:
    return (F.when(score >= cfg.high_from, K.LEVEL_HIGH)
             .when(score.between(cfg.medium_from, cfg.high_from - 1), K.LEVEL_MEDIUM)
             .otherwise(K.LEVEL_LOW))


def with_score(f: DataFrame, cfg: RiskConfig) -> DataFrame:
    """C5-C8 on a frame that carries the five flags."""
    one = F.lit(1)
    same, rapid, spike = (F.col(c) == one for c in FLAG_COLUMNS[:3])
    city, state = F.col("city_mismatch_flag") == one, F.col("state_mismatch_flag") == one
    velocity = F.when(same, cfg.points_same_day).when(rapid, cfg.points_rapid).otherwise(0)
    behaviour = F.when(spike, cfg.points_spike).otherwise(0)
    geography = F.when(state, cfg.points_state).when(city, cfg.points_city).otherwise(0)
    s = f.withColumns({
        "velocity_risk_points": velocity,
        "behavioural_risk_points": behaviour,
        "geographic_risk_points": geography,
    })
    score = F.col("velocity_risk_points") + F.col("behavioural_risk_points") + F.col("geographic_risk_points")
    dims = flag(same | rapid) + F.col("amount_spike_flag") + flag(city | state)
    reason = F.concat_ws(
        ", ",
        F.when(same, K.REASON_SAME_DAY),
        F.when(rapid, K.REASON_RAPID),
        F.when(spike, K.REASON_SPIKE),
        F.when(state, K.REASON_STATE).when(city, K.REASON_CITY),
    )
    s = s.withColumns({"transaction_risk_score": score, "risk_dimension_count": dims})
    return s.withColumns({
        "risk_level": level_of(F.col("transaction_risk_score"), cfg),
        "risk_reason": F.coalesce(F.nullif(reason, F.lit("")), F.lit(K.REASON_NONE)),
    })


def score_frame(tx: DataFrame, addr: DataFrame, cfg: RiskConfig | None = None, state: DataFrame | None = None, deal=None) -> DataFrame:
    """Scored frame with the internal helper columns (_ratio, _prior_sum ...)."""
    cfg = cfg or RiskConfig()
    return with_score(features(tx, addr, cfg, state=state, deal=deal), cfg)


def risk_projection(scored: DataFrame, *more: str) -> DataFrame:
    """The 27 published columns (money rounded for display), and ``more`` of the frame's own."""
    return scored.select(
        "SalesOrderID", "CustomerID", "OrderDate",
        cents_to_money("TotalDue").alias("order_value"),
        "OnlineOrderFlag", "CreditCardID", "previous_order_date", "days_since_previous_order",
        "prior_order_count",
        money2("_prior_avg").alias("prior_avg_order_value"),
        money2("_ratio").alias("amount_vs_customer_avg"),
        "billing_city", "billing_state", "shipping_city", "shipping_state",
        *FLAG_COLUMNS,
        "velocity_risk_points", "behavioural_risk_points", "geographic_risk_points",
        "transaction_risk_score", "risk_dimension_count", "risk_level", "risk_reason", *more,
    )


def score_transactions(tx: DataFrame, addr: DataFrame, cfg: RiskConfig | None = None, deal=None) -> DataFrame:
    """G1: one scored row per order, 27 columns. Rows in == rows out."""
    return risk_projection(score_frame(tx, addr, cfg, deal=deal))


def ranked_risk(risk: DataFrame) -> DataFrame:
    """G1's published order: score, dimensions, ratio, value (desc), then id."""
    return risk.orderBy(F.col("transaction_risk_score").desc(), F.col("risk_dimension_count").desc(),
                        F.col("amount_vs_customer_avg").desc_nulls_last(),
                        F.col("order_value").desc(), F.col("SalesOrderID").asc())


# ---------------------------------------------------------------- G0, G0b, G0c

def risk_features(tx: DataFrame, addr: DataFrame, cfg: RiskConfig | None = None) -> DataFrame:
    """Feature table with prior maximum; rapid here counts gap 0-7."""
    f = features(tx, addr, cfg, rapid_from=0, with_max=True)
    return f.select(
        "SalesOrderID", "CustomerID", "OrderDate",
        cents_to_money("TotalDue").alias("order_value"),
        "OnlineOrderFlag", "CreditCardID", "previous_order_date", "days_since_previous_order",
        "prior_order_count",
        money2("_prior_avg").alias("prior_avg_order_value"),
        cents_to_money("_prior_max").alias("prior_max_order_value"),
        money2("_ratio").alias("amount_vs_customer_avg"),
        "billing_city", "billing_state", "shipping_city", "shipping_state",
        "same_day_repeat_flag", "rapid_repeat_flag", "amount_spike_flag",
        F.col("city_mismatch_flag").alias("billing_shipping_city_mismatch_flag"),
        F.col("state_mismatch_flag").alias("billing_shipping_state_mismatch_flag"),
    )


def _signal_count() -> Column:
    return sum((F.col(c) for c in FLAG_COLUMNS), F.lit(0))


def feature_distribution(tx: DataFrame, addr: DataFrame, cfg: RiskConfig | None = None) -> DataFrame:
    """Indicator totals and orders with two or more signals (rapid 1-7)."""
    cfg = cfg or RiskConfig()
    f = features(tx, addr, cfg)
    return f.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        *[F.sum(c).cast("bigint").alias(c.replace("_flag", "_count")) for c in FLAG_COLUMNS],
        F.sum(flag(_signal_count() >= cfg.multi_signal_from)).cast("bigint")
        .alias("transactions_with_multiple_signals"),
    )


def multi_signal_transactions(tx: DataFrame, addr: DataFrame, cfg: RiskConfig | None = None) -> DataFrame:
    """Orders with two or more of the five flags (city and state both count)."""
    cfg = cfg or RiskConfig()
    f = features(tx, addr, cfg).withColumn("signal_count", _signal_count())
    return (f.where(F.col("signal_count") >= cfg.multi_signal_from)
             .select("SalesOrderID", "CustomerID", "OrderDate",
                     cents_to_money("TotalDue").alias("order_value"),
                     "days_since_previous_order", money2("_ratio").alias("amount_vs_customer_avg"),
                     *FLAG_COLUMNS, "signal_count"))


# ---------------------------------------------------------------- G2, G3

def _level_rank() -> Column:
    return (F.when(F.col("risk_level") == K.LEVEL_HIGH, 1)
             .when(F.col("risk_level") == K.LEVEL_MEDIUM, 2).otherwise(3))


def risk_level_distribution(scored: DataFrame) -> DataFrame:
    """Per level count, share, total and average of the *raw* value.

    ``scored`` is :func:`score_frame` output (TotalDue in cents).
    """
    g = scored.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("TotalDue").alias("_cents"),
        F.count("TotalDue").alias("_nn"),
    )
    total = F.sum("transaction_count").over(_all_rows())
    return (g.select(
        "risk_level", "transaction_count",
        share_pct("transaction_count", total).alias("percentage_of_transactions"),
        round_half_up(F.col("_cents").cast("double") / 100, 2).alias("total_order_value"),
        round_half_up(F.col("_cents").cast("double") / (F.col("_nn") * 100).cast("double"), 2)
        .alias("avg_order_value"),
    ).orderBy(_level_rank()))


def _all_rows():
    from pyspark.sql import Window
    # the frame is the aggregated result: at most a handful of rows
    return Window.partitionBy()


def risk_score_distribution(scored: DataFrame) -> DataFrame:
    """Per score count and share."""
    g = scored.groupBy("transaction_risk_score").agg(F.count(F.lit(1)).alias("transaction_count"))
    total = F.sum("transaction_count").over(_all_rows())
    return (g.select("transaction_risk_score", "transaction_count",
                     share_pct("transaction_count", total).alias("percentage_of_transactions"))
             .orderBy(F.col("transaction_risk_score").desc()))
