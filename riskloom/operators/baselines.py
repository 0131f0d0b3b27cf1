"""C1-C2 customer history and the D* baseline analyses.

History is "strictly earlier orders of the same customer" in the order
(OrderDate, SalesOrderID). It is computed once by the skew-proof prefix scan
(:mod:`riskloom.functions.scan`), so a customer holding a third of all orders
is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.numeric import cents_to_money, round_half_up
from ..functions.scan import ScanSpec, prefix_scan
from .history_state import with_state

HISTORY_KEYS = ["CustomerID"]
HISTORY_ORDER = ["OrderDate", "SalesOrderID"]


def customer_history(tx: DataFrame, cfg: RiskConfig | None = None,
                     with_max: bool = True, with_previous_value: bool = False, state: DataFrame | None = None,
                     deal=None) -> DataFrame:
    """C1 + C2: add previous order, prior count / sum / max, gap and ratio.

    With ``state`` (:mod:`riskloom.operators.history_state`) ``tx`` holds only
    orders after those behind the state, and their history continues from it.
    ``deal(rows)`` lays the rows out anew before columns are derived from them.

    Added columns: previous_order_date, _previous_cents, prior_order_count,
    _prior_nn, _prior_sum, _prior_max (cents), days_since_previous_order,
    _prior_avg (money, unrounded), _ratio (value / prior average, unrounded).
    """
    cfg = cfg or RiskConfig()
    spec = ScanSpec(
        count_as="prior_order_count",
        sums={"_prior_sum": "TotalDue"},
        nonnull={"_prior_nn": "TotalDue"},
        maxes={"_prior_max": "TotalDue"} if with_max else {},
        lags={"previous_order_date": "OrderDate",
              **({"_previous_cents": "TotalDue"} if with_previous_value else {})},
    )
    h = prefix_scan(tx, HISTORY_KEYS, HISTORY_ORDER, spec, cfg.history_partitions)
    if state is not None:
        h = with_state(h, state)
    if deal is not None:
        h = deal(h)
    nn = F.col("_prior_nn")
    return h.withColumns({
        "days_since_previous_order": F.datediff("OrderDate", "previous_order_date"),
        "_prior_avg": F.when(nn > 0, F.col("_prior_sum").cast("double") / (nn * 100).cast("double")),
        # value / (sum / n) computed as (value * n) / sum: exact integers, one rounding
        "_ratio": F.when(nn > 0, (F.col("TotalDue") * nn).cast("double")
                         / F.nullif(F.col("_prior_sum"), F.lit(0)).cast("double")),
    })


def order_value() -> Column:
    return cents_to_money("TotalDue").alias("order_value")


def money2(c) -> Column:
    return round_half_up(c, 2)


def order_sequence(tx: DataFrame, cfg: RiskConfig | None = None) -> DataFrame:
    """Order number within the customer and the customer's order total."""
    cfg = cfg or RiskConfig()
    spec = ScanSpec(count_as="_before")
    h = prefix_scan(tx.select("SalesOrderID", "CustomerID", "OrderDate", "TotalDue"),
                    HISTORY_KEYS, HISTORY_ORDER, spec, cfg.history_partitions)
    totals = tx.groupBy("CustomerID").agg(F.count(F.lit(1)).alias("customer_total_orders"))
    # one row per customer on the small side; a hot customer on the big side is
    # split by AQE's skew-join handling
    return h.join(totals, h["CustomerID"].eqNullSafe(totals["CustomerID"]), "left").select(
        "SalesOrderID", h["CustomerID"], "OrderDate", order_value(),
        (F.col("_before") + 1).alias("customer_order_number"),
        "customer_total_orders",
    )


def previous_order(tx: DataFrame, cfg: RiskConfig | None = None) -> DataFrame:
    """Previous order date and value, gap, value / previous value."""
    h = customer_history(tx, cfg, with_max=False, with_previous_value=True)
    return h.select(
        "SalesOrderID", "CustomerID", "OrderDate", "previous_order_date",
        "days_since_previous_order", order_value(),
        cents_to_money("_previous_cents").alias("previous_order_value"),
        money2(F.col("TotalDue").cast("double")
               / F.nullif(F.col("_previous_cents"), F.lit(0)).cast("double"))
        .alias("value_vs_previous_order"),
    )


def _baseline_cols(with_max: bool):
    cols = [
        "SalesOrderID", "CustomerID", "OrderDate", order_value(), "prior_order_count",
        money2("_prior_avg").alias("prior_avg_order_value"),
    ]
    if with_max:
        cols.append(cents_to_money("_prior_max").alias("prior_max_order_value"))
    return cols


def historical_baseline(tx: DataFrame, cfg: RiskConfig | None = None) -> DataFrame:
    """D3: prior count, average and maximum; difference and ratio to the average."""
    h = customer_history(tx, cfg)
    nn = F.col("_prior_nn")
    above = F.when(nn > 0, (F.col("TotalDue") * nn - F.col("_prior_sum")).cast("double")
                   / (nn * 100).cast("double"))
    return h.select(
        *_baseline_cols(True),
        money2(above).alias("amount_above_customer_avg"),
        money2("_ratio").alias("amount_vs_customer_avg"),
    )


def largest_deviations(tx: DataFrame, n: int = 100, cfg: RiskConfig | None = None) -> DataFrame:
    """Orders with at least two prior orders, top n by the rounded ratio."""
    cfg = cfg or RiskConfig()
    h = customer_history(tx, cfg, with_max=False)
    out = h.where(F.col("prior_order_count") >= cfg.spike_min_prior).select(
        *_baseline_cols(False), money2("_ratio").alias("amount_vs_customer_avg"))
    return out.orderBy(F.col("amount_vs_customer_avg").desc_nulls_last(),
                       F.col("SalesOrderID").asc()).limit(n)
