"""R* dashboard datasets: the tables behind the five report pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up, to_cents
from ..functions.ranking import value_positions
from .patterns import gap_segment


def overview_kpis(export: DataFrame) -> DataFrame:
    """Total, flagged, High and model-eligible orders."""
    return export.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("flagged_transaction_flag").cast("bigint").alias("flagged_transactions"),
        F.sum("high_risk_flag").cast("bigint").alias("high_risk_transactions"),
        F.sum("model_eligible_flag").cast("bigint").alias("model_eligible_transactions"),
    )


def investigation_queue(export: DataFrame, scores=None, reasons=None) -> DataFrame:
    """Flagged orders for review, optionally filtered by score and reason."""
    q = export.where(F.col("flagged_transaction_flag") == 1)
    if scores is not None:
        q = q.where(F.col("transaction_risk_score").isin(list(scores)))
    if reasons is not None:
        q = q.where(F.col("risk_reason").isin(list(reasons)))
    return (q.select("transaction_risk_score", "risk_level", "risk_reason", "behaviour_anomaly_percentile",
                     "SalesOrderID", "CustomerID", "order_value", "days_since_previous_order",
                     "prior_order_count", "amount_vs_customer_avg")
             .orderBy(F.col("transaction_risk_score").desc(),
                      F.col("behaviour_anomaly_percentile").desc_nulls_last(), "SalesOrderID"))


def behaviour_dashboard(export: DataFrame) -> DataFrame:
    """Per gap segment rows, flagged, behaviour top 5 %, mean ratio."""
    g = export.groupBy(gap_segment("days_since_previous_order").alias("order_gap_segment")).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("flagged_transaction_flag").cast("bigint").alias("flagged_transactions"),
        F.sum("behaviour_top_5pct").cast("bigint").alias("behaviour_top_5pct"),
        F.sum("amount_spike_flag").cast("bigint").alias("amount_spikes"),
        F.sum(to_cents("amount_vs_customer_avg")).alias("_r"), F.count("amount_vs_customer_avg").alias("_rn"),
    )
    return g.select("order_gap_segment", "transactions", "flagged_transactions", "behaviour_top_5pct",
                    "amount_spikes",
                    round_half_up(F.col("_r").cast("double") / (F.col("_rn") * 100).cast("double"), 2)
                    .alias("avg_amount_vs_customer_avg")).orderBy("order_gap_segment")


def geography_dashboard(export: DataFrame) -> DataFrame:
    """Per billing / shipping place pair: rows, mismatches, value and flagged value."""
    g = export.groupBy("billing_city", "shipping_city").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("geographic_mismatch_flag").cast("bigint").alias("mismatch_transactions"),
        F.sum(to_cents("order_value")).alias("_v"),
        F.sum(F.when(F.col("flagged_transaction_flag") == 1, to_cents("order_value"))).alias("_fv"),
    )
    # share of all flagged value: the total is one number read as a scalar
    # (place pairs can be many, so no single-partition window over them)
    fv_total = export.agg(F.sum(F.when(F.col("flagged_transaction_flag") == 1,
                                       to_cents("order_value"))).alias("t")).first()["t"]
    total = F.lit(float(fv_total) if fv_total else None).cast("double")
    return g.select("billing_city", "shipping_city", "transactions", "mismatch_transactions",
                    (F.col("_v").cast("double") / 100).alias("total_order_value"),
                    (F.coalesce(F.col("_fv"), F.lit(0)).cast("double") / 100).alias("flagged_order_value"),
                    round_half_up(F.coalesce(F.col("_fv"), F.lit(0)).cast("double") * 100
                                  / total.cast("double"), 2).alias("flagged_value_share"))


def customer_dashboard(export: DataFrame) -> DataFrame:
    """Per customer exposure, flagged value and anomaly percentiles."""
    g = export.groupBy("CustomerID").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum(to_cents("order_value")).alias("_v"),
        F.sum(F.when(F.col("flagged_transaction_flag") == 1, to_cents("order_value"))).alias("_fv"),
        F.sum("flagged_transaction_flag").cast("bigint").alias("flagged_transactions"),
        F.sum("high_risk_flag").cast("bigint").alias("high_risk_transactions"),
        F.max("transaction_risk_score").alias("max_transaction_risk_score"),
        # mean percentile from integer billionths: the sum does not depend on row order
        F.sum(F.floor(F.col("behaviour_anomaly_percentile") * 1e9 + 0.5).cast("bigint")).alias("_mps"),
        F.count("behaviour_anomaly_percentile").alias("_mpn"),
        F.max("behaviour_anomaly_percentile").alias("_xp"),
    )
    return g.select("CustomerID", "transactions", (F.col("_v").cast("double") / 100).alias("total_order_value"),
                    (F.coalesce(F.col("_fv"), F.lit(0)).cast("double") / 100).alias("flagged_order_value"),
                    "flagged_transactions", "high_risk_transactions", "max_transaction_risk_score",
                    round_half_up(F.col("_mps").cast("double") / (F.col("_mpn") * 1e9), 4)
                    .alias("avg_behaviour_percentile"),
                    round_half_up("_xp", 4).alias("max_behaviour_percentile")
                    ).orderBy(F.col("flagged_order_value").desc(), "CustomerID")


# Lower ends of the ratio bands; the first band holds what is below 1.
RATIO_BANDS = (1.0, 2.0, 3.0, 5.0)


def ratio_bands(export: DataFrame) -> DataFrame:
    """Orders, repeat orders and flagged orders per band of the ratio to the customer's average."""
    ratio = F.col("amount_vs_customer_avg")
    band = F.when(ratio.isNull(), -1).otherwise(sum((F.when(ratio >= lo, 1).otherwise(0) for lo in RATIO_BANDS), F.lit(0)))
    return export.groupBy(band.cast("int").alias("ratio_band")).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("same_day_repeat_flag").cast("bigint").alias("same_day_repeats"),
        F.sum("rapid_repeat_flag").cast("bigint").alias("rapid_repeats"),
        F.sum("flagged_transaction_flag").cast("bigint").alias("flagged_transactions"))


def geography_by_state(export: DataFrame) -> DataFrame:
    """Per side (billing, shipping) and state: orders, mismatches and value."""
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_state").alias("state"))
                                for side in ("billing", "shipping")]))
    return export.select(sides.alias("s"), "geographic_mismatch_flag", "flagged_transaction_flag", "order_value").groupBy(
        F.col("s.side").alias("side"), F.col("s.state").alias("state")).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("geographic_mismatch_flag").cast("bigint").alias("mismatch_transactions"),
        F.sum("flagged_transaction_flag").cast("bigint").alias("flagged_transactions"),
        (F.sum(to_cents("order_value")).cast("double") / 100).alias("total_order_value"))


def customer_ranking(export: DataFrame) -> DataFrame:
    """Customers by flagged value, highest first, with their rank (equal values share it).

    The rank is the number of customers with a higher value plus one, from the
    distributed positions of the distinct values.
    """
    c = customer_dashboard(export).select("CustomerID", "transactions", "flagged_order_value")
    c = c.withColumn("_v", -to_cents("flagged_order_value"))
    at = value_positions(c, "_v").select(F.col("__rk_value").alias("_w"), (F.col("__rk_before") + 1).alias("customer_rank"))
    return c.join(at, F.col("_v") == F.col("_w")).select("customer_rank", "CustomerID", "transactions", "flagged_order_value")
