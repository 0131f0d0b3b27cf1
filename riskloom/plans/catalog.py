"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each name is the operator's function name. The roles are bound from the
driver tables by :func:`riskloom.sources.binding.bind_driver_tables`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.caching import input_key, published_once, run_folder
from ..operators import audit, baselines, column_profile, geopay, history_state, marts, patterns, quality, scoring
from ..sources.binding import CORE_COLUMNS, SCORE_COLUMNS, TX_COLUMNS, bind_driver_tables, bind_events, bind_orders
from ..sources.io import mart_path, register_views, write_mart
from ..sources.warehouse import RISK_VIEWS, open_warehouse, publish_views, tables_like

Query = Callable[[SparkSession, str], DataFrame]


def _roles(spark, sf):
    return bind_driver_tables(spark, sf)


def _scoring_roles(spark, sf):
    # the score reads no due or ship date
    return bind_driver_tables(spark, sf, SCORE_COLUMNS)


def _risk(spark, sf):
    r = _scoring_roles(spark, sf)
    return scoring.score_transactions(r.tx, r.addr, RiskConfig())


def _scored(spark, sf):
    r = _scoring_roles(spark, sf)
    return scoring.score_frame(r.tx, r.addr, RiskConfig())


def _ds(spark, sf, deal=None):
    r = _scoring_roles(spark, sf)
    return marts.vw_fraud_analytics_dataset(scoring.score_transactions(r.tx, r.addr, RiskConfig(), deal))


def _tx(fn, *columns):
    """A query on the order role, bound with the columns it declares (all if none are named)."""
    return lambda spark, sf: fn(bind_orders(spark, sf, columns or TX_COLUMNS))


def _tx_addr(fn):
    def q(spark, sf):
        r = _scoring_roles(spark, sf)
        return fn(r.tx, r.addr)
    return q


def _on_risk(fn):
    return lambda spark, sf: fn(_risk(spark, sf))


def _on_ds(fn):
    return lambda spark, sf: fn(_ds(spark, sf))


def base_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    # A - source audit
    q["audit_tables"] = lambda s, sf: audit.audit_catalog(s, open_warehouse(s, sf).database)
    q["catalog_tables"] = lambda s, sf: tables_like(s, open_warehouse(s, sf).database, audit.SOURCE_PATTERNS)
    q["audit_columns"] = lambda s, sf: _inventory(s, sf).drop("approx_distinct")
    q["audit_distinct_estimates"] = lambda s, sf: _inventory(s, sf).select("table_name", "column_name", "approx_distinct")
    q["audit_distinct_error"] = lambda s, sf: column_profile.distinct_check(_inventory(s, sf), _roles(s, sf).tables())
    q["table_volumes"] = lambda s, sf: audit.table_volumes(_roles(s, sf).tables())
    q["transaction_coverage"] = _tx(audit.transaction_coverage, *CORE_COLUMNS)
    q["value_baseline"] = _tx(audit.value_baseline, *CORE_COLUMNS)
    q["customer_purchasing"] = _tx(audit.customer_purchasing, *CORE_COLUMNS)
    q["order_frequency_distribution"] = _tx(audit.order_frequency_distribution, *CORE_COLUMNS)
    q["customer_cards"] = lambda s, sf: (lambda r: audit.customer_cards(r.cust, r.bridge, r.card))(_roles(s, sf))
    q["order_locations"] = _tx_addr(audit.order_locations)
    # B - data quality
    q["duplicate_orders"] = _tx(quality.duplicate_orders, *CORE_COLUMNS)
    q["missing_core_fields"] = _tx(quality.missing_core_fields)
    q["invalid_values"] = _tx(quality.invalid_values, *CORE_COLUMNS)
    q["date_inconsistencies"] = _tx(quality.date_inconsistencies)
    q["orphan_customers"] = lambda s, sf: (lambda r: quality.orphan_customers(r.tx, r.cust))(
        bind_driver_tables(s, sf, CORE_COLUMNS))
    q["orphan_cards"] = lambda s, sf: (lambda r: quality.orphan_cards(r.tx, r.card))(_roles(s, sf))
    q["orphan_addresses"] = _tx_addr(quality.orphan_addresses)
    q["card_coverage"] = _tx(quality.card_coverage)
    q["customer_coverage"] = lambda s, sf: (lambda r: quality.customer_coverage(r.cust, r.tx))(_roles(s, sf))
    q["channel_coverage"] = _tx(quality.channel_coverage, *CORE_COLUMNS, "CreditCardID")
    # D - baselines
    q["order_sequence"] = _tx(baselines.order_sequence, *CORE_COLUMNS)
    q["previous_order"] = _tx(baselines.previous_order, *CORE_COLUMNS)
    q["historical_baseline"] = _tx(baselines.historical_baseline, *CORE_COLUMNS)
    q["largest_deviations"] = _tx(baselines.largest_deviations, *CORE_COLUMNS)
    # E - patterns
    q["transaction_timing"] = _tx(patterns.transaction_timing, *CORE_COLUMNS)
    q["gap_distribution"] = _tx(patterns.gap_distribution, *CORE_COLUMNS)
    q["rapid_repeats"] = _tx(patterns.rapid_repeats, *CORE_COLUMNS)
    q["amount_spikes"] = _tx(patterns.amount_spikes, *CORE_COLUMNS)
    q["pattern_indicators"] = _tx(patterns.pattern_indicators, *CORE_COLUMNS, "CreditCardID")
    # F - payment and geography
    q["location_relationship"] = _tx_addr(geopay.location_relationship)
    q["location_mismatches"] = _tx_addr(geopay.location_mismatches)
    q["card_verification"] = lambda s, sf: (lambda r: geopay.card_verification(r.tx, r.cust, r.bridge))(_roles(s, sf))
    q["shared_cards"] = lambda s, sf: (lambda r: geopay.shared_cards(r.bridge, r.cust, r.card))(_roles(s, sf))
    q["geographic_indicators"] = _tx_addr(geopay.geographic_indicators)
    # G - features and scoring
    q["risk_features"] = _tx_addr(scoring.risk_features)
    q["feature_distribution"] = _tx_addr(scoring.feature_distribution)
    q["multi_signal_transactions"] = _tx_addr(scoring.multi_signal_transactions)
    q["score_transactions"] = _tx_addr(scoring.score_transactions)
    q["risk_level_distribution"] = lambda s, sf: scoring.risk_level_distribution(_scored(s, sf))
    q["risk_score_distribution"] = lambda s, sf: scoring.risk_score_distribution(_scored(s, sf))
    q["incremental_risk"] = _incremental_risk
    q["customer_state"] = _customer_state
    # H - views
    q["vw_transaction_risk_analysis"] = _risk
    q["top_risk"] = _on_risk(marts.top_risk)
    q["risk_row_count"] = _on_risk(marts.risk_row_count)
    q["vw_high_risk_transactions"] = _on_risk(marts.vw_high_risk_transactions)
    q["vw_risk_level_summary"] = _on_risk(marts.vw_risk_level_summary)
    q["vw_customer_risk_summary"] = _on_risk(marts.vw_customer_risk_summary)
    q["top_customers"] = lambda s, sf: marts.top_customers(marts.vw_customer_risk_summary(_risk(s, sf)))
    # I - analytics dataset
    q["vw_fraud_analytics_dataset"] = _ds
    q["dataset_total"] = _on_ds(marts.dataset_total)
    q["dataset_levels"] = _on_ds(marts.dataset_levels)
    q["investigation_preview"] = _on_ds(marts.investigation_preview)
    q["flagged_volume"] = _on_ds(marts.flagged_volume)
    q["monthly_risk"] = _on_ds(marts.monthly_risk)
    # second binding: the same analyses over purchase events (no geography)
    q["score_events"] = lambda s, sf: scoring.score_transactions(bind_events(s, sf), _no_addresses(s))
    q["event_gap_distribution"] = lambda s, sf: patterns.gap_distribution(bind_events(s, sf))
    q["event_risk_level_distribution"] = lambda s, sf: scoring.risk_level_distribution(
        scoring.score_frame(bind_events(s, sf), _no_addresses(s)))
    # Views registered and read back through the SQL surface
    q["view_level_counts"] = _view_level_counts
    for view in RISK_VIEWS:
        q[f"stored_{view}"] = (lambda view: lambda s, sf: s.table(f"{publish_views(s, sf).database}.{view}"))(view)
    # the dataset written as a month-partitioned mart to the shared folder, read back
    q["mart_monthly_risk"] = _mart_monthly_risk
    return q


def _inventory(spark, sf):
    """A2 from stored profiles: orders by year of order, the other tables whole; the queries of an application share one scan."""
    def profiles():
        tables = _roles(spark, sf).tables()
        parts = [column_profile.profile_parts(tables[n], n, F.year("OrderDate") if n == "salesorderheader" else None) for n in audit.CORE_TABLES]
        return reduce(DataFrame.unionByName, parts)
    return column_profile.described(column_profile.united(published_once(spark, sf, "profiles", profiles)))


def _incremental_risk(spark, sf):
    """G1 year by year: each year scans its own orders and continues from the state of the years before.

    The orders are bound to their lines, customers and suppliers once and stored; the years read that table.
    """
    r = _scoring_roles(spark, sf)
    mart = history_state.RiskMart(spark, f"{run_folder(spark)}/risk-mart-{input_key(spark, sf)}")
    dates = bind_orders(spark, sf, CORE_COLUMNS).agg(F.min(F.year("OrderDate")).alias("lo"), F.max(F.year("OrderDate")).alias("hi")).first()
    done = mart.parts()
    for year in range(dates.lo, dates.hi + 1):
        if str(year) not in done:
            tx = published_once(spark, sf, "score-orders", lambda: r.tx)
            since, until = F.lit(f"{year}-01-01").cast("timestamp_ntz"), F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")
            own = (F.col("OrderDate") >= since) & (F.col("OrderDate") < until)
            mart.advance(str(year), tx.where(own | F.col("OrderDate").isNull() if year == dates.lo else own), r.addr)
    return mart.scored()


def _customer_state(spark, sf):
    """The state after all orders, merged from the states of two halves."""
    tx = bind_orders(spark, sf, CORE_COLUMNS)
    halves = [history_state.state_of(tx.where(F.pmod("SalesOrderID", F.lit(2)) == k)) for k in (0, 1)]
    return history_state.merged(*halves).select("CustomerID", "orders", "valued_orders", "total_cents", "max_cents", F.col("last.OrderDate").alias("last_order_date"))


def _no_addresses(spark):
    return spark.createDataFrame([], "AddressID bigint, City string, StateProvinceID int")


def _view_level_counts(spark, sf):
    # the views stack two deep, as in the published schema
    register_views(spark, {"vw_transaction_risk_analysis": _risk(spark, sf)})
    register_views(spark, {"vw_fraud_analytics_dataset": marts.vw_fraud_analytics_dataset(
        spark.table("vw_transaction_risk_analysis"))})
    return spark.sql("""
        SELECT risk_level, COUNT(*) AS transaction_count
        FROM vw_fraud_analytics_dataset
        GROUP BY risk_level, risk_level_order
        ORDER BY risk_level_order DESC""")


def _mart_monthly_risk(spark, sf):
    """The monthly report over the dataset written as a month-partitioned mart."""
    ds = _ds(spark, sf)
    path = mart_path(spark, f"fraud_dataset_{input_key(spark, sf)}")
    write_mart(ds, path, "order_year_month")
    return marts.monthly_risk(spark.read.schema(ds.schema).parquet(path))


def all_queries() -> dict[str, Query]:
    from . import catalog_models
    return base_queries() | catalog_models.model_queries()
