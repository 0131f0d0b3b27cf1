"""Physical-plan properties that matter at scale (checked on sf0.001)."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from riskloom.functions import scan, two_way
from riskloom.functions.ranking import average_rank_pct
from riskloom.operators import audit, marts, scoring
from riskloom.sources.binding import SCORE_COLUMNS, bind_driver_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def unwritten(monkeypatch):
    """Plans in one piece: intermediate tables are not written."""
    for module in (scan, two_way):
        monkeypatch.setattr(module, "materialise", lambda df, label: df)


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_scoring_plan_has_one_range_exchange_and_no_customer_window(spark, unwritten):
    r = bind_driver_tables(spark, SF, SCORE_COLUMNS)
    p = _plan(scoring.score_transactions(r.tx, r.addr))
    # the history is a range exchange on (customer, date, id) ...
    assert re.search(r"rangepartitioning\(CustomerID", p)
    # ... and never a window over the data partitioned by customer
    assert not re.search(r"Window \[.*CustomerID#\d+L?\], \[OrderDate", p)
    # column pruning reaches the scans: no dates, quantities or prices of lines
    line_schema = re.search(r"lineitem.parquet\]\n.*\nReadSchema: (struct<[^>]*>)", p)
    assert line_schema
    for column in ("l_quantity", "l_extendedprice", "l_shipdate"):
        assert column not in line_schema.group(1)


@pytest.mark.parametrize("name", [
    "transaction_coverage", "value_baseline", "customer_purchasing", "order_frequency_distribution", "duplicate_orders",
    "invalid_values", "orphan_customers", "order_sequence", "previous_order", "historical_baseline",
    "largest_deviations", "transaction_timing", "gap_distribution", "rapid_repeats", "amount_spikes"])
def test_order_questions_do_not_scan_the_lines(spark, unwritten, name):
    p = _plan(E.queries()[name](spark, SF))
    assert "orders.parquet" in p and "lineitem.parquet" not in p and "supplier.parquet" not in p


def test_column_audit_scans_each_table_once_per_role(spark):
    roles = bind_driver_tables(spark, SF)
    p = _plan(audit.audit_columns({"salesorderdetail": roles.detail}))
    assert p.count("lineitem.parquet") == 1


def test_monthly_summary_aggregates_partially_before_the_shuffle(spark):
    r = bind_driver_tables(spark, SF, SCORE_COLUMNS)
    p = _plan(marts.monthly_risk(marts.vw_fraud_analytics_dataset(scoring.score_transactions(r.tx, r.addr))))
    assert "partial_count" in p and "hashpartitioning(order_year_month" in p


def test_rank_has_no_single_partition_exchange_over_rows(spark, unwritten):
    df = spark.range(0, 5000).selectExpr("id", "cast(id % 97 as double) as x")
    p = _plan(average_rank_pct(df, "x", "pct"))
    assert "rangepartitioning(__rk_none" in p and "__rk_value" in p
    assert p.count("rangepartitioning(") == 1 and "hashpartitioning" not in p and "SortMergeJoin" not in p  # the only join is the broadcast of a row per partition


def test_nothing_stays_in_the_block_stores(spark):
    spark.catalog.clearCache()
    for name in ("historical_baseline", "ratio_percentile_rank", "export_dataset_standin"):
        E.queries()[name](spark, SF).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
