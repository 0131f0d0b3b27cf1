"""Values at the edges: rows without a score, NaN ranks, large integers, large keys, no shared folder."""

import math

import pytest

from riskloom import session
from riskloom.functions.ranking import average_rank_pct
from riskloom.functions.scan import ScanSpec, prefix_scan
from riskloom.operators import compare, forest
from riskloom.sources.binding import first_lines


def test_rows_without_a_score_are_neither_normal_nor_anomalies(spark):
    ds = spark.createDataFrame(
        [(1, 0, None, None, None, 5.0, 1), (2, 3, 4.0, 10, 2.0, 8.0, 1), (3, 2, None, 4, 0.0, 9.0, 0)],
        "SalesOrderID long, prior_order_count long, amount_vs_customer_avg double, days_since_previous_order int, "
        "prior_avg_order_value double, order_value double, OnlineOrderFlag int")
    rows = {r.SalesOrderID: r for r in compare.model_scores(ds, "ratio").collect()}
    assert set(rows) == {2, 3}
    assert (rows[2].anomaly_prediction, rows[2].anomaly_flag, rows[2].top_1pct_anomaly) == (-1, 1, 1)
    assert (rows[3].anomaly_prediction, rows[3].anomaly_flag, rows[3].top_1pct_anomaly) == (None, None, None)
    counts = forest.eligibility_counts(ds).first()
    assert (counts.first_transactions, counts.model_rows, counts.unscored_rows) == (1, 2, 1)
    by_flag = {r.anomaly_flag: r.transaction_count for r in compare.flag_rate(compare.model_results(ds, "ratio")).collect()}
    assert by_flag == {1: 1, None: 1}


def test_nan_has_no_rank(spark):
    df = spark.createDataFrame([(1, 1.0), (2, math.nan), (3, None), (4, 3.0)], "id long, x double")
    got = {r.id: r.pct for r in average_rank_pct(df, "x", "pct").collect()}
    assert got == {1: 0.5, 2: None, 3: None, 4: 1.0}


def test_running_maximum_is_exact_above_2_to_53(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(1, 1, big), (1, 2, None), (1, 3, 5), (2, 1, -big)], "k long, o long, v long")
    got = {(r.k, r.o): r.m for r in prefix_scan(df, ["k"], ["o"], ScanSpec(count_as="n", maxes={"m": "v"})).collect()}
    assert got == {(1, 1): None, (1, 2): big, (1, 3): big, (2, 1): None}


def test_supplier_keys_beyond_the_packing_raise(spark):
    schema = "l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate timestamp_ntz"
    fine = spark.createDataFrame([(1, 2, 7, None), (1, 1, 2**32 - 1, None), (2, 1, None, None)], schema)
    assert {r.l_orderkey: r.CreditCardID for r in first_lines(fine).collect()} == {1: 2**32 - 1, 2: None}
    for key in (2**32, -1):
        with pytest.raises(Exception, match="supplier key outside"):
            first_lines(spark.createDataFrame([(1, 1, key, None)], schema)).collect()


def test_a_cluster_without_a_shared_folder_raises(spark, monkeypatch):
    class Context:
        master = "spark://somewhere"
        _jsc = spark.sparkContext._jsc

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})

    monkeypatch.setattr(Context, "_jsc", type("J", (), {"sc": lambda self: type("S", (), {
        "getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})())
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
