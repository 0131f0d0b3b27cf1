"""D* and E* on the hand-made branch matrix (expected values derived by hand)."""

from riskloom.operators import baselines, patterns
from tests.fixtures import tx_frame


def _by_id(df):
    return {r.SalesOrderID: r for r in df.collect()}


def test_order_sequence_and_previous_order(spark):
    tx = tx_frame(spark)
    seq = _by_id(baselines.order_sequence(tx))
    assert [seq[i].customer_order_number for i in (101, 102, 103, 108)] == [1, 2, 3, 8]
    assert {seq[i].customer_total_orders for i in range(101, 109)} == {8}
    assert seq[203].customer_total_orders == 3 and seq[402].customer_order_number == 2
    prev = _by_id(baselines.previous_order(tx))
    assert prev[101].previous_order_date is None and prev[101].value_vs_previous_order is None
    assert prev[103].previous_order_value == 100.0 and prev[103].value_vs_previous_order == 3.0
    assert prev[202].value_vs_previous_order == 100.0
    assert prev[302].value_vs_previous_order is None          # previous value 0 -> NULL, no error


def test_historical_baseline(spark):
    hb = _by_id(baselines.historical_baseline(tx_frame(spark)))
    r = hb[104]
    assert (r.prior_order_count, r.prior_avg_order_value, r.prior_max_order_value) == (3, 166.67, 300.0)
    assert r.amount_above_customer_avg == 433.33 and r.amount_vs_customer_avg == 3.6
    assert hb[101].prior_max_order_value is None and hb[101].prior_avg_order_value is None
    top = baselines.largest_deviations(tx_frame(spark), n=2).collect()
    assert [t.SalesOrderID for t in top] == [104, 103]       # 3.6, then 3.0 (203 shows 3.0 too: id breaks tie)


def test_patterns(spark):
    tx = tx_frame(spark)
    rapid = {r.SalesOrderID for r in patterns.rapid_repeats(tx).collect()}
    assert rapid == {102, 103, 104, 202, 203, 402}                 # gap 0-7, first orders excluded
    spikes = {r.SalesOrderID for r in patterns.amount_spikes(tx).collect()}
    assert spikes == {103, 104}                                    # 203 is 2.996 -> no spike
    pi = _by_id(patterns.pattern_indicators(tx))
    assert set(pi) == {102, 103, 104, 202, 203, 402}
    assert (pi[104].same_day_repeat_flag, pi[104].rapid_repeat_flag, pi[104].amount_spike_flag) == (1, 1, 1)
