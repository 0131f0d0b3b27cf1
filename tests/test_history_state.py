"""State and new part against the full scan, value by value."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from riskloom.operators import baselines, history_state, scoring

SCHEMA = ("SalesOrderID bigint, CustomerID bigint, OrderDate timestamp_ntz, DueDate timestamp_ntz, ShipDate timestamp_ntz, TotalDue bigint, OnlineOrderFlag int, "
          "CreditCardID bigint, BillToAddressID bigint, ShipToAddressID bigint")


def orders(n=3000):
    """One customer with most orders, orders without customer, date or value, and ties of dates."""
    rng = random.Random(8)
    rows = []
    for i in range(n):
        day = datetime.datetime(2021, 1, 1) + datetime.timedelta(days=rng.randrange(400))
        customer = 1 if rng.random() < 0.4 else rng.choice([None, *range(2, 60)])
        rows.append((i, customer, None if rng.random() < 0.02 else day, None, None, None if rng.random() < 0.05 else rng.randrange(-500, 90000), i % 2, None, i % 3, i % 4))
    return rows


@pytest.fixture(scope="module")
def tx(spark):
    return spark.createDataFrame(orders(), SCHEMA)


@pytest.fixture(scope="module")
def addr(spark):
    return spark.createDataFrame([(0, "a", 1), (1, "b", 1), (2, "c", 2)], "AddressID bigint, City string, StateProvinceID int")


def as_rows(df):
    return sorted(map(str, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


def month(df, name):
    return df.where(F.coalesce(F.date_format("OrderDate", "yyyy-MM"), F.lit("2021-01")) == name)


def test_state_and_new_part_equal_the_full_scan(tx):
    late = F.col("OrderDate") >= F.lit("2021-08-01").cast("timestamp_ntz")
    old, new = tx.where(~F.coalesce(late, F.lit(False))), tx.where(late)
    for options in ({}, {"with_max": False}, {"with_previous_value": True}):
        whole = baselines.customer_history(tx, **options).where(late)
        part = baselines.customer_history(new, state=history_state.state_of(old), **options)
        assert as_rows(part) == as_rows(whole) and whole.count() > 500


def test_states_merge_in_any_grouping(tx):
    whole = history_state.state_of(tx)
    parts = [history_state.state_of(tx.where(F.col("SalesOrderID") % 5 == k)) for k in range(5)]
    assert as_rows(history_state.merged(*parts)) == as_rows(whole)
    assert as_rows(history_state.merged(history_state.merged(*parts[:2]), *parts[2:])) == as_rows(whole)


def test_mart_by_months_equals_scoring_at_once(spark, tx, addr, tmp_path):
    mart = history_state.RiskMart(spark, str(tmp_path / "mart"))
    assert mart.parts() == [] and mart.state() is None
    names = sorted({r[0] for r in tx.select(F.coalesce(F.date_format("OrderDate", "yyyy-MM"), F.lit("2021-01"))).distinct().collect()})[:4] + ["rest"]
    for name in names:
        rows = month(tx, name) if name != "rest" else tx.where(F.date_format("OrderDate", "yyyy-MM") > names[-2])
        mart.advance(name, rows, addr)
    assert mart.parts() == names
    whole = scoring.score_transactions(tx, addr)
    assert as_rows(mart.scored()) == as_rows(whole)
    assert as_rows(mart.state()) == as_rows(history_state.state_of(tx))
    mart.advance("rest", tx.where(F.date_format("OrderDate", "yyyy-MM") > names[-2]), addr)  # the last part again
    assert as_rows(mart.scored()) == as_rows(whole)
    with pytest.raises(ValueError):
        mart.advance(names[0], month(tx, names[0]), addr)


def test_a_broken_part_is_not_done(spark, tx, addr, tmp_path):
    mart = history_state.RiskMart(spark, str(tmp_path / "mart"))
    mart.advance("2021-01", month(tx, "2021-01"), addr)
    spark.range(3).write.parquet(str(tmp_path / "mart" / "scored" / "part=2021-02"))  # a run that ended before the state
    assert mart.parts() == ["2021-01"]
    assert mart.scored().count() == month(tx, "2021-01").count()
    mart.advance("2021-02", month(tx, "2021-02"), addr)
    assert mart.scored().count() == month(tx, "2021-01").count() + month(tx, "2021-02").count()


def test_empty_part(spark, tx, addr, tmp_path):
    mart = history_state.RiskMart(spark, str(tmp_path / "mart"))
    mart.advance("1", tx.where("false"), addr)
    mart.advance("2", tx, addr)
    assert as_rows(mart.scored()) == as_rows(scoring.score_transactions(tx, addr))


def test_years_read_the_bound_orders_not_the_lines_again(spark, monkeypatch):
    """Orders are joined to their lines once; a year's step reads that table alone."""
    from riskloom.plans import catalog
    read = []
    advance = history_state.RiskMart.advance

    def spied(self, part, tx, addr):
        read.append({f for f in tx.inputFiles() if "lineitem" in f})
        advance(self, part, tx, addr)
    monkeypatch.setattr(history_state.RiskMart, "advance", spied)
    monkeypatch.setattr(catalog, "input_key", lambda *a, own=uuid.uuid4().hex: f"read-test-{own}")  # a mart of its own
    assert catalog._incremental_risk(spark, "/root/testdata/sf0.001").count() == 1500
    assert len(read) == 7 and not any(read)
