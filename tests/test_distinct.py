"""Distinct counts by bitmaps against sets."""

import random

from pyspark.sql import functions as F

from riskloom.functions import distinct
from riskloom.operators import audit, quality


def rows(n=8000):
    rng = random.Random(2)
    ids = [0, 1, -1, 32767, 32768, 32769, -32768, -32769, 2**40, -(2**40), 2**62, None]
    return [(rng.choice(ids) if rng.random() < 0.3 else rng.randrange(-3000, 90000), rng.choice(["a", "b", None]), rng.randrange(100)) for _ in range(n)]


def test_conditional_counts_equal_sets(spark):
    data = rows()
    df = spark.createDataFrame(data, "id long, g string, v int").repartition(5)
    where = {"every": None, "low": F.col("v") < 3, "none": F.col("v") > 1000, "unknown": F.lit(None).cast("boolean")}
    tests = {"every": lambda v: True, "low": lambda v: v < 3, "none": lambda v: False, "unknown": lambda v: False}
    whole = distinct.distinct_counts(df, "id", where).first().asDict()
    assert whole == {n: len({i for i, _, v in data if i is not None and f(v)}) for n, f in tests.items()}
    for row in distinct.distinct_counts(df, "id", where, ("g",)).collect():
        assert {n: row[n] for n in where} == {n: len({i for i, g, v in data if i is not None and g == row.g and f(v)}) for n, f in tests.items()}


def test_shared_counts_equal_sets(spark):
    one, two = rows(3000), rows(500) + [(200000 + i, "z", 0) for i in range(50)]
    found = distinct.shared_counts(spark.createDataFrame(one, "id long, g string, v int"), "id", spark.createDataFrame(two, "key long, g string, v int"), "key").first()
    a, b = {r[0] for r in one} - {None}, {r[0] for r in two} - {None}
    assert tuple(found) == (len(a), len(b), len(a & b))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long")
    assert tuple(distinct.distinct_counts(none, "id", {"n": None}).first()) == (0,)
    assert tuple(distinct.shared_counts(none, "id", none, "id").first()) == (0, 0, 0)
    tx = spark.createDataFrame([], "CustomerID long, OrderDate timestamp_ntz")
    assert tuple(audit.transaction_coverage(tx).first()) == (None, None, 0, 0)


def test_no_plan_multiplies_rows(spark):
    tx = spark.range(100).selectExpr("id AS CustomerID", "current_timestamp() AS OrderDate", "id AS CreditCardID", "id AS TotalDue", "1 AS OnlineOrderFlag")
    for df in (quality.customer_coverage(tx, tx), quality.channel_coverage(tx), audit.transaction_coverage(tx)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and "Join" not in plan


def test_orders_without_a_customer_count_as_orders(spark):
    tx = spark.sql("SELECT * FROM VALUES (CAST(NULL AS BIGINT), TIMESTAMP_NTZ '2020-01-01'), (5, TIMESTAMP_NTZ '2020-02-01'), (5, NULL) AS t(CustomerID, OrderDate)")
    found = audit.transaction_coverage(tx).first()
    assert (found.total_orders, found.active_customers, found.first_order_date.month, found.last_order_date.month) == (3, 1, 1, 2)
