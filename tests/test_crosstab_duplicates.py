"""Contingency tables and exact duplicates against plain counting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.operators import crosstab, profile

SCHEMA = "a string, b int, c double, d string"


def rows(n=3000):
    rng = random.Random(4)
    return [(rng.choice(["x", "y", None]), rng.choice([1, 2, 3, None, 1, 1]), rng.choice([None, 0.5, float(rng.randrange(50))]), rng.choice(["", None, "p", "q" * 40])) for _ in range(n)]


def test_crosstab_learns_categories_and_keeps_null(spark):
    data = rows()
    found = crosstab.crosstab(spark.createDataFrame(data, SCHEMA), "a", "b", "b_")
    assert found.columns == ["a", "b_1", "b_2", "b_3", "b_null"]
    pairs = Counter((r[0], r[1]) for r in data)
    assert {r.a: tuple(r)[1:] for r in found.collect()} == {a: tuple(pairs[a, b] for b in (1, 2, 3, None)) for a in ("x", "y", None)}
    fixed = crosstab.crosstab(spark.createDataFrame(data, SCHEMA), "a", "b", "b_", categories=(2, 9))
    assert {r.a: (r.b_2, r.b_9) for r in fixed.collect()} == {a: (pairs[a, 2], 0) for a in ("x", "y", None)}


def test_crosstab_of_nothing_and_of_too_much(spark, monkeypatch):
    assert crosstab.crosstab(spark.createDataFrame([], SCHEMA), "a", "b").columns == ["a"]
    monkeypatch.setattr(crosstab, "MOST_COLUMNS", 3)
    with pytest.raises(ValueError):
        crosstab.crosstab(spark.createDataFrame(rows(), SCHEMA), "a", "c")


def test_exact_duplicates_equal_counting(spark):
    data = rows(2000) + [("only", 77, 1.25, "once")]
    counted = {r: n for r, n in Counter(data).items() if n > 1}
    found = {tuple(r)[:4]: r.copies for r in profile.exact_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert found == counted
    row = profile.duplicate_profile(spark.createDataFrame(data, SCHEMA), "b").first()
    assert row.exact_duplicate_rows == len(data) - len(set(data)) and row.duplicate_ids == len(data) - len({r[1] for r in data})


def test_rows_that_share_a_fingerprint_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(profile, "fingerprint", lambda df: [F.lit(1).alias("_fp1"), F.lit(2).alias("_fp2")])
    data = rows(500)
    found = {tuple(r)[:4]: r.copies for r in profile.exact_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert found == {r: n for r, n in Counter(data).items() if n > 1}


def test_only_fingerprints_are_exchanged_for_grouping(spark):
    plan = profile.exact_duplicates(spark.range(1000).selectExpr("id AS k", "cast(id AS string) AS wide"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_fp1" in plan


def test_types_and_preview(spark):
    df = spark.createDataFrame([(3, None), (1, "a"), (2, "b")], "SalesOrderID int, t string")
    assert [tuple(r) for r in profile.dataset_types(df).collect()] == [(1, "SalesOrderID", "int", 3), (2, "t", "string", 2)]
    assert [r.SalesOrderID for r in profile.dataset_preview(df, 2).collect()] == [1, 2]
