"""Contingency tables of any two columns.

Rows are first counted per pair of categories (partial aggregates; a pair that
holds a third of all rows is one row per task). The small pair table tells
which categories the column side has, NULL among them, and is then spread into
one column per category: the data is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.caching import materialise

#: A table with more columns is not a report; :func:`pair_counts` gives any number of pairs as rows.
MOST_COLUMNS = 1000
NULL_NAME = "null"


def pair_counts(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, count) of the pairs that occur; NULL is a category of its own."""
    return df.groupBy(F.col(f"`{row}`").alias("row"), F.col(f"`{column}`").alias("column")).agg(F.count(F.lit(1)).alias("count"))


def crosstab(df: DataFrame, row: str, column: str, prefix: str = "", categories: Sequence | None = None) -> DataFrame:
    """One row per category of ``row``, one bigint column ``prefix + category`` per category of ``column``.

    Columns are in order of their category, NULL (named ``null``) last; pairs
    that do not occur count 0. ``categories`` fixes the columns: then they are
    not learned, and other categories are left out.
    """
    pairs = pair_counts(df, row, column)
    if categories is None:
        pairs = materialise(pairs, "crosstab")  # a row per pair; read for the categories and for the table
        found = [r["column"] for r in pairs.select("column").distinct().limit(MOST_COLUMNS + 1).collect()]
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"{column} has more than {MOST_COLUMNS} categories: use pair_counts")
        categories = sorted((c for c in found if c is not None)) + [None] * (None in found)
    cells = [F.coalesce(F.sum(F.when(F.col("column").eqNullSafe(F.lit(c)), F.col("count"))), F.lit(0)).cast("bigint").alias(
        prefix + (NULL_NAME if c is None else str(c))) for c in categories]
    return pairs.groupBy(F.col("row").alias(row)).agg(*cells) if cells else pairs.groupBy(F.col("row").alias(row)).agg(F.first("row")).select(row)
