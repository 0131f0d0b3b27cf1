"""Exact counts of distinct integers by merged bitmaps.

``COUNT(DISTINCT a), COUNT(DISTINCT CASE WHEN c THEN a END)`` in one query makes
Spark multiply the rows, one copy per count (an Expand), and shuffle the
distinct pairs. Here an id's bucket holds 32,768 neighbouring ids; each task
sets one bit per id in a 4 KB bitmap per bucket and count, the bitmaps of a
bucket are or-ed after one exchange, and the bits are summed. All counts over
one column - under any number of conditions - share that pass, an id that
occurs a billion times is one bit, and what is exchanged is at most 4 KB per
bucket, count and task.

Which ids two tables share comes from and-ing their bitmaps bucket by bucket,
so no id is joined.

Ids are integers of any sign; NULL is not counted. Bitmaps suit ids that are
dense in places, as assigned keys are; ids spread over the whole 64-bit range
(hashes) would cost 4 KB each, so group those plainly.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = "bucket"


def bitmaps(df: DataFrame, column: str | Column, where: Mapping[str, Column | None], groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, bucket, one bitmap per name): the ids of ``column`` that fulfil each condition (None: all)."""
    x = F.col(column) if isinstance(column, str) else column
    rows = df.where(x.isNotNull()).select(*groups, F.bitmap_bucket_number(x).alias(BUCKET), F.bitmap_bit_position(x).alias("_bit"),
                                          *[c.alias(f"_{n}") for n, c in where.items() if c is not None])
    return rows.groupBy(*groups, BUCKET).agg(*[
        F.bitmap_construct_agg(F.col("_bit") if c is None else F.when(F.col(f"_{n}"), F.col("_bit"))).alias(n) for n, c in where.items()])


def distinct_counts(df: DataFrame, column: str | Column, where: Mapping[str, Column | None], groups: tuple[str, ...] = ()) -> DataFrame:
    """One row (one per group) with a distinct count per name of ``where``."""
    maps = bitmaps(df, column, where, groups)
    counts = [F.coalesce(F.sum(F.bitmap_count(n)), F.lit(0)).cast("bigint").alias(n) for n in where]
    return maps.groupBy(*groups).agg(*counts) if groups else maps.agg(*counts)


def shared_counts(one: DataFrame, one_column: str, two: DataFrame, two_column: str) -> DataFrame:
    """One row (in_one, in_two, in_both): distinct ids of either table and of both, from their bitmaps alone."""
    maps = bitmaps(one, one_column, {"ids": None}).withColumn("table", F.lit(1)).unionByName(
        bitmaps(two, two_column, {"ids": None}).withColumn("table", F.lit(2)))
    # two rows at most per bucket: one bitmap of each table
    buckets = maps.groupBy(BUCKET).agg(
        F.sum(F.when(F.col("table") == 1, F.bitmap_count("ids"))).alias("in_one"), F.sum(F.when(F.col("table") == 2, F.bitmap_count("ids"))).alias("in_two"),
        F.when(F.count(F.lit(1)) == 2, F.bitmap_count(F.bitmap_and_agg("ids"))).alias("in_both"))
    return buckets.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in ("in_one", "in_two", "in_both")])
