"""Reading the driver tables, shared-folder tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, **options: object) -> DataFrame:
    """The frame written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a write's shuffle files go as soon as the write has ended: what they led to is stored.

    A lost executor still costs no more than its own tasks: while a write runs
    its shuffles are kept, and afterwards nothing reads them.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def size_in_bytes(df: DataFrame) -> int:
    """The planner's estimate of a frame's bytes (file sizes for a scan); sets partition counts only."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(spark: SparkSession, n_bytes: int, each: int) -> int:
    """Partitions so that each holds about ``each`` bytes, at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))


def all_stars(links: DataFrame) -> bool:
    """Whether of distinct links (u, v) every u has one v and no v is a u."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (src, dst): the smallest node reachable.

    Alternating large-star and small-star steps. Each is a group minimum (with
    map-side combine) joined back to the edges, so a hub's edges are never in
    one task: the join is left to skew splitting. The edge set of each round is
    written to the shared folder. The rounds end as soon as all that is left are
    stars, which another round would not change.
    """
    links = edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    links = written(links, "links")
    while not all_stars(links):
        # large star: every larger neighbour is hung on the smallest of the closed neighbourhood
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: the smaller neighbours are hung on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        links = written(small, "links")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
