"""Tables bucketed by a key, so that joins on the key move no rows.

Each table is hashed into the same number of buckets when it is written - the
one exchange it ever needs - and registered in the session's catalog with its
folder in the shared space. A join of two such tables on their key reads
bucket by bucket: task k reads bucket k of both. A bucket is one file, written
by one task; a lost task is run again from the files.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .caching import STORED_CODEC, input_key, is_written, run_folder

BUCKET_BYTES = 128 << 20
#: A table of many more files costs its readers more than larger buckets do.
MOST_BUCKETS = 1 << 16


def bucket_count(df: DataFrame) -> int:
    """Buckets of about ``BUCKET_BYTES`` of what ``df`` reads, at least the session's shuffle partitions.

    The files' sizes count, not the planner's size of the result: a join's is the product of its sides.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // BUCKET_BYTES), MOST_BUCKETS))


def write_bucketed(df: DataFrame, name: str, key: str | tuple[str, ...], buckets: int, dealt: bool = False) -> DataFrame:
    """Writes ``df`` bucketed and sorted by ``key`` (one column or several) as table ``name``, and reads it back.

    With ``dealt`` the rows lie in their buckets already (the write sorts each). Were they moved since, a bucket
    would have several files, with the same rows.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}"
    keys = (key,) if isinstance(key, str) else key
    quoted = [f"`{k}`" for k in keys]
    spread = df if dealt else df.repartition(buckets, *quoted).sortWithinPartitions(*quoted)
    spread.write.mode("overwrite").format("parquet").option("compression", STORED_CODEC).bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def table_name(spark: SparkSession, folder: str, name: str) -> str:
    """A catalog name for a table that this application derives from this state of ``folder``."""
    return re.sub(r"\W", "_", f"riskloom_{name}_{input_key(spark, folder)}_{spark.sparkContext.applicationId}").lower()


def buckets_of(spark: SparkSession, table: str) -> int:
    """The number of buckets of a table of the catalog."""
    return int(spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()["data_type"])


def bucketed_once(spark: SparkSession, folder: str, name: str, key: str, build: Callable[..., DataFrame], like: str | None = None, early: bool = False) -> DataFrame:
    """A bucketed table that the queries of an application share: written at first use of this state of ``folder``.

    ``like`` is the name of another such table, whose number of buckets it takes. With ``early``, ``build`` is given a
    function that deals rows out into the buckets, to be called once, where the rows are narrowest: columns derived
    afterwards do not pass the exchange.
    """
    table = table_name(spark, folder, name)
    if not (spark.catalog.tableExists(table) and is_written(spark, f"{run_folder(spark)}/{table}")):
        if early:
            counts: list[int] = []

            def deal(rows: DataFrame) -> DataFrame:
                counts.append(bucket_count(rows))
                return rows.repartition(counts[0], f"`{key}`")
            df = build(deal)
            return write_bucketed(df, table, key, counts[0], dealt=True)
        df = build()
        return write_bucketed(df, table, key, buckets_of(spark, table_name(spark, folder, like)) if like else bucket_count(df))
    return spark.table(table)
