"""X5-X8 sources and sinks: CSV hand-over, views, partitioned marts."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_dataset_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and an explicit schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).csv(path)


class WrongHeader(ValueError):
    """A file whose header is not the schema's list of columns."""


class TooManyRejects(ValueError):
    """More malformed records than the caller allows."""


@dataclass(frozen=True)
class CheckedCsv:
    """A CSV hand-over sorted into good rows and rejects, both stored below ``path``."""

    spark: SparkSession
    path: str
    schema: T.StructType

    def _side(self, rejected: bool) -> DataFrame:
        fields = T.StructType([*self.schema.fields, T.StructField(CORRUPT, T.StringType()), T.StructField("_file", T.StringType()),
                               T.StructField("_rejected", T.BooleanType())])
        return self.spark.read.schema(fields).parquet(self.path).where(F.col("_rejected") == F.lit(rejected))

    @property
    def good(self) -> DataFrame:
        return self._side(False).select(*[f"`{c}`" for c in self.schema.fieldNames()])

    @property
    def rejects(self) -> DataFrame:
        """(file, record): every malformed record as it stands in its file."""
        return self._side(True).select(F.col("_file").alias("file"), F.col(CORRUPT).alias("record"))

    def counts(self) -> DataFrame:
        """(file, good_rows, rejected_rows)."""
        every = self._side(False).select("_file", "_rejected").unionByName(self._side(True).select("_file", "_rejected"))
        return every.groupBy(F.col("_file").alias("file")).agg(F.count_if(~F.col("_rejected")).alias("good_rows"), F.count_if("_rejected").alias("rejected_rows"))


def read_checked_csv(spark: SparkSession, path: str, schema: T.StructType, store: str, max_rejected_share: float | None = None,
                     multi_line: bool = False) -> CheckedCsv:
    """X5 with a reject path: one scan that sorts the records of CSV files under ``path`` into ``store``.

    Every file's header must name the schema's columns in order, else
    :class:`WrongHeader` is raised and nothing is kept as read. A record with
    missing or surplus fields, or with a field that does not parse as its
    column's type, is rejected with its text and file; the others are good. An
    empty text reads as NULL, as CSV does not tell them apart. A header-only
    file has no rows. With ``max_rejected_share`` a larger share of
    rejects raises :class:`TooManyRejects` (good rows and rejects stay stored).
    Records with line breaks inside quotes need ``multi_line``, which reads a
    file in one task.
    """
    fields = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields] + [T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(fields).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT).option("multiLine", multi_line)
    rows = reader.csv(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col(CORRUPT).isNotNull().alias("_rejected"))
    try:
        # rejects lie beside the good rows in a folder of their own, so neither is read for the other
        rows.write.mode("overwrite").partitionBy("_rejected").parquet(store)
    except (PySparkException, Py4JJavaError) as error:
        said = [line.strip() for line in str(error).splitlines() if "CSV header" in line]
        if said:
            raise WrongHeader(said[0]) from error
        raise
    found = CheckedCsv(spark, store, T.StructType(fields.fields[:-1]))
    if max_rejected_share is not None:
        sums = found.counts().agg(F.sum("good_rows").alias("good"), F.sum("rejected_rows").alias("rejected")).first()
        if sums.rejected and sums.rejected > max_rejected_share * (sums.good + sums.rejected):
            raise TooManyRejects(f"{sums.rejected} of {sums.good + sums.rejected} records are malformed; see {store}")
    return found


def write_dataset_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and no index column (one file per partition)."""
    # rebalance: AQE sizes the write tasks (no flood of tiny files, no giant task)
    df.hint("rebalance").write.mode(mode).option("header", True).csv(path)


def register_views(spark: SparkSession, views: dict[str, DataFrame]) -> None:
    """Create-or-replace temporary views (read back with ``spark.table``)."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def write_mart(df: DataFrame, path: str, partition_by: str | None = "order_year_month",
               mode: str = "overwrite", dealt: bool = False) -> None:
    """Persist a mart as Parquet, partitioned for month-pruned reads; ``dealt`` rows are laid out for it already."""
    # rebalance by the partition column: each task writes few months (few
    # files), and AQE splits a month that holds a large share of the rows
    if dealt:
        df.write.mode(mode).partitionBy(*([partition_by] if partition_by else [])).parquet(path)
    elif partition_by:
        df.hint("rebalance", partition_by).write.mode(mode).partitionBy(partition_by).parquet(path)
    else:
        df.hint("rebalance").write.mode(mode).parquet(path)


def mart_path(spark: SparkSession, name: str) -> str:
    """A folder for a written mart inside the shared checkpoint folder."""
    import os
    import uuid
    from ..session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), "marts", f"{name}-{uuid.uuid4().hex[:8]}")
