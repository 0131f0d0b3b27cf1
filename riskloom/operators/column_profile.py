"""Column profiles that merge: counts, least and greatest values, distinct sketches.

A profile has one row per (table, part, column). A part is any share of a
table's rows - a month, a load - profiled once, when it arrives. Profiles of
parts unite without reading the rows again: counts add, minima and maxima
nest, and HyperLogLog sketches merge into the sketch of the union, so a value
that occurs in many parts still counts once. A table of a hundred months
costs one scan of the new month.

Values are compared by kind: integers (and booleans, 0 or 1) as bigint,
fractions as double, dates, timestamps and all other kinds as text; dates and
timestamps are written in ISO form, whose order is the order of time. NaN is
the greatest double, as in Spark's own order. A column without values has no
minimum, no maximum and 0 distinct values.

The estimate's relative standard error is 1.04 / sqrt(2 ** log_registers):
0.82 % at 14. A sketch takes 2 ** log_registers bytes at most, whatever the
column holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_REGISTERS = 14
#: Three standard errors of the distinct estimate.
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LOG_REGISTERS / 2)
PROFILE_SCHEMA = (
    "table_name string, part string, column_name string, ordinal_position bigint, data_type string, row_count bigint, value_count bigint, "
    "min_integer bigint, max_integer bigint, min_double double, max_double double, min_text string, max_text string, sketch binary")
PROFILE_COLUMNS = tuple(c.split()[0] for c in PROFILE_SCHEMA.split(", "))


def _lanes(field: T.StructField) -> dict[str, Column]:
    """The column under the one lane in which its values are compared."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return {"integer": c.cast("bigint")}
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return {"double": c.cast("double") + F.lit(0.0)}  # -0.0 and 0.0 are one value
    if isinstance(kind, T.DateType):
        return {"text": F.date_format(c, "yyyy-MM-dd")}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return {"text": F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")}
    return {"text": c.cast("string") if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) else F.hex(c) if isinstance(kind, T.BinaryType) else F.to_json(c)}


def profile_parts(df: DataFrame, table_name: str, part: Column | None = None) -> DataFrame:
    """The profile of each part of ``df`` (``PROFILE_SCHEMA``): one scan, one partial aggregate per task.

    ``part`` gives a row's part (NULL is a part of its own, ``""``); without it the table is one part.
    """
    aggregates, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, field in enumerate(df.schema.fields):
        lane, value = next(iter(_lanes(field).items()))
        aggregates += [F.count(value).alias(f"_n{i}"), F.min(value).alias(f"_min{i}"), F.max(value).alias(f"_max{i}"),
                       F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), F.lit(LOG_REGISTERS)).alias(f"_s{i}")]
        bounds = [F.col(f"_{end}{i}").alias(f"{end}_{lane}") if other == lane else F.lit(None).cast(kind).alias(f"{end}_{other}")
                  for other, kind in (("integer", "bigint"), ("double", "double"), ("text", "string")) for end in ("min", "max")]
        rows.append(F.struct(F.lit(field.name).alias("column_name"), F.lit(i + 1).cast("bigint").alias("ordinal_position"),
                             F.lit(field.dataType.simpleString()).alias("data_type"), F.col("_rows").alias("row_count"),
                             F.col(f"_n{i}").alias("value_count"), *bounds, F.col(f"_s{i}").alias("sketch")))
    if part is None:
        grouped = df.agg(*aggregates).withColumn("part", F.lit(""))
    else:
        grouped = df.groupBy(F.coalesce(part.cast("string"), F.lit("")).alias("part")).agg(*aggregates)
    return grouped.select(F.lit(table_name).alias("table_name"), "part", F.explode(F.array(*rows)).alias("c")).select("table_name", "part", "c.*").select(
        *PROFILE_COLUMNS)


def united(parts: DataFrame) -> DataFrame:
    """One row per (table, column) from the profiles of any parts, with the sketches merged."""
    bounds = [f(f"{end}_{lane}").alias(f"{end}_{lane}") for lane in ("integer", "double", "text") for end, f in (("min", F.min), ("max", F.max))]
    return parts.groupBy("table_name", "column_name", "ordinal_position", "data_type").agg(
        F.sum("row_count").alias("row_count"), F.sum("value_count").alias("value_count"), *bounds, F.hll_union_agg("sketch").alias("sketch")).select(
        "table_name", F.lit("").alias("part"), *[c for c in PROFILE_COLUMNS if c not in ("table_name", "part")])


def described(profile: DataFrame) -> DataFrame:
    """Inventory rows of united profiles: NULL count, minimum and maximum as text, distinct estimate."""
    def text(end: str) -> Column:
        return F.coalesce(F.col(f"{end}_integer").cast("string"), F.when(F.col(f"{end}_double").isNotNull(), F.format_string("%.6f", f"{end}_double")), F.col(f"{end}_text"))
    known = F.col("value_count") > 0
    return profile.select(
        "table_name", "column_name", "ordinal_position", "data_type", (F.col("row_count") - F.col("value_count")).alias("null_count"),
        F.when(known, text("min")).alias("min_value"), F.when(known, text("max")).alias("max_value"),
        F.hll_sketch_estimate("sketch").alias("approx_distinct"))


class ProfileStore:
    """Profiles of parts as one Parquet table below ``path``; a part is written once and united on reading."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def add(self, df: DataFrame, table_name: str, part: Column | None = None) -> None:
        """Profiles the rows of ``df``, which must be new parts (or a whole table that has none stored)."""
        found = profile_parts(df, table_name, part)
        # the aggregate has one row per column and part: one small file per call
        found.coalesce(1).write.mode("append").parquet(self.path)

    def parts(self) -> DataFrame:
        return self.spark.read.schema(PROFILE_SCHEMA).parquet(self.path)

    def inventory(self) -> DataFrame:
        return described(united(self.parts()))


def distinct_check(inventory: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The exact distinct count of each profiled column, and whether the estimate lies within ``DISTINCT_ERROR`` of it.

    Every column is counted by grouping (column, value) pairs of one pass per
    table, so no plan multiplies the rows once more for each distinct count.
    """
    exact = None
    for name, df in tables.items():
        values = F.array(*[F.struct(F.lit(f.name).alias("column_name"), next(iter(_lanes(f).values())).cast("string").alias("value")) for f in df.schema.fields])
        counted = df.select(F.explode(values).alias("x")).select("x.*").groupBy("column_name", "value").agg(F.lit(1).alias("one")).groupBy("column_name").agg(
            F.count("value").alias("distinct_values")).select(F.lit(name).alias("table_name"), "column_name", "distinct_values")
        exact = counted if exact is None else exact.unionByName(counted)
    off = F.abs(F.col("approx_distinct") - F.col("distinct_values")).cast("double")
    return inventory.join(exact, ["table_name", "column_name"]).select(
        "table_name", "column_name", "distinct_values", (off <= F.ceil(F.col("distinct_values") * DISTINCT_ERROR)).cast("int").alias("within_error"))
