"""P* exploratory profile of the analytics dataset (the notebook's first half).

Every statistic is a distributed aggregate. Exact percentiles and medians come
from :mod:`riskloom.functions.quantiles` (all columns in shared passes); no
single task holds a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as K
from ..functions.numeric import round_half_up, to_cents
from ..functions import quantiles
from ..functions.ranking import equal_width_histogram

NUMERIC_COLUMNS = ("order_value", "days_since_previous_order", "prior_order_count",
                   "prior_avg_order_value", "amount_vs_customer_avg", "transaction_risk_score")
FLAGS = ("same_day_repeat_flag", "rapid_repeat_flag", "amount_spike_flag",
         "city_mismatch_flag", "state_mismatch_flag")
# Fixed velocity segments: right-closed bins (-1,0] (0,7] (7,30] (30,90] (90,inf)
VELOCITY_SEGMENTS = (("Same day", 0), ("1-7 days", 7), ("8-30 days", 30), ("31-90 days", 90),
                     ("More than 90 days", None))
VALUE_PERCENTILES = (0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
RATIO_PERCENTILES = (0.50, 0.75, 0.90, 0.95, 0.99)
QUARTILES = (0.25, 0.50, 0.75)
# What P4, P7, P10, P11 and P12 ask of the dataset's numeric columns, answered by shared passes.
PROFILED = {c: QUARTILES for c in NUMERIC_COLUMNS} | {
    "order_value": VALUE_PERCENTILES, "amount_vs_customer_avg": (0.25, *RATIO_PERCENTILES), "days_since_previous_order": VALUE_PERCENTILES}


def dataset_shape(ds: DataFrame) -> DataFrame:
    """Rows and columns."""
    return ds.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(ds.columns)).cast("bigint"))


def dataset_types(ds: DataFrame) -> DataFrame:
    """Columns in order with their type and the number of values (one aggregate)."""
    counts = ds.agg(*[F.count(f"`{c}`").alias(f"_{i}") for i, c in enumerate(ds.columns)])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(i + 1).cast("bigint").alias("ordinal_position"), F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"_{i}").alias("non_null_count"))
        for i, f in enumerate(ds.schema.fields)])).alias("c")).select("c.*").orderBy("ordinal_position")


def dataset_preview(ds: DataFrame, n: int = 5, key: str = "SalesOrderID") -> DataFrame:
    """The first ``n`` rows by key, all columns (each task keeps its own first ``n``)."""
    return ds.orderBy(key).limit(n)


def fingerprint(df: DataFrame) -> list:
    """128 bits of a row's values, with its NULLs' places, as two bigints."""
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in df.columns])
    return [F.xxhash64(F.lit(lane), nulls, *[f"`{c}`" for c in df.columns]).alias(f"_fp{lane}") for lane in (1, 2)]


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, each once with its number of copies (``copies``).

    Rows are grouped by fingerprint first: 16 bytes a row, combined before the
    shuffle. Only rows whose fingerprint occurs again are compared in full,
    which also tells apart different rows that share one.
    """
    marked = df.select("*", *fingerprint(df))
    again = marked.groupBy("_fp1", "_fp2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_fp1", "_fp2")
    return marked.join(again, ["_fp1", "_fp2"], "left_semi").groupBy(*[f"`{c}`" for c in df.columns]).agg(
        F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicate_profile(ds: DataFrame, key: str = "SalesOrderID") -> DataFrame:
    """Rows repeating an earlier row exactly, and repeated ids."""
    exact = exact_duplicates(ds).agg(F.sum(F.col("copies") - 1).alias("v")).withColumn("m", F.lit("exact"))
    ids = ds.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("v")).withColumn("m", F.lit("ids"))
    both = exact.unionByName(ids)
    return both.agg(*[F.coalesce(F.max(F.when(F.col("m") == m, F.col("v"))), F.lit(0)).cast("bigint").alias(name)
                      for m, name in (("exact", "exact_duplicate_rows"), ("ids", "duplicate_ids"))])


def missing_summary(ds: DataFrame) -> DataFrame:
    """NULL count and share per column, only columns with NULLs, most first."""
    cols = ds.columns
    one = ds.agg(F.count(F.lit(1)).alias("__n"),
                 *[(F.count(F.lit(1)) - F.count(F.col(c))).alias(f"__m{i}") for i, c in enumerate(cols)])
    long = one.select("__n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"__m{i}").alias("missing_count"))
        for i, c in enumerate(cols)])).alias("s")).select("__n", "s.*")
    return (long.where(F.col("missing_count") > 0)
                .select("column_name", "missing_count",
                        round_half_up(F.col("missing_count").cast("double") * 100 / F.col("__n").cast("double"), 2)
                        .alias("missing_percentage"))
                .orderBy(F.col("missing_count").desc(), "column_name"))


def numeric_table(ds: DataFrame, wanted=PROFILED) -> DataFrame:
    """Moments and exact quantiles of the numeric columns as (column_name, statistic, percentile, value)."""
    return quantiles.profile_table(ds, wanted)


def describe_numeric(ds: DataFrame, cols=NUMERIC_COLUMNS, table: DataFrame | None = None) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max per column (2 places)."""
    table = numeric_table(ds, {c: QUARTILES for c in cols}) if table is None else table

    def one(statistic: str, percentile: float | None = None):
        here = F.col("statistic") == statistic
        return F.max(F.when(here & (F.col("percentile") == percentile) if percentile is not None else here, F.col("value")))
    named = {"mean": one("mean"), "std": one("std"), "min": one("min"), "p25": one("quantile", 0.25), "p50": one("quantile", 0.5),
             "p75": one("quantile", 0.75), "max": one("max")}
    return table.where(F.col("column_name").isin(*cols)).groupBy("column_name").agg(
        one("count").cast("bigint").alias("count"), *[round_half_up(v, 2).alias(n) for n, v in named.items()]).orderBy("column_name")


def value_shares(ds: DataFrame, col: str) -> DataFrame:
    """P5: share of rows per value (``value_counts(normalize=True)``)."""
    g = ds.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # the total is one number (an aggregate read as a scalar), so a column
    # with many distinct values never meets in one task
    total = ds.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return g.select("value", (F.col("n").cast("double") / F.lit(float(total or 0))).alias("share")
                    ).orderBy(F.col("share").desc(), "value")


def top_values(ds: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The n most frequent values."""
    return (ds.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), F.col("value").asc_nulls_first()).limit(n))


def percentile_profile(ds: DataFrame, col: str, probs=VALUE_PERCENTILES, digits: int = 2, table: DataFrame | None = None) -> DataFrame:
    """``describe(percentiles=...)`` as (statistic, value) rows."""
    table = numeric_table(ds, {col: probs}) if table is None else table
    name = F.when(F.col("percentile").isNull(), F.col("statistic")).otherwise(
        F.concat(F.format_number(F.col("percentile") * 100, 0), F.lit("%")))
    asked = F.col("percentile").isNull() | F.col("percentile").isin(*[float(p) for p in probs])
    return table.where((F.col("column_name") == col) & asked).select(name.alias("statistic"), round_half_up("value", digits).alias("value"))


def histogram(ds: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram over the column's range."""
    return equal_width_histogram(ds, col, bins)


def with_log_value(ds: DataFrame) -> DataFrame:
    """Adds ``log_order_value = log1p(order_value)``."""
    return ds.withColumn("log_order_value", F.log1p("order_value"))


def log_value_histogram(ds: DataFrame, bins: int = 50) -> DataFrame:
    """Histogram of the log value."""
    return equal_width_histogram(with_log_value(ds), "log_order_value", bins)


def trimmed_histogram(ds: DataFrame, col: str = "amount_vs_customer_avg", upper_p: float = 0.99,
                      marker: float = K.SPIKE_RATIO, bins: int = 50, table: DataFrame | None = None) -> DataFrame:
    """Histogram of values in [0, p99]; flags the bin holding the marker."""
    if table is None:
        hi = quantiles.numeric_profile(ds, {col: [upper_p]})[col]["quantiles"][upper_p]
    else:
        hi = table.where((F.col("column_name") == col) & (F.col("percentile") == upper_p)).first()["value"]
    if hi is None:
        return equal_width_histogram(ds.where(F.lit(False)), col, bins, marker=marker)
    kept = ds.where(F.col(col).between(0, hi))
    return equal_width_histogram(kept, col, bins, marker=marker)


def velocity_segment():
    """The label of a row's gap; NULL for first orders."""
    g = F.col("days_since_previous_order")
    seg = None
    for label, upper in VELOCITY_SEGMENTS:
        cond = g <= upper if upper is not None else g.isNotNull()
        seg = F.when(cond, label) if seg is None else seg.when(cond, label)
    return seg


def velocity_segments(ds: DataFrame) -> DataFrame:
    """Five fixed gap segments; first orders (NULL gap) are left out."""
    g, seg = F.col("days_since_previous_order"), velocity_segment()
    counts = (ds.where(g > -1).groupBy(seg.alias("_seg")).agg(F.count(F.lit(1)).alias("_n")))
    spark = ds.sparkSession
    order = spark.createDataFrame([(i + 1, s) for i, (s, _) in enumerate(VELOCITY_SEGMENTS)],
                                  "segment_order int, segment string")
    # five labels on one side, at most five groups on the other
    return (order.join(F.broadcast(counts), F.col("segment") == F.col("_seg"), "left")
                 .select("segment_order", "segment",
                         F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("transaction_count"))
                 .orderBy("segment_order"))


def indicator_totals(ds: DataFrame) -> DataFrame:
    """How often each of the five indicators fires, most frequent first."""
    one = ds.agg(*[F.sum(c).cast("bigint").alias(c) for c in FLAGS])
    long = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("indicator"), F.col(c).alias("total")) for c in FLAGS])).alias("s"))
    return long.select("s.*").orderBy(F.col("total").desc(), "indicator")


def score_counts(ds: DataFrame) -> DataFrame:
    """Rows per rule score."""
    return (ds.groupBy("transaction_risk_score").agg(F.count(F.lit(1)).alias("transaction_count"))
              .orderBy("transaction_risk_score"))


def level_counts(ds: DataFrame) -> DataFrame:
    """Rows per level in the fixed order High, Medium, Low (missing: 0)."""
    counts = ds.groupBy(F.col("risk_level").alias("_lvl")).agg(F.count(F.lit(1)).alias("_n"))
    spark = ds.sparkSession
    order = spark.createDataFrame([(1, K.LEVEL_HIGH), (2, K.LEVEL_MEDIUM), (3, K.LEVEL_LOW)],
                                  "level_order int, risk_level string")
    return (order.join(F.broadcast(counts), F.col("risk_level") == F.col("_lvl"), "left")
                 .select("level_order", "risk_level",
                         F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("transaction_count"))
                 .orderBy("level_order"))


def _scaled_mean(col: str, digits: int = 2):
    # exact mean of a two-decimal column: integer hundredths, one division
    return round_half_up(F.sum(to_cents(col)).cast("double") / (F.count(col) * 100).cast("double"), digits)


def behaviour_by_level(ds: DataFrame) -> DataFrame:
    """Per level count, mean and median value, mean gap, ratio and score."""
    g = ds.groupBy("risk_level").agg(
        F.count("SalesOrderID").alias("transaction_count"),
        _scaled_mean("order_value").alias("avg_order_value"),
        round_half_up(F.sum("days_since_previous_order").cast("double")
                      / F.count("days_since_previous_order").cast("double"), 2)
        .alias("avg_days_since_previous_order"),
        _scaled_mean("amount_vs_customer_avg").alias("avg_amount_vs_customer_avg"),
        round_half_up(F.sum("transaction_risk_score").cast("double")
                      / F.count("transaction_risk_score").cast("double"), 2).alias("avg_risk_score"),
    )
    levels = (K.LEVEL_HIGH, K.LEVEL_MEDIUM, K.LEVEL_LOW)
    med = quantiles.quantiles_by_group(ds, F.col("risk_level"), levels, {"order_value": (0.5,)}).select(
        F.col("group").alias("_lvl"), round_half_up("value", 2).alias("median_order_value"))
    j = g.join(F.broadcast(med), F.col("risk_level") == F.col("_lvl"), "left")  # three rows
    return j.select("risk_level", "transaction_count", "avg_order_value", "median_order_value",
                    "avg_days_since_previous_order", "avg_amount_vs_customer_avg", "avg_risk_score"
                    ).orderBy("risk_level")


REVIEW_COLUMNS = ("SalesOrderID", "CustomerID", "OrderDate", "order_value", "days_since_previous_order",
                  "prior_order_count", "prior_avg_order_value", "amount_vs_customer_avg",
                  "transaction_risk_score", "risk_reason")


def high_risk_review(ds: DataFrame) -> DataFrame:
    """High rows by score and ratio, descending."""
    return (ds.where(F.col("risk_level") == K.LEVEL_HIGH).select(*REVIEW_COLUMNS)
              .orderBy(F.col("transaction_risk_score").desc(), F.col("amount_vs_customer_avg").desc_nulls_last(),
                       "SalesOrderID"))
