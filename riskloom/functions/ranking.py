"""Distributed ranks, exact percentiles and equal-width histograms.

A global ``rank() OVER (ORDER BY x)`` or an exact ``percentile`` sends every
value to one task. Here the values are first pre-aggregated to
(value, count) pairs (map-side combine: a value repeated a billion times is
one row after the partial aggregate), then the positions of the distinct
values come from the skew-proof prefix scan over a range-partitioned table.

* average-tie percentile rank (``pandas.Series.rank(pct=True)``): see
  :mod:`riskloom.functions.two_way`, which needs neither groups nor a join
* exact percentile with linear interpolation (``quantile_cont``,
  ``numpy.percentile``): the values at positions floor/ceil((n-1)p).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import ScanSpec, prefix_scan
from .two_way import average_rank_pct  # noqa: F401 - the ranks are offered together

_V = "__rk_value"


def value_positions(df: DataFrame, value, groups: list[str] | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """Distinct non-null values per group with count and rows-before.

    Returns ``groups..., __rk_value, __rk_c (ties), __rk_before (rows before)``.
    """
    groups = list(groups or [])
    v = F.col(value) if isinstance(value, str) else value
    counts = (df.select(*groups, v.alias(_V)).where(F.col(_V).isNotNull() & ~F.isnan(F.col(_V).cast("double")))
                .groupBy(*groups, _V).agg(F.count(F.lit(1)).alias("__rk_c")))
    spec = ScanSpec(sums={"__rk_before": "__rk_c"})
    return prefix_scan(counts, groups, [_V], spec, num_partitions)


def _group_totals(pos: DataFrame, groups: list[str]) -> DataFrame:
    return pos.groupBy(*groups).agg(F.sum("__rk_c").alias("__rk_n"))


def _attach_totals(pos: DataFrame, groups: list[str]) -> DataFrame:
    totals = _group_totals(pos, groups)
    if not groups:
        # one number, computed by Spark and read as a scalar
        n = totals.first()["__rk_n"] or 0
        return pos.withColumn("__rk_n", F.lit(n).cast("bigint"))
    cond = None
    t = totals.select(*[F.col(g).alias(f"__rk_g_{g}") for g in groups], "__rk_n")
    for g in groups:
        c = F.col(g).eqNullSafe(F.col(f"__rk_g_{g}"))
        cond = c if cond is None else cond & c
    return pos.join(t, cond, "left").drop(*[f"__rk_g_{g}" for g in groups])


def exact_percentiles(df: DataFrame, value, probs, groups: list[str] | None = None,
                      prob_col: str = "percentile", out: str = "value") -> DataFrame:
    """Linear-interpolation percentiles, one row per (group, probability)."""
    groups = list(groups or [])
    pos = _attach_totals(value_positions(df, value, groups), groups)
    probs = [float(p) for p in probs]
    h = (F.col("__rk_n") - 1).cast("double") * F.col("__rk_p")
    lo = F.floor(h).cast("bigint")
    hi = F.ceil(h).cast("bigint")
    start, end = F.col("__rk_before"), F.col("__rk_before") + F.col("__rk_c")
    rows = (pos.withColumn("__rk_p", F.explode(F.array(*[F.lit(p) for p in probs])))
               .withColumns({"__rk_h": h, "__rk_lo": lo, "__rk_hi": hi}))
    hit_lo = (start <= F.col("__rk_lo")) & (F.col("__rk_lo") < end)
    hit_hi = (start <= F.col("__rk_hi")) & (F.col("__rk_hi") < end)
    # at most two distinct values per (group, probability) survive the filter
    picked = rows.where(hit_lo | hit_hi).groupBy(*groups, "__rk_p").agg(
        F.max(F.when(hit_lo, F.col(_V))).alias("__rk_vlo"),
        F.max(F.when(hit_hi, F.col(_V))).alias("__rk_vhi"),
        F.first("__rk_h").alias("__rk_h"),
    )
    frac = F.col("__rk_h") - F.floor("__rk_h")
    val = F.col("__rk_vlo").cast("double") + frac * (F.col("__rk_vhi").cast("double")
                                                    - F.col("__rk_vlo").cast("double"))
    return picked.select(*groups, F.col("__rk_p").alias(prob_col), val.alias(out))


def exact_median(df: DataFrame, value, groups: list[str] | None = None, out: str = "median") -> DataFrame:
    return exact_percentiles(df, value, [0.5], groups, out=out).drop("percentile")


def equal_width_histogram(df: DataFrame, value: str, bins: int = 50,
                          lo: float | None = None, hi: float | None = None,
                          marker: float | None = None) -> DataFrame:
    """``numpy.histogram``-style counts: ``bins`` equal bins over [lo, hi].

    The last bin is closed. Empty bins are kept (count 0). NULLs are ignored.
    """
    v = F.col(value).cast("double")
    base = df.select(v.alias("__h_v")).where(F.col("__h_v").isNotNull())
    if lo is None or hi is None:
        stats = base.agg(F.min("__h_v").alias("lo"), F.max("__h_v").alias("hi")).first()
        lo = stats["lo"] if lo is None else lo
        hi = stats["hi"] if hi is None else hi
    spark = df.sparkSession
    all_bins = spark.range(1, bins + 1).select(F.col("id").cast("bigint").alias("bin"))
    if lo is None:
        return all_bins.select("bin", F.lit(None).cast("double").alias("bin_start"),
                               F.lit(None).cast("double").alias("bin_end"),
                               F.lit(0).cast("bigint").alias("count"))
    lo, hi = float(lo), float(hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = hi - lo
    b = F.least(F.floor((F.col("__h_v") - F.lit(lo)) / F.lit(width) * bins).cast("bigint") + 1,
                F.lit(bins))
    counts = (base.where((F.col("__h_v") >= lo) & (F.col("__h_v") <= hi))
                  .groupBy(b.alias("__h_bin")).agg(F.count(F.lit(1)).alias("__h_n")))
    # the bin table has exactly `bins` rows
    out = all_bins.join(F.broadcast(counts), F.col("bin") == F.col("__h_bin"), "left").select(
        "bin",
        (F.lit(lo) + (F.col("bin") - 1) * F.lit(width) / bins).alias("bin_start"),
        (F.lit(lo) + F.col("bin") * F.lit(width) / bins).alias("bin_end"),
        F.coalesce(F.col("__h_n"), F.lit(0)).cast("bigint").alias("count"),
    )
    if marker is not None:
        out = out.withColumn("contains_marker", ((F.col("bin_start") <= marker)
                                                 & ((F.col("bin_end") > marker)
                                                    | ((F.col("bin") == bins) & (F.col("bin_end") >= marker))))
                             .cast("int"))
    return out.orderBy("bin")
