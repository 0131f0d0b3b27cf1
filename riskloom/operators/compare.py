"""M7-M15 model results and Q* rule / model comparison and export.

``model_results`` attaches two anomaly scores to the eligible rows of the
dataset. ``scorer="forest"`` fits the two Isolation Forests;
``scorer="ratio"`` uses deterministic stand-in scores (the rounded ratio, the
gap), one per model, so that every downstream comparison can be checked exactly against SQL.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as K
from ..config import ForestConfig
from ..functions.caching import materialise
from ..functions.numeric import flag, round_half_up
from ..functions import bucketed, quantiles
from ..functions.ranking import average_rank_pct
from . import forest as M
from .crosstab import crosstab

# Fixed shares, column lists and preview fields of the published results.
SHARES = ((0.99, "top_1pct"), (0.95, "top_5pct"), (0.90, "top_10pct"))
PROFILE_FEATURES = ("order_value", "days_since_previous_order", "prior_order_count",
                    "prior_avg_order_value", "amount_vs_customer_avg")


# The two models: score column, percentile column, prefix of the share flags, features and log columns.
MODELS = {"initial": ("anomaly_score", "anomaly_percentile", "", M.INITIAL_FEATURES, M.INITIAL_LOG),
          "behaviour": ("behaviour_anomaly_score", "behaviour_anomaly_percentile", "behaviour_", M.BEHAVIOUR_FEATURES, M.BEHAVIOUR_LOG)}


def fit_model(ds: DataFrame, which: str, cfg: ForestConfig | None = None) -> M.StoredForest:
    """One of the two models, fitted on ``ds``."""
    return M.fit_forest(ds, *MODELS[which][3:], cfg or ForestConfig())


def forest_scores(ds: DataFrame, features, log_cols, out: str, cfg: ForestConfig | None = None) -> DataFrame:
    """M3-M6 (or M13-M14): fit and score -> (id, out)."""
    # scores feed a rank and a join: compute them once
    return materialise(M.fit_forest(ds, features, log_cols, cfg or ForestConfig()).score(ds, out), "scores")


# Deterministic stand-in scores, one per model, so that swapped models show.
STAND_IN = {"anomaly_score": lambda: F.col("amount_vs_customer_avg") - F.lit(3.0),
            "behaviour_anomaly_score": lambda: F.lit(30.0) - F.col("days_since_previous_order")}


def _stand_in(ds: DataFrame, out: str) -> DataFrame:
    return M.eligible(ds).select("SalesOrderID", STAND_IN[out]().cast("double").alias(out))


def with_top_flags(df: DataFrame, pct: str, prefix: str) -> DataFrame:
    """0/1 flags for percentile >= 0.99, 0.95, 0.90; NULL without a percentile."""
    return df.withColumns({f"{prefix}{name}": F.when(F.col(pct).isNotNull(), flag(F.col(pct) >= p)) for p, name in SHARES})


def _ranked(ds: DataFrame, scorer: str, which: str, fitted) -> DataFrame:
    """One model's narrow frame: id, score, percentile and top-share flags."""
    name, pct, prefix = MODELS[which][:3]
    # the range exchange of the rank reads its input twice (once for a sample): score once
    s = materialise(fitted(which).score(ds, name), "scores") if scorer == "forest" else _stand_in(ds, name)
    r = with_top_flags(average_rank_pct(s, name, pct), pct, prefix)
    if which == "initial":
        r = r.withColumnsRenamed({n: f"{n}_anomaly" for _, n in SHARES})
    return r


def ranked_models(ds: DataFrame, scorer: str = "forest", cfg: ForestConfig | None = None, keep=None, fitted=None) -> tuple[DataFrame, DataFrame]:
    """M6 + M11 + M12 and M14 + M15: each model's scores, percentiles and top-share flags, one narrow row per scored id.

    Ranks are computed on the (id, score) frames, not on the wide dataset.
    ``keep(frame, which)`` stores a model's frame; ``fitted(which)`` gives a
    stored forest (without it both are fitted here). With the forest, the two
    independent models run as concurrent Spark jobs from two driver threads;
    results do not depend on it.
    """
    if scorer not in ("forest", "ratio"):
        raise ValueError(scorer)
    keep = keep or (lambda df, which: materialise(df, f"ranked-{which}"))
    fitted = fitted or (lambda which: fit_model(ds, which, cfg))
    if scorer == "forest":
        with ThreadPoolExecutor(max_workers=2) as pool:
            return tuple(pool.map(lambda which: keep(_ranked(ds, scorer, which, fitted), which), MODELS))
    return tuple(keep(_ranked(ds, scorer, which, fitted), which) for which in MODELS)


def with_scores(rows: DataFrame, initial: DataFrame, behaviour: DataFrame) -> DataFrame:
    """Rows with both models' columns, by order id; where all three are bucketed by it no row moves."""
    out = rows.join(initial, "SalesOrderID", "left").join(behaviour, "SalesOrderID", "left")
    # a row without a score is neither normal nor an anomaly: prediction and flags stay NULL
    scored = F.col("anomaly_score").isNotNull()
    return out.withColumns({"anomaly_prediction": F.when(scored, F.when(F.col("anomaly_score") > 0, -1).otherwise(1)),
                            "anomaly_flag": F.when(scored, flag(F.col("anomaly_score") > 0))})


def model_scores(ds: DataFrame, scorer: str = "forest", cfg: ForestConfig | None = None, stored: bool = True) -> DataFrame:
    """M6 + M11 + M12 + M14 + M15 on narrow frames: one row per eligible id.

    Columns: SalesOrderID, anomaly_score, anomaly_prediction, anomaly_flag,
    anomaly_percentile, top_*_anomaly, behaviour_anomaly_score,
    behaviour_anomaly_percentile, behaviour_top_*. Without ``stored`` they are
    joined where they are read, which is cheaper for a single reader.
    """
    out = with_scores(M.eligible(ds).select("SalesOrderID"), *ranked_models(ds, scorer, cfg, keep=None if stored else lambda df, which: df))
    # narrow (id + a dozen numbers), read by the results frame and the export
    return materialise(out, "model-scores") if stored else out


def stored_models(ds: DataFrame, name: str, scorer: str = "forest", cfg: ForestConfig | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dataset and both models' frames as tables bucketed by order id: ``ds`` is computed once, each is exchanged once."""
    buckets = bucketed.bucket_count(ds)
    stored = bucketed.write_bucketed(ds, f"{name}_dataset", "SalesOrderID", buckets)
    models = ranked_models(stored, scorer, cfg, lambda df, which: bucketed.write_bucketed(df, f"{name}_{scorer}_{which}", "SalesOrderID", buckets))
    return stored, *models


def model_results(ds: DataFrame, scorer: str = "forest", cfg: ForestConfig | None = None,
                  scores: DataFrame | None = None) -> DataFrame:
    """M7: the eligible dataset rows with both models' scores, ranks and flags."""
    scores = scores if scores is not None else model_scores(ds, scorer, cfg)
    return M.eligible(ds).join(scores, "SalesOrderID", "left")


# ---------------------------------------------------------------- M8-M12

def flag_rate(res: DataFrame) -> DataFrame:
    """M8: rows per automatic flag and their share (%)."""
    g = res.groupBy("anomaly_flag").agg(F.count(F.lit(1)).alias("transaction_count"))
    from pyspark.sql import Window
    total = F.sum("transaction_count").over(Window.partitionBy())  # two rows
    return g.select("anomaly_flag", "transaction_count",
                    round_half_up(F.col("transaction_count").cast("double") * 100 / total.cast("double"), 2)
                    .alias("percentage")).orderBy("anomaly_flag")


ANOMALY_COLUMNS = ("SalesOrderID", "CustomerID", "OrderDate", "order_value", "days_since_previous_order",
                   "prior_order_count", "prior_avg_order_value", "amount_vs_customer_avg", "anomaly_score")


def top_anomalies(res: DataFrame, n: int = 10) -> DataFrame:
    """M9: flagged rows with the highest scores."""
    return (res.where(F.col("anomaly_flag") == 1).select(*ANOMALY_COLUMNS)
               .orderBy(F.col("anomaly_score").desc(), "SalesOrderID").limit(n))


SCORE_PERCENTILES = (0.50, 0.75, 0.90, 0.95, 0.99)


def score_percentiles(res: DataFrame, col: str = "anomaly_score", table: DataFrame | None = None) -> DataFrame:
    """Percentiles of the score (4 places)."""
    from .profile import percentile_profile
    return percentile_profile(res, col, SCORE_PERCENTILES, digits=4, table=table)


def top_share_counts(res: DataFrame, prefix: str = "") -> DataFrame:
    """Rows in the top 1 / 5 / 10 %."""
    cols = [f"{prefix}{n}_anomaly" if not prefix else f"{prefix}{n}" for _, n in SHARES]
    return res.agg(*[F.sum(c).cast("bigint").alias(c) for c in cols])


# ---------------------------------------------------------------- Q1-Q8

def level_flag_crosstab(res: DataFrame) -> DataFrame:
    """Q1: level x automatic flag counts."""
    return crosstab(res, "risk_level", "anomaly_flag", "flag_", categories=(0, 1)).orderBy("risk_level")


def _names(prefix: str):
    if prefix:
        return f"{prefix}anomaly_score", [f"{prefix}{n}" for _, n in SHARES]
    return "anomaly_score", [f"{n}_anomaly" for _, n in SHARES]


def cross_method(res: DataFrame, prefix: str = "") -> DataFrame:
    """Q2 / Q8: per level rows, mean score (4 places) and top-share hits."""
    score, tops = _names(prefix)
    return (res.groupBy("risk_level").agg(
        F.count("SalesOrderID").alias("transactions"),
        round_half_up(F.avg(score), 4).alias("avg_score"),
        *[F.sum(t).cast("bigint").alias(n) for t, (_, n) in zip(tops, SHARES)])
        .orderBy("risk_level"))


def overlap_rates(res: DataFrame, prefix: str = "") -> DataFrame:
    """Q3 / Q8: hit rates per level in percent."""
    c = cross_method(res, prefix)
    return c.select("risk_level", "avg_score", *[
        round_half_up(F.col(n).cast("double") / F.col("transactions").cast("double") * 100, 2)
        .alias(f"{n}_rate") for _, n in SHARES]).orderBy("risk_level")


def _model_only(res: DataFrame) -> DataFrame:
    return res.where((F.col("risk_level") == K.LEVEL_LOW) & (F.col("top_1pct_anomaly") == 1))


def model_only_count(res: DataFrame) -> DataFrame:
    """Q4: Low rows inside the model's top 1 %."""
    return _model_only(res).agg(F.count(F.lit(1)).alias("model_only_anomalies"))


def model_only(res: DataFrame, n: int = 10) -> DataFrame:
    """Q4: the n strongest model-only anomalies."""
    return (_model_only(res).select(*ANOMALY_COLUMNS, "anomaly_percentile", "risk_reason")
            .orderBy(F.col("anomaly_score").desc(), "SalesOrderID").limit(n))


def high_risk_validation(res: DataFrame) -> DataFrame:
    """Q5: High rows with the model score and percentile."""
    return (res.where(F.col("risk_level") == K.LEVEL_HIGH)
               .select("SalesOrderID", "CustomerID", "order_value", "days_since_previous_order",
                       "prior_order_count", "prior_avg_order_value", "amount_vs_customer_avg",
                       "transaction_risk_score", "anomaly_score", "anomaly_percentile", "risk_reason")
               .orderBy(F.col("anomaly_score").desc_nulls_last(), "SalesOrderID"))


def profile_comparison(res: DataFrame) -> DataFrame:
    """Q6: medians of five features, model-only vs the other Low rows."""
    low = res.where(F.col("risk_level") == K.LEVEL_LOW)
    top, other = "model_top_1pct", "other_low_risk"
    side = F.when(F.col("top_1pct_anomaly") == 1, top).otherwise(other)
    med = quantiles.quantiles_by_group(low, side, (top, other), {c: (0.5,) for c in PROFILE_FEATURES})
    wide = med.groupBy(F.col("column_name").alias("feature")).agg(*[F.max(F.when(F.col("group") == g, F.col("value"))).alias(g) for g in (top, other)])
    return wide.select("feature", round_half_up("model_top_1pct", 2).alias("model_top_1pct"),
                       round_half_up("other_low_risk", 2).alias("other_low_risk")).orderBy("feature")


def high_risk_both_models(res: DataFrame) -> DataFrame:
    """Q7: High rows with both percentiles, by the behaviour percentile."""
    return (res.where(F.col("risk_level") == K.LEVEL_HIGH)
               .select("SalesOrderID", "CustomerID", "days_since_previous_order", "amount_vs_customer_avg",
                       "transaction_risk_score", "anomaly_percentile", "behaviour_anomaly_percentile",
                       "risk_reason")
               .orderBy(F.col("behaviour_anomaly_percentile").desc_nulls_last(), "SalesOrderID"))


# ---------------------------------------------------------------- Q9-Q12

EXPORT_MODEL_COLUMNS = ("model_eligible_flag", "behaviour_anomaly_score", "behaviour_anomaly_percentile",
                        "behaviour_top_1pct", "behaviour_top_5pct", "behaviour_top_10pct",
                        "anomaly_score", "anomaly_percentile")


def export_dataset(ds: DataFrame, scores: DataFrame) -> DataFrame:
    """Q9: every dataset row + log value + model columns (flags 0, scores NULL if not eligible).

    ``scores`` is :func:`model_scores` output (or a results frame with the
    same columns): one narrow join on the order id.
    """
    narrow = scores.select("SalesOrderID", *[c for c in EXPORT_MODEL_COLUMNS if c != "model_eligible_flag"])
    return _exported(ds.join(narrow, "SalesOrderID", "left"), ds.columns)


def export_from_history(history: DataFrame, scores: DataFrame, score, deal) -> DataFrame:
    """Q9 from the customer history: joined with the scores and laid out while narrow, scored afterwards.

    ``score(rows, *more)`` makes the dataset's columns and keeps ``more``.
    """
    own = [c for c in EXPORT_MODEL_COLUMNS if c != "model_eligible_flag"]
    joined = score(deal(history.join(scores.select("SalesOrderID", *own), "SalesOrderID", "left")), *own)
    return _exported(joined, [c for c in joined.columns if c not in own])


def export_stored(ds: DataFrame, initial: DataFrame, behaviour: DataFrame) -> DataFrame:
    """Q9 from :func:`stored_models`: the joins read bucket by bucket."""
    return _exported(with_scores(ds, initial, behaviour), ds.columns)


def _exported(joined: DataFrame, columns: list[str]) -> DataFrame:
    eligible = F.coalesce(F.col("prior_order_count") > 0, F.lit(False))
    flags = ("behaviour_top_1pct", "behaviour_top_5pct", "behaviour_top_10pct")
    made = {"model_eligible_flag": eligible.cast("int")} | {c: F.coalesce(F.col(c), F.lit(0)) for c in flags}
    return joined.select(*columns, F.log1p("order_value").alias("log_order_value"),
                         *[made[c].alias(c) if c in made else F.col(c) for c in EXPORT_MODEL_COLUMNS])


def export_checks(export: DataFrame) -> DataFrame:
    """Q10: rows, columns and eligible rows of the export."""
    return export.agg(F.count(F.lit(1)).alias("total_rows"),
                      F.sum("model_eligible_flag").cast("bigint").alias("model_eligible")
                      ).withColumn("total_columns", F.lit(len(export.columns)).cast("bigint"))


PREVIEW_FIELDS = ("SalesOrderID", "CustomerID", "order_value", "risk_level", "transaction_risk_score",
                  "model_eligible_flag", "behaviour_anomaly_score", "behaviour_anomaly_percentile",
                  "behaviour_top_1pct", "behaviour_top_5pct", "behaviour_top_10pct")


def export_preview(export: DataFrame, n: int = 6) -> DataFrame:
    """Q11: 11 fields of the first n orders."""
    return export.select(*PREVIEW_FIELDS).orderBy("SalesOrderID").limit(n)
