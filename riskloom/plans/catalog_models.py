"""Registered P*, X56, M*, Q*, R* queries (over the analytics dataset).

Model-based queries come in two forms: with the fitted Isolation Forests
(``scorer="forest"``; checked on rows and by the statistical tests) and with
the deterministic stand-in score (``*_standin``; checked value by value
against SQL).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .. import config as K
from ..functions.bucketed import bucketed_once, table_name
from ..functions.caching import input_key, published_once, run_folder
from ..functions.numeric import round_half_up
from ..operators import compare, dashboards, forest, marts, profile
from ..operators.crosstab import crosstab, pair_counts
from ..functions.ranking import average_rank_pct
from ..sources.io import mart_path, read_checked_csv, read_dataset_csv, write_dataset_csv
from .catalog import _ds as _build_ds



# The filters of the registered review queue: single-signal scores and two reasons.
QUEUE_SCORES = (2, 3)
QUEUE_REASONS = (K.REASON_SAME_DAY, K.REASON_SPIKE)


def _ds(spark, sf):
    return bucketed_once(spark, sf, "dataset", "SalesOrderID", lambda deal: _build_ds(spark, sf, deal), early=True)


def _forest(spark, sf, which):
    """The stored forest of one model: fitted and saved at first use of this state of the tables."""
    path = f"{run_folder(spark)}/forest-{which}-{input_key(spark, sf)}"
    if forest.load_forest(spark, path) is None:
        forest.save_forest(spark, compare.fit_model(_ds(spark, sf), which), path)
    return forest.load_forest(spark, path)


def _models(spark, sf, scorer):
    """Both models' frames, bucketed like the dataset."""
    ds = _ds(spark, sf)
    names = {which: f"{scorer}_{which}" for which in ("initial", "behaviour")}
    if all(spark.catalog.tableExists(table_name(spark, sf, n)) for n in names.values()):
        return tuple(spark.table(table_name(spark, sf, n)) for n in names.values())
    return compare.ranked_models(ds, scorer, fitted=lambda which: _forest(spark, sf, which), keep=lambda df, which: bucketed_once(spark, sf, names[which], "SalesOrderID", lambda: df, "dataset"))


def _res(spark, sf, scorer):
    return compare.with_scores(forest.eligible(_ds(spark, sf)), *_models(spark, sf, scorer))


def _export(spark, sf, scorer):
    return compare.export_stored(_ds(spark, sf), *_models(spark, sf, scorer))


def _numeric(spark, sf):
    """Quantiles of the dataset's columns: P4, P7, P10, P11 and P12 read this one table."""
    return published_once(spark, sf, "numeric", lambda: profile.numeric_table(_ds(spark, sf)))


def _numeric_score(spark, sf):
    """Quantiles of the stand-in score (M10): the questions on the dataset alone need no ranked score."""
    return published_once(spark, sf, "numeric_score", lambda: profile.numeric_table(
        _models(spark, sf, "ratio")[0], {"anomaly_score": compare.SCORE_PERCENTILES}))


def _numeric_q(fn, *a, **k):
    return lambda s, sf: fn(_ds(s, sf), *a, **k, table=_numeric(s, sf))


def _ds_q(fn, *a, **k):
    return lambda s, sf: fn(_ds(s, sf), *a, **k)


def _res_q(fn, scorer, *a, **k):
    return lambda s, sf: fn(_res(s, sf, scorer), *a, **k)


def _exp_q(fn, scorer, *a, **k):
    return lambda s, sf: fn(_export(s, sf, scorer), *a, **k)


def _export_csv(spark, sf, scorer):
    """Q12: write the export as CSV under the checkpoint folder and read it back."""
    exp = _export(spark, sf, scorer)
    path = mart_path(spark, f"export-{scorer}")
    write_dataset_csv(exp, path)
    return read_dataset_csv(spark, path, exp.schema)


def _checked_csv(spark, sf):
    """The dataset written as CSV with every fiftieth value and every seventieth date damaged, and read back with its rejects."""
    ds = _ds(spark, sf)
    text = ds.withColumns({"order_value": F.when(F.col("SalesOrderID") % 50 == 0, "n/a").otherwise(F.col("order_value").cast("string")),
                           "OrderDate": F.when(F.col("SalesOrderID") % 70 == 0, "yesterday").otherwise(F.date_format("OrderDate", "yyyy-MM-dd'T'HH:mm:ss"))})
    path = mart_path(spark, "checked-csv")
    write_dataset_csv(text, path)
    return read_checked_csv(spark, path, ds.schema, mart_path(spark, "checked-rows"), max_rejected_share=0.1)


def _checked_csv_counts(spark, sf):
    return _checked_csv(spark, sf).counts().agg(F.sum("good_rows").alias("good_rows"), F.sum("rejected_rows").alias("rejected_rows"))


def model_queries():
    q = {}
    # P - profile of the dataset
    q["dataset_shape"] = _ds_q(profile.dataset_shape)
    q["dataset_types"] = _ds_q(profile.dataset_types)
    q["dataset_preview"] = _ds_q(profile.dataset_preview)
    q["duplicate_profile"] = _ds_q(profile.duplicate_profile)
    # planted copies: every tenth order once more, every hundredth twice more, every seventh with another value
    q["duplicate_profile_planted"] = _ds_q(lambda d: profile.duplicate_profile(_with_copies(d)))
    q["exact_duplicates_planted"] = _ds_q(lambda d: profile.exact_duplicates(_with_copies(d)).select("SalesOrderID", "copies"))
    q["crosstab_level_channel"] = _ds_q(crosstab, "risk_level", "OnlineOrderFlag", "channel_")
    q["crosstab_level_segment"] = _ds_q(lambda d: crosstab(d.withColumn("segment", profile.velocity_segment()), "risk_level", "segment"))
    q["pair_counts_segment_reason"] = _ds_q(lambda d: pair_counts(d.withColumn("segment", profile.velocity_segment()), "segment", "risk_reason"))
    q["missing_summary"] = _ds_q(profile.missing_summary)
    q["describe_numeric"] = _numeric_q(profile.describe_numeric)
    q["value_shares_risk_level"] = _ds_q(profile.value_shares, "risk_level")
    q["value_shares_channel"] = _ds_q(profile.value_shares, "OnlineOrderFlag")
    q["top_reasons"] = _ds_q(profile.top_values, "risk_reason", 10)
    q["value_percentiles"] = _numeric_q(profile.percentile_profile, "order_value", profile.VALUE_PERCENTILES)
    q["value_histogram"] = _ds_q(profile.histogram, "order_value", 50)
    q["log_value_histogram"] = _ds_q(profile.log_value_histogram)
    q["ratio_percentiles"] = _numeric_q(profile.percentile_profile, "amount_vs_customer_avg",
                                       profile.RATIO_PERCENTILES)
    q["trimmed_ratio_histogram"] = _numeric_q(profile.trimmed_histogram)
    q["gap_percentiles"] = _numeric_q(profile.percentile_profile, "days_since_previous_order",
                                      profile.VALUE_PERCENTILES)
    q["velocity_segments"] = _ds_q(profile.velocity_segments)
    q["indicator_totals"] = _ds_q(profile.indicator_totals)
    q["score_counts"] = _ds_q(profile.score_counts)
    q["level_counts"] = _ds_q(profile.level_counts)
    q["behaviour_by_level"] = _ds_q(profile.behaviour_by_level)
    q["high_risk_review"] = _ds_q(profile.high_risk_review)
    q["checked_csv_good"] = lambda s, sf: _checked_csv(s, sf).good
    q["checked_csv_counts"] = _checked_csv_counts
    # X56 - average-tie percentile rank, on the ratio of every order
    q["ratio_percentile_rank"] = lambda s, sf: average_rank_pct(
        _ds(s, sf).select("SalesOrderID", "amount_vs_customer_avg"), "amount_vs_customer_avg",
        "ratio_percentile")
    # M - models
    q["model_features"] = _ds_q(forest.model_features)
    q["eligibility_counts"] = _ds_q(forest.eligibility_counts)
    for scorer, suffix in (("forest", ""), ("ratio", "_standin")):
        q[f"flag_rate{suffix}"] = _res_q(compare.flag_rate, scorer)
        q[f"top_anomalies{suffix}"] = _res_q(compare.top_anomalies, scorer)
        q[f"top_share_counts{suffix}"] = _res_q(compare.top_share_counts, scorer)
        q[f"behaviour_top_share_counts{suffix}"] = _res_q(compare.top_share_counts, scorer, "behaviour_")
        q[f"level_flag_crosstab{suffix}"] = _res_q(compare.level_flag_crosstab, scorer)
        q[f"cross_method{suffix}"] = _res_q(compare.cross_method, scorer)
        q[f"overlap_rates{suffix}"] = _res_q(compare.overlap_rates, scorer)
        q[f"model_only_count{suffix}"] = _res_q(compare.model_only_count, scorer)
        q[f"model_only{suffix}"] = _res_q(compare.model_only, scorer)
        q[f"high_risk_validation{suffix}"] = _res_q(compare.high_risk_validation, scorer)
        q[f"profile_comparison{suffix}"] = _res_q(compare.profile_comparison, scorer)
        q[f"high_risk_both_models{suffix}"] = _res_q(compare.high_risk_both_models, scorer)
        q[f"behaviour_comparison{suffix}"] = _res_q(compare.overlap_rates, scorer, "behaviour_")
        q[f"export_dataset{suffix}"] = (lambda sc: lambda s, sf: _export(s, sf, sc))(scorer)
        q[f"export_checks{suffix}"] = _exp_q(compare.export_checks, scorer)
        q[f"export_preview{suffix}"] = _exp_q(compare.export_preview, scorer)
        q[f"export_csv{suffix}"] = (lambda sc: lambda s, sf: _export_csv(s, sf, sc))(scorer)
        # R - dashboard datasets
        q[f"overview_kpis{suffix}"] = _exp_q(dashboards.overview_kpis, scorer)
        q[f"investigation_queue{suffix}"] = _exp_q(dashboards.investigation_queue, scorer)
        q[f"behaviour_dashboard{suffix}"] = _exp_q(dashboards.behaviour_dashboard, scorer)
        q[f"geography_dashboard{suffix}"] = _exp_q(dashboards.geography_dashboard, scorer)
        q[f"ratio_bands{suffix}"] = _exp_q(dashboards.ratio_bands, scorer)
        q[f"geography_by_state{suffix}"] = _exp_q(dashboards.geography_by_state, scorer)
        q[f"customer_ranking{suffix}"] = _exp_q(dashboards.customer_ranking, scorer)
        q[f"investigation_queue_filtered{suffix}"] = _exp_q(
            dashboards.investigation_queue, scorer, scores=QUEUE_SCORES, reasons=QUEUE_REASONS)
        q[f"behaviour_counts{suffix}"] = _res_q(compare.cross_method, scorer, "behaviour_")
        q[f"customer_dashboard{suffix}"] = _exp_q(dashboards.customer_dashboard, scorer)
    q["score_percentiles"] = lambda s, sf: compare.score_percentiles(_models(s, sf, "forest")[0])
    q["score_percentiles_standin"] = lambda s, sf: compare.score_percentiles(None, table=_numeric_score(s, sf))
    for which, (name, *_) in compare.MODELS.items():
        q[name + "s"] = (lambda which, name: lambda s, sf: _forest(s, sf, which).score(_ds(s, sf), name))(which, name)
    q["stored_model_scores"] = _stored_model_scores
    q["monthly_flagged_rate"] = _ds_q(marts.monthly_risk)
    # reports over the published (written) marts
    q["published_monthly_risk"] = lambda s, sf: marts.monthly_risk(_published(s, sf).read_dataset(s))
    q["published_overview_kpis_standin"] = lambda s, sf: dashboards.overview_kpis(
        _published(s, sf).read_export(s))
    # M3 / M13 model inputs, M4 scaler check, M5 fitted node table, M10 score histogram
    q["model_input_initial"] = _ds_q(lambda d: _six_places(forest.transform_initial(forest.eligible(d))))
    q["model_input_behaviour"] = _ds_q(lambda d: _six_places(forest.transform_behaviour(forest.eligible(d))))
    q["scaled_check_initial"] = _ds_q(lambda d: _scaled_check(*_model_input(d)))
    q["scaled_check_behaviour"] = _ds_q(lambda d: _scaled_check(
        forest.transform_behaviour(forest.eligible(d)), [f"f_{c}" for c in forest.BEHAVIOUR_FEATURES]))
    q["forest_invariants"] = lambda s, sf: _forest_invariants(s, sf)
    q["forest_nodes_initial"] = lambda s, sf: s.createDataFrame(_forest(s, sf, "initial").model.nodes, forest.NODE_SCHEMA)
    q["score_histogram"] = _res_q(lambda r: profile.histogram(r, "anomaly_score", 50), "forest")
    q["score_histogram_standin"] = _res_q(lambda r: profile.histogram(r, "anomaly_score", 50), "ratio")

    return q


def _with_copies(ds):
    changed = ds.where("SalesOrderID % 7 = 0").withColumn("order_value", F.col("order_value") + 1)
    return ds.unionByName(ds.where("SalesOrderID % 10 = 0")).unionByName(ds.where("SalesOrderID % 100 = 0")).unionByName(changed)


def _model_input(ds):
    x = forest.transform(forest.eligible(ds), forest.INITIAL_FEATURES, forest.INITIAL_LOG)
    return x, [f"f_{c}" for c in forest.INITIAL_FEATURES]


def _six_places(x):
    """The model input at six places: engines differ in the last bit of a logarithm."""
    return x.withColumns({c: round_half_up(c, 6) for c in x.columns if c != "SalesOrderID"})


def _scaled_check(x, cols):
    z, _ = forest.standardise(x, cols)
    # adding 0.0 turns a rounded -0.0 into 0.0
    return forest.scaled_check(z, cols).select(*[(F.col(f"{c}_{s}") + 0.0).alias(f"{c}_{s}") for c in cols for s in ("mean", "std")])


def _forest_invariants(spark, sf):
    """What holds for any fitted forest: trees, rows per root, score range, flags, scored rows."""
    fitted = spark.createDataFrame(_forest(spark, sf, "initial").model.nodes, forest.NODE_SCHEMA)
    nodes = fitted.where("node = 0").agg(
        F.countDistinct("tree").alias("trees"), F.min("size").cast("bigint").alias("least_root_rows"),
        F.max("size").cast("bigint").alias("most_root_rows"))
    res = _res(spark, sf, "forest").agg(
        F.count("anomaly_score").alias("scored_rows"),
        F.count(F.when(F.col("anomaly_score").isNull(), 1)).alias("unscored_rows"),
        F.count(F.when((F.col("anomaly_score") <= -0.5) | (F.col("anomaly_score") >= 0.5), 1)).alias("scores_out_of_range"),
        F.count(F.when(~F.col("anomaly_flag").eqNullSafe((F.col("anomaly_score") > 0).cast("int")), 1)).alias("wrong_flags"))
    # one row each
    return nodes.withColumn("one", F.lit(1)).join(res.withColumn("one", F.lit(1)), "one").drop("one")


# A model made by a rule, so that SQL can make it too: complete trees over the initial features.
RULE_TREES, RULE_DEPTH, RULE_PSI = 12, 4, 64


def rule_forest():
    """Node ``n`` of tree ``t`` splits feature (t + n) mod 6 at ((7 n + 3 t) mod 11 - 5) / 4; leaves hold 1 + (5 n + t) mod 9 rows."""
    inner, nodes = 2 ** RULE_DEPTH - 1, []
    for t in range(RULE_TREES):
        for n in range(2 * inner + 1):
            depth = (n + 1).bit_length() - 1
            leaf = n >= inner
            nodes.append((t, n, -1 if leaf else (t + n) % 6, 0.0 if leaf else ((7 * n + 3 * t) % 11 - 5) / 4,
                          -1 if leaf else 2 * n + 1, -1 if leaf else 2 * n + 2, 1 + (5 * n + t) % 9, depth))
    columns = [f"f_{c}" for c in forest.INITIAL_FEATURES]
    model = forest.IsolationForestModel(columns, RULE_PSI, RULE_TREES, -0.5, pd.DataFrame(nodes, columns=forest.NODE_SCHEMA.fieldNames()))
    return forest.StoredForest(model, list(forest.INITIAL_LOG), {c: (2.0 * k, 1.0 + k / 2) for k, c in enumerate(columns)})


def _stored_model_scores(spark, sf):
    """M6 on a stored model: saved as a table, loaded by path, applied to every eligible order (six places)."""
    path = f"{run_folder(spark)}/forest-rule"
    if forest.load_forest(spark, path) is None:
        forest.save_forest(spark, rule_forest(), path)
    return forest.load_forest(spark, path).score(_ds(spark, sf)).select("SalesOrderID", round_half_up("anomaly_score", 6).alias("anomaly_score"))


def _published(spark, sf):
    from ..sources.binding import bind_driver_tables
    from .publish import existing, publish_marts
    base, name = f"{run_folder(spark)}/published", f"risk_{input_key(spark, sf)}"
    done = existing(spark, base, name)
    return done or publish_marts(spark, bind_driver_tables(spark, sf), name=name, scorer="ratio", base=base)
