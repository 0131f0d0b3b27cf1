"""DuckDB twins of the profile, rank and stand-in model queries."""

from __future__ import annotations

from .. import config as K
from .oracle import r, with_binding
from .oracle_profile import profile_oracles

# The stand-in scores: ratio - 3 and 30 - gap on eligible rows; ranks with average ties.
RES = """
, res0 AS (
    SELECT *, amount_vs_customer_avg - 3.0 AS anomaly_score, CAST(30.0 - days_since_previous_order AS DOUBLE) AS behaviour_anomaly_score
    FROM ds WHERE prior_order_count > 0
),
res1 AS (
    SELECT *,
        CASE WHEN anomaly_score > 0 THEN -1 WHEN anomaly_score <= 0 THEN 1 END AS anomaly_prediction,
        CASE WHEN anomaly_score > 0 THEN 1 WHEN anomaly_score <= 0 THEN 0 END AS anomaly_flag,
        CASE WHEN anomaly_score IS NOT NULL THEN
            (RANK() OVER (ORDER BY anomaly_score) - 1
             + CAST(COUNT(*) OVER (PARTITION BY anomaly_score) + 1 AS DOUBLE) / 2)
            / CAST(COUNT(anomaly_score) OVER () AS DOUBLE) END AS anomaly_percentile,
        CASE WHEN behaviour_anomaly_score IS NOT NULL THEN
            (RANK() OVER (ORDER BY behaviour_anomaly_score) - 1
             + CAST(COUNT(*) OVER (PARTITION BY behaviour_anomaly_score) + 1 AS DOUBLE) / 2)
            / CAST(COUNT(behaviour_anomaly_score) OVER () AS DOUBLE) END AS behaviour_anomaly_percentile
    FROM res0
),
res AS (
    SELECT *,
        CASE WHEN anomaly_percentile IS NOT NULL THEN CAST(anomaly_percentile >= 0.99 AS INTEGER) END AS top_1pct_anomaly,
        CASE WHEN anomaly_percentile IS NOT NULL THEN CAST(anomaly_percentile >= 0.95 AS INTEGER) END AS top_5pct_anomaly,
        CASE WHEN anomaly_percentile IS NOT NULL THEN CAST(anomaly_percentile >= 0.9 AS INTEGER) END AS top_10pct_anomaly,
        CASE WHEN behaviour_anomaly_percentile IS NOT NULL THEN CAST(behaviour_anomaly_percentile >= 0.99 AS INTEGER) END AS behaviour_top_1pct,
        CASE WHEN behaviour_anomaly_percentile IS NOT NULL THEN CAST(behaviour_anomaly_percentile >= 0.95 AS INTEGER) END AS behaviour_top_5pct,
        CASE WHEN behaviour_anomaly_percentile IS NOT NULL THEN CAST(behaviour_anomaly_percentile >= 0.9 AS INTEGER) END AS behaviour_top_10pct
    FROM res1
),
export AS (
    SELECT d.*, LN(1 + d.order_value) AS log_order_value,
        CASE WHEN x.SalesOrderID IS NULL THEN 0 ELSE 1 END AS model_eligible_flag,
        x.behaviour_anomaly_score, x.behaviour_anomaly_percentile,
        COALESCE(x.behaviour_top_1pct, 0) AS behaviour_top_1pct,
        COALESCE(x.behaviour_top_5pct, 0) AS behaviour_top_5pct,
        COALESCE(x.behaviour_top_10pct, 0) AS behaviour_top_10pct,
        x.anomaly_score, x.anomaly_percentile
    FROM ds d LEFT JOIN res x ON d.SalesOrderID = x.SalesOrderID
)
"""


def _m(select: str) -> str:
    return with_binding(RES + select)


def _cross(score: str, tops) -> str:
    return (f"SELECT risk_level, COUNT(SalesOrderID) AS transactions, {r(f'AVG({score})', 4)} AS avg_score, "
            + ", ".join(f"CAST(SUM({t}) AS BIGINT) AS {n}" for t, n in tops)
            + " FROM res GROUP BY risk_level")


def _rates(score: str, tops) -> str:
    inner = _cross(score, tops)
    return _m("SELECT risk_level, avg_score, " + ", ".join(
        f"{r(f'CAST({n} AS DOUBLE) / CAST(transactions AS DOUBLE) * 100')} AS {n}_rate" for _, n in tops)
        + f" FROM ({inner}) c")


INIT_TOPS = (("top_1pct_anomaly", "top_1pct"), ("top_5pct_anomaly", "top_5pct"), ("top_10pct_anomaly", "top_10pct"))
BEH_TOPS = (("behaviour_top_1pct", "top_1pct"), ("behaviour_top_5pct", "top_5pct"),
            ("behaviour_top_10pct", "top_10pct"))
ANOMALY_COLS = ("SalesOrderID, CustomerID, OrderDate, order_value, days_since_previous_order, prior_order_count, "
                "prior_avg_order_value, amount_vs_customer_avg, anomaly_score")


def _input(features, logs) -> str:
    columns = {c: (f"LN(1 + {c})" if c in logs else f"CAST({c} AS DOUBLE)") for c in features}
    whole = " AND ".join(f"{c} IS NOT NULL" for c in features)
    return "SELECT SalesOrderID, " + ", ".join(f"{e} AS f_{c}" for c, e in columns.items()) + f" FROM ds WHERE prior_order_count > 0 AND {whole}"


def _input_oracle(features, logs) -> str:
    return with_binding("SELECT SalesOrderID, " + ", ".join(f"{r(f'f_{c}', 6)} AS f_{c}" for c in features) + f" FROM ({_input(features, logs)}) x")


def _scaled_oracle(features, logs) -> str:
    n = [f"f_{c}" for c in features]
    stats = ", ".join(f"AVG({c}) AS m_{c}, CASE WHEN STDDEV_POP({c}) > 0 THEN STDDEV_POP({c}) ELSE 1 END AS s_{c}" for c in n)
    z = ", ".join(f"(x.{c} - t.m_{c}) / t.s_{c} AS {c}" for c in n)
    out = ", ".join(f"{r(f'AVG({c})')} + 0.0 AS {c}_mean, {r(f'STDDEV_SAMP({c})')} + 0.0 AS {c}_std" for c in n)
    return with_binding(f", x AS ({_input(features, logs)}), t AS (SELECT {stats} FROM x), z AS (SELECT {z} FROM x, t) SELECT {out} FROM z")


INITIAL = ("order_value", "days_since_previous_order", "prior_order_count", "prior_avg_order_value",
           "amount_vs_customer_avg", "OnlineOrderFlag")
INITIAL_LOGS = ("order_value", "days_since_previous_order", "prior_avg_order_value", "amount_vs_customer_avg")
BEHAVIOUR = ("days_since_previous_order", "prior_order_count", "amount_vs_customer_avg", "OnlineOrderFlag")
BEHAVIOUR_LOGS = ("days_since_previous_order", "prior_order_count")
UNSCORED = "(order_value + days_since_previous_order + prior_avg_order_value + amount_vs_customer_avg + OnlineOrderFlag) IS NULL"


def model_oracles() -> dict[str, str]:
    o = profile_oracles()
    o["ratio_percentile_rank"] = with_binding("""
        SELECT SalesOrderID, amount_vs_customer_avg,
            CASE WHEN amount_vs_customer_avg IS NOT NULL THEN
                (RANK() OVER (ORDER BY amount_vs_customer_avg) - 1
                 + CAST(COUNT(*) OVER (PARTITION BY amount_vs_customer_avg) + 1 AS DOUBLE) / 2)
                / CAST(COUNT(amount_vs_customer_avg) OVER () AS DOUBLE) END AS ratio_percentile
        FROM ds""")
    o["model_features"] = with_binding(", ".join(
        f"CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS {c}" for c in (
            "order_value", "days_since_previous_order", "prior_order_count", "prior_avg_order_value",
            "amount_vs_customer_avg", "OnlineOrderFlag")).join(["SELECT ", " FROM ds"]))
    o["eligibility_counts"] = with_binding(
        "SELECT CAST(SUM(CASE WHEN prior_order_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS first_transactions, "
        "CAST(SUM(CASE WHEN prior_order_count > 0 THEN 1 ELSE 0 END) AS BIGINT) AS model_rows, "
        "CAST(COUNT(*) FILTER (WHERE prior_order_count > 0 AND (order_value + days_since_previous_order "
        "+ prior_avg_order_value + amount_vs_customer_avg + OnlineOrderFlag) IS NULL) AS BIGINT) AS unscored_rows FROM ds")
    s = "_standin"
    o["flag_rate" + s] = _m(f"""
        SELECT anomaly_flag, COUNT(*) AS transaction_count,
               {r('CAST(COUNT(*) AS DOUBLE) * 100 / CAST(SUM(COUNT(*)) OVER () AS DOUBLE)')} AS percentage
        FROM res GROUP BY anomaly_flag""")
    o["top_anomalies" + s] = _m(f"SELECT {ANOMALY_COLS} FROM res WHERE anomaly_flag = 1 "
                                f"ORDER BY anomaly_score DESC, SalesOrderID LIMIT 10")
    pct_rows = ["SELECT 'count' AS statistic, CAST(COUNT(anomaly_score) AS DOUBLE) AS value FROM res",
                "SELECT 'mean', AVG(anomaly_score) FROM res", "SELECT 'std', STDDEV_SAMP(anomaly_score) FROM res",
                "SELECT 'min', MIN(anomaly_score) FROM res", "SELECT 'max', MAX(anomaly_score) FROM res"]
    pct_rows += [f"SELECT '{round(p * 100):d}%', QUANTILE_CONT(anomaly_score, {p}) FROM res"
                 for p in (0.5, 0.75, 0.9, 0.95, 0.99)]
    o["score_percentiles" + s] = _m(f"SELECT statistic, {r('value', 4)} AS value FROM ("
                                    + " UNION ALL ".join(pct_rows) + ") t")
    o["top_share_counts" + s] = _m("SELECT " + ", ".join(f"CAST(SUM({t}) AS BIGINT) AS {t}" for t, _ in INIT_TOPS)
                                   + " FROM res")
    o["behaviour_top_share_counts" + s] = _m("SELECT " + ", ".join(
        f"CAST(SUM({t}) AS BIGINT) AS {t}" for t, _ in BEH_TOPS) + " FROM res")
    o["level_flag_crosstab" + s] = _m(
        "SELECT risk_level, CAST(SUM(CASE WHEN anomaly_flag = 0 THEN 1 ELSE 0 END) AS BIGINT) AS flag_0, "
        "CAST(SUM(CASE WHEN anomaly_flag = 1 THEN 1 ELSE 0 END) AS BIGINT) AS flag_1 FROM res GROUP BY risk_level")
    o["cross_method" + s] = _m(_cross("anomaly_score", INIT_TOPS))
    o["overlap_rates" + s] = _rates("anomaly_score", INIT_TOPS)
    o["behaviour_comparison" + s] = _rates("behaviour_anomaly_score", BEH_TOPS)
    only = "FROM res WHERE risk_level = 'Low' AND top_1pct_anomaly = 1"
    o["model_only_count" + s] = _m(f"SELECT COUNT(*) AS model_only_anomalies {only}")
    o["model_only" + s] = _m(f"SELECT {ANOMALY_COLS}, anomaly_percentile, risk_reason {only} "
                             f"ORDER BY anomaly_score DESC, SalesOrderID LIMIT 10")
    o["high_risk_validation" + s] = _m(
        "SELECT SalesOrderID, CustomerID, order_value, days_since_previous_order, prior_order_count, "
        "prior_avg_order_value, amount_vs_customer_avg, transaction_risk_score, anomaly_score, anomaly_percentile, "
        "risk_reason FROM res WHERE risk_level = 'High'")
    feats = ("order_value", "days_since_previous_order", "prior_order_count", "prior_avg_order_value",
             "amount_vs_customer_avg")
    med = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, "
        f"QUANTILE_CONT(CASE WHEN top_1pct_anomaly = 1 THEN CAST({f} AS DOUBLE) END, 0.5) AS a, "
        f"QUANTILE_CONT(CASE WHEN top_1pct_anomaly = 0 THEN CAST({f} AS DOUBLE) END, 0.5) AS b "
        f"FROM res WHERE risk_level = 'Low'" for f in feats)
    o["profile_comparison" + s] = _m(f"SELECT feature, {r('a')} AS model_top_1pct, {r('b')} AS other_low_risk "
                                     f"FROM ({med}) m")
    o["high_risk_both_models" + s] = _m(
        "SELECT SalesOrderID, CustomerID, days_since_previous_order, amount_vs_customer_avg, transaction_risk_score, "
        "anomaly_percentile, behaviour_anomaly_percentile, risk_reason FROM res WHERE risk_level = 'High'")
    o["export_dataset" + s] = _m("SELECT * FROM export")
    o["export_csv" + s] = _m("SELECT * FROM export")
    o["export_checks" + s] = _m("SELECT COUNT(*) AS total_rows, CAST(SUM(model_eligible_flag) AS BIGINT) AS "
                                "model_eligible, CAST(45 AS BIGINT) AS total_columns FROM export")
    o["export_preview" + s] = _m(
        "SELECT SalesOrderID, CustomerID, order_value, risk_level, transaction_risk_score, model_eligible_flag, "
        "behaviour_anomaly_score, behaviour_anomaly_percentile, behaviour_top_1pct, behaviour_top_5pct, "
        "behaviour_top_10pct FROM export ORDER BY SalesOrderID LIMIT 6")
    o["overview_kpis" + s] = _m(
        "SELECT COUNT(*) AS total_transactions, CAST(SUM(flagged_transaction_flag) AS BIGINT) AS "
        "flagged_transactions, CAST(SUM(high_risk_flag) AS BIGINT) AS high_risk_transactions, "
        "CAST(SUM(model_eligible_flag) AS BIGINT) AS model_eligible_transactions FROM export")
    o["investigation_queue" + s] = _m(
        "SELECT transaction_risk_score, risk_level, risk_reason, behaviour_anomaly_percentile, SalesOrderID, "
        "CustomerID, order_value, days_since_previous_order, prior_order_count, amount_vs_customer_avg "
        "FROM export WHERE flagged_transaction_flag = 1")
    cents = "CAST(ROUND({} * 100) AS BIGINT)"
    o["behaviour_dashboard" + s] = _m(f"""
        SELECT CASE WHEN days_since_previous_order IS NULL THEN 'First order'
                    WHEN days_since_previous_order = 0 THEN 'Same day'
                    WHEN days_since_previous_order BETWEEN 1 AND 7 THEN '1-7 days'
                    WHEN days_since_previous_order BETWEEN 8 AND 30 THEN '8-30 days'
                    WHEN days_since_previous_order BETWEEN 31 AND 90 THEN '31-90 days'
                    ELSE 'More than 90 days' END AS order_gap_segment,
               COUNT(*) AS transactions, CAST(SUM(flagged_transaction_flag) AS BIGINT) AS flagged_transactions,
               CAST(SUM(behaviour_top_5pct) AS BIGINT) AS behaviour_top_5pct,
               CAST(SUM(amount_spike_flag) AS BIGINT) AS amount_spikes,
               {r('CAST(SUM(' + cents.format('amount_vs_customer_avg') + ') AS DOUBLE) / CAST(COUNT(amount_vs_customer_avg) * 100 AS DOUBLE)')}
                   AS avg_amount_vs_customer_avg
        FROM export GROUP BY 1""")
    fv = f"SUM(CASE WHEN flagged_transaction_flag = 1 THEN {cents.format('order_value')} END)"
    o["geography_dashboard" + s] = _m(f"""
        SELECT billing_city, shipping_city, transactions, mismatch_transactions,
               CAST(v AS DOUBLE) / 100 AS total_order_value, CAST(COALESCE(fv, 0) AS DOUBLE) / 100 AS flagged_order_value,
               {r('CAST(COALESCE(fv, 0) AS DOUBLE) * 100 / CAST(SUM(fv) OVER () AS DOUBLE)')} AS flagged_value_share
        FROM (SELECT billing_city, shipping_city, COUNT(*) AS transactions,
                     CAST(SUM(geographic_mismatch_flag) AS BIGINT) AS mismatch_transactions,
                     SUM({cents.format('order_value')}) AS v, {fv} AS fv
              FROM export GROUP BY billing_city, shipping_city) g""")
    o["customer_dashboard" + s] = _m(f"""
        SELECT CustomerID, COUNT(*) AS transactions, CAST(SUM({cents.format('order_value')}) AS DOUBLE) / 100
                   AS total_order_value,
               CAST(COALESCE({fv}, 0) AS DOUBLE) / 100 AS flagged_order_value,
               CAST(SUM(flagged_transaction_flag) AS BIGINT) AS flagged_transactions,
               CAST(SUM(high_risk_flag) AS BIGINT) AS high_risk_transactions,
               MAX(transaction_risk_score) AS max_transaction_risk_score,
               {r('CAST(SUM(CAST(FLOOR(behaviour_anomaly_percentile * 1e9 + 0.5) AS BIGINT)) AS DOUBLE) / (COUNT(behaviour_anomaly_percentile) * 1e9)', 4)}
                   AS avg_behaviour_percentile,
               {r('MAX(behaviour_anomaly_percentile)', 4)} AS max_behaviour_percentile
        FROM export GROUP BY CustomerID""")
    o["score_histogram_standin"] = _hist_res()
    o["published_overview_kpis_standin"] = o["overview_kpis" + s]
    o["monthly_flagged_rate"] = with_binding(f"""
        SELECT order_year_month, COUNT(*) AS total_transactions,
               CAST(SUM(flagged_transaction_flag) AS BIGINT) AS flagged_transactions,
               CAST(SUM(high_risk_flag) AS BIGINT) AS high_risk_transactions,
               {r('CAST(SUM(flagged_transaction_flag) AS DOUBLE) * 100 / CAST(COUNT(*) AS DOUBLE)')}
                   AS flagged_transaction_rate
        FROM ds GROUP BY order_year_month""")
    o["published_monthly_risk"] = o["monthly_flagged_rate"]
    o["ratio_bands" + s] = _m("""
        SELECT CAST(CASE WHEN amount_vs_customer_avg IS NULL THEN -1 WHEN amount_vs_customer_avg < 1 THEN 0
                         WHEN amount_vs_customer_avg < 2 THEN 1 WHEN amount_vs_customer_avg < 3 THEN 2
                         WHEN amount_vs_customer_avg < 5 THEN 3 ELSE 4 END AS INTEGER) AS ratio_band,
               COUNT(*) AS transactions, CAST(SUM(same_day_repeat_flag) AS BIGINT) AS same_day_repeats,
               CAST(SUM(rapid_repeat_flag) AS BIGINT) AS rapid_repeats,
               CAST(SUM(flagged_transaction_flag) AS BIGINT) AS flagged_transactions
        FROM export GROUP BY ratio_band""")
    o["geography_by_state" + s] = _m("""
        SELECT side, state, COUNT(*) AS transactions, CAST(SUM(geographic_mismatch_flag) AS BIGINT) AS mismatch_transactions,
               CAST(SUM(flagged_transaction_flag) AS BIGINT) AS flagged_transactions,
               CAST(SUM(CAST(ROUND(order_value * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_order_value
        FROM (SELECT 'billing' AS side, billing_state AS state, * FROM export
              UNION ALL SELECT 'shipping' AS side, shipping_state AS state, * FROM export) x
        GROUP BY side, state""")
    o["customer_ranking" + s] = _m("""
        SELECT RANK() OVER (ORDER BY flagged DESC) AS customer_rank, CustomerID, transactions,
               CAST(flagged AS DOUBLE) / 100 AS flagged_order_value
        FROM (SELECT CustomerID, COUNT(*) AS transactions,
                     SUM(CASE WHEN flagged_transaction_flag = 1 THEN CAST(ROUND(order_value * 100) AS BIGINT) ELSE 0 END) AS flagged
              FROM export GROUP BY CustomerID) x""")
    o["investigation_queue_filtered" + s] = _m("""
        SELECT transaction_risk_score, risk_level, risk_reason, behaviour_anomaly_percentile, SalesOrderID, CustomerID,
               order_value, days_since_previous_order, prior_order_count, amount_vs_customer_avg
        FROM export WHERE flagged_transaction_flag = 1 AND transaction_risk_score IN (2, 3)
          AND risk_reason IN (""" + ", ".join(f"'{x}'" for x in (K.REASON_SAME_DAY, K.REASON_SPIKE)) + ")")
    o["behaviour_counts" + s] = _m(_cross("behaviour_anomaly_score", BEH_TOPS))
    for name in ("ratio_bands", "geography_by_state", "customer_ranking"):
        o[name] = o[name + s]
    # reports that hold no score are the same for every scorer
    for name in ("export_checks", "overview_kpis", "geography_dashboard"):
        o[name] = o[name + s]
    o["model_input_initial"] = _input_oracle(INITIAL, INITIAL_LOGS)
    o["model_input_behaviour"] = _input_oracle(BEHAVIOUR, BEHAVIOUR_LOGS)
    o["scaled_check_initial"] = _scaled_oracle(INITIAL, INITIAL_LOGS)
    o["scaled_check_behaviour"] = _scaled_oracle(BEHAVIOUR, BEHAVIOUR_LOGS)
    o["forest_invariants"] = with_binding(f"""
        SELECT CAST(300 AS BIGINT) AS trees, CAST(LEAST(256, COUNT(*) FILTER (WHERE NOT {UNSCORED})) AS BIGINT) AS least_root_rows,
               CAST(LEAST(256, COUNT(*) FILTER (WHERE NOT {UNSCORED})) AS BIGINT) AS most_root_rows,
               CAST(COUNT(*) FILTER (WHERE NOT {UNSCORED}) AS BIGINT) AS scored_rows,
               CAST(COUNT(*) FILTER (WHERE {UNSCORED}) AS BIGINT) AS unscored_rows,
               CAST(0 AS BIGINT) AS scores_out_of_range, CAST(0 AS BIGINT) AS wrong_flags
        FROM ds WHERE prior_order_count > 0""")
    o["stored_model_scores"] = _stored_model_oracle()
    return o


def _hist_res(bins: int = 50) -> str:
    return _m(f""", vals AS (SELECT anomaly_score AS v FROM res WHERE anomaly_score IS NOT NULL),
        rng0 AS (SELECT MIN(v) AS lo0, MAX(v) AS hi0 FROM vals),
        rng AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                       CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM rng0),
        b AS (SELECT LEAST(CAST(FLOOR((v - lo) / (hi - lo) * {bins}) AS BIGINT) + 1, {bins}) AS bin
              FROM vals, rng WHERE v >= lo AND v <= hi),
        c AS (SELECT bin, COUNT(*) AS n FROM b GROUP BY bin),
        g AS (SELECT CAST(range AS BIGINT) AS bin FROM range(1, {bins + 1}))
        SELECT g.bin, lo + (g.bin - 1) * (hi - lo) / {bins} AS bin_start, lo + g.bin * (hi - lo) / {bins} AS bin_end,
               CAST(COALESCE(c.n, 0) AS BIGINT) AS count
        FROM g CROSS JOIN rng LEFT JOIN c ON g.bin = c.bin""")


def _stored_model_oracle() -> str:
    """The rule's node table walked from the root, one level per round; a leaf adds the mean path of its rows."""
    columns = {c: k for k, c in enumerate(INITIAL)}
    scaled = ", ".join(f"(f_{c} - {2.0 * k}) / {1 + k / 2}" for c, k in columns.items())
    path = "CASE {n} WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 * (LN({n} - 1) + 0.5772156649015329) - 2 * CAST({n} - 1 AS DOUBLE) / {n} END"
    return with_binding(f"""
        , x AS (SELECT SalesOrderID, [{scaled}] AS z FROM ({_input(INITIAL, INITIAL_LOGS)}) i),
        nodes AS (SELECT t.range AS tree, n.range AS node, (t.range + n.range) % 6 AS feature,
                         CAST((7 * n.range + 3 * t.range) % 11 - 5 AS DOUBLE) / 4 AS threshold, 1 + (5 * n.range + t.range) % 9 AS size
                  FROM range(12) t, range(31) n),
        walk AS (
            SELECT SalesOrderID, z, t.range AS tree, CAST(0 AS BIGINT) AS node FROM x, range(12) t
            UNION ALL
            SELECT w.SalesOrderID, w.z, w.tree, 2 * w.node + CASE WHEN w.z[n.feature + 1] <= n.threshold THEN 1 ELSE 2 END
            FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE w.node < 15),
        paths AS (SELECT w.SalesOrderID, AVG(4 + {path.format(n='n.size')}) AS h FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node
                  WHERE w.node >= 15 GROUP BY w.SalesOrderID)
        SELECT SalesOrderID, {r(f"POW(2, -h / ({path.format(n='64')})) - 0.5", 6)} AS anomaly_score FROM paths""").replace("WITH ", "WITH RECURSIVE ", 1)
