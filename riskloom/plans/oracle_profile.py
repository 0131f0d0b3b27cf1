"""DuckDB twins of the P* profile queries (over the ``ds`` CTE of the binding)."""

from __future__ import annotations

from .oracle import r, with_binding

DS_COLUMNS = (
    "SalesOrderID CustomerID OrderDate order_year order_month order_year_month order_value OnlineOrderFlag "
    "CreditCardID previous_order_date days_since_previous_order prior_order_count prior_avg_order_value "
    "amount_vs_customer_avg billing_city billing_state shipping_city shipping_state same_day_repeat_flag "
    "rapid_repeat_flag amount_spike_flag city_mismatch_flag state_mismatch_flag velocity_risk_flag "
    "geographic_mismatch_flag risk_flag_count velocity_risk_points behavioural_risk_points "
    "geographic_risk_points transaction_risk_score risk_dimension_count risk_level risk_reason high_risk_flag "
    "flagged_transaction_flag risk_level_order").split()
NUMERIC = ("order_value", "days_since_previous_order", "prior_order_count", "prior_avg_order_value",
           "amount_vs_customer_avg", "transaction_risk_score")
FLAGS = ("same_day_repeat_flag", "rapid_repeat_flag", "amount_spike_flag", "city_mismatch_flag",
         "state_mismatch_flag")


def _hist(values_sql: str, bins: int = 50, marker: float | None = None) -> str:
    """numpy-style histogram over the range of ``values_sql`` (column v)."""
    mark = ""
    if marker is not None:
        mark = (f", CAST(CASE WHEN bin_start <= {marker} AND (bin_end > {marker} OR (bin = {bins} "
                f"AND bin_end >= {marker})) THEN 1 ELSE 0 END AS INTEGER) AS contains_marker")
    return with_binding(f""", vals AS ({values_sql}),
        rng0 AS (SELECT MIN(v) AS lo0, MAX(v) AS hi0 FROM vals),
        rng AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                       CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM rng0),
        b AS (SELECT LEAST(CAST(FLOOR((v - lo) / (hi - lo) * {bins}) AS BIGINT) + 1, {bins}) AS bin
              FROM vals, rng WHERE v >= lo AND v <= hi),
        c AS (SELECT bin, COUNT(*) AS n FROM b GROUP BY bin),
        g AS (SELECT CAST(range AS BIGINT) AS bin FROM range(1, {bins + 1})),
        h AS (SELECT g.bin, lo + (g.bin - 1) * (hi - lo) / {bins} AS bin_start,
                     lo + g.bin * (hi - lo) / {bins} AS bin_end, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
              FROM g CROSS JOIN rng LEFT JOIN c ON g.bin = c.bin)
        SELECT *{mark} FROM h""").replace("WITH \n", "WITH \n", 1)


def _percentile_rows(col: str, probs) -> str:
    parts = [f"SELECT 'count' AS statistic, CAST(COUNT({col}) AS DOUBLE) AS value FROM ds",
             f"SELECT 'mean', AVG(CAST({col} AS DOUBLE)) FROM ds",
             f"SELECT 'std', STDDEV_SAMP(CAST({col} AS DOUBLE)) FROM ds",
             f"SELECT 'min', CAST(MIN({col}) AS DOUBLE) FROM ds",
             f"SELECT 'max', CAST(MAX({col}) AS DOUBLE) FROM ds"]
    for p in probs:
        parts.append(f"SELECT '{round(p * 100):d}%', QUANTILE_CONT(CAST({col} AS DOUBLE), {p}) FROM ds")
    return with_binding(f"SELECT statistic, {r('value')} AS value FROM ({' UNION ALL '.join(parts)}) t")


def profile_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["dataset_shape"] = with_binding(f"SELECT COUNT(*) AS row_count, CAST({len(DS_COLUMNS)} AS BIGINT) "
                                      f"AS column_count FROM ds")
    cols = ", ".join(DS_COLUMNS)
    o["duplicate_profile"] = with_binding(f"""
        SELECT CAST((SELECT COALESCE(SUM(n - 1), 0) FROM (SELECT COUNT(*) AS n FROM ds GROUP BY {cols}) a)
                    AS BIGINT) AS exact_duplicate_rows,
               CAST((SELECT COALESCE(SUM(n - 1), 0) FROM (SELECT COUNT(*) AS n FROM ds GROUP BY SalesOrderID) b)
                    AS BIGINT) AS duplicate_ids""")
    copies = ("(SELECT * FROM ds UNION ALL SELECT * FROM ds WHERE SalesOrderID % 10 = 0 UNION ALL SELECT * FROM ds WHERE SalesOrderID % 100 = 0 "
              "UNION ALL SELECT * REPLACE (order_value + 1 AS order_value) FROM ds WHERE SalesOrderID % 7 = 0)")
    repeated = f"(SELECT SalesOrderID, copies FROM (SELECT {cols}, COUNT(*) AS copies FROM {copies} u GROUP BY {cols}) g WHERE copies > 1)"
    o["duplicate_profile_planted"] = with_binding(f"""
        SELECT CAST(COALESCE((SELECT SUM(copies - 1) FROM {repeated} a), 0) AS BIGINT) AS exact_duplicate_rows,
               CAST((SELECT COALESCE(SUM(n - 1), 0) FROM (SELECT COUNT(*) AS n FROM {copies} u GROUP BY SalesOrderID) b) AS BIGINT) AS duplicate_ids""")
    o["exact_duplicates_planted"] = with_binding(f"SELECT * FROM {repeated} r")
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "DOUBLE": "double"}
    named = "CASE typeof({0}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.items()) + " ELSE lower(typeof({0})) END"
    o["dataset_types"] = with_binding(" UNION ALL ".join(
        f"SELECT CAST({i + 1} AS BIGINT) AS ordinal_position, '{c}' AS column_name, (SELECT {named.format(c)} FROM ds LIMIT 1) AS data_type, "
        f"(SELECT COUNT({c}) FROM ds) AS non_null_count" for i, c in enumerate(DS_COLUMNS)))
    o["dataset_preview"] = with_binding(f"SELECT {cols} FROM ds ORDER BY SalesOrderID LIMIT 5")
    damaged = "(SalesOrderID % 50 = 0 OR SalesOrderID % 70 = 0)"
    o["checked_csv_good"] = with_binding(f"SELECT {cols} FROM ds WHERE NOT {damaged}")
    o["checked_csv_counts"] = with_binding(f"SELECT COUNT(*) FILTER (NOT {damaged}) AS good_rows, COUNT(*) FILTER ({damaged}) AS rejected_rows FROM ds")
    o["crosstab_level_channel"] = with_binding("SELECT risk_level, " + ", ".join(
        f"COUNT(*) FILTER (OnlineOrderFlag = {c}) AS channel_{c}" for c in (0, 1)) + " FROM ds GROUP BY risk_level")
    segment = ("CASE WHEN days_since_previous_order <= 0 THEN 'Same day' WHEN days_since_previous_order <= 7 THEN '1-7 days' "
               "WHEN days_since_previous_order <= 30 THEN '8-30 days' WHEN days_since_previous_order <= 90 THEN '31-90 days' "
               "WHEN days_since_previous_order > 90 THEN 'More than 90 days' END")
    o["crosstab_level_segment"] = with_binding("SELECT risk_level, " + ", ".join(
        f"""COUNT(*) FILTER ({segment} = '{c}') AS "{c}" """ for c in ("1-7 days", "31-90 days", "8-30 days", "More than 90 days", "Same day"))
        + f', COUNT(*) FILTER ({segment} IS NULL) AS "null" FROM ds GROUP BY risk_level')
    o["pair_counts_segment_reason"] = with_binding(
        f'SELECT {segment} AS "row", risk_reason AS "column", COUNT(*) AS count FROM ds GROUP BY ALL')
    miss = " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing_count, "
                              f"COUNT(*) AS n FROM ds" for c in DS_COLUMNS)
    o["missing_summary"] = with_binding(f"""
        SELECT column_name, missing_count, {r('CAST(missing_count AS DOUBLE) * 100 / CAST(n AS DOUBLE)')}
               AS missing_percentage FROM ({miss}) m WHERE missing_count > 0""")
    desc = " UNION ALL ".join(f"""
        SELECT '{c}' AS column_name, COUNT({c}) AS count, AVG(CAST({c} AS DOUBLE)) AS mean,
               STDDEV_SAMP(CAST({c} AS DOUBLE)) AS std, CAST(MIN({c}) AS DOUBLE) AS min,
               QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25) AS p25, QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5) AS p50,
               QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75) AS p75, CAST(MAX({c}) AS DOUBLE) AS max FROM ds"""
                        for c in NUMERIC)
    o["describe_numeric"] = with_binding(
        "SELECT column_name, count, " + ", ".join(f"{r(c)} AS {c}" for c in
                                                  ("mean", "std", "min", "p25", "p50", "p75", "max"))
        + f" FROM ({desc}) d")
    for name, col in (("value_shares_risk_level", "risk_level"), ("value_shares_channel", "OnlineOrderFlag")):
        o[name] = with_binding(f"""
            SELECT CAST({col} AS VARCHAR) AS value,
                   CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS share
            FROM ds GROUP BY {col}""")
    o["top_reasons"] = with_binding("SELECT risk_reason AS value, COUNT(*) AS count FROM ds GROUP BY risk_reason "
                                    "ORDER BY count DESC, value NULLS FIRST LIMIT 10")
    o["value_percentiles"] = _percentile_rows("order_value", (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
    o["value_histogram"] = _hist("SELECT CAST(order_value AS DOUBLE) AS v FROM ds WHERE order_value IS NOT NULL")
    o["log_value_histogram"] = _hist("SELECT LN(1 + CAST(order_value AS DOUBLE)) AS v FROM ds "
                                     "WHERE order_value IS NOT NULL")
    o["ratio_percentiles"] = _percentile_rows("amount_vs_customer_avg", (0.5, 0.75, 0.9, 0.95, 0.99))
    o["trimmed_ratio_histogram"] = _hist(
        "SELECT amount_vs_customer_avg AS v FROM ds WHERE amount_vs_customer_avg BETWEEN 0 AND "
        "(SELECT QUANTILE_CONT(amount_vs_customer_avg, 0.99) FROM ds)", marker=3.0)
    o["gap_percentiles"] = _percentile_rows("days_since_previous_order", (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
    o["velocity_segments"] = with_binding("""
        , seg AS (SELECT * FROM (VALUES (1, 'Same day'), (2, '1-7 days'), (3, '8-30 days'), (4, '31-90 days'),
                                        (5, 'More than 90 days')) s(segment_order, segment)),
        c AS (SELECT CASE WHEN days_since_previous_order <= 0 THEN 'Same day'
                          WHEN days_since_previous_order <= 7 THEN '1-7 days'
                          WHEN days_since_previous_order <= 30 THEN '8-30 days'
                          WHEN days_since_previous_order <= 90 THEN '31-90 days'
                          ELSE 'More than 90 days' END AS seg, COUNT(*) AS n
              FROM ds WHERE days_since_previous_order > -1 GROUP BY 1)
        SELECT CAST(segment_order AS INTEGER) AS segment_order, segment,
               CAST(COALESCE(n, 0) AS BIGINT) AS transaction_count
        FROM seg LEFT JOIN c ON seg.segment = c.seg""")
    o["indicator_totals"] = with_binding(" UNION ALL ".join(
        f"SELECT '{f}' AS indicator, CAST(SUM({f}) AS BIGINT) AS total FROM ds" for f in FLAGS))
    o["score_counts"] = with_binding("SELECT transaction_risk_score, COUNT(*) AS transaction_count FROM ds "
                                     "GROUP BY transaction_risk_score")
    o["level_counts"] = with_binding("""
        , lv AS (SELECT * FROM (VALUES (1, 'High'), (2, 'Medium'), (3, 'Low')) l(level_order, risk_level)),
        c AS (SELECT risk_level AS lvl, COUNT(*) AS n FROM ds GROUP BY risk_level)
        SELECT CAST(level_order AS INTEGER) AS level_order, risk_level,
               CAST(COALESCE(n, 0) AS BIGINT) AS transaction_count
        FROM lv LEFT JOIN c ON lv.risk_level = c.lvl""")
    cents = "CAST(ROUND({} * 100) AS BIGINT)"
    o["behaviour_by_level"] = with_binding(f"""
        SELECT risk_level, COUNT(SalesOrderID) AS transaction_count,
               {r('CAST(SUM(' + cents.format('order_value') + ') AS DOUBLE) / CAST(COUNT(order_value) * 100 AS DOUBLE)')}
                   AS avg_order_value,
               {r('QUANTILE_CONT(order_value, 0.5)')} AS median_order_value,
               {r('CAST(SUM(days_since_previous_order) AS DOUBLE) / CAST(COUNT(days_since_previous_order) AS DOUBLE)')}
                   AS avg_days_since_previous_order,
               {r('CAST(SUM(' + cents.format('amount_vs_customer_avg') + ') AS DOUBLE) / CAST(COUNT(amount_vs_customer_avg) * 100 AS DOUBLE)')}
                   AS avg_amount_vs_customer_avg,
               {r('CAST(SUM(transaction_risk_score) AS DOUBLE) / CAST(COUNT(transaction_risk_score) AS DOUBLE)')}
                   AS avg_risk_score
        FROM ds GROUP BY risk_level""")
    o["high_risk_review"] = with_binding("""
        SELECT SalesOrderID, CustomerID, OrderDate, order_value, days_since_previous_order, prior_order_count,
               prior_avg_order_value, amount_vs_customer_avg, transaction_risk_score, risk_reason
        FROM ds WHERE risk_level = 'High'""")
    return o
