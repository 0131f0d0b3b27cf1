"""Bench: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each job is executed completely with the ``noop`` sink (no collect to the
driver). Times are the median wall seconds of three runs, after one warm-up
run of the scoring job. Every run starts from the tables: nothing may be held
in the block stores, and a job that finds a stored copy fails. Shuffle bytes
come from Spark's event log in a scratch folder. Core counts other than the
driver's: set BENCH_CPUS.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.config import RiskConfig  # noqa: E402
from riskloom.functions.ranking import average_rank_pct  # noqa: E402
from riskloom.operators import compare, forest, marts, scoring  # noqa: E402
from riskloom.session import local_session  # noqa: E402
from riskloom.sources.binding import bind_driver_tables  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def shuffled(events: str, windows: dict[str, tuple[float, float]]) -> dict[str, float]:
    """MB that the last run of each job wrote to shuffles."""
    out = dict.fromkeys(windows, 0.0)
    for name in os.listdir(events):
        with open(os.path.join(events, name)) as lines:
            for line in lines:
                if not line.startswith('{"Event":"SparkListenerTaskEnd"'):
                    continue
                e = json.loads(line)
                n = (e.get("Task Metrics") or {}).get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                for job, (lo, hi) in windows.items():
                    if lo <= e["Task Info"]["Launch Time"] <= hi:
                        out[job] += n / 1e6
    return {k: round(v, 1) for k, v in out.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    events = tempfile.mkdtemp(prefix="riskloom-events-")
    os.environ["PYSPARK_SUBMIT_ARGS"] = (
        f"--conf spark.eventLog.enabled=true --conf spark.eventLog.dir=file://{events} "
        "--conf spark.eventLog.compress=false --conf spark.eventLog.rolling.enabled=false pyspark-shell")
    spark = local_session(cpus, app="riskloom-bench", shuffle_partitions=max(8, int(cpus) * 2))
    cfg = RiskConfig()

    def risk():
        r = bind_driver_tables(spark, sf_dir)
        return scoring.score_transactions(r.tx, r.addr, cfg)

    def ds():
        return marts.vw_fraud_analytics_dataset(risk())

    run(risk())  # warm-up (JVM, Python workers, file listing)
    times, windows = {}, {}

    def timed(name, fn, runs: int = 3):
        # median of `runs` timed runs (after the common warm-up)
        samples = []
        for _ in range(runs):
            if not spark.sparkContext._jsc.getPersistentRDDs().isEmpty():
                raise RuntimeError(f"{name} would start from a stored copy")
            began, t0 = time.time(), time.perf_counter()
            fn()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
        windows[name] = (began * 1000, time.time() * 1000)

    timed("g1_score_transactions", lambda: run(risk()))
    timed("h4_customer_risk_summary", lambda: run(marts.vw_customer_risk_summary(risk())))
    timed("i6_monthly_risk", lambda: run(marts.monthly_risk(ds())))
    timed("m11_ratio_percentile_rank",
          lambda: run(average_rank_pct(ds().select("SalesOrderID", "amount_vs_customer_avg"),
                                       "amount_vs_customer_avg", "pct")))
    timed("m5_m6_forest_fit_score",
          lambda: run(compare.forest_scores(ds(), forest.INITIAL_FEATURES, forest.INITIAL_LOG, "anomaly_score")))
    def q9():
        # under a name of its own, so that no run finds a stored copy
        run(compare.export_stored(*compare.stored_models(ds(), f"bench_{uuid.uuid4().hex}", "forest")))

    timed("q9_export_dataset", q9)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "shuffle_mb": shuffled(events, windows), "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
