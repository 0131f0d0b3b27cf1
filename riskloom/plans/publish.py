"""Publish the shared marts once; reports then read tables, not lineage.

``publish_marts`` computes the scored dataset and the export a single time,
writes them as Parquet under the shared folder the session names in
``spark.checkpoint.dir`` (partitioned by month for pruned reads), and returns
readers over the written files. Writing cuts the lineage: a lost executor
only re-reads files, and twenty reports do not each re-run the history scan.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.caching import is_written
from ..operators import compare, marts, scoring
from ..operators.baselines import customer_history
from ..session import ensure_checkpoint_dir
from ..sources.binding import SCORE_COLUMNS, Roles
from ..sources.io import write_mart


@dataclass(frozen=True)
class Published:
    dataset: str
    export: str

    def read_dataset(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.dataset)

    def read_export(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.export)


def existing(spark: SparkSession, base: str, name: str) -> Published | None:
    """What an earlier ``publish_marts`` of that name wrote whole, if it did."""
    found = Published(dataset=os.path.join(base, f"{name}_dataset"), export=os.path.join(base, f"{name}_export"))
    return found if is_written(spark, found.dataset) and is_written(spark, found.export) else None


def publish_marts(spark: SparkSession, roles: Roles, name: str = "risk", scorer: str = "forest",
                  base: str | None = None) -> Published:
    """Write the 36-column dataset and the 45-column export (both by month)."""
    base = base or os.path.join(ensure_checkpoint_dir(spark), "published")
    cfg = RiskConfig()
    # the history is stored by its scan; both marts are dealt out by month while
    # they are as narrow as it, and scored behind that exchange
    history = customer_history(roles.tx.select(*[c for c in roles.tx.columns if c in SCORE_COLUMNS]), cfg, with_max=False)

    def by_month(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_month", F.year("OrderDate") * 12 + F.month("OrderDate")).hint("rebalance", "_month")

    def scored(rows: DataFrame, *more: str) -> DataFrame:
        risk = scoring.with_score(scoring.history_features(rows, roles.addr, cfg, cfg.rapid_min_days), cfg)
        return marts.vw_fraud_analytics_dataset(scoring.risk_projection(risk, *more), *more)
    ds_path = os.path.join(base, f"{name}_dataset")
    write_mart(scored(by_month(history)), ds_path, "order_year_month", dealt=True)
    # the models read the written dataset
    scores = compare.model_scores(spark.read.parquet(ds_path), scorer, stored=False)
    ex_path = os.path.join(base, f"{name}_export")
    write_mart(compare.export_from_history(history, scores, scored, by_month), ex_path, "order_year_month", dealt=True)
    return Published(dataset=ds_path, export=ex_path)
