"""C1, X50-X54 by increments: a state per customer, so a new month scans only its own rows.

What a new order needs of its customer's past fits in one row: how many orders,
how many with a value, their sum and maximum, and the last order (date, id,
value). States merge - counts and sums add, maxima nest, the later of two last
orders stays - so the state of all history is the merge of the states of its
parts, and the history of a part's rows is a scan of the part joined with the
state before it. The join has one state row per customer; a customer with a
third of the part's orders is on the side that skew splitting cuts.

Parts must come in the order of the history: every order of a later part
follows all orders of earlier parts in (OrderDate, SalesOrderID). Orders
without a date come before all others, so they belong to the first part;
orders without a customer form one customer, as in the full scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.caching import is_written

STATE_SCHEMA = ("CustomerID bigint, orders bigint, valued_orders bigint, total_cents bigint, max_cents bigint, "
                "last struct<OrderDate: timestamp_ntz, SalesOrderID: bigint, TotalDue: bigint>")


def state_of(tx: DataFrame) -> DataFrame:
    """The state of a set of orders: one partial aggregate per task and customer."""
    return tx.groupBy("CustomerID").agg(
        F.count(F.lit(1)).alias("orders"), F.count("TotalDue").alias("valued_orders"), F.coalesce(F.sum("TotalDue"), F.lit(0)).alias("total_cents"),
        F.max("TotalDue").alias("max_cents"), F.max(F.struct("OrderDate", "SalesOrderID", "TotalDue")).alias("last"))


def merged(*states: DataFrame) -> DataFrame:
    """The state of all orders behind some states."""
    every = states[0]
    for other in states[1:]:
        every = every.unionByName(other)
    return every.groupBy("CustomerID").agg(
        *[F.sum(c).alias(c) for c in ("orders", "valued_orders", "total_cents")], F.max("max_cents").alias("max_cents"), F.max("last").alias("last"))


def with_state(scanned: DataFrame, state: DataFrame) -> DataFrame:
    """The running columns of a part's own scan, continued from the state before the part."""
    before = state.select(F.col("CustomerID").alias("_s_customer"), "orders", "valued_orders", "total_cents", "max_cents", "last")
    joined = scanned.join(before, F.col("CustomerID").eqNullSafe(F.col("_s_customer")), "left")
    first = F.col("prior_order_count") == 0  # in this part: the order before it is the state's last

    def plus(column: str, stored: str):
        return F.col(column) + F.coalesce(F.col(stored), F.lit(0))
    made = {"previous_order_date": F.when(first, F.col("last.OrderDate")).otherwise(F.col("previous_order_date")),
            "prior_order_count": plus("prior_order_count", "orders"), "_prior_sum": plus("_prior_sum", "total_cents"),
            "_prior_nn": plus("_prior_nn", "valued_orders")}
    if "_prior_max" in scanned.columns:
        made["_prior_max"] = F.greatest("_prior_max", "max_cents")
    if "_previous_cents" in scanned.columns:
        made["_previous_cents"] = F.when(first, F.col("last.TotalDue")).otherwise(F.col("_previous_cents"))
    return joined.select(*[made[c].alias(c) if c in made else F.col(c) for c in scanned.columns])


class RiskMart:
    """Scored orders by part, and the customers' state after each part, as tables below ``path``.

    A part's rows are written before its state, and both replace what a broken
    run left, so a part is done once its state is whole; running the last part
    again gives the same tables.
    """

    def __init__(self, spark: SparkSession, path: str, cfg: RiskConfig | None = None) -> None:
        self.spark, self.path, self.cfg = spark, path, cfg or RiskConfig()

    def _state_path(self, part: str) -> str:
        return f"{self.path}/state/part={part}"

    def parts(self) -> list[str]:
        """The parts that are done, in order."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        names = sorted(f.getPath().getName().removeprefix("part=") for f in files.listStatus(at))
        return [n for n in names if is_written(self.spark, self._state_path(n))]

    def state(self, part: str | None = None) -> DataFrame | None:
        """The state after ``part`` (the last one), or None before any."""
        done = self.parts()
        if not done:
            return None
        return self.spark.read.schema(STATE_SCHEMA).parquet(self._state_path(part or done[-1]))

    def advance(self, part: str, tx: DataFrame, addr: DataFrame) -> None:
        """Scores the orders of a new part and carries the state on. Parts sort by name in the order of their dates."""
        from . import scoring
        done = self.parts()
        if done and part < done[-1]:
            raise ValueError(f"part {part} lies before {done[-1]}, which is done")
        earlier = [p for p in done if p < part]
        before = self.state(earlier[-1]) if earlier else None
        scored = scoring.risk_projection(scoring.score_frame(tx, addr, self.cfg, before))
        scored.hint("rebalance").write.mode("overwrite").parquet(f"{self.path}/scored/part={part}")
        own = state_of(tx)
        (merged(before, own) if before is not None else own).write.mode("overwrite").parquet(self._state_path(part))

    def scored(self) -> DataFrame:
        """All scored orders of the parts that are done."""
        done = self.parts()
        if not done:
            raise ValueError("no part is done")
        return self.spark.read.option("basePath", f"{self.path}/scored").parquet(*[f"{self.path}/scored/part={p}" for p in done]).drop("part")
