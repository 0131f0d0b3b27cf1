"""A* source audit: source profile, column profile, volumes, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import cents_to_money, round_half_up
from ..sources import warehouse
from . import column_profile

# Fixed name patterns of the published table inventory (natural order).
SOURCE_PATTERNS = ("customer", "salesorder", "creditcard", "personcredit", "purchaseorder",
                   "vendor", "transactionhistory", "employee", "address")
CORE_TABLES = ("customer", "creditcard", "personcreditcard", "salesorderheader",
               "salesorderdetail", "address")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def tables_like(tables: dict[str, DataFrame], patterns=SOURCE_PATTERNS) -> list[str]:
    """Names containing any of the patterns (``LIKE '%p%'``), sorted."""
    return sorted(n for n in tables if any(p.lower() in n.lower() for p in patterns))


def audit_tables(tables: dict[str, DataFrame], patterns=SOURCE_PATTERNS) -> DataFrame:
    """A1: matching tables with rows, columns and NULL cells (one pass each)."""
    frames = []
    for name in tables_like(tables, patterns):
        df = tables[name]
        nulls = [F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)) for c in df.columns]
        null_cells = reduce(lambda a, b: a + b, nulls, F.lit(0)).cast("bigint")
        frames.append(df.agg(F.count(F.lit(1)).alias("row_count"), null_cells.alias("null_cells"))
                        .select(F.lit(name).alias("table_name"), "row_count",
                                F.lit(len(df.columns)).cast("bigint").alias("column_count"),
                                "null_cells"))
    return _union(frames).orderBy("table_name")


def audit_catalog(spark: SparkSession, database: str, patterns=SOURCE_PATTERNS) -> DataFrame:
    """A1 over the catalog: the tables and views of a database whose names match, with rows, columns and NULL cells."""
    names = [r["table_name"] for r in warehouse.tables_like(spark, database, patterns).collect()]  # names of a catalog
    return audit_tables({n: spark.table(f"{database}.{n}") for n in names}, patterns)


def audit_columns(tables: dict[str, DataFrame], names=CORE_TABLES) -> DataFrame:
    """A2: column inventory in ordinal order with NULL count, minimum, maximum and approximate distinct count.

    One aggregate per table; see :mod:`riskloom.operators.column_profile` for
    profiles that are stored by part and united without another scan.
    """
    profiles = [column_profile.profile_parts(tables[name], name) for name in names if name in tables]
    return column_profile.described(_union(profiles)).orderBy("table_name", "ordinal_position")


def table_volumes(tables: dict[str, DataFrame], names=CORE_TABLES) -> DataFrame:
    """A3: row counts of the core tables in one row."""
    counts = _union([tables[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("t"), "n")
                     for n in names if n in tables])
    return counts.agg(*[F.max(F.when(F.col("t") == n, F.col("n"))).alias(f"{n}_rows")
                        for n in names if n in tables])


def transaction_coverage(tx: DataFrame) -> DataFrame:
    """A4: first and last order date, orders and active customers.

    Dates and orders are aggregated along with the customers' bitmaps, bucket
    by bucket; orders without a customer form a bucket of their own.
    """
    buckets = tx.groupBy(F.bitmap_bucket_number("CustomerID").alias("bucket")).agg(
        F.min("OrderDate").alias("first"), F.max("OrderDate").alias("last"), F.count(F.lit(1)).alias("orders"),
        F.bitmap_construct_agg(F.bitmap_bit_position("CustomerID")).alias("customers"))
    active = F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("customers")))
    return buckets.agg(F.min("first").alias("first_order_date"), F.max("last").alias("last_order_date"),
                       F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"), F.coalesce(active, F.lit(0)).alias("active_customers"))


def value_baseline(tx: DataFrame) -> DataFrame:
    """A5: minimum, average, maximum and total order value."""
    a = tx.agg(F.min("TotalDue").alias("mn"), F.max("TotalDue").alias("mx"),
               F.sum("TotalDue").alias("s"), F.count("TotalDue").alias("n"))
    return a.select(
        cents_to_money("mn").alias("min_order_value"),
        round_half_up(F.col("s").cast("double") / (F.col("n") * 100).cast("double"), 2).alias("avg_order_value"),
        cents_to_money("mx").alias("max_order_value"),
        cents_to_money("s").alias("total_order_value"),
    )


def customer_purchasing(tx: DataFrame) -> DataFrame:
    """Per customer order count, average, maximum and total spend."""
    g = tx.groupBy("CustomerID").agg(
        F.count(F.lit(1)).alias("order_count"), F.count("TotalDue").alias("_n"),
        F.sum("TotalDue").alias("_s"), F.max("TotalDue").alias("_mx"))
    return g.select(
        "CustomerID", "order_count",
        round_half_up(F.col("_s").cast("double") / (F.col("_n") * 100).cast("double"), 2).alias("avg_order_value"),
        cents_to_money("_mx").alias("max_order_value"),
        cents_to_money("_s").alias("total_spend"),
    ).orderBy(F.col("order_count").desc(), "CustomerID")


def order_frequency_distribution(tx: DataFrame) -> DataFrame:
    """Number of customers per order count."""
    per = tx.groupBy("CustomerID").agg(F.count(F.lit(1)).alias("order_count"))
    return (per.groupBy("order_count").agg(F.count(F.lit(1)).alias("customer_count"))
               .orderBy("order_count"))


def customer_cards(cust: DataFrame, bridge: DataFrame, card: DataFrame, limit: int = 100) -> DataFrame:
    """Customers with a PersonID, their registered cards and card details."""
    c = cust.where(F.col("PersonID").isNotNull()).select("CustomerID", "PersonID")
    b = bridge.select(F.col("BusinessEntityID").alias("_b_person"), F.col("CreditCardID"))
    k = card.select(F.col("CreditCardID").alias("_k_id"), "CardType", "ExpMonth", "ExpYear")
    j = (c.join(b, F.col("PersonID") == F.col("_b_person"), "left")
          .join(k, F.col("CreditCardID") == F.col("_k_id"), "left"))
    return (j.select("CustomerID", "PersonID", "CreditCardID", "CardType", "ExpMonth", "ExpYear")
             .orderBy(F.col("CustomerID").asc_nulls_first(), F.col("CreditCardID").asc_nulls_first())
             .limit(limit))


def order_locations(tx: DataFrame, addr: DataFrame, limit: int = 100) -> DataFrame:
    """Orders with billing and shipping city / state, first by id."""
    from .geopay import with_locations
    g = with_locations(tx.select("SalesOrderID", "CustomerID", "TotalDue", "BillToAddressID",
                                 "ShipToAddressID"), addr)
    return (g.select("SalesOrderID", "CustomerID", cents_to_money("TotalDue").alias("order_value"),
                     "BillToAddressID", "billing_city", "billing_state",
                     "ShipToAddressID", "shipping_city", "shipping_state")
             .orderBy("SalesOrderID").limit(limit))
