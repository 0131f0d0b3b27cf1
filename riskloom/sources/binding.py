"""Role binding: any source tables -> the six roles the analyses read.

The analyses never read a table by name. They read roles:

* ``tx``     one row per order: SalesOrderID, CustomerID, OrderDate, DueDate,
             ShipDate, TotalDue (integer cents), OnlineOrderFlag,
             CreditCardID, BillToAddressID, ShipToAddressID
* ``cust``   CustomerID, PersonID
* ``bridge`` BusinessEntityID (= PersonID), CreditCardID
* ``card``   CreditCardID, CardType, ExpMonth, ExpYear
* ``addr``   AddressID, City, StateProvinceID
* ``detail`` order lines (counted only)

``bind_driver_tables`` maps the TPC-H style driver tables to these roles;
``bind_events`` maps purchase events (no geography, no cards).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import to_cents

# Fixed values of the driver binding: priorities counted as online orders,
# the segment whose customers have no PersonID, the return flag that marks a
# registered card.
ONLINE_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")
NO_PERSON_SEGMENT = "MACHINERY"
REGISTERED_RETURN_FLAG = "A"
SUPPLIER_KEY_RANGE = 1 << 32

# Columns of an order that come from the order table alone, and those that need
# the order's lines, its customer or its supplier.
CORE_COLUMNS = ("SalesOrderID", "CustomerID", "OrderDate", "TotalDue", "OnlineOrderFlag")
LINE_COLUMNS = ("DueDate", "ShipDate", "CreditCardID", "ShipToAddressID")
SCORE_COLUMNS = (*CORE_COLUMNS, "CreditCardID", "BillToAddressID", "ShipToAddressID")
TX_COLUMNS = ("SalesOrderID", "CustomerID", "OrderDate", "DueDate", "ShipDate", "TotalDue",
              "OnlineOrderFlag", "CreditCardID", "BillToAddressID", "ShipToAddressID")


@dataclass(frozen=True)
class Roles:
    tx: DataFrame
    cust: DataFrame
    bridge: DataFrame
    card: DataFrame
    addr: DataFrame
    detail: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        """The roles under the names of the original schema."""
        return {
            "customer": self.cust,
            "creditcard": self.card,
            "personcreditcard": self.bridge,
            "salesorderheader": self.tx,
            "salesorderdetail": self.detail,
            "address": self.addr,
        }


# Declared schemas of the driver tables: reads need no schema-inference job
# (and no footer reads at planning time on a large table).
DRIVER_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in DRIVER_SCHEMAS:
        reader = reader.schema(DRIVER_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bind_orders(spark: SparkSession, sf_dir: str, columns=TX_COLUMNS) -> DataFrame:
    """The ``tx`` role with ``columns`` only.

    The line table, customers and suppliers are joined only for columns that
    come from them; a question about orders alone reads the order table alone.
    """
    orders = read_table(spark, sf_dir, "orders")
    tx = orders.select(
        F.col("o_orderkey").alias("SalesOrderID"),
        F.col("o_custkey").alias("CustomerID"),
        F.col("o_orderdate").alias("OrderDate"),
        to_cents("o_totalprice").alias("TotalDue"),
        F.when(F.col("o_orderpriority").isin(*ONLINE_PRIORITIES), 1).otherwise(0).alias("OnlineOrderFlag"),
    )
    if set(columns) & set(LINE_COLUMNS):
        lines = first_lines(read_table(spark, sf_dir, "lineitem"))
        tx = tx.join(lines, F.col("SalesOrderID") == F.col("l_orderkey"), "left")
    if "BillToAddressID" in columns:
        customer = read_table(spark, sf_dir, "customer")
        tx = tx.join(customer.select("c_custkey", F.col("c_nationkey").cast("bigint").alias("BillToAddressID")),
                     F.col("CustomerID") == F.col("c_custkey"), "left")
    if "ShipToAddressID" in columns:
        supplier = read_table(spark, sf_dir, "supplier")
        tx = tx.join(supplier.select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("ShipToAddressID")),
                     F.col("CreditCardID") == F.col("s_suppkey"), "left")
    return tx.select(*[c for c in TX_COLUMNS if c in columns])


def first_lines(lineitem: DataFrame) -> DataFrame:
    """Per order: ship and due date and the card (supplier of the first line).

    Line numbers repeat inside an order, so the supplier breaks ties. The pair
    is packed into one bigint - line number in the high 32 bits, supplier in
    the low ones - so the smallest pair is a plain min and the aggregate stays
    hash based. A supplier that does not fit raises an error.
    """
    supplier = F.col("l_suppkey")
    fits = supplier.isNull() | ((supplier >= 0) & (supplier < SUPPLIER_KEY_RANGE))
    packed = F.when(fits, F.col("l_linenumber").cast("bigint") * F.lit(SUPPLIER_KEY_RANGE) + supplier).otherwise(
        F.raise_error(F.concat(F.lit("supplier key outside 0 ... 2^32 - 1: "), supplier.cast("string"))).cast("bigint"))
    return lineitem.groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("ShipDate"),
        F.max("l_shipdate").alias("DueDate"),
        F.min(packed).alias("_first_line"),
    ).select("l_orderkey", "ShipDate", "DueDate",
             F.pmod(F.col("_first_line"), F.lit(SUPPLIER_KEY_RANGE)).alias("CreditCardID"))


def bind_driver_tables(spark: SparkSession, sf_dir: str, columns=TX_COLUMNS) -> Roles:
    orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")
    customer = read_table(spark, sf_dir, "customer")
    supplier = read_table(spark, sf_dir, "supplier")
    nation = read_table(spark, sf_dir, "nation")

    tx = bind_orders(spark, sf_dir, columns)
    cust = customer.select(
        F.col("c_custkey").alias("CustomerID"),
        F.when(F.col("c_mktsegment") == NO_PERSON_SEGMENT, F.lit(None).cast("bigint"))
        .otherwise(F.col("c_custkey")).alias("PersonID"),
    )
    bridge = (
        lineitem.where(F.col("l_returnflag") == REGISTERED_RETURN_FLAG)
        .select("l_orderkey", F.col("l_suppkey").alias("CreditCardID"))
        .join(orders.select("o_orderkey", F.col("o_custkey").alias("BusinessEntityID")),
              F.col("l_orderkey") == F.col("o_orderkey"))
        .select("BusinessEntityID", "CreditCardID")
        .distinct()
    )
    card = supplier.select(
        F.col("s_suppkey").alias("CreditCardID"),
        F.col("s_name").alias("CardType"),
        (F.lit(1) + F.col("s_suppkey") % 12).cast("int").alias("ExpMonth"),
        (F.lit(2000) + F.col("s_suppkey") % 8).cast("int").alias("ExpYear"),
    )
    addr = nation.select(
        F.col("n_nationkey").cast("bigint").alias("AddressID"),
        F.col("n_name").alias("City"),
        F.col("n_regionkey").alias("StateProvinceID"),
    )
    return Roles(tx=tx, cust=cust, bridge=bridge, card=card, addr=addr, detail=lineitem)


def bind_events(spark: SparkSession, sf_dir: str, event_type: str = "purchase") -> DataFrame:
    """Purchase events as a ``tx`` role without addresses or cards."""
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == event_type)
    return ev.select(
        F.col("event_id").alias("SalesOrderID"),
        F.col("user_id").alias("CustomerID"),
        F.col("ts").alias("OrderDate"),
        F.lit(None).cast("timestamp_ntz").alias("DueDate"),
        F.lit(None).cast("timestamp_ntz").alias("ShipDate"),
        to_cents("value").alias("TotalDue"),
        F.lit(1).alias("OnlineOrderFlag"),
        F.lit(None).cast("bigint").alias("CreditCardID"),
        F.lit(None).cast("bigint").alias("BillToAddressID"),
        F.lit(None).cast("bigint").alias("ShipToAddressID"),
    )
