"""B* data-quality checks on the order table and its dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distinct import distinct_counts, shared_counts
from ..functions.numeric import flag


def duplicate_orders(tx: DataFrame) -> DataFrame:
    """B1: order ids that occur more than once."""
    return (tx.groupBy("SalesOrderID").agg(F.count(F.lit(1)).alias("record_count"))
              .where(F.col("record_count") > 1))


def missing_core_fields(tx: DataFrame) -> DataFrame:
    """B2: NULL counts of six core fields, one row."""
    fields = {
        "missing_sales_order_id": "SalesOrderID",
        "missing_customer_id": "CustomerID",
        "missing_order_date": "OrderDate",
        "missing_total_due": "TotalDue",
        "missing_billing_address": "BillToAddressID",
        "missing_shipping_address": "ShipToAddressID",
    }
    return tx.agg(*[F.sum(flag(F.col(c).isNull())).cast("bigint").alias(name)
                    for name, c in fields.items()])


def invalid_values(tx: DataFrame) -> DataFrame:
    """Orders whose value is zero or negative."""
    return tx.where(F.col("TotalDue") <= 0).agg(F.count(F.lit(1)).alias("invalid_order_values"))


def date_inconsistencies(tx: DataFrame) -> DataFrame:
    """Due or ship date before the order date (NULL dates do not match)."""
    return (tx.where((F.col("DueDate") < F.col("OrderDate")) | (F.col("ShipDate") < F.col("OrderDate")))
              .select("SalesOrderID", "OrderDate", "DueDate", "ShipDate"))


def orphan_customers(tx: DataFrame, cust: DataFrame) -> DataFrame:
    """Orders whose customer is not in the customer table (NULL counts)."""
    c = cust.select(F.col("CustomerID").alias("_c_id"))
    return (tx.join(c, F.col("CustomerID") == F.col("_c_id"), "left_anti")
              .select("SalesOrderID", "CustomerID"))


def orphan_cards(tx: DataFrame, card: DataFrame) -> DataFrame:
    """Orders whose non-NULL card is not in the card table."""
    c = card.select(F.col("CreditCardID").alias("_card_id"))
    return (tx.where(F.col("CreditCardID").isNotNull())
              .join(c, F.col("CreditCardID") == F.col("_card_id"), "left_anti")
              .select("SalesOrderID", "CustomerID", "CreditCardID", "OnlineOrderFlag"))


def orphan_addresses(tx: DataFrame, addr: DataFrame) -> DataFrame:
    """Billing or shipping address missing; NULL ids count as missing."""
    ids = addr.select("AddressID").distinct().withColumn("_hit", F.lit(True))
    bill = ids.select(F.col("AddressID").alias("_b_id"), F.col("_hit").alias("_b_hit"))
    ship = ids.select(F.col("AddressID").alias("_s_id"), F.col("_hit").alias("_s_hit"))
    j = (tx.select("SalesOrderID", "BillToAddressID", "ShipToAddressID")
           .join(bill, F.col("BillToAddressID") == F.col("_b_id"), "left")
           .join(ship, F.col("ShipToAddressID") == F.col("_s_id"), "left"))
    return (j.where(F.col("_b_hit").isNull() | F.col("_s_hit").isNull())
             .select("SalesOrderID", "BillToAddressID", "ShipToAddressID"))


def card_coverage(tx: DataFrame) -> DataFrame:
    """Per channel, orders with and without a card."""
    return (tx.groupBy("OnlineOrderFlag").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum(flag(F.col("CreditCardID").isNull())).cast("bigint").alias("orders_without_card"),
        F.sum(flag(F.col("CreditCardID").isNotNull())).cast("bigint").alias("orders_with_card"),
    ).orderBy("OnlineOrderFlag"))


def customer_coverage(cust: DataFrame, tx: DataFrame) -> DataFrame:
    """Customers, customers with orders, customers without orders.

    The customer x order left join of the published check is replaced by the
    two tables' id bitmaps: no row is joined or multiplied.
    """
    known = shared_counts(cust, "CustomerID", tx, "CustomerID")
    return known.select(F.col("in_one").alias("total_customers"), F.col("in_both").alias("customers_with_orders"),
                        (F.col("in_one") - F.col("in_both")).alias("customers_without_orders"))


def channel_coverage(tx: DataFrame) -> DataFrame:
    """Per channel, orders and the distinct customers with any order, with and without a card, and above 1,000 in value.

    Several conditional distinct counts over one column: one pass of bitmaps.
    """
    paid = F.col("CreditCardID").isNotNull()
    counts = distinct_counts(tx, "CustomerID", {"customers": None, "customers_with_card": paid, "customers_without_card": ~paid,
                                                "customers_above_1000": F.col("TotalDue") > 100_000}, ("OnlineOrderFlag",))
    return counts.orderBy("OnlineOrderFlag")
