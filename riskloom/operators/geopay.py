"""C3 billing / shipping geography and the F* payment and geography analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import cents_to_money, flag

# Fixed labels of the published analyses.
SAME_STATE = "Same state/province"
DIFFERENT_STATE = "Different state/province"
CARD_NONE = "No card used"
CARD_UNAVAILABLE = "Customer card ownership unavailable"
CARD_REGISTERED = "Registered customer card"
CARD_NOT_REGISTERED = "Card not registered to customer"


def with_locations(df: DataFrame, addr: DataFrame) -> DataFrame:
    """Left join the address dimension twice: as billing and as shipping place.

    AddressID must be unique in ``addr`` (a repeated id would multiply rows).
    """
    # no hint: the planner and AQE broadcast the dimension by its bytes, or not
    a = addr.select("AddressID", "City", "StateProvinceID")
    bill = a.select(F.col("AddressID").alias("_bill_id"), F.col("City").alias("billing_city"),
                    F.col("StateProvinceID").alias("billing_state"))
    ship = a.select(F.col("AddressID").alias("_ship_id"), F.col("City").alias("shipping_city"),
                    F.col("StateProvinceID").alias("shipping_state"))
    return (df.join(bill, F.col("BillToAddressID") == F.col("_bill_id"), "left")
              .join(ship, F.col("ShipToAddressID") == F.col("_ship_id"), "left"))


def city_mismatch():
    return flag(F.col("billing_city") != F.col("shipping_city"))


def state_mismatch():
    return flag(F.col("billing_state") != F.col("shipping_state"))


def location_relationship(tx: DataFrame, addr: DataFrame) -> DataFrame:
    """same vs different state; an unknown place counts as different."""
    g = with_locations(tx.select("BillToAddressID", "ShipToAddressID"), addr)
    rel = F.when(F.col("billing_state") == F.col("shipping_state"), SAME_STATE).otherwise(DIFFERENT_STATE)
    return (g.groupBy(rel.alias("location_relationship"))
             .agg(F.count(F.lit(1)).alias("transaction_count"))
             .orderBy(F.col("transaction_count").desc(), "location_relationship"))


def _geo_features(tx: DataFrame, addr: DataFrame) -> DataFrame:
    g = with_locations(tx, addr)
    return g.withColumns({
        "billing_shipping_city_mismatch_flag": city_mismatch(),
        "billing_shipping_state_mismatch_flag": state_mismatch(),
    })


def location_mismatches(tx: DataFrame, addr: DataFrame) -> DataFrame:
    """orders whose billing and shipping city or state differ (unknown: no)."""
    g = _geo_features(tx, addr)
    return (g.where((F.col("billing_shipping_city_mismatch_flag") == 1)
                    | (F.col("billing_shipping_state_mismatch_flag") == 1))
             .select("SalesOrderID", "CustomerID", "OrderDate",
                     cents_to_money("TotalDue").alias("order_value"),
                     "billing_city", "billing_state", "shipping_city", "shipping_state",
                     "billing_shipping_city_mismatch_flag", "billing_shipping_state_mismatch_flag"))


def geographic_indicators(tx: DataFrame, addr: DataFrame) -> DataFrame:
    """F2 with channel and card."""
    g = _geo_features(tx, addr)
    return (g.where((F.col("billing_shipping_city_mismatch_flag") == 1)
                    | (F.col("billing_shipping_state_mismatch_flag") == 1))
             .select("SalesOrderID", "CustomerID", "OrderDate",
                     cents_to_money("TotalDue").alias("order_value"),
                     "OnlineOrderFlag", "CreditCardID",
                     "billing_city", "billing_state", "shipping_city", "shipping_state",
                     "billing_shipping_city_mismatch_flag", "billing_shipping_state_mismatch_flag"))


def card_verification_status(tx: DataFrame, cust: DataFrame, bridge: DataFrame) -> DataFrame:
    """Per order the card status, tested in the published order.

    The correlated EXISTS becomes a left join to the *de-duplicated* bridge,
    so a pair listed twice does not double the order.
    """
    c = cust.select(F.col("CustomerID").alias("_c_id"), "PersonID").dropDuplicates(["_c_id"])
    pairs = (bridge.select(F.col("BusinessEntityID").alias("_b_person"),
                           F.col("CreditCardID").alias("_b_card"))
             .where(F.col("_b_person").isNotNull() & F.col("_b_card").isNotNull())
             .distinct().withColumn("_registered", F.lit(True)))
    t = tx.select("SalesOrderID", "CustomerID", "CreditCardID", "OnlineOrderFlag")
    j = (t.join(c, F.col("CustomerID") == F.col("_c_id"), "left")
          .join(pairs, (F.col("PersonID") == F.col("_b_person"))
                & (F.col("CreditCardID") == F.col("_b_card")), "left"))
    status = (F.when(F.col("CreditCardID").isNull(), CARD_NONE)
               .when(F.col("PersonID").isNull(), CARD_UNAVAILABLE)
               .when(F.col("_registered"), CARD_REGISTERED)
               .otherwise(CARD_NOT_REGISTERED))
    return j.select("SalesOrderID", "CustomerID", "CreditCardID", "OnlineOrderFlag", "PersonID",
                    status.alias("card_verification_status"))


def card_verification(tx: DataFrame, cust: DataFrame, bridge: DataFrame) -> DataFrame:
    """orders per card status."""
    s = card_verification_status(tx, cust, bridge)
    return (s.groupBy("card_verification_status")
             .agg(F.count(F.lit(1)).alias("transaction_count"))
             .orderBy(F.col("transaction_count").desc(), "card_verification_status"))


def shared_cards(bridge: DataFrame, cust: DataFrame, card: DataFrame) -> DataFrame:
    """cards linked to more than one customer."""
    c = cust.select("CustomerID", "PersonID").where(F.col("PersonID").isNotNull())
    linked = bridge.join(c, bridge["BusinessEntityID"] == c["PersonID"], "inner")
    # distinct (card, customer) pairs first: partial aggregation, then count
    pairs = linked.select(bridge["CreditCardID"], c["CustomerID"]).distinct()
    per_card = pairs.groupBy("CreditCardID").agg(F.count("CustomerID").alias("associated_customer_count"))
    cards = card.select(F.col("CreditCardID").alias("_card_id"), "CardType")
    out = (per_card.where(F.col("associated_customer_count") > 1)
           .join(cards, F.col("CreditCardID") == F.col("_card_id"), "left"))
    return (out.select("CreditCardID", "CardType", "associated_customer_count")
               .orderBy(F.col("associated_customer_count").desc(), "CreditCardID"))
