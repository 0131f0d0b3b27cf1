"""B* quality checks and F3 card status on hand-made rows (branches the driver tables never reach)."""

from datetime import datetime

from riskloom.operators import geopay, quality
from tests.fixtures import TX_SCHEMA

D = datetime(2024, 1, 10)
EARLY = datetime(2024, 1, 5)


def _tx(spark, rows):
    full = []
    for r in rows:
        base = dict(SalesOrderID=None, CustomerID=1, OrderDate=D, DueDate=D, ShipDate=D, TotalDue=100,
                    OnlineOrderFlag=1, CreditCardID=None, BillToAddressID=1, ShipToAddressID=1)
        base.update(r)
        full.append(tuple(base[f.name] for f in TX_SCHEMA.fields))
    return spark.createDataFrame(full, TX_SCHEMA)


def test_quality_branches(spark):
    tx = _tx(spark, [
        dict(SalesOrderID=1), dict(SalesOrderID=1),                  # duplicated id
        dict(SalesOrderID=2, CustomerID=None),                       # NULL customer (also an orphan)
        dict(SalesOrderID=3, OrderDate=None),                        # NULL date
        dict(SalesOrderID=4, TotalDue=None),
        dict(SalesOrderID=5, BillToAddressID=None),                  # NULL id counts as missing address
        dict(SalesOrderID=6, ShipToAddressID=None),
        dict(SalesOrderID=None),                                     # NULL order id
        dict(SalesOrderID=7, TotalDue=0),                            # value 0
        dict(SalesOrderID=8, DueDate=EARLY),                         # due before order
        dict(SalesOrderID=9, ShipDate=EARLY),                        # ship before order
        dict(SalesOrderID=10, ShipDate=None),                        # NULL ship date: no match
        dict(SalesOrderID=11, CustomerID=99),                        # unknown customer
        dict(SalesOrderID=12, CreditCardID=777),                     # unknown non-NULL card
        dict(SalesOrderID=13, CreditCardID=5),                       # known card
    ])
    cust = spark.createDataFrame([(1, 1), (2, 2)], "CustomerID bigint, PersonID bigint")  # 2 has no orders
    card = spark.createDataFrame([(5, "Vista", 1, 2030)], "CreditCardID bigint, CardType string, ExpMonth int, ExpYear int")
    addr = spark.createDataFrame([(1, "Madrid", 10)], "AddressID bigint, City string, StateProvinceID int")

    assert [(r.SalesOrderID, r.record_count) for r in quality.duplicate_orders(tx).collect()] == [(1, 2)]
    m = quality.missing_core_fields(tx).first().asDict()
    assert m == {"missing_sales_order_id": 1, "missing_customer_id": 1, "missing_order_date": 1,
                 "missing_total_due": 1, "missing_billing_address": 1, "missing_shipping_address": 1}
    assert quality.invalid_values(tx).first().invalid_order_values == 1
    assert {r.SalesOrderID for r in quality.date_inconsistencies(tx).collect()} == {8, 9}
    assert {r.SalesOrderID for r in quality.orphan_customers(tx, cust).collect()} == {2, 11}
    assert {r.SalesOrderID for r in quality.orphan_cards(tx, card).collect()} == {12}
    assert {r.SalesOrderID for r in quality.orphan_addresses(tx, addr).collect()} == {5, 6}
    cov = quality.customer_coverage(cust, tx).first().asDict()
    assert cov == {"total_customers": 2, "customers_with_orders": 1, "customers_without_orders": 1}
    cc = {r.OnlineOrderFlag: (r.order_count, r.orders_without_card, r.orders_with_card)
          for r in quality.card_coverage(tx).collect()}
    assert cc == {1: (15, 13, 2)}


def test_card_status_order_and_duplicate_bridge(spark):
    tx = _tx(spark, [
        dict(SalesOrderID=1, CustomerID=1, CreditCardID=None),       # no card
        dict(SalesOrderID=2, CustomerID=2, CreditCardID=50),         # PersonID NULL
        dict(SalesOrderID=3, CustomerID=1, CreditCardID=50),         # registered (listed twice)
        dict(SalesOrderID=4, CustomerID=1, CreditCardID=60),         # not registered
        dict(SalesOrderID=5, CustomerID=2, CreditCardID=None),       # card NULL and PersonID NULL
    ])
    cust = spark.createDataFrame([(1, 1), (2, None)], "CustomerID bigint, PersonID bigint")
    bridge = spark.createDataFrame([(1, 50), (1, 50)], "BusinessEntityID bigint, CreditCardID bigint")
    got = {r.SalesOrderID: r.card_verification_status
           for r in geopay.card_verification_status(tx, cust, bridge).collect()}
    assert got == {1: "No card used", 2: "Customer card ownership unavailable", 3: "Registered customer card",
                   4: "Card not registered to customer", 5: "No card used"}
    counts = {r.card_verification_status: r.transaction_count
              for r in geopay.card_verification(tx, cust, bridge).collect()}
    assert counts["Registered customer card"] == 1 and counts["No card used"] == 2
