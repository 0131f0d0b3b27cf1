"""Hand-made rows hitting every rule branch (expected values written by hand)."""

from datetime import datetime

from pyspark.sql import types as T

ADDR = [(1, "Madrid", 10), (2, "Toledo", 10), (3, "Porto", 20), (4, None, None), (5, "Madrid", 20)]

# order, customer, date, value (money), ship address
ORDERS = [
    (101, 1, "2024-01-01 00:00", 100.00, 1), (102, 1, "2024-01-01 00:00", 100.00, 1),
    (103, 1, "2024-01-08 00:00", 300.00, 1), (104, 1, "2024-01-08 00:00", 600.00, 3),
    (105, 1, "2024-01-16 00:00", 50.00, 2), (106, 1, "2024-02-15 00:00", 50.00, 5),
    (107, 1, "2024-05-16 00:00", 50.00, 4), (108, 1, "2024-06-16 00:00", 50.00, None),
    (201, 2, "2024-01-01 00:00", 10.00, 1), (202, 2, "2024-01-02 00:00", 1000.00, 1),
    (203, 2, "2024-01-09 00:00", 1513.00, 1),
    (301, 3, "2024-01-01 00:00", 0.00, 1), (302, 3, "2024-03-01 00:00", 0.00, 1),
    (303, 3, "2024-03-31 00:00", 20.00, 1),
    (401, 4, "2024-01-01 23:59", 5.00, 1), (402, 4, "2024-01-02 00:01", 5.00, 1),
]

# order -> (score, level, reason)
EXPECTED = {
    101: (0, "Low", "No risk indicators"),
    102: (2, "Medium", "Same-day repeat"),
    103: (4, "High", "Rapid repeat (1-7 days), Amount spike"),
    104: (7, "High", "Same-day repeat, Amount spike, State/province mismatch"),
    105: (1, "Medium", "City mismatch"),
    106: (2, "Medium", "State/province mismatch"),
    107: (0, "Low", "No risk indicators"),
    108: (0, "Low", "No risk indicators"),
    201: (0, "Low", "No risk indicators"),
    202: (1, "Medium", "Rapid repeat (1-7 days)"),
    203: (1, "Medium", "Rapid repeat (1-7 days)"),
    301: (0, "Low", "No risk indicators"),
    302: (0, "Low", "No risk indicators"),
    303: (0, "Low", "No risk indicators"),
    401: (0, "Low", "No risk indicators"),
    402: (1, "Medium", "Rapid repeat (1-7 days)"),
}

TX_SCHEMA = T.StructType([
    T.StructField("SalesOrderID", T.LongType()), T.StructField("CustomerID", T.LongType()),
    T.StructField("OrderDate", T.TimestampNTZType()), T.StructField("DueDate", T.TimestampNTZType()),
    T.StructField("ShipDate", T.TimestampNTZType()), T.StructField("TotalDue", T.LongType()),
    T.StructField("OnlineOrderFlag", T.IntegerType()), T.StructField("CreditCardID", T.LongType()),
    T.StructField("BillToAddressID", T.LongType()), T.StructField("ShipToAddressID", T.LongType()),
])


def tx_frame(spark, orders=ORDERS):
    rows = []
    for oid, cust, d, value, ship in orders:
        ts = datetime.strptime(d, "%Y-%m-%d %H:%M")
        rows.append((oid, cust, ts, ts, ts, round(value * 100), 1, None, 1, ship))
    return spark.createDataFrame(rows, TX_SCHEMA)


def addr_frame(spark):
    return spark.createDataFrame(ADDR, "AddressID bigint, City string, StateProvinceID int")
