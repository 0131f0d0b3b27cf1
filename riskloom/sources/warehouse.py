"""Tables and views by name.

A warehouse is a Spark database whose tables and views any session of the
application - or, with a shared metastore, any application - reads by name:

* ``<name>_raw`` holds external tables over the source files: nothing is
  copied, and dropping a table leaves its files;
* ``<name>`` holds the six roles as permanent views over them, the scored
  orders as an external table (the history scan behind them runs once, when
  they are published), and the analytical views over that table.

Views are kept as SQL text in the catalog, so they outlive the session that
made them and stack: a view over views is planned as one query, and filters and
columns reach the files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as K
from ..functions.caching import input_key, is_written, run_folder
from .binding import DRIVER_SCHEMAS, NO_PERSON_SEGMENT, ONLINE_PRIORITIES, REGISTERED_RETURN_FLAG, bind_driver_tables

SCORED = "risk_scored"


def _texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# The roles over the source tables ({raw}: their database).
ROLE_VIEWS = {
    "customer": f"""
        SELECT c_custkey AS CustomerID, IF(c_mktsegment = '{NO_PERSON_SEGMENT}', NULL, c_custkey) AS PersonID FROM {{raw}}.customer""",
    "personcreditcard": f"""
        SELECT DISTINCT o_custkey AS BusinessEntityID, l_suppkey AS CreditCardID
        FROM {{raw}}.lineitem JOIN {{raw}}.orders ON l_orderkey = o_orderkey WHERE l_returnflag = '{REGISTERED_RETURN_FLAG}'""",
    "creditcard": """
        SELECT s_suppkey AS CreditCardID, s_name AS CardType, CAST(1 + s_suppkey % 12 AS INT) AS ExpMonth, CAST(2000 + s_suppkey % 8 AS INT) AS ExpYear
        FROM {raw}.supplier""",
    "address": """
        SELECT CAST(n_nationkey AS BIGINT) AS AddressID, n_name AS City, n_regionkey AS StateProvinceID FROM {raw}.nation""",
    "salesorderdetail": "SELECT * FROM {raw}.lineitem",
    "salesorderheader": f"""
        SELECT o_orderkey AS SalesOrderID, o_custkey AS CustomerID, o_orderdate AS OrderDate, last_shipped AS DueDate, first_shipped AS ShipDate,
               CAST(ROUND(o_totalprice * 100) AS BIGINT) AS TotalDue, IF(o_orderpriority IN ({_texts(ONLINE_PRIORITIES)}), 1, 0) AS OnlineOrderFlag,
               first_line.l_suppkey AS CreditCardID, CAST(c_nationkey AS BIGINT) AS BillToAddressID, CAST(s_nationkey AS BIGINT) AS ShipToAddressID
        FROM {{raw}}.orders
        LEFT JOIN (SELECT l_orderkey, MIN(l_shipdate) AS first_shipped, MAX(l_shipdate) AS last_shipped, MIN(STRUCT(l_linenumber, l_suppkey)) AS first_line
                   FROM {{raw}}.lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
        LEFT JOIN {{raw}}.customer ON c_custkey = o_custkey
        LEFT JOIN {{raw}}.supplier ON s_suppkey = first_line.l_suppkey""",
}
SOURCES = ("orders", "lineitem", "customer", "supplier", "nation")

_CENTS = "CAST(ROUND(order_value * 100) AS BIGINT)"


def _half_up(x: str) -> str:
    return f"SIGN({x}) * CAST(FLOOR(ABS({x}) * 100.0D + 0.5D) AS DOUBLE) / 100.0D"


def _mean_money() -> str:
    return _half_up(f"(CAST(SUM({_CENTS}) AS DOUBLE) / CAST(COUNT(order_value) * 100 AS DOUBLE))")


# The analytical views over the scored orders ({db}: this database).
RISK_VIEWS = {
    "vw_transaction_risk_analysis": f"SELECT * FROM {{db}}.{SCORED}",
    "vw_high_risk_transactions": f"""
        SELECT * EXCEPT (previous_order_date, velocity_risk_points, behavioural_risk_points, geographic_risk_points)
        FROM {{db}}.vw_transaction_risk_analysis WHERE risk_level = '{K.LEVEL_HIGH}'""",
    "vw_risk_level_summary": f"""
        SELECT risk_level, COUNT(*) AS transaction_count, {_half_up("(CAST(COUNT(*) AS DOUBLE) * 100 / CAST(SUM(COUNT(*)) OVER () AS DOUBLE))")} AS percentage_of_transactions,
               {_half_up(f"(CAST(SUM({_CENTS}) AS DOUBLE) / 100)")} AS total_order_value, {_mean_money()} AS avg_order_value,
               {_half_up(f"(CAST(MAX({_CENTS}) AS DOUBLE) / 100)")} AS max_order_value
        FROM {{db}}.vw_transaction_risk_analysis GROUP BY risk_level""",
    "vw_customer_risk_summary": f"""
        SELECT CustomerID, COUNT(*) AS total_transactions, {_half_up(f"(CAST(SUM({_CENTS}) AS DOUBLE) / 100)")} AS total_order_value, {_mean_money()} AS avg_order_value,
               MAX(transaction_risk_score) AS max_transaction_risk_score,
               {_half_up("(CAST(SUM(transaction_risk_score) AS DOUBLE) / CAST(COUNT(transaction_risk_score) AS DOUBLE))")} AS avg_transaction_risk_score,
               COUNT_IF(risk_level = '{K.LEVEL_HIGH}') AS high_risk_transactions, COUNT_IF(risk_level = '{K.LEVEL_MEDIUM}') AS medium_risk_transactions,
               SUM(same_day_repeat_flag) AS same_day_repeat_count, SUM(rapid_repeat_flag) AS rapid_repeat_count, SUM(amount_spike_flag) AS amount_spike_count,
               SUM(city_mismatch_flag) AS city_mismatch_count, SUM(state_mismatch_flag) AS state_mismatch_count
        FROM {{db}}.vw_transaction_risk_analysis GROUP BY CustomerID""",
    "vw_fraud_analytics_dataset": f"""
        SELECT *, IF(risk_level = '{K.LEVEL_HIGH}', 1, 0) AS high_risk_flag, IF(risk_level IN ('{K.LEVEL_HIGH}', '{K.LEVEL_MEDIUM}'), 1, 0) AS flagged_transaction_flag,
               CASE risk_level WHEN '{K.LEVEL_HIGH}' THEN 3 WHEN '{K.LEVEL_MEDIUM}' THEN 2 ELSE 1 END AS risk_level_order,
               same_day_repeat_flag + rapid_repeat_flag + amount_spike_flag + geographic_mismatch_flag AS risk_flag_count
        FROM (SELECT *, YEAR(OrderDate) AS order_year, MONTH(OrderDate) AS order_month, DATE_FORMAT(OrderDate, 'yyyy-MM') AS order_year_month,
                     GREATEST(same_day_repeat_flag, rapid_repeat_flag) AS velocity_risk_flag, GREATEST(city_mismatch_flag, state_mismatch_flag) AS geographic_mismatch_flag
              FROM {{db}}.vw_transaction_risk_analysis)""",
}


@dataclass(frozen=True)
class Warehouse:
    """A database of roles and analytical views over the tables of one folder."""

    database: str

    @property
    def raw(self) -> str:
        return f"{self.database}_raw"

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """Every table and view of the catalog's database, by name."""
        return {t.name: spark.table(f"{self.database}.{t.name}") for t in spark.catalog.listTables(self.database) if not t.isTemporary}


def tables_like(spark: SparkSession, database: str, patterns) -> DataFrame:
    """(table_name) of the catalog's tables and views whose name holds any of the patterns, whatever the case."""
    names = [(t.name,) for t in spark.catalog.listTables(database) if not t.isTemporary]
    asked = reduce(lambda a, b: a | b, [F.col("table_name").ilike(f"%{p}%") for p in patterns], F.lit(False))
    return spark.createDataFrame(names, "table_name string").where(asked).orderBy("table_name")


def external_table(spark: SparkSession, database: str, name: str, path: str, schema: str | None = None) -> None:
    """An external Parquet table over files that stay where they are."""
    columns = f"({schema})" if schema else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.`{name}` {columns} USING parquet LOCATION '{path}'")


def register_sql_views(spark: SparkSession, database: str, views: dict[str, str], **names: str) -> None:
    """Create-or-replace permanent views from SQL text, in order, so later ones may read earlier ones."""
    for name, text in views.items():
        spark.sql(f"CREATE OR REPLACE VIEW {database}.`{name}` AS {text.format(**names)}")


def open_warehouse(spark: SparkSession, folder: str, name: str | None = None) -> Warehouse:
    """The warehouse over this state of ``folder``: made at first use, found by its name later."""
    house = Warehouse(name or f"riskloom_{input_key(spark, folder)[:16]}")
    base = f"{run_folder(spark)}/warehouse"
    for database in (house.raw, house.database):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{base}/{database}'")
    if not spark.catalog.tableExists(f"{house.database}.salesorderheader"):
        for source in SOURCES:
            external_table(spark, house.raw, source, f"{folder.rstrip('/')}/{source}.parquet", DRIVER_SCHEMAS[source])
        register_sql_views(spark, house.database, ROLE_VIEWS, raw=house.raw)
    return house


def publish_views(spark: SparkSession, folder: str, name: str | None = None) -> Warehouse:
    """The warehouse with the scored orders and the analytical views over them."""
    from ..operators import scoring
    house = open_warehouse(spark, folder, name)
    path = f"{run_folder(spark)}/warehouse/{house.database}/{SCORED}"
    if not is_written(spark, path):
        roles = bind_driver_tables(spark, folder)
        # the scan's own stored partitions set the files: the wide rows are not dealt out once more
        scoring.score_transactions(roles.tx, roles.addr).write.mode("overwrite").parquet(path)
    if not spark.catalog.tableExists(f"{house.database}.vw_fraud_analytics_dataset"):
        external_table(spark, house.database, SCORED, path)
        register_sql_views(spark, house.database, RISK_VIEWS, db=house.database)
    return house
