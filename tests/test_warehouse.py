"""Tables and views by name: catalog scans, stored views, other sessions."""

import uuid

import pytest

from riskloom.operators import audit, marts, scoring
from riskloom.sources import warehouse
from riskloom.sources.binding import bind_driver_tables

SF = "/root/testdata/sf0.001"


def as_rows(df):
    return sorted(map(str, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


def test_roles_as_views_equal_the_binding(spark):
    house = warehouse.open_warehouse(spark, SF)
    roles = bind_driver_tables(spark, SF).tables()
    assert set(house.tables(spark)) - {warehouse.SCORED, *warehouse.RISK_VIEWS} == set(roles)
    for name, df in roles.items():
        assert as_rows(spark.table(f"{house.database}.{name}")) == as_rows(df), name


def test_another_session_reads_the_views(spark):
    house = warehouse.publish_views(spark, SF)
    other = spark.newSession()
    assert not [t for t in other.catalog.listTables() if t.isTemporary and t.name == "vw_fraud_analytics_dataset"]
    levels = other.sql(f"SELECT risk_level, COUNT(*) AS n FROM {house.database}.vw_fraud_analytics_dataset GROUP BY risk_level")
    assert sum(r.n for r in levels.collect()) == 1500
    roles = bind_driver_tables(spark, SF)
    risk = scoring.score_transactions(roles.tx, roles.addr)
    assert as_rows(other.table(f"{house.database}.vw_fraud_analytics_dataset")) == as_rows(marts.vw_fraud_analytics_dataset(risk))
    assert as_rows(other.table(f"{house.database}.vw_customer_risk_summary")) == as_rows(marts.vw_customer_risk_summary(risk))


def test_views_are_kept_as_text_and_prune_files(spark):
    house = warehouse.publish_views(spark, SF)
    text = spark.sql(f"SHOW CREATE TABLE {house.database}.vw_high_risk_transactions").first()[0]
    assert "vw_transaction_risk_analysis" in text
    plan = spark.sql(f"SELECT COUNT(*) FROM {house.database}.vw_fraud_analytics_dataset WHERE risk_level = 'High'")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<risk_level:string>" in plan and "EqualTo(risk_level,High)" in plan


def test_names_come_from_the_catalog(spark):
    house = warehouse.open_warehouse(spark, SF, "riskloom_names_test")
    spark.sql(f"CREATE OR REPLACE VIEW {house.database}.vendor_Employee AS SELECT 1 AS a, CAST(NULL AS INT) AS b")
    spark.sql(f"CREATE OR REPLACE VIEW {house.database}.other AS SELECT 1 AS a")
    spark.range(3).createOrReplaceTempView("customer_temporary")
    found = [r.table_name for r in warehouse.tables_like(spark, house.database, ("EMPLOYEE", "creditcard")).collect()]
    assert found == ["creditcard", "personcreditcard", "vendor_employee"]
    rows = {r.table_name: (r.row_count, r.column_count, r.null_cells) for r in audit.audit_catalog(spark, house.database, ("vendor",)).collect()}
    assert rows == {"vendor_employee": (1, 2, 1)}
    assert warehouse.tables_like(spark, house.database, ()).count() == 0


def test_an_external_table_leaves_its_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    spark.sql("CREATE DATABASE IF NOT EXISTS riskloom_external_test LOCATION '%s'" % (tmp_path / "db"))
    warehouse.external_table(spark, "riskloom_external_test", "t", path)
    assert spark.table("riskloom_external_test.t").count() == 5
    spark.sql("DROP TABLE riskloom_external_test.t")
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        spark.table("riskloom_external_test.t")


def test_scored_orders_are_written_without_another_exchange(spark, monkeypatch):
    """The stored scores are written from the scan's partitions: the wide rows are not dealt out once more."""
    frame = type(spark.range(1))
    hints, hint = [], frame.hint
    monkeypatch.setattr(frame, "hint", lambda self, name, *a: (hints.append(name), hint(self, name, *a))[1])
    house = warehouse.publish_views(spark, SF, f"exchange_{uuid.uuid4().hex[:8]}")
    assert spark.table(f"{house.database}.vw_transaction_risk_analysis").count() == 1500
    assert "rebalance" not in hints
