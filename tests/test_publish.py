import os
import tempfile
import uuid

from riskloom.operators import compare, dashboards, marts, scoring
from riskloom.plans.publish import publish_marts
from riskloom.sources.binding import bind_driver_tables


def test_publish_and_report_from_written_marts(spark):
    roles = bind_driver_tables(spark, "/root/testdata/sf0.001")
    base = os.path.join(tempfile.mkdtemp(prefix="riskloom-pub-"), "p")
    pub = publish_marts(spark, roles, scorer="ratio", base=base)
    ds = pub.read_dataset(spark)
    ex = pub.read_export(spark)
    assert ds.count() == 1500 and ex.count() == 1500
    assert len(ex.columns) == 45
    # reports read the written tables and agree with the lineage-based ones
    live = marts.monthly_risk(marts.vw_fraud_analytics_dataset(scoring.score_transactions(roles.tx, roles.addr)))
    assert sorted(marts.monthly_risk(ds).collect()) == sorted(live.collect())
    k = dashboards.overview_kpis(ex).first()
    assert k.total_transactions == 1500 and k.model_eligible_transactions == 1350


def test_month_filter_prunes_partitions(spark):
    import contextlib
    import io
    roles = bind_driver_tables(spark, "/root/testdata/sf0.001")
    base = os.path.join(tempfile.mkdtemp(prefix="riskloom-pub-"), "p")
    pub = publish_marts(spark, roles, scorer="ratio", base=base)
    one = pub.read_dataset(spark).where("order_year_month = '1998-08'")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        one.explain("formatted")
    assert "PartitionFilters: [isnotnull(order_year_month" in buf.getvalue()
    live = marts.vw_fraud_analytics_dataset(scoring.score_transactions(roles.tx, roles.addr))
    assert one.count() == live.where("order_year_month = '1998-08'").count() > 0


def test_export_from_bucketed_tables_moves_no_rows(spark):
    roles = bind_driver_tables(spark, "/root/testdata/sf0.001")
    ds = marts.vw_fraud_analytics_dataset(scoring.score_transactions(roles.tx, roles.addr))
    stored = compare.stored_models(ds, f"publish_test_{uuid.uuid4().hex}", "ratio")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables beyond the limit are joined
    try:
        export = compare.export_stored(*stored)
        plan = export._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
        rows = sorted(map(str, export.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == sorted(map(str, compare.export_dataset(ds, compare.model_scores(ds, "ratio")).collect()))


def test_bucketed_tables_are_shared_and_seen_by_other_sessions(spark, tmp_path):
    from riskloom.functions.bucketed import bucketed_once, buckets_of, table_name
    folder = str(tmp_path / "in")
    spark.range(100).write.parquet(f"{folder}/t.parquet")
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(f"{folder}/t.parquet").withColumnRenamed("id", "k")
    one = bucketed_once(spark, folder, "t", "k", build)
    assert bucketed_once(spark, folder, "t", "k", build).count() == one.count() == 100 and len(built) == 1
    assert buckets_of(spark, table_name(spark, folder, "t")) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.newSession().table(table_name(spark, folder, "t")).count() == 100
    spark.range(7).write.mode("overwrite").parquet(f"{folder}/t.parquet")  # another state of the input is another table
    assert bucketed_once(spark, folder, "t", "k", build).count() == 7 and len(built) == 2


def _columns_at(df, node):
    """The columns that pass the optimised plan's first node of that name, down its left sides."""
    at = df._jdf.queryExecution().optimizedPlan()
    while at.nodeName() != node:
        at = at.children().apply(0)
    return {at.output().apply(i).name() for i in range(at.output().size())}


def test_rows_pass_the_exchange_to_their_buckets_before_they_are_scored(spark):
    roles = bind_driver_tables(spark, "/root/testdata/sf0.001")
    plain = marts.vw_fraud_analytics_dataset(scoring.score_transactions(roles.tx, roles.addr))
    dealt = marts.vw_fraud_analytics_dataset(scoring.score_transactions(roles.tx, roles.addr, deal=lambda rows: rows.repartition(5, "SalesOrderID")))
    passed = _columns_at(dealt, "RepartitionByExpression")
    assert "SalesOrderID" in passed and len(passed) <= 12 and not passed & {"risk_reason", "billing_city", "velocity_risk_points"}
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))


def test_dealt_rows_are_written_a_file_a_bucket(spark):
    from pyspark.sql import functions as F
    from riskloom.functions.bucketed import write_bucketed
    rows = spark.range(1000).select((F.col("id") % 333).alias("k"), "id")
    wide = rows.repartition(5, "k").withColumn("twice", F.col("id") * 2)
    table = write_bucketed(wide, f"dealt_test_{uuid.uuid4().hex}", "k", 5, dealt=True)
    assert len(table.inputFiles()) == 5
    assert sorted(table.collect()) == sorted(wide.collect())


def test_marts_are_dealt_out_by_month_before_they_are_scored(spark, monkeypatch):
    from riskloom.plans import publish
    seen, write = {}, publish.write_mart

    def spy(df, path, *a, **k):
        seen[os.path.basename(path)] = df
        return write(df, path, *a, **k)
    monkeypatch.setattr(publish, "write_mart", spy)
    roles = bind_driver_tables(spark, "/root/testdata/sf0.001")
    base = os.path.join(tempfile.mkdtemp(prefix="riskloom-pub-"), "p")
    pub = publish_marts(spark, roles, scorer="ratio", base=base)
    for df in seen.values():
        passed = _columns_at(df, "RebalancePartitions")
        assert "SalesOrderID" in passed and len(passed) <= 21 and not passed & {"risk_reason", "billing_city", "velocity_risk_points"}
    live = marts.vw_fraud_analytics_dataset(scoring.score_transactions(roles.tx, roles.addr))
    columns = live.columns
    assert sorted(map(str, pub.read_dataset(spark).select(columns).collect())) == sorted(map(str, live.collect()))
    export = compare.export_dataset(live, compare.model_scores(live, "ratio"))
    assert sorted(map(str, pub.read_export(spark).select(export.columns).collect())) == sorted(map(str, export.collect()))


def test_repeated_ids_are_published_as_the_score_joins_make_them(spark):
    from dataclasses import replace
    from pyspark.sql import functions as F
    roles = bind_driver_tables(spark, "/root/testdata/sf0.001")
    tx = roles.tx.where("SalesOrderID < 200")
    roles = replace(roles, tx=tx.unionByName(tx.where("SalesOrderID % 3 = 0")).withColumn("SalesOrderID", F.when(F.col("SalesOrderID") != 7, F.col("SalesOrderID"))))
    base = os.path.join(tempfile.mkdtemp(prefix="riskloom-pub-"), "p")
    pub = publish_marts(spark, roles, scorer="ratio", base=base)
    ds = pub.read_dataset(spark)
    export = compare.export_dataset(ds, compare.model_scores(ds, "ratio"))
    assert ds.count() == roles.tx.count()
    assert sorted(map(str, pub.read_export(spark).select(export.columns).collect())) == sorted(map(str, export.collect()))
