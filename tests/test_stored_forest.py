"""Stored forests: save and load, versions, and scores by a recursive walk in SQL over the stored tables."""

import duckdb
import pytest

from riskloom.config import ForestConfig
from riskloom.operators import compare, forest, marts, scoring
from riskloom.sources.binding import bind_driver_tables


@pytest.fixture(scope="module")
def dataset(spark):
    roles = bind_driver_tables(spark, "/root/testdata/sf0.001")
    return marts.vw_fraud_analytics_dataset(scoring.score_transactions(roles.tx, roles.addr))


@pytest.fixture(scope="module")
def fitted(dataset):
    return compare.fit_model(dataset, "initial", ForestConfig(n_trees=40))


def scores(df):
    return {r.SalesOrderID: r.anomaly_score for r in df.collect()}


def test_a_loaded_model_scores_as_the_saved_one(spark, dataset, fitted, tmp_path):
    path = str(tmp_path / "model")
    assert forest.load_forest(spark, path) is None
    assert forest.save_forest(spark, fitted, path) == 1
    loaded = forest.load_forest(spark, path)
    assert scores(loaded.score(dataset)) == scores(fitted.score(dataset))
    assert (loaded.model.features, loaded.log_cols, loaded.scaler, loaded.version) == (fitted.model.features, fitted.log_cols, fitted.scaler, 1)


def test_versions_stay_and_a_broken_save_leaves_none(spark, dataset, fitted, tmp_path):
    path = str(tmp_path / "model")
    forest.save_forest(spark, fitted, path)
    other = compare.fit_model(dataset, "behaviour", ForestConfig(n_trees=10))
    fitted.model.nodes.head(3).to_parquet(str(tmp_path / "half.parquet"))  # nodes without a version row are not a model
    assert forest.save_forest(spark, other, path) == 2
    assert forest.load_forest(spark, path).model.n_trees == 10
    assert scores(forest.load_forest(spark, path, 1).score(dataset)) == scores(fitted.score(dataset))
    assert forest.load_forest(spark, path, 3) is None


def test_new_rows_are_scored_by_the_stored_scaler(spark, dataset, fitted):
    """A share of the rows scores as it does among all rows: nothing is fitted again."""
    part = dataset.where("SalesOrderID % 7 = 3")
    whole = scores(fitted.score(dataset))
    assert scores(fitted.score(part)) == {k: v for k, v in whole.items() if k % 7 == 3}


def test_fitted_scores_equal_a_walk_in_sql(spark, dataset, fitted, tmp_path):
    path = str(tmp_path / "model")
    forest.save_forest(spark, fitted, path)
    forest.transform_initial(forest.eligible(dataset)).write.parquet(str(tmp_path / "input"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW nodes AS SELECT * FROM read_parquet('{path}/nodes-1/*.parquet')")
    con.execute(f"CREATE VIEW meta AS SELECT * FROM read_parquet('{path}/versions/*.parquet')")
    scaled = ", ".join(f"(x.f_{c} - m.means[{k + 1}]) / m.deviations[{k + 1}]" for k, c in enumerate(forest.INITIAL_FEATURES))
    size = "CASE WHEN {0} <= 1 THEN 0 WHEN {0} = 2 THEN 1 ELSE 2 * (LN({0} - 1) + 0.5772156649015329) - 2 * CAST({0} - 1 AS DOUBLE) / {0} END"
    found = dict(con.execute(f"""
        WITH RECURSIVE x AS (SELECT SalesOrderID, [{scaled}] AS z FROM read_parquet('{tmp_path}/input/*.parquet') x, meta m),
        walk AS (
            SELECT x.SalesOrderID, x.z, n.tree, n.node, n.feature, n.threshold, n."left", n."right", n.size, n.depth FROM x, nodes n WHERE n.node = 0
            UNION ALL
            SELECT w.SalesOrderID, w.z, n.tree, n.node, n.feature, n.threshold, n."left", n."right", n.size, n.depth FROM walk w
            JOIN nodes n ON n.tree = w.tree AND n.node = CASE WHEN w.z[w.feature + 1] <= w.threshold THEN w."left" ELSE w."right" END WHERE w.feature >= 0)
        SELECT SalesOrderID, POW(2, -AVG(depth + {size.format('size')}) / (SELECT {size.format('psi')} FROM meta)) + (SELECT "offset" FROM meta)
        FROM walk WHERE feature < 0 GROUP BY SalesOrderID""").fetchall())
    ours = scores(fitted.score(dataset))
    assert found.keys() == ours.keys() and len(ours) > 1000
    assert all(abs(found[k] - ours[k]) < 1e-9 for k in ours)
