import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskloom.config import ForestConfig
from riskloom.operators import forest as M


def _frame(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"SalesOrderID": np.arange(n), "a": rng.normal(0, 1, n), "b": rng.normal(0, 1, n),
                        "c": np.ones(n)})
    out = [n - 1, n - 2, n - 3]
    pdf.loc[out, ["a", "b"]] = [[8.0, 8.0], [-9.0, 7.0], [10.0, -8.0]]
    return spark.createDataFrame(pdf), out


def test_planted_outliers_rank_top(spark):
    df, out = _frame(spark)
    model = M.fit_isolation_forest(df, ["a", "b", "c"], ForestConfig(n_trees=100))
    s = M.score(df, model).toPandas().set_index("SalesOrderID")["anomaly_score"]
    assert s.between(-0.5, 0.5).all()
    top = set(s.sort_values(ascending=False).index[:int(len(s) * 0.01)])
    assert set(out) <= top
    assert (s.loc[out] > 0).all()


def test_same_seed_same_forest_under_repartitioning(spark):
    df, _ = _frame(spark, n=1500)
    cfg = ForestConfig(n_trees=50)
    a = M.fit_isolation_forest(df, ["a", "b", "c"], cfg).nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    b = M.fit_isolation_forest(df.repartition(7, F.rand(1)), ["a", "b", "c"], cfg).nodes
    b = b.sort_values(["tree", "node"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_small_input_and_constant_columns(spark):
    df, _ = _frame(spark, n=40)
    model = M.fit_isolation_forest(df, ["a", "b", "c"], ForestConfig(n_trees=20))
    assert model.psi == 40
    assert (model.nodes.feature != 2).all()   # the constant column never splits
    assert M.score(df, model).count() == 40


def test_path_length_constant():
    assert M.average_path_length(np.array([0, 1, 2]))[2] == 1.0
    assert abs(M.average_path_length(np.array([256]))[0] - 10.2448) < 1e-3


def test_wrapper_api(spark):
    df, out = _frame(spark, n=800)
    f = M.IsolationForest(ForestConfig(n_trees=40)).fit(df)
    s = f.score(df).toPandas().set_index("SalesOrderID")["anomaly_score"]
    assert len(s) == 800 and s.loc[out].min() > s.median()


def test_scoring_needs_memory_for_rows_not_for_rows_times_trees():
    """A batch walks tree after tree: equal to the walk of all trees at once, bit by bit, in a small part of its memory."""
    import tracemalloc

    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    names = [f"f{k}" for k in range(4)]
    trees = []
    for t in range(60):
        own = pd.DataFrame(x[rng.choice(600, 128, replace=False)], columns=names).assign(tree=t, __h=rng.random(128), __id=np.arange(128))
        trees.append(M._build_tree(own, names, 128, 7))
    arr = M.IsolationForestModel(names, 128, 60, -0.5, pd.concat(trees)).arrays()
    rows = rng.normal(size=(12_000, 4))
    rows[::50, 1] = np.nan
    idx = np.repeat(arr["roots"][:, None], len(rows), axis=1)
    for _ in range(arr["steps"]):
        go_left = rows.T[arr["feature"][idx], np.arange(len(rows))[None, :]] <= arr["threshold"][idx]
        idx = np.where(go_left, arr["left"][idx], arr["right"][idx])
    expected = np.power(2.0, -arr["leaf"][idx].mean(axis=0) / arr["norm"])
    tracemalloc.start()
    found = M._score_batch(rows, arr)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(found, expected)
    assert peak < 60 * len(rows) * 8 / 4  # one array of a value per row and tree is four times that
