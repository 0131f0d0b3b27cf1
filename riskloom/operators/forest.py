"""M* anomaly models: a distributed Isolation Forest (Liu, Ting, Zhou 2008).

* **Features** (M1-M4, M13): log transforms and standardisation with the
  population standard deviation, all as column expressions; the scaler
  statistics are one aggregate (2 numbers per feature).
* **Sampling** (M5): every tree needs psi = min(256, n) rows drawn without
  replacement. A Bernoulli pre-sample keyed by a hash of the row id keeps
  about ``oversample * trees * psi`` rows (independent of n); each kept row
  is assigned to ``k`` trees by further hashes, and each tree keeps its psi
  smallest hashes. Only that bounded sample is shuffled, to one group per
  tree (``groupBy("tree").applyInPandas``). Deterministic for a seed and
  independent of the partitioning.
* **Fit**: per tree, random feature among the non-constant ones and a
  uniform threshold between the node's min and max; depth limit
  ceil(log2 psi). The forest is a node table of at most
  ``trees * (2 psi - 1)`` rows - a bound fixed by the configuration - so it
  is broadcast for scoring.
* **Score** (M6): map-only vectorised traversal in ``mapInPandas``;
  ``anomaly_score = 2^(-E[h]/c(psi)) - 0.5`` (higher = stranger, the
  negated decision function with the automatic offset), flagged when > 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ForestConfig
from ..functions.numeric import round_half_up

# Fixed feature lists of the two models.
EULER_GAMMA = 0.5772156649015329

INITIAL_FEATURES = ("order_value", "days_since_previous_order", "prior_order_count",
                    "prior_avg_order_value", "amount_vs_customer_avg", "OnlineOrderFlag")
INITIAL_LOG = ("order_value", "days_since_previous_order", "prior_avg_order_value", "amount_vs_customer_avg")
BEHAVIOUR_FEATURES = ("days_since_previous_order", "prior_order_count", "amount_vs_customer_avg",
                      "OnlineOrderFlag")
BEHAVIOUR_LOG = ("days_since_previous_order", "prior_order_count")


def average_path_length(n):
    """c(n): mean path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb
    return out


# ---------------------------------------------------------------- M1-M4, M13

def model_features(ds: DataFrame, cols=INITIAL_FEATURES) -> DataFrame:
    """M1: the feature columns and their NULL counts (one row)."""
    return ds.agg(*[(F.count(F.lit(1)) - F.count(c)).alias(c) for c in cols])


def eligible(ds: DataFrame) -> DataFrame:
    """M2: rows with customer history (prior order count > 0)."""
    return ds.where(F.col("prior_order_count") > 0)


def eligibility_counts(ds: DataFrame) -> DataFrame:
    """M2 check: first orders, model rows, and model rows a missing feature leaves without a score."""
    missing = F.lit(False)
    for c in dict.fromkeys((*INITIAL_FEATURES, *BEHAVIOUR_FEATURES)):
        v = F.col(c).cast("double")
        missing = missing | v.isNull() | F.isnan(v)
    return ds.agg(F.sum(F.when(F.col("prior_order_count") == 0, 1).otherwise(0)).cast("bigint")
                  .alias("first_transactions"),
                  F.sum(F.when(F.col("prior_order_count") > 0, 1).otherwise(0)).cast("bigint")
                  .alias("model_rows"),
                  F.sum(F.when((F.col("prior_order_count") > 0) & missing, 1).otherwise(0)).cast("bigint")
                  .alias("unscored_rows"))


def transform(x: DataFrame, features, log_cols, id_col: str = "SalesOrderID") -> DataFrame:
    """log1p on ``log_cols``; rows with a missing feature are dropped."""
    cols = [F.col(id_col)]
    for c in features:
        v = F.col(c).cast("double")
        cols.append((F.log1p(v) if c in log_cols else v).alias(f"f_{c}"))
    out = x.select(*cols)
    cond = None
    for c in features:
        ok = F.col(f"f_{c}").isNotNull() & ~F.isnan(f"f_{c}")
        cond = ok if cond is None else cond & ok
    return out.where(cond)


def scaler_stats(x: DataFrame, cols) -> dict:
    """Mean and population standard deviation per column (one aggregate)."""
    row = x.agg(F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(f"m_{c}") for c in cols],
                *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    stats = {"__n": row["__n"]}
    for c in cols:
        sd = row[f"s_{c}"]
        stats[c] = (row[f"m_{c}"] or 0.0, sd if sd and sd > 0 else 1.0)
    return stats


def standardise(x: DataFrame, cols, stats: dict | None = None) -> tuple[DataFrame, dict]:
    """M4: (x - mean) / population std; a constant column is divided by 1."""
    stats = stats or scaler_stats(x, cols)
    return x.withColumns({c: (F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1]) for c in cols}), stats


def row_count(stats: dict) -> int | None:
    return stats.get("__n")


def scaled_check(z: DataFrame, cols) -> DataFrame:
    """M4 check: mean and sample std of each scaled column (2 places)."""
    return z.agg(*[round_half_up(F.avg(c), 2).alias(f"{c}_mean") for c in cols],
                 *[round_half_up(F.stddev_samp(c), 2).alias(f"{c}_std") for c in cols])


# ---------------------------------------------------------------- M5 fit

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType()),
])


def _hash01(*cols):
    # xxhash64 -> [0, 1)
    h = F.xxhash64(*cols)
    return (F.pmod(h, F.lit(1 << 52)).cast("double") / float(1 << 52))


def _build_tree(pdf: pd.DataFrame, features: list[str], psi: int, seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    pdf = pdf.sort_values(["__h", "__id"]).head(psi)
    if len(pdf) < psi:
        raise ValueError(f"tree {tree} got {len(pdf)} of {psi} rows: raise oversample")
    x = pdf[features].to_numpy(dtype=np.float64)
    rng = np.random.default_rng([seed, tree])
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    rows = []

    def grow(idx: np.ndarray, depth: int) -> int:
        me = len(rows)
        rows.append(None)
        n = len(idx)
        if depth >= max_depth or n <= 1:
            rows[me] = (tree, me, -1, 0.0, -1, -1, n, depth)
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        order = rng.permutation(len(features))
        chosen = next((f for f in order if hi[f] > lo[f]), None)
        if chosen is None:
            rows[me] = (tree, me, -1, 0.0, -1, -1, n, depth)
            return me
        thr = rng.uniform(lo[chosen], hi[chosen])
        go_left = sub[:, chosen] <= thr
        left = grow(idx[go_left], depth + 1)
        right = grow(idx[~go_left], depth + 1)
        rows[me] = (tree, me, int(chosen), float(thr), left, right, n, depth)
        return me

    grow(np.arange(len(x)), 0)
    return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])


@dataclass
class IsolationForestModel:
    features: list[str]
    psi: int
    n_trees: int
    offset: float
    nodes: pd.DataFrame

    def arrays(self):
        """Flat node arrays with global child indices (for the broadcast)."""
        nd = self.nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        sizes = nd.groupby("tree").size()
        firsts = np.concatenate([[0], np.cumsum(sizes.to_numpy())[:-1]]).astype(np.int64)
        first_of = dict(zip(sizes.index.astype(int), firsts))
        glob = nd["tree"].map(first_of).to_numpy(dtype=np.int64)
        feat = nd["feature"].to_numpy(dtype=np.int64)
        own = np.arange(len(nd), dtype=np.int64)
        leaf = feat < 0
        # leaves loop to themselves (threshold +inf), so every row takes the
        # same number of steps and no per-step leaf mask is needed
        left = np.where(leaf, own, nd["left"].to_numpy(dtype=np.int64) + glob)
        right = np.where(leaf, own, nd["right"].to_numpy(dtype=np.int64) + glob)
        thr = np.where(leaf, np.inf, nd["threshold"].to_numpy(dtype=np.float64))
        leaf_val = nd["depth"].to_numpy(dtype=np.float64) + average_path_length(nd["size"].to_numpy())
        return {
            "roots": firsts, "feature": np.where(leaf, 0, feat), "threshold": thr,
            "left": left, "right": right, "leaf": leaf_val,
            "steps": int(nd["depth"].max()) if len(nd) else 0,
            "norm": float(average_path_length(np.array([self.psi]))[0]),
        }


def fit_isolation_forest(x: DataFrame, features, cfg: ForestConfig | None = None,
                         id_col: str = "SalesOrderID", n: int | None = None) -> IsolationForestModel:
    """M5: fit on ``x`` (one row per id, feature columns already prepared).

    The node table (at most trees x (2 psi - 1) rows) comes to the driver to be
    broadcast for scoring.
    """
    cfg = cfg or ForestConfig()
    n = x.count() if n is None else n
    nodes = grow_forest(x, features, cfg, id_col, n).toPandas()
    return IsolationForestModel(features=list(features), psi=min(cfg.max_samples, n), n_trees=cfg.n_trees,
                                offset=cfg.offset, nodes=nodes)


def grow_forest(x: DataFrame, features, cfg: ForestConfig | None = None,
                id_col: str = "SalesOrderID", n: int | None = None) -> DataFrame:
    """The node table of the fitted forest, one group of sampled rows per tree."""
    cfg = cfg or ForestConfig()
    features = list(features)
    n = x.count() if n is None else n
    if n == 0:
        raise ValueError("no rows to fit")
    psi = min(cfg.max_samples, n)
    trees = cfg.n_trees
    target = cfg.oversample * trees * psi
    q = min(1.0, target / n)
    pre = x.where(_hash01(F.col(id_col), F.lit(cfg.seed)) < q) if q < 1 else x
    m = max(1, round(q * n))
    k = max(1, math.ceil(target / m))
    if k >= trees:
        tree_ids = F.sequence(F.lit(0), F.lit(trees - 1))
    else:
        tree_ids = F.array_distinct(F.array(*[
            F.pmod(F.xxhash64(F.col(id_col), F.lit(cfg.seed), F.lit(j), F.lit("tree")), F.lit(trees))
            .cast("int") for j in range(k)]))
    cand = (pre.select(F.col(id_col).alias("__id"), *features, F.explode(tree_ids).alias("tree"))
               .withColumn("__h", F.xxhash64(F.col("__id"), F.col("tree"), F.lit(cfg.seed), F.lit("rank"))))
    seed = cfg.seed
    feats = list(features)
    return cand.groupBy("tree").applyInPandas(lambda pdf: _build_tree(pdf, feats, psi, seed), NODE_SCHEMA)


# ---------------------------------------------------------------- M6 score

#: Rows that walk a tree together: their few arrays stay in a core's own cache.
SCORE_ROWS = 5000


def _mean_paths(x: np.ndarray, arr: dict) -> np.ndarray:
    """Mean path length of every row, tree after tree; only arrays of one value per row are made."""
    n = x.shape[0]
    flat = np.ascontiguousarray(x.T).ravel()  # feature after feature
    cols = np.arange(n)
    start, thr, leaf = arr["feature"] * n, arr["threshold"], arr["leaf"]
    child = np.stack([arr["left"], arr["right"]], axis=1).ravel()
    total = np.zeros(n)
    for root in arr["roots"]:
        at = np.full(n, root)
        for _ in range(arr["steps"]):
            go_left = flat.take(start.take(at) + cols) <= thr.take(at)
            at += at
            at += ~go_left
            at = child.take(at)
        total += leaf.take(at)
    return total / len(arr["roots"])


def _score_batch(x: np.ndarray, arr: dict) -> np.ndarray:
    """Mean path length over all trees for a batch of rows -> 2^(-E[h]/c(psi))."""
    h = np.concatenate([_mean_paths(x[i : i + SCORE_ROWS], arr) for i in range(0, x.shape[0], SCORE_ROWS)])
    return np.power(2.0, -h / arr["norm"])


def score(x: DataFrame, model: IsolationForestModel, out: str = "anomaly_score",
          id_col: str = "SalesOrderID") -> DataFrame:
    """M6: anomaly score (s - 0.5 with the automatic offset) per row of ``x``."""
    spark = x.sparkSession
    bc = spark.sparkContext.broadcast(model.arrays())
    feats = list(model.features)
    offset = model.offset

    def fn(batches):
        arr = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                yield pd.DataFrame({id_col: pd.Series([], dtype="int64"), out: pd.Series([], dtype="float64")})
                continue
            s = _score_batch(pdf[feats].to_numpy(dtype=np.float64), arr)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), out: s + offset})

    schema = T.StructType([T.StructField(id_col, x.schema[id_col].dataType),
                           T.StructField(out, T.DoubleType())])
    return x.select(id_col, *feats).mapInPandas(fn, schema)


# ---------------------------------------------------------------- stored models

@dataclass
class StoredForest:
    """A fitted forest with all it needs to score other rows: features, log columns, scaler, offset."""

    model: IsolationForestModel
    log_cols: list[str]
    scaler: dict[str, tuple[float, float]]
    version: int = 0

    def inputs(self, ds: DataFrame, id_col: str = "SalesOrderID") -> DataFrame:
        """The eligible rows' features under the stored scaler."""
        names = [c.removeprefix("f_") for c in self.model.features]
        return standardise(transform(eligible(ds), names, self.log_cols, id_col), self.model.features, self.scaler)[0]

    def score(self, ds: DataFrame, out: str = "anomaly_score", id_col: str = "SalesOrderID") -> DataFrame:
        """(id, ``out``) of the eligible rows: map-only, nothing is fitted."""
        return score(self.inputs(ds, id_col), self.model, out, id_col)


META_SCHEMA = ("features array<string>, log_cols array<string>, means array<double>, deviations array<double>, "
               "psi int, n_trees int, offset double, version int")


def save_forest(spark: SparkSession, forest: StoredForest, path: str) -> int:
    """Writes the next version below ``path`` and returns its number.

    The node table goes first, the row that describes it last, so a version
    exists once it is whole; a broken save leaves no version.
    """
    version = max([m.version for m in _versions(spark, path)], default=0) + 1
    m = forest.model
    nodes = spark.createDataFrame(m.nodes.astype({c.name: "float64" if c.name == "threshold" else "int32" for c in NODE_SCHEMA}), NODE_SCHEMA)
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes-{version}")
    row = (list(m.features), list(forest.log_cols), [float(forest.scaler[c][0]) for c in m.features], [float(forest.scaler[c][1]) for c in m.features],
           int(m.psi), int(m.n_trees), float(m.offset), version)
    spark.createDataFrame([row], META_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def _versions(spark: SparkSession, path: str) -> list:
    from ..functions.caching import is_written
    if not is_written(spark, f"{path}/versions"):
        return []
    return spark.read.schema(META_SCHEMA).parquet(f"{path}/versions").collect()  # one row per saved model


def load_forest(spark: SparkSession, path: str, version: int | None = None) -> StoredForest | None:
    """A saved model (the latest, or one version), or None."""
    found = [m for m in _versions(spark, path) if version in (None, m.version)]
    if not found:
        return None
    meta = max(found, key=lambda m: m.version)
    # at most trees x (2 psi - 1) rows, the bound of the fit
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes-{meta.version}").toPandas()
    model = IsolationForestModel(features=list(meta.features), psi=meta.psi, n_trees=meta.n_trees, offset=meta.offset, nodes=nodes)
    return StoredForest(model, list(meta.log_cols), {c: (m, d) for c, m, d in zip(meta.features, meta.means, meta.deviations)}, meta.version)


def fit_forest(ds: DataFrame, features, log_cols, cfg: ForestConfig | None = None) -> StoredForest:
    """M3-M5 (or M13-M14): transform, standardise and fit on the eligible rows of ``ds``."""
    from ..functions.caching import materialise
    # the model input (id + a few doubles) is read for the scaler, the row count and the sample: one copy
    x = materialise(transform(eligible(ds), features, log_cols), "model-input")
    columns = [f"f_{c}" for c in features]
    z, stats = standardise(x, columns)
    model = fit_isolation_forest(z, columns, cfg, n=row_count(stats))
    return StoredForest(model, list(log_cols), {c: stats[c] for c in columns})


# ---------------------------------------------------------------- API in the survey's terms

def transform_initial(x: DataFrame) -> DataFrame:
    """M3: initial model inputs (log of value, gap, prior average and ratio)."""
    return transform(x, INITIAL_FEATURES, INITIAL_LOG)


def transform_behaviour(x: DataFrame) -> DataFrame:
    """Behaviour model inputs (log of gap and prior count, raw ratio, channel)."""
    return transform(x, BEHAVIOUR_FEATURES, BEHAVIOUR_LOG)


class IsolationForest:
    """``IsolationForest(cfg).fit(x).score(x)`` over prepared feature columns."""

    def __init__(self, cfg: ForestConfig | None = None, id_col: str = "SalesOrderID"):
        self.cfg = cfg or ForestConfig()
        self.id_col = id_col
        self.model: IsolationForestModel | None = None

    def fit(self, x: DataFrame, features=None) -> "IsolationForest":
        features = list(features or [c for c in x.columns if c != self.id_col])
        self.model = fit_isolation_forest(x, features, self.cfg, self.id_col)
        return self

    def score(self, x: DataFrame, out: str = "anomaly_score") -> DataFrame:
        if self.model is None:
            raise ValueError("fit first")
        return score(x, self.model, out=out, id_col=self.id_col)
