import numpy as np
import pytest
import pandas as pd
from pyspark.sql import functions as F

from riskloom.functions.ranking import average_rank_pct, equal_width_histogram, exact_percentiles
from riskloom.functions.scan import ScanSpec, prefix_scan


@pytest.mark.parametrize("n,parts", [(20000, 16), (150, 64), (3000, 7)])
def test_prefix_scan_hot_key_matches_pandas(spark, n, parts):
    # one customer holds most rows; the range exchange spreads it over many
    # partitions (some partitions hold only that customer, some may be empty)
    rng = np.random.default_rng(7 + n)
    cust = np.where(rng.random(n) < 0.7, 1, rng.integers(2, 50, n)).astype("float")
    cust[rng.random(n) < 0.03] = np.nan          # NULL keys form one group
    pdf = pd.DataFrame({"k": cust, "t": rng.integers(0, 500, n), "id": np.arange(n),
                        "v": rng.integers(-100, 1000, n).astype("float")})
    pdf.loc[rng.random(n) < 0.05, "v"] = np.nan
    df = (spark.createDataFrame(pdf)
          .withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v").cast("long")))
          .withColumn("k", F.when(F.isnan("k"), None).otherwise(F.col("k").cast("long"))))
    spec = ScanSpec(count_as="cnt", sums={"s": "v"}, nonnull={"nn": "v"}, maxes={"mx": "v"},
                    lags={"lt": "t", "lv": "v"})
    got = prefix_scan(df, ["k"], ["t", "id"], spec, num_partitions=parts).toPandas().sort_values("id")
    exp = pdf.assign(k=pdf.k.fillna(-1)).sort_values(["k", "t", "id"]).copy()
    g = exp.groupby("k")
    exp["cnt"] = g.cumcount()
    exp["s"] = g["v"].transform(lambda s: s.fillna(0).cumsum().shift(1, fill_value=0))
    exp["nn"] = g["v"].transform(lambda s: s.notna().astype(int).cumsum().shift(1, fill_value=0))
    exp["mx"] = g["v"].transform(lambda s: s.cummax().ffill().shift(1))
    exp["lt"] = g["t"].shift(1)
    exp["lv"] = g["v"].shift(1)
    exp = exp.sort_values("id")
    for c in ("cnt", "s", "nn"):
        assert (got[c].to_numpy() == exp[c].to_numpy()).all(), c
    for c in ("mx", "lt", "lv"):
        a, b = got[c].to_numpy(dtype=float), exp[c].to_numpy(dtype=float)
        assert np.array_equal(np.isnan(a), np.isnan(b)), c
        assert np.allclose(a[~np.isnan(a)], b[~np.isnan(b)]), c


def test_average_rank_matches_pandas_with_heavy_ties(spark):
    rng = np.random.default_rng(3)
    vals = np.where(rng.random(5000) < 0.4, 1.0, rng.integers(0, 300, 5000).astype(float))
    vals[:50] = np.nan
    pdf = pd.DataFrame({"id": np.arange(len(vals)), "x": vals})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))
    got = average_rank_pct(df, "x", "pct").toPandas().sort_values("id")
    exp = pdf["x"].rank(pct=True)
    a, b = got["pct"].to_numpy(dtype=float), exp.to_numpy(dtype=float)
    assert np.array_equal(np.isnan(a), np.isnan(b))
    assert np.allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=0, atol=1e-12)


@pytest.mark.parametrize("parts", [3, 40, 200])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_rank_of_ties_and_groups_over_many_partitions(spark, parts, groups):
    # a value and a group that hold most rows cross many partitions; 200 partitions leave some empty
    rng = np.random.default_rng(parts)
    n = 2500
    x = np.where(rng.random(n) < 0.5, 7.0, rng.integers(0, 12, n).astype(float))
    x[rng.random(n) < 0.05] = np.nan
    g = np.where(rng.random(n) < 0.6, "hot", np.where(rng.random(n) < 0.2, "", rng.choice(["a", "b"], n)))
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "g": g})
    df = spark.createDataFrame(pdf).withColumn("g", F.nullif("g", F.lit("")))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = average_rank_pct(df, "x", "pct", groups).toPandas().sort_values("id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    exp = (pdf.groupby("g")["x"] if groups else pdf["x"]).rank(pct=True)
    a, b = got["pct"].to_numpy(dtype=float), exp.to_numpy(dtype=float)
    assert len(got) == n and np.array_equal(np.isnan(a), np.isnan(b))
    assert np.allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=0, atol=1e-12)


def test_rank_of_an_empty_table_and_of_nulls(spark):
    assert average_rank_pct(spark.createDataFrame([], "id int, x double"), "x", "pct").count() == 0
    assert [r.pct for r in average_rank_pct(spark.createDataFrame([(1, None), (2, None)], "id int, x bigint"), "x", "pct").collect()] == [None, None]


def test_fixture_rank_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 4.0), (5, None)], "id int, x double")
    got = {r.id: r.pct for r in average_rank_pct(df, "x", "pct").collect()}
    assert got == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0, 5: None}


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    vals = rng.normal(100, 30, 3001).round(2)
    df = spark.createDataFrame(pd.DataFrame({"x": vals, "g": rng.integers(0, 3, 3001)}))
    probs = [0.01, 0.25, 0.5, 0.9, 0.99]
    got = {r.percentile: r.value for r in exact_percentiles(df, "x", probs).collect()}
    for p in probs:
        assert abs(got[p] - np.percentile(vals, p * 100)) < 1e-9
    pdf = df.toPandas()
    med = {r.g: r.median for r in exact_percentiles(df, "x", [0.5], groups=["g"], out="median").collect()}
    for g, sub in pdf.groupby("g"):
        assert abs(med[g] - sub.x.median()) < 1e-9


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,)], "v double")
    h = {r.bin: r["count"] for r in equal_width_histogram(df, "v", 50, lo=0.0, hi=10.0).collect()}
    assert h[1] == 1 and h[50] == 2 and sum(h.values()) == 3 and len(h) == 50


def test_rank_exchanges_no_column_that_follows_from_the_others(spark, monkeypatch):
    from riskloom.functions import two_way
    seen, keep = [], two_way.materialise
    monkeypatch.setattr(two_way, "materialise", lambda df, label: seen.append(df) or keep(df, label))
    df = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("v"))
    ranks = {r.id: r.p for r in two_way.average_rank_pct(df, "v", "p").collect()}
    assert ranks == pytest.approx((pd.Series(range(500)) % 7).rank(pct=True).to_dict())
    at = seen[0]._jdf.queryExecution().optimizedPlan()
    while at.nodeName() != "RepartitionByExpression":
        at = at.children().apply(0)
    assert {at.output().apply(i).name() for i in range(at.output().size())} == {"id", "v", "__rk_none", "__rk_value"}
