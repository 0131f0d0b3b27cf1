"""Quantiles by sketch and count against numpy, with every way a rank can be reached."""

import random

import numpy as np
import pytest

from riskloom.functions import quantiles

PROBS = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 0.999, 1.0)


def columns(n=30_000):
    rng = np.random.default_rng(5)
    heavy = np.where(rng.random(n) < 0.6, 7.0, rng.normal(0, 100, n))
    return {"smooth": rng.normal(0, 1, n), "heavy": heavy, "few": rng.integers(0, 4, n).astype(float), "one": np.full(n, 3.0),
            "money": np.round(rng.lognormal(3, 2, n), 2), "signed": np.where(rng.random(n) < 0.5, 0.0, -0.0)}


def frame(spark, data, holes=True):
    rng = random.Random(1)
    names = list(data)
    rows = [tuple(None if holes and rng.random() < 0.1 else float("nan") if holes and rng.random() < 0.02 else float(v) for v in r) for r in zip(*data.values())]
    known = {c: np.array([r[k] for r in rows if r[k] is not None and not np.isnan(r[k])]) for k, c in enumerate(names)}
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)), known


@pytest.mark.parametrize("gather,size,error", [(1 << 20, 1024, None), (50, 64, None), (10, 8, 0.0), (0, 16, None)])
def test_quantiles_equal_numpy(spark, monkeypatch, gather, size, error):
    """Small sketches and small brackets force refining; an error of 0 makes brackets miss."""
    monkeypatch.setattr(quantiles, "GATHER", gather)
    monkeypatch.setattr(quantiles, "SKETCH_SIZE", size)
    if error is not None:
        monkeypatch.setattr(quantiles, "RANK_ERROR", error)
    data = columns(30_000 if gather > 1000 else 4_000)
    df, known = frame(spark, data)
    found = quantiles.numeric_profile(df, {c: PROBS for c in data})
    for c, values in known.items():
        for p in PROBS:
            assert found[c]["quantiles"][p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12), (c, p)
        assert found[c]["count"] == len(values) and found[c]["min"] == values.min() and found[c]["max"] == values.max()
        assert found[c]["mean"] == pytest.approx(values.mean()) and found[c]["std"] == pytest.approx(values.std(ddof=1))


def test_empty_and_single_values(spark):
    df = spark.createDataFrame([(None, 4.0), (None, None)], "a double, b double")
    found = quantiles.numeric_profile(df, {"a": [0.5], "b": [0.25, 0.5]})
    assert found["a"]["quantiles"] == {0.5: None} and found["a"]["count"] == 0
    assert found["b"]["quantiles"] == {0.25: 4.0, 0.5: 4.0}
    assert quantiles.numeric_profile(df, {}) == {}


def test_columns_share_passes_and_values_are_not_exchanged(spark, monkeypatch):
    data = columns()
    df, _ = frame(spark, data, holes=False)
    passes = []
    count, gather = quantiles.count_pass, quantiles.gather_pass
    monkeypatch.setattr(quantiles, "count_pass", lambda *a: (passes.append("count"), count(*a)))
    monkeypatch.setattr(quantiles, "gather_pass", lambda *a: (passes.append("gather"), gather(*a)))
    quantiles.numeric_profile(df, {c: PROBS for c in data})
    assert passes == ["count", "gather"]


def test_passes_build_no_aggregate_per_bracket(spark, monkeypatch):
    """Dozens of brackets cost a row of counts each, not five aggregates and a sketch of every row, in the count and in the pick."""
    data = columns()
    df, known = frame(spark, data)
    hunts = quantiles._hunts(quantiles.first_pass(df, {c: PROBS for c in data}), {c: PROBS for c in data})
    counts = quantiles.bracket_counts(df, hunts)
    for i, h in enumerate(hunts):
        v = known[h.column]
        assert (counts[i]["below"], counts[i]["at_low"]) == ((v < h.low).sum(), (v == h.low).sum())
        assert counts[i]["inside"] == ((v > h.low) & (v < h.high)).sum() and counts[i]["at_high"] == ((v == h.high).sum() if h.high > h.low else 0)
    sketches, sketch = [], quantiles._sketch
    monkeypatch.setattr(quantiles, "_sketch", lambda v: sketches.append(v) or sketch(v))
    quantiles.numeric_profile(df, {c: PROBS for c in data})
    assert len(sketches) == len(data)  # one per column in the first pass, none per bracket
