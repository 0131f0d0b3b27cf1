"""Exact quantiles of many columns by sketch and count, without sorting them.

A quantile needs the values at one or two ranks. One aggregate builds a KLL
sketch per column (a few KB whatever the rows) and takes from it a bracket
[low, high] for each rank. A second pass counts, for all brackets at once, the
values below, on and inside them, which says exactly where the rank lies (a
batch of a column is sorted once, then every bracket costs a binary search):

* on an end of the bracket: that end is the answer, however often it occurs;
* inside: if at most ``GATHER`` values are, they are grouped, ordered within
  their bracket and picked from; else a sketch of the inside alone gives the
  next, far narrower bracket;
* outside (the sketch missed): the certified bounds of the rank still enclose
  it and shrink with every pass.

So the result never depends on the sketch; only the number of passes does. Two
passes and a bounded pick are usual; a sketch narrows a bracket about a
hundredfold. All columns and probabilities share each pass. Nothing is
exchanged but a few numbers per task and bracket, and at most ``GATHER`` values
per bracket in the pick.

NULL and NaN are ignored. Values are compared as doubles. A column without
values has NULL quantiles.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH_SIZE = 1024
#: Rank error of a sketch that is exceeded once in a hundred times, doubled. It decides the passes, never the result.
RANK_ERROR = 2 * 2.296 / SKETCH_SIZE ** 0.9723
GATHER = 1 << 20
MOMENTS = ("count", "mean", "std", "min", "max")


@dataclass
class Hunt:
    """The search for the values at the ranks around one quantile of one column."""

    column: str
    prob: float
    ranks: tuple[int, int]
    fraction: float
    low: float
    high: float
    least: float          # certified: least <= value <= greatest
    greatest: float
    found: dict[int, float] = field(default_factory=dict)
    gather_from: int | None = None  # rows up to the bracket's lower end, once the inside is small enough

    def open(self) -> list[int]:
        return [r for r in dict.fromkeys(self.ranks) if r not in self.found]

    def value(self) -> float:
        a, b = self.found[self.ranks[0]], self.found[self.ranks[1]]
        return a + self.fraction * (b - a)


def _value(column: str) -> Column:
    v = F.col(f"`{column}`").cast("double") + F.lit(0.0)
    return F.when(~F.isnan(v), v)


def _sketch(values: Column) -> Column:
    return F.kll_sketch_agg_double(values, F.lit(SKETCH_SIZE))


def _at(sketch: Column, rank: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(min(max(rank, 0.0), 1.0)))


def first_pass(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, dict]:
    """Per column its moments and the first brackets: one aggregate, one row."""
    aggregates = []
    for i, column in enumerate(wanted):
        v = _value(column)
        aggregates += [F.count(v).alias(f"count{i}"), F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"min{i}"),
                       F.max(v).alias(f"max{i}"), _sketch(v).alias(f"sketch{i}")]
    picked = []
    for i, (column, probs) in enumerate(wanted.items()):
        n, sketch = F.col(f"count{i}"), F.col(f"sketch{i}")
        for j, p in enumerate(probs):
            for end, rank in (("low", p - RANK_ERROR), ("high", p + RANK_ERROR)):
                picked.append(F.when(n > 0, _at(sketch, rank)).alias(f"{end}{i}_{j}"))
    row = df.agg(*aggregates).select(*[f"{m}{i}" for i in range(len(wanted)) for m in MOMENTS], *picked).first()
    return {column: {m: row[f"{m}{i}"] for m in MOMENTS} | {"brackets": [(row[f"low{i}_{j}"], row[f"high{i}_{j}"]) for j in range(len(probs))]}
            for i, (column, probs) in enumerate(wanted.items())}


def _hunts(found: dict[str, dict], wanted: Mapping[str, Sequence[float]]) -> list[Hunt]:
    out = []
    for column, probs in wanted.items():
        n = found[column]["count"]
        for p, (low, high) in zip(probs, found[column]["brackets"]):
            if n:
                at = (n - 1) * float(p)
                out.append(Hunt(column, float(p), (math.floor(at), math.ceil(at)), at - math.floor(at), low, high, found[column]["min"], found[column]["max"]))
    return out


def _inside(h: Hunt) -> Column:
    v = _value(h.column)
    return F.when((v > h.low) & (v < h.high), v)


def _columns(df: DataFrame, hunts: list[Hunt]) -> tuple[DataFrame, list[int]]:
    """The hunted columns as doubles, and each hunt's place among them."""
    names = list(dict.fromkeys(h.column for h in hunts))
    return df.select(*[_value(c).alias(f"v{k}") for k, c in enumerate(names)]), [names.index(h.column) for h in hunts]


def _sorted_values(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.sort(c.drop_null().to_numpy(zero_copy_only=False)) for c in batch.columns]


def _bounds(values: np.ndarray, low: float, high: float) -> tuple[int, int, int, int]:
    """Of sorted values: how many are < low, <= low, < high and <= high."""
    return (*(int(np.searchsorted(values, low, side)) for side in ("left", "right")), *(int(np.searchsorted(values, high, side)) for side in ("left", "right")))


def bracket_counts(df: DataFrame, hunts: list[Hunt]) -> dict[int, dict]:
    """Per hunt the values below, on the ends of and inside its bracket; a task sends one row per hunt."""
    values, at = _columns(df, hunts)
    brackets = [(k, h.low, h.high) for k, h in zip(at, hunts)]

    def count(batches):
        found = np.zeros((len(brackets), 4), np.int64)
        for batch in batches:
            columns = _sorted_values(batch)
            for i, (k, low, high) in enumerate(brackets):
                below, upto, before, end = _bounds(columns[k], low, high)
                found[i] += (below, upto - below, max(before - upto, 0), end - before if high > low else 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(brackets)), pa.int32()), *(pa.array(found[:, n]) for n in range(4))], names=names)

    names = ["hunt", "below", "at_low", "inside", "at_high"]
    counted = values.mapInArrow(count, "hunt int, below long, at_low long, inside long, at_high long")
    return {r["hunt"]: r.asDict() for r in counted.groupBy("hunt").agg(*[F.sum(n).alias(n) for n in names[1:]]).collect()}


def count_pass(df: DataFrame, hunts: list[Hunt]) -> None:
    """Counts every open bracket in one pass and moves each hunt on."""
    counts = bracket_counts(df, hunts)
    wide = []
    for i, h in enumerate(hunts):
        row = counts[i]
        below = row["below"]
        start = below + row["at_low"]
        end = start + row["inside"]
        for r in h.open():
            if below <= r < start:
                h.found[r] = h.low
            elif end <= r < end + row["at_high"]:
                h.found[r] = h.high
        left = h.open()
        if not left:
            continue
        if all(r < below for r in left):
            h.low, h.high, h.greatest = h.least, h.low, h.low
        elif all(r >= end for r in left):
            h.low, h.high, h.least = h.high, h.greatest, h.high
        elif all(start <= r < end for r in left):
            if row["inside"] <= GATHER:
                h.gather_from = start
            else:
                h.least, h.greatest = h.low, h.high
                n = row["inside"]
                wide.append((h, (min(left) - start) / n - RANK_ERROR, (max(left) + 1 - start) / n + RANK_ERROR))
        else:  # the two ranks lie on different sides: go on with all of the certified range
            h.low, h.high = h.least, h.greatest
    if wide:  # only brackets that hold too much are sketched again
        sketched = df.agg(*[_sketch(_inside(h)).alias(f"sketch{k}") for k, (h, *_) in enumerate(wide)])
        ends = sketched.select(*[_at(F.col(f"sketch{k}"), p).alias(f"{end}{k}") for k, (_, *ps) in enumerate(wide) for end, p in zip(("low", "high"), ps)]).first()
        for k, (h, *_) in enumerate(wide):
            h.low, h.high = ends[f"low{k}"], ends[f"high{k}"]


def gather_pass(df: DataFrame, hunts: list[Hunt]) -> None:
    """Picks the open ranks of small brackets: at most ``GATHER`` values each, ordered bracket by bracket."""
    values, at = _columns(df, hunts)
    brackets = [(k, h.low, h.high) for k, h in zip(at, hunts)]

    def inside(batches):
        for batch in batches:
            columns = _sorted_values(batch)
            for i, (k, low, high) in enumerate(brackets):
                _, start, end, _ = _bounds(columns[k], low, high)
                if start < end:
                    value, ties = np.unique(columns[k][start:end], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i), pa.int32()), pa.array(value), pa.array(ties, pa.int64())], names=["hunt", "value", "ties"])

    counted = values.mapInArrow(inside, "hunt int, value double, ties long").groupBy("hunt", "value").agg(F.sum("ties").alias("ties"))
    upto = F.sum("ties").over(Window.partitionBy("hunt").orderBy("value"))
    ranked = counted.withColumn("upto", upto)
    hit = F.lit(False)
    for i, h in enumerate(hunts):
        for r in h.open():
            place = r - h.gather_from
            hit = hit | ((F.col("hunt") == i) & (F.col("upto") - F.col("ties") <= place) & (F.lit(place) < F.col("upto")))
    for row in ranked.where(hit).collect():  # two rows at most for each hunt
        h = hunts[row["hunt"]]
        for r in h.open():
            if row["upto"] - row["ties"] <= r - h.gather_from < row["upto"]:
                h.found[r] = row["value"]


def numeric_profile(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, dict]:
    """Per column of ``wanted`` its moments and ``quantiles`` {probability: value}, from shared passes over ``df``.

    ``df`` is read once per pass: pass a stored table, not a long computation.
    """
    wanted = {c: [float(p) for p in dict.fromkeys(probs)] for c, probs in wanted.items()}
    if not wanted:
        return {}
    narrow = df.select(*[f"`{c}`" for c in wanted])
    found = first_pass(narrow, wanted)
    hunts = _hunts(found, wanted)
    while True:
        going = [h for h in hunts if h.open() and h.gather_from is None]
        if not going:
            break
        count_pass(narrow, going)
    last = [h for h in hunts if h.open()]
    if last:
        gather_pass(narrow, last)
    values = {(h.column, h.prob): h.value() for h in hunts}
    return {c: {m: found[c][m] for m in MOMENTS} | {"quantiles": {p: values.get((c, p)) for p in probs}} for c, probs in wanted.items()}


def profile_table(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> DataFrame:
    """(column_name, statistic, percentile, value): the moments, and a row per quantile under ``"quantile"``."""
    rows = []
    for column, found in numeric_profile(df, wanted).items():
        rows += [(column, m, None, None if found[m] is None else float(found[m])) for m in MOMENTS]
        rows += [(column, "quantile", p, v) for p, v in found["quantiles"].items()]
    return df.sparkSession.createDataFrame(rows, "column_name string, statistic string, percentile double, value double")


def quantiles_by_group(df: DataFrame, group: Column, labels: Sequence[str], wanted: Mapping[str, Sequence[float]]) -> DataFrame:
    """(group, column_name, percentile, value) for a fixed list of groups, each a column of the shared passes."""
    split = df.select(*[F.when(group == F.lit(label), F.col(f"`{c}`").cast("double")).alias(f"{k} {c}") for k, label in enumerate(labels) for c in wanted])
    found = numeric_profile(split, {f"{k} {c}": probs for k in range(len(labels)) for c, probs in wanted.items()})
    rows = [(labels[int(k)], c, p, v) for (k, c), one in ((name.split(" ", 1), one) for name, one in found.items()) for p, v in one["quantiles"].items()]
    return df.sparkSession.createDataFrame(rows, "group string, column_name string, percentile double, value double")
