"""Average-tie percentile rank by one sorted pass in each direction.

A row's average rank needs the rows below its value and its ties. Both follow
from counting in two directions over rows in order of their values:

1. One range exchange on (groups, value, hash of the row). The hash splits a
   value that a third of all rows share over many partitions.
2. Within a partition the ascending pass gives each row the rows of its group
   below its value; the rows are turned round by their running number (a local
   sort, no exchange) and the descending pass gives those above it.
3. Only a partition's first and last group, and its first and last value, go on
   in other partitions. What they have there comes from one summary row per
   partition, carried forwards and backwards on the driver - a list as long as
   the number of partitions - and broadcast.

Ties are what is neither below nor above. Nothing is grouped by value and
nothing is joined back to the rows; the rows are written once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .caching import materialise
from .scan import _fill_for, _np_values

_V, _NONE = "__rk_value", "__rk_none"
_PID, _ROW, _POS, _LESS, _MORE, _N = "__rk_pid", "__rk_row", "__rk_pos", "__rk_less", "__rk_more", "__rk_n"


class _Borders:
    """Where a batch's rows differ from the row before in some columns, across batches."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.last = names, None

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        ends = []
        for k, name in enumerate(self.names):
            column = batch.column(batch.schema.get_field_index(name))
            values, valid = _np_values(column, _fill_for(column.type))
            new[1:] |= (valid[1:] != valid[:-1]) | (valid[1:] & valid[:-1] & (values[1:] != values[:-1]))
            if self.last is None or self.last[k][1] != valid[0] or (valid[0] and self.last[k][0] != values[0]):
                new[0] = True
            ends.append((values[-1], valid[-1]))
        if not self.names and self.last is None:
            new[0] = True
        self.last = ends
        return new


def _filled(at_start: np.ndarray, starts: np.ndarray, n: int, carried: int) -> np.ndarray:
    """The value that holds from each start on; ``carried`` before the first one."""
    where = np.searchsorted(starts, np.arange(n), side="right")
    return np.concatenate([[carried], at_start])[where]


def _appended(batch: pa.RecordBatch, **columns: np.ndarray) -> pa.RecordBatch:
    arrays, names = [batch.column(i) for i in range(batch.num_columns)], list(batch.schema.names)
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array(c) for c in columns.values())], [*names, *columns])


def _ascending(keys: list[str]):
    def scan(batches):
        part, row = TaskContext.get().partitionId(), 0
        key_borders, run_borders = _Borders(keys), _Borders([*keys, _V])
        pos, less = 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, run = key_borders.of(batch), run_borders.of(batch)
            at = np.arange(n)
            starts = np.flatnonzero(key)
            first = _filled(starts, starts, n, -pos)  # a group that goes on began before the batch
            place = at - first + 1
            runs = np.flatnonzero(run)
            below = _filled(place[runs] - 1, runs, n, less)
            yield _appended(batch, **{_PID: np.full(n, part, np.int32), _ROW: row + at, _POS: place, _LESS: below})
            row, pos, less = row + n, int(place[-1]), int(below[-1])
    return scan


def _descending(keys: list[str]):
    def scan(batches):
        key_borders, run_borders = _Borders(keys), _Borders([*keys, _V])
        size, more = 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            place = batch.column(batch.schema.get_field_index(_POS)).to_numpy()
            starts, runs = np.flatnonzero(key_borders.of(batch)), np.flatnonzero(run_borders.of(batch))
            sizes = _filled(place[starts], starts, n, size)  # the first row met of a group is its last
            above = _filled(sizes[runs] - place[runs], runs, n, more)
            yield _appended(batch, **{_MORE: above, _N: sizes})
            size, more = int(sizes[-1]), int(above[-1])
    return scan


def _carried(edges: list, ahead: str, behind: str) -> dict[int, tuple[int, int]]:
    """Per partition, rows of the group at its ``ahead`` edge in the partitions before, and those of them with the edge's value."""
    out, key, value, rows, ties = {}, None, None, 0, 0
    for part in edges:
        near, far = part[ahead], part[behind]
        same = key is not None and key == tuple(near.key)
        out[part["pid"]] = (rows, ties if value == near.value else 0) if same else (0, 0)
        one_group = tuple(near.key) == tuple(far.key)
        one_value = one_group and near.value == far.value
        ties = far.ties + (ties if same and one_value and value == near.value else 0)
        rows = far.n + (rows if same and one_group else 0)
        key, value = tuple(far.key), far.value
    return out


def average_rank_pct(df: DataFrame, value: str, out: str, groups: list[str] | None = None) -> DataFrame:
    """Adds ``out`` = average-tie rank / count of non-null values, per group (NULL and NaN stay unranked).

    NULL group keys form one group. ``df`` is written once and read twice, the
    first time for a sample of its keys that sets the ranges: pass a stored
    table rather than a long computation.
    """
    groups = list(groups or [])
    names = df.columns
    v = F.col(f"`{value}`")
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        rows = df.withColumn(_NONE, v.isNull() | F.isnan(v)).withColumn(_V, F.when(~F.col(_NONE), v + F.lit(0.0).cast(df.schema[value].dataType)))
    else:
        rows = df.withColumn(_NONE, v.isNull()).withColumn(_V, v)
    # the hash is worked out on both sides of the exchange: as a column it would be the widest of it
    tie = F.xxhash64(*[f"`{c}`" for c in names])
    order = [*(F.col(f"`{c}`").asc_nulls_first() for c in (*groups, _NONE, _V)), tie.asc_nulls_first()]
    keys = [*groups, _NONE]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    up = T.StructType([*rows.schema.fields, T.StructField(_PID, T.IntegerType()), *(T.StructField(c, T.LongType()) for c in (_ROW, _POS, _LESS))])
    both = T.StructType([*up.fields, T.StructField(_MORE, T.LongType()), T.StructField(_N, T.LongType())])
    counted = ranged.mapInArrow(_ascending(keys), up).sortWithinPartitions(F.col(_ROW).desc()).mapInArrow(_descending(keys), both)
    counted = materialise(counted, "ranked")

    edge = F.struct(F.struct(*[f"`{c}`" for c in keys]).alias("key"), F.col(_V).alias("value"), F.col(_N).alias("n"),
                    (F.col(_N) - F.col(_LESS) - F.col(_MORE)).alias("ties"))
    edges = sorted(counted.groupBy(F.col(_PID).alias("pid")).agg(
        F.min_by(edge, _ROW).alias("first"), F.max_by(edge, _ROW).alias("last"), (F.max(_ROW) + 1).alias("rows")).collect(), key=lambda r: r.pid)
    before, after = _carried(edges, "first", "last"), _carried(edges[::-1], "last", "first")
    carry = df.sparkSession.createDataFrame(
        [(r.pid, r.rows, *before[r.pid], *after[r.pid]) for r in edges],
        "__rk_p int, __rk_rows long, __rk_b long, __rk_bt long, __rk_a long, __rk_at long")
    joined = counted.join(F.broadcast(carry), F.col(_PID) == F.col("__rk_p"))  # one row per partition
    first_group = F.col(_POS) == F.col(_ROW) + 1
    last_group = F.col(_ROW) - F.col(_POS) + 1 + F.col(_N) == F.col("__rk_rows")
    less = F.col(_LESS) + F.when(first_group, F.col("__rk_b") - F.when(F.col(_LESS) == 0, F.col("__rk_bt")).otherwise(0)).otherwise(0)
    more = F.col(_MORE) + F.when(last_group, F.col("__rk_a") - F.when(F.col(_MORE) == 0, F.col("__rk_at")).otherwise(0)).otherwise(0)
    total = F.col(_N) + F.when(first_group, F.col("__rk_b")).otherwise(0) + F.when(last_group, F.col("__rk_a")).otherwise(0)
    rank = less + (total - less - more + 1) / F.lit(2.0)
    return joined.select(*[f"`{c}`" for c in names], F.when(~F.col(_NONE), rank / total).alias(out))
