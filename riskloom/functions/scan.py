"""Skew-proof exclusive running aggregates ("strictly earlier rows").

``ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING`` and ``LAG`` over
``PARTITION BY key`` put every row of one key into one task. When one
customer (or one value) holds a third of all rows, that task holds a third of
the data. This module computes the same columns without that limit:

1. ``repartitionByRange(n, key..., order...)``: the order columns end in a
   unique id, so Spark's sampled range bounds split a hot key over many
   partitions and every partition is about the same size.
2. Inside each partition (sorted locally) a vectorised Arrow pass computes the
   running aggregates of the rows *in that partition*; its state is O(1). It
   also marks the partition's first and last row.
3. A key can only continue across a partition boundary through those two
   rows, so the carry from earlier partitions is computed from the marked
   rows alone: at most two rows per partition (a filter over the written
   scan, no aggregate over the data, no shuffle of per-key summaries). The
   carry table has at most one row per partition - a proven bound - and is
   broadcast.
4. A broadcast join adds the carry to the local values.

One full shuffle of the data (the range exchange); no task holds more than
one range partition; nothing passes through the driver. The scanned
partitions are written to the shared folder, so the marked rows and the final
join read the same copy and the same partition ids, whichever executors are
lost.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .caching import materialise

_PID = "__scan_pid"
_EDGE = "__scan_edge"      # 1 = first row of the partition, 2 = last row, 3 = both


@dataclass
class ScanSpec:
    """What to accumulate. Keys of each dict are output column names."""

    count_as: str | None = None                       # rows strictly before
    sums: dict = field(default_factory=dict)          # sum of non-null values before (0 if none)
    nonnull: dict = field(default_factory=dict)       # count of non-null values before
    maxes: dict = field(default_factory=dict)         # max of values before (NULL if none)
    lags: dict = field(default_factory=dict)          # value of the previous row (NULL for the first)


def _np_values(arr: pa.Array, fill):
    valid = np.asarray(arr.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    if arr.null_count:
        arr = arr.fill_null(fill)
    return arr.to_numpy(zero_copy_only=False), valid


def _fill_for(typ: pa.DataType):
    if pa.types.is_string(typ) or pa.types.is_large_string(typ):
        return ""
    if pa.types.is_timestamp(typ) or pa.types.is_date(typ):
        return pa.scalar(0, type=typ)
    if pa.types.is_boolean(typ):
        return False
    return 0


def _local_scan_fn(key_names, spec: ScanSpec, out_names):
    """Build the per-partition Arrow function (rows arrive sorted)."""
    sum_items = list(spec.sums.items())
    nn_items = list(spec.nonnull.items())
    max_items = list(spec.maxes.items())
    lag_items = list(spec.lags.items())

    def fn(batches):
        prev_key = None          # [(value, valid)] of the last row seen
        st_cnt = 0
        st_sum, st_nn, st_max, st_last = {}, {}, {}, {}
        pending = None           # one batch of look-ahead to mark the last row
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            new = np.zeros(n, dtype=bool)
            keys_now = []
            for k in key_names:
                arr = rb.column(rb.schema.get_field_index(k))
                vals, valid = _np_values(arr, _fill_for(arr.type))
                keys_now.append((vals, valid))
                if n > 1:
                    new[1:] |= (valid[1:] != valid[:-1]) | (valid[1:] & (vals[1:] != vals[:-1]))
            first_batch = prev_key is None
            if first_batch:
                cont0 = False
            else:
                cont0 = True
                for (vals, valid), (pv, pvalid) in zip(keys_now, prev_key):
                    if valid[0] != pvalid or (valid[0] and vals[0] != pv):
                        cont0 = False
                        break
            new[0] = True
            starts = np.flatnonzero(new)
            gid = np.cumsum(new) - 1
            carry_rows = (gid == 0) & cont0
            pos = np.arange(n, dtype=np.int64) - starts[gid]

            out_cols = {}
            cnt = pos + np.where(carry_rows, st_cnt, 0)
            out_cols[spec.count_as] = pa.array(cnt, type=pa.int64())
            new_sum, new_nn, new_max, new_last = {}, {}, {}, {}
            for name, src in sum_items:
                arr = rb.column(rb.schema.get_field_index(src))
                is_float = pa.types.is_floating(arr.type)
                vals, valid = _np_values(arr, 0)
                vals = np.where(valid, vals.astype(np.float64 if is_float else np.int64), 0)
                excl = np.cumsum(vals) - vals
                before = excl - excl[starts][gid] + np.where(carry_rows, st_sum.get(name, 0), 0)
                out_cols[name] = pa.array(before, type=pa.float64() if is_float else pa.int64())
                new_sum[name] = before[-1] + vals[-1]
            for name, src in nn_items:
                arr = rb.column(rb.schema.get_field_index(src))
                valid = np.asarray(arr.is_valid().to_numpy(zero_copy_only=False), dtype=np.int64)
                excl = np.cumsum(valid) - valid
                before = excl - excl[starts][gid] + np.where(carry_rows, st_nn.get(name, 0), 0)
                out_cols[name] = pa.array(before, type=pa.int64())
                new_nn[name] = int(before[-1] + valid[-1])
            for name, src in max_items:
                arr = rb.column(rb.schema.get_field_index(src))
                is_float = pa.types.is_floating(arr.type)
                vals, valid = _np_values(arr, 0)
                # integers stay integers: a double is exact only up to 2^53
                kind, low = (np.float64, -np.inf) if is_float else (np.int64, np.iinfo(np.int64).min)
                vals = np.where(valid, vals.astype(kind), low)
                cm = pd.Series(vals).groupby(gid).cummax().to_numpy()
                before = np.empty(n, dtype=kind)
                before[0] = low
                before[1:] = cm[:-1]
                before[starts] = low
                has, cval = st_max.get(name, (False, low))
                if cont0 and has:
                    before = np.where(carry_rows, np.maximum(before, cval), before)
                ok = before > low
                if is_float:
                    out_cols[name] = pa.array(np.where(ok, before, 0.0), type=pa.float64(), mask=~ok)
                else:
                    out_cols[name] = pa.array(np.where(ok, before, 0).astype(np.int64), type=arr.type, mask=~ok)
                lastv = max(before[-1], vals[-1])
                new_max[name] = (lastv > low, lastv)
            for name, src in lag_items:
                arr = rb.column(rb.schema.get_field_index(src))
                head = st_last.get(name)
                if head is None:
                    head = pa.nulls(1, type=arr.type)
                ext = pa.concat_arrays([head, arr])
                null_idx = new.copy()
                if cont0:
                    null_idx[0] = False
                out_cols[name] = ext.take(pa.array(np.arange(n, dtype=np.int64), mask=null_idx))
                new_last[name] = arr.slice(n - 1, 1)
            edge = np.zeros(n, dtype=np.int32)
            if first_batch:
                edge[0] = 1
            out_cols[_EDGE] = edge

            st_cnt = int(cnt[-1]) + 1
            st_sum.update(new_sum)
            st_nn.update(new_nn)
            st_max.update(new_max)
            st_last.update(new_last)
            prev_key = [(vals[-1], valid[-1]) for vals, valid in keys_now]

            arrays = [rb.column(i) for i in range(rb.num_columns)]
            names = list(rb.schema.names)
            for name in out_names:
                arrays.append(out_cols[name])
                names.append(name)
            if pending is not None:
                yield _finish(pending, last=False)
            pending = (arrays, names)
        if pending is not None:
            yield _finish(pending, last=True)

    return fn


def _finish(pending, last: bool) -> pa.RecordBatch:
    arrays, names = pending
    i = names.index(_EDGE)
    edge = np.asarray(arrays[i]).copy()
    if last:
        edge[-1] |= 2
    arrays = list(arrays)
    arrays[i] = pa.array(edge, type=pa.int32())
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _spark_type(df: DataFrame, c: str):
    return df.schema[c].dataType


def prefix_scan(df: DataFrame, keys: list[str], order: list[str], spec: ScanSpec,
                num_partitions: int | None = None) -> DataFrame:
    """Add exclusive running aggregates of ``spec`` per ``keys`` in ``order``.

    ``order`` should end in a unique column so that the order is total.
    NULL keys form one group (as SQL window partitions do); NULLs sort first.
    """
    sort_cols = [F.col(c).asc_nulls_first() for c in keys + order]
    # Without an explicit count the exchange starts from
    # spark.sql.shuffle.partitions and AQE may coalesce neighbouring ranges to
    # its advisory size: small inputs get few tasks, large ones keep many, and
    # partitions stay contiguous key ranges (all the carry logic needs).
    ranged = (df.repartitionByRange(num_partitions, *sort_cols) if num_partitions
              else df.repartitionByRange(*sort_cols)).withColumn(_PID, F.spark_partition_id())

    out_names: list[str] = []
    out_fields = list(ranged.schema.fields)
    tmp: dict[str, str] = {}

    def add(name, dtype):
        t = f"__scan_l_{name}"
        tmp[name] = t
        out_names.append(t)
        out_fields.append(T.StructField(t, dtype, True))

    local = ScanSpec()
    add("__cnt", T.LongType())
    local.count_as = cnt_local = tmp["__cnt"]
    for name, src in spec.sums.items():
        is_float = isinstance(_spark_type(df, src), (T.DoubleType, T.FloatType))
        add(name, T.DoubleType() if is_float else T.LongType())
        local.sums[tmp[name]] = src
    for name, src in spec.nonnull.items():
        add(name, T.LongType())
        local.nonnull[tmp[name]] = src
    for name, src in spec.maxes.items():
        st = _spark_type(df, src)
        add(name, T.DoubleType() if isinstance(st, (T.DoubleType, T.FloatType)) else st)
        local.maxes[tmp[name]] = src
    for name, src in spec.lags.items():
        add(name, _spark_type(df, src))
        local.lags[tmp[name]] = src
    out_names.append(_EDGE)
    out_fields.append(T.StructField(_EDGE, T.IntegerType(), True))

    scanned = (ranged.sortWithinPartitions(*sort_cols)
               .mapInArrow(_local_scan_fn(keys, local, out_names), T.StructType(out_fields)))
    # one written copy pins the partition ids; the edges are read back by a
    # pushed filter on a few columns, the rows once
    scanned = materialise(scanned, "scan")

    # ---- carry from the partition edges (<= 2 rows per partition)
    edges = scanned.where(F.col(_EDGE) > 0)
    firsts = edges.where((F.col(_EDGE) % 2) == 1).select(
        F.col(_PID).alias("__f_pid"), *[F.col(k).alias(f"__fk_{k}") for k in keys])
    # totals of the partition's last key within the partition = last row's
    # exclusive local values + the row itself
    tot = {"__t_cnt": F.col(cnt_local) + 1}
    for name, src in spec.sums.items():
        tot[f"__t_{name}"] = F.col(tmp[name]) + F.coalesce(F.col(src), F.lit(0)).cast(
            "double" if isinstance(_spark_type(df, src), (T.DoubleType, T.FloatType)) else "bigint")
    for name, src in spec.nonnull.items():
        tot[f"__t_{name}"] = F.col(tmp[name]) + F.col(src).isNotNull().cast("bigint")
    for name, src in spec.maxes.items():
        tot[f"__t_{name}"] = F.greatest(F.col(tmp[name]), F.col(src).cast(out_type(df, src)))
    for name, src in spec.lags.items():
        tot[f"__t_{name}"] = F.col(src)            # the last row's own value
    lasts = edges.where(F.col(_EDGE) >= 2).select(
        _PID, *[F.col(k).alias(f"__lk_{k}") for k in keys], *[c.alias(n) for n, c in tot.items()])
    parts = lasts.join(F.broadcast(firsts), F.col(_PID) == F.col("__f_pid"), "left")

    # one row per partition: a window over this tiny table (a single task is fine)
    w = Window.orderBy(_PID)
    same_key_as_prev = F.lit(True)
    whole = F.lit(True)
    for k in keys:
        same_key_as_prev = same_key_as_prev & F.col(f"__fk_{k}").eqNullSafe(F.lag(f"__lk_{k}").over(w))
        whole = whole & F.col(f"__fk_{k}").eqNullSafe(F.col(f"__lk_{k}"))
    cont = F.coalesce(whole & same_key_as_prev, F.lit(False))
    parts = parts.withColumn("__run", F.sum(F.when(cont, 0).otherwise(1)).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    wr = Window.partitionBy("__run").orderBy(_PID).rowsBetween(Window.unboundedPreceding, 0)
    mono = {n for n, s in spec.lags.items() if order and s == order[0]}
    cum = {"__k_cnt": F.sum("__t_cnt").over(wr)}
    for name in list(spec.sums) + list(spec.nonnull):
        cum[f"__k_{name}"] = F.sum(f"__t_{name}").over(wr)
    for name in list(spec.maxes) + [n for n in spec.lags if n in mono]:
        cum[f"__k_{name}"] = F.max(f"__t_{name}").over(wr)
    for name in spec.lags:
        if name not in mono:
            cum[f"__k_{name}"] = F.col(f"__t_{name}")
    # the carry of a partition's last key goes to the next non-empty partition
    carry = parts.select(F.lead(_PID).over(w).alias("__k_pid"),
                         *[F.col(f"__lk_{k}").alias(f"__k_key_{k}") for k in keys],
                         *[c.alias(n) for n, c in cum.items()]).where(F.col("__k_pid").isNotNull())

    cond = F.col(_PID) == F.col("__k_pid")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_key_{k}"))
    joined = scanned.join(F.broadcast(carry), cond, "left")

    def add_carry(local_col: str, carried: str) -> Column:
        return F.col(local_col) + F.coalesce(F.col(carried), F.lit(0))

    final = []
    if spec.count_as:
        final.append(add_carry(cnt_local, "__k_cnt").alias(spec.count_as))
    for name in list(spec.sums) + list(spec.nonnull):
        final.append(add_carry(tmp[name], f"__k_{name}").alias(name))
    for name in spec.maxes:
        final.append(F.greatest(F.col(tmp[name]), F.col(f"__k_{name}"))
                     .cast(_spark_type(df, spec.maxes[name])).alias(name))
    for name in spec.lags:
        final.append(F.when(F.col(cnt_local) == 0, F.col(f"__k_{name}"))
                     .otherwise(F.col(tmp[name])).alias(name))
    return joined.select(*[F.col(c) for c in df.columns], *final)


def out_type(df: DataFrame, src: str):
    st = _spark_type(df, src)
    return T.DoubleType() if isinstance(st, (T.DoubleType, T.FloatType)) else st
