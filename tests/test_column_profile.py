"""Column profiles: merging parts equals profiling the whole; estimates within their error."""

import datetime
import random

from pyspark.sql import functions as F

from riskloom.operators import audit, column_profile

SCHEMA = "k long, f double, t string, d date, s timestamp_ntz, b boolean, bin binary, part int, never string"


def rows(n=6000):
    rng = random.Random(3)
    out = []
    for i in range(n):
        day = datetime.date(2020, 1, 1) + datetime.timedelta(days=rng.randrange(900))
        out.append((rng.randrange(4000) if i % 11 else None, rng.choice([0.0, -0.0, 1.5, float(i % 700)]), rng.choice(["", "é", None, f"v{i % 2500}"]), day,
                    datetime.datetime(day.year, day.month, day.day, i % 24, i % 60), i % 3 == 0, bytes([i % 256]), rng.randrange(7) if i % 13 else None, None))
    return out


def as_rows(df):
    return sorted(map(tuple, df.collect()))


def alike(one, two):
    """All but the estimate equal; a merged sketch may differ from one filled at once, both within the error."""
    one, two = as_rows(one), as_rows(two)
    return [r[:-1] for r in one] == [r[:-1] for r in two] and all(
        abs(a[-1] - b[-1]) <= 1 + 2 * column_profile.DISTINCT_ERROR * b[-1] for a, b in zip(one, two))


def test_united_parts_equal_the_whole(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    whole = column_profile.profile_parts(df, "t")
    parts = column_profile.profile_parts(df, "t", F.col("part"))
    assert parts.select("part").distinct().count() == 8
    assert alike(column_profile.described(column_profile.united(parts)), column_profile.described(whole))


def test_profile_against_plain_counts(spark):
    data = rows()
    found = {r.column_name: r for r in audit.audit_columns({"t": spark.createDataFrame(data, SCHEMA)}, names=("t",)).collect()}
    for place, name in enumerate(["k", "f", "t", "d", "s", "b", "bin", "part", "never"]):
        values = [r[place] for r in data if r[place] is not None]
        row = found[name]
        assert row.ordinal_position == place + 1 and row.null_count == len(data) - len(values)
        distinct = len({v + 0.0 if name == "f" else v for v in values})
        assert abs(row.approx_distinct - distinct) <= -(-distinct * column_profile.DISTINCT_ERROR // 1)
        if name in ("k", "part"):
            assert (row.min_value, row.max_value) == (str(min(values)), str(max(values)))
        if name == "f":
            assert (row.min_value, row.max_value) == (f"{min(values) + 0.0:.6f}", f"{max(values):.6f}")
        if name == "d":
            assert (row.min_value, row.max_value) == (min(values).isoformat(), max(values).isoformat())
    assert (found["never"].min_value, found["never"].max_value, found["never"].approx_distinct) == (None, None, 0)


def test_stored_parts_are_not_scanned_again(spark, tmp_path):
    first, second = spark.createDataFrame(rows(3000), SCHEMA), spark.createDataFrame(rows(6000)[3000:], SCHEMA)
    store = column_profile.ProfileStore(spark, str(tmp_path / "profiles"))
    store.add(first, "t", F.lit("one"))
    store.add(second, "t", F.lit("two"))
    assert alike(store.inventory(), audit.audit_columns({"t": first.unionByName(second)}, names=("t",)))
    plan = store.inventory()._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "LocalTableScan" not in plan and "Scan ExistingRDD" not in plan


def test_empty_table(spark):
    found = audit.audit_columns({"t": spark.createDataFrame([], "k long, t string")}, names=("t",)).collect()
    assert [(r.null_count, r.min_value, r.approx_distinct) for r in found] == [(0, None, 0)] * 2
