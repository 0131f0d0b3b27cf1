"""CSV hand-over with a reject path."""

import datetime
import os

import pytest
from pyspark.sql import types as T

from riskloom.sources import io


@pytest.fixture(scope="module")
def schema():
    return T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType()),
                         T.StructField("day", T.DateType())])


def put(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, f"{name}.csv"), "w") as f:
            f.write(text)
    return str(folder)


GOOD = "id,name,value,day\n1,a,1.5,2020-01-02\n2,\"b, \\\"q\\\"\",,2020-02-03\n3,,-0.25,\n"


def test_good_rows_and_rejects(spark, schema, tmp_path):
    bad = "id,name,value,day\n4,d,x,2020-01-01\n5,e,2.0\n6,f,3.0,2020-01-01,more\n7,g,4.0,not a day\n8,h,5.0,2020-03-03\n"
    path = put(tmp_path / "in", one=GOOD, two=bad, none="id,name,value,day\n")
    found = io.read_checked_csv(spark, path, schema, str(tmp_path / "store"))
    assert sorted(map(tuple, found.good.collect())) == [
        (1, "a", 1.5, datetime.date(2020, 1, 2)), (2, 'b, "q"', None, datetime.date(2020, 2, 3)), (3, None, -0.25, None), (8, "h", 5.0, datetime.date(2020, 3, 3))]
    assert sorted(r.record for r in found.rejects.collect()) == ["4,d,x,2020-01-01", "5,e,2.0", "6,f,3.0,2020-01-01,more", "7,g,4.0,not a day"]
    assert {os.path.basename(r.file): (r.good_rows, r.rejected_rows) for r in found.counts().collect()} == {"one.csv": (3, 0), "two.csv": (1, 4)}


def test_wrong_headers_raise(spark, schema, tmp_path):
    for name, header in {"order": "name,id,value,day", "missing": "id,name,value", "other": "id,name,amount,day"}.items():
        path = put(tmp_path / name, one=GOOD, two=f"{header}\n1,1,1,2020-01-01\n")
        with pytest.raises(io.WrongHeader):
            io.read_checked_csv(spark, path, schema, str(tmp_path / f"{name}-store"))


def test_share_of_rejects(spark, schema, tmp_path):
    path = put(tmp_path / "in", one=GOOD + "x,y,z,w\n")
    assert io.read_checked_csv(spark, path, schema, str(tmp_path / "a"), max_rejected_share=0.25).good.count() == 3
    with pytest.raises(io.TooManyRejects):
        io.read_checked_csv(spark, path, schema, str(tmp_path / "b"), max_rejected_share=0.2)


def test_files_without_rejects_or_rows(spark, schema, tmp_path):
    whole = io.read_checked_csv(spark, put(tmp_path / "in", one=GOOD), schema, str(tmp_path / "a"))
    assert whole.good.count() == 3 and whole.rejects.count() == 0
    none = io.read_checked_csv(spark, put(tmp_path / "empty", one="id,name,value,day\n"), schema, str(tmp_path / "b"))
    assert none.good.count() == 0 and none.rejects.count() == 0 and none.counts().count() == 0
    assert io.read_checked_csv(spark, put(tmp_path / "bad", one="id,name,value,day\nx,y,z,w\n"), schema, str(tmp_path / "c")).good.count() == 0


def test_round_trip_with_line_breaks(spark, schema, tmp_path):
    rows = [(1, "two\nlines", 0.1, None), (2, 'quote " and, comma', 1e300, datetime.date(1999, 12, 31)), (3, "", None, None)]
    df = spark.createDataFrame(rows, schema)
    io.write_dataset_csv(df, str(tmp_path / "out"))
    found = io.read_checked_csv(spark, str(tmp_path / "out"), schema, str(tmp_path / "store"), multi_line=True)
    want = [(*r[:1], r[1] or None, *r[2:]) for r in rows]  # an empty text reads as NULL
    assert sorted(map(str, map(tuple, found.good.collect()))) == sorted(map(str, want)) and found.rejects.count() == 0
