"""Vector operators, WARC archives and the pipeline's stages."""

import hashlib

import duckdb
import pytest
import numpy as np
import pyarrow as pa

import corpus_pipeline
from riskloom.llm import kdtree, metric_join, tables, warc
from riskloom.llm.tables import components

from .cases import frame


def vectors(spark, rows):
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())),
                      "shard": pa.array(["clash"] * len(rows), pa.string()), "v": pa.array([0] * len(rows), pa.int64())})
    return spark.createDataFrame(table)


def awkward(n=400, dim=8):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(dim).tolist()) for i in range(n)]
    rows += [(n + i, [x + 0.01 * rng.standard_normal() for x in rows[i][1]]) for i in range(30)]
    rows += [(n + 100 + i, rows[7][1]) for i in range(60)]  # copies of one vector
    rows += [(900, None), (901, []), (902, [None] * dim), (903, [float("nan")] * dim), (904, [float("inf")] * dim), (905, [0.0] * dim),
             (906, [1.0] * 3), (5, rows[5][1]), (None, rows[9][1])]
    return rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("hot", [False, True])
def test_top_k_equals_brute_force(spark, hot):
    rows = awkward()
    if hot:  # one vec_id holds half of the rows
        rng = np.random.default_rng(4)
        rows += [(777, rng.standard_normal(8).tolist()) for _ in range(500)]
    got = sorted(tuple(r) for r in kdtree.top_k(vectors(spark, rows), every=20, k=5, shard_rows=64, query_block=8).collect())
    ints = [(i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows if usable(v) and i is not None]
    want = []
    for q, v in {i: v for i, v in ints if i % 20 == 0}.items():
        best = sorted(((-int(v @ w), j) for j, w in ints if j != q and len(w) == len(v)))[:5]
        want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert kdtree.top_k(vectors(spark, rows[:0])).count() == 0


def test_metric_join_equals_brute_force(spark):
    rows = awkward()
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in metric_join.link(vectors(spark, rows), cell_rows=64).collect())
    fit = [k for k, (i, v) in enumerate(rows) if usable(v) and any(v)]
    near = {k: [] for k in range(len(rows))}
    for a in fit:
        for b in fit:
            x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
            if a != b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.95:
                near[a].append(b)
    want = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        want.append((str(i), len(near[k]), least, i == least))
    assert got == sorted(want)
    assert metric_join.link(vectors(spark, rows[:0])).count() == 0


def test_metric_join_deals_copies_out_in_turns(spark, monkeypatch):
    """Whatever the turns, blocks and parts of guests: the same links; no turn's copies take more than a turn may."""
    import re
    rows = awkward()
    want = sorted(map(str, metric_join.link(vectors(spark, rows)).collect()))
    told, unit = [], metric_join._cells

    def cells(classes, dim, width, threshold, reach, cell_rows, path):
        unit(classes, dim, width, threshold, reach, cell_rows, path)
        files = [str(r[0]) for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect()]
        told.append(len({re.search(r"part-\d+-([0-9a-f-]{36})", f)[1] for f in files}))
    monkeypatch.setattr(metric_join, "_cells", cells)
    monkeypatch.setattr(metric_join, "TURN_BYTES", 1 << 10)
    for cell_rows in (16, 64):
        assert sorted(map(str, metric_join.link(vectors(spark, rows), cell_rows=cell_rows).collect())) == want
    assert max(told) > 3


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(200, 260)] + [(7, 8), (8, 9), (9, 7), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 260)} == {1}
    assert got[7] == got[8] == got[9] == 7 and 5 not in got
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_stars_take_no_round(spark, monkeypatch):
    labels, kept = [], tables.written
    monkeypatch.setattr(tables, "written", lambda df, label, **options: labels.append(label) or kept(df, label, **options))
    stars = [(1, i) for i in range(10, 30)] + [(40, 2), (2, 41), (41, 2), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(stars, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 2, 40: 2, 41: 2} | {i: 1 for i in range(10, 30)}
    assert labels == ["links"]
    assert {r.component for r in components(spark.createDataFrame([(1, 3), (2, 3)], "src long, dst long")).collect()} == {1}
    assert len(labels) > 2


def pages(spark, rows):
    return spark.createDataFrame(pa.table({
        "page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string()),
        "html": pa.array([r[2] for r in rows], pa.string()), "chunk": pa.array(["clash"] * len(rows), pa.string()),
        "record_type": pa.array(["clash"] * len(rows), pa.string())}))


PAGES = [(3, "http://a/ b\r\nX: y", "ü" * 500), (1, None, "ü" * 500), (2, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"),
         (7, "u", "WARC/1.1\r\n\r\nbody\r\n\r\n" * 400), (8, "u", "\r\n\r\n" * 100), (9, "u", "\r\n\r\n" * 100), (None, "u", "ü" * 500),
         (10, "u", "y" * 300_000), (11, "u", "y" * 300_000), (12, "u", "z"), (12, "u", "z"), (13, "u", "w" * 200), (13, "u", "w" * 200)]


def test_archives_round_trip(spark):
    got = sorted((tuple(r) for r in warc.archive_round_trip(pages(spark, PAGES), chunk_bytes=1000).collect()), key=str)
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        again = h in first and first[h] != i
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_chunks_carry_running_digests_and_rebuild_the_payload(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archives(pages(spark, PAGES), path, chunk_bytes=1000)
    chunks = warc.read_chunks(spark, path).where("page_id = 10").orderBy("chunk").collect()
    body, sha = b"", hashlib.sha256()
    for k, c in enumerate(chunks):
        sha.update(c.data)
        assert (c.chunk, c.start, c.running_digest, c.last) == (k, len(body), sha.hexdigest(), k == len(chunks) - 1)
        body += c.data
    assert len(chunks) == 300 and body == b"y" * 300_000


def test_rows_of_one_id_spread_over_shards_and_a_stored_tree_is_the_tree(spark):
    from pyspark.sql import functions as F
    rows = spark.range(2000).select(F.lit(7).cast("long").alias("vec_id"), F.lit(2).alias("dim"), F.array(F.col("id"), F.col("id") % 13).alias("v"), F.col("id").alias("row"))
    trees = kdtree._trees(rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(8)))).collect()
    sizes = [len(r["ids"]) // 8 for r in trees]
    assert len(trees) == 8 and max(sizes) < 400 and sum(sizes) == 2000
    points = np.array([[k, k % 13] for k in range(300)])
    tree = kdtree.Tree(np.arange(300), points, leaf=16)
    again = kdtree.Tree.unpacked(tree.packed(), 2)
    query = np.array([3, -5])
    assert again.span == [tuple(map(int, x)) for x in tree.span] and (again.points == tree.points).all()
    one, two = (t.search(query, 5, t.bounds(query[None, :])[0], 7, -np.inf) for t in (tree, again))
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()


def test_segments_cross_file_borders(spark, tmp_path):
    """Records of several segments over many files, among them repeated rows and a record longer than a file."""
    rows = [(i, f"http://x/{i}", f"{i} " * 400) for i in range(300)] + [(7, "http://x/7", "7 " * 400)] * 3 + [(None, None, "z" * 4000)] * 2
    rows += [(1000, "http://x/long", "".join(chr(97 + i % 26) for i in range(60_000))), (1001, "u", "é" * 3000)]
    path = f"file://{tmp_path}/archive"
    warc.write_archives(pages(spark, rows).coalesce(2), path, chunk_bytes=300, file_records=7)
    assert len([f for f in (tmp_path / "archive").iterdir() if f.name.endswith(".gz")]) > 100
    found = warc.read_chunks(spark, path).where("last").collect()
    assert len(found) == len(rows)
    want = sorted((str(i), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_digest) for r in found) == want
    for r in found:
        if r.record_type == "response":
            assert r.running_digest == r.payload_digest
    long = warc.read_chunks(spark, path).where("page_id = 1000").orderBy("chunk").collect()
    assert b"".join(c.data for c in long) == rows[-2][2].encode() and [c.chunk for c in long] == list(range(200))


def test_a_lost_file_is_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archives(pages(spark, [(1, "u", "".join(chr(97 + i % 26) for i in range(30_000)))]).coalesce(1), path, chunk_bytes=300, file_records=7)
    lost = sorted(f for f in (tmp_path / "archive").iterdir() if f.name.endswith(".gz"))[3]
    kept = f"file://{tmp_path}/kept"
    (tmp_path / "kept").mkdir()
    for f in (tmp_path / "archive").iterdir():
        if f != lost and f.name.endswith(".gz"):
            (tmp_path / "kept" / f.name).write_bytes(f.read_bytes())
    with pytest.raises(Exception, match="segment"):
        warc.read_chunks(spark, kept).collect()


def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs, counts = tables.table(spark, sf, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = tables.written(stage(spark, docs, sf), f"test-{name}")
        counts.append(docs.count())
        if name != "pack":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "passages", "mix", "pack"]
    assert 200 > counts[0] > counts[1] == counts[2] and counts[4] >= counts[3] > 0
    lengths = docs.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 4096 for r in lengths)


def test_stages_take_awkward_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    for rows in (None, []):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = tables.written(stage(spark, docs, sf), f"edge-{name}")
        assert (docs.count() > 0) == (rows is None)


def test_twins_of_the_vector_and_archive_queries(spark):
    from riskloom.llm import catalog
    from tools.check_oracle import TABLES, rows
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in catalog.llm_oracles().items():
        assert rows(catalog.llm_queries()[name](spark, sf).toPandas()) == rows(con.sql(sql).df()), name
