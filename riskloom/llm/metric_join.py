"""Embedding near-dedup: an exact metric range join over pivot cells.

Cosine >= t between unit vectors is a distance of at most ``sqrt(2 - 2t)``.
Every vector belongs to the cell of its nearest pivot. Cells are put together
to blocks of homes, and a vector is copied, as a guest, to each other block with
a cell that can hold a neighbour: by the triangle inequality one within (cell
radius + distance) of that pivot and no farther than the distance from the plane
between the two pivots. Of two blocks one takes the guests of the other, so each
vector meets all its neighbours once. A block's guests come in bounded groups,
so no group grows with the data.

Copies are made in turns: a turn's groups are joined and their links stored
before the next turn's copies are dealt out, so copies under way take no more
disk than the vectors, however many blocks a vector is a guest of.

Equal vectors are collapsed first and counted. Links are counted where they
are found; only a spanning forest of each block's links leaves it, so output
stays linear in the vectors whatever the size of a group of copies.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are kept; only vectors of one length are
compared; repeated rows are vectors of their own; a null vec_id takes part,
its component is the smallest non-null id reachable; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..session import ensure_checkpoint_dir
from .kdtree import usable
from .tables import components, shuffles_dropped, written

CELL_ROWS = 4096
#: Homes of a block and guests of a group, in cells.
BLOCK_CELLS, GUEST_CELLS = 4, 12
#: Blocks that there are at least, as long as they hold a quarter of a cell.
BLOCKS = 12
#: Bytes of copies that may be under way at least.
TURN_BYTES = 128 << 20
#: Pivots are broadcast: at most this many.
MAX_PIVOTS = 2048
#: Numbers of the single-precision product that are looked at together.
STRIP = 1 << 22
#: Slack of single precision; pairs inside it are computed again in double.
SLACK = 1e-4


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    most = np.abs(v).max(axis=1, keepdims=True)
    v = v / most
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a binary column in doubles."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * dim * len(column) else "<f8").reshape(len(column), dim).astype(np.float64)


def _strip_edges(rows: np.ndarray, cols: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (node, smallest node of its part) of the links a[rows] - b[cols]."""
    nodes, at = np.unique(np.concatenate([a[rows], b[cols]]), return_inverse=True)
    u, v = at[: len(rows)], at[len(rows):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def link(embeddings: DataFrame, threshold: float = 0.95, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    # an array whose elements compare by value: -0.0 becomes 0.0 in the key only; single precision stays as it is
    kind = "float" if isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType) else "double"
    sound = usable("embedding") & F.exists("embedding", lambda x: x != 0)
    rows = embeddings.select("vec_id", F.when(sound, F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))).alias("v"))
    name = [F.xxhash64("v").alias("a"), F.xxhash64(F.lit(5), "v").alias("b")]
    with shuffles_dropped(embeddings.sparkSession):
        classes = written(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
                          .withColumn("cls", F.monotonically_increasing_id()), "range-classes")
        dims = [r.dim for r in classes.select(F.size("v").alias("dim")).distinct().collect()]
        if not dims:
            return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        path = f"{ensure_checkpoint_dir(embeddings.sparkSession)}/range-links-{uuid.uuid4().hex}"
        for d in dims:
            _cells(classes.where(F.size("v") == d), d, 4 if kind == "float" else 8, threshold, reach, cell_rows, path)
        found = embeddings.sparkSession.read.schema(LINKS).parquet(path)
        links = found.where("n IS NOT NULL").groupBy(F.col("src").alias("cls")).agg(F.sum("n").alias("others"))
        parts = components(found.where("dst IS NOT NULL").select("src", "dst"))
        named = classes.select("cls", "least", "n", *name)
        # two hashes name a class to its rows, if no other class has the same; else the vector itself does
        apart = named.groupBy("a", "b").count().where("count > 1").isEmpty()
        if not apart:
            named = classes.select("cls", "least", "n", F.col("v").alias("w"))
        named = named.join(parts.withColumnRenamed("node", "cls"), "cls", "left").join(links, "cls", "left")
        named = written(named.withColumn("component", F.coalesce("component", "cls")), "range-named")
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        named = named.join(least, "component").select(
            *(("a", "b") if apart else "w"), "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        named = written(named, "range-result")
    if apart:
        rows = rows.select("vec_id", *(F.when(F.col("v").isNotNull(), x).alias(k) for k, x in zip("ab", name)))
        out = rows.join(named, ["a", "b"], "left")
    else:
        out = rows.join(named, F.col("v") == F.col("w"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"))


LINKS = "src long, n long, dst long"


def _cells(classes: DataFrame, dim: int, width: int, threshold: float, reach: float, cell_rows: int, path: str) -> None:
    """Adds partial link counts (src, n) and spanning links (src, dst) between classes to the folder ``path``."""
    spark = classes.sparkSession
    total = classes.count()
    n_pivots = min(MAX_PIVOTS, max(1, -(-total // cell_rows)))
    chosen = classes.orderBy(F.xxhash64("v"), "cls").limit(n_pivots).select("v").collect()
    pivots = spark.sparkContext.broadcast(_unit(np.array([r.v for r in chosen], np.float64).reshape(-1, dim)))
    form = f"<f{width}"

    def placed(batch: pa.RecordBatch):
        """(vectors, gap to every pivot, home cell, gap to it) of rows (cls, v, n)."""
        v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        gap = np.sqrt(np.maximum(0, 2 - 2 * _unit(v) @ pivots.value.T))
        home = gap.argmin(axis=1)
        return v, gap, home, gap[np.arange(len(home)), home]

    def spread(batches):
        far, n = np.zeros(n_pivots), np.zeros(n_pivots, np.int64)
        for batch in batches:
            if batch.num_rows:
                _, _, home, own = placed(batch)
                np.maximum.at(far, home, own)
                n += np.bincount(home, minlength=n_pivots)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"home": pa.array(held, pa.int64()), "r": pa.array(far[held]), "n": pa.array(n[held], pa.int64())})

    part = classes.select("cls", "v", "n")
    radius, count = np.zeros(n_pivots), np.zeros(n_pivots, np.int64)
    for r in part.mapInArrow(spread, "home long, r double, n long").groupBy("home").agg(F.max("r").alias("r"), F.sum("n").alias("n")).collect():  # one row per pivot
        radius[r.home], count[r.home] = r.r, r.n
    # cells become blocks in the order of their pivots' distance from the first; a large cell is cut into several
    most = min(BLOCK_CELLS * cell_rows, max(cell_rows // 4, -(-total // BLOCKS)))
    cuts = np.maximum(1, -(-count // most))
    block, blocks, room = np.zeros(n_pivots, np.int64), 0, 0
    for cell in np.argsort(-(pivots.value @ pivots.value[0]), kind="stable").tolist():
        if blocks and cuts[cell] == 1 and count[cell] <= room:
            block[cell], room = blocks - 1, room - count[cell]
        else:
            block[cell], blocks = blocks, blocks + int(cuts[cell])
            room = most - count[cell] if cuts[cell] == 1 else 0
    shape = spark.sparkContext.broadcast((radius, block, cuts))

    def guests_of(cls, gap, home, own):
        """(home block of each row, rows and blocks that they are guests of)."""
        radius, block, cuts = shape.value
        mine = block[home] + cls * 2654435761 % (1 << 31) % cuts[home]
        between = np.sqrt(np.maximum(0, 2 - 2 * pivots.value @ pivots.value.T))
        near = (gap**2 - own[:, None]**2 <= 2 * between[home] * reach + 1e-9) & (gap <= radius + reach)
        near[np.arange(len(home)), home] = True
        row, cell = np.nonzero(near & (count > 0))
        times = cuts[cell]
        row, to = np.repeat(row, times), np.repeat(block[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        both = np.unique(row * np.int64(blocks) + to)
        row, to = both // blocks, both % blocks
        # one of two blocks takes the guests of the other
        takes = np.where((mine[row] + to) % 2 == 1, to > mine[row], to < mine[row])
        return mine, row[takes], to[takes]

    def counted(batches):
        n = np.zeros(blocks, np.int64)
        for batch in batches:
            if batch.num_rows:
                _, gap, home, own = placed(batch)
                n += np.bincount(guests_of(batch.column(0).to_numpy(), gap, home, own)[2], minlength=blocks)
        yield pa.RecordBatch.from_pydict({"block": pa.array(np.flatnonzero(n), pa.int64()), "n": pa.array(n[n > 0], pa.int64())})

    guests = np.zeros(blocks, np.int64)
    for r in part.mapInArrow(counted, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).collect():  # one row per block
        guests[r.block] = r.n
    groups = -(-guests // (GUEST_CELLS * cell_rows))
    first = np.concatenate([[0], np.cumsum(groups + 1)])  # a block's groups: its homes alone, and with each part of the guests
    each = width * dim + 48
    copies = int((guests + groups * np.minimum(most, total)).sum() + total) * each
    turns = min(int(first[-1]), 1 + copies // max(TURN_BYTES, total * each))

    def dealt(turn: int):
        lo, hi = (-(-int(first[-1]) * k // turns) for k in (turn, turn + 1))

        def copy(batches):
            """A row per group of this turn that the vector is needed in."""
            for batch in batches:
                if not batch.num_rows:
                    continue
                cls = batch.column(0).to_numpy()
                v, gap, home, own = placed(batch)
                mine, row, to = guests_of(cls, gap, home, own)
                group = first[to] + 1 + cls[row] * 2654435761 % (1 << 31) % np.maximum(1, groups[to])
                times = groups[mine] + 1
                h_row = np.repeat(np.arange(len(cls)), times)
                h_group = first[mine][h_row] + np.arange(len(h_row)) - np.repeat(np.cumsum(times) - times, times)
                take, group = np.concatenate([row, h_row]), np.concatenate([group, h_group])
                as_home = np.arange(len(take)) >= len(row)
                now = np.flatnonzero((group >= lo) & (group < hi))
                data = pa.array([x.tobytes() for x in np.ascontiguousarray(v, form)], pa.binary())
                for a in range(0, len(now), 8192):
                    s = now[a : a + 8192]
                    t = pa.array(take[s])
                    yield pa.RecordBatch.from_pydict({
                        "grp": pa.array(group[s], pa.int64()), "as_home": pa.array(as_home[s], pa.bool_()), "home": pa.array(home[take[s]], pa.int64()),
                        "gap": pa.array(own[take[s]], pa.float64()), "cls": batch.column(0).take(t), "n": batch.column(2).take(t), "data": data.take(t)})
        return copy

    def join(table: pa.Table) -> pa.Table:
        radius, p = shape.value[0], pivots.value
        as_home, cls, n, home, own = (table.column(c).to_numpy() for c in ("as_home", "cls", "n", "home", "gap"))
        unit = _unit(v := _stack(table.column("data").combine_chunks(), dim))
        small = unit.astype(np.float32)
        alone = as_home.all()
        others, total, edges = np.flatnonzero(as_home == alone), np.zeros(len(cls), np.int64), [(cls[:0], cls[:0])]
        for cell in np.unique(home[as_home]).tolist():
            a, b = np.flatnonzero(as_home & (home == cell)), others
            if not alone:  # the guests that this cell can hold a neighbour of
                gap = np.sqrt(np.maximum(0, 2 - 2 * unit[b] @ p[cell]))
                between = np.sqrt(np.maximum(0, 2 - 2 * p[home[b]] @ p[cell]))
                b = b[(home[b] == cell) | (gap**2 - own[b]**2 <= 2 * between * reach + 1e-9) & (gap <= radius[cell] + reach)]
            right, strip = small[b].T, max(16, STRIP // max(1, len(b)))
            for lo in range(0, len(a), strip):
                rough = small[a[lo : lo + strip]] @ right
                r, c = np.nonzero(rough >= threshold - SLACK)
                sure = rough[r, c] >= threshold + SLACK
                r, c = a[lo + r], b[c]
                close = cls[r] != cls[c]
                r, c, sure = r[close], c[close], sure[close]
                for part in range(0, len(r), 1 << 16):
                    s = np.flatnonzero(~sure[part : part + (1 << 16)]) + part
                    x, y = v[r[s]], v[c[s]]
                    x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
                    cos = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                    sure[s] = cos >= threshold
                r, c = r[sure], c[sure]
                if len(r):
                    np.add.at(total, r, n[c])
                    if not alone:
                        np.add.at(total, c, n[r])
                    edges.append(_strip_edges(r, c, cls, cls))
        u, w = (np.concatenate(x) for x in zip(*edges))
        if len(edges) > 2:  # those of all strips span no more than the group
            u, w = _strip_edges(np.arange(len(u)), np.arange(len(w)), u, w)
        some = np.flatnonzero(total)
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table({"src": pa.array(np.concatenate([cls[some], u]), pa.int64()),
                         "n": pa.chunked_array([pa.array(total[some], pa.int64()), none(len(u))]),
                         "dst": pa.chunked_array([none(len(some)), pa.array(w, pa.int64())])})

    schema = "grp long, as_home boolean, home long, gap double, cls long, n long, data binary"
    for turn in range(turns):
        part.mapInArrow(dealt(turn), schema).groupBy("grp").applyInArrow(join, LINKS).write.mode("append").parquet(path)


def link_sql(threshold: float = 0.95) -> str:
    return f"""
    WITH RECURSIVE v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
      WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding)
        AND NOT list_contains(list_transform(embedding, lambda x: NOT isfinite(x)), true)
        AND list_contains(list_transform(embedding, lambda x: x <> 0), true)
    ), link AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
        AND list_cosine_similarity(a.e, b.e) >= {threshold}
    ), reach AS (
      SELECT vec_id AS a, vec_id AS b FROM embeddings
      UNION
      SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
    ), part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT e.vec_id, CAST((SELECT count(*) FROM link WHERE link.a = e.vec_id) AS BIGINT) AS n_links,
           part.component_id, e.vec_id = part.component_id AS kept
    FROM embeddings e JOIN part ON part.a = e.vec_id"""
