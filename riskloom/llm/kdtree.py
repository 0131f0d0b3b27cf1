"""Exact top-k inner-product search: one KD-tree per shard, best-first with a propagated k-th score.

Components become ``floor(scale * x)`` integers, so scores are exact. Rows are
dealt to shards by hash; a shard's tree splits the widest side of its box at
the median and keeps tight boxes. A node's bound is the largest inner product
any point of its box can have with the query. A block of queries first
searches one home shard; its k-th scores are then handed to the searches in all
other shards, which skip every box whose bound is below it.

A tree is built once and stored with its boxes. Query blocks are sent to the
shards they search; a task reads a shard's tree and then streams the blocks
past it, so it holds one tree and one block, and a shard travels once.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows without vec_id; only vectors of the same
length are compared; repeated rows are separate candidates, and a repeated
query row counts once; rows are dealt to shards one by one, so many rows of one
vec_id spread over all; ties go to the smaller vec_id; with no candidates a
query has no rows. Other columns are ignored.
"""

from __future__ import annotations

import copy
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

LEAF_ROWS = 64
SHARD_ROWS = 8192
QUERY_BLOCK = 256


def usable(vector: Column | str) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, odd), F.lit(False))


class Tree:
    """Median-split KD-tree over the rows of one shard; points are reordered so that a leaf is a slice."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        order = np.lexsort((ids,))
        self.ids, self.points = ids[order], points[order]
        self.low, self.high, self.span, self.child, self.least = [], [], [], [], []
        index = np.arange(len(ids))
        self._split(index, 0, len(index), leaf)
        self.ids, self.points = self.ids[index], self.points[index]
        self.low, self.high, self.least = np.array(self.low), np.array(self.high), np.array(self.least)

    def _split(self, index: np.ndarray, lo: int, hi: int, leaf: int) -> int:
        own = self.points[index[lo:hi]]
        node = len(self.span)
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.least.append(self.ids[index[lo:hi]].min())
        self.span.append((lo, hi))
        self.child.append(None)
        side = int(np.argmax(high - low))
        if hi - lo > leaf and high[side] > low[side]:
            half = (hi - lo) // 2
            index[lo:hi] = index[lo:hi][np.argpartition(own[:, side], half, kind="introselect")]
            self.child[node] = (self._split(index, lo, lo + half, leaf), self._split(index, lo + half, hi, leaf))
        return node

    def packed(self) -> dict[str, bytes]:
        """The tree as bytes; points are integers."""
        child = np.array([(-1, -1) if c is None else c for c in self.child])
        return {"ids": self.ids.astype("<i8").tobytes(), "vectors": self.points.astype("<i8").tobytes(), "low": self.low.astype("<i8").tobytes(),
                "high": self.high.astype("<i8").tobytes(), "least": self.least.astype("<i8").tobytes(),
                "span": np.array(self.span).astype("<i8").tobytes(), "child": child.astype("<i8").tobytes()}

    @classmethod
    def unpacked(cls, parts: dict[str, bytes], dim: int) -> Tree:
        tree = cls.__new__(cls)
        tree.ids, tree.least = (np.frombuffer(parts[c], "<i8") for c in ("ids", "least"))
        tree.points, tree.low, tree.high = (_matrix(parts[c], dim) for c in ("vectors", "low", "high"))
        tree.span = [tuple(x) for x in _matrix(parts["span"], 2).tolist()]
        tree.child = [None if a < 0 else (a, b) for a, b in _matrix(parts["child"], 2).tolist()]
        tree.most = max(int(np.abs(tree.low).max(initial=0)), int(np.abs(tree.high).max(initial=0)))
        return tree

    def of_kind(self, kind: type) -> Tree:
        """The same tree with numbers of another kind."""
        tree = copy.copy(self)
        tree.points, tree.low, tree.high = (x.astype(kind) for x in (self.points, self.low, self.high))
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows with id other than ``own`` that reach ``floor``."""
        best_s, best_i = np.empty(0), np.empty(0, np.int64)
        heap = [(-bound[0], 0)]
        while heap:
            up, node = heapq.heappop(heap)
            if -up < floor:
                break
            if len(best_s) == k and -up == floor and self.least[node] > best_i[-1]:
                continue
            if self.child[node] is not None:
                for c in self.child[node]:
                    if bound[c] >= floor:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            lo, hi = self.span[node]
            score, ids = self.points[lo:hi] @ query, self.ids[lo:hi]
            fit = (score >= floor) & (ids != own)
            if fit.any():
                best_s, best_i = np.concatenate([best_s, score[fit]]), np.concatenate([best_i, ids[fit]])
                first = np.lexsort((best_i, -best_s))[:k]
                best_s, best_i = best_s[first], best_i[first]
                if len(best_s) == k:
                    floor = max(floor, best_s[-1])
        return best_i, best_s


def _matrix(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, "<i8").reshape(-1, dim)


def _kind(most: int, queries: np.ndarray, dim: int) -> type:
    """Doubles while every product sum is below 2^53, else Python integers."""
    return np.float64 if most * int(np.abs(queries).max(initial=0)) * max(1, dim) < 2**53 else object


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.ascontiguousarray(np.stack(vectors.to_numpy()), "<i8")


TREE = "shard long, dim int, ids binary, vectors binary, low binary, high binary, least binary, span binary, child binary"
TREE_COLUMNS = [c.split()[0] for c in TREE.split(", ")]


def _trees(rows: DataFrame) -> DataFrame:
    """One row per (shard, dim): its tree."""
    def build(key, pdf):
        tree = Tree(pdf["vec_id"].to_numpy("<i8"), _stacked(pdf["v"]))
        return pd.DataFrame([{"shard": key[0], "dim": key[1], **tree.packed()}])[TREE_COLUMNS]
    return rows.groupBy("shard", "dim").applyInPandas(build, TREE)


def _blocks(asked: DataFrame) -> DataFrame:
    """One row per (query block, dim): packed ids and integer vectors."""
    def pack(key, pdf):
        return pd.DataFrame({"qblock": [key[0]], "dim": [key[1]], "qids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "queries": [_stacked(pdf["v"]).tobytes()]})
    return asked.groupBy("qblock", "dim").applyInPandas(pack, "qblock long, dim int, qids binary, queries binary")


RESULT = "qblock long, query_id long, vec_id long, score long"


def _search(sent: DataFrame, trees: DataFrame, shards: int, k: int) -> DataFrame:
    """Search every query block in the shard it is sent to; ``floors`` holds the k-th scores known so far."""
    def run(batches):
        at, tree, kinds = None, None, {}
        for batch in batches:
            for n in range(batch.num_rows):
                r = {c: batch.column(j)[n].as_py() for j, c in enumerate(batch.schema.names)}
                if r["qids"] is None:  # a tree comes before its blocks
                    at, tree, kinds = (r["shard"], r["dim"]), Tree.unpacked(r, r["dim"]), {}
                    continue
                if at != (r["shard"], r["dim"]):
                    continue  # no rows of this length in the shard
                qid, q = np.frombuffer(r["qids"], "<i8"), _matrix(r["queries"], r["dim"])
                kind = _kind(tree.most, q, r["dim"])
                if kind not in kinds:
                    kinds[kind] = tree.of_kind(kind)
                own = kinds[kind]
                q = q.astype(kind)
                bound = own.bounds(q)
                floors = np.frombuffer(r["floors"], "<f8") if r["floors"] else np.full(len(qid), -np.inf)
                found = [own.search(q[i], qid[i], bound[i], k, floors[i]) for i in range(len(qid))]
                yield pa.RecordBatch.from_pydict({
                    "qblock": pa.array(np.full(sum(len(f[0]) for f in found), r["qblock"]), pa.int64()),
                    "query_id": pa.array(np.repeat(qid, [len(f[0]) for f in found]), pa.int64()),
                    "vec_id": pa.array(np.concatenate([f[0] for f in found]), pa.int64()),
                    "score": pa.array([int(x) for f in found for x in f[1]], pa.int64())})
    both = trees.unionByName(sent, allowMissingColumns=True).repartition(shards, "shard", "dim")
    order = [F.col("shard"), F.col("dim"), F.col("qids").isNotNull(), F.col("qblock")]
    return both.sortWithinPartitions(*order).mapInArrow(run, RESULT)


def top_k(embeddings: DataFrame, every: int = 100, k: int = 10, scale: int = 1024,
          shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = written(embeddings.where(usable("embedding") & F.col("vec_id").isNotNull()).select(
        "vec_id", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("row"),
        F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v")), "topk-rows")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "dim", "v").distinct()
    n, m = rows.count(), asked.count()
    shards, qblocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_block))

    trees = written(_trees(rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))), "topk-trees")
    blocks = written(_blocks(asked.withColumn("qblock", F.pmod(F.xxhash64("vec_id", "v"), F.lit(qblocks)))), "topk-queries")

    home = F.pmod("qblock", F.lit(shards))
    first = written(_search(blocks.withColumn("floors", F.lit(None).cast("binary")).withColumn("shard", home), trees, shards, k), "topk-home")
    # the k-th score of each query in its home shard, laid out as its block's ids are
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = (first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k)
           .groupBy("qblock").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("kth")))

    def floors(frames):
        for pdf in frames:
            kept = []
            for qids, known in zip(pdf["qids"], pdf["kth"]):
                known = dict(known) if known is not None else {}
                kept.append(np.array([known.get(i, -np.inf) for i in np.frombuffer(qids, "<i8").tolist()], "<f8").tobytes())
            yield pdf.assign(floors=kept)[["qblock", "dim", "qids", "queries", "floors"]]

    told = blocks.join(kth, "qblock", "left").mapInPandas(floors, "qblock long, dim int, qids binary, queries binary, floors binary")
    pairs = told.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
    rest = _search(pairs, trees, shards, k)
    return (first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def top_k_sql(every: int = 100, k: int = 10, scale: int = 1024) -> str:
    return f"""
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND list_count(embedding) = len(embedding) AND NOT list_contains(list_transform(embedding, lambda x: NOT isfinite(x)), true)
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM (SELECT DISTINCT * FROM v WHERE vec_id % {every} = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""
