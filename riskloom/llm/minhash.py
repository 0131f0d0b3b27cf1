"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five lower-case words. Weights are the count in the text
times the inverse document frequency, scaled to 1 ... 2: in a text with a
thousand copies the shared shingles are common and an edit is not, and unscaled
weights would make a few edits outweigh the text. Document frequencies are
counted over all documents in a table of ``2^CELL_BITS`` hashed cells, which
bounds the broadcast. Each text gets ``BANDS x ROWS`` samples (shingle, level) by improved
consistent weighted sampling; two texts agree on a sample with probability
equal to their weighted Jaccard similarity. Texts that agree on a whole band
share a bucket, and pairs from buckets are verified by weighted Jaccard.

Texts with equal shingle counts are one class from the start. Every bucket
names ``LEADERS`` leaders by hash, and each of its classes is compared with
them, in one pass: pairs grow with the classes, not with their square, however
large a group of copies is. Then buckets of at most ``SMALL`` classes compare
all classes that are still apart. Larger buckets do the same in blocks:
classes of a large component get blocks of their own, which never meet each
other, and a task compares two blocks by products of their shingle columns and
returns spanning links only. So components are made twice, whatever the input.
So two classes that share a bucket and are similar always end in one group.

Defined results: a text of fewer than five words is one shingle; null and
empty texts link with nothing; repeated rows are documents of one class, of
which one is kept; a class is named by its smallest doc_id (null if all are
null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import components, written
from .text import Fingerprints, blocks, mix64, shingles, word_prints

SHINGLE = 5
SIMILAR = 0.8
BANDS = 10
ROWS = 3
CELL_BITS = 20
CHUNKS = 64
LEADERS = 3
SMALL = 32
#: Classes and shingles of one block of a larger bucket, about.
BLOCK = 512
BLOCK_SHINGLES = 1 << 19
#: Shingle columns multiplied at a time.
COLUMNS = 4096
#: Bytes of texts that are worked on at a time.
TEXT_BYTES = 1 << 20
#: Size of the pool of (r, ln c, beta) draws; a shingle's hash picks one per sample.
POOL = 1 << 16


def _counts(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count, classes of rows per document) sorted by document and shingle; 32-bit shingles."""
    h, doc = shingles(word, first, SHINGLE)
    h = h >> np.uint64(32)
    key = np.sort(doc.astype(np.uint64) << np.uint64(32) | h)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    doc = (key >> np.uint64(32)).astype(np.int64)
    return doc, (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), count, np.searchsorted(doc, np.arange(len(first)))


def _texts(batches):
    prints = Fingerprints()
    for rows, data, offsets in blocks(batches, TEXT_BYTES):
        word, _, _, first = word_prints(prints, data, offsets)
        yield rows, *_counts(word, first)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency by hashed cell, over all documents."""
    def count(batches):
        total, n = np.zeros(1 << CELL_BITS, np.int64), 0
        for rows, _, shingle, _, _ in _texts(batches):
            total += np.bincount(shingle >> np.uint32(32 - CELL_BITS), minlength=1 << CELL_BITS)
            n += rows.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array(range(CHUNKS + 1), pa.int32()),
                "counts": pa.array([x.astype("<i8").tobytes() for x in [*np.split(total, CHUNKS), np.array([n])]], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for packed in batch.column(batch.schema.get_field_index("counts")):
                part = np.frombuffer(packed.as_buffer(), "<i8")
                total = part.copy() if total is None else total + part
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "chunk int, counts binary")
    # summed by chunk: the table itself, of fixed size, is what the driver gets
    got = {r.chunk: np.frombuffer(bytes(r.counts), "<i8") for r in
           parts.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()}
    if not got:
        return np.ones(1 << CELL_BITS, np.float32)
    df, n = np.concatenate([got[k] for k in range(CHUNKS)]), got[CHUNKS][0]
    return (1 + np.maximum(np.log((1 + n) / (1 + df)), 0) / np.log(1 + n)).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling with draws from a fixed pool."""

    def __init__(self, samples: int) -> None:
        rng = np.random.default_rng(2)
        self.multiplier = rng.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = rng.gamma(2, 1, POOL).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, POOL)).astype(np.float32)
        self.beta = rng.random(POOL, np.float32)
        self.per_r = 1 / self.r

    def samples(self, shingle: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
        """[text, sample] codes; ``at`` are the starts of the texts' (non-empty) ranges."""
        wide = mix64(shingle.astype(np.uint64) + np.uint64(1))
        ln_w = np.log(weight).astype(np.float32)
        n = np.diff(np.append(at, len(shingle)))
        out = np.empty((len(at), len(self.multiplier)), np.uint64)
        for j, m in enumerate(self.multiplier):
            pick = (wide * m >> np.uint64(48)).astype(np.int64)
            r, beta = self.r[pick], self.beta[pick]
            level = np.floor(ln_w * self.per_r[pick] + beta)
            ln_a = self.ln_c[pick] - r * (level - beta + 1)
            least = np.minimum.reduceat(ln_a, at)
            best = np.flatnonzero(ln_a == np.repeat(least, n))
            code = mix64(wide[best] * m + level[best].astype(np.int64).astype(np.uint64))
            # equal draws: the smallest code
            text = np.searchsorted(at, best, side="right") - 1
            starts = np.searchsorted(text, np.arange(len(at)))
            out[:, j] = np.minimum.reduceat(code, starts)
        return out


def signatures(docs: DataFrame, idf, bands: int, rows_: int) -> DataFrame:
    """(doc_id, text_key, a, b, bands): the class (a, b) of equal shingle counts and the band keys; empty texts have none."""
    def sign(batches):
        sampler = Sampler(bands * rows_)
        weights = idf.value
        for rows, doc, shingle, count, at in _texts(batches):
            n = rows.num_rows
            some = np.flatnonzero(np.diff(at) > 0)
            a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            keys = np.zeros((n, bands), np.uint64)
            if len(some):
                starts = at[:-1][some]
                one = mix64(shingle.astype(np.uint64) * np.uint64(2654435761) + count.astype(np.uint64))
                a[some] = np.add.reduceat(one, starts)
                b[some] = np.add.reduceat(mix64(one ^ np.uint64(0x9E3779B97F4A7C15)), starts)
                code = sampler.samples(shingle, count * weights[shingle >> np.uint32(32 - CELL_BITS)], starts)
                for k in range(bands):
                    key = np.full(len(some), k, np.uint64)
                    for j in range(rows_):
                        key = mix64(key * np.uint64(31) + code[:, k * rows_ + j])
                    keys[some, k] = key
            null = np.diff(at) == 0
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column(rows.schema.get_field_index("doc_id")),
                "text_key": rows.column(rows.schema.get_field_index("text_key")),
                "a": pa.array(a.view(np.int64), mask=null), "b": pa.array(b.view(np.int64), mask=null),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64)))})
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        sign, "doc_id long, text_key long, a long, b long, bands array<long>")


def vectors(docs: DataFrame) -> DataFrame:
    """(a, b, v): every text's class and its packed sorted shingles and counts."""
    def pack(batches):
        for rows, doc, shingle, count, at in _texts(batches):
            some = np.flatnonzero(np.diff(at) > 0)
            if not len(some):
                continue
            starts = at[:-1][some]
            one = mix64(shingle.astype(np.uint64) * np.uint64(2654435761) + count.astype(np.uint64))
            packed = [shingle[i:j].astype("<u4").tobytes() + (b"" if (c := count[i:j]).max() == 1 else c.astype("<u4").tobytes())
                      for i, j in zip(starts.tolist(), at[1:][some].tolist())]
            yield pa.RecordBatch.from_pydict({
                "a": pa.array(np.add.reduceat(one, starts).view(np.int64)),
                "b": pa.array(np.add.reduceat(mix64(one ^ np.uint64(0x9E3779B97F4A7C15)), starts).view(np.int64)),
                "n": pa.array((at[1:] - at[:-1])[some], pa.int32()), "v": pa.array(packed, pa.binary())})
    return docs.select("text").mapInArrow(pack, "a long, b long, n int, v binary")


def _unpack(n: int, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(v, "<u4")
    return whole[:n], whole[n:] if len(whole) > n else np.ones(n, np.uint32)


def weighted_jaccard(x: tuple, y: tuple, idf: np.ndarray) -> float:
    """Sum of minima over sum of maxima of the two texts' weights."""
    (s, c), (t, d) = x, y
    shift = np.uint32(32 - CELL_BITS)
    _, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
    w = idf[s[i] >> shift].astype(np.float64)
    both = float((np.minimum(c[i], d[j]) * w).sum())
    total = float((c * idf[s >> shift].astype(np.float64)).sum() + (d * idf[t >> shift].astype(np.float64)).sum())
    return both / (total - both) if total > both else 1.0


def verify(pairs: DataFrame, held: DataFrame, idf) -> DataFrame:
    """(x, y, sim) of the pairs of classes (x, y)."""
    def measure(batches):
        weights = idf.value
        for batch in batches:
            n1, v1, n2, v2 = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n1", "v1", "n2", "v2"))
            # a leader meets its members one after another: its vector is unpacked once
            sim = [weighted_jaccard(_unpack(n, v), _unpack(m, w), weights) for n, v, m, w in zip(n1, v1, n2, v2)]
            yield pa.RecordBatch.from_pydict({"x": batch.column(0), "y": batch.column(1), "sim": pa.array(sim, pa.float64())})
    one = held.select(F.col("cls").alias("x"), F.col("n").alias("n1"), F.col("v").alias("v1"))
    two = held.select(F.col("cls").alias("y"), F.col("n").alias("n2"), F.col("v").alias("v2"))
    joined = pairs.join(two, "y").join(one, "x").select("x", "y", "n1", "v1", "n2", "v2")
    return joined.mapInArrow(measure, "x long, y long, sim double")


def _levels(n: list[int], v: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, element, weight): a shingle of count c is c elements, so weighted Jaccard is that of weighted sets."""
    each = [_unpack(*x) for x in zip(n, v)]
    shingle, count = (np.concatenate(x) for x in zip(*each))
    cls = np.repeat(np.repeat(np.arange(len(n)), n), count)
    level = np.arange(len(cls)) - np.repeat(np.cumsum(count) - count, count)
    shingle = np.repeat(shingle, count)
    return cls, shingle.astype(np.uint64) | level.astype(np.uint64) << np.uint64(32), idf[shingle >> np.uint32(32 - CELL_BITS)]


def similar_pairs(n: list[int], v: list[bytes], left: np.ndarray, right: np.ndarray, idf: np.ndarray, similar: float) -> Iterator[tuple[int, int]]:
    """Pairs (i of ``left``, j of ``right``) of classes whose weighted Jaccard similarity reaches ``similar``."""
    cls, element, weight = _levels(n, v, idf)
    total = np.bincount(cls, weight, len(n))
    _, col = np.unique(element, return_inverse=True)
    place, holds = np.full((2, len(n)), -1), np.zeros((2, col.max() + 1), bool)
    for side, own in enumerate((left, right)):
        place[side, own] = np.arange(len(own))
        holds[side, col[place[side, cls] >= 0]] = True
    both = holds.all(axis=0)
    number = np.where(both, np.cumsum(both) - 1, -1)[col]
    order = np.argsort(number, kind="stable")
    order = order[np.searchsorted(number[order], 0):]
    shared = np.zeros((len(left), len(right)), np.float32)
    cuts = np.searchsorted(number[order], np.arange(0, both.sum() + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = order[a:b]
        x, y = (np.zeros((len(own), COLUMNS), np.float32) for own in (left, right))
        mine = part[place[0, cls[part]] >= 0]
        x[place[0, cls[mine]], number[mine] - k * COLUMNS] = weight[mine]
        mine = part[place[1, cls[part]] >= 0]
        y[place[1, cls[mine]], number[mine] - k * COLUMNS] = 1
        shared += x @ y.T
    # the products are rounded: pairs near the limit are measured again
    limit = similar / (1 + similar) * (total[left][:, None] + total[right][None, :])
    for i, j in np.argwhere(shared >= limit * (1 - 1e-4)).tolist():
        yield int(left[i]), int(right[j])


def crowded_links(crowd: DataFrame, held: DataFrame, idf, similar: float) -> DataFrame:
    """(x, y, sim): links between the parts of buckets (bucket, cls, part), all pairs of different parts compared."""
    sized = crowd.join(held.select("cls", F.col("n").alias("width")), "cls")
    own = sized.groupBy("bucket", "part").agg(F.count("*").alias("m")).where(F.col("m") >= BLOCK).select("bucket", "part", F.col("part").alias("own"))
    sized = sized.join(own, ["bucket", "part"], "left").withColumn("own", F.coalesce("own", F.lit(-1).cast("long")))
    slots = sized.groupBy("bucket", "own").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("width") / BLOCK_SHINGLES)).alias("slots"))
    placed = written(sized.join(slots, ["bucket", "own"]).select(
        "bucket", "own", F.pmod(F.xxhash64("cls"), F.col("slots")).alias("slot"), "cls", "part"), "near-blocks")
    blocks_ = placed.select("bucket", F.struct("own", "slot").alias("at")).distinct()
    meet = blocks_.alias("m").join(blocks_.alias("n"), F.expr(
        "m.bucket = n.bucket AND m.at <= n.at AND (m.at.own <> n.at.own OR m.at.own = -1)")).selectExpr("m.bucket AS bucket", "m.at AS one", "n.at AS two")
    sides = meet.select("bucket", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("at"))
    dealt = sides.join(placed.select("bucket", F.struct("own", "slot").alias("at"), "cls", "part"), ["bucket", "at"]).select(
        F.concat_ws(" ", "bucket", "one.own", "one.slot", "two.own", "two.slot").alias("pair"), (F.col("at") == F.col("one")).alias("first"),
        (F.col("at") == F.col("two")).alias("second"), "cls", "part").join(held, "cls")

    def compare(table: pa.Table) -> pa.Table:
        cls, part = (table.column(c).to_numpy() for c in ("cls", "part"))
        n, v = table.column("n").to_pylist(), table.column("v").to_pylist()
        left, right = (np.flatnonzero(table.column(c).to_numpy()) for c in ("first", "second"))
        root: dict[int, int] = {}

        def find(p: int) -> int:
            while root.get(p, p) != p:
                p = root[p]
            return p

        out = []
        for i, j in similar_pairs(n, v, left, right, idf.value, similar):
            a, b = find(int(part[i])), find(int(part[j]))
            if a != b and (sim := weighted_jaccard(_unpack(n[i], v[i]), _unpack(n[j], v[j]), idf.value)) >= similar:
                root[max(a, b)] = min(a, b)
                out.append((min(cls[i], cls[j]), max(cls[i], cls[j]), sim))
        x, y, sim = zip(*out) if out else ((), (), ())
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), "sim": pa.array(sim, pa.float64())})

    return dealt.groupBy("pair").applyInArrow(compare, "x long, y long, sim double")


def joined_components(linked: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links (x, y): only the components that the new links join are worked on."""
    def top(side: str) -> DataFrame:
        return linked.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    contracted = links.select("x", "y").join(top("x"), "x", "left").join(top("y"), "y", "left").select(
        F.coalesce("of_x", "x").alias("src"), F.coalesce("of_y", "y").alias("dst")).where("src <> dst")
    moved = components(contracted)
    old = linked.join(moved.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select(
        "node", F.coalesce("top", "component").alias("component"))
    new = moved.join(linked.select("node"), "node", "left_anti").select("node", "component")
    return written(old.unionByName(new), "near-components")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its group), kept (one per group), text_key (hash of its text)."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs))
    signed = written(signatures(docs, idf, bands, rows).withColumn("row", F.monotonically_increasing_id()), "near-signed")
    classes = written(signed.where("a IS NOT NULL").groupBy("a", "b").agg(F.min("row").alias("cls"), F.first("bands").alias("bands")), "near-classes")

    keyed = classes.select("cls", F.explode("bands").alias("bucket"))
    crowded = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = written(keyed.join(crowded, "bucket").select("bucket", "cls"), "near-buckets")
    asked = classes.join(members.select("cls").distinct(), "cls", "left_semi").select("a", "b", "cls")
    held = written(vectors(docs).join(asked, ["a", "b"]).dropDuplicates(["a", "b"]).select("cls", "n", "v"), "near-vectors")

    known = spark.createDataFrame([], "x long, y long, sim double")
    linked = spark.createDataFrame([], "node long, component long")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("cls", "other").alias("x"), F.greatest("cls", "other").alias("y")).distinct()

    # each class of a bucket is compared with all its leaders at once
    leads = members.groupBy("bucket").agg(*(F.min(F.struct(F.xxhash64("cls", F.lit(k)).alias("h"), "cls")).alias(f"lead{k}") for k in range(LEADERS)))
    leads = leads.select("bucket", F.array(*(f"lead{k}.cls" for k in range(LEADERS))).alias("leads"))
    led = members.join(leads, "bucket").select("cls", F.explode("leads").alias("other")).where("cls <> other")
    led = written(ordered(led), "near-led")
    if not led.isEmpty():
        known = written(verify(led, held, idf), "near-led-sim")
        linked = written(components(known.where(F.col("sim") >= similar).select(F.col("x").alias("src"), F.col("y").alias("dst"))), "near-components")

    # buckets whose classes are still apart: all pairs in small ones, blocks in larger ones
    part = members.join(linked.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "cls", F.coalesce("component", "cls").alias("part"))
    split = part.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low < high")
    rest = written(part.join(split.select("bucket", "n"), "bucket"), "near-rest")
    few, crowd = rest.where(F.col("n") <= SMALL), rest.where(F.col("n") > SMALL).drop("n")
    pairs = few.alias("m").join(few.alias("n"), F.expr("m.bucket = n.bucket AND m.cls < n.cls AND m.part <> n.part")).selectExpr("m.cls AS cls", "n.cls AS other")
    found = []
    if not few.isEmpty():
        found.append(verify(written(ordered(pairs).join(known, ["x", "y"], "left_anti"), "near-few"), held, idf))
    if not crowd.isEmpty():
        found.append(crowded_links(crowd, held, idf, similar))
    if found:
        links = written(reduce(DataFrame.unionByName, found).where(F.col("sim") >= similar), "near-links")
        if not links.isEmpty():
            linked = joined_components(linked, links)
    linked = linked.withColumnRenamed("node", "cls")

    grouped = classes.select("a", "b", "cls").join(linked, "cls", "left").select("a", "b", F.coalesce("component", "cls").alias("grp"))
    out = signed.drop("bands").join(grouped, ["a", "b"], "left").withColumn("grp", F.coalesce("grp", "row"))
    # the kept document is the group's first by doc_id, then row: a minimum, so no group is gathered
    head = out.groupBy("grp").agg(F.min("doc_id").alias("class_id"),
                                  F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("row").alias("r"))).alias("first"))
    return out.join(head.select("grp", "class_id", F.col("first.r").alias("r")), "grp").select(
        "doc_id", "class_id", (F.col("row") == F.col("r")).alias("kept"), "text_key")
