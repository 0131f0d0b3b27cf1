"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent-semantic space.

A document's terms are its words' shapes (case, last character, length,
digits, same as the word before), pairs of neighbouring shapes, and lower-case
words, hashed into ``DIMS`` columns: square roots of the counts times the
inverse document frequency over all documents, scaled to length one. A
truncated SVD of at most ``SAMPLE`` labelled documents gives the latent space;
their vectors are broadcast. Every document's cosines with all of them are
computed exactly, a block at a time, and the labels of the ``NEIGHBOURS``
closest are averaged with weight cosine^``SHARPNESS``.

Labels come only from rows whose crc32(doc_id as text) mod 4 is not 2. The
labelled sample is the ``SAMPLE`` rows of smallest hash, the only bound; the
document frequencies, the vectors and the votes cover all rows and whole texts.

Defined results: a null or empty text has no terms and gets the share of label
1 in the sample, as does every row when nothing is labelled (0.5 then); a null
doc_id is scored and not held out; a doc_id with several labels counts with
its mean label; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Fingerprints, blocks, lower_ascii, words

DIMS = 4096
SHAPE_DIMS = 512
PAIR_DIMS = 1536
SAMPLE = 4096
LATENT = 64
NEIGHBOURS = 25
SHARPNESS = 4
KEEP = 0.7


def held_out(doc_id: Column | str) -> Column:
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.coalesce(F.crc32(text) % 4 == 2, F.lit(False))


def _classes() -> np.ndarray:
    """Class of a word's last byte: letter or digit, full stop, comma, exclamation or question, bar, other ASCII."""
    kind = np.full(256, 5, np.int64)
    kind[128:] = 0
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        kind[lo:hi] = 0
    for k, chars in ((1, ".:;"), (2, ","), (3, "!?"), (4, "|")):
        kind[[ord(c) for c in chars]] = k
    return kind


class Terms:
    """Term columns of the words of a block."""

    def __init__(self) -> None:
        self.prints, self.last = Fingerprints(), _classes()

    def columns(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, column) of every term."""
        start, end, first = words(data, offsets)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        if not len(start):
            return doc, doc
        def count(mask):
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(mask, out=total[1:])
            return total[end] - total[start]
        upper = count((data >= 65) & (data < 91))
        digits = count((data >= 48) & (data < 58)) > 0
        odd = count(self.last[data] == 5)
        length = end - start
        prints = self.prints
        exact = prints.of(prints.prefix(data), start, end)
        same = np.zeros(len(start), bool)
        same[1:] = (exact[1:] == exact[:-1]) & (doc[1:] == doc[:-1])
        case = np.where(upper == 0, 0, np.where(upper == 1, 1, 2))
        shape = np.searchsorted([2, 5, 9, 16], length, side="right")
        for part, size in ((self.last[data[end - 1]], 6), (case, 3), (digits, 2), (same, 2), (np.minimum(odd, 2), 3)):
            shape = shape * size + part
        spread = (shape.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        own = (spread >> np.uint64(40)) % np.uint64(SHAPE_DIMS)
        pair = (spread[:-1] * np.uint64(31) + spread[1:] >> np.uint64(36)) % np.uint64(PAIR_DIMS) + np.uint64(SHAPE_DIMS)
        inside = doc[1:] == doc[:-1]
        word = prints.of(prints.prefix(lower_ascii(data)), start, end) % np.uint64(DIMS - SHAPE_DIMS - PAIR_DIMS) + np.uint64(SHAPE_DIMS + PAIR_DIMS)
        return (np.concatenate([doc, doc[1:][inside], doc]),
                np.concatenate([own, pair[inside], word]).astype(np.int64))

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, column = self.columns(data, offsets)
        n = len(offsets) - 1
        return np.bincount(doc * DIMS + column, minlength=n * DIMS).reshape(n, DIMS)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each term column, and their number; summed in the tasks, then over tasks."""
    def count(batches):
        terms, total, n = Terms(), np.zeros(DIMS, np.int64), 0
        for rows, data, offsets in blocks(batches):
            for lo in range(0, rows.num_rows, 256):
                part = offsets[lo : lo + 257]
                total += (terms.counts(data[part[0] : part[-1]], part - part[0]) > 0).sum(axis=0)
            n += rows.num_rows
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(-1, DIMS), pa.int64()),
                                          "df": pa.array(np.concatenate([[n], total]), pa.int64())})
    got = docs.select("text").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(DIMS + 1, np.int64)
    for r in got:  # DIMS + 1 rows
        df[r.term + 1] = r.df
    return df[1:], int(df[0])


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts).astype(np.float32) * idf
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> list[tuple[float, bytes]]:
    """(label, packed term counts) of at most ``sample`` labelled documents that are not held out."""
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
             .groupBy("doc_id").agg(F.avg("quality").alias("label")))
    chosen = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def pack(batches):
        terms = Terms()
        for rows, data, offsets in blocks(batches):
            label = rows.column(rows.schema.get_field_index("label"))
            for lo in range(0, rows.num_rows, 256):
                part = offsets[lo : lo + 257]
                counts = terms.counts(data[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_pydict({
                    "label": label.slice(lo, len(counts)),
                    "counts": pa.array([np.stack([c := np.flatnonzero(x), x[c]]).astype("<i4").tobytes() for x in counts], pa.binary())})
    # at most `sample` rows: small enough to send to every task
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = one.select("label", "text").mapInArrow(pack, "label double, counts binary")
    return sorted((r.label, bytes(r.counts)) for r in got.collect())


def fit(sample: list[tuple[float, bytes]], df: np.ndarray, n: int, latent: int = LATENT) -> dict:
    """The model: idf, projection to the latent space, labelled vectors there."""
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    if not sample:
        return {"idf": idf, "axes": np.zeros((DIMS, 1), np.float32), "vectors": np.zeros((0, 1), np.float32),
                "labels": np.zeros(0), "prior": 0.5}
    counts = np.zeros((len(sample), DIMS), np.float32)
    for i, (_, packed) in enumerate(sample):
        column, value = np.frombuffer(packed, "<i4").reshape(2, -1)
        counts[i, column] = value
    np.sqrt(counts, out=counts)  # as weigh(), in the one array that is there
    counts *= idf
    x = counts
    for lo in range(0, len(x), 256):
        length = np.sqrt((x[lo : lo + 256] ** 2).sum(axis=1, keepdims=True))
        x[lo : lo + 256] /= np.where(length > 0, length, 1)
    # truncated SVD: orthonormal range of random projections after three power steps
    basis = np.random.default_rng(3).standard_normal((DIMS, latent + 16)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ turn.T)[:, :latent].astype(np.float32)
    labels = np.array([label for label, _ in sample])
    return {"idf": idf, "axes": axes, "vectors": latent_vectors(x, axes), "labels": labels, "prior": float(labels.mean())}


def latent_vectors(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    z = x @ axes
    length = np.sqrt((z * z).sum(axis=1, keepdims=True))
    return z / np.where(length > 0, length, 1)


def votes(z: np.ndarray, model: dict, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> np.ndarray:
    """Weighted mean label of the closest labelled vectors; the prior where nothing is similar."""
    m = len(model["labels"])
    if not m:
        return np.full(len(z), model["prior"])
    cos = z @ model["vectors"].T
    k = min(neighbours, m)
    near = np.argpartition(cos, m - k, axis=1)[:, m - k:] if k < m else np.tile(np.arange(m), (len(z), 1))
    weight = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** sharpness
    total = weight.sum(axis=1)
    return np.where(total > 0, (weight * model["labels"][near]).sum(axis=1) / np.where(total > 0, total, 1), model["prior"])


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, latent: int = LATENT,
             threshold: float = KEEP, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, and the columns ``keep``."""
    spark = docs.sparkSession
    df, n = document_frequencies(docs)
    model = spark.sparkContext.broadcast(fit(labelled_sample(docs, labels, sample), df, n, latent))

    def score(batches):
        terms, m = Terms(), model.value
        for rows, data, offsets in blocks(batches):
            out = []
            for lo in range(0, rows.num_rows, 256):
                part = offsets[lo : lo + 257]
                counts = terms.counts(data[part[0] : part[-1]], part - part[0])
                own = votes(latent_vectors(weigh(counts, m["idf"]), m["axes"]), m)
                out.append(np.where(counts.any(axis=1), own, m["prior"]))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.clip(np.concatenate(out), 0, 1), pa.float64())],
                                             names=[*rows.schema.names, "score"])

    columns = ["doc_id", "text", *(c for c in keep if c not in ("doc_id", "text"))]
    chosen = docs.select(*columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema)
    scored = chosen.mapInArrow(score, f"{kinds}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), *(c for c in keep if c != "doc_id"))
