"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pyarrow as pa


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents() -> list[tuple]:
    rng = random.Random(5)
    shared = words(rng, 70)
    base = words(rng, 200)
    near = base.split()
    near[50] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, None, "en", "b"), (5, "", None, None),
        (6, "   \n\t ", "en", "a"), (7, f"{words(rng, 60)} {shared} {words(rng, 40)}", "en", "c"),
        (8, f"{words(rng, 30)}\n{shared} {words(rng, 90)}", "en", "c"), (9, words(rng, 3), "fr", "a"), (9, words(rng, 120), "fr", "a"),
        (10, base, "en", "a"), (10, base, "en", "a"), (None, f"{shared} {words(rng, 50)}", "en", None),
        (11, words(rng, 5000), "en", "a"), (12, "é" * 300 + " ü ß", "de", "b"), (13, "x" * 400, "en", "b"), (14, "x" * 350, "en", "b"),
        (15, shared.upper(), "en", "c"), (16, "Tief " * 200, "de", "b")]
    return rows


def frame(spark, rows=None):
    """The documents with more columns whose names the operators use inside."""
    rows = documents() if rows is None else rows
    table = pa.table({
        "doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()),
        "lang": pa.array([r[2] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string()),
        "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64()), "id": pa.array(["clash"] * len(rows), pa.string()),
        "key": pa.array(["clash"] * len(rows), pa.string()), "row": pa.array(["clash"] * len(rows), pa.string()),
        "score": pa.array([None] * len(rows), pa.float64()), "size": pa.array([7] * len(rows), pa.int64())})
    return spark.createDataFrame(table)
