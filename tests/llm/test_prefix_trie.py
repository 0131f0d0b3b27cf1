"""The conversation trie against a plain rebuild of every conversation."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from riskloom.llm import prefix_trie


def frame(spark, rows):
    table = pa.table({
        "conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()),
        "role": pa.array([r[2] for r in rows], pa.string()), "text": pa.array([r[3] for r in rows], pa.string()),
        "depth": pa.array(["clash"] * len(rows), pa.string()), "at": pa.array(["clash"] * len(rows), pa.string()), "part": pa.array([None] * len(rows), pa.float64())})
    return spark.createDataFrame(table)


def by_hand(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(x)] for c, x in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = turns.get(c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), [])
        whole[c] = tuple(base[:h] + own[h:])
    nodes = defaultdict(list)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            nodes[x[:d]].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)

    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or int(not children[p])
        saved[p] = sum(saved[k] for k in children[p]) + (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, who in nodes.items():
        ends = ",".join(str(c) for c in sorted(who) if len(whole[c]) == len(p))
        out.append((min(who), len(p), min(nodes[p[:-1]]) if p else None, len(who), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def awkward():
    rng = random.Random(9)
    rows = [(None, 0, "user", "no conversation"), (7, None, "user", "first"), (7, 3, None, None), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 1, "user", ""),
            (-5, 0, "user", "minus"), (-105, 0, "user", "minus"), (-100, 0, "user", "base of minus"), (9_000_000_000, 0, "user", "far"), (9_000_000_001, 1, "a", "é😀")]
    rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice("abc")) for c in range(100, 400) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", "hot" if t < 3 else str(c % 3)) for c in range(1000, 1300) for t in range(rng.randrange(1, 7))]  # copies and one common start
    rows += [(500, t, "user", f"long {t % 5}") for t in range(700)] + [(501, t, "user", f"long {t % 5}") for t in range(650)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions", ["3", "61"])
def test_trie_equals_rebuilt_conversations(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # one conversation over many tasks
    try:
        rows = awkward()
        got = sorted((tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == by_hand(rows)


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0


def test_long_lists_of_ends_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 100)
    rows = [(c, 9, "user", "same") for c in range(2000, 2400)]
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()), key=str)
    assert got == by_hand(rows)


def test_colliding_fingerprints_are_found_and_done_again(spark, monkeypatch):
    """Multiplier 1 makes a prefix the sum of its turns, whatever their order."""
    monkeypatch.setattr(prefix_trie, "MULTIPLIERS", ((1, 1), *prefix_trie.MULTIPLIERS[1:]))
    rows = [(c, t, "user", "ab"[(t + c) % 2]) for c in range(300, 330) for t in range(8)]
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()), key=str)
    assert got == by_hand(rows)
    monkeypatch.setattr(prefix_trie, "MULTIPLIERS", ((1, 1),))
    with pytest.raises(prefix_trie.Collision):
        prefix_trie.prefix_trie(frame(spark, rows))


def test_turns_with_one_hash_are_compared(spark, monkeypatch):
    whole = prefix_trie.turn_hash
    monkeypatch.setattr(prefix_trie, "turn_hash", lambda tries, lane: whole(tries, lane) if tries else prefix_trie.F.lit(7).cast("long"))
    rows = [(c, t, "user", f"{c % 10} {t}") for c in range(300, 330) for t in range(7)]
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()), key=str)
    assert got == by_hand(rows)
