"""Trie of rebuilt conversations by composable fingerprints, without rebuilt texts.

A rebuilt conversation is the head of its base conversation and the rest of
its own turns. A run of turns has the fingerprint (length, value); two runs
compose to (m + n, x * B^n + y) modulo a prime, an associative product with a
unit, and the product of a run less its head follows from both. So each stored
turn is hashed once, and the prefixes of all rebuilt conversations come from
products of base heads and own rests; their turns are references (conversation,
position) to stored ones.

1. Turns are range-partitioned by conversation and turn, so one conversation may
   span many tasks. A task streams its rows and writes running products; what
   enters a task from earlier ones is composed from one row per task.
2. Every conversation and depth is one narrow row (node key = depth and
   fingerprint; one reference to its last turn). Rows grow with the turns.
3. Nodes are groups of these rows. Where a node's rows refer to different
   stored turns, those turns are fetched by reference and compared; equal
   parents and equal last turns make equal prefixes by induction. Should two
   different ones meet, all is done again with other multipliers and salts.
4. A node is named by its smallest member. The nodes of one name form a chain
   down to that conversation's end, so sums over subtrees need no walk: a
   node's subtree holds the rest of its own chain and the whole chains of its
   other members. The first comes from a running sum along chains, the second
   from one grouping of the narrow rows.
5. Digests of ends: sorted ids are joined into chunks by range partitions, and
   one pass per node streams its chunks in order, so a node where a third of
   all conversations end is never held.

Defined results: turns are ordered by turn (null first), ties by role and
text; null roles and texts are empty; repeated rows are turns each. Rows
without a conv_id belong to no conversation. ``c - c % 100`` takes the sign of
``c`` as SQL does. An empty table gives no rows. Other columns are ignored.
Rows of one conversation that agree in turn, role and the first 64 characters
of the text are sorted in one task, spilling to disk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import ScanSpec, prefix_scan
from .tables import written

PRIME = (1 << 61) - 1
#: Pairs of multipliers; the pair of a later try also salts the turns' hashes.
MULTIPLIERS = ((1234567890123456789, 987654321987654321), (1162261467112358132, 1729840517302911677), (2007286318273645901, 1384750293847561029))
LONGEST_HEAD = 5
GROUP = 100
CHUNK = 64 << 10
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "f1", "f2"]


class Collision(Exception):
    """Different turns or prefixes with one fingerprint."""


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return (F.crc32(conv_id.cast("string")) % (LONGEST_HEAD + 1)).cast("int")


def turn_hash(tries: int, lane: int) -> Column:
    return F.xxhash64(F.lit(f"{tries}-{lane}"), "role", F.lit("|"), "text").bitwiseAND(F.lit(PRIME))


def scanned_turns(conversations: DataFrame, tries: int) -> DataFrame:
    """(part, seq, conv_id, at, v1, v2, t1, t2, size, role, text): positions and running products within each task's rows."""
    bases = MULTIPLIERS[tries]
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))

    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    key = [F.col("conv_id"), F.col("turn").asc_nulls_first()]
    rows = rows.repartitionByRange(*key, F.substring("role", 1, 64), F.substring("text", 1, 64)).sortWithinPartitions(*key, "role", "text")
    rows = rows.select("conv_id", turn_hash(tries, 1).alias("t1"), turn_hash(tries, 2).alias("t2"), F.length("text").cast("long").alias("size"), "role", "text")

    def scan(batches):
        part, seq = TaskContext.get().partitionId(), 0
        conv, n, v1, v2 = None, 0, 0, 0
        for batch in batches:
            at, one, two = [], [], []
            for c, t1, t2 in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if c != conv:
                    conv, n, v1, v2 = c, 0, 0, 0
                n, v1, v2 = n + 1, (v1 * bases[0] + t1) % PRIME, (v2 * bases[1] + t2) % PRIME
                at.append(n)
                one.append(v1)
                two.append(v2)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, part, np.int32)), pa.array(np.arange(seq, seq + rows)), batch.column(0), pa.array(at, pa.int64()), pa.array(one, pa.int64()),
                 pa.array(two, pa.int64()), *(batch.column(k) for k in range(1, 6))],
                ["part", "seq", "conv_id", "at", "v1", "v2", "t1", "t2", "size", "role", "text"])
            seq += rows
    return written(rows.mapInArrow(scan, "part int, seq long, conv_id long, at long, v1 long, v2 long, t1 long, t2 long, size long, role string, text string"), "turns")


def carries(scanned: DataFrame, tries: int) -> dict[int, tuple[int, int, int, int]]:
    """By task, the conversation that goes on from earlier tasks and its (length, v1, v2) so far: at most one entry a task."""
    edges = scanned.groupBy("part").agg(F.min_by("conv_id", "seq").alias("first"), F.max_by(F.struct("conv_id", "at", "v1", "v2"), "seq").alias("last")).collect()
    out, conv, length, value = {}, None, 0, (0, 0)
    for row in sorted(edges, key=lambda r: r.part):
        last = row["last"]
        if row["first"] == conv:
            out[row.part] = (conv, length, *value)
        on = last.conv_id == conv
        value = tuple((v * pow(b, last["at"], PRIME) * on + x) % PRIME for v, b, x in zip(value, MULTIPLIERS[tries], (last.v1, last.v2)))
        conv, length = last.conv_id, last["at"] + on * length
    return out


def whole_products(scanned: DataFrame, before: dict, tries: int, more: tuple[str, ...]) -> DataFrame:
    """``scanned`` with positions and products from the conversation's first turn on."""
    columns = ["part", "conv_id", "at", "v1", "v2", *more]
    kinds = {f.name: f.dataType.simpleString() for f in scanned.schema}

    def carry(batches):
        for batch in batches:
            part, conv = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at, v1, v2 = (batch.column(k).to_numpy().copy() for k in (2, 3, 4))
            for k in np.flatnonzero(np.isin(part, list(before))).tolist():
                c, n, x, y = before[int(part[k])]
                if c == conv[k]:
                    steps = int(at[k])
                    v1[k] = (x * pow(MULTIPLIERS[tries][0], steps, PRIME) + int(v1[k])) % PRIME
                    v2[k] = (y * pow(MULTIPLIERS[tries][1], steps, PRIME) + int(v2[k])) % PRIME
                    at[k] += n
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at), pa.array(v1), pa.array(v2), *(batch.column(k) for k in range(5, len(columns)))], columns[1:])
    return scanned.select(*columns).mapInArrow(carry, ", ".join(f"{c} {kinds[c]}" for c in columns[1:]))


def memberships(turns: DataFrame, tries: int) -> DataFrame:
    """One row per conversation and depth: node key, parent's key, last turn's hash, size and reference, rebuilt length ``total``."""
    bases, inverses = MULTIPLIERS[tries], [pow(b, -1, PRIME) for b in MULTIPLIERS[tries]]
    own = turns.groupBy("conv_id").agg(
        F.max("at").alias("n_own"), F.max(F.when(F.col("at") == head_turns(F.col("conv_id")), F.struct("v1", "v2"))).alias("cut"))
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("at") <= LONGEST_HEAD)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("at", "v1", "v2", "t1", "t2", "size"))).alias("head"))  # five turns at most
    convs = own.withColumn("h", head_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")))
    convs = convs.withColumn("n_head", F.size("head")).withColumn("total", F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    convs = written(convs, "conversations")
    nothing = F.lit(0).cast("long")
    root = convs.select("conv_id", "total", nothing.alias("depth"), nothing.alias("f1"), nothing.alias("f2"), nothing.alias("t1"), nothing.alias("t2"),
                        nothing.alias("size"), F.lit(None).cast("long").alias("ref_conv"), F.lit(None).cast("long").alias("ref_at"))
    taken = convs.select("conv_id", "total", "base", F.explode("head").alias("x")).select(
        "conv_id", "total", F.col("x.at").alias("depth"), F.col("x.v1").alias("f1"), F.col("x.v2").alias("f2"), "x.t1", "x.t2", "x.size",
        F.col("base").alias("ref_conv"), F.col("x.at").alias("ref_at"))
    last = F.try_element_at("head", F.lit(-1))
    rest = convs.where("n_own > h").select(
        "conv_id", "total", "h", "n_head", *(F.coalesce(last[v], nothing).alias(f"head_{v}") for v in ("v1", "v2")),
        *(F.coalesce(F.col("cut")[v], nothing).alias(f"cut_{v}") for v in ("v1", "v2")))
    rest = turns.join(rest, "conv_id").where("at > h").select(
        "conv_id", "total", (F.col("n_head") + F.col("at") - F.col("h")).alias("depth"), "v1", "v2", "t1", "t2", "size", F.col("conv_id").alias("ref_conv"),
        F.col("at").alias("ref_at"), (F.col("at") - F.col("h")).alias("steps"), "head_v1", "head_v2", "cut_v1", "cut_v2")
    columns = root.columns

    def compose(batches):
        """Base head times own rest: the own head's product is taken out of the running product."""
        for batch in batches:
            part = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            steps = part["steps"].to_pylist()
            made = {}
            for lane, base in enumerate(bases, 1):
                made[f"f{lane}"] = pa.array([((x - y) * pow(base, n, PRIME) + v) % PRIME for x, y, n, v in zip(
                    part[f"head_v{lane}"].to_pylist(), part[f"cut_v{lane}"].to_pylist(), steps, part[f"v{lane}"].to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([made.get(c, part.get(c)) for c in columns], columns)

    def parents(batches):
        for batch in batches:
            part = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            up = [pa.array([(f - t) * inverse % PRIME for f, t in zip(part[f"f{lane}"].to_pylist(), part[f"t{lane}"].to_pylist())], pa.int64())
                  for lane, inverse in enumerate(inverses, 1)]
            yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), *up], [*columns, "p1", "p2"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in root.schema)
    everyone = root.select(*columns).unionByName(taken).unionByName(rest.mapInArrow(compose, schema))
    return written(everyone.mapInArrow(parents, f"{schema}, p1 long, p2 long"), "memberships")


def verified(nodes: DataFrame, members: DataFrame, turns: DataFrame) -> None:
    """Raises ``Collision`` unless all rows of each node have one parent and equal last turns."""
    if not nodes.where("NOT alike").isEmpty():
        raise Collision("two prefixes share a fingerprint")
    several = nodes.where("first_ref <> last_ref").select(*NODE, "first_ref")
    refs = members.join(several, NODE).select("first_ref", F.col("ref_conv").alias("conv_id"), F.col("ref_at").alias("at")).distinct()
    compared = refs.join(turns, ["conv_id", "at"]).groupBy("first_ref").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("role", "text") for f in (F.min, F.max)))
    if not compared.where("min_role <> max_role OR min_text <> max_text").isEmpty():
        raise Collision("two turns share a hash")


def grouped(members: DataFrame) -> DataFrame:
    """One row per node: smallest member, members, its last turn's size, and what ``verified`` needs."""
    ref = F.struct("ref_conv", "ref_at")
    alike = [F.min(c) == F.max(c) for c in ("p1", "p2", "t1", "t2", "size")]
    nodes = members.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("total").alias("deepest"), F.min(F.struct("conv_id", "total")).alias("own"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("size").alias("size"), F.min(ref).alias("first_ref"), F.max(ref).alias("last_ref"),
        (alike[0] & alike[1] & alike[2] & alike[3] & alike[4]).alias("alike"))
    return written(nodes.withColumn("own_total", F.col("own.total")).drop("own"), "nodes")


def end_digests(members: DataFrame) -> DataFrame:
    """(node key, ends_sha256) of the nodes where conversations end."""
    ends = members.where("depth = total").select(*NODE, "conv_id").repartitionByRange("f1", "f2", "depth", "conv_id").sortWithinPartitions("f1", "f2", "depth", "conv_id")

    def chunks(batches):
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            out, lo = [], 0
            while lo < len(rows):
                hi = lo
                while hi < len(rows) and rows[hi][:3] == rows[lo][:3] and hi - lo < CHUNK // 20:  # a decimal and its comma take at most 21 bytes
                    hi += 1
                out.append((*rows[lo], ",".join(str(r[3]) for r in rows[lo:hi])))
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k == 4 else pa.int64()) for k, x in enumerate(zip(*out) if out else [[]] * 5)], [*NODE, "first", "ids"])

    def digest(batches):
        node, sha = None, None

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([sha.hexdigest()])], [*NODE, "ends_sha256"])
        for batch in batches:
            for *key, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if key == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        yield row()
                    node, sha = key, hashlib.sha256()
                sha.update(ids.encode())
        if node is not None:
            yield row()
    joined = ends.mapInArrow(chunks, "depth long, f1 long, f2 long, first long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "depth long, f1 long, f2 long, ends_sha256 string")


def described(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """The trie's rows."""
    weighed = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("size")).withColumn("childless", (F.col("deepest") == F.col("depth")).cast("long"))
    chains = weighed.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("chain_saved"), F.max("childless").alias("chain_leaf"))
    below = members.select(*NODE, "conv_id").join(chains.hint("merge"), "conv_id").groupBy(*NODE).agg(
        F.sum("chain_saved").alias("all_saved"), F.sum("chain_leaf").alias("n_leaves"), F.sum((F.col("top") == F.col("depth") + 1).cast("long")).alias("branches"))
    placed = prefix_scan(weighed.select(*NODE, "conv_id", "saved"), ["conv_id"], ["depth"], ScanSpec(count_as="place", sums={"saved_above": "saved"}))
    placed = placed.select(*NODE, "place", "saved_above")
    full = written(weighed.join(below, NODE).join(placed, NODE).join(end_digests(members), NODE, "left").select(
        "conv_id", *NODE, "p1", "p2", "place", "n_convs", (F.col("branches") + (F.col("own_total") > F.col("depth")).cast("long")).alias("n_children"), "n_leaves",
        (F.col("all_saved") - F.col("saved_above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")), "trie")
    names = full.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"))
    tops = full.where("place = 0").join(names, ["depth", "p1", "p2"], "left")
    inner = full.where("place > 0").withColumn("parent_conv_id", F.col("conv_id"))
    return tops.unionByName(inner).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    for tries in range(len(MULTIPLIERS)):
        scanned = scanned_turns(conversations, tries)
        before = carries(scanned, tries)
        turns = written(whole_products(scanned, before, tries, ("t1", "t2", "size")), "turn-products")
        members = memberships(turns, tries)
        nodes = grouped(members)
        try:
            verified(nodes, members, whole_products(scanned, before, tries, ("role", "text")))
        except Collision:
            if tries + 1 == len(MULTIPLIERS):
                raise
            continue
        return described(nodes, members)
    raise AssertionError("no multipliers")
