"""Mixing sources to target weights: a low-discrepancy schedule over equal-token blocks.

Slot i of the mix gets the golden-ratio point ``x_i = i * G mod 2^31``. The
point falls into one source's share of the cumulative weights. The slots of a
source are ranked; turn r takes the r-th block of that source's shuffled
documents, cyclically, until the source's target is met (its last block is
cut). The points are evenly spread over every prefix, so every prefix of the
schedule has about the target shares.

``schedule`` gives the slots with their source, turn, block and words; what a
document contributes (``mix``) is the sum over the slots that hold a part of
it, and ``mixed_documents`` lays every copy of a document out at the slot that
holds its first word, in the order of the slots.

Only the list of sources (one row each, the mix's specification) reaches the
driver. Documents stay distributed: their places in the shuffled order come
from sums per hash range, a running sum of those, and running sums inside a
range, so a source holding a third of all rows is spread over all tasks.

Defined results: a null text has size 0; documents of size 0 take nothing; a
null source is a source of its own, last in order; repeated rows are separate
documents; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

WORDS = r"[^\x20\x09-\x0D]+"
#: 2^31 over the golden ratio, odd: the step of the schedule's points.
GOLDEN = 1327217885
PERIOD = 1 << 31
#: Words of a block; the mix has one slot per block.
BLOCK_WORDS = 256
#: A source is taken at most this many times.
MAX_REPEAT = 3
#: log2 of the hash ranges a source is cut into for the distributed prefix sum.
RANGE_BITS = 12
#: Stands for a null doc_id where rows are matched; the text's hash still tells the two apart.
NO_ID = 2**63 - 1
#: Slots generated and ranked at a time.
CHUNK = 1 << 14


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3),
                   max_repeat: int = MAX_REPEAT) -> list[tuple[str | None, int, float]]:
    """(source, size, target), sources by code point with null last.

    Weights repeat along the list. Targets share the total size by weight and
    stop at ``max_repeat`` times their source's size; the excess is shared
    again by weight among the others until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped, target = sum(sizes.values()), set(), {}
    while len(capped) < len(names):
        free = [s for s in names if s not in capped]
        left = total - sum(max_repeat * sizes[s] for s in capped)
        unit = sum(weight[s] for s in free)
        target |= {s: left * weight[s] / unit for s in free}
        over = [s for s in free if target[s] > max_repeat * sizes[s]]
        if not over:
            break
        capped.update(over)
        target |= {s: float(max_repeat * sizes[s]) for s in over}
    return [(s, sizes[s], target[s]) for s in names]


def turns(spark, targets: list[tuple[str | None, int, float]], block_words: int) -> DataFrame:
    """(slot, place, turn): the schedule, up to the turns each source needs for its target.

    Slots are made in chunks that are ranked on their own; a running sum of the
    chunks' counts gives each source's rank at the chunk's start. The points
    leave a source at most a few slots short of its share; its missing turns
    follow at the end.
    """
    goal = np.array([t for _, _, t in targets])
    total = float(goal.sum())
    edges = np.floor(np.cumsum(goal) / max(total, 1.0) * PERIOD).astype(np.int64)
    n = int(-(-total // block_words))

    def deal(frames):
        for pdf in frames:
            for chunk in pdf["id"]:
                slot = np.arange(chunk * CHUNK, min(n, (chunk + 1) * CHUNK), dtype=np.int64)
                x = slot % PERIOD * GOLDEN % PERIOD
                place = np.minimum(np.searchsorted(edges, x, side="right"), len(edges) - 1)
                order = np.argsort(place, kind="stable")
                ranked = place[order]
                rank = np.empty(len(slot), np.int64)
                rank[order] = np.arange(len(slot)) - np.searchsorted(ranked, ranked)
                yield pd.DataFrame({"chunk": chunk, "slot": slot, "place": place, "rank": rank})

    dealt = spark.range(-(-n // CHUNK)).mapInPandas(deal, "chunk long, slot long, place long, rank long")
    counts = dealt.groupBy("chunk", "place").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("chunk", "place", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    # the planner takes generated rows for few: no broadcast of what grows with the slots
    ranked = dealt.join(base.hint("merge"), ["chunk", "place"]).select("slot", "place", (F.col("base") + F.col("rank")).alias("turn"))

    need = spark.createDataFrame(
        [(k, _need(size, goal, block_words)) for k, (_, size, goal) in enumerate(targets)], "place long, need long")
    have = counts.groupBy("place").agg(F.sum("n").alias("have"))
    late = (need.join(F.broadcast(have), "place", "left").withColumn("have", F.coalesce("have", F.lit(0)))
            .where("have < need")
            .select(F.lit(n).cast("long").alias("slot"), "place", F.explode(F.expr("sequence(have, need - 1)")).alias("turn")))
    return ranked.join(F.broadcast(need), "place").where("turn < need").drop("need").unionByName(late)


def _need(size: int, target: float, block_words: int) -> int:
    """Turns that make up ``target`` words: whole passes over the source, then blocks of one more."""
    words = round(target)
    if size == 0:
        return 0
    passes, rest = divmod(words, size)
    return passes * -(-size // block_words) + -(-rest // block_words)


def _laid_out(docs: DataFrame, seed: int) -> tuple[DataFrame, list[tuple[str | None, int, float]]]:
    """Every document's place in its source's shuffled order (``place``, ``at``: words before it), and the sources' targets."""
    spark = docs.sparkSession
    sized = written(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("h")), "mix-sizes")
    totals = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    targets = source_targets(totals)
    listed = spark.createDataFrame([(s, n, t, k) for k, (s, n, t) in enumerate(targets)],
                                   "source string, source_size long, target double, place long")

    rows = sized.join(listed.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rows = rows.withColumn("range", F.shiftrightunsigned("h", 64 - RANGE_BITS).cast("int"))
    ahead = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("place", "range").agg(F.sum("size").alias("n")).select(
        "place", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("place", "range").orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base.hint("merge"), ["place", "range"])
    return at.withColumn("at", F.col("base") + F.col("within")), targets


def _sizes(spark, targets: list[tuple[str | None, int, float]], block_words: int) -> DataFrame:
    return spark.createDataFrame([(k, s, -(-n // block_words), n, round(t)) for k, (s, n, t) in enumerate(targets)],
                                 "place long, source string, blocks long, words long, goal long")


def schedule(spark, targets: list[tuple[str | None, int, float]], block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, place, source, turn, block, words): what the mix takes, in order; a slot holds one block, its source's last one up to the target."""
    sizes = _sizes(spark, targets, block_words)
    slots = turns(spark, targets, block_words).join(F.broadcast(sizes.where("blocks > 0")), "place")  # one row per source
    block, whole = F.expr("turn % blocks"), F.expr(f"least({block_words}, words - (turn % blocks) * {block_words})")
    upto = F.expr(f"goal - (turn div blocks) * words - (turn % blocks) * {block_words}")
    return slots.select("slot", "place", "source", "turn", block.alias("block"), F.least(whole, upto).alias("words"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 8) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, text_key (hash of doc_id and text)."""
    at, targets = _laid_out(docs, seed)
    # a document's share of each block (place, block): words [lo, hi) of the block
    cut = at.where("size > 0").select("row", "place", "at", "size", F.explode(F.expr(
        f"sequence(at div {block_words}, (at + size - 1) div {block_words})")).alias("block")).select(
        "row", "place", "block",
        F.greatest(F.lit(0), F.col("at") - F.col("block") * block_words).alias("lo"),
        F.least(F.lit(block_words), F.col("at") + F.col("size") - F.col("block") * block_words).alias("hi"))
    used = schedule(docs.sparkSession, targets, block_words).groupBy("place", "block", F.col("words").alias("reach")).agg(F.count("*").alias("times"))
    taken = (cut.join(used.hint("merge"), ["place", "block"])
             .groupBy("row").agg(F.sum(F.expr("times * greatest(0, least(hi, reach) - lo)")).alias("taken")))
    return at.join(taken.hint("merge"), "row", "left").select(
        "doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("h").alias("text_key"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 8) -> DataFrame:
    """The mix itself, in slot order: every document as often as it is taken; the one at a source's target is cut after its last word taken.

    A copy of a document stands at the slot of its first word: its source's
    pass over the shuffled documents and its block there make the turn, and
    the schedule has the turn's slot. Rows lie in order of the slots over the
    partitions and within each.
    """
    spark = docs.sparkSession
    at, targets = _laid_out(docs, seed)
    sizes = _sizes(spark, targets, block_words).drop("source")
    passes = F.expr("IF(goal > at, (goal - at - 1) div words, -1)")  # the last pass that reaches the document's first word
    copies = at.where("size > 0").join(F.broadcast(sizes), "place").where(passes >= 0).select(
        F.col("doc_id").alias("mix_id"), F.col("h").alias("mix_key"), "place", "at", F.col("size").alias("mix_size"), "blocks", "words", "goal",
        F.explode(F.sequence(F.lit(0), passes)).alias("pass"))
    copies = copies.select("mix_id", "mix_key", "place", "at", "mix_size", F.expr(f"pass * blocks + at div {block_words}").alias("turn"),
                           F.expr("least(mix_size, goal - pass * words - at)").alias("mix_copy"))
    slots = schedule(spark, targets, block_words).select("place", "turn", F.col("slot").alias("mix_slot"))
    placed = copies.join(slots.hint("merge"), ["place", "turn"])
    # both sides meet on the same two columns, without nulls, so that one exchange of the texts serves to drop repeats and to join
    keyed = docs.withColumns({"mix_id": F.coalesce(F.col("doc_id"), F.lit(NO_ID)), "mix_text": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))})
    keyed = keyed.dropDuplicates(["mix_id", "mix_text"])
    placed = placed.select(F.coalesce("mix_id", F.lit(NO_ID)).alias("mix_id"), F.col("mix_key").alias("mix_text"), F.col("at").alias("mix_at"),
                           "mix_size", "mix_copy", "mix_slot")
    both = keyed.join(placed.hint("merge"), ["mix_id", "mix_text"])
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), 1, F.col("mix_copy").cast("int")), " ")
    ordered = both.withColumn("text", F.when(F.col("mix_copy") < F.col("mix_size"), cut).otherwise(F.col("text")))
    return ordered.repartitionByRange("mix_slot", "mix_at").sortWithinPartitions("mix_slot", "mix_at").select(*docs.columns)
