"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents become ids of a public tokenizer plus one end id; those longer than a
sequence are cut into pieces. Pieces that fill a sequence stand alone; the rest
are laid out by length over range partitions and dealt in turn into demes of
about ``DEME`` pieces, so every deme has the same mix of lengths, and copies of
a row spread over all demes. A solution is a list of bins. Crossover injects well-filled bins of one parent into the other, drops
the bins that hold a duplicate, and puts the displaced pieces back by best fit,
longest first; mutation empties the worst bins. Each deme evolves on
``ISLANDS`` islands; after every epoch an island's elite migrates to the next
island of its deme, and the best elite wins. A deme that has as few bins as its
total length allows evolves on: its bins may still be filled better.

Ids are the tokenizer's own: the strings of its special tokens in a text become
their ids. A word's ids do not depend on the words around it, so each task tokenises the
distinct words of a block once and gathers the ids of whole texts from them.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; a null doc_id is packed like any other; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written
from .text import Fingerprints, blocks, ragged, words

SEQUENCE = 4096
END_ID = 1
DEME = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
OFFSPRING = 6
#: Words whose ids a task remembers between blocks.
WORD_CACHE = 1_000_000


class WordIds:
    """Token ids of whole texts, from the ids of their white-space-separated words.

    New words are encoded many at a time, with a control character that the
    block does not hold as a word between them; its id marks the borders. Ids
    of up to ``WORD_CACHE`` words stay for later blocks and tasks of a worker.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.prints = Fingerprints()
        self.known, self.start, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _encode(self, texts: list[str], raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, number of ids of each)."""
        mark = next((chr(c) for c in (1, 2, 3, 4, 5, 6, 7, 8) if bytes([c]) not in raw), None)
        own = self.tokenizer.encode(mark, add_special_tokens=False).ids if mark else []
        if len(own) != 1:  # no free mark: word by word
            lists = [e.ids for lo in range(0, len(texts), 4096) for e in
                     self.tokenizer.encode_batch_fast(texts[lo : lo + 4096], add_special_tokens=False)]
            return np.array([x for ids in lists for x in ids], np.uint32), np.array([len(x) for x in lists], np.int64)
        joined = [f" {mark} ".join([*texts[lo : lo + 512], ""]) for lo in range(0, len(texts), 512)]
        out = []
        for lo in range(0, len(joined), 16):
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined[lo : lo + 16], add_special_tokens=False)]
        ids = np.concatenate(out) if out else np.empty(0, np.uint32)
        border = ids == own[0]
        return ids[~border], np.diff(np.concatenate([[0], np.cumsum(~border)[border]]))

    def ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) per document, each closed by ``end_id``."""
        start, end, first = words(data, offsets)
        value, at, back = np.unique(self.prints.of(self.prints.prefix(data), start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, value)
        old = np.zeros(len(value), bool)
        inside = place < len(self.known)
        old[inside] = self.known[place[inside]] == value[inside]
        raw, new = data.tobytes(), np.flatnonzero(~old)
        fresh, n_fresh = self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist())], raw)
        flat = np.concatenate([self.flat, fresh])
        w_start, w_count = np.empty(len(value), np.int64), np.empty(len(value), np.int64)
        w_start[old], w_count[old] = self.start[place[old]], self.count[place[old]]
        w_start[new], w_count[new] = len(self.flat) + np.cumsum(n_fresh) - n_fresh, n_fresh
        if len(self.known) + len(new) <= WORD_CACHE:
            order = np.argsort(np.concatenate([self.known, value[new]]), kind="stable")
            self.known = np.concatenate([self.known, value[new]])[order]
            self.start = np.concatenate([self.start, w_start[new]])[order]
            self.count = np.concatenate([self.count, n_fresh])[order]
            self.flat = flat
        lengths = w_count[back]
        body = flat[ragged(w_start[back], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[first]  # ids before each document, without end ids
        n = len(offsets) - 1
        return np.insert(body, ends[1:], np.uint32(end_id)), ends + np.arange(n + 1)


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole documents, or pieces of ``sequence`` ids of longer ones."""
    shared = docs.sparkSession.sparkContext.broadcast({})

    def cut(batches):
        if "encoder" not in shared.value:  # once per worker process
            shared.value["encoder"] = WordIds(tokenizer)
        encoder = shared.value["encoder"]
        for rows, data, offsets in blocks(batches, 2 << 20):
            ids, at = encoder.ids(data, offsets, end_id)
            n = np.diff(at)
            count = -(-n // sequence)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * sequence
            length = np.minimum(sequence, n[doc] - start)
            raw, lo = memoryview(ids.astype("<u4")).cast("B"), at[doc] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column(rows.schema.get_field_index("doc_id")).take(pa.array(doc)),
                "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins by free space, for best fit."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]]) -> None:
        self.sizes, self.capacity, self.bins = sizes, capacity, bins
        self.free = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))

    def put(self, items: list[int]) -> list[list[int]]:
        """Best fit, longest first; returns the bins."""
        return self.put_in_turn(sorted(items, key=lambda i: -self.sizes[i]))

    def put_in_turn(self, items: list[int]) -> list[list[int]]:
        """Best fit in the order given; returns the bins."""
        sizes, free, bins = self.sizes, self.free, self.bins
        for i in items:
            k = bisect_left(free, (sizes[i], -1))
            if k < len(free):
                room, b = free.pop(k)
                bins[b].append(i)
            else:
                room, b = self.capacity, len(bins)
                bins.append([i])
            insort(free, (room - sizes[i], b))
        return bins


def fitness(sizes: list[int], capacity: int, bins: list[list[int]]) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean squared fill)."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(rng: np.random.Generator, sizes: list[int], capacity: int, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Whole well-filled bins of ``b`` enter ``a``; bins with a duplicate go, their other pieces are put back by best fit."""
    full = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    taken = [x for x in full[: max(1, len(full) // 2)] if rng.random() < 0.5]
    inside = {i for x in taken for i in x}
    kept, displaced = [], []
    for x in a:
        if inside.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in inside]
    return Bins(sizes, capacity, kept + [list(x) for x in taken]).put(displaced)


def mutate(rng: np.random.Generator, sizes: list[int], capacity: int, a: list[list[int]]) -> list[list[int]]:
    """Empty the worst bins and some others, and put their pieces back by best fit."""
    order = sorted(range(len(a)), key=lambda k: sum(sizes[i] for i in a[k]))
    out = set(order[: max(1, len(a) // 20)]) | set(rng.choice(len(a), max(1, len(a) // 20), replace=False).tolist())
    return Bins(sizes, capacity, [list(x) for k, x in enumerate(a) if k not in out]).put([i for k in out for i in a[k]])


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]],
           population: int = POPULATION, offspring: int = OFFSPRING) -> list[list[int]]:
    """Best packing after one epoch that starts from best-fit decreasing, shuffled best fits, the given elites and mutations."""
    rng = np.random.default_rng(seed)
    score = lambda x: (fitness(sizes, capacity, x), x)
    starts = [*elites, Bins(sizes, capacity, []).put(list(range(len(sizes))))]
    starts += [mutate(rng, sizes, capacity, starts[0]) for _ in range(population - max(1, len(elites)))]
    starts += [Bins(sizes, capacity, []).put_in_turn(rng.permutation(len(sizes)).tolist()) for _ in range(population - 1)]
    pool = sorted(map(score, starts), key=itemgetter(0), reverse=True)
    for _ in range(offspring + len(pool) - population):  # a larger pool has so many children more, and shrinks with them
        a, b = rng.choice(len(pool), 2, replace=False)
        child = crossover(rng, sizes, capacity, pool[a][1], pool[b][1])
        if rng.random() < 0.5:
            child = mutate(rng, sizes, capacity, child)
        pool = sorted([*pool, score(child)], key=itemgetter(0), reverse=True)[: max(population, len(pool) - 1)]
    return pool[0][1]


def _to_bins(which: np.ndarray) -> list[list[int]]:
    order = np.argsort(which, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(which[order])) + 1)]


def pack(parts: DataFrame, sequence: int = SEQUENCE, deme: int = DEME, islands: int = ISLANDS,
         epochs: int = EPOCHS, seed: int = 10) -> DataFrame:
    """``parts`` (with column ``length``) plus sequence_id and offset."""
    names = [c for c in ("doc_id", "piece", "ids_crc32") if c in parts.columns]
    # in order of length; the last key splits a row that has many copies over partitions
    # written first: finding the ranges reads the pieces once more, and they must not be tokenised again for it
    parts = written(parts, "pack-tokens")
    keyed = parts.withColumn("h", F.xxhash64(F.lit(seed), *names, "length")).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    keyed = keyed.repartitionByRange("length", "h", "salt").sortWithinPartitions("length", "h", "salt")
    parts = written(keyed.drop("salt").withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    short = parts.where(F.col("length") < sequence)
    demes = max(1, -(-short.count() // deme))
    # the place within the partition deals the rows in turn, from a start of the partition's own
    turn = F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) + F.shiftright("row", 33) * F.lit(0x9E3779B1)
    # a deme is one packed row; its pieces come in hash order
    groups = written(
        short.select(F.pmod(turn, F.lit(demes)).alias("deme"), "h", "length", "row")
        .groupBy("deme").agg(F.array_sort(F.collect_list(F.struct("h", "length", "row"))).alias("p"))
        .select("deme", F.transform("p", lambda x: x["length"]).alias("sizes"), F.transform("p", lambda x: x["row"]).alias("rows")), "pack-demes")

    def run(frames):
        for pdf in frames:
            for deme_, island, epoch, sizes, own, guest in zip(*(pdf[c] for c in ("deme", "island", "epoch", "sizes", "own", "guest"))):
                sizes = [int(x) for x in sizes]
                elites = [_to_bins(np.asarray(x)) for x in (own, guest) if x is not None]
                best = evolve(sizes, sequence, [seed, int(deme_), int(island), int(epoch)], elites)
                which = np.empty(len(sizes), np.int64)
                for k, b in enumerate(best):
                    which[b] = k
                n, fill = fitness(sizes, sequence, best)
                yield pd.DataFrame({"deme": [deme_], "island": [island], "bins": [which], "n": [n], "fill": [fill]})

    dealt = groups.select("deme", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    elite = None
    for epoch in range(epochs):
        rows = dealt.withColumn("epoch", F.lit(epoch))
        if elite is None:
            rows = rows.withColumn("own", F.lit(None).cast("array<long>")).withColumn("guest", F.lit(None).cast("array<long>"))
        else:  # ring: an island's elite is the guest of the next one
            guests = elite.select("deme", ((F.col("island") + 1) % islands).alias("island"), F.col("bins").alias("guest"))
            rows = rows.join(elite.select("deme", "island", F.col("bins").alias("own")), ["deme", "island"]).join(guests, ["deme", "island"])
        rows = rows.repartition(min(demes * islands, 4096), "deme", "island")
        elite = written(rows.mapInPandas(run, "deme long, island int, bins array<long>, n long, fill double"), f"pack-epoch{epoch}")
    best = elite.groupBy("deme").agg(F.max_by("bins", F.struct("n", "fill", "island")).alias("bins"))
    placed = groups.join(best, "deme").select("deme", F.explode(F.arrays_zip("rows", "sizes", "bins")).alias("p")).select(
        "deme", F.col("p.rows").alias("row"), F.col("p.sizes").alias("size"), F.col("p.bins").alias("bin"))
    inside = Window.partitionBy("deme", "bin").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("row", (F.col("deme") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"),
                           F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("offset"))
    alone = parts.where(F.col("length") >= sequence).select("row", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return parts.join(placed.unionByName(alone), "row").drop("row", "h")


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    return pack(pieces(docs, tokenizer, sequence), sequence)
