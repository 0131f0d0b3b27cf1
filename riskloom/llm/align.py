"""Cross-tokenizer alignment of two tokenizations by byte offsets, Arrow-native.

A is a byte-level BPE of the ``tokenizers`` library, B a model of the
``sentencepiece`` library. Both spell the bytes of a space and the text.

One pass over the documents, block by block, all steps on Arrow columns:

1. ids per unit as list columns; ``list_flatten`` and ``list_parent_indices``
   turn them into (unit, id) columns;
2. byte ends by a segmented cumulative sum: the running sum of the tokens'
   byte lengths less the sum before their unit;
3. an Acero hash join (full outer) on the keys (unit, end). Ends that both
   sides have close a group. In order of the ends, each row is one link: the
   stretch up to it lies in exactly one A and one B token, the next ones that
   end there or later (``fill_null_backward``);
4. ``Table.group_by`` counts the block's id pairs, weighted by how often their
   unit occurs. Spark merges these partial counts.

A unit is a run of spaces and a word: no token of either side goes beyond it
(checked on the two models; else the unit is the text), so its end is an end
of both sides, and groups and links of a text are those of its units. Distinct
units of a block are aligned once.

Counts come back by a join of each block's distinct pairs with the merged
counts, grouped by block: a block is bounded, and a frequent pair is one row a
block on the skew-splitting side of the join. The highest count of each B id
is broadcast; it has at most one row for each id of B's vocabulary. Blocks are
written to the shared folder once, so nothing is tokenised again.

Defined results: null and empty texts, and texts whose tokens do not spell the
space and the text again (they hold U+2581), have no tokens: zeros and an
empty ``groups_sha256``. Repeated rows and null doc_ids are aligned each; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import MARK, UNIT_BYTES
from .tables import written
from .text import blocks
from .units import Units, after_solid

BLOCK = 2 << 20
#: Blocks in one file of the written table; a reader holds a file's rows at once.
BLOCKS_A_FILE = 4
#: Units whose ids a worker remembers, for each of the two tokenizers.
UNIT_CACHE = 360_000
#: Per document, but for ``units`` (of all documents end to end), ``n_slots`` (per unit), ``slots`` (of all units), and ``pair`` and ``n`` (per pair).
BLOCK_TYPE = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
              "n_units array<long>, units binary, n_slots binary, slots binary, pair array<long>, n array<long>")
BLOCK_COLUMNS = [c.split()[0] for c in BLOCK_TYPE.split(", ")]
RESULT_TYPE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def packed(values: np.ndarray) -> bytes:
    """Small integers, byte plane after byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(n).astype(np.int64)


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Remembered:
    """Ids of distinct units, four bytes each; short ones stay for later blocks of the worker, the longest unused go first."""

    def __init__(self) -> None:
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encoded(self, units: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def of_all(self, units: list[bytes]) -> pa.LargeListArray:
        """The ids of each unit."""
        young, old = self.young, self.old
        out = list(map(young.get, units))
        new = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            ids = old.get(units[k])
            if ids is None:
                new.append(k)
            else:
                out[k] = young[units[k]] = ids
        for lo in range(0, len(new), 2048):
            part = new[lo : lo + 2048]
            lists = pa.array(self.encoded([units[k] for k in part]), pa.large_list(pa.uint32()))
            raw, at = lists.values.to_numpy().tobytes(), (lists.offsets.to_numpy() * 4).tolist()
            for k, begin, end in zip(part, at, at[1:]):
                ids = out[k] = raw[begin:end]
                if len(units[k]) <= UNIT_BYTES:
                    self.young[units[k]] = ids
            if len(self.young) >= UNIT_CACHE // 2:
                self.old, self.young = self.young, {}
        ends = np.cumsum(np.fromiter(map(len, out), np.int64, len(out))) // 4
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int64)), pa.array(np.frombuffer(b"".join(out), np.uint32).astype(np.int64)))


class ByteLevel(Remembered):
    """Ids of units by a byte-level BPE file, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        splits = said["pre_tokenizer"] or {}
        self.by_word = said["normalizer"] is None and splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space")
        letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for name, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in name)

    def encoded(self, units: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]


class Pieces(Remembered):
    """Ids of units by a SentencePiece model, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(self.library.get_piece_size())
        names = [self.library.id_to_piece(i) for i in every]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace(MARK, " ").encode() for i, n in zip(every, names)]
        self.by_word = not any(MARK in n.lstrip(MARK) for i, n in zip(every, names) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i)))
        mark = self.library.piece_to_id(MARK)
        self.space = [mark] if mark != self.library.unk_id() else [self.library.piece_to_id(f"<0x{b:02X}>") for b in MARK.encode()]

    def encoded(self, units: list[bytes]) -> list[list[int]]:
        """The library puts the first space before a text itself, but not before an empty one."""
        lists = self.library.encode([u[1:].decode() for u in units], num_threads=1)
        return [ids if len(u) > 1 else self.space for u, ids in zip(units, lists)]


class Side:
    """One tokenizer's bytes, lengths and decimal names by id."""

    def __init__(self, spelled: list[bytes]) -> None:
        self.spelled = pa.array(spelled, pa.large_binary())
        self.length = pc.binary_length(self.spelled).cast(pa.int64())
        self.names = pa.array([str(i) for i in range(len(spelled))], pa.large_string())


class Tokens:
    """One side's tokens of a list of units: flat ids, their units, byte ends and whether they spell the unit."""

    def __init__(self, column: pa.LargeListArray, side: Side, units: pa.Array) -> None:
        self.ids = pc.list_flatten(column)
        self.unit = pc.list_parent_indices(column)
        self.count = pc.list_value_length(column).cast(pa.int64())
        lengths = side.length.take(self.ids)
        running = pc.cumulative_sum(lengths)
        first = pa.array(np.concatenate([[0], np.cumsum(self.count.to_numpy(zero_copy_only=False))])[:-1].astype(np.int64))
        before = pa.concat_arrays([pa.array([0], pa.int64()), running]).take(first)
        self.end = pc.subtract(running, before.take(self.unit))
        spelled = pc.binary_join(pa.LargeListArray.from_arrays(column.offsets, side.spelled.take(self.ids)), pa.scalar(b"", pa.large_binary()))
        self.whole = pc.equal(spelled, units)

    def table(self, name: str) -> pa.Table:
        return pa.table({"unit": self.unit, "end": self.end, name: pa.array(np.arange(len(self.ids)))})


class Aligned:
    """Groups and links of a list of units."""

    def __init__(self, a_lists: pa.LargeListArray, b_lists: pa.LargeListArray, a_side: Side, b_side: Side, units: pa.Array) -> None:
        a, b = Tokens(a_lists, a_side, units), Tokens(b_lists, b_side, units)
        self.whole = pc.and_(a.whole, b.whole).to_numpy(zero_copy_only=False).astype(bool)
        if not self.whole.all():  # such units have no tokens; their texts are left out
            good, none = pa.array(self.whole), pa.scalar([], a_lists.type)
            a, b = (Tokens(pc.if_else(good, x, none), side, units) for x, side in ((a_lists, a_side), (b_lists, b_side)))
        self.n_a, self.n_b = a.count.to_numpy(zero_copy_only=False), b.count.to_numpy(zero_copy_only=False)
        ends = a.table("a").join(b.table("b"), ["unit", "end"], join_type="full outer", use_threads=False).combine_chunks()
        ends = ends.sort_by([("unit", "ascending"), ("end", "ascending")]).combine_chunks()
        column = {n: ends.column(n).combine_chunks() if isinstance(ends.column(n), pa.ChunkedArray) else ends.column(n) for n in ends.column_names}
        both = pc.and_(pc.is_valid(column["a"]), pc.is_valid(column["b"]))
        self.unit = column["unit"].to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(units)
        self.n_links = np.bincount(self.unit, minlength=n)
        common = both.to_numpy(zero_copy_only=False).astype(bool)
        self.n_groups = np.bincount(self.unit[common], minlength=n)
        self.a = a.ids.take(pc.fill_null_backward(column["a"])).to_numpy(zero_copy_only=False)
        self.b = b.ids.take(pc.fill_null_backward(column["b"])).to_numpy(zero_copy_only=False)
        sides = []
        for side, tokens, at in ((a_side, a, column["a"]), (b_side, b, column["b"])):
            close = np.concatenate([[0], at.filter(both).to_numpy(zero_copy_only=False).astype(np.int64) + 1]).astype(np.int64)
            sides.append(joined(close, side.names.take(tokens.ids), ","))
        groups = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string()))
        self.spelled = joined(np.concatenate([[0], np.cumsum(self.n_groups)]), groups, ";")


def joined(offsets: np.ndarray, values: pa.Array, by: str) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values), pa.scalar(by, pa.large_string()))


class Aligner:
    """Both tokenizers of a worker, and the work on one block."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_side, self.b_side = Side(self.a.bytes), Side(self.b.bytes)
        self.by_word = self.a.by_word and self.b.by_word

    def cuts(self, data: np.ndarray) -> np.ndarray:
        return after_solid(data) if self.by_word else np.zeros(len(data), bool)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> dict:
        """Per text the sizes and the digest of its groups, its units, the units' pairs, and the pairs' counts."""
        units = Units(data, offsets, self.cuts)
        names = units.distinct.to_pylist()
        aligned = Aligned(self.a.of_all(names), self.b.of_all(names), self.a_side, self.b_side, units.distinct)
        broken = units.sums((~aligned.whole).astype(np.int64)) > 0
        lengths = np.diff(units.first)
        used = np.repeat(~broken, lengths)
        weight = np.bincount(units.index[used], minlength=len(names))
        pair = (aligned.a.astype(np.int64) << 32) | aligned.b.astype(np.int64)
        links = pa.table({"pair": pair, "n": weight[aligned.unit]})
        counted = links.group_by("pair", use_threads=False).aggregate([("n", "sum")]).sort_by("pair")
        distinct = counted.column("pair").to_numpy()
        spelled = pc.binary_join(units.gather(aligned.spelled), pa.scalar(";", pa.large_string()))
        out = {name: np.where(broken, 0, units.sums(per_unit)) for name, per_unit in (
            ("n_a", aligned.n_a), ("n_b", aligned.n_b), ("n_groups", aligned.n_groups), ("n_links", aligned.n_links))}
        out["groups_sha256"] = ["" if bad or not n else hashlib.sha256(text.as_py().encode()).hexdigest()
                                for text, bad, n in zip(spelled, broken.tolist(), lengths.tolist())]
        out["n_units"] = np.where(broken, 0, lengths)
        out["units"], out["n_slots"], out["slots"] = packed(units.index[used]), packed(aligned.n_links), packed(np.searchsorted(distinct, pair))
        out["pair"], out["n"] = distinct, counted.column("n_sum").to_numpy()
        return out


def as_row(block: int, doc_id: pa.Array, found: dict) -> pa.RecordBatch:
    """The block as one row of lists."""
    def one(values, kind):
        values = values if isinstance(values, pa.Array) else pa.array(values, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = {"block": pa.array([block], pa.int64()), "doc_id": one(doc_id, pa.int64())}
    columns |= {c: one(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_units", "pair", "n")}
    columns |= {c: pa.array([found[c]], pa.binary()) for c in ("units", "n_slots", "slots")}
    columns["groups_sha256"] = one(found["groups_sha256"], pa.string())
    return pa.RecordBatch.from_pydict({c: columns[c] for c in BLOCK_COLUMNS})


def only(column: pa.ChunkedArray) -> pa.Array:
    """The items of the one list in a column."""
    return column.combine_chunks().flatten() if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in column.chunks])


def with_counts(counts: pa.Table, block: pa.Table) -> pa.Table:
    """The rows of one block's documents; ``counts`` has a row (slot, count, best) for each pair of the block."""
    n_pairs = len(only(block.column("pair")))
    total, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
    slot = counts.column("slot").to_numpy()
    total[slot], best[slot] = counts.column("count").to_numpy(), counts.column("best").to_numpy().astype(np.int64)

    def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        running, at = np.concatenate([[0], np.cumsum(values)]), np.concatenate([[0], np.cumsum(lengths)])
        return running[at[1:]] - running[at[:-1]]

    slots, n_slots, units = (unpacked(block.column(c)[0].as_py()) for c in ("slots", "n_slots", "units"))
    n_units = only(block.column("n_units")).to_numpy()
    columns = {c: only(block.column(c)) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    columns["n_best"], columns["count_sum"] = (pa.array(sums(sums(v[slots], n_slots)[units], n_units), pa.int64()) for v in (best, total))
    return pa.table(columns | {"groups_sha256": only(block.column("groups_sha256"))})


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per block of documents (``BLOCK_TYPE``)."""
    shared = docs.sparkSession.sparkContext.broadcast({})

    def align(batches):
        if "aligner" not in shared.value:  # once per worker process
            shared.value["aligner"] = Aligner(a_path, b_path)
        aligner = shared.value["aligner"]
        task = TaskContext.get().partitionId()
        for k, (rows, data, offsets) in enumerate(blocks(batches, BLOCK)):
            yield as_row((task << 32) | k, rows.column(rows.schema.get_field_index("doc_id")), aligner.block(data, offsets))
            pa.default_memory_pool().release_unused()
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(align, BLOCK_TYPE)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair of all documents, and whether no A id has more with the pair's B id."""
    counts = written(found.select(F.explode(F.arrays_zip("pair", "n")).alias("x")).groupBy("x.pair").agg(F.sum("x.n").alias("count")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("highest"))  # at most one row per id of B
    return counts.join(F.broadcast(highest), b_id == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``RESULT_TYPE`` per document."""
    found = written(aligned_blocks(docs, a_path, b_path), "aligned", maxRecordsPerFile=BLOCKS_A_FILE)
    own = found.select(F.col("block").alias("of_block"), F.posexplode("pair").alias("slot", "pair"))
    known = own.join(pair_counts(found).hint("merge"), "pair").select("of_block", "slot", "count", "best")
    return known.groupBy("of_block").cogroup(found.groupBy("block")).applyInArrow(with_counts, RESULT_TYPE)
