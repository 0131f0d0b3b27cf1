"""SentencePiece encoding and decoding by a merge-type prefix table.

Byte-pair merging has a local form: of all tokens that end a prefix of a text,
just one can be the last token of that prefix's encoding, namely the longest
that is compatible with the last token of the prefix before it. So

1. an automaton over the pieces gives the tokens that end at each place;
2. the prefix table stores each prefix's last token: the first match, longest
   first, that passes the pair test with the table entry at its own start;
3. the ids are read backwards from the end of the text.

Pair test: two tokens are compatible if merging their characters never joins
them across the border. Each piece's own merges are replayed once when the
model is loaded and kept as steps (rank of the merge, symbol at the left edge,
symbol at the right edge). For a pair the two step lists are merged by rank;
the pair fails as soon as the symbols at the border would merge before the
next step of either side. Pieces that merging never forms are left out of the
automaton. Characters without a piece become byte tokens.

No piece holds a space mark after another character (checked when the model is
loaded), so a text falls into units of spaces and a word, and every distinct
unit of a block goes through the table once; a worker remembers up to
``UNIT_CACHE`` short units. If a model breaks that rule, the unit is the text.

Decoding looks pieces up, gathers runs of byte tokens into characters (a byte
that is not part of one becomes U+FFFD; control ids end a run), drops control ids, gives U+2047 in
spaces for the unknown id, and drops the one space put before the text.

The job is map-only: no shuffle, memory bounded by a block of ``BLOCK`` bytes
(one text, if longer) and the remembered units.

Defined results: a null text is empty; an empty text is the end id alone and
decodes to the empty text; repeated rows and null doc_ids are encoded each; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import blocks
from .units import Units, after_other_than_space

BLOCK = 4 << 20
UNIT_CACHE = 200_000
UNIT_BYTES = 64
PAIR_CACHE = 500_000
MARK = "▁"
NEVER = 1 << 60


class PieceModel:
    """A SentencePiece model of merge type (BPE) with byte fallback."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("the model must be of type BPE with byte fallback")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("the model must keep texts as they are, but for one space in front")
        kind = proto.ModelProto.SentencePiece
        self.kinds = [p.type for p in model.pieces]
        if kind.USER_DEFINED in self.kinds or kind.UNUSED in self.kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.names = [p.piece for p in model.pieces]
        self.control, self.unknown = kind.CONTROL, kind.UNKNOWN
        self.end_id = model.trainer_spec.eos_id
        self.byte_ids = {int(n[1:-1], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds)) if k == kind.BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        normal = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds)) if k == kind.NORMAL}
        self.by_word = not any(MARK in n.lstrip(MARK) for n in normal)

        # symbols: pieces, and the characters that only occur inside pieces
        self.symbols = dict(normal)
        self.base = len(self.names)
        self.lone: list[str] = []
        for c in sorted({c for n in normal for c in n} - normal.keys()):
            self.symbols[c] = self.base + len(self.lone)
            self.lone.append(c)
        self.width = self.base + len(self.lone)
        ranks = {s: r for r, s in enumerate(sorted({p.score for p in model.pieces}, reverse=True))}
        self.joined: dict[int, tuple[int, int]] = {}
        for name, i in normal.items():
            for k in range(1, len(name)):
                a, b = self.symbols.get(name[:k]), self.symbols.get(name[k:])
                if a is not None and b is not None:
                    self.joined[a * self.width + b] = (ranks[model.pieces[i].score], i)
        self.steps: dict[int, list[tuple[int, int, int]]] = {}
        self.length: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for name, i in self.symbols.items():
            steps, formed = self._replay(name)
            if formed:
                self.steps[i], self.length[i] = steps, len(name)
                self.automaton.add_word(name, (i, len(name)))
        if self.symbols:
            self.automaton.make_automaton()
        # by token, the tokens already tested after it
        self.fits: dict[int, dict[int, bool]] = {i: {} for i in self.steps}
        self.tested = 0
        # the text of ids that stand for themselves; None: bytes, control and unknown ids
        self.texts = [n.replace(MARK, " ") if k == kind.NORMAL else None for n, k in zip(self.names, self.kinds)]
        self.decimals = [str(i) for i in range(len(self.names))]

    def _replay(self, name: str) -> tuple[list[tuple[int, int, int]], bool]:
        """The edges of ``name`` before its first merge and after each, and whether one symbol is left.

        Every entry is (rank of the merge that comes next, left edge, right edge).
        """
        row = [self.symbols[c] for c in name]
        out = []
        while True:
            pairs = [(self.joined[a * self.width + b], k) for k, (a, b) in enumerate(zip(row, row[1:])) if a * self.width + b in self.joined]
            if not pairs:
                out.append((NEVER, row[0], row[-1]))
                return out, len(row) == 1
            (rank, made), k = min(pairs, key=lambda p: (p[0][0], p[1]))
            out.append((rank, row[0], row[-1]))
            row[k : k + 2] = [made]

    def compatible(self, one: int, two: int) -> bool:
        """Whether the characters of both tokens merge into just these two tokens."""
        left, right = self.steps[one], self.steps[two]
        i = j = 0
        while True:
            here, _, a = left[i]
            there, b, _ = right[j]
            across = self.joined.get(a * self.width + b, (NEVER, 0))[0]
            if across < here and across <= there:  # of equal ranks the leftmost merges first
                return False
            if here == there == NEVER:
                return True
            if here <= there:
                i += 1
            else:
                j += 1

    def encode_unit(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks already."""
        n, fits = len(text), self.fits
        last = [-1] * (n + 1)  # of each prefix; -1: none, or a character in no piece
        after: list[dict[int, bool] | None] = [None] * (n + 1)  # what is known to fit after that token
        if self.tested > PAIR_CACHE:
            for known in fits.values():
                known.clear()
            self.tested = 0
        for end, (token, size) in self.automaton.iter(text) if self.symbols else ():
            end += 1
            if after[end] is not None:
                continue
            known = after[end - size]
            if known is not None:
                ok = known.get(token)
                if ok is None:
                    ok = known[token] = self.compatible(last[end - size], token)
                    self.tested += 1
                if not ok:
                    continue
            last[end], after[end] = token, fits[token]
        length, base = self.length, self.base
        ids: list[int] = []
        while n:
            token = last[n]
            if 0 <= token < base:
                ids.append(token)
                n -= length[token]
            else:
                n -= 1
                ids.extend(self.byte_ids[b] for b in reversed(text[n].encode()))
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text with the end id."""
        return [*(self.encode_unit(MARK + text.replace(" ", MARK)) if text else ()), self.end_id]

    def surface(self, ids: Sequence[int]) -> str:
        """The text of ids, with the space in front."""
        plain = [self.texts[i] for i in ids]
        if None not in plain:
            return "".join(plain)
        out: list[bytes] = []
        run = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(whole_characters(run))
                run = bytearray()
            if self.kinds[i] == self.unknown:
                out.append(" ⁇ ".encode())
            elif self.kinds[i] != self.control:
                out.append(self.names[i].replace(MARK, " ").encode())
        if run:
            out.append(whole_characters(run))
        return b"".join(out).decode()

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        text = self.surface(ids)
        first = next((i for i in ids if self.kinds[i] != self.control), None)
        return text[1:] if first is not None and self.names[first].startswith(MARK) else text


def whole_characters(run: bytes | bytearray) -> bytes:
    """The bytes as UTF-8, with U+FFFD for each byte that is not part of a character."""
    run = bytes(run)
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            part = run[at : at + size]
            try:
                part.decode()
            except UnicodeDecodeError:
                continue
            out.append(part)
            at += len(part)
            break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


class UnitIds:
    """Ids of the distinct units of a block; short ones stay for later blocks of the worker."""

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        self.young: dict[bytes, list[int]] = {}
        self.old: dict[bytes, list[int]] = {}

    def cuts(self, data: np.ndarray) -> np.ndarray:
        return after_other_than_space(data) if self.model.by_word else np.zeros(len(data), bool)

    def of(self, unit: bytes) -> list[int]:
        ids = self.young.get(unit)
        if ids is not None:
            return ids
        ids = self.old.get(unit)
        if ids is None:
            ids = self.model.encode_unit(unit.decode().replace(" ", MARK))
        if len(unit) <= UNIT_BYTES:
            if len(self.young) >= UNIT_CACHE // 2:
                self.old, self.young = self.young, {}
            self.young[unit] = ids
        return ids


def worker_table(shared: dict, path: str) -> UnitIds:
    """One table per Python worker process and model."""
    if path not in shared:
        shared[path] = UnitIds(path)
    return shared[path]



def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): every text's ids with the end id."""
    shared = docs.sparkSession.sparkContext.broadcast({})

    def ids(batches):
        table = worker_table(shared.value, path)
        for rows, data, offsets in blocks(batches, BLOCK):
            units = Units(data, offsets, table.cuts)
            lists = [table.of(u) for u in units.distinct.to_pylist()]
            per_text = units.gather(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column(rows.schema.get_field_index("doc_id")),
                "ids": pa.array([[i for unit in text for i in unit] + [table.model.end_id] for text in per_text.to_pylist()], pa.list_(pa.int32()))})
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(ids, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids are no ids."""
    shared = coded.sparkSession.sparkContext.broadcast({})

    def texts(batches):
        table = worker_table(shared.value, path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "text": pa.array([table.model.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())})
    return coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(texts, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast({})

    def digests(batches):
        table = worker_table(shared.value, path)
        model = table.model
        decimals = model.decimals
        end = str(model.end_id)
        for rows, data, offsets in blocks(batches, BLOCK):
            units = Units(data, offsets, table.cuts)
            lists = [table.of(u) for u in units.distinct.to_pylist()]
            count = np.fromiter(map(len, lists), np.int64, len(lists))
            spelled = units.gather(pa.array([" ".join([decimals[i] for i in x]) for x in lists], pa.large_string()))
            surface = units.gather(pa.array([model.surface(x) for x in lists], pa.large_string()))
            spelled, surface = (pc.binary_join(x, pa.scalar(by, pa.large_string())) for x, by in ((spelled, " "), (surface, "")))
            ids_hash, text_hash = [], []
            for ids, text in zip(spelled, surface):
                ids, text = ids.as_py(), text.as_py()
                ids_hash.append(hashlib.sha256((f"{ids} {end}" if ids else end).encode()).hexdigest())
                text_hash.append(hashlib.sha256(text[1:].encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column(rows.schema.get_field_index("doc_id")), "n_tokens": pa.array(units.sums(count) + 1, pa.int64()),
                "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())})
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
