"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

A string is earlier in a document of smaller doc_id, or at an earlier start of
the same document. The operator sorts suffixes to a depth of ``LENGTH`` bytes,
one suffix bucket at a time (a difference-cover blockwise construction):

1. Bucket keys. Every start's string has one anchor: the fingerprint that is
   least among its ``GRAM``-byte grams. Equal strings have equal anchors at equal
   places, so the anchor names the suffix bucket. Runs of starts share an
   anchor. Anchors that occur once in the table end here: each block of
   documents settles repeats of its own and sends one key per document.
2. The runs whose anchor occurs again go to their bucket with the bytes they
   need; a block sends equal runs once, their later copies are settled there.
3. A bucket's suffixes are sorted in slices of bounded size. A difference
   cover of every ``PERIOD`` positions is ranked first (names of 32 bytes, pairs of
   names for 64). Suffixes are sorted by their first 32 bytes; longer ties are
   parted by a ternary quicksort over all ties at once, comparing the ranks at
   the cover position both suffixes share and the bytes after it. Equal
   suffixes form a class; all but the earliest are repeats.
4. Documents take back their repeated starts, and the covered bytes go.

A string in a third of all documents reaches its bucket once per block, so no
task gets it once per document. Texts travel once, by document; both joins use
that exchange.

Defined results: a null text is empty; texts shorter than ``LENGTH`` stay;
rows sharing a doc_id are compared by start alone, and equal rows get equal
results; null doc_ids come last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import code_of, column, key_buckets, repeated_codes
from .text import Fingerprints, blocks, ragged, text_arrays

LENGTH = 100
GRAM = 32
PERIOD = 32
#: Starts looked at together.
CHUNK = 1 << 18
#: Bytes of one slice of a bucket that is sorted at a time.
SLICE_BYTES = 2 << 20
LAST = 2**63 - 1


# --- difference cover -------------------------------------------------------

def difference_cover(v: int) -> list[int]:
    """A small set of residues whose differences are all residues modulo ``v`` (greedy)."""
    cover, missing = [0, 1], set(range(v)) - {0, 1, v - 1}
    while missing:
        best = max(range(v), key=lambda d: len({(d - c) % v for c in cover} & missing) + len({(c - d) % v for c in cover} & missing))
        missing -= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return sorted(cover)


def _shifts(cover: list[int], v: int) -> np.ndarray:
    """By difference x of two residues: a residue d of the cover with d + x also in it."""
    out = np.empty(v, np.int64)
    for x in range(v):
        out[x] = next(d for d in cover if (d + x) % v in cover)
    return out


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian integer."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(n, np.uint64)
    for j in range(8):
        part = out[j::8]
        part[:] = padded[j : j + 8 * len(part)].view(">u8")
    return out


def _numbered(order: np.ndarray, s: np.ndarray) -> np.ndarray:
    """By row the position of its value among the distinct ones, from 0; ``s`` are the values in ``order``."""
    new = np.zeros(len(order), bool)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    return _numbered(order, key[order])


def _pair_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks by two small numbers, at most that of the rows each."""
    bits = (len(a) + 1).bit_length()
    if 3 * bits > 63:
        return _ranks(a << 32 | b)
    packed = np.sort((a << 2 * bits) | (b << bits) | np.arange(len(a)))  # values and row: sorting them moves no index
    return _numbered(packed & ((1 << bits) - 1), packed >> bits)


def _names(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by their keys, equal rows alike; sorts of one integer are many times faster than one of several keys."""
    names = [_ranks(key) for key in keys]
    while len(names) > 1:  # neighbours make a pair: the order stays
        names = [_pair_ranks(a, b) for a, b in zip(names[::2], names[1::2])] + names[len(names) & ~1 :]
    return names[0]


class SuffixSorter:
    """Classes of equal ``LENGTH``-byte strings of a text, by difference-cover suffix sorting."""

    def __init__(self, length: int = LENGTH, period: int = PERIOD) -> None:
        if length < period + 64:
            raise ValueError("strings must be longer than the period and two names")
        self.length, self.period = length, period
        self.cover = np.array(difference_cover(period))
        self.shift = _shifts(self.cover.tolist(), period)

    def cover_ranks(self, data: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Rank of the 64 bytes at every cover position (others unset)."""
        n, v = len(data), self.period
        at = (np.arange(0, n, v)[:, None] + self.cover).ravel()
        at = at[at + 32 <= n]
        name = np.full(n + 64, -1, np.int64)
        if len(at):
            name[at] = _names(*(word[at + j] for j in (0, 8, 16, 24)))
            # the cover repeats every 32 bytes, so the next name is at a cover position too
            name[at] = _pair_ranks(name[at], name[at + 32] + 1)
        return name

    def classes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each start, a number that equal strings share; every start has ``length`` bytes after it."""
        word = _words(data)
        rank = self.cover_ranks(data, word)
        head = _names(*(word[starts + j] for j in (0, 8, 16, 24)))
        order = np.argsort(head)
        group = head[order]
        out = np.empty(len(starts), np.int64)
        active, serial = order, 0
        rng = np.random.default_rng(0)
        tails = [*range(64, self.length - 8, 8), self.length - 8]
        while len(active):
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.append(first, len(active)))
            number = np.repeat(np.arange(len(first)), size)
            pivot = active[first + (rng.random(len(first)) * size).astype(np.int64)][number]
            i, p = starts[active], starts[pivot]
            x = (self.shift[(p - i) % self.period] - i) % self.period
            a, b = rank[i + x], rank[p + x]
            sign = np.where(a < b, np.int8(-1), np.where(a > b, np.int8(1), np.int8(0)))
            tie = np.flatnonzero((sign == 0) & (i != p))
            for j in tails:
                if not len(tie):
                    break
                a, b = word[i[tie] + j], word[p[tie] + j]
                sign[tie[a < b]], sign[tie[a > b]] = -1, 1
                tie = tie[a == b]
            equal = sign == 0
            out[active[equal]] = serial + number[equal]
            serial += len(first)
            group = number[~equal] * 2 + (sign[~equal] > 0)
            active = active[~equal]
            by = np.argsort(group, kind="stable")
            active, group = active[by], group[by]
        return out


# --- anchors ----------------------------------------------------------------

def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    rest = width - size
    return np.minimum(key[:-rest], key[rest:]) if rest else key


def anchor_runs(prints: Fingerprints, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH,
                gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start, number of starts, anchor fingerprint) of the runs of starts with one anchor."""
    n, found = len(data), []
    low = np.uint64((1 << 20) - 1)
    for lo in range(0, max(0, n - length + 1), CHUNK):
        part = data[lo : lo + CHUNK + length - 1]
        grams = prints.grams(prints.prefix(part), gram)
        key = grams & ~low | np.arange(len(grams), dtype=np.uint64)
        at = (_sliding_min(key, length - gram + 1) & low).astype(np.int64)
        start = np.arange(lo, lo + len(at))
        first_doc, last_doc = np.searchsorted(offsets, [lo, lo + len(at) - 1], side="right") - 1
        near = offsets[first_doc : last_doc + 2]
        doc = first_doc + np.repeat(np.arange(len(near) - 1), np.diff(np.clip(near, lo, lo + len(at))))
        valid = start + length <= offsets[doc + 1]
        head = valid.copy()
        head[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        run = np.flatnonzero(head)
        if len(run):
            count = np.add.reduceat(valid, run).astype(np.int64)
            found.append((doc[run], start[run], count, grams[at[run]]))
    if not found:
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


# --- runs to buckets, repeats back ------------------------------------------

RUNS = "bucket long, id long, key long, start long, n long, ids binary, keys binary, starts binary, counts binary, anchors binary, bytes binary"


def bucket_runs(known: DataFrame, buckets: int, length: int) -> DataFrame:
    """Runs with a repeated anchor: packed per (block, bucket), or settled repeats (bucket null)."""
    def cut(batches):
        prints = Fingerprints()
        for rows, data, offsets in blocks(batches):
            doc, start, n, anchor = anchor_runs(prints, data, offsets, length)
            codes = column(rows, "codes")
            code = code_of(anchor, buckets)
            keep = np.zeros(len(doc), bool)
            first = np.searchsorted(doc, np.arange(rows.num_rows + 1))
            for d in range(rows.num_rows):
                lo, hi = first[d], first[d + 1]
                if hi > lo:
                    own = np.frombuffer(b"".join(codes[d].as_py()), "<u8")
                    keep[lo:hi] = np.isin(code[lo:hi], own)
            doc, start, n, anchor = doc[keep], start[keep], n[keep], anchor[keep]
            if not len(doc):
                continue
            ids, keys = column(rows, "id").to_numpy()[doc], column(rows, "key").to_numpy()[doc]
            place, size = start - offsets[doc], n + length - 1
            # equal runs of the block: the earliest is sent on, the later ones are repeats throughout
            print_ = prints.of(prints.prefix(data), start, start + size)
            order = np.lexsort((place, ids, print_))
            same = np.zeros(len(order), bool)
            raw = data.tobytes()
            lead = np.arange(len(order))
            for j in np.flatnonzero((print_[order][1:] == print_[order][:-1]) & (size[order][1:] == size[order][:-1])) + 1:
                a, b = order[lead[j - 1]], order[j]
                if raw[start[a] : start[a] + size[a]] == raw[start[b] : start[b] + size[b]]:
                    lead[j] = lead[j - 1]
                    same[j] = (ids[a], place[a]) != (ids[b], place[b])
            later = order[same]
            empty = pa.nulls(len(later), pa.binary())
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.nulls(len(later), pa.int64()), "id": pa.array(ids[later]), "key": pa.array(keys[later]),
                "start": pa.array(place[later]), "n": pa.array(n[later]), "ids": empty, "keys": empty, "starts": empty,
                "counts": empty, "anchors": empty, "bytes": empty})
            sent = order[~same]
            bucket = (anchor[sent] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            sent, bucket = sent[by], bucket[by]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            spans = list(zip(cuts.tolist(), np.append(cuts[1:], len(sent)).tolist()))
            none = pa.nulls(len(cuts), pa.int64())
            packed = lambda x, kind: pa.array([x[sent[a:b]].astype(kind).tobytes() for a, b in spans], pa.binary())
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(bucket[cuts]), "id": none, "key": none, "start": none, "n": none,
                "ids": packed(ids, "<i8"), "keys": packed(keys, "<i8"), "starts": packed(place, "<i8"), "counts": packed(n, "<i4"),
                "anchors": packed(anchor, "<u8"),
                "bytes": pa.array([data[ragged(start[sent[a:b]], size[sent[a:b]])].tobytes() for a, b in spans], pa.binary())})
    return known.select("id", "key", "text", "codes").mapInArrow(cut, RUNS)


def _spans(flag: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of runs of set flags; a run never crosses an edge."""
    head, tail = flag.copy(), flag.copy()
    head[1:] &= ~flag[:-1] | edge[1:]
    tail[:-1] &= ~flag[1:] | edge[1:]
    at = np.flatnonzero(head)
    return at, np.flatnonzero(tail) + 1 - at


def repeats_of(sorter: SuffixSorter, data: np.ndarray, at: np.ndarray, ids: np.ndarray, starts: np.ndarray,
               counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first start, number) of the starts whose string also starts earlier; run r has its bytes at ``at[r]``."""
    run = np.repeat(np.arange(len(at)), counts)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    cls = sorter.classes(data, at[run] + inner)
    own, place = ids[run], starts[run] + inner
    order = np.argsort(cls)
    c, o, p = cls[order], own[order], place[order]
    head = np.concatenate([[True], c[1:] != c[:-1]])
    at_head, number = np.flatnonzero(head), np.cumsum(head) - 1
    least = np.minimum.reduceat(o, at_head)[number]  # of its class: the smallest id, and the earliest start there
    early = np.minimum.reduceat(np.where(o == least, p, LAST), at_head)[number]
    again = np.zeros(len(run), bool)
    again[order] = (o != least) | (p != early)
    first, n = _spans(again, inner == 0)
    return run[first], place[first], n


def sort_buckets(runs: DataFrame, length: int) -> DataFrame:
    """(id, key, start, n): runs of starts whose string also starts earlier."""
    def sort(table: pa.Table) -> pa.Table:
        def gathered(name, kind):
            return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
        ids, keys, starts = (gathered(c, "<i8") for c in ("ids", "keys", "starts"))
        counts, anchors, data = gathered("counts", "<i4").astype(np.int64), gathered("anchors", "<u8"), gathered("bytes", np.uint8)
        size = counts + length - 1
        at = np.cumsum(size) - size
        sorter, out = SuffixSorter(length), []
        # one slice of whole anchors at a time
        order = np.argsort(anchors, kind="stable")
        ends = np.cumsum(size[order])
        lo = 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[order[lo]] + SLICE_BYTES, side="right")))
            while hi < len(order) and anchors[order[hi]] == anchors[order[hi - 1]]:
                hi += 1
            own = order[lo:hi]
            lo = hi
            if len(own) == 1 and counts[own[0]] == 1:
                continue
            text = data[ragged(at[own], size[own])]
            run, place, n = repeats_of(sorter, text, np.cumsum(size[own]) - size[own], ids[own], starts[own], counts[own])
            out.append((ids[own[run]], keys[own[run]], place, n))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 4
        return pa.table(dict(zip(("id", "key", "start", "n"), (pa.array(c, pa.int64()) for c in cols))))

    settled = runs.where("bucket IS NULL").select("id", "key", "start", "n")
    sorted_ = runs.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(sort, "id long, key long, start long, n long")
    return settled.unionByName(sorted_)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(table_start: np.ndarray, table_n: np.ndarray, n_bytes: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs [from, to) of a document."""
    order = np.argsort(table_start, kind="stable")
    lo, hi = table_start[order], np.maximum.accumulate(table_start[order] + table_n[order] - 1 + length)
    head = np.concatenate([[True], lo[1:] > hi[:-1]])
    first = np.flatnonzero(head)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes as ``text``)."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "text",
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    buckets = key_buckets(docs)
    def anchors(prints, data, offsets):
        doc, _, _, anchor = anchor_runs(prints, data, offsets, length)
        return doc, anchor

    codes = repeated_codes(base, buckets, anchors).groupBy("id", "key").agg(F.collect_set("codes").alias("codes"))
    known = base.join(codes.hint("merge"), ["id", "key"])
    found = sort_buckets(bucket_runs(known, buckets, length), length)
    again = found.groupBy("id", "key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))

    def finish(batches):
        for batch in batches:
            data, offsets = text_arrays(column(batch, "text"))
            ids, runs = column(batch, "id"), column(batch, "runs")
            raw, out = memoryview(data), []
            flat = runs.flatten()
            f_start, f_n = (flat.field(j).to_numpy() for j in range(2))
            cuts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(runs), 0).to_numpy())]).astype(np.int64)
            for d in range(batch.num_rows):
                text, sha, lost, spans, kept = raw[offsets[d] : offsets[d + 1]], hashlib.sha256(), 0, 0, []
                own = np.arange(cuts[d], cuts[d + 1])
                at = 0
                if len(own):
                    for a, b in zip(*(x.tolist() for x in _removed(f_start[own], f_n[own], len(text), length))):
                        sha.update(text[at:a])
                        kept.append(text[at:a])
                        at, lost, spans = b, lost + b - a, spans + 1
                sha.update(text[at:])
                kept.append(text[at:])
                i = ids[d].as_py()
                out.append((None if i == LAST else i, len(text), lost, spans, sha.hexdigest(), b"".join(kept) if with_text else b""))
            cols = list(zip(*out)) if out else [()] * 6
            fields = {"doc_id": pa.array(cols[0], pa.int64()), "n_bytes": pa.array(cols[1], pa.int64()), "n_removed": pa.array(cols[2], pa.int64()),
                      "n_spans": pa.array(cols[3], pa.int64()), "kept_sha256": pa.array(cols[4], pa.string())}
            if with_text:
                fields["text"] = pa.array(cols[5], pa.binary())
            yield pa.RecordBatch.from_pydict(fields)

    whole = base.join(again.hint("merge"), ["id", "key"], "left").select("id", "text", "runs")
    return whole.mapInArrow(finish, RESULT + (", text binary" if with_text else ""))
