"""Language-model scoring by prediction by partial matching over bytes.

A text is read as its lower-case words with one blank between them and a line
end after the last. The model is a trie of byte contexts of up to ``ORDER``
bytes with the counts of what followed each in the training documents. A byte
is coded in the longest context of the trie; a context that has not seen it
escapes with the estimate q / 2n (q distinct symbols in n; each gives up half a count), and the next
shorter context leaves out the symbols the longer one has seen (exclusion),
down to equal chances for the bytes never seen. The code length is summed per
document, log10.

The chance of a byte depends on the ``ORDER`` bytes before it and itself, its
gram. So the model is worked out once for every distinct gram of all documents:

1. Blocks count their distinct grams, and one exchange adds them up (grams of
   held-out documents count 0). They grow with the corpus, and none is dropped.
2. Grams are dealt by the last three bytes of their context, so every context
   of three bytes or more meets all its suffixes in one place; a chunk of whole
   groups is turned into chances level by level (``Level``). A group has at
   most 2^24 grams. The contexts of up to two bytes have at most 2^24 grams in
   all and are broadcast.
3. Texts are scored block by block: the ``COMMON`` most frequent grams are
   broadcast, the other distinct grams of a block are joined with their chances
   by an exchange and come back to the block.

With a given ``trie`` the operator scores with that pretrained model instead.
Tasks turn the trie into a table of states: a state is the longest known
context, so many stretches of text are scored side by side, each warmed up by
the ``ORDER`` bytes before it.

Token counts for the base score: the ``FREQUENT`` most frequent training
tokens are broadcast; the others are joined by a shuffle.

Defined results: a null or empty text is the end token alone; a null doc_id is
not held out; repeated rows are scored (and learnt from) each; with no training
documents all bytes are equally likely; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import packed, unpacked
from .tables import written
from .text import Fingerprints, blocks, lower_ascii, ragged, word_prints

ORDER = 5
FREQUENT = 1 << 17
#: Grams whose chances are broadcast; the others are joined.
COMMON = 1 << 20
#: Bytes of a block that is scored at a time.
BLOCK = 2 << 20
#: Grams turned into chances at a time, beyond the group that is being read.
CHUNK = 1 << 20
BLANK, END = 0x20, 0x0A
#: Bytes scored in one stretch.
STRETCH = 256
#: Token code of the end of a text.
END_TOKEN = -1


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def stream(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): each document's lower-case words with blanks between and a line end."""
    low = lower_ascii(data)
    n = end - start + 1
    at = ragged(start, n)
    out = low[np.minimum(at, max(0, len(low) - 1))] if len(at) else np.empty(0, np.uint8)
    close = np.cumsum(n)
    out[close - 1] = BLANK
    words_in = np.diff(first)
    total = np.concatenate([[0], close])
    some = np.flatnonzero(words_in > 0)
    out[total[first[1:][some]] - 1] = END
    none = np.flatnonzero(words_in == 0)
    out = np.insert(out, total[first[none]], END) if len(none) else out
    return out, total[first] + np.concatenate([[0], np.cumsum(words_in == 0)])


def context_codes(text: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Per byte: the ``order`` bytes before it (line ends before a document) and itself, as one integer."""
    n = np.diff(at)
    padded = np.insert(text, np.repeat(at[:-1], order), END) if len(text) else text
    code = np.zeros(max(0, len(padded) - order), np.uint64)
    for j in range(order + 1):
        code = code << np.uint64(8) | padded[j : j + len(code)]
    # the windows that end inside a document's own bytes
    return code[ragged(at[:-1] + np.arange(len(n)) * order, n)]


def _folded(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[at], np.add.reduceat(count, at) if len(at) else count


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


class _Folder:
    """Counts by key, folded whenever ``most`` entries wait."""

    def __init__(self, most: int = 3_000_000) -> None:
        self.most, self.keys, self.counts, self.waiting = most, [], [], 0

    def add(self, key: np.ndarray, count: np.ndarray):
        self.keys.append(key)
        self.counts.append(count)
        self.waiting += len(key)
        if self.waiting > self.most:
            folded = self.fold()
            if len(folded[0]) > self.most // 2:
                return folded
            self.add(*folded)
        return None

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        out = _folded(self.keys, self.counts) if self.keys else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.keys, self.counts, self.waiting = [], [], 0
        return out


def gather(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, n): counts in the training documents of the context-and-byte grams of all documents (kind 0) and of tokens (kind 1)."""
    def emit(kind: int, key: np.ndarray, count: np.ndarray):
        key = key.view(np.int64) if key.dtype == np.uint64 else key
        for lo in range(0, len(key), 100_000):
            k = key[lo : lo + 100_000]
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(k), kind), pa.int32()), "key": pa.array(k, pa.int64()),
                                              "n": pa.array(count[lo : lo + 100_000], pa.int64())})

    def count(batches):
        prints, folders = Fingerprints(), (_Folder(), _Folder())
        for rows, data, offsets in blocks(batches):
            word, start, end, first = word_prints(prints, data, offsets)
            text, at = stream(data, offsets, start, end, first)
            out = np.asarray(rows.column(rows.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False), bool)
            codes, outside = context_codes(text, at, order), np.repeat(out, np.diff(at))
            unseen = np.unique(codes[outside])
            own = np.repeat(~out, np.diff(first))
            for kind, (values, counts) in ((0, _distinct(codes[~outside])), (0, (unseen, np.zeros(len(unseen), np.int64))),
                                           (1, _distinct(np.concatenate([word[own], np.full(int((~out).sum()), END_TOKEN, np.int64).view(np.uint64)])))):
                if full := folders[kind].add(values, counts):
                    yield from emit(kind, *full)
        for kind in (0, 1):
            yield from emit(kind, *folders[kind].fold())

    counted = docs.select(held_out().alias("held_out"), "text").mapInArrow(count, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Level:
    """Chances of the grams of one context length, from those one byte shorter.

    ``gram``: distinct and sorted, ``p``: chance of the last byte in the context
    of the others, ``after``: its chance after an escape from that context.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, up: Level | None) -> None:
        self.gram, self.n = gram, n.astype(np.float64)
        context = gram >> np.uint64(8)
        head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(gram) else np.empty(0, np.int64)
        width = np.diff(np.append(head, len(gram)))

        def whole(values: np.ndarray) -> np.ndarray:
            """Sums over a context, for each of its grams."""
            return np.repeat(np.add.reduceat(values, head), width) if len(gram) else values
        seen = self.n > 0
        self.total, self.symbols = whole(self.n), whole(seen.astype(np.float64))
        total = np.where(self.total > 0, self.total, 1)
        if up is None:
            self.after = 1.0 / np.maximum(1, 256 - self.symbols)
            shorter = self.after  # without any training text all bytes are equally likely
        else:
            at = np.searchsorted(up.gram, gram & np.uint64((1 << 8 * up.bytes) - 1))
            theirs, later, shorter = up.n[at], up.after[at], up.p[at]
            left = up.total[at] - whole(np.where(seen, theirs, 0.0))  # what the shorter context has seen beyond this one
            safe = np.where(left > 0, left, 1)
            new = up.symbols[at] - self.symbols
            self.after = np.where(left > 0, np.where(theirs > 0, (theirs - 0.5) / safe, new / 2 / safe * later), later)
        own = np.where(seen, (self.n - np.where(self.symbols < 256, 0.5, 0)) / total, self.symbols / 2 / total * self.after)
        self.p = np.where(self.total > 0, own, shorter)
        self.bytes = 1 if up is None else up.bytes + 1


def _shortened(gram: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the last ``size`` bytes of grams."""
    return _folded([gram & np.uint64((1 << 8 * size) - 1)], [n])


def levels(gram: np.ndarray, n: np.ndarray, sizes: range, up: Level | None) -> Level:
    """The level of the longest of ``sizes``, built from the shortest on; grams are whole groups of what ``up`` tells apart."""
    for size in sizes:
        up = Level(*_shortened(gram, n, size), up)
    return up


#: Bytes of the grams that are broadcast: contexts of up to two bytes.
SHORT = 3


def gram_chances(grams: DataFrame, order: int) -> DataFrame:
    """(key, n, logp): log10 of the chance of every gram."""
    spark = grams.sparkSession
    short = min(SHORT, order + 1)
    low = grams.groupBy(F.col("key").bitwiseAND((1 << 8 * short) - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    base = spark.sparkContext.broadcast(levels(low.column("key").to_numpy().astype(np.uint64), low.column("n").to_numpy(), range(1, short + 1), None))

    def chances(batches):
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def done(parts):
            tail, key, n = (np.concatenate(x) for x in zip(*parts))
            by_key = np.argsort(key)
            key, n = key[by_key], n[by_key]
            top = levels(key, n, range(short + 1, order + 2), base.value)
            logp = np.log10(top.p[np.searchsorted(top.gram, key)])
            for lo in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_pydict({"key": pa.array(key[lo : lo + 100_000].view(np.int64)), "n": pa.array(n[lo : lo + 100_000], pa.int64()),
                                                  "logp": pa.array(logp[lo : lo + 100_000])})
        for batch in batches:
            tail, key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            if held >= CHUNK and len(tail):  # a group that goes on is kept whole
                last = waiting[-1][0][-1]
                cut = int(np.searchsorted(tail, last, side="right"))
                if cut < len(tail):
                    yield from done([*waiting, (tail[:cut], key[:cut], n[:cut])])
                    waiting, held, tail, key, n = [], 0, tail[cut:], key[cut:], n[cut:]
            if len(tail):
                waiting.append((tail, key, n))
                held += len(tail)
        if waiting:
            yield from done(waiting)

    tail = F.shiftright("key", 8).bitwiseAND((1 << 8 * SHORT) - 1)
    dealt = grams.select(tail.alias("tail"), "key", "n").repartition("tail").sortWithinPartitions("tail")
    return written(dealt.mapInArrow(chances, "key long, n long, logp double"), "ppm-chances")


class Model:
    """State table of a trie: ``next`` state and log10 probability by (state, byte)."""

    def __init__(self, trie: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        kept: list[np.ndarray] = [np.zeros(1, np.int64)]
        for j in range(1, len(trie)):
            own = np.unique(trie[j][0])
            # a state must be reachable byte by byte: without its first or its last byte it is a state too
            own = own[np.isin(own >> 8, kept[j - 1]) & np.isin(own & ((1 << 8 * (j - 1)) - 1), kept[j - 1])]
            kept.append(own)
        base = np.cumsum([0, *map(len, kept)])
        size = int(base[-1])
        self.next = np.zeros((size, 256), np.uint16 if size <= 1 << 16 else np.int32)
        self.logp = np.empty((size, 256), np.float32)
        later = np.empty((size, 256), np.float32)  # chance of a byte after an escape from the state
        count = np.zeros((size, 256), np.float32)
        for j, (context, symbol, n) in enumerate(trie):
            if len(context):
                at = np.searchsorted(kept[j], context)
                ok = (at < len(kept[j])) & (kept[j][np.minimum(at, len(kept[j]) - 1)] == context)
                count[base[j] + at[ok], symbol[ok]] = n[ok]
        for j, own in enumerate(kept):
            lo, hi = base[j], base[j + 1]
            for a in range(lo, hi, 2048):
                b = min(a + 2048, hi)
                mine = count[a:b].astype(np.float64)
                seen, q = mine > 0, (mine > 0).sum(axis=1, keepdims=True)
                if j == 0:
                    after = np.full((1, 256), 1.0 / max(1, 256 - int(q[0, 0])))
                else:
                    up = base[j - 1] + np.searchsorted(kept[j - 1], own[a - lo : b - lo] & ((1 << 8 * (j - 1)) - 1))
                    self.next[a:b] = self.next[up]
                    theirs = count[up].astype(np.float64)
                    new = (theirs > 0).sum(axis=1, keepdims=True) - q
                    whole = np.where(seen, 0, theirs).sum(axis=1, keepdims=True)
                    safe = np.where(whole > 0, whole, 1)
                    after = np.where(whole > 0, np.where(theirs > 0, (theirs - 0.5) / safe, new / 2 / safe * later[up]), later[up])
                later[a:b] = after
                total = np.maximum(mine.sum(axis=1, keepdims=True), 0.5)
                with np.errstate(divide="ignore"):
                    p = np.where(seen, (mine - np.where(q < 256, 0.5, 0)) / total, np.where(q > 0, q / 2 / total, 1) * after)
                self.logp[a:b] = np.log10(p)
            if j + 1 < len(kept) and len(kept[j + 1]):
                child = kept[j + 1]
                self.next[lo + np.searchsorted(own, child >> 8), child & 255] = base[j + 1] + np.arange(len(child))
        self.order = len(trie) - 1

    def score(self, text: np.ndarray, at: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
        """log10 probability of each document's bytes."""
        n = np.diff(at)
        parts = -(-n // stretch)
        doc = np.repeat(np.arange(len(n)), parts)
        lo = at[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * stretch
        hi = np.minimum(lo + stretch, at[1:][doc])
        order = np.argsort(lo - hi, kind="stable")  # longest first: finished stretches drop off the end
        lo, length, owner = lo[order], (hi - lo)[order], doc[order]
        begin, total = at[:-1][owner], np.zeros(len(lo))
        state = np.zeros(len(lo), np.int64)
        flat_next, flat_logp = self.next.ravel(), self.logp.ravel()
        for back in range(self.order, 0, -1):
            place = lo - back
            byte = np.where(place >= begin, text[np.maximum(place, 0)], END)
            state = flat_next[state * 256 + byte].astype(np.int64)
        alive = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        for step, m in enumerate(alive.tolist()):
            cell = state[:m] * 256 + text[lo[:m] + step]
            total[:m] += flat_logp[cell]
            state[:m] = flat_next[cell]
        return np.bincount(owner, weights=total, minlength=len(n))


def _model(shared: dict) -> Model:
    if "model" not in shared:  # once per worker process
        shared["model"] = Model(shared["trie"])
    return shared["model"]


DOC = "block long, place long, doc_id long, held_out boolean, n_tokens long, known long, gain double, score double, rare array<long>, misses binary, codes array<long>"
DOC_COLUMNS = [c.split()[0] for c in DOC.split(", ")]
SCORED = "doc_id long, held_out boolean, n_tokens long, known long, gain double, score double, rare array<long>"


def _finished(chances: pa.Table, docs: pa.Table) -> pa.Table:
    """A block's documents with the chances of its joined grams added; ``chances`` has (slot, logp) of each."""
    slot = chances.column("slot").to_numpy()
    logp = np.zeros(int(slot.max(initial=-1)) + 1)
    logp[slot] = chances.column("logp").to_numpy()
    more = [float(logp[unpacked(m)].sum()) if m else 0.0 for m in docs.column("misses").to_pylist()]
    names = [c.split()[0] for c in SCORED.split(", ")]
    return pa.table({c: pa.array(docs.column(c).to_numpy() + np.array(more)) if c == "score" else docs.column(c) for c in names})


def score(docs: DataFrame, order: int = ORDER, frequent: int = FREQUENT, common: int = COMMON, trie: list | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    counts = written(gather(docs, order), "ppm-counts")
    tokens = counts.where("kind = 1").select("key", "n")
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    often = tokens.orderBy(F.desc("n"), "key").limit(frequent).toArrow().sort_by("key")
    known = spark.sparkContext.broadcast((often.column("key").to_numpy(), often.column("n").to_numpy()))
    shared = spark.sparkContext.broadcast({"trie": trie})
    if trie is None:
        chances = gram_chances(counts.where("kind = 0").select("key", "n"), order)
        top = chances.orderBy(F.desc("n"), "key").limit(common).select("key", "logp").toArrow().sort_by("key")
        spread = spark.sparkContext.broadcast((top.column("key").to_numpy().view(np.uint64), top.column("logp").to_numpy()))

    def tokens_of(word: np.ndarray, first: np.ndarray, n: int) -> dict:
        keys, n_of = known.value
        doc = np.concatenate([np.repeat(np.arange(n), np.diff(first)), np.arange(n)])
        token = np.concatenate([word.view(np.int64), np.full(n, END_TOKEN, np.int64)])
        value, back = np.unique(token, return_inverse=True)
        place = np.minimum(np.searchsorted(keys, value), max(0, len(keys) - 1))
        hit = keys[place] == value if len(keys) else np.zeros(len(value), bool)
        seen = np.where(hit, n_of[place] if len(keys) else 0, 0)
        rare = ~hit[back]
        order_ = np.lexsort((token[rare], doc[rare]))
        r_doc, r_token = doc[rare][order_], token[rare][order_]
        return {"n_tokens": pa.array(np.diff(first) + 1, pa.int64()),
                "known": pa.array(np.bincount(doc, weights=hit[back], minlength=n).astype(np.int64)),
                "gain": pa.array(np.bincount(doc, weights=np.log10(seen + 1.0)[back], minlength=n)),
                "rare": pa.ListArray.from_arrays(pa.array(np.searchsorted(r_doc, np.arange(n + 1)), pa.int32()), pa.array(r_token, pa.int64()))}

    def grams_of(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes | None], np.ndarray]:
        """Per document the sum over its broadcast grams and its other grams as slots, and the grams of the slots."""
        keys, logp = spread.value
        n = len(at) - 1
        value, back = np.unique(context_codes(text, at, order), return_inverse=True)
        place = np.minimum(np.searchsorted(keys, value), max(0, len(keys) - 1))
        hit = keys[place] == value if len(keys) else np.zeros(len(value), bool)
        logs = np.where(hit, logp[place], 0.0) if len(keys) else np.zeros(len(value))
        sums = np.bincount(np.repeat(np.arange(n), np.diff(at)), weights=logs[back], minlength=n)
        slot = np.where(hit, -1, np.cumsum(~hit) - 1)[back]
        missed = slot >= 0
        cuts = np.concatenate([[0], np.cumsum(missed)])[at]
        slot = slot[missed]
        return sums, [packed(slot[a:b]) if b > a else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], value[~hit]

    def run(batches):
        prints, task = Fingerprints(), TaskContext.get().partitionId()
        for k, (rows, data, offsets) in enumerate(blocks(batches, BLOCK)):
            word, start, end, first = word_prints(prints, data, offsets)
            text, at = stream(data, offsets, start, end, first)
            n, block = rows.num_rows, (task << 32) | k
            if trie is None:
                sums, misses, codes = grams_of(text, at)
            else:
                sums, misses, codes = _model(shared.value).score(text, at), [None] * n, np.empty(0, np.uint64)
            # the block's joined grams travel with its first document
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.full(n, len(codes))]), pa.int32()), pa.array(codes.view(np.int64)))
            made = tokens_of(word, first, n) | {
                "block": pa.array(np.full(n, block), pa.int64()), "place": pa.array(np.arange(n), pa.int64()), "score": pa.array(sums),
                "misses": pa.array(misses, pa.binary()), "codes": lists}
            made |= {c: rows.column(rows.schema.get_field_index(c)) for c in ("doc_id", "held_out")}
            yield pa.RecordBatch.from_pydict({c: made[c] for c in DOC_COLUMNS})

    scored = written(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, DOC), "ppm-blocks")
    if trie is None:
        asked = scored.where("size(codes) > 0").select(F.col("block").alias("of_block"), F.posexplode("codes").alias("slot", "key"))
        answers = asked.join(chances.select("key", "logp").hint("merge"), "key").select("of_block", "slot", "logp")
        scored = answers.groupBy("of_block").cogroup(scored.drop("codes", "place").groupBy("block")).applyInArrow(_finished, SCORED)
    else:
        scored = scored.select(*[c.split()[0] for c in SCORED.split(", ")])
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "ppm-scored")
    if total.v > frequent:
        # tokens outside the broadcast table: unseen ones have count 0 and add nothing, so an inner join is whole
        seldom = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("tf"))
        extra = (seldom.join(tokens, "key").groupBy("row")
                 .agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("rise")))
        scored = scored.drop("rare").join(extra, "row", "left")
    else:
        scored = scored.withColumns({"more": F.lit(0), "rise": F.lit(0.0)})
    size = total.n + total.v + 1
    return scored.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
                         F.lit(total.n).cast("long").alias("train_tokens"),
                         (F.col("gain") + F.coalesce("rise", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(size)))).alias("base_score"),
                         "score")
