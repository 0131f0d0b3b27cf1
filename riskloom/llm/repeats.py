"""Which keys of a document occur elsewhere: the shared first step of the repeat finders."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .tables import parts, size_in_bytes
from .text import Fingerprints, blocks, mix64

#: Key buckets at least; more with the size of the texts, so that a bucket fits a task.
BUCKETS = 64
BUCKET_BYTES = 32 << 20


def key_buckets(docs: DataFrame) -> int:
    return max(BUCKETS, parts(docs.sparkSession, 2 * size_in_bytes(docs.select("text")), BUCKET_BYTES))


def code_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """(bucket, 32 bits) of a key in one integer: what tells keys apart while they are counted."""
    return (key & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) << np.uint64(32) | key >> np.uint64(32)


def column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def repeated_codes(docs: DataFrame, buckets: int, keys_of: Callable) -> DataFrame:
    """(id, key, codes): per document, packed codes of its keys that occur elsewhere too.

    A document is (id, key), its doc_id and the hash of its text: rows that share
    a doc_id (or have none) are never gathered, and copies of a row are one document.

    ``keys_of(prints, data, offsets)`` gives (document, 64-bit key) pairs of a
    block. Keys that repeat inside a block are settled there, and the key's
    bucket gets one mark for the whole block; only a key that is single in its
    block travels with its document. So a key found in a third of all documents
    reaches its bucket once per block.
    """
    def count(batches):
        prints = Fingerprints()
        for rows, data, offsets in blocks(batches):
            doc, key64 = keys_of(prints, data, offsets)
            if not len(doc):
                continue
            ids, texts = column(rows, "id").to_numpy(), column(rows, "key").to_numpy()
            code = code_of(key64, buckets)
            order = np.lexsort((doc, code))
            code, doc = code[order], doc[order]
            new = np.concatenate([[True], code[1:] != code[:-1]])
            first = np.flatnonzero(new)
            often = np.diff(np.append(first, len(code))) > 1
            # repeats inside the block are settled here; the bucket only learns of the key
            again = np.repeat(often, np.diff(np.append(first, len(code))))
            yield from _by_document(ids[doc[again]], texts[doc[again]], code[again])
            key, owner, text = code[first], ids[doc[first]], texts[doc[first]]
            bucket = (key >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            small, whole = (key & np.uint64(0xFFFFFFFF)).astype("<u4"), np.stack([owner, text], axis=1).astype("<i8")
            single = ~often
            spans = list(zip(cuts.tolist(), np.append(cuts[1:], len(key)).tolist()))
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(bucket[cuts], pa.int64()), "id": pa.nulls(len(cuts), pa.int64()),
                "key": pa.nulls(len(cuts), pa.int64()),
                "keys": pa.array([np.concatenate([small[a:b][single[a:b]], small[a:b][~single[a:b]]]).tobytes() for a, b in spans], pa.binary()),
                "owners": pa.array([whole[a:b][single[a:b]].tobytes() for a, b in spans], pa.binary())})

    def _by_document(ids, texts, code):
        order = np.lexsort((code, texts, ids))
        ids, texts, code = ids[order], texts[order], code[order]
        other = (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])
        keep = np.concatenate([[True], other | (code[1:] != code[:-1])])[: len(ids)]
        ids, texts, code = ids[keep], texts[keep], code[keep]
        other = (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])
        cuts = np.flatnonzero(np.concatenate([[True], other])) if len(ids) else np.empty(0, np.int64)
        ends = np.append(cuts[1:], len(ids))
        # what is settled passes through any bucket as it is
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array((mix64(texts[cuts].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)), "id": pa.array(ids[cuts], pa.int64()),
            "key": pa.array(texts[cuts], pa.int64()),
            "keys": pa.array([code[a:b].astype("<u8").tobytes() for a, b in zip(cuts.tolist(), ends.tolist())], pa.binary()),
            "owners": pa.nulls(len(cuts), pa.binary())})

    def judge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        settled = table.filter(pc.is_null(table.column("owners")))
        settled = pa.table({"id": settled.column("id"), "key": settled.column("key"), "codes": settled.column("keys")})
        table = table.filter(pc.is_valid(table.column("owners")))
        if not table.num_rows:
            return settled
        keys = [np.frombuffer(k.as_buffer(), "<u4") for k in table.column("keys")]
        owners = [np.frombuffer(o.as_buffer(), "<i8").reshape(-1, 2) for o in table.column("owners")]
        key = np.concatenate(keys)
        single = np.concatenate([np.arange(len(k)) < len(o) for k, o in zip(keys, owners)])
        owner = np.concatenate([np.concatenate([o, np.full((len(k) - len(o), 2), -1)]) for k, o in zip(keys, owners)])
        order = np.argsort(key, kind="stable")
        key, owner, single = key[order], owner[order], single[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        # one entry per block: two of a key are two documents, or a document and a block that repeats it
        again = (np.repeat(size, size) > 1) & single
        code = key[again].astype(np.uint64) | np.uint64(bucket << 32)
        out = list(_by_document(owner[again, 0], owner[again, 1], code))[0]
        return pa.concat_tables([settled, pa.table({"id": out.column(1), "key": out.column(2), "codes": out.column(3)})])

    dealt = docs.select("id", "key", "text").mapInArrow(count, "bucket long, id long, key long, keys binary, owners binary")
    return dealt.groupBy("bucket").applyInArrow(judge, "id long, key long, codes binary")
