"""Exact frequencies of all shingles, and each document's shared shingles in rare-first order, in two shuffles of bytes.

1. A task gathers the distinct shingle hashes of some documents into a block of about ``BLOCK`` hashes, sorts them and
   deals them by their leading bits into buckets: per bucket the distinct hashes, how many documents of the block hold
   each, and which. Neighbouring hashes are stored as differences, so that a shingle takes about 6.5 bytes on the wire.
   Where ``HOT`` documents of a block hold a hash, the bucket gets their number alone and the list of documents goes
   straight to the block's second step: no bucket gathers a row per document that holds a frequent shingle.
2. A bucket adds up the numbers of all blocks and answers each block with its hashes of two documents at least, with
   their level (eight steps per doubling of the frequency, 255 at most).
3. A block puts its answers together: of each document the shared hashes by (level, hash), rare first. A document that
   shares fewer hashes than any link needs goes.

The number of buckets follows the number of shingles (``bucket_bits``), so a bucket, like a block, stays of one size.
Hashes are compared by 48 bits besides the bucket's (by 64 where there are 2^16 buckets or more).

A block's number is its task's and its place in the task: ``rows`` has to be a table that is read in the same order again,
as files are, so that a task run twice gives the same blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small
from .hashing import mix, shingle_sets

BLOCK, BUCKET, HOT, MOST_DOCS = 700_000, 700_000, 64, 42_000
RANGES = 32
_ASK, _LIST, _HEAD = 0, 1, 2
DEALT = "to int, block long, kind int, bucket int, a binary, b binary, c binary"
SETS = "cls long, n int, ranges binary, ids binary"


def bucket_bits(shingles: int) -> int:
    return max(4, int(max(shingles, 1) / BUCKET).bit_length())


def set_class(h: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit name of a set of hashes."""
    with np.errstate(over="ignore"):
        x = mix(h ^ np.uint64(0x9FB21C651E98DF25 + seed)).sum(dtype=np.uint64) + np.uint64(len(h))
        return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def _packed(keys: np.ndarray) -> bytes:
    """Ascending 48-bit numbers: differences of the upper 16 bits, compressed, then the lower 32 bits."""
    top = zlib.compress(np.diff((keys >> np.uint64(32)).astype("<u2"), prepend=np.uint16(0)).tobytes(), 1)
    return len(top).to_bytes(4, "little") + top + keys.astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    top = np.cumsum(np.frombuffer(zlib.decompress(data[4 : 4 + n]), "<u2"), dtype=np.uint16).astype(np.uint64)
    return (top << np.uint64(32)) | np.frombuffer(data, "<u4", offset=4 + n)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"to": pa.int32(), "block": pa.int64(), "kind": pa.int32(), "bucket": pa.int32()}
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.binary())) for c, n in zip(columns, names, strict=True)], names=names)


def _deal(k: int, bits: int, seed: int, block_size: int = BLOCK, hot_from: int = HOT):
    names = ["to", "block", "kind", "bucket", "a", "b", "c"]
    width = min(48, 64 - bits)

    def flush(block: int, sets: list, classes: list):
        h, n = np.concatenate(sets), np.array([len(s) for s in sets])
        own = np.repeat(np.arange(len(n), dtype="<u2"), n)
        order = np.argsort(h)
        h, own = h[order], own[order]
        bucket = h >> np.uint64(64 - bits)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        held = np.diff(np.append(first, len(h)))
        keys, of = h[first] & np.uint64((1 << width) - 1), bucket[first].astype(np.int64)
        hot = held >= hot_from
        edges = np.searchsorted(of, np.arange((1 << bits) + 1))
        ends = np.append(first, len(h))
        cold = np.repeat(~hot, held)
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            x, y = edges[b], edges[b + 1]
            at = slice(ends[x], ends[y])
            rows.append((b, block, _ASK, b, _packed(keys[x:y]), np.minimum(held[x:y], 255).astype("u1").tobytes(), own[at][cold[at]].tobytes()))
        back = block % (1 << bits)
        if hot.any():
            rows.append((back, block, _LIST, 0, h[first][hot].astype("<u8").tobytes(), held[hot].astype("<u4").tobytes(), own[~cold].tobytes()))
        rows.append((back, block, _HEAD, 0, np.array(classes, "<i8").tobytes(), n.astype("<i4").tobytes(), b""))
        for i in range(0, len(rows), 64):
            yield _table(rows[i : i + 64], names)

    def rows(batches):
        block, sets, classes, size, seen = TaskContext.get().partitionId() << 32, [], [], 0, set()
        for b in small(batches):
            for d, h in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), k), strict=True):
                if d is None or not len(h):
                    continue
                cls = set_class(h, seed)
                if cls in seen:  # this set is in a block of this task already
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(cls)
                sets.append(h)
                classes.append(cls)
                size += len(h)
                if size >= block_size or len(sets) >= MOST_DOCS:
                    yield from flush(block, sets, classes)
                    block, sets, classes, size = block + 1, [], [], 0
        if sets:
            yield from flush(block, sets, classes)

    return rows


def _answer(hot_from: int = HOT):
    """``hot_from`` has to be that of ``_deal``: it tells which lists of documents a bucket was given."""

    def answers(rows: pa.Table) -> pa.Table:
        return _answers(rows, hot_from)

    return answers


def _answers(rows: pa.Table, hot_from: int) -> pa.Table:
    names = ["block", "kind", "bucket", "a", "b", "c"]
    kinds = rows.column("kind").to_numpy()
    block, bucket = rows.column("block").to_pylist(), rows.column("bucket").to_pylist()
    a, b, c = (rows.column(x) for x in "abc")
    out = [(block[i], int(kinds[i]), bucket[i], a[i].as_py(), b[i].as_py(), c[i].as_py()) for i in np.flatnonzero(kinds != _ASK)]
    asked = np.flatnonzero(kinds == _ASK)
    if len(asked):
        keys = [_unpacked(a[i].as_py()) for i in asked]
        held = [np.frombuffer(b[i].as_py(), "u1") for i in asked]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(held), len(every))
        del every
        level = np.where(total > 1, np.clip(np.floor(8 * np.log2(np.maximum(total, 1))), 1, 255), 0).astype("u1")[at]
        for i, x, n, end in zip(asked, keys, held, np.cumsum([len(x) for x in keys]), strict=True):
            own = level[end - len(x) : end]
            take = own > 0
            if take.any():
                docs = np.frombuffer(c[i].as_py(), "<u2")
                given = np.where(n < hot_from, n, 0)
                out.append((block[i], _ASK, bucket[i], _packed(x[take]), np.stack([own[take], given[take]]).tobytes(), docs[np.repeat(take, given)].tobytes()))
    return pa.Table.from_batches([_table(out, names)])


def _assemble(bits: int, percent: int):
    width = min(48, 64 - bits)
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int32()), ("ranges", pa.binary()), ("ids", pa.binary())])

    def sets(rows: pa.Table) -> pa.Table:
        kind, bucket = rows.column("kind").to_pylist(), rows.column("bucket").to_pylist()
        a, b, c = (rows.column(x).to_pylist() for x in "abc")
        head = kind.index(_HEAD)
        classes, n = np.frombuffer(a[head], "<i8"), np.frombuffer(b[head], "<i4").astype(np.int64)
        ids, level, own, hot_ids, hot_level = [], [], [], [], []
        for i, what in enumerate(kind):
            if what != _ASK:
                continue
            x = _unpacked(a[i]) | (np.uint64(bucket[i]) << np.uint64(width))
            lv, given = np.frombuffer(b[i], "u1").reshape(2, -1)
            ids.append(np.repeat(x, given))
            level.append(np.repeat(lv, given))
            own.append(np.frombuffer(c[i], "<u2"))
            hot_ids.append(x[given == 0])
            hot_level.append(lv[given == 0])
        if kind.count(_LIST):
            i = kind.index(_LIST)
            h, held = np.frombuffer(a[i], "<u8"), np.frombuffer(b[i], "<u4")
            h = ((h >> np.uint64(64 - bits)) << np.uint64(width)) | (h & np.uint64((1 << width) - 1))
            known, lv = np.concatenate(hot_ids), np.concatenate(hot_level)
            order = np.argsort(known)
            lv = lv[order][np.searchsorted(known[order], h)]  # all of them are asked for, and shared
            ids.append(np.repeat(h, held))
            level.append(np.repeat(lv, held))
            own.append(np.frombuffer(c[i], "<u2"))
        if not ids:
            return schema.empty_table()
        ids, level, own = np.concatenate(ids), np.concatenate(level), np.concatenate(own)
        shared = np.bincount(own, minlength=len(n))
        keep = (shared > 0) & (shared >= (percent * n + 99) // 100)
        take = keep[own]
        ids, level, own = ids[take], level[take], own[take]
        order = np.lexsort((ids, level, own))
        ids, own = ids[order], own[order]
        docs = np.flatnonzero(keep)
        ranges = np.bincount(own.astype(np.int64) * RANGES + (mix(ids.copy()) >> np.uint64(59)).astype(np.int64), minlength=len(n) * RANGES).reshape(-1, RANGES)[docs].astype("<u4")
        ends = np.searchsorted(own, docs, "right")
        starts = ends - shared[docs]
        return pa.Table.from_arrays(
            [pa.array(classes[docs]), pa.array(n[docs], pa.int32()), pa.array([r.tobytes() for r in ranges], pa.binary()), pa.array([ids[s:e].astype("<u8").tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())],
            schema=schema,
        )

    return sets


def shared_sets(texts: DataFrame, k: int, percent: int, shingles: int, seed: int = 0, block_size: int = BLOCK, hot_from: int = HOT, bits: int | None = None) -> DataFrame:
    """(cls, n, ranges, ids) of the sets of ``texts`` (doc_id, text) that may link: their size, and the shingles that
    they share with any other document, rare first. Equal sets have equal rows, one per task at most."""
    bits = bucket_bits(shingles) if bits is None else bits
    dealt = texts.mapInArrow(_deal(k, bits, seed, block_size, hot_from), DEALT)
    answers = dealt.groupBy("to").applyInArrow(_answer(hot_from), "block long, kind int, bucket int, a binary, b binary, c binary")
    return answers.groupBy("block").applyInArrow(_assemble(bits, percent), SETS)
