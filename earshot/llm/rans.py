"""Token-id output: static range asymmetric numeral system (rANS) segments.

Operator ``write_ids`` encodes every text, appends an end id, and writes the ids in ascending doc_id order as segments;
``read_ids`` decodes them. A segment is a byte string of its own (one row of the Parquet table that carries it):

    magic, sizes | frequency table, shared by all blocks | lengths of documents | index of blocks | blocks

A block holds a run of the segment's ids, spread over ``LANES`` interleaved states: id i of a block belongs to lane
i % lanes. Blocks are independent of each other; within a block, a checkpoint every ``STEPS`` steps keeps all states and
the place in the words, so that a decoder can start there. Every block carries a CRC-32 of its ids.

Numbers: state 64 bits in [2^31, 2^63), renormalised by 32-bit words, frequencies sum to 2^20.

Edge cases: a null or empty text is the end id alone; equal doc_ids follow each other by text; rows without doc_id come
first (nulls sort first); an empty table gives no segment; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_offsets, shared_dir, small, texts_of
from .tokens import encoder

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
LANES, STEPS = 2048, 256
#: Ids of a block and of a segment; a task holds one segment in memory.
BLOCK_IDS, SEGMENT_IDS = LANES * STEPS * 4, 1 << 23
MAGIC = b"RSG1"


# ---- one block ------------------------------------------------------------------------------------------------------


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2^20; what occurs keeps 1 at least."""
    total, goal = int(counts.sum()), 1 << SCALE_BITS
    if not total:
        return np.zeros(len(counts), np.uint32)
    if int((counts > 0).sum()) > goal:
        raise ValueError("more symbols than the table has slots")
    f = np.where(counts > 0, np.maximum(counts.astype(np.int64) * goal // total, 1), 0)
    rest = goal - int(f.sum())
    if rest > 0:
        f[int(np.argmax(f))] += rest
    while rest < 0:  # take from the largest, never below 1
        i = int(np.argmax(f))
        take = min(-rest, max(int(f[i]) // 2, 1))
        f[i] -= take
        rest += take
    return f.astype(np.uint32)


def encode_block(symbols: np.ndarray, freq: np.ndarray, first: np.ndarray, lanes: int, steps: int = STEPS) -> tuple[bytes, list[tuple[int, np.ndarray]]]:
    """Words of a block, and its checkpoints (place in the words, states) in ascending order; the first is the start."""
    n, state = len(symbols), np.full(lanes, LOW, np.uint64)
    f_all, c_all = freq[symbols].astype(np.uint64), first[symbols].astype(np.uint64)
    words, marks = [], []
    for t in range((n - 1) // lanes, -1, -1):
        f, c = f_all[t * lanes : (t + 1) * lanes], c_all[t * lanes : (t + 1) * lanes]
        x = state[: len(f)]
        full = x >= (f << np.uint64(43))
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(f)] = (q << np.uint64(SCALE_BITS)) + (x - q * f) + c
        if t % steps == 0:
            marks.append((len(words), state.copy()))
    sizes = np.cumsum([0, *[len(w) for w in reversed(words)]])
    stream = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    return stream, [(int(sizes[len(words) - k]), s) for k, s in reversed(marks)]


def decode_block(words: np.ndarray, states: np.ndarray, n: int, freq: np.ndarray, first: np.ndarray, slots: np.ndarray, at: int = 0) -> np.ndarray:
    """``n`` ids from a checkpoint on: its states and its place ``at`` in the words."""
    lanes, out = len(states), np.empty(n, np.uint32)
    state, mask = states.copy(), np.uint64((1 << SCALE_BITS) - 1)
    freq, first = freq.astype(np.uint64), first.astype(np.uint64)
    for start in range(0, n, lanes):
        x = state[: min(lanes, n - start)]
        slot = x & mask
        s = slots[slot.astype(np.int64)]
        out[start : start + len(x)] = s
        x = freq[s] * (x >> np.uint64(SCALE_BITS)) + slot - first[s]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
        at += len(low)
        state[: len(x)] = x
    if (state != LOW).any():  # the encoder began there
        raise ValueError("the states don't end where they began")
    return out


# ---- one segment ----------------------------------------------------------------------------------------------------


def pack_segment(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    counts = np.bincount(ids, minlength=1)
    freq = frequencies(counts)
    first = (np.cumsum(freq, dtype=np.uint64) - freq).astype(np.uint32)
    used = np.flatnonzero(freq).astype("<u4")
    table = zlib.compress(used.tobytes() + freq[used].astype("<u4").tobytes(), 1)
    docs = zlib.compress(np.array([-1 if x is None else x for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], "u1").tobytes() + np.array(lengths, "<u4").tobytes(), 1)
    blocks, index = [], []
    for start in range(0, len(ids), BLOCK_IDS):
        part = ids[start : start + BLOCK_IDS]
        lanes = min(LANES, -(-len(part) // STEPS))
        stream, marks = encode_block(part, freq, first, lanes)
        body = struct.pack("<IIII", len(part), lanes, len(marks), zlib.crc32(part.astype("<u4").tobytes()))
        body += b"".join(struct.pack("<I", at) + s.astype("<u8").tobytes() for at, s in marks) + stream
        index.append(len(body))
        blocks.append(body)
    head = MAGIC + struct.pack("<IIIII", len(doc_ids), len(used), len(table), len(docs), len(blocks))
    return b"".join([head, table, docs, np.array(index, "<u4").tobytes(), *blocks])


class Segment:
    """Reads a segment; blocks, and the stretches between checkpoints, can be decoded in any order."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("no segment")
        n_docs, n_used, n_table, n_index, n_blocks = struct.unpack_from("<IIIII", data, 4)
        at = 24
        table = np.frombuffer(zlib.decompress(data[at : at + n_table]), "<u4")
        at += n_table
        docs = zlib.decompress(data[at : at + n_index])
        at += n_index
        used, f = table[:n_used], table[n_used:]
        self.freq = np.zeros(int(used[-1]) + 1 if n_used else 1, np.uint32)
        self.freq[used] = f
        self.first = (np.cumsum(self.freq, dtype=np.uint64) - self.freq).astype(np.uint32)
        self.slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)
        none = np.frombuffer(docs, "u1", n_docs, 8 * n_docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(np.frombuffer(docs, "<i8", n_docs), none, strict=True)]
        self.lengths = np.frombuffer(docs, "<u4", n_docs, 9 * n_docs).astype(np.int64)
        sizes = np.frombuffer(data, "<u4", n_blocks, at).astype(np.int64)
        self.ends = at + 4 * n_blocks + np.cumsum(sizes)
        self.starts, self.data = self.ends - sizes, data

    def block(self, k: int, mark: int = 0, check: bool = True) -> np.ndarray:
        """The ids of block ``k`` from checkpoint ``mark`` on."""
        at = int(self.starts[k])
        n, lanes, n_marks, crc = struct.unpack_from("<IIII", self.data, at)
        size = 4 + 8 * lanes
        place = at + 16 + mark * size
        (word,) = struct.unpack_from("<I", self.data, place)
        states = np.frombuffer(self.data, "<u8", lanes, place + 4)
        body = at + 16 + n_marks * size
        words = np.frombuffer(self.data, "<u4", (int(self.ends[k]) - body) // 4, body)
        ids = decode_block(words, states, n - mark * lanes * STEPS, self.freq, self.first, self.slots, word)
        if check and mark == 0 and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k} doesn't match its checksum")
        return ids

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.starts))]) if len(self.starts) else np.empty(0, np.uint32)


# ---- Spark ----------------------------------------------------------------------------------------------------------

SEGMENTS = "part int, seg int, n_docs long, n_ids long, segment binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, kind: str = "byte_level") -> None:
    """Writes the segments of ``docs`` to ``path``. One shuffle, of the texts by ranges of doc_id; then each task encodes
    its range in order, one segment after the other."""

    def segments(batches):
        part, seg, doc_ids, arrays, size = TaskContext.get().partitionId(), 0, [], [], 0
        enc = encoder(tokenizer, kind)

        def flush():
            ids = np.concatenate(arrays)
            data = pack_segment(doc_ids, [len(x) for x in arrays], ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names=["part", "seg", "n_docs", "n_ids", "segment"])

        for b in small(batches):
            for d, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                doc_ids.append(d)
                arrays.append(np.append(ids, np.uint32(end_id)))
                size += len(arrays[-1])
                if size >= SEGMENT_IDS:
                    yield flush()
                    seg, doc_ids, arrays, size = seg + 1, [], [], 0
        if doc_ids:
            yield flush()

    # rows of one doc_id (or of none) are spread by a hash of the text
    of = F.xxhash64("text")
    ordered = texts_of(docs).repartitionByRange("doc_id", of).sortWithinPartitions("doc_id", of, "text")
    ordered.mapInArrow(segments, SEGMENTS).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents, decoded from the segments."""
    schema = "part int, seg int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def documents(batches):
        for b in batches:
            part, seg, data = b.column(0), b.column(1), b.column(2)
            for i in range(b.num_rows):
                s = Segment(data[i].as_py())
                ids = s.ids().astype("<u4")
                ends = np.cumsum(s.lengths)
                view, crc = memoryview(ids).cast("B"), []
                for e, n in zip(ends.tolist(), s.lengths.tolist(), strict=True):
                    crc.append(zlib.crc32(view[4 * (e - n) : 4 * e]))
                n = len(crc)
                columns = [pa.array(np.full(n, part[i].as_py(), np.int32)), pa.array(np.full(n, seg[i].as_py(), np.int32)), pa.array(s.doc_ids, pa.int64()), pa.array(ends - s.lengths), pa.array(s.lengths), pa.array(crc, pa.int64())]
                names = ["part", "seg", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[e - k : e].astype(np.int64) for e, k in zip(ends, s.lengths, strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    stored = spark.read.schema(SEGMENTS).parquet(path)
    offsets = running_offsets(stored.select("part", "seg", "n_ids"), ["part", "seg"], "n_ids", "before").drop("n_ids")
    rows = stored.select("part", "seg", "segment").mapInArrow(documents, schema)
    out = rows.join(offsets, ["part", "seg"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
    return out


def op1_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from .common import table

    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_ids(spark, path)
