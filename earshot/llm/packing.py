"""Packing: vector bin packing of examples into sequences.

Every sequence has three limits: tokens, segments (pieces of examples), and tokens that bear loss. The next piece of a
sequence is the one with the largest dot product of its sizes and the room that is left, both as shares of the limits;
when none fits as a whole, the one that exceeds the room least is cut, so that the sequence ends full.

Each task packs the rows of its input split as it tokenizes them: nothing is shuffled, and the ids of a lost task are
those of its repetition, as a split's rows keep their order. Per task, one sequence at most is left partly filled for
want of rows (more only where the limit on segments or on loss-bearing tokens closes a sequence early).

Edge cases: a null or empty text is its end id alone; equal rows are packed each for itself; an empty table gives no
piece; a row without doc_id is packed like any other; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, texts_of
from .tokens import encoder


#: Pieces in an Arrow batch that goes back (up to 8 KB each with ids), and pieces in each generation of the encoder's cache.
EMITTED, CACHED = 512, 400_000


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048


class Packer:
    """Packs examples as they come; ``pieces`` of finished sequences are given back by ``add`` and ``finish``.

    An example is (key, ids, prompt): the first ``prompt`` ids bear no loss. A piece is (key, start, ids, total,
    sequence, offset, segment, loss tokens).
    """

    def __init__(self, limits: Limits, group: int = 2048):
        self.limits, self.group = limits, group
        self.waiting: list[tuple] = []  # (key, start, ids, total, prompt)
        self.room = 0
        self.sequence = 0

    def _loss(self, start: int, n: int, prompt: int) -> int:
        return max(0, start + n - max(start, prompt))

    def add(self, key, ids: np.ndarray, prompt: int = 0):
        out, at, n = [], 0, len(ids)
        while n - at >= self.limits.tokens and self._loss(at, self.limits.tokens, prompt) <= self.limits.loss_tokens:
            part = ids[at : at + self.limits.tokens]
            out.append((key, at, part, n, self.sequence, 0, 0, self._loss(at, len(part), prompt)))
            self.sequence += 1
            at += self.limits.tokens
        while at < n:  # a rest that alone may bear more loss than a sequence takes is cut beforehand
            size = min(n - at, self.limits.tokens)
            if self._loss(at, size, prompt) > self.limits.loss_tokens:
                size = max(prompt - at, 0) + self.limits.loss_tokens
            self.waiting.append((key, at, ids[at : at + size], n, prompt))
            self.room += size
            at += size
        if len(self.waiting) >= self.group:
            out += self._pack(keep=True)
        return out

    def finish(self):
        return self._pack(keep=False)

    def _pack(self, keep: bool):
        """Fills sequences from what waits; ``keep``: leaves what can't fill a sequence for later."""
        lim, out = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], float), []
        items = self.waiting
        size = np.array([[len(x[2]), 1, self._loss(x[1], len(x[2]), x[4])] for x in items], float).reshape(-1, 3)
        open_, left = np.ones(len(items), bool), size[:, 0].sum()
        share = size / lim
        while open_.any() and not (keep and (left < self.limits.tokens or open_.sum() <= self.limits.segments)):
            room, offset, segment = lim.copy(), 0, 0
            while room[0] >= 1 and room[1] >= 1:
                fits = open_ & (size <= room).all(axis=1)
                whole = np.flatnonzero(fits)
                last = room[1] == 1
                if len(whole) and not (last and (size[open_, 0] > room[0]).any() and size[whole, 0].max() < room[0]):
                    i = int(whole[np.argmax(share[whole] @ (room / lim))])
                    take = int(size[i, 0])
                else:  # cut the one that exceeds the room least
                    i, take = self._cut(items, size, open_, room)
                    if i < 0:
                        break
                key, start, ids, total, prompt = items[i]
                loss = self._loss(start, take, prompt)
                out.append((key, start, ids[:take], total, self.sequence, offset, segment, loss))
                offset, segment, left = offset + take, segment + 1, left - take
                room -= (take, 1, loss)
                if take == len(ids):
                    open_[i] = False
                else:
                    items[i] = (key, start + take, ids[take:], total, prompt)
                    size[i] = len(ids) - take, 1, self._loss(start + take, len(ids) - take, prompt)
                    share[i] = size[i] / lim
            self.sequence += 1
        self.waiting = [x for x, o in zip(items, open_, strict=True) if o]
        return out

    def _cut(self, items, size, open_, room):
        over = np.flatnonzero(open_)
        for i in over[np.argsort(size[over, 0], kind="stable")]:
            _, start, ids, _, prompt = items[i]
            take = int(min(room[0], len(ids)))
            if self._loss(start, take, prompt) > room[2]:
                take = int(max(prompt - start, 0) + room[2])
            if take > 0 and (take == room[0] or room[2] < 1 or size[i, 0] >= room[0]):
                return int(i), min(take, len(ids))
        return -1, 0


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, kind: str = "word_end", limits: Limits = Limits(), prompt: str | None = None, with_ids: bool = False, cached: int = CACHED) -> DataFrame:
    """One row per piece. ``cached`` bounds what a worker remembers of pieces' ids: fewer take more time, not other ids. ``prompt``: a column with the number of leading tokens that bear no loss."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment int, loss_tokens int" + ", ids array<int>" * with_ids

    def pieces(batches):
        part, enc, packer = TaskContext.get().partitionId(), encoder(tokenizer, kind, cached), Packer(limits)

        def rows(found):
            key, start, ids, total, seq, offset, segment, loss = zip(*found, strict=True)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            columns = [pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(np.array(seq, np.int64) + (part << 36)), pa.array(offset, pa.int64()), pa.array(segment, pa.int32()), pa.array(loss, pa.int32())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in small(batches):
            keys, prompts = b.column(0).to_pylist(), b.column(2).to_pylist()
            found = []
            for key, ids, k in zip(keys, enc.encode(b.column(1).to_pylist()), prompts, strict=True):
                found += packer.add(key, np.append(ids, np.uint32(end_id)), k)
                if len(found) >= EMITTED:
                    yield rows(found)
                    found = []
            if found:
                yield rows(found)
        if found := packer.finish():
            yield rows(found)

    bare = F.coalesce(F.col(prompt).cast("int"), F.lit(0)) if prompt else F.lit(0)
    return texts_of(docs, bare.alias("prompt")).mapInArrow(pieces, schema)


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
