"""Token counts without ids: pieces of each distinct pre-token once, times per-document pre-token frequencies.

1. Texts are read in blocks of some million characters. A block gets a dictionary of its distinct pre-tokens; each of
   its documents becomes a list of (place in the dictionary, frequency), packed. Both go to one written table.
2. The dictionaries' entries are dealt by pre-token and sorted there, so that equal ones stand together; the tokenizer
   counts each distinct one's pieces once, and every entry takes that count: no second shuffle for a distinct list.
3. The counts go back to their blocks as one array each and are joined to the documents of the block; a document's
   tokens are the sum of frequency times count. A block has a bounded size, so no key gathers more than a block's
   dictionary, and a frequent pre-token has one row per block, not one per document.

Special strings inside a text are cut out before the pre-tokens are made, as the library does by default; each counts
as one piece. Frequent pre-tokens meet one row per block, not one per document, and the join is an ordinary shuffle
join that adaptive execution may split.

Edge cases: a null or empty text has 0 tokens; equal doc_ids give a row each; an empty table gives no row; a row without
doc_id gets its counts like any other; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, texts_of

#: The byte-level pattern of the vocabulary file (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = ("<|endoftext|>",)
BLOCK_CHARS = 48_000_000

CODED = "block long, doc_id long, n_bytes long, places binary, counts binary, place int, piece string"


def _coded(special: tuple[str, ...], block_chars: int):
    import regex

    pattern = regex.compile(PATTERN)
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def split(text: str) -> list[str]:
        if cut is None or not cut.search(text):
            return pattern.findall(text)
        out = []
        for k, part in enumerate(cut.split(text)):
            out += [part] if k % 2 else pattern.findall(part)
        return out

    def rows(batches):
        block, known, chars = TaskContext.get().partitionId() << 20, {}, 0

        def dictionary():
            n = len(known)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(known), pa.string())], names=NAMES)

        for b in batches:
            found = []

            def documents(found):
                d, size, places, counts = zip(*found, strict=True)
                n = len(d)
                return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(d, pa.int64()), pa.array(size, pa.int64()), pa.array(places, pa.binary()), pa.array(counts, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=NAMES)

            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                times = Counter(split(text))
                for x in times:
                    if x not in known:
                        known[x] = len(known)
                place = np.fromiter(map(known.__getitem__, times), np.int64, len(times))
                count = np.fromiter(times.values(), np.int64, len(times))
                order = np.argsort(place)
                step = np.diff(place[order], prepend=0)
                found.append((d, len(text.encode("utf-8", "surrogatepass")), zlib.compress(_short(step), 1), zlib.compress(_short(count[order]), 1)))
                chars += len(text)
                if chars >= block_chars:
                    yield documents(found)
                    yield dictionary()
                    block, known, chars, found = block + 1, {}, 0, []
            if found:
                yield documents(found)
        if known:
            yield dictionary()

    return rows


NAMES = ["block", "doc_id", "n_bytes", "places", "counts", "place", "piece"]


def _short(x: np.ndarray) -> bytes:
    """Seven bits a byte, the highest bit set on all but a number's last byte."""
    x = x.astype(np.uint64)
    if len(x) and int(x.max()) < 128:
        return x.astype(np.uint8).tobytes()
    n = np.maximum((np.ceil(np.log2(x.astype(float) + 1) / 7)).astype(np.int64), 1)
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    for k in range(int(n.max()) if len(x) else 0):
        has = n > k
        part = (x[has] >> np.uint64(7 * k)).astype(np.uint64) & np.uint64(127)
        out[ends[has] - 1 - k] = part.astype(np.uint8) | (128 if k else 0)
    return out.tobytes()


def _long(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not (b > 127).any():
        return b.astype(np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    behind = np.repeat(last, last - first + 1) - np.arange(len(b))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * behind), first)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, special: tuple[str, ...] = SPECIAL, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_distinct) of every document."""

    def coded(batches):
        yield from _coded(special, block_chars)(batches)

    def pieces(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on each core
        from tokenizers import Tokenizer

        t, last, last_n = Tokenizer.from_file(tokenizer), None, 0
        for b in batches:
            coded_ = b.column(0).dictionary_encode()
            own = coded_.dictionary.to_pylist()
            known = len(own) > 0 and own[0] == last  # goes on from the batch before
            n = [last_n] * known + [len(e.ids) for e in t.encode_batch_fast(own[known:], add_special_tokens=False)]
            if own:
                last, last_n = own[-1], n[-1]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(np.array(n, np.int32)[coded_.indices.to_numpy()])], names=["block", "place", "n"])

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        of = right.column("of")
        n = np.frombuffer(zlib.decompress(of[0].as_py()), "<u4").astype(np.int64) if len(of) else np.zeros(0, np.int64)
        total, distinct = [], []
        for p, c in zip(left.column("places").to_pylist(), left.column("counts").to_pylist(), strict=True):
            at = np.cumsum(_long(zlib.decompress(p)))
            total.append(int((n[at] * _long(zlib.decompress(c))).sum()))
            distinct.append(len(at))
        return pa.table({"doc_id": left.column("doc_id"), "n_bytes": left.column("n_bytes"), "n_tokens": pa.array(total, pa.int64()), "n_distinct": pa.array(distinct, pa.int64())})

    def arrays(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        n = np.zeros(rows.num_rows, "<u4")
        n[rows.column("place").to_numpy()] = rows.column("n").to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "of": pa.array([zlib.compress(n.tobytes(), 1)], pa.binary())})

    rows = stage(texts_of(docs).mapInArrow(coded, CODED), "pretokens")
    entries = rows.where(F.col("place").isNotNull()).select("piece", "block", "place")
    counted = entries.repartition("piece").sortWithinPartitions("piece").mapInArrow(pieces, "block long, place int, n int")
    back = counted.groupBy("block").applyInArrow(arrays, "block long, of binary")
    documents = rows.where(F.col("place").isNull()).select("block", "doc_id", "n_bytes", "places", "counts")
    out = documents.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(sums, "doc_id long, n_bytes long, n_tokens long, n_distinct long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_distinct")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
