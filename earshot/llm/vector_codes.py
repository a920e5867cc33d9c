"""Vector codes: product quantisation by Elkan's form of Lloyd's method, on integers.

1. Components become integers, floor(256 x); vectors are cut into ``PARTS`` parts. The codebook of a part position starts
   as that part of the ``ENTRIES`` smallest vec_ids.
2. The first assignment measures all entries and writes, for each vector and part, its entry, an upper bound of the
   distance to it and a lower bound of the distance to every entry (float16, rounded so that each stays a bound).
3. Entries are replaced by the floor of their parts' means, from sums of each task's rows added up by (part, entry).
4. Later assignments read the bounds, shift them by the entries' movement and measure only what the triangle inequality
   leaves open: an entry goes if its lower bound, or half its distance to the assigned entry, is above the upper bound.
   Both tests are strict, and what is left is compared by exact integer distances and index, so ties go to the lower
   index as in a full search. What is measured becomes the new bound.

Codebooks (``ENTRIES`` entries a part) are all that the driver holds; sums reach it added up, one row per part and entry.
Vectors are read and written by task, in batches, and never shuffled but for the labels' sums. Bounds take 2 bytes for
each part and entry: 2,080 bytes a vector for 16 parts of 64 entries, for two rounds.

Edge cases: a null or empty vector, one with a null or non-finite component, or of another length than most vectors
(the longer, of equally frequent lengths) is dropped; a length that isn't a multiple of ``PARTS`` is filled up with zeros;
integers beyond 2^24 (components beyond 65,536) are cut to that; rows without vec_id are coded, but start no entry; rows
that repeat a vec_id each count, in order of their integers' bytes; fewer vectors than entries start fewer entries; null labels
are one group; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, give_back, stage, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MOST = 1 << 24
BATCH = 1024
KEPT = "vec_id long, label int, ints binary"
BOUNDED = KEPT + ", entry binary, upper binary, lower binary"


def _batches(batches, rows: int = BATCH):
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def _stacked(column, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def kept_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, ints) of the rows that count, and the number of components, zeros included."""
    x = F.col("embedding")
    whole = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(whole)
    most = rows.groupBy(F.size(x).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    n = most[0].n if most else 0
    width = -(-n // PARTS) * PARTS

    def ints(batches):
        for b in _batches(batches):
            flat = np.asarray(b.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, n)
            out = np.zeros((b.num_rows, width), "<i4")
            out[:, :n] = np.clip(np.floor(flat * SCALE), -MOST, MOST)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _bytes(out)], names=["vec_id", "label", "ints"])

    chosen = rows.where(F.size(x) == n).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    return stage(chosen.mapInArrow(ints, KEPT), "vectors"), width


def first_entries(kept: DataFrame, width: int) -> np.ndarray:
    """Codebooks (part, entry, component) from the smallest vec_ids; at most ``ENTRIES`` rows come to the driver."""
    rows = kept.where("vec_id is not null").select("vec_id", "ints").orderBy("vec_id", "ints").limit(ENTRIES).collect()
    x = [np.frombuffer(r.ints, "<i4") for r in rows]
    return np.array(x, np.int64).reshape(len(x), PARTS, width // PARTS).transpose(1, 0, 2)


def _down(x: np.ndarray) -> np.ndarray:
    """The greatest float16 that isn't above ``x`` (not negative)."""
    y = np.minimum(x, 65504.0).astype("<f2")
    return np.where(y.astype(np.float64) > x, np.nextafter(y, np.float16(-np.inf)), y).astype("<f2")


def _up(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = x.astype("<f2")
    return np.where(y.astype(np.float64) < x, np.nextafter(y, np.float16(np.inf)), y).astype("<f2")


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of parts to entries."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None] - entries[None, :, j]
        out += d * d
    return out


def full_assignment(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one part: nearest entry (the lower index of equals), its squared distance, upper and lower bounds."""
    d = squares(x, entries)
    a = d.argmin(axis=1)
    best = d[np.arange(len(x)), a]
    root = np.sqrt(d.astype(np.float64))
    return a, best, _up(np.sqrt(best.astype(np.float64)) * (1 + 1e-12)), _down(root * (1 - 1e-12))


def pruned_assignment(x, entries, moved, a, upper, lower, last: bool = False):
    """The same from older bounds; ``moved`` is how far each entry has moved. Also how many distances were measured.

    Rows that their bounds settle keep their entry; only a ``last`` assignment measures their distance, too.
    """
    n, rows = len(x), np.arange(len(x))
    low = np.maximum(lower.astype(np.float64) - moved[None, :] * (1 + 1e-12), 0.0) * (1 - 1e-12)
    high = (upper.astype(np.float64) + moved[a]) * (1 + 1e-12)
    between = np.sqrt(squares(entries, entries).astype(np.float64)) * (0.5 * (1 - 1e-12))
    np.fill_diagonal(between, np.inf)
    best = np.full(n, -1, np.int64)

    def open_at(r):
        out = ~((low[r] > high[r, None]) | (between[a[r]] > high[r, None]))
        out[np.arange(len(r)), a[r]] = False
        return out

    def measure(r, e):
        d = x[r] - entries[e]
        d = (d * d).sum(axis=1)
        root = np.sqrt(d.astype(np.float64))
        low[r, e] = root * (1 - 1e-12)
        return d, root * (1 + 1e-12)

    # upper bounds become tight where they don't settle the row, then entries still open are measured
    some = rows if last else rows[open_at(rows).any(axis=1)]
    best[some], tight = measure(some, a[some])
    high[some] = np.minimum(high[some], tight)
    at, e = np.nonzero(open_at(some))
    r = some[at]
    d, root = measure(r, e)
    # the least of (distance, index) among the assigned entry and what was measured
    all_rows, all_entries, all_d, all_high = np.concatenate([some, r]), np.concatenate([a[some], e]), np.concatenate([best[some], d]), np.concatenate([high[some], root])
    order = np.lexsort((all_entries, all_d, all_rows))
    first = order[np.searchsorted(all_rows[order], some)]
    a = a.copy()
    a[some], best[some], high[some] = all_entries[first], all_d[first], all_high[first]
    return a, best, _up(high), _down(low), len(some) + len(r)


def _bounded(entries: np.ndarray):
    parts, many, size = entries.shape

    def rows(batches):
        for b in _batches(batches):
            x = _stacked(b.column(2), "<i4", parts, size).astype(np.int64)
            got = [full_assignment(x[:, p], entries[p]) for p in range(parts)]
            a, _, upper, lower = (np.stack([g[i] for g in got], axis=1) for i in range(4))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _bytes(a.astype("u1")), _bytes(upper), _bytes(lower)], names=["vec_id", "label", "ints", "entry", "upper", "lower"])

    return rows


def _again(entries: np.ndarray, moved: np.ndarray, last: bool):
    parts, many, size = entries.shape

    def rows(batches):
        for b in _batches(batches):
            x = _stacked(b.column(2), "<i4", parts, size).astype(np.int64)
            a = _stacked(b.column(3), "u1", parts).astype(np.int64)
            upper, lower = _stacked(b.column(4), "<f2", parts), _stacked(b.column(5), "<f2", parts, many)
            got = [pruned_assignment(x[:, p], entries[p], moved[p], a[:, p], upper[:, p], lower[:, p], last) for p in range(parts)]
            a, best, upper, lower = (np.stack([g[i] for g in got], axis=1) for i in range(4))
            if last:
                codes = pa.array([row.tobytes().hex() for row in a.astype("u1")])
                yield pa.RecordBatch.from_arrays([*b.columns[:2], codes, pa.array(best.sum(axis=1)), pa.array([sum(g[4] for g in got) // b.num_rows] * b.num_rows, pa.int64())], names=["vec_id", "label", "code", "error", "measured"])
            else:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], _bytes(a.astype("u1")), _bytes(upper), _bytes(lower)], names=["vec_id", "label", "ints", "entry", "upper", "lower"])

    return rows


def _sums(parts: int, many: int, size: int):
    """Each task's (place, n, sums) of the parts assigned to each entry; place is part * entries + entry."""

    def rows(batches):
        total, count = np.zeros((parts * many, size), np.int64), np.zeros(parts * many, np.int64)
        for b in _batches(batches):
            x = _stacked(b.column(0), "<i4", parts, size).astype(np.int64)
            place = _stacked(b.column(1), "u1", parts).astype(np.int64) + np.arange(parts)[None, :] * many
            np.add.at(total, place.ravel(), x.reshape(-1, size))
            count += np.bincount(place.ravel(), minlength=parts * many)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), pa.array(total[at].tolist(), pa.list_(pa.int64()))], names=["place", "n", "sums"])

    return rows


def moved_entries(bounded: DataFrame, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next codebooks, and how far each entry moves."""
    parts, many, size = entries.shape
    rows = bounded.select("ints", "entry").mapInArrow(_sums(parts, many, size), "place long, n long, sums array<long>")
    rows = rows.select("place", "n", F.posexplode("sums").alias("at", "sum")).groupBy("place", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).collect()
    out = entries.copy()
    for r in rows:
        out[r.place // many, r.place % many, r["at"]] = r["sum"] // r.n
    d = (out - entries).astype(np.float64)
    return out, np.sqrt((d * d).sum(axis=2)) * (1 + 1e-12)


def digest(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, measured) of each kept row of ``vectors`` (vec_id, embedding, label), and the codebooks.

    ``measured`` is how many of the PARTS * ENTRIES distances the last assignment measured a row, on average of its batch.
    """
    kept, width = kept_vectors(vectors)
    entries = first_entries(kept, width)
    columns = "vec_id long, label int, code string, error long, measured long"
    if not entries.size:
        return kept.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("measured")), entries
    bounded = stage(kept.mapInArrow(_bounded(entries), BOUNDED), "bounds")
    for r in range(ROUNDS):
        entries, moved = moved_entries(bounded, entries)
        if r == ROUNDS - 1:
            out = stage(bounded.mapInArrow(_again(entries, moved, True), columns), "codes")
        else:
            out = stage(bounded.mapInArrow(_again(entries, moved, False), BOUNDED), "bounds")
        dropped(bounded)
        bounded = out
    return out, entries


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, entries = encode(table(spark, sf_dir, "embeddings"))
    of = codes.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    rows = codes.join(of, F.col("label").eqNullSafe(F.col("l")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256"))


def _assigned(book: str) -> str:
    return f"""SELECT row, p, arg_min(e, dist * {ENTRIES} + e) AS e, min(dist) AS dist FROM (
      SELECT v.row, v.p, b.e, sum((v.x - b.x) * (v.x - b.x)) AS dist FROM parts v JOIN {book} b USING (p, j) GROUP BY ALL) GROUP BY ALL"""


def _updated(book: str, assigned: str) -> str:
    return f"""SELECT p, e, j, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
      SELECT p, a.e, j, (sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM parts v JOIN {assigned} a USING (row, p) GROUP BY ALL) m USING (p, e, j)"""


#: By full search; vectors of the test tables are whole, of one length, and have distinct vec_ids.
ORACLE = f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), flat AS (SELECT row, vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i, len(embedding) // {PARTS} AS size FROM kept
), parts AS MATERIALIZED (SELECT row, vec_id, i // size AS p, i % size AS j, floor(v::DOUBLE * {SCALE})::BIGINT AS x FROM flat
), starts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}
), b0 AS MATERIALIZED (SELECT p, e, j, x FROM parts JOIN starts USING (vec_id)
), a0 AS MATERIALIZED ({_assigned("b0")}
), b1 AS MATERIALIZED ({_updated("b0", "a0")}
), a1 AS MATERIALIZED ({_assigned("b1")}
), b2 AS MATERIALIZED ({_updated("b1", "a1")}
), a2 AS MATERIALIZED ({_assigned("b2")}
), codes AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a2 GROUP BY row
), book AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN kept USING (row), book
"""
