"""Vector codes: Elkan's pruning against full search, SQL, ties, and odd rows."""

import duckdb
import numpy as np
import pytest

from earshot.llm import vector_codes as V
from earshot.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code string, ints string, place long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "i", 1) for r in rows], SCHEMA)


def brute(rows):
    """Codes and errors by full search; rows are (vec_id, vector, label), whole and of one length."""
    x = np.floor(np.array([r[1] for r in rows], np.float32).astype(np.float64) * 256).astype(np.int64)
    n, size = len(x), x.shape[1] // 16
    x = x.reshape(n, 16, size)
    order = sorted(range(n), key=lambda i: rows[i][0])[:64]
    books = x[order].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(2):
        a, _ = assign()
        for p in range(16):
            for e in range(books.shape[1]):
                own = x[a[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    a, d = assign()
    return {r[0]: (a[i].astype("u1").tobytes().hex(), int(d[i].sum())) for i, r in enumerate(rows)}, V.digest(books)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op12(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    got = QUERIES["op12_vector_codes"](spark, d)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, con.execute(ORACLE_SQL["op12_vector_codes"]).fetchall()))


@pytest.mark.parametrize(("n", "size", "step"), [(700, 2, 0.25), (300, 4, 0.004), (40, 1, 1.0), (900, 1, 0.5)])
def test_ties_and_coarse_vectors(spark, n, size, step):
    """Coarse steps give many equal distances, equal entries and repeated vectors."""
    rng = np.random.default_rng(n)
    rows = [(int(i), (np.round(rng.normal(0, 1, 16 * size) / step) * step).astype(np.float32).tolist(), int(i % 3) if i % 5 else None) for i in rng.permutation(n)]
    codes, books = V.encode(frame(spark, rows))
    got = codes.collect()
    want, digest = brute(rows)
    assert {r.vec_id: (r.code, r.error) for r in got} == want and V.digest(books) == digest
    assert n < 100 or all(r.measured < 16 * 64 for r in got)


def test_bounds_stay_bounds():
    rng = np.random.default_rng(1)
    for scale in (1, 100, 10_000):
        x, c = rng.integers(-scale, scale, (500, 4)), rng.integers(-scale, scale, (64, 4))
        a, best, upper, lower = V.full_assignment(x, c)
        for last in (False, False, True):
            c2 = c + rng.integers(-scale // 10 - 1, scale // 10 + 2, c.shape)
            moved = np.sqrt(((c2 - c) ** 2).sum(axis=1).astype(float)) * (1 + 1e-12)
            a, best, upper, lower, n = V.pruned_assignment(x, c2, moved, a, upper, lower, last)
            c = c2
            d = V.squares(x, c)
            assert (a == d.argmin(axis=1)).all() and n <= d.size
            assert (lower.astype(float) ** 2 <= d + 1e-6).all() and (upper.astype(float) ** 2 >= d.min(axis=1) - 1e-6).all()
        assert (best == d.min(axis=1)).all()


def test_odd_rows(spark):
    good = [(i, [float(i % 7) / 4] * 32, 1) for i in range(5)]
    rows = [*good, (4, [0.5] * 32, None), (None, [0.25] * 32, 2), (6, None, 1), (7, [], 1), (8, [None] + [0.0] * 31, 1), (9, [float("nan")] * 32, 1), (10, [float("inf")] * 32, 1), (11, [1.0] * 16, 1), (12, [3e38] * 32, None)]
    codes, books = V.encode(frame(spark, rows))
    got = codes.collect()
    assert sorted(-1 if r.vec_id is None else r.vec_id for r in got) == [-1, 0, 1, 2, 3, 4, 4, 12] and books.shape == (16, 7, 2)
    assert all(len(r.code) == 32 for r in got)
    short, books = V.encode(frame(spark, [(1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 4.0], 1)]))
    assert {r.error for r in short.collect()} == {0} and books.shape == (16, 2, 1)
    for none in (frame(spark, []), frame(spark, rows[7:11])):
        assert V.encode(none)[0].count() == 0
