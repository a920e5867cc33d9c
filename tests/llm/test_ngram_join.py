"""The n-gram join: frequent shingles, repeated and missing doc_ids, wide length ratios, very long texts."""

import numpy as np
import pytest

from earshot.llm import ngram_join, rare_shingles

from .test_operators import brute_components


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_small_blocks_and_hot_shingles(spark, monkeypatch):
    """Several blocks and buckets; passages that most documents hold, groups of near copies, exact copies."""
    def small(texts, k, percent, shingles, seed=0):
        return rare_shingles.shared_sets(texts.repartition(3, "doc_id"), k, percent, shingles, seed, block_size=700, hot_from=6, bits=6)

    monkeypatch.setattr(ngram_join, "shared_sets", small)
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(25)]
    bases = [[f"b{g}_{i}" for i in range(50)] for g in range(12)]
    rows = []
    for d in range(260):
        w = list(bases[int(rng.integers(12))])
        for j in rng.integers(0, 50, int(rng.integers(0, 4))):
            w[j] = f"x{rng.integers(0, 40)}"
        if d % 3:
            w = passage + w
        rows.append((d, " ".join(w)))
    rows += [(300 + i, rows[i][1]) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows), 4, 75).collect()}
    assert got == brute_components(dict(rows), 4, 75)


def test_equal_ids_with_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, None), (5, ""), (None, a), (6, "one"), (7, "one"), (8, "unlike all others here")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows)).collect())
    assert [(d, c) for d, _, c in got] == [(0, None), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8)]


def test_far_sizes(spark):
    long = [f"w{i}" for i in range(10_003)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:1_003])), (3, " ".join(long[:999]))]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(frame(spark, rows), 4, 10).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("n", [0, 1, 70_000])
def test_packed_keys(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 48, n, dtype=np.uint64))
    assert (rare_shingles._unpacked(rare_shingles._packed(keys)) == keys).all()
