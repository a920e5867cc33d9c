"""Decontamination of edited copies, against brute force over all windows."""

import math
from collections import Counter

import numpy as np
import pytest

from earshot.llm import decontamination

THRESHOLD, K = 0.8, 5


def shingles(words):
    return {tuple(words[i : i + K]) for i in range(max(len(words) - K + 1, 1))} if words else set()


def brute_leaks(docs, items):
    sets = {i: shingles(w) for i, w in items.items()}
    df = Counter(s for v in sets.values() for s in v)
    weight = {s: math.log1p(len(items) / n) for s, n in df.items()}
    unseen = math.log1p(len(items))
    found = set()
    for d, words in docs.items():
        for i, w in items.items():
            if not sets[i] & shingles(words):
                continue
            for at in range(max(len(words) - len(w) + 1, 1)):
                own = shingles(words[at : at + len(w)])
                both = sum(weight[s] for s in own & sets[i])
                either = sum(weight.get(s, unseen) for s in own | sets[i])
                if both >= (THRESHOLD - 1e-9) * either:
                    found.add((d, i))
                    break
    return found


def test_edited_copies_down_to_the_threshold(spark):
    rng = np.random.default_rng(11)
    known = [f"w{i}" for i in range(3000)]
    items = {i: [str(x) for x in rng.choice(known, int(rng.choice([13, 20, 36, 50, 100])), replace=False)] for i in range(40)}
    docs = {}
    for d in range(400):
        w = list(items[int(rng.integers(40))])
        most = int((len(w) - K + 1) * (1 - THRESHOLD) / (1 + THRESHOLD) + 1e-9)
        kind = d % 4
        n = most if kind < 2 else int(rng.integers(1, most + 3))
        places = range(len(w) - n, len(w)) if kind == 0 else range(n) if kind == 1 else rng.choice(len(w), n, replace=False)
        for j in places:
            w[j] = f"x{rng.integers(10**9)}"
        docs[d] = [*(f"y{rng.integers(10**9)}" for _ in range(7)), *w, *(f"y{rng.integers(10**9)}" for _ in range(5))]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    want = brute_leaks(docs, items)
    assert len(want) > 200
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, b).collect()} == want


def edited(rng, words, edits):
    w = list(words)
    for _ in range(int(rng.integers(0, edits + 1))):
        if not w:
            break
        kind, j = int(rng.integers(5)), int(rng.integers(len(w)))
        if kind == 0:
            w.insert(j, f"x{rng.integers(10**9)}")
        elif kind == 1:
            del w[j]
        elif kind == 2:
            w[j] = f"x{rng.integers(10**9)}"
        elif kind == 3 and j + 1 < len(w):
            w[j], w[j + 1] = w[j + 1], w[j]
        elif kind == 4:  # two parts change places
            w = w[j:] + w[:j]
    return w


@pytest.mark.parametrize(("known", "lengths", "edits", "common"), [(3000, [13, 36, 50, 100], 3, 0), (3000, [5, 6, 7, 8, 9, 10, 12], 1, 0), (12, [8, 13, 20, 36, 100], 3, 0), (30, [8, 13, 20, 36, 100], 4, 0), (3000, [20, 40, 80], 3, 40)])
def test_insertions_deletions_swaps_and_moves(spark, known, lengths, edits, common):
    """Also short items, repeated words, and a passage that half of the items share (shingles of unequal weight)."""
    rng = np.random.default_rng(known + edits)
    names, items, docs = [f"w{i}" for i in range(known)], {}, {}
    for i in range(40):
        n = int(rng.choice(lengths))
        w = [str(x) for x in rng.choice(names, n, replace=known < 200)]
        items[i] = w[: n // 2] + [f"c{j}" for j in range(common)][: n // 3] + w[n // 2 : n - n // 3] if common and i % 2 else w
    for d in range(250):
        w = edited(rng, items[int(rng.integers(40))], edits)
        docs[d] = [*(f"y{rng.integers(10**9)}" for _ in range(int(rng.integers(0, 8)))), *w, *(f"y{rng.integers(10**9)}" for _ in range(int(rng.integers(0, 6))))]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    want = brute_leaks(docs, items)
    assert len(want) > 50
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, b).collect()} == want


def test_long_texts_and_extra_columns(spark):
    item = " ".join(f"a{i}" for i in range(40))
    text = ("filler words here " * 30_000) + item.replace("a20", "a20 put in") + " and on " + ("a0 a1 a2 a3 a4 a5 " * 2000) + item
    rows = [(1, text, "w", 3, "s", 1.0), (2, "", "w", 3, "s", 1.0), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, n_words int, word string, similarity double")
    b = spark.createDataFrame([(7, item, "x", 2), (None, item + " more", "x", 2)], "item_id long, text string, shingle string, weight int")
    got = {(r.doc_id, r.item_id, r.similarity) for r in decontamination.find_leaks(df, b).collect() if r.item_id == 7}
    assert got == {(1, 7, 1.0)}


def test_equal_and_missing_ids_and_single_words(spark):
    words = [f"a{i}" for i in range(30)]
    item, other = " ".join(words), " ".join(f"b{i}" for i in range(30))
    rows = [(1, other), (1, item), (None, "nothing of it"), (None, other), (None, item), (2, "x " * 3000 + item), (3, "the word itself"), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (8, other), (9, "ITSELF"), (10, item), (11, " "), (None, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_word) for r in decontamination.find_leaks(df, b).collect()}
    assert got == {(d, i, 0) for d in (1, None) for i in (7, 8, 10)} | {(2, 7, 3000), (2, 10, 3000), (3, 9, 2)}


def test_keys_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_KEYS", 3)
    items = {i: " ".join(f"i{i}_{j}" for j in range(20)) for i in range(6)}
    df = spark.createDataFrame([(i, "before " + t + " after") for i, t in items.items()], "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, b).collect()} == {(i, i) for i in items}


def test_blocks_meet_within_the_radius(spark):
    rng = np.random.default_rng(2)
    for radius in (3, 12, 25):
        a = rng.integers(-(2**63), 2**63 - 1, 200)
        pairs = []
        for x in a.tolist():
            y = x
            for bit in rng.choice(64, int(rng.integers(0, radius + 1)), replace=False).tolist():
                y ^= (1 << bit) if bit < 63 else -(1 << 63)
            pairs.append((x, y))
        df = spark.createDataFrame(pairs, "a long, b long")
        from pyspark.sql import functions as F

        x, _ = decontamination._blocks(F.col("a"), radius)
        y, _ = decontamination._blocks(F.col("b"), radius)
        near = F.exists(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)) <= decontamination.FLIPS), lambda t: t)
        assert df.where(~near).count() == 0
