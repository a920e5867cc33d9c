"""The trie of conversations: SQL, a plain walk over random conversations, hot prefixes, long conversations, odd rows."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from earshot.llm import conversation_trie as C
from earshot.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth long, hash string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "h") for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, v in sorted(built.items()):
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
            if d:
                children[v[: d - 1]].add(v[:d])
    below = {}
    for p in sorted(members, key=len, reverse=True):
        leaves, saved = int(not children[p]), (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        for x in children[p]:
            leaves, saved = leaves + below[x][0], saved + below[x][1]
        below[p] = leaves, saved
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(p))
        out.add((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    got = QUERIES["op13_conversation_trie"](spark, d)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, con.execute(ORACLE_SQL["op13_conversation_trie"]).fetchall()))


def test_shared_beginnings(spark, monkeypatch):
    """Few texts, so that prefixes meet; one beginning in a third of all; equal conversations; small buckets and pieces."""
    monkeypatch.setattr(C, "BUCKET", 3)
    monkeypatch.setattr(C, "PIECE", 7)
    rng, rows = np.random.default_rng(6), []
    for c in range(400):
        n = int(rng.integers(1, 14))
        texts = ["hello", "", None, "ß long"]
        v = [(c, t, ["user", "bot", None][int(rng.integers(3))] if c % 3 else "user", texts[int(rng.integers(4))] if c % 3 else "same") for t in range(n)]
        rows += [v[i] for i in rng.permutation(n)]
    assert {tuple(r) for r in C.trie(frame(spark, rows)).collect()} == brute(rows)


def test_one_long_conversation_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "BUCKET", 64)
    rows = [(5, t, "user", f"t{t % 50}") for t in range(3000)] + [(7, t, "user", f"t{t % 50}") for t in range(2000)]
    rows += [(8, None, None, None), (8, 1, "a", "x " * 50_000), (None, 0, "user", "no id"), (-3, 0, "user", "t0"), (-5, 1, "user", "t1"), (2**62, 0, "a", "b"), (11, 3, "u", "z"), (11, 3, "u", "z")]
    got = C.trie(frame(spark, rows)).collect()
    want = {c for c in brute([(c, t, r, x) for c, t, r, x in rows if c is None or c >= 0])}
    positive = C.trie(frame(spark, [r for r in rows if r[0] is None or r[0] >= 0])).collect()
    assert {tuple(r) for r in positive} == want and len(positive) == len(want)
    assert sum(r.depth == 0 for r in got) == 1 and min(r.conv_id for r in got) == -5
    assert C.trie(frame(spark, [])).count() == C.trie(frame(spark, [(None, 1, "a", "b")])).count() == 0


def test_roles_and_texts_dont_run_together(spark):
    rows = [(0, 0, "a", "b c"), (1, 0, "a b", "c"), (2, 0, "", "a b c"), (3, 0, "a b c", "")]
    got = {tuple(r) for r in C.trie(frame(spark, rows)).collect()}
    assert got == brute(rows)
