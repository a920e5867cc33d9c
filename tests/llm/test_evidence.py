"""Language ID and quality against plain Python; repeated ids, ties, very long texts."""

import math
from collections import defaultdict

import numpy as np

from earshot.llm import language_id, quality, quotes

SF = "/root/testdata/sf0.001"


def test_posterior_in_plain_python(spark):
    """The fusion of three languages, row by row, with the row's own share taken out."""
    rng = np.random.default_rng(4)
    names = ["a", "b", "c"]
    rows = []
    for i in range(60):
        ll = (rng.normal(size=3) * 3).tolist() if i % 7 else [0.0, 0.0, 0.0]
        rows.append((i, [None, "a", "b"][i % 3], [None, "x", "y", "x"][i % 4], [None, "h.x", "g.h.x", "z"][(i // 2) % 4], [None, "h.x", "h.x", "z"][(i // 2) % 4], int(bool(i % 7)), ll))
    soft = lambda v: [math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v]
    df = spark.createDataFrame([(*r, soft(r[-1])) for r in rows], "id long, declared string, suffix string, host string, domain string, n_grams long, ll array<double>, post array<double>")
    got = {r.id: r for r in language_id.fuse(df, names).collect()}
    told = [r for r in rows if r[5]]
    total = [sum(soft(r[6])[k] for r in told) for k in range(3)]
    sums = [defaultdict(lambda: [0.0] * 3) for _ in range(4)]
    for r in told:
        for s, key in zip(sums, r[1:5], strict=True):
            if key is not None:
                s[key] = [x + y for x, y in zip(s[key], soft(r[6]), strict=True)]
    A, K = language_id.ALPHA, language_id.KAPPA
    for r in rows:
        own = soft(r[6]) if r[5] else [0.0] * 3
        score = []
        for k in range(3):
            prior = (total[k] + A) / (len(told) + 3 * A)
            d, h = (sums[j][r[j + 1]] if r[j + 1] in sums[j] else [0.0] * 3 for j in (3, 2))
            domain = (max(d[k] - own[k], 0) + K * prior) / (max(sum(d) - sum(own), 0) + K)
            host = (max(h[k] - own[k], 0) + K * domain) / (max(sum(h) - sum(own), 0) + K)
            x = r[6][k] + math.log(prior if r[3] is None else host)
            for j in (0, 1):
                if r[j + 1] in sums[j]:
                    v = sums[j][r[j + 1]]
                    x += math.log(max(max(v[k] - own[k], 0) + A * sum(v) / len(told), 1e-9) / (total[k] + A))
            score.append(x)
        p = soft(score)
        assert np.allclose(got[r[0]].posterior, p, atol=1e-9) and got[r[0]].lang == names[int(np.argmax(p))]
        assert got[r[0]].text_lang == (names[int(np.argmax(r[6]))] if r[5] else "und")


def test_many_languages_and_ties(spark):
    word = lambda i: f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(110 + i // 26)} "
    docs = spark.createDataFrame([(i, word(i) * 30, f"l{i}", None) for i in range(80)] + [(200, None, "l0", None), (201, "", "l1", None), (202, word(7) * 40_000, None, None)], "doc_id long, text string, lang string, source string")
    got = {r.id: r.lang for r in language_id.identify_documents(docs).collect()}
    assert all(got[i] == f"l{i}" for i in range(80)) and got[202] == "l7" and len(got) == 83


def test_dual_objective_of_the_descent():
    """Against projected gradient steps on the same dual problem, until they settle."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    y = np.where(rng.random(60) < 0.4, 1.0, -1.0)
    ratio = rng.normal(size=30)
    w, bias = quality.descend(rows, y, ratio, rounds=2000)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / math.sqrt(max(float(ratio[r] @ ratio[r]), 1e-12))
        x[i, 30] = 1
    top = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    q = (y[:, None] * x) @ (y[:, None] * x).T
    alpha, step = np.zeros(60), 1 / np.linalg.norm(q, 2)
    for _ in range(100_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, top)
    best = (alpha * y) @ x
    primal = lambda v: 0.5 * v @ v + (top * np.maximum(1 - y * (x @ v), 0)).sum()
    own = np.append(np.divide(w, ratio), bias)
    assert abs(primal(own) - primal(best)) < 0.01 * primal(best)


def test_learning_is_the_same_for_any_order(spark):
    texts = ["good fine words here", "bad words there !!!", "fine again", "!!! $$$ bad"] * 20
    rows = [(i, f"{t} {i}") for i, t in enumerate(texts)] + [(3, "another text of the same id"), (3, "a third one")]
    labels = spark.createDataFrame([(i, int("bad" not in t), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    models = [quality.learn(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 4))]
    assert (models[0]["w"] == models[1]["w"]).all() and models[0]["a"] == models[1]["a"]


def test_quotes_of_many_lines_and_far_conversations(spark):
    long = "\n".join(f"line number {i} of a very long message" for i in range(3000))
    rows = [(1, 0, long), (1, 1, "\n".join("> " + x for x in long.split("\n")) + "\nI agree"), (2, 0, "> " + long.split("\n")[17] + "\nWhat?"), (3, 0, "One two three four five"), (3, 0, "One two three four five"), (3, 1, "> One two three four five\n> \n>> deeper words not found\nyes")]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(df).collect()}
    assert (got[1, 1].reply_to_turn, got[1, 1].text) == (0, "I agree")
    assert (got[2, 0].reply_to_conv, got[2, 0].reply_to_turn) == (1, 0)
    assert (got[3, 1].reply_to_turn, got[3, 1].max_level, got[3, 1].text) == (0, 2, "yes")
