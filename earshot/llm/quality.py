"""Quality classifier: naive Bayes support vectors.

Indicators of word n-grams (single words, pairs) and of byte groups of a text's shape are hashed to a fixed number of
features. Each is scaled by the log ratio of its smoothed counts in the two classes, counted by a grouped aggregation; a
linear model with hinge loss is fitted on the scaled indicators by dual coordinate descent; a logistic curve, fitted on
a quarter of the rows that neither the counts nor the descent have seen, turns its margin into a score.

Labels are learnt from rows whose crc32(doc_id as text) mod 5 is not 0, at most ``MAX_TRAIN`` of them (the smallest by a
hash of doc_id): the one bounded sample here, a parameter. Every row of the table is scored, on its whole text.

Edge cases: a null or empty text has no indicator and gets the score of the intercept; labels that are null or whose
document is missing are left out; a doc_id labelled twice counts once, with the smaller label; of different texts of one
doc_id the smallest is learnt from; without labels of both classes every score is the share of label 1 (0.5 without
labels); equal rows get equal scores, a score of exactly the threshold is predicted as 1; a very long text is hashed in a
run of its own; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stage, table, texts_of
from .hashing import batches_of, mix, spans, word_hashes

MAX_TRAIN = 8_000
WORD_BITS = 18
#: Classes of bytes for the shape groups (four bits): lower case, upper case, digit, beyond ASCII, space, newline, then single signs.
SIGNS = "!*$%&#|.,"


def _classes() -> np.ndarray:
    c = np.full(256, 15, np.uint8)
    c[ord("a") : ord("z") + 1], c[ord("A") : ord("Z") + 1], c[ord("0") : ord("9") + 1], c[128:] = 0, 1, 2, 3
    c[ord(" ")], c[ord("\n")] = 4, 5
    for k, s in enumerate(SIGNS):
        c[ord(s)] = 6 + k
    return c


CLASS = _classes()
SHAPES = 1 << 12
FEATURES = (1 << WORD_BITS) + SHAPES


def features_of(texts: list[str]):
    """Yields each text's features, distinct and ascending: words and pairs of words, then groups of three byte classes."""
    for a, b in batches_of(texts):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts[a:b]]
        begins = np.cumsum([0, *[len(p) + 1 for p in parts]])
        raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        starts, ends = spans(raw)
        h = word_hashes(raw, starts, ends)
        owner = np.searchsorted(begins, starts, "right") - 1
        with np.errstate(over="ignore"):
            pair = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
        same = owner[:-1] == owner[1:]
        shift = np.uint64(64 - WORD_BITS)
        key = np.concatenate([(owner.astype(np.int64) << WORD_BITS) | (h >> shift).astype(np.int64), (owner[:-1][same].astype(np.int64) << WORD_BITS) | (pair[same] >> shift).astype(np.int64)])
        key = np.unique(key)
        cut = np.searchsorted(key, np.arange(b - a + 1, dtype=np.int64) << WORD_BITS)
        word = (key & ((1 << WORD_BITS) - 1)).astype(np.int32)
        c = CLASS[raw].astype(np.int64)
        n = len(raw)
        of = np.repeat(np.arange(b - a), np.diff(begins))
        if n >= 3:
            group = (c[:-2] << 8) | (c[1:-1] << 4) | c[2:]
            inside = of[:-2] == of[2:]
            seen = np.bincount((of[:-2] * SHAPES + group)[inside], minlength=(b - a) * SHAPES).reshape(b - a, SHAPES) > 0
        else:
            seen = np.zeros((b - a, SHAPES), bool)
        for i in range(b - a):
            yield np.concatenate([word[cut[i] : cut[i + 1]], np.flatnonzero(seen[i]).astype(np.int32) + (1 << WORD_BITS)])


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss. Rows are scaled to unit length; (weights of the bare indicators, intercept)."""
    w, bias = np.zeros(len(ratio)), 0.0
    values = [ratio[r] for r in rows]
    length = np.array([float(v @ v) for v in values])
    scale = 1 / np.sqrt(np.maximum(length, 1e-12))
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    share = np.bincount((y > 0).astype(int), minlength=2) / max(len(y), 1)
    top = np.where(y > 0, cost * 0.5 / max(share[1], 1e-9), cost * 0.5 / max(share[0], 1e-9))
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            v = values[i]
            g = y[i] * (scale[i] * float(w[rows[i]] @ v) + bias) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), top[i])
            if (step := new - alpha[i]) != 0.0:
                alpha[i] = new
                w[rows[i]] += (step * y[i] * scale[i]) * v
                bias += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w * ratio, bias


def margins(rows, w: np.ndarray, norm: np.ndarray, bias: float) -> np.ndarray:
    """``norm``: squared ratios, for the same scaling to unit length as in the descent."""
    return np.array([float(w[r].sum()) / np.sqrt(max(float(norm[r].sum()), 1e-12)) + bias for r in rows])


def logistic_curve(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), by Newton steps on targets drawn in a little from 0 and 1."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * m * m).sum() + 1e-6, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [(g * m).sum(), g.sum()])
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-7:
            break
    return a, b


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> dict:
    """The model: weights of indicators, squared ratios, intercept, curve. Bounded by ``FEATURES`` and ``max_train``."""
    y = F.col(label).cast("int")
    own = labels.where(F.col("doc_id").isNotNull() & y.isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(y).alias("y"))
    own = own.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = stage(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "chosen")

    def rows(batches):
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(features_of(b.column(1).to_pylist())), pa.list_(pa.int32()))], names=["doc_id", "y", "features"])

    # max_train rows of 12 bytes: bounded, whatever the table's size
    train = texts_of(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    train = stage(train.select("doc_id", "text", "y").mapInArrow(rows, "doc_id long, y int, features array<int>"), "train")
    # a quarter is kept for the curve alone, by a hash of doc_id
    unseen = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(4)) == 0
    train = train.withColumn("kept", unseen.cast("int"))
    counts = train.where("kept = 0").select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").alias("up"), F.count("*").alias("n"))

    def fit(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending")])
        is_row = part.column("features").is_valid().to_numpy()
        table_ = part.filter(pa.array(~is_row))
        part = part.filter(pa.array(is_row))
        labels_ = part.column("y").to_numpy().astype(np.int64)
        feats = [np.asarray(x.values) for x in part.column("features")]
        up, all_ = np.ones(FEATURES), np.full(FEATURES, 2.0)
        f = table_.column("f").to_numpy()
        up[f] += table_.column("up").to_numpy()
        all_[f] += table_.column("n").to_numpy()
        down = all_ - up
        ratio = np.log((up / up.sum()) / (down / down.sum()))
        sign = labels_ * 2.0 - 1
        kept = part.column("kept").to_numpy() == 1
        w, bias = descend([x for x, t in zip(feats, kept, strict=True) if not t], sign[~kept], ratio)
        curve = logistic_curve(margins([x for x, t in zip(feats, kept, strict=True) if t], w, ratio**2, bias), labels_[kept])
        return pa.table({"w": pa.array([w.astype("<f4").tobytes()], pa.binary()), "norm": pa.array([(ratio**2).astype("<f4").tobytes()], pa.binary()), "bias": [float(bias)], "a": [float(curve[0])], "b": [float(curve[1])]})

    share = train.agg(F.count("*").alias("n"), F.sum("y").alias("up")).first()
    n, up = share.n or 0, share.up or 0
    if up in (0, n):
        return {"w": np.zeros(FEATURES, np.float32), "norm": np.zeros(FEATURES, np.float32), "bias": 0.0, "a": 0.0, "b": 0.0 if not n else 30.0 if up else -30.0}
    empty = "cast(null as long) doc_id", "cast(null as int) y", "cast(null as array<int>) features", "cast(null as int) kept"
    both = train.selectExpr("0 g", "doc_id", "y", "features", "kept", "cast(null as int) f", "cast(null as long) up", "cast(null as long) n").unionByName(counts.selectExpr("0 g", *empty, "f", "up", "n"))
    m = both.groupBy("g").applyInArrow(fit, "w binary, norm binary, bias double, a double, b double").first()
    return {"w": np.frombuffer(m.w, "<f4"), "norm": np.frombuffer(m.norm, "<f4"), "bias": m.bias, "a": m.a, "b": m.b}


def score(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        m = sent.value
        for b in small(batches):
            x = margins(features_of(b.column(1).to_pylist()), m["w"], m["norm"], m["bias"])
            s = 1 / (1 + np.exp(-np.clip(m["a"] * x + m["b"], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return texts_of(docs).mapInArrow(rows, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_nb_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
