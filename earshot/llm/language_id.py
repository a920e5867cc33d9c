"""Language ID: Bayesian fusion of what the text, its markup, its address and its host say.

For each row and language the log posterior is the sum of

* the text's log likelihood under a byte-trigram model of each language, tempered: trigrams overlap and depend on each
  other, so each counts ``TEMPER``;
* the log likelihood of the declared markup language, and of the address suffix, given the language. Both tables are
  learnt from this corpus: a grouped aggregation of the rows' text posteriors, smoothed. A missing declaration, or one
  never seen, says what it says about all languages alike;
* the log prior of the host. Hosts are smoothed towards their parent domain, domains towards the whole corpus, each by
  ``KAPPA`` rows; the row's own share is taken out of its host's and domain's sums first.

The grouped tables have a row per host, domain, declaration or suffix; they meet the rows in ordinary joins (broadcast
only where Spark measures them small, split where adaptive execution finds a hot host). Trigram counts come from a
bounded sample of labelled rows (``MAX_TRAIN``, the smallest by a hash of doc_id); the languages are those of the sample.
Everything else covers all rows.

Edge cases: a null or empty text has no likelihood of its own, the other evidence decides; with no evidence at all the
corpus prior does, and ``n_grams`` is 0; equal rows get the same language; of equal posteriors the language that is more
frequent in the sample wins; a very long text weighs as ``MOST_GRAMS`` trigrams, all of it is read; null hosts, declarations and suffixes each
count as a value of their own that says nothing; an empty table gives no row; without labelled rows there is no language
and the result is "und".
"""

from __future__ import annotations

import html as html_
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stage, table
from .hashing import LOWER

MAX_TRAIN = 6_000
GRAM_BITS = 15
TEMPER, MOST_GRAMS = 0.25, 400
ALPHA, KAPPA = 1.0, 5.0

_HIDDEN = re.compile(r"<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_LANG = re.compile(r"""<html\b[^>]*?\slang\s*=\s*["']?\s*([A-Za-z]+)""", re.I)


def text_of_page(html: str) -> tuple[str, str | None]:
    """The visible text, and the language that the markup declares (first subtag, lower case)."""
    found = _LANG.search(html)
    return html_.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", html))), found[1].lower() if found else None


def grams(text: str) -> np.ndarray:
    """Hashed byte trigrams, A-Z in lower case; groups of digits, signs and spaces alone don't count."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(LOWER), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    some = letter[:-2] | letter[1:-1] | letter[2:]
    b = np.where(letter, b, 32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    with np.errstate(over="ignore"):
        return ((code[some] * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)


def learn_text_model(docs: DataFrame, label: str = "lang", max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages (those of the sample, most frequent first), and log probabilities of trigrams, one row per language."""
    named = docs.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("lang"))
    chosen = stage(named.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(max_train), "chosen")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in small(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << GRAM_BITS, np.int64)
                sums[lang] += np.bincount(grams(text), minlength=1 << GRAM_BITS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "gram", "n"])

    # max_train rows: bounded, whatever the table's size
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col(label).alias("lang")).join(F.broadcast(chosen), ["doc_id", "lang"])
    rows = train.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # bounded by the sample: the trigrams of max_train texts
    rows = stage(rows, "grams")
    languages = [r.lang for r in rows.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()]
    got = rows.toPandas() if languages else None
    logp = np.zeros((len(languages), 1 << GRAM_BITS), np.float32)
    for k, lang in enumerate(languages):
        own = got[got["lang"] == lang]
        n = np.full(1 << GRAM_BITS, 0.5)
        n[own["gram"].to_numpy(np.int64)] += own["n"].to_numpy(np.float64)
        logp[k] = np.log(n / n.sum())
    return languages, logp


def score_texts(rows: DataFrame, model: tuple[list[str], np.ndarray], is_html: bool) -> DataFrame:
    """(id, declared, suffix, host, domain, n_grams, ll, post): the tempered log likelihoods per language, in the model's
    order, and what they say alone.

    ``rows``: id, text, declared, suffix, host. Of a page, the declaration comes from its markup.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model[1])

    def score(batches):
        logp = sent.value
        for b in small(batches):
            declared, ll, size = b.column(2).to_pylist(), [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if is_html:
                    text, declared[i] = text_of_page(text)
                g = grams(text)
                size.append(len(g))
                factor = TEMPER * min(1.0, MOST_GRAMS / max(len(g), 1))
                ll.append((logp[:, g].sum(axis=1, dtype=np.float64) * factor) if len(g) else np.zeros(len(logp)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(declared, pa.string()), b.column(3), b.column(4), pa.array(size, pa.int64()), pa.array(ll, pa.list_(pa.float64())), pa.array(list(_softmax(np.array(ll))) if len(logp) else ll, pa.list_(pa.float64()))], names=["id", "declared", "suffix", "host", "n_grams", "ll", "post"])

    out = rows.select("id", F.coalesce("text", F.lit("")).alias("text"), "declared", "suffix", "host").mapInArrow(score, "id long, declared string, suffix string, host string, n_grams long, ll array<double>, post array<double>")
    parts = F.split("host", r"\.")
    domain = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(F.col("host"))
    return out.withColumn("domain", domain)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sums(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Per value of ``key``: the sum of text posteriors for each language."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.sum(F.get("post", F.lit(i))) for i in range(n)]).alias(f"{key}_n"))


def _dense(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``n`` numbers, 0 where the column is null; where it isn't."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), n))
    out[known] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out, known


def _fused(languages: list[str], total: np.ndarray, told: int):
    """From (id, ll, post, n_grams, declared, suffix, host) and the sums of the row's keys to the posterior."""
    n = len(languages)
    prior = (total + ALPHA) / (told + ALPHA * n)
    names = pa.array(languages, pa.string())

    def rows(batches):
        for b in batches:
            ll, post = (_dense(b.column(c), n)[0] for c in ("ll", "post"))
            some = b.column("n_grams").to_numpy() > 0
            own = post * some[:, None]
            mine = own.sum(axis=1, keepdims=True)

            def share(all_, above):
                return (np.maximum(all_ - own, 0) + KAPPA * above) / (np.maximum(all_.sum(axis=1, keepdims=True) - mine, 0) + KAPPA)

            host = share(_dense(b.column("host_n"), n)[0], share(_dense(b.column("domain_n"), n)[0], prior))
            named = b.column("host").is_valid().to_numpy(zero_copy_only=False)[:, None]
            score = ll + np.log(np.where(named, host, prior))
            for key in ("declared", "suffix"):
                all_, known = _dense(b.column(f"{key}_n"), n)
                seen = np.maximum(all_ - own, 0) + ALPHA * all_.sum(axis=1, keepdims=True) / max(told, 1)
                score += np.where(known[:, None], np.log(np.maximum(seen, 1e-9) / (total + ALPHA)), 0)
            p = _softmax(score) if len(score) else score
            lang = names.take(pa.array(p.argmax(axis=1)))
            text = pa.array([x if y else "und" for x, y in zip(names.take(pa.array(post.argmax(axis=1))).to_pylist(), some, strict=True)], pa.string())
            columns = [b.column("id"), lang, pa.array(p.max(axis=1)), text, *(b.column(c) for c in ("declared", "suffix", "host", "n_grams")), pa.array(list(p), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lang", "confidence", "text_lang", "declared", "suffix", "host", "n_grams", "posterior"])

    return rows


def fuse(scored: DataFrame, languages: list[str]) -> DataFrame:
    """(id, lang, confidence, text_lang, declared, suffix, host, n_grams, posterior) of every scored row."""
    n = len(languages)
    if not n:
        none = F.array().cast("array<double>")
        return scored.select("id", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), "declared", "suffix", "host", "n_grams", none.alias("posterior"))
    first = stage(scored, "scored")
    # the corpus prior, one row; rows without text say nothing about it
    told = first.where("n_grams > 0")
    whole = told.agg(*[F.coalesce(F.sum(F.get("post", F.lit(i))), F.lit(0.0)).alias(f"t{i}") for i in range(n)], F.count("*").alias("m")).first()
    total = np.array([whole[f"t{i}"] for i in range(n)])
    rows = first
    for key in ("declared", "suffix", "host", "domain"):
        rows = rows.join(_sums(told, key, n), key, "left")
    rows = rows.select("id", "ll", "post", "n_grams", "declared", "suffix", "host", "declared_n", "suffix_n", "host_n", "domain_n")
    return rows.mapInArrow(_fused(languages, total, whole.m), "id long, lang string, confidence double, text_lang string, declared string, suffix string, host string, n_grams long, posterior array<double>")


def address(url) -> tuple[F.Column, F.Column]:
    """Host (lower case, without "www.") and suffix of an address."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    return host, F.when(F.instr(host, ".") > 0, F.regexp_extract(host, r"([^.]+)$", 1))


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html); the text model is learnt from ``docs`` (doc_id, text, lang)."""
    host, suffix = address(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("html").alias("text"), F.lit(None).cast("string").alias("declared"), suffix.alias("suffix"), host.alias("host"))
    model = learn_text_model(docs)
    return fuse(score_texts(rows, model, is_html=True), model[0])


def identify_documents(docs: DataFrame) -> DataFrame:
    """The same for plain texts: ``lang`` is what they declare, ``source`` their host."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))
    model = learn_text_model(docs)
    return fuse(score_texts(rows, model, is_html=False), model[0])


def op6_bayesian_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("page_id"), "lang", "confidence", "text_lang", "declared", "suffix", "host", "n_grams")
