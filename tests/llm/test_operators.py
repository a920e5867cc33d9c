"""The operators of earshot.llm against brute force on small tables, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokenizers_
import pytest
from tokenizers import Tokenizer

from earshot.llm import decontamination, jpeg, language_id, licenses, ngram_join, packing, quality, quotes, rans, token_counts
from earshot.llm.queries import QUERIES
from earshot.llm.tokens import PieceEncoder

SF = "/root/testdata/sf0.001"
BYTE, WORD = tokenizers_.path("byte_bpe_50k.json"), tokenizers_.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, words string, class string"
LONG = "lorem ipsum dolor " * 30_000
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the farm today", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs away from the farm today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the farm today", "en", None),
    (3, "", "en", "a"),
    (4, None, None, None),
    (5, LONG, "en", "b"),
    (6, "ß\t ÀÉ  中文 ́ <|endoftext|> x\n\n\ny \xa0 don't I'LL", "de", "b"),
    (None, "a text without an id", "en", "b"),
    (7, "one", "fr", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*x, len(x[1] or ""), 9, "w", "c") for x in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def ids_of(path, text, end):
    return np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [end], "<u4")


ODD_TEXTS = ["", "a", "\n", "a\n", "a\n\n", "a\n\nb", "a\n\n\nb", " a", "a  b", "a\tb", " \n a", "don't I'LL <|endoftext|> x", "x <|startoftext|>y", "中文 ́a   b\xa0c", "\0a \0", "ÀÉ ß ſ ŉ", "a\x85b \x1cc", "é ﬁ ½", "'s 's\n's", "İI i̇"]


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte_level"), (WORD, "word_end")])
def test_pieces_give_the_librarys_ids(docs, path, kind):
    e, t = PieceEncoder(path, kind, most=500), Tokenizer.from_file(path)
    texts = list(texts_of(docs).values()) + ODD_TEXTS
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte_level"), (WORD, "word_end")])
def test_cached_pieces_and_pre_tokens_dont_mix(path, kind):
    """Words alone, with stops, at the start, after a space or a line, in any order, through one cache."""
    rng, e, t = np.random.default_rng(5), PieceEncoder(path, kind, most=300), Tokenizer.from_file(path)
    words = ["a", "A", "it", "It's", "'s", "s", "''s", ".", "?'", "12", "x1", "é", "É", "İ", "i̇", "ж", "\0", "\0a", "\1", "\1ж", "\1i̇", "\n", "\n\n", "foo,", "foo", "Foo", "foo.bar", "--", "<|"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.integers(1, 9))) for _ in range(3000)]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [1, 5, 300, 70_000, 2_500_000])
def test_segments_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50256).astype(np.uint32)
    s = rans.Segment(rans.pack_segment([7], [n], ids))
    assert (s.ids() == ids).all() and s.doc_ids == [7]
    if n > rans.LANES * rans.STEPS:  # from a checkpoint inside a block
        assert (s.block(0, 1) == ids[: rans.BLOCK_IDS][rans.LANES * rans.STEPS :]).all()
    broken = bytearray(rans.pack_segment([7], [n], ids))
    broken[-1] ^= 1
    if n >= 300:
        with pytest.raises((ValueError, IndexError)):
            rans.Segment(bytes(broken)).ids()


def test_op1(spark, docs, odd, none, tmp_path):
    want, at = texts_of(docs), 0
    for r in QUERIES["op1_rans_ids"](spark, SF).orderBy("doc_id").collect():
        ids = ids_of(BYTE, want[r.doc_id], 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rans.write_ids(odd, str(tmp_path / "odd"), BYTE)
    got = rans.read_ids(spark, str(tmp_path / "odd"), with_ids=True).collect()
    assert len(got) == len(ODD) and next(r for r in got if r.doc_id == 4).ids == [2]
    rans.write_ids(none, str(tmp_path / "none"), BYTE)
    assert rans.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_jpeg_round_trip_and_broken():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 64 * k, dtype=np.uint8).tobytes() for k in (1, 2, 9, 33, 9000)] + [b"\0" * 64, b"\xff" * 128]
    media = jpeg.encode_payloads(payloads)
    got = jpeg.decode_many([*media, None, b"abc", media[2][:100], media[1] + b"x"])
    for p, x in zip(payloads, got, strict=False):
        assert b"".join(t.tobytes() for _, t in x) == p
    assert [im.height for im, _ in got[4]] == [8191 * 8, 809 * 8]
    assert all(isinstance(x, jpeg.Broken) for x in got[len(payloads) :])


def test_op2(spark, docs, odd, none):
    want = texts_of(docs)
    for r in QUERIES["op2_jpeg_media"](spark, SF).collect():
        raw = want[r.doc_id].encode()
        p = raw.ljust(max(-(-len(raw) // 64), 1) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    got = jpeg.thumbnails(jpeg.texts_to_media(odd)).collect()
    assert len(got) == len(ODD) and all(r.error is None for r in got)
    assert jpeg.thumbnails(jpeg.texts_to_media(none)).count() == 0


def test_op3(docs, odd, none):
    for df in (docs, odd):
        want = texts_of(df)
        for r in token_counts.count_tokens(df, BYTE, block_chars=20_000).collect():
            text = want[r.doc_id]
            assert (r.n_tokens, r.n_bytes) == (len(ids_of(BYTE, text, 0)) - 1, len(text.encode()))
            assert r.over_limit == (r.n_tokens > 1024)
    assert token_counts.count_tokens(none, BYTE).count() == 0


def test_op4(spark):
    rows = [(1, 0, "u", "Hello there, how do you install this thing?"), (1, 1, "a", "First read the manual, please.\nThen run it."), (1, 2, "u", "Unrelated new topic here, sorry."), (1, 3, "a", "Anna wrote:\n> Hello there, how do\n> you install this thing?\n\nUse the installer package."), (1, 4, "u", "> Use the installer package.\n>> hello there, how do you install this THING?\nThanks a lot for that"), (2, 0, "u", "> First read the manual, please.\nWhich manual?"), (2, 1, "a", None), (None, 1, "x", "y"), (2, 1, "a", None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, thread string")
    got = quotes.conversations(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert (by[1, 3].reply_to_turn, by[1, 4].reply_to_turn, by[1, 4].depth, by[1, 4].thread, by[1, 4].max_level) == (0, 3, 2, 0, 2)
    assert by[1, 3].text == "Use the installer package." and by[1, 4].text == "Thanks a lot for that"
    assert (by[2, 0].reply_to_conv, by[2, 0].reply_to_turn) == (1, 1)
    assert [t for _, t in sorted((r.position, r.turn) for r in got if r.conv_id == 1)] == [0, 3, 4, 1, 2]
    assert quotes.conversations(df.where("false")).count() == 0
    assert QUERIES["op4_quotation_threads"](spark, SF).count() == spark.read.parquet(f"{SF}/conversations.parquet").count()


@pytest.mark.parametrize("limits", [packing.Limits(64, 5, 50), packing.Limits(64, 64, 64), packing.Limits(32, 1, 32)])
def test_packer(limits):
    rng, packer, out, given = np.random.default_rng(3), packing.Packer(limits, group=40), [], {}
    for i in range(300):
        given[i] = rng.integers(0, 1000, int(rng.integers(1, 200))).astype(np.uint32)
        out += packer.add(i, given[i], int(rng.integers(0, 20)))
    out += packer.finish()
    docs_, sequences = defaultdict(list), defaultdict(list)
    for o in out:
        docs_[o[0]].append(o)
        sequences[o[4]].append(o)
    for k, v in docs_.items():
        v.sort(key=lambda o: o[1])
        assert (np.concatenate([o[2] for o in v]) == given[k]).all() and v[0][3] == len(given[k])
    for v in sequences.values():
        v.sort(key=lambda o: o[5])
        assert [o[5] for o in v] == np.cumsum([0, *[len(o[2]) for o in v[:-1]]]).tolist()
        assert sum(len(o[2]) for o in v) <= limits.tokens and len(v) <= limits.segments and sum(o[7] for o in v) <= limits.loss_tokens
    assert len(docs_) == 300


def test_op5(spark, docs, odd, none):
    rows, want = QUERIES["op5_vector_packing"](spark, SF).collect(), texts_of(docs)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(want)
    for d, v in by.items():
        ids, at = ids_of(WORD, want[d], 1), 0
        for r in sorted(v, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    total, sequences = sum(r.length for r in rows), {r.sequence_id for r in rows}
    assert total / (2048 * len(sequences)) > 0.95
    assert {r.doc_id for r in packing.pack(odd, WORD).collect()} == {1, 2, 3, 4, 5, 6, 7, None}
    assert packing.pack(none, WORD).count() == 0


def test_op6(spark, docs, odd, none):
    rows = QUERIES["op6_bayesian_language_id"](spark, SF).collect()
    assert sum(r.lang == r.declared for r in rows) >= 0.95 * len(rows)
    pages = spark.createDataFrame([(1, "https://x.example.de/a", '<html lang="en"><script>the the the</script><p>der die das und nicht ist ein</p>'), (2, None, None), (3, "nothing", ""), (3, "nothing", "")], "page_id long, url string, html string")
    assert sorted(r.id for r in language_id.identify_pages(pages, docs).collect()) == [1, 2, 3, 3]
    assert language_id.identify_documents(odd).count() == len(ODD)
    assert language_id.identify_documents(none).count() == 0
    told = language_id.identify_documents(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(r.lang == lang[r.id] for r in told) >= 0.98 * len(told)
    assert language_id.text_of_page("<p>a<!-- x -->b&amp;c</p>") == (" a b&c ", None)


def test_op7(spark, docs, odd, none):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def lower(t):
        return re.sub("[A-Z]", lambda m: m[0].lower(), t)

    templates = {label: set(rx.findall(lower(t))) for label, t in licenses.TEMPLATES.items()}
    want = texts_of(docs)
    for r in QUERIES["op7_license_scan"](spark, SF).collect():
        words = rx.findall(lower(want[r.doc_id]))
        at, base, labels = [], set(), set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at += found
            base |= {label} if found else set()
        for line in lower(want[r.doc_id]).split("\n"):
            own = set(rx.findall(line))
            labels |= {label for label, t in templates.items() if len(own & t) >= 0.8 * len(t) - 1e-9}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(base | labels)))
    documents, matches = licenses.scan(odd)
    assert documents.count() == len(ODD) and matches.count() == 0
    assert licenses.scan(none)[0].count() == 0


def brute_components(texts, k, percent):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        n = min(k, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    held, common = defaultdict(list), Counter()
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    for v in held.values():
        common.update((a, b) for i, b in enumerate(v) for a in v[:i])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("rounds", [0, 3])
def test_op8(spark, docs, odd, none, monkeypatch, rounds):
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", rounds)
    want = brute_components(texts_of(docs), 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, 4, 85).collect()} == want
    if not rounds:
        return
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    near = []
    for i in range(80):  # one large group of near copies, some of them apart
        w = list(base)
        for j in rng.integers(0, 60, int(rng.integers(0, 5))):
            w[j] = f"x{rng.integers(0, 9)}"
        near.append((i, " ".join(w)))
    df = spark.createDataFrame(near, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, 4, 70).collect()} == brute_components(dict(near), 4, 70)
    got = ngram_join.jaccard_components(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert ngram_join.jaccard_components(none).count() == 0


def test_op9(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_nb_support_vectors"](spark, sf).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    up, down = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in down] for a in up]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    labels = spark.createDataFrame([(1, 1, None), (5, 0, None), (None, 1, None), (2, None, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    for df in (odd, none):
        assert quality.score(df, quality.learn(df, labels)).count() == df.count()
        assert quality.score(df, quality.learn(df, labels.where("false"))).count() == df.count()


def test_op10(spark, docs, odd, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(d, i) for d, t in texts_of(docs).items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == want
    words = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten eleven twelve").split()
    near = [*words]
    near[-1] = "thirteen"
    df = spark.createDataFrame([(1, "Before that: " + " ".join(words).upper() + ". And after."), (2, " ".join(near)), (3, " ".join(words[::-1])), (4, None), (None, " ".join(words)), (1, "x")], "doc_id long, text string")
    b = spark.createDataFrame([(9, " ".join(words)), (10, None), (11, ""), (12, "word")], "item_id long, text string")
    assert {r.doc_id for r in decontamination.find_leaks(df, b).collect()} == {1, 2, None}
    assert decontamination.find_leaks(none, b).count() == decontamination.find_leaks(df, b.where("false")).count() == 0
