"""JPEG features of texts that take more than one image."""

import os

import numpy as np
import pytest

from earshot.llm import jpeg


def test_feature_takes_all_images(spark):
    first, rest = "lorem ipsum " * 43_685 + "abcd", "a" * 20_000 + "z" * 20_000
    assert len(first) == 8191 * 64
    df = spark.createDataFrame([(1, first + rest), (2, first + rest[::-1]), (3, first)], "doc_id long, text string")
    got = {r.doc_id: r for r in jpeg.thumbnails(jpeg.texts_to_media(df)).collect()}
    assert got[1].n_images == got[2].n_images == 2 and got[3].n_images == 1
    assert got[1].thumb_hash != got[2].thumb_hash
    assert {got[1].thumb_hash.split("+")[0], got[2].thumb_hash.split("+")[0]} == {got[3].thumb_hash}


@pytest.mark.parametrize("counts", [[0] * 11 + [5], [1] * 12, [2**k for k in range(12)], [3, 0, 9, 9, 0, 0, 1, 40, 7, 0, 0, 0]])
def test_table_for_counts(counts):
    bits, symbols = jpeg.table_for(counts)
    assert sorted(symbols) == list(range(12)) and sum(bits) == 12
    codes = jpeg.huffman_codes(bits, symbols)
    assert sum(2.0**-n for _, n in codes.values()) < 1 and all(code != (1 << n) - 1 for code, n in codes.values())
    for a, b in np.argwhere(np.subtract.outer(counts, counts) > 0):
        assert codes[a][1] <= codes[b][1]
    payloads = [bytes(range(256)), b"some text and more of it ".ljust(64, b"\0"), b"\xff\0" * 320]
    got = jpeg.decode_many(jpeg.encode_payloads(payloads, (bits, symbols)))
    assert [b"".join(p.tobytes() for _, p in x) for x in got] == payloads


def test_counted_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert jpeg.counted_table(docs.limit(0)) == jpeg.STANDARD == jpeg.table_for([0] * 12)
    counts = np.zeros(12, int)
    for r in docs.collect():
        for row in np.frombuffer(jpeg.payload_of(r.text or "")[1], np.uint8).reshape(-1, 64).tolist():
            for before, byte in zip([128, *row], row):
                counts[abs(byte - before).bit_length()] += 1
    dc = jpeg.counted_table(docs)
    assert dc == jpeg.table_for(counts.tolist())
    size = {x: jpeg.texts_to_media(docs, x).selectExpr("sum(length(media))").first()[0] for x in (dc, jpeg.STANDARD)}
    assert size[dc] < 0.92 * size[jpeg.STANDARD]


def test_media_take_less_than_the_budget(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    media = jpeg.stored_media(docs)
    assert sum(os.path.getsize(x[len("file://") :]) for x in media.inputFiles()) < 1.35 * os.path.getsize("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.pixels for r in jpeg.thumbnails(media, with_pixels=True).collect()}
    assert got == {r.doc_id: jpeg.payload_of(r.text or "")[1] for r in docs.collect()}


def test_levels(spark):
    texts = ["naïve words that a language has, 中文 ", "\0\x7f" * 50, ""]
    payloads = [jpeg.payload_of(x * k)[1] for x in texts for k in (1, 3, 700)] + [bytes(range(256))]
    pairs = jpeg.pair_counts(payloads)
    want = np.zeros((257, 256), int)
    for p in payloads:
        for k, byte in enumerate(p):
            want[p[k - 1] if k % 64 else 256, byte] += 1
    assert (pairs == want).all()
    levels = jpeg.arranged(pairs)
    assert sorted(levels) == list(range(256)) and levels == jpeg.arranged(pairs) != jpeg.PLAIN
    assert jpeg.arranged(pairs * 0) == jpeg.PLAIN
    dc = jpeg.table_for(jpeg.category_counts(pairs, levels))
    got = jpeg.decode_many(jpeg.encode_payloads(payloads, dc, levels))
    assert [b"".join(x.tobytes() for _, x in g) for g in got] == payloads
    docs = spark.createDataFrame([(k, x) for k, x in enumerate([*texts, None])], "doc_id long, text string")
    assert (jpeg.counted_pairs(docs) == jpeg.pair_counts([jpeg.payload_of(x)[1] for x in [*texts, ""]])).all()
    assert jpeg.counted_coding(docs.limit(0)) == (jpeg.STANDARD, jpeg.PLAIN)


def test_another_decoder_gives_the_levels(spark):
    """The JVM's own JPEG decoder, on images of this writer: each block is flat, and nothing is smoothed."""
    jvm = spark.sparkContext._jvm
    payload = jpeg.payload_of("Some words, and some more; of more rows of 64 bytes than a run of flat blocks is long. " * 400)[1]
    assert len(payload) > 32767
    pairs = jpeg.pair_counts([payload])
    levels = jpeg.arranged(pairs)
    for dc, of in ((jpeg.STANDARD, jpeg.PLAIN), (jpeg.table_for(jpeg.category_counts(pairs, levels)), levels)):
        (media,) = jpeg.encode_payloads([payload], dc, of)
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(media)))
        samples = np.frombuffer(bytes(image.getRaster().getDataBuffer().getData()), np.uint8).reshape(image.getHeight(), image.getWidth())
        assert (samples == samples[::8, ::8].repeat(8, 0).repeat(8, 1)).all()
        assert samples[::8, ::8].tobytes() == payload.translate(of)


def test_images_of_another_writer(spark):
    """Baseline from the JVM: blocks of one shade each. Its progressive images send DC bit by bit and are refused."""
    jvm = spark.sparkContext._jvm
    shades = np.random.default_rng(5).integers(0, 256, (3, 9))
    image = jvm.java.awt.image.BufferedImage(72, 24, 10)  # grey
    for y, x in np.ndindex(24, 72):
        image.getRaster().setSample(x, y, 0, int(shades[y // 8, x // 8]))
    made = {}
    for mode in (0, 1):  # baseline, progressive
        out = jvm.java.io.ByteArrayOutputStream()
        writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
        settings = writer.getDefaultWriteParam()
        settings.setProgressiveMode(mode)
        writer.setOutput(jvm.javax.imageio.stream.MemoryCacheImageOutputStream(out))
        writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), settings)
        writer.getOutput().flush()
        made[mode] = bytes(out.toByteArray())
    ((_, plane),), refused = jpeg.decode_many([made[0], made[1]])
    assert plane.shape == (3, 9) and abs(plane.astype(int) - shades).max() <= 16  # the quantizer's step
    assert isinstance(refused, jpeg.Broken) and "DC in more than one scan" in str(refused)


def test_broken_progressive():
    (media,) = jpeg.encode_payloads([bytes(range(64))], jpeg.STANDARD, bytes(range(255, -1, -1)))
    ac = jpeg._marker(0xC4, bytes([0x10, 1, *[0] * 15, 0])) + jpeg._marker(0xDA, bytes([1, 1, 0, 1, 63, 0])) + b"\0" * 8
    more = jpeg._marker(0xDA, bytes([1, 1, 0, 0, 0, 0x10])) + b"\0" * 8
    twice = media.replace(b"LEVELS\0\xff", b"LEVELS\0\xfe")
    whole, skipped, *broken = jpeg.decode_many([media, media[:-2] + ac + media[-2:], media[:-2] + more + media[-2:], media[:-2] + ac, media[:-2] + ac[:30], media[:-2], twice, media.replace(b"\x00\x00\x01\x05", b"\x00\x00\xff\x05"), media[:40], media + media[:9]])
    assert whole[0][1].tobytes() == skipped[0][1].tobytes() == bytes(range(64))
    assert all(isinstance(x, jpeg.Broken) for x in broken)
