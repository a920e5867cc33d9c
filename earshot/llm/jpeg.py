"""Media columns: JPEG, baseline or with DC in one progressive scan, decoded to DC-only luminance thumbnails.

``thumbnails`` reads a column of JPEG bytes: it parses the markers, Huffman-decodes the scan, and rebuilds from the DC
coefficients of the luminance component a thumbnail of an eighth of the size, one sample per 8 x 8 block. Restart
intervals are independent, so all intervals of all images of a batch with equal tables are decoded in step, as numpy
vectors.

``texts_to_media`` is the writer that goes with it: a payload byte becomes the DC coefficient of one block (quantizer 8,
so that the block's samples equal the byte's level), 64 blocks a row, one restart interval a row. The thumbnail of such
an image is the payload again: nothing is lost. A payload beyond 8,191 rows goes on in further images after the first,
in the same bytes. The images are progressive, a DC scan and an AC scan that says in few bytes that all blocks are flat:
a baseline block would end with a code of its own, a bit for each byte.

Levels and DC table are made for the data: ``counted_pairs`` counts which byte follows which in one pass over the whole
texts (at most 257 x 256 numbers, whatever the input). ``arranged`` gives bytes that often follow each other near
levels, as a JPEG codes the difference of neighbours: text leaps by 64 and more at each space otherwise. The categories
of difference that are frequent then get short codes. An image carries its levels in a segment (APP11, the byte of each
level), as a palette: any decoder gives the levels, ``thumbnails`` the bytes.

The query writes the stored form as a table and reads it again before it decodes. The table is compressed for what
repeats from row to row: headers, and copies of texts.

Edge cases: a null or empty text gives the 64 zero bytes that the padding adds; a null or broken image gets null
dimensions and an error text, other rows aren't harmed; equal texts give equal bytes; other columns are not read.
Progressive images with DC in several scans (by component or by bit) are refused; AC scans are skipped.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import stage, table, texts_of

WIDE, MOST_ROWS = 64, 8191
#: The luminance DC table of the JPEG standard (codes per length, categories), and each byte as its own level.
STANDARD = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
PLAIN = bytes(range(256))
_PALETTE = b"LEVELS\0"
#: Passes over all bytes in the search for levels; over 12,000 texts no swap helped after four.
_MOST_PASSES = 12
_BATCH_BYTES = 1 << 20


def huffman_codes(bits: list[int], values: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol: (code, length), canonical."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[values[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def table_for(counts: list[int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The Huffman table (codes per length, symbols) that suits symbols 0, 1, ... with these counts; without any, the standard's.

    A count of 0 gets a code, too. As the format demands, no code is all ones: a symbol rarer than all others is made
    for it and left out. Ties go by the smaller symbol, so equal counts give equal tables.
    """
    if not sum(counts):
        return STANDARD
    n = len(counts)
    heap = [(max(c, 1), k, [k]) for k, c in enumerate(counts)] + [(0, n, [n])]
    heapq.heapify(heap)
    length = [0] * (n + 1)
    while len(heap) > 1:
        (a, _, x), (b, k, y) = heapq.heappop(heap), heapq.heappop(heap)
        for symbol in x + y:
            length[symbol] += 1
        heapq.heappush(heap, (a + b, k, x + y))
    if max(length) > 16:  # the format's limit; 12 categories can't get there
        return STANDARD
    order = sorted(range(n), key=lambda k: (length[k], k))
    return tuple(sum(length[k] == size for k in order) for size in range(1, 17)), tuple(order)


def lookup(bits: list[int], values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits that may follow: the symbol and its code's length (0: no code)."""
    symbol, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for s, (code, n) in huffman_codes(bits, values).items():
        at = code << (16 - n)
        symbol[at : at + (1 << (16 - n))] = s
        length[at : at + (1 << (16 - n))] = n
    return symbol, length


# ---- writing --------------------------------------------------------------------------------------------------------


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _header(rows: int, dc: tuple, levels: bytes) -> bytes:
    quant = bytes([0, 8] + [1] * 63)
    frame = struct.pack(">BHHBBBB", 8, rows * 8, WIDE * 8, 1, 1, 0x11, 0)
    palette = b"" if levels == PLAIN else _marker(0xEB, _PALETTE + _inverse(levels))
    return b"\xff\xd8" + palette + _marker(0xDB, quant) + _marker(0xC2, frame) + _marker(0xC4, bytes([0x00, *dc[0], *dc[1]])) + _marker(0xDD, struct.pack(">H", WIDE)) + _marker(0xDA, bytes([1, 1, 0x00, 0, 0, 0]))


@lru_cache(1024)
def _flat(rows: int) -> bytes:
    """The AC scan of an image without AC, in runs of up to 32,767 blocks, and the image's end."""
    runs = bytes([0x10, 0, 0, 0, 15, *[0] * 12, *range(0, 0xF0, 0x10)])  # four bits each, by the length of the run in bits
    bits, left = "", rows * WIDE
    while left:
        run = min(left, 32767)
        bits += f"{run.bit_length() - 1:04b}" + f"{run:b}"[1:]
        left -= run
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    return _marker(0xDD, b"\0\0") + _marker(0xC4, runs) + _marker(0xDA, bytes([1, 1, 0x00, 1, 63, 0])) + scan + b"\xff\xd9"


@lru_cache(4)
def _inverse(levels: bytes) -> bytes:
    return np.argsort(np.frombuffer(levels, np.uint8)).astype(np.uint8).tobytes()


@lru_cache(4)
def _difference_codes(table_dc: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference from -255 to 255: all bits of the block (code, magnitude) and their number."""
    dc = huffman_codes(*table_dc)
    value, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = dc[s]
        extra = d if d >= 0 else d + (1 << s) - 1
        value[d + 255] = (code << s) | extra
        length[d + 255] = n + s
    return value, length


def _grid(payloads: list[bytes]) -> np.ndarray:
    """Rows of 64 bytes."""
    return np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDE)


def _differences(payloads: list[bytes], levels: bytes) -> np.ndarray:
    """By rows of 64: each byte's level less that of the byte before it, a row's first less 128."""
    grid = np.frombuffer(levels, np.uint8)[_grid(payloads)].astype(np.int64)
    diff = np.empty_like(grid)
    diff[:, 0] = grid[:, 0] - 128
    np.subtract(grid[:, 1:], grid[:, :-1], out=diff[:, 1:])
    return diff


_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)])


def pair_counts(payloads: list[bytes]) -> np.ndarray:
    """How often each byte (column) follows each (row); row 256: how often it begins a row."""
    if not payloads:
        return np.zeros((257, 256), np.int64)
    grid = _grid(payloads)
    pairs = np.bincount((grid[:, :-1].astype(np.int64) << 8 | grid[:, 1:]).ravel(), minlength=1 << 16)
    return np.concatenate([pairs, np.bincount(grid[:, 0], minlength=256)]).reshape(257, 256)


def category_counts(pairs: np.ndarray, levels: bytes = PLAIN) -> list[int]:
    """How many differences fall into each of the 12 categories."""
    level = np.frombuffer(levels, np.uint8).astype(np.int64)
    category = _CATEGORY[level - np.append(level, 128)[:, None] + 255]
    return [int(pairs[category == k].sum()) for k in range(12)]


def arranged(pairs: np.ndarray) -> bytes:
    """The level of each byte, so that neighbours in these counts differ little.

    Frequent bytes start in the middle, rarer ones to both sides. Then each byte in turn swaps levels with the one that
    saves most bits, with code lengths counted again after each pass. All numbers are whole, so equal counts give equal
    levels.
    """
    often, first = pairs.sum(axis=0), pairs[256]
    if not often.any():
        return PLAIN
    order = sorted(range(256), key=lambda b: (-often[b], b))
    all_levels = np.arange(256)
    level = np.empty(256, np.int64)
    level[order] = sorted(range(256), key=lambda x: (abs(x - 128), -x))
    both = (pairs[:256] + pairs[:256].T).astype(float)
    np.fill_diagonal(both, 0)
    for _ in range(_MOST_PASSES):
        codes = huffman_codes(*table_for(category_counts(pairs, level.astype(np.uint8).tobytes())))
        bits = np.array([codes[s][1] + s for s in _CATEGORY], float)
        begin = first[:, None] * bits[all_levels - 128 + 255]
        settled = True
        for a in (b for b in order if often[b]):
            cost = both @ bits[level[:, None] - all_levels + 255] + begin  # of a byte at a level, all others where they are
            here, own = level[a], cost[all_levels, level]
            more = cost[a, level] - cost[a, here] + cost[:, here] - own
            more += 2 * both[a] * (bits[here - level + 255] - bits[255])  # the two keep their distance
            more[a] = 0
            b = int(more.argmin())
            if more[b] < 0:
                level[a], level[b] = level[b], here
                settled = False
        if settled:
            break
    return level.astype(np.uint8).tobytes()


def encode_payloads(payloads: list[bytes], dc: tuple = STANDARD, levels: bytes = PLAIN) -> list[bytes]:
    """JPEG bytes of each payload (a positive multiple of 64 bytes each), with the DC table ``dc`` and ``levels`` by byte."""
    if not payloads:
        return []
    image_rows, owner = [], []
    for k, p in enumerate(payloads):
        rows = len(p) // WIDE
        for at in range(0, rows, MOST_ROWS):
            image_rows.append(min(MOST_ROWS, rows - at))
            owner.append(k)
    first_row = np.cumsum([0, *image_rows])
    diff = _differences(payloads, levels) + 255
    codes, lengths = _difference_codes(dc)
    value, length = codes[diff], lengths[diff]
    within = np.cumsum(length, axis=1)
    total = within[:, -1]
    size = -(-total // 8)
    start = np.cumsum(size) - size
    pad = size * 8 - total
    offset = (start[:, None] * 8 + within - length).ravel()
    value, length = np.concatenate([value.ravel(), (1 << pad) - 1]), np.concatenate([length.ravel(), pad])
    offset = np.concatenate([offset, start * 8 + total])
    word, shift = offset >> 5, offset & 31
    wide = value << (64 - shift - length).clip(0, 63)
    wide[length == 0] = 0
    wide = wide.view(np.uint64)
    n_words = int(start[-1] + size[-1]) // 4 + 3
    acc = np.bincount(word, (wide >> np.uint64(32)).astype(float), n_words) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(float), n_words)
    raw = acc.astype(np.uint64).astype(">u4").view(np.uint8)[: int(start[-1] + size[-1])]
    # stuffing after 0xFF, restart markers after each row but an image's last
    number = np.arange(len(diff)) - np.repeat(first_row[:-1], image_rows)
    more = np.ones(len(diff), bool)
    more[first_row[1:] - 1] = False
    full = raw == 0xFF
    extra = full.astype(np.int64)
    ends = start + size - 1
    extra[ends] += 2 * more
    place = np.arange(len(raw)) + np.cumsum(extra) - extra
    out = np.zeros(len(raw) + int(extra.sum()), np.uint8)
    out[place] = raw
    at = place[ends] + 1 + full[ends]
    out[at[more]] = 0xFF
    out[at[more] + 1] = 0xD0 + number[more] % 8
    cuts = at[first_row[1:] - 1]
    scan = out.tobytes()
    media: list[list[bytes]] = [[] for _ in payloads]
    began = 0
    for k, rows, cut in zip(owner, image_rows, cuts.tolist(), strict=True):
        media[k] += [_header(rows, dc, levels), scan[began:cut], _flat(rows)]
        began = cut
    return [b"".join(x) for x in media]


# ---- reading --------------------------------------------------------------------------------------------------------


@dataclass
class Image:
    width: int
    height: int
    components: tuple  # (id, h, v, quantizer of DC, DC table, AC table), in the order of the scan
    tables: tuple  # (DC tables, AC tables): (bits, values) by number
    restart: int
    scan: tuple[int, int]
    end: int
    palette: bytes | None = None  # the byte of each level


class Broken(ValueError):
    pass


def parse(data: bytes, at: int = 0) -> Image:
    """Markers of the image that begins at ``at``."""
    if data[at : at + 2] != b"\xff\xd8":
        raise Broken("no start of image")
    at += 2
    quant, dc, ac, frame, restart, palette, progressive = {}, {}, {}, None, 0, None, False
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise Broken("no marker where one belongs")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            raise Broken("no scan")
        (n,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        try:
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC4:
                while body:
                    bits = tuple(body[1:17])
                    if len(body) < 17 + sum(bits):
                        raise Broken("a marker is cut off")
                    (ac if body[0] >> 4 else dc)[body[0] & 15] = (bits, tuple(body[17 : 17 + sum(bits)]))
                    body = body[17 + sum(bits) :]
            elif kind in (0xC0, 0xC2):
                progressive = kind == 0xC2
                depth, height, width, count = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise Broken("not 8 bits a sample")
                frame = (width, height, {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)}, body[6])
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise Broken("neither baseline nor progressive")
            elif kind == 0xEB and body.startswith(_PALETTE):
                palette = body[len(_PALETTE) :]
                if len(set(palette)) != 256 or len(palette) != 256:
                    raise Broken("levels that aren't one for each byte")
            elif kind == 0xDD:
                (restart,) = struct.unpack_from(">H", body)
            elif kind == 0xDA:
                break
        except (IndexError, struct.error) as e:
            raise Broken("a marker is cut off") from e
    if not frame or not frame[0] or not frame[1]:
        raise Broken("no frame before the scan")
    try:
        listed = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
        components = tuple((c, *frame[2][c][:2], quant[frame[2][c][2]], t >> 4, t & 15) for c, t in listed)
        if progressive and body[1 + 2 * body[0] :] != b"\0\0\0":
            raise Broken("DC in more than one scan")
        tables = (tuple(sorted((t, dc[t]) for t in {x[4] for x in components})), () if progressive else tuple(sorted((t, ac[t]) for t in {x[5] for x in components})))
    except (KeyError, IndexError) as e:
        raise Broken("a table is missing") from e
    if len(components) != len(frame[2]):
        raise Broken("more scans than one")
    scan = at, _scan_end(data, at)
    end = scan[1]
    while progressive and data[end + 1] != 0xD9:  # AC scans and their tables
        if end + 5 > len(data):
            raise Broken("a marker is cut off")
        kind, (n,) = data[end + 1], struct.unpack_from(">H", data, end + 2)
        if kind == 0xDA and data[end + 2 + n - 3 : end + 2 + n - 2] == b"\0":
            raise Broken("DC in more than one scan")
        end += 2 + n
        if kind == 0xDA:
            end = _scan_end(data, end)
        elif data[end : end + 1] != b"\xff" or end + 1 >= len(data):
            raise Broken("no marker where one belongs")
    if len(components) == 1:
        components = ((components[0][0], 1, 1, *components[0][3:]),)
    return Image(frame[0], frame[1], components, tables, restart, scan, end, palette)


def _scan_end(data: bytes, at: int) -> int:
    """Where the marker lies that ends the coded bytes from ``at``."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise Broken("the scan doesn't end")
        if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def images_of(data: bytes) -> list[Image]:
    """All images in a row of bytes, one after the other."""
    out, at = [], 0
    while at < len(data):
        im = parse(data, at)
        out.append(im)
        if data[im.end : im.end + 2] != b"\xff\xd9":
            raise Broken("no end of image")
        at = im.end + 2
    if not out:
        raise Broken("no start of image")
    return out


def _units(im: Image) -> tuple[int, int]:
    """MCUs a row, and in all."""
    h, v = max(c[1] for c in im.components), max(c[2] for c in im.components)
    across, down = -(-im.width // (8 * h)), -(-im.height // (8 * v))
    return across, across * down


def dc_planes(batch: list[tuple[bytes, Image]]) -> list[np.ndarray]:
    """DC-only luminance thumbnails (uint8, by the palette where an image has one) of images whose components and tables are equal."""
    im0 = batch[0][1]
    order = [(k, c[4], c[5]) for k, c in enumerate(im0.components) for _ in range(c[1] * c[2])]
    dc = {t: lookup(list(b), list(v)) for t, (b, v) in im0.tables[0]}
    ac = {t: lookup(list(b), list(v)) for t, (b, v) in im0.tables[1]}
    scans = np.frombuffer(b"".join(d[i.scan[0] : i.scan[1]] for d, i in batch) + b"\0" * 16, np.uint8)
    sizes = [i.scan[1] - i.scan[0] for _, i in batch]
    begins = np.cumsum([0, *sizes])
    full = np.flatnonzero(scans[:-1] == 0xFF)
    after = scans[full + 1]
    keep = np.ones(len(scans), bool)
    keep[full[after == 0] + 1] = False
    rst = full[(after >= 0xD0) & (after <= 0xD7)]
    keep[rst] = keep[rst + 1] = False
    b = scans[keep].astype(np.uint64)
    moved = np.cumsum(keep) - keep
    # lanes: one per restart interval
    lane_start, lane_units, per_image = [], [], []
    cuts = np.searchsorted(rst, begins)
    for k, (_, im) in enumerate(batch):
        units = _units(im)[1]
        step = im.restart or units
        n = -(-units // step)
        marks = rst[cuts[k] : cuts[k + 1]]
        if len(marks) < n - 1:
            raise Broken("restart markers are missing")
        lane_start.append(moved[np.concatenate([[begins[k]], marks[: n - 1] + 2])])
        lane_units.append(np.concatenate([np.full(n - 1, step), [units - step * (n - 1)]]))
        per_image.append(n)
    pos, units = np.concatenate(lane_start).astype(np.int64) * 8, np.concatenate(lane_units)
    blocks, lum = units * len(order), sum(1 for k, *_ in order if k == 0)
    padded = np.concatenate([b, np.zeros(8, np.uint64)])
    w48 = np.zeros(len(b), np.uint64)
    for j in range(6):
        w48 |= padded[j : j + len(b)] << np.uint64(40 - 8 * j)
    last = len(b) - 1
    most = int(blocks.max())
    got = np.zeros((len(pos), int(units.max()) * lum), np.int32)
    pred = np.zeros((len(im0.components), len(pos)), np.int64)
    lanes, uneven = np.arange(len(pos)), int(blocks.min()) != most

    def window(p):
        return ((w48[np.minimum(p >> 3, last)] << (p & 7).astype(np.uint64)) & np.uint64((1 << 48) - 1)).astype(np.int64)

    column = 0
    for step in range(most):
        if uneven:
            lanes = np.flatnonzero(blocks > step)
        comp, t_dc, t_ac = order[step % len(order)]
        p = pos[lanes]
        w = window(p)
        top = w >> 32
        s, n = dc[t_dc][0][top].astype(np.int64), dc[t_dc][1][top].astype(np.int64)
        if not n.all():
            raise Broken("a code that no table has")
        used = n + s
        extra = (w >> (48 - used)) & ((1 << s) - 1)
        value = np.where((s > 0) & (extra < (1 << np.maximum(s - 1, 0))), extra - (1 << s) + 1, extra)
        pred[comp, lanes] += value
        if comp == 0:
            got[lanes, column] = pred[0, lanes]
            column += 1
        p = p + used
        if not ac:  # a DC scan alone
            pos[lanes] = p
            continue
        # the end of block mostly follows at once: up to 13 bits of it are in the same window
        nxt = (w << used) >> 32 & 0xFFFF
        a_s, a_n = ac[t_ac][0][nxt], ac[t_ac][1][nxt].astype(np.int64)
        done = (a_s == 0) & (a_n > 0) & (a_n <= 41 - used)
        pos[lanes] = p + np.where(done, a_n, 0)
        rest = lanes[~done]
        k = np.ones(len(rest), np.int64)
        while len(rest):
            w = window(pos[rest])
            top = w >> 32
            s, n = ac[t_ac][0][top].astype(np.int64), ac[t_ac][1][top].astype(np.int64)
            if not n.all():
                raise Broken("a code that no table has")
            run, bits = s >> 4, s & 15
            pos[rest] += n + bits
            end = (bits == 0) & (run != 15)
            k = k + run + 1
            on = ~end & (k < 64)
            rest, k = rest[on], k[on]
    out, at = [], 0
    h, v, q = im0.components[0][1], im0.components[0][2], im0.components[0][3]
    for (_, im), n in zip(batch, per_image, strict=True):
        across, total = _units(im)
        own = units[at : at + n]
        if (own == own[0]).all():
            flat = got[at : at + n, : int(own[0]) * lum].reshape(-1)
        else:
            flat = np.concatenate([got[at + i, : own[i] * lum] for i in range(n)])
        at += n
        flat = np.clip((flat * q + 4) // 8 + 128, 0, 255).astype(np.uint8)
        if h == v == 1:
            plane = flat.reshape(-1, across)
        else:
            plane = flat.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)
        plane = plane[: -(-im.height // 8), : -(-im.width // 8)]
        out.append(plane if im.palette is None else np.frombuffer(im.palette, np.uint8)[plane])
    return out


def decode_many(media: list[bytes | None]) -> list[list[tuple[Image, np.ndarray]] | Exception]:
    """For each row of bytes its images with thumbnails, or what is wrong with it."""
    out: list = [None] * len(media)
    groups: dict[tuple, list[tuple[int, int, Image]]] = {}
    for r, data in enumerate(media):
        try:
            if data is None:
                raise Broken("no media")
            found = images_of(data)
            out[r] = [None] * len(found)
            for i, im in enumerate(found):
                groups.setdefault((im.components, im.tables), []).append((r, i, im))
        except Broken as e:
            out[r] = e
    for members in groups.values():
        try:
            planes = dc_planes([(media[r], im) for r, _, im in members])
        except Broken:
            planes = []
            for r, _, im in members:  # one by one, to find the broken ones
                try:
                    planes += dc_planes([(media[r], im)])
                except Broken as e:
                    planes.append(e)
        for (r, i, im), plane in zip(members, planes, strict=True):
            if isinstance(out[r], list):
                if isinstance(plane, Broken):
                    out[r] = plane
                else:
                    out[r][i] = (im, plane)
    return out


def thumbnail_hash(plane: np.ndarray) -> int:
    """64 bits: which of 8 x 8 areas are lighter than the mean of all areas."""
    def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = -(-np.arange(8) * len(x) // 8)
        ends = np.concatenate([[np.zeros(x.shape[1])], np.cumsum(x, axis=0, dtype=float)])
        cuts = np.append(cuts, len(x))
        return ends[cuts[1:]] - ends[cuts[:-1]], np.diff(cuts)

    by_row, rows = halves(plane)
    area, columns = halves(by_row.T)
    area, n = area.T, np.outer(rows, columns)
    mean = np.divide(area, n, out=np.zeros_like(area), where=n > 0)
    level = mean[n > 0].mean()
    return int("".join("1" if x else "0" for x in (mean > level).ravel()), 2)


# ---- Spark ----------------------------------------------------------------------------------------------------------


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    size = max(-(-len(raw) // WIDE), 1) * WIDE
    return len(raw), raw.ljust(size, b"\0")


def _slices(sizes: list[int]):
    """Runs of rows of about a megabyte together."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > _BATCH_BYTES:
            yield slice(start, k)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def counted_pairs(docs: DataFrame) -> np.ndarray:
    """``pair_counts`` of all texts of ``docs``."""

    def count(batches):
        total = np.zeros((257, 256), np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for part in _slices([len(x) for x in texts]):
                total += pair_counts([payload_of(x)[1] for x in texts[part]])
        before, byte = total.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(before, pa.int32()), pa.array(byte, pa.int32()), pa.array(total[before, byte], pa.int64())], names=["before", "byte", "n"])

    from pyspark.sql import functions as F

    sums = texts_of(docs).select("text").mapInArrow(count, "before int, byte int, n long").groupBy("before", "byte").agg(F.sum("n").alias("n"))
    pairs = np.zeros((257, 256), np.int64)
    for r in sums.collect():  # 257 x 256 rows at most
        pairs[r.before, r.byte] = r.n
    return pairs


def counted_table(docs: DataFrame) -> tuple:
    """The DC table for the texts of ``docs`` with each byte as its level, from all their differences; without rows, the standard's."""
    return table_for(category_counts(counted_pairs(docs)))


def counted_coding(docs: DataFrame) -> tuple[tuple, bytes]:
    """DC table and levels for the texts of ``docs``, from all their pairs of bytes; without rows, the standard's and the bytes."""
    pairs = counted_pairs(docs)
    levels = arranged(pairs)
    return table_for(category_counts(pairs, levels)), levels


def texts_to_media(docs: DataFrame, dc: tuple = STANDARD, levels: bytes = PLAIN) -> DataFrame:
    """(doc_id, n_bytes, media): each text, padded, as JPEG bytes with the DC table ``dc`` and ``levels``."""

    def write(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in _slices([len(x) for x in texts]):
                made = [payload_of(x) for x in texts[part]]
                yield pa.RecordBatch.from_arrays([b.column(0)[part.start : part.stop], pa.array([n for n, _ in made], pa.int64()), pa.array(encode_payloads([p for _, p in made], dc, levels), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts_of(docs).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def thumbnails(media: DataFrame, column: str = "media", key: str = "doc_id", with_pixels: bool = False) -> DataFrame:
    """Per row: dimensions, number of images, thumbnail hashes (of further images with their size), and digests of the thumbnails' samples and of the bytes.

    ``with_pixels`` adds the samples. All other columns of ``media`` are left out but the key and ``n_bytes``.
    """
    schema = f"{key} long, n_bytes long, width int, height int, n_images int, thumb_hash string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string" + ", pixels binary" * with_pixels
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches):
        for b in batches:
            keys, sizes, data = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for part in _slices([len(x or b"") for x in data]):
                rows = []
                for k, n, raw, got in zip(keys[part], sizes[part], data[part], decode_many(data[part]), strict=True):
                    of = (len(raw), hashlib.sha256(raw).hexdigest()) if raw is not None else (None, None)
                    if isinstance(got, Exception):
                        rows.append((k, n, None, None, None, None, None, None, None, *of, str(got), *[None] * with_pixels))
                        continue
                    pixels = b"".join(p.tobytes() for _, p in got)
                    im = got[0][0]
                    hashes = [f"{thumbnail_hash(p):016x}" for _, p in got]
                    seen = "+".join([hashes[0], *(f"{x.width}x{x.height}:{h}" for (x, _), h in zip(got[1:], hashes[1:], strict=True))])
                    rows.append((k, n, im.width, im.height, len(got), seen, len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-64:]), *of, None, *[pixels] * with_pixels))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names)

    from pyspark.sql import functions as F

    has = F.col("n_bytes").cast("long") if "n_bytes" in media.columns else F.lit(None).cast("long")
    return media.select(F.col(key).cast("long").alias(key), has.alias("n_bytes"), F.col(column).alias("media")).mapInArrow(read, schema)


def stored_media(docs: DataFrame) -> DataFrame:
    """``texts_to_media`` with counted table and levels, written and read again."""
    return stage(texts_to_media(docs, *counted_coding(docs)), "media", compression="zstd")


def op2_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = thumbnails(stored_media(table(spark, sf_dir, "documents")))
    feature = F.format_string("%dx%d/%d:%s", "width", "height", "n_images", "thumb_hash")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
