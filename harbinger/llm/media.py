"""Baseline JPEG columns: bytes stored as images, markers parsed, scans Huffman-decoded, DC-only luminance thumbnails.

Storing: a payload's bytes become the DC terms of 8x8 blocks (one block a byte, quantizer 8, no AC terms), so
the DC-only thumbnail of the image, in which a block is one sample, is the payload. A row of blocks holds 64
bytes and is a restart interval. Longer payloads than one image can hold become several images in a row.

Reading works on any baseline JPEG (sequential, 8 bits, Huffman; one scan or one a component): headers are parsed one image at a time, then
the entropy-coded intervals of all images of a batch are decoded side by side, a symbol of each per step.
Only luminance DC terms are kept; chroma and AC terms are decoded to be skipped.

Null texts count as empty; null or broken media give null features. Every row gives one row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from harbinger.llm import bytescan, common

ROW = 64
#: Rows of blocks in one image; 65,535 lines is the format's limit.
MOST_ROWS = 8000
PASS_ROWS = 1 << 14

# Fixed values of the format: the usual DC luminance code (lengths, then categories) and a code of one symbol.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = tuple(range(12))
AC_COUNTS = (1, *(0,) * 15)
AC_VALUES = (0,)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _codes(counts: tuple[int, ...], values: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for v in values[k : k + n]:
            out[v] = (code, length)
            code += 1
        k += n
        code <<= 1
    return out


def _head(rows: int) -> bytes:
    lines = rows * 8
    return b"".join([
        b"\xff\xd8", _segment(0xDB, bytes([0]) + bytes([8] + [1] * 63)), _segment(0xC0, bytes([8]) + lines.to_bytes(2, "big") + (ROW * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
        _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_VALUES])), _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_VALUES])), _segment(0xDD, ROW.to_bytes(2, "big")), _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


_DC = _codes(DC_COUNTS, DC_VALUES)


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 to 255, with the end-of-block bit."""
    code, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        head, length = _DC[c]
        extra = d if d >= 0 else d + (1 << c) - 1
        code[d + 255], size[d + 255] = ((head << c) | extra) << 1, length + c + 1
    return code, size


_CODE, _SIZE = _block_codes()


def store(payload: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """Images of payloads that lie one after the other in an array of rows of 64 bytes; rows: how many each has."""
    x = payload.reshape(-1, ROW).astype(np.int64) - 128
    n = x.shape[0]
    x[:, 1:] -= payload.reshape(-1, ROW).astype(np.int64)[:, :-1] - 128
    code, size = _CODE[x + 255], _SIZE[x + 255]
    bits = size.sum(axis=1)
    length = (bits + 7) // 8
    first = np.cumsum(length) - length
    at = (np.cumsum(size, axis=1) - size + 8 * first[:, None]).ravel()
    # The last byte of an interval is filled with ones: a further code of up to seven of them.
    fill = 8 * length - bits
    at = np.concatenate([at, 8 * first + bits])
    value = np.concatenate([code.ravel(), (np.uint32(1) << fill.astype(np.uint32)) - np.uint32(1)]).astype(np.int64)
    value = value << (24 - (at & 7) - np.concatenate([size.ravel(), fill]))
    byte, total = at >> 3, int(length.sum())
    data = sum(np.bincount(byte + k, (value >> (16 - 8 * k)) & 0xFF, minlength=total + 3)[:total] for k in range(3)).astype(np.uint8)
    stuffed = np.flatnonzero(data == 0xFF)
    data = np.insert(data, stuffed + 1, 0)
    ends = np.cumsum(length)
    ends = ends + np.searchsorted(stuffed, ends, "left")
    body, cuts = data.tobytes(), [0, *ends.tolist()]
    out, row = [], 0
    marks = [bytes((0xFF, 0xD0 + k)) for k in range(8)]
    for count in rows.tolist():
        images = []
        for lo in range(0, count, MOST_ROWS):
            own = range(row + lo, row + min(count, lo + MOST_ROWS))
            scan = [body[cuts[own[0]] : cuts[own[0] + 1]]]
            for k, r in enumerate(own[1:]):
                scan += [marks[k & 7], body[cuts[r] : cuts[r + 1]]]
            images += [_head(len(own)), *scan, b"\xff\xd9"]
        out.append(b"".join(images))
        row += count
    return out


@dataclass
class Component:
    """What a frame says of a component, and its tables of the scan."""

    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Image:
    """A parsed image: its size, components, restart interval and where its scan lies."""

    width: int = 0
    height: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    order: list[int] = field(default_factory=list)
    restart: int = 0
    dc_quant: dict[int, int] = field(default_factory=dict)
    start: int = 0
    end: int = 0


class _Tables:
    """Huffman tables met so far, as lookups of 16 bits: length times 256 plus symbol; 0 where there is no code."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.rows: list[np.ndarray] = []

    def add(self, body: bytes) -> int:
        if body not in self.number:
            table = np.zeros(1 << 16, np.uint16)
            for symbol, (code, length) in _codes(tuple(body[:16]), tuple(body[16:])).items():
                table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            self.number[body] = len(self.rows)
            self.rows.append(table)
        return self.number[body]


def parse(data: bytes, at: int, tables: _Tables) -> tuple[Image, int]:
    """The image that starts at `at` and where it ends, with the scan that holds its first component, luminance. Raises
    ValueError on anything but baseline, and on frames larger than their scan can fill."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, huffman = Image(), {}
    at += 2
    while True:
        while data[at + 1 : at + 2] == b"\xff":
            at += 1
        if data[at : at + 2] == b"\xff\xd9":
            if not image.order:
                raise ValueError("no scan of luminance")
            return image, at + 2
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("no marker")
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + length]
        if len(body) != length - 2:
            raise ValueError("a segment is cut off")
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                if not image.order:
                    image.dc_quant[number] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huffman[body[0]] = tables.add(body[1:n])
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8 or image.components or not 1 <= body[5] <= 4:
                raise ValueError("not one frame of 8 bits and at most four components")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for k in range(body[5]):
                c, hv, q = body[6 + 3 * k : 9 + 3 * k]
                if not (1 <= hv >> 4 <= 4 and 1 <= hv & 15 <= 4) or c in image.components:
                    raise ValueError("no such sampling")
                image.components[c] = Component(hv >> 4, hv & 15, q)
            if not image.width or not image.height:
                raise ValueError("no size")
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            if not image.order:
                image.restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            order = [body[1 + 2 * k] for k in range(body[0])]
            if not order or len(set(order)) != len(order) or not set(order) <= set(image.components):
                raise ValueError("a scan of no known components")
            begin, at = at, _scan_end(data, at)
            if next(iter(image.components)) not in order or image.order:
                continue
            for k, c in enumerate(order):
                image.components[c].dc, image.components[c].ac = huffman[body[2 + 2 * k] >> 4], huffman[16 | body[2 + 2 * k] & 15]
            image.order, image.start, image.end = order, begin, at
            if order[0] != next(iter(image.components)):
                raise ValueError("luminance is not first")
            blocks, units, *_ = _layout(image)
            if 2 * len(blocks) * units > 8 * (at - begin):  # a block has two codes of a bit at least
                raise ValueError("a scan too short for its frame")


def _scan_end(data: bytes, at: int) -> int:
    """The next marker that is no restart."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("no end of image")
        if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
            at += 2
        elif data[at + 1] == 0xFF:
            at += 1
        else:
            return at


def _layout(image: Image) -> tuple[list[tuple[int, bool]], int, int, int, int]:
    """Blocks of a unit as (component, luminance?), units in all, units a row, luminance blocks across and down in a unit."""
    first = image.order[0]
    h, v = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
    if len(image.order) == 1:  # a scan of one component is not padded to whole units
        own = image.components[first]
        across, down = -(-(-(-image.width * own.h // h)) // 8), -(-(-(-image.height * own.v // v)) // 8)
        return [(first, True)], across * down, across, 1, 1
    across, down = -(-image.width // (8 * h)), -(-image.height // (8 * v))
    blocks = [(c, c == first) for c in image.order for _ in range(image.components[c].h * image.components[c].v)]
    return blocks, across * down, across, image.components[first].h, image.components[first].v


def thumbnails(data: bytes, images: list[Image], tables: _Tables) -> list[np.ndarray | None]:
    """DC-only luminance of each image, a sample per 8x8 block; None where the entropy-coded data is broken."""
    raw = np.frombuffer(data, np.uint8)
    parts, lanes = [], []
    filled = 0
    layouts = [_layout(i) for i in images]
    for k, image in enumerate(images):
        scan = raw[image.start : image.end]
        ff = np.flatnonzero(scan[:-1] == 0xFF) if scan.size else np.empty(0, np.int64)
        following = scan[ff + 1]
        marks, drop = ff[following >= 0xD0], ff[following == 0] + 1
        keep = np.ones(scan.size, bool)
        keep[drop] = keep[marks] = keep[marks + 1] = False
        clean = scan[keep]
        ends = np.append(marks - np.searchsorted(drop, marks) - 2 * np.arange(marks.size), clean.size)
        units = layouts[k][1]
        step = image.restart or units
        need = -(-units // step)
        starts = np.concatenate([[0], ends[:-1]])
        lanes += [(k, int(s) + filled, int(e) + filled, r * step, min(step, units - r * step)) for r, (s, e) in enumerate(zip(starts[:need], ends[:need], strict=True))]
        if ends.size < need:
            lanes.append((k, 0, 0, 0, 1))  # a missing interval: fails below
        parts.append(clean)
        filled += clean.size
    stream = np.concatenate([*parts, np.zeros(8, np.uint8)])
    word = stream[:-3].astype(np.uint32) << 24 | stream[1:-2].astype(np.uint32) << 16 | stream[2:-1].astype(np.uint32) << 8 | stream[3:]
    word = np.append(word, np.zeros(4, np.uint32))
    table = np.concatenate(tables.rows)
    lane = np.array(lanes, np.int64).reshape(-1, 5)
    image_of, bit, end, unit, left = lane[:, 0], 8 * lane[:, 1], 8 * lane[:, 2], lane[:, 3], lane[:, 4]
    # Per image: its unit's blocks, padded; per block the tables, component and whether it is luminance.
    depth = max(len(b) for b, *_ in layouts)
    per = np.zeros((len(images), depth, 4), np.int64)
    for k, (blocks, *_rest) in enumerate(layouts):
        index = {c: n for n, c in enumerate(images[k].order)}
        for d, (c, light) in enumerate(blocks):
            per[k, d] = images[k].components[c].dc << 16, images[k].components[c].ac << 16, index[c], light
    blocks_of = np.array([len(b) for b, *_ in layouts])[image_of]
    light_of = np.array([sum(x for _, x in b) for b, *_ in layouts])
    sizes = np.array([n for _, n, *_ in layouts]) * light_of
    base = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.int32)
    place = base[image_of] + unit * light_of[image_of]
    n = image_of.size
    block, coef, total = np.zeros(n, np.int64), np.zeros(n, np.int64), left * blocks_of
    pred, ok = np.zeros((n, 4), np.int64), np.ones(len(images), bool)
    live = np.arange(n)
    i_im, i_bit, i_end, i_blocks, i_total, i_place = image_of, bit.copy(), end, blocks_of, total.copy(), place.copy()
    i_block, i_coef = block, coef
    last = word.size - 2
    while live.size:
        info = per[i_im, i_block]
        dc = i_coef == 0
        peek = (word[np.minimum(i_bit >> 3, last)] >> (16 - (i_bit & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        got = table[np.where(dc, info[:, 0], info[:, 1]) + peek].astype(np.int64)
        length, symbol = got >> 8, got & 255
        size = np.where(dc, symbol, symbol & 15)
        i_bit = i_bit + length
        extra = ((word[np.minimum(i_bit >> 3, last)] << (i_bit & 7).astype(np.uint32)) & np.uint32(0xFFFFFFFF)).astype(np.int64) >> (32 - size)
        i_bit = i_bit + size
        bad = (length == 0) | (i_bit > i_end) | dc & (symbol > 11)
        which = np.flatnonzero(dc)
        if which.size:
            value = extra[which]
            s = size[which]
            value = np.where((s > 0) & (value < (1 << np.maximum(s - 1, 0))), value - (1 << s) + 1, value)
            comp = info[which, 2]
            new = pred[live[which], comp] + value
            pred[live[which], comp] = new
            lit = (info[which, 3] == 1) & ~bad[which]
            out[i_place[which[lit]]] = new[lit]
            i_place[which[lit]] += 1
        i_coef = np.where(dc, 1, np.where(symbol == 0, 64, i_coef + (symbol >> 4) + 1))
        bad |= i_coef > 64
        done = i_coef >= 64
        i_coef[done] = 0
        i_block = i_block + done
        i_block[i_block == i_blocks] = 0
        i_total = i_total - done
        if bad.any():
            ok[i_im[bad]] = False
        stay = (i_total > 0) & ~bad
        if not stay.all():
            live, i_im, i_bit, i_end, i_blocks, i_total, i_place, i_block, i_coef = (a[stay] for a in (live, i_im, i_bit, i_end, i_blocks, i_total, i_place, i_block, i_coef))
    result: list[np.ndarray | None] = []
    for k, image in enumerate(images):
        if not ok[k]:
            result.append(None)
            continue
        _, units, across, h, v = layouts[k]
        x = out[base[k] : base[k] + sizes[k]].reshape(units // across, across, v, h).transpose(0, 2, 1, 3).reshape(units // across * v, across * h)
        quant = image.dc_quant.get(image.components[image.order[0]].quant, 1)
        top = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
        mine = image.components[image.order[0]]
        wide = -(-(-(-image.width * mine.h // top[0])) // 8) if len(image.order) > 1 else across
        high = -(-(-(-image.height * mine.v // top[1])) // 8) if len(image.order) > 1 else units // across
        result.append(np.clip((x[:high, :wide] * quant + 4 * (quant % 8 != 0)) // 8 + 128, 0, 255).astype(np.uint8))
    return result


def average_hash(x: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 grid of means lie above the mean of all."""
    rows, cols = np.arange(8) * x.shape[0] // 8, np.arange(8) * x.shape[1] // 8
    sums = np.add.reduceat(np.add.reduceat(x.astype(np.int64), np.minimum(rows, x.shape[0] - 1), axis=0), np.minimum(cols, x.shape[1] - 1), axis=1)
    count = np.maximum(np.diff(np.append(rows, x.shape[0])), 1)[:, None] * np.maximum(np.diff(np.append(cols, x.shape[1])), 1)[None, :]
    means = sums / count
    return np.packbits((means > means.mean()).ravel()).tobytes().hex()


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, filled with bytes 0 to a positive multiple of 64, as images."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = bytescan.raw(b.column("text"))
            for lo, hi in bytescan.passes(offsets, PASS_ROWS * ROW):
                n = np.diff(offsets[lo : hi + 1])
                rows = np.maximum(1, -(-n // ROW))
                payload = np.zeros(int(rows.sum()) * ROW, np.uint8)
                shift = (np.cumsum(rows) - rows) * ROW - (offsets[lo:hi] - offsets[lo])
                own = data[offsets[lo] : offsets[hi]]
                payload[np.arange(own.size) + np.repeat(shift, n)] = own
                media = store(payload, rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return common.texts_of(docs, id_col, text_col).transform(common.map_batches, encode, "doc_id long, n_bytes long, media binary")


def read_media(rows: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, media_bytes, media_sha256, images, width, height, thumbnail (of all images, one below the
    other, as bytes) and its average hash (where images differ in width, one of each, joined by dashes), and the columns in
    `keep`; features are null where the media is null, broken or not baseline."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Tables()
        for whole in batches:
            column = whole.column("media")
            sizes = np.array([0 if not x.is_valid else len(x.as_buffer()) for x in column], np.int64)
            offsets = np.zeros(sizes.size + 1, np.int64)
            np.cumsum(sizes, out=offsets[1:])
            for lo, hi in bytescan.passes(offsets, PASS_ROWS * ROW):
                media = column.slice(lo, hi - lo).to_pylist()
                data = b"".join(m or b"" for m in media)
                images, owner, at, broken = [], [], 0, [m is None or not m for m in media]
                for k, m in enumerate(media):
                    end, mine = at + len(m or b""), []
                    try:
                        own = data[:end] if len(media) == 1 else m
                        shift = 0 if len(media) == 1 else at
                        i = 0
                        while m and i < len(m):
                            image, i = parse(own, i, tables)
                            image.start, image.end = image.start + shift, image.end + shift
                            mine.append(image)
                    except (ValueError, KeyError, IndexError):
                        broken[k] = True
                        mine = []
                    images += mine
                    owner += [k] * len(mine)
                    at = end
                thumbs = thumbnails(data, images, tables) if images else []
                of: dict[int, list] = {}
                for k, image, x in zip(owner, images, thumbs, strict=True):
                    of.setdefault(k, []).append((image, x))
                out = []
                for k, m in enumerate(media):
                    row = {"media_bytes": None if m is None else len(m), "media_sha256": None if m is None else hashlib.sha256(m).hexdigest()}
                    got = of.get(k, [])
                    if not broken[k] and got and all(x is not None for _, x in got):
                        same = len({x.shape[1] for _, x in got}) == 1
                        hashed = average_hash(np.concatenate([x for _, x in got])) if same else "-".join(average_hash(x) for _, x in got)
                        row |= {"images": len(got), "width": max(i.width for i, _ in got), "height": sum(i.height for i, _ in got), "thumbnail": b"".join(x.tobytes() for _, x in got), "hash": hashed}
                    out.append(row)
                own_columns = [whole.column(c).slice(lo, hi - lo) for c in ("doc_id", *keep)]
                kinds = (("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("images", pa.int32()), ("width", pa.int32()), ("height", pa.int64()), ("thumbnail", pa.binary()), ("hash", pa.string()))
                yield pa.RecordBatch.from_arrays([*own_columns, *(pa.array([r.get(c) for r in out], t) for c, t in kinds)], ["doc_id", *keep, *(c for c, _ in kinds)])

    from pyspark.sql import functions as F

    own = rows.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(media_col).alias("media"))
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in own.schema if f.name in keep)
    return own.transform(common.map_batches, decode, f"doc_id long, {kept}media_bytes long, media_sha256 string, images int, width int, height long, thumbnail binary, hash string")


def op3_media(spark, sf_dir: str) -> DataFrame:
    """All documents' texts stored as images; payloads and features come from the stored form."""
    from pyspark.sql import functions as F

    rows = read_media(store_texts(common.documents(spark, sf_dir)), keep=("n_bytes",))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), F.col("images").cast("string"), F.col("hash"))
    return rows.select(
        "doc_id", "n_bytes", F.length("thumbnail").cast("long").alias("payload_bytes"), F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.substring("thumbnail", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"), "width", "height", F.col("hash").alias("thumbnail_hash"),
    )
