"""Media columns: baseline JPEG, read in numpy.

``decode`` parses the markers of any baseline JPEG (8-bit, sequential Huffman,
up to four components, interleaved or not, with or without restart intervals),
decodes its scans and rebuilds the luminance from DC coefficients alone: one
pixel for each 8x8 block. Features are the dimensions and two hashes of that
thumbnail.

``encode_payload`` stores bytes losslessly as a gray JPEG: a byte is the DC
coefficient of one block, at a quantiser step of 8, so the block's samples all
have the byte's value. Rows of 24 blocks are restart intervals, which decode
independently and so together, in lockstep. A table of all 16-bit windows
resolves a whole DC-only block at once; scans that have other blocks are decoded
symbol by symbol. Payloads beyond one image's height go on in further images of
the same stream.

Defined results: a null text is an empty one; every text is padded with bytes
255 to a positive multiple of 576; equal texts give equal media; an empty table
gives an empty result; other columns are ignored; bytes that are not a baseline
JPEG raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inkwarden.llm.text import read

#: Blocks in a row and bytes that a payload is padded to a multiple of.
ACROSS, UNIT = 24, 576
#: Block rows of one image: the most whole units under 65,536 sample lines.
ROWS = 65_535 // 8 // ACROSS * ACROSS
#: Code lengths of the standard's luminance DC table, for categories 0 to 11.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: The only AC symbol that is written: end of block, as one zero bit.
AC_COUNTS, AC_SYMBOLS = (1,) + (0,) * 15, (0,)
DC_STEP = 8
#: Fixed value: the zig-zag order starts at the DC coefficient, which is all that is kept.
BLOCK = 64


def padded(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


# ---------------------------------------------------------------- writing


def _codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol: (code, bits), by the canonical rule."""
    out, code, k = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, bits)
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(maxsize=1)
def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """value and bits of a whole DC-only block, by DC difference + 255."""
    dc, (eob, eob_bits) = _codes(DC_COUNTS, DC_SYMBOLS), _codes(AC_COUNTS, AC_SYMBOLS)[0]
    value, bits = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        value[d + 255] = ((code << size | extra) << eob_bits) | eob
        bits[d + 255] = n + size + eob_bits
    return value, bits


def _scan(payload: np.ndarray) -> bytes:
    """Entropy-coded data of rows of blocks, a restart marker between rows."""
    value, bits = _block_codes()
    rows = payload.astype(np.int16).reshape(-1, ACROSS) - 128
    d = np.diff(rows, axis=1, prepend=np.int16(0)) + 255
    v = np.zeros((len(rows), ACROSS + 1), np.uint64)
    n = np.zeros((len(rows), ACROSS + 1), np.int64)
    v[:, :-1], n[:, :-1] = value[d], bits[d]
    n[:, -1] = -n.sum(axis=1) % 8  # a row's last byte fills up with ones
    v[:, -1] = (np.uint64(1) << n[:, -1].astype(np.uint64)) - np.uint64(1)
    n = n.ravel()
    at = np.cumsum(n) - n
    word, shift = at >> 5, (64 - n - (at & 31)).astype(np.uint64)
    both = v.ravel() << shift
    size = int(at[-1] + n[-1]) // 8
    words = int(word[-1]) + 2
    total = np.bincount(word, (both >> np.uint64(32)).astype(np.float64), words) + np.bincount(word + 1, (both & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    data = np.frombuffer(total.astype(">u4").tobytes(), np.uint8)[:size]
    # a zero follows each byte 255, a marker each row but the last
    row_bytes = np.add.reduceat(n, np.arange(0, len(n), ACROSS + 1)) // 8
    row = np.repeat(np.arange(len(rows)), row_bytes)
    full = data == 255
    place = np.arange(size) + np.cumsum(full) - full + 2 * row
    out = np.zeros(size + int(full.sum()) + 2 * (len(rows) - 1), np.uint8)
    out[place] = data
    ends = np.cumsum(row_bytes)[:-1]
    mark = place[ends] - 2 if len(ends) else np.zeros(0, np.int64)
    out[mark], out[mark + 1] = 255, 0xD0 + np.arange(len(mark)) % 8
    return out.tobytes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def encode_payload(payload: bytes) -> bytes:
    """One gray baseline JPEG for each ``ROWS`` rows of 24 bytes, one after another."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 576 bytes")
    data, out = np.frombuffer(payload, np.uint8), []
    for at in range(0, len(data), ROWS * ACROSS):
        part = data[at : at + ROWS * ACROSS]
        out += [
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            _segment(0xDB, b"\0" + bytes([DC_STEP]) + b"\1" * (BLOCK - 1)),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, len(part) // ACROSS * 8, ACROSS * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\0" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)),
            _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)),
            _segment(0xDD, struct.pack(">H", ACROSS)),
            _segment(0xDA, b"\1\1\0\0\x3f\0"),
            _scan(part),
            b"\xff\xd9",
        ]
    return b"".join(out)


# ---------------------------------------------------------------- reading


@dataclass
class Component:
    across: int  # sampling factors
    down: int
    step: int  # index of its quantiser table
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))  # DC, dequantised


#: Bytes in which the end of a scan is looked for at first.
LOOK = 1 << 19


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]

    def thumbnail(self) -> np.ndarray:
        """One luminance sample for each block of the first component."""
        luma = self.components[0]
        rows = -(-(-(-self.height * luma.down // max(c.down for c in self.components))) // 8)
        columns = -(-(-(-self.width * luma.across // max(c.across for c in self.components))) // 8)
        dc = luma.blocks[:rows, :columns]
        return np.clip((dc + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """symbol and bits of the code at the head of each 16-bit window; 0 bits where there is none."""
    symbol, bits = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    for s, (code, n) in _codes(tuple(counts), tuple(symbols)).items():
        low = code << (16 - n)
        symbol[low : low + (1 << (16 - n))], bits[low : low + (1 << (16 - n))] = s, n
    return symbol, bits


@lru_cache(maxsize=16)
def _blocks(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """DC difference and bits of a whole block that is DC and end of block, for each 16-bit window; else 0 bits."""
    window = np.arange(1 << 16)
    size, n = _lookup(*dc)
    symbol, m = _lookup(*ac)
    used = n + size
    extra = (window >> np.maximum(16 - used, 0)) & ((1 << np.minimum(size, 16)) - 1)
    diff = np.where(size == 0, 0, np.where(extra >> np.maximum(size - 1, 0) == 1, extra, extra - (1 << np.minimum(size, 16)) + 1))
    rest = (window << np.minimum(used, 16)) & 0xFFFF
    whole = (n > 0) & (m[rest] > 0) & (symbol[rest] == 0) & (used + m[rest] <= 16)
    return diff.astype(np.int32), np.where(whole, used + m[rest], 0).astype(np.int32)


def _intervals(data: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The scan's bytes without stuffing and markers, the start of each restart interval in them, and the scan's end."""
    stop = at + LOOK
    while True:  # up to the marker that ends the scan, not to the end of a stream of many images
        full = np.flatnonzero(data[at : min(stop, len(data)) - 1] == 255) + at
        after = data[full + 1]
        other = np.flatnonzero((after != 0) & ((after < 0xD0) | (after > 0xD7)))
        if len(other) or stop >= len(data):
            break
        stop = at + 2 * (stop - at)
    end = int(full[other[0]]) if len(other) else len(data)
    full, after = full[full < end], after[full < end]
    keep = np.ones(end - at, bool)
    keep[full[after == 0] + 1 - at] = False
    restart = full[after != 0] - at
    keep[restart] = keep[restart + 1] = False
    return data[at:end][keep], np.r_[0, (np.cumsum(keep) - keep)[restart]], end


def _lockstep(clean: np.ndarray, starts: np.ndarray, count: int, last: int, tables: tuple) -> np.ndarray | None:
    """DC values of intervals of ``count`` blocks of one component (the last of ``last``), or None if a block has more than DC."""
    diff, bits = tables
    wide = np.r_[clean, np.full(4, 255, np.uint8)].astype(np.uint32)
    window = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    at = starts.astype(np.int64) * 8
    out = np.zeros((len(starts), count), np.int32)
    for k in range(count):
        lanes = len(starts) - (k >= last)
        if not lanes:
            break
        p = at[:lanes]
        head = (window[np.minimum(p >> 3, len(window) - 1)] >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF
        n = bits[head]
        if not n.all():
            return None
        out[:lanes, k] = diff[head]
        at[:lanes] = p + n
    return np.cumsum(out, axis=1).ravel()[: (len(starts) - 1) * count + last]


def _serial(clean: np.ndarray, starts: np.ndarray, units: list[int], lookups: list[tuple], count: int, total: int) -> list[list[int]]:
    """DC values by component of a scan, symbol by symbol; ``units`` names the component of each block of an MCU."""
    data = clean.tobytes() + b"\xff" * 8
    values: list[list[int]] = [[] for _ in lookups]
    for i, start in enumerate(starts.tolist()):
        at, last = start * 8, [0] * len(lookups)
        for _ in range(min(count, total - i * count)):
            for c in units:
                (ds, dn), (as_, an) = lookups[c]
                head = (int.from_bytes(data[at >> 3 : (at >> 3) + 3], "big") >> (8 - (at & 7))) & 0xFFFF
                size, n = int(ds[head]), int(dn[head])
                if not n or at >> 3 > len(data) - 8:
                    raise ValueError("broken entropy-coded data")
                at += n
                extra = (int.from_bytes(data[at >> 3 : (at >> 3) + 4], "big") >> (32 - (at & 7) - size)) & ((1 << size) - 1)
                at += size
                last[c] += extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
                values[c].append(last[c])
                k = 1
                while k < BLOCK:
                    head = (int.from_bytes(data[at >> 3 : (at >> 3) + 3], "big") >> (8 - (at & 7))) & 0xFFFF
                    symbol, n = int(as_[head]), int(an[head])
                    if not n:
                        raise ValueError("broken entropy-coded data")
                    at += n + (symbol & 15)
                    if symbol == 0:
                        break
                    k += (symbol >> 4) + 1
    return values


def decode(media: bytes) -> list[Image]:
    """The images of a stream of baseline JPEGs, with their DC coefficients."""
    data, at, images = np.frombuffer(media, np.uint8), 0, []
    while at < len(media):
        image, at = _decode_one(media, data, at)
        images.append(image)
    return images


def _decode_one(media: bytes, data: np.ndarray, at: int) -> tuple[Image, int]:
    if media[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    steps: dict[int, int] = {}
    tables: dict[int, tuple[bytes, bytes]] = {}
    named: dict[int, Component] = {}
    image: Image | None = None
    restart = 0
    while True:
        while at < len(media) and media[at] == 255 and media[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 2 > len(media) or media[at] != 255:
            raise ValueError("no marker where one is due")
        marker = media[at + 1]
        if marker == 0xD9:
            if image is None:
                raise ValueError("no frame")
            return image, at + 2
        (size,) = struct.unpack_from(">H", media, at + 2)
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + BLOCK * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xC0:
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not height or not width:
                raise ValueError("not an 8-bit frame with a size")
            for i in range(n):
                name, factors, table = body[6 + 3 * i : 9 + 3 * i]
                named[name] = Component(factors >> 4, factors & 15, table)
            image = Image(width, height, list(named.values()))
        elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise ValueError("not baseline")
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan before its frame")
            parts = [(named[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
            at = _read_scan(data, at, image, parts, steps, tables, restart)


def _read_scan(data, at, image, parts, steps, tables, restart) -> int:
    clean, starts, end = _intervals(data, at)
    most = max(c.across for c in image.components), max(c.down for c in image.components)
    wide, high = -(-image.width // (8 * most[0])), -(-image.height // (8 * most[1]))  # in MCUs
    if len(parts) == 1:  # not interleaved: an MCU is a block
        c = parts[0][0]
        columns, rows = -(-(-(-image.width * c.across // most[0])) // 8), -(-(-(-image.height * c.down // most[1])) // 8)
        units, total = [0], columns * rows
    else:
        units, total = [i for i, (c, _) in enumerate(parts) for _ in range(c.across * c.down)], wide * high
    count = restart or total
    starts = starts[: -(-total // count)]
    if len(starts) < -(-total // count):
        raise ValueError("a restart interval is missing")
    pairs = [(tables[t >> 4], tables[16 | t & 15]) for _, t in parts]
    fast = _lockstep(clean, starts, count, total - (len(starts) - 1) * count, _blocks(*pairs[0])) if len(parts) == 1 else None
    values = [fast] if fast is not None else _serial(clean, starts, units, [(_lookup(*d), _lookup(*a)) for d, a in pairs], count, total)
    for (c, _), v in zip(parts, values, strict=True):
        v = np.asarray(v, np.int32) * steps[c.step]
        if len(parts) == 1:
            c.blocks = v.reshape(rows, columns)
        else:
            c.blocks = v.reshape(high, wide, c.down, c.across).transpose(0, 2, 1, 3).reshape(high * c.down, wide * c.across)
    return end


def stored_payload(images: list[Image]) -> bytes:
    """The bytes that ``encode_payload`` stored."""
    return b"".join(i.thumbnail().tobytes() for i in images)


# ---------------------------------------------------------------- features


def _reduced(thumbnail: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Integer means of a grid of cells; a short side repeats its lines."""
    for axis, n in ((0, rows), (1, columns)):
        size = thumbnail.shape[axis]
        thumbnail = np.repeat(thumbnail, -(-n // size), axis) if size < n else thumbnail
        size = thumbnail.shape[axis]
        edges = np.arange(n + 1) * size // n
        sums = np.add.reduceat(thumbnail.astype(np.int64), edges[:-1], axis)
        thumbnail = sums // np.diff(edges).reshape((-1, 1) if axis == 0 else (1, -1))
    return thumbnail


def average_hash(thumbnail: np.ndarray) -> str:
    cells = _reduced(thumbnail, 8, 8)
    return np.packbits(cells * cells.size > cells.sum()).tobytes().hex()


def difference_hash(thumbnail: np.ndarray) -> str:
    cells = _reduced(thumbnail, 8, 9)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def feature(images: list[Image]) -> str:
    """Dimensions, average hash and difference hash of each image's thumbnail."""
    return ";".join(f"{i.width}x{i.height}:{average_hash(t)}:{difference_hash(t)}" for i in images for t in [i.thumbnail()])


def _mapped(df: DataFrame, columns: list[str], source: str, schema: str, row) -> DataFrame:
    """``columns`` and what ``row`` makes of each value of ``source``, with a memo of nothing: rows are independent."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds what a batch's media take
                part = batch.slice(at, 512)
                made = [row(v.as_py()) for v in part.column(source)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *(pa.array([m[k] for m in made], kinds[t]) for k, (_, t) in enumerate(fields))], names=[*columns, *(n for n, _ in fields)])

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.select(*dict.fromkeys([*columns, source])).mapInArrow(run, f"{kept}, {schema}")


def media_columns(df: DataFrame, columns: list[str], media: str = "media") -> DataFrame:
    """``columns`` with width, height and feature of the first image of each JPEG stream; null for a null."""

    def row(data: bytes | None):
        if data is None:
            return None, None, None
        images = decode(data)
        return images[0].width, images[0].height, feature(images)

    return _mapped(df, columns, media, "width int, height int, feature string", row)


def stored_texts(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with each text stored as a JPEG and what is read back from the stored bytes."""

    def row(text: str | None):
        n = len((text or "").encode("utf-8", "surrogatepass"))
        media = encode_payload(padded(text))
        images = decode(media)
        payload = stored_payload(images)
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(images)

    return _mapped(docs, columns, "text", "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", row)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(read(spark, sf_dir, "documents"), ["doc_id"])
