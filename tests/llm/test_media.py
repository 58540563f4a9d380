import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from inkwarden.llm import media as m


@pytest.mark.parametrize("text", [None, "", "a", "x" * 576, "é漢字😀" * 500, "\xff" * 1000, "\0" * 577])
def test_payload_round_trip(text):
    data = m.padded(text)
    assert len(data) % 576 == 0 and data
    assert m.stored_payload(m.decode(m.encode_payload(data))) == data


def test_random_bytes_and_several_images():
    data = np.random.default_rng(1).integers(0, 256, 576 * 700, dtype=np.uint8).tobytes()
    images = m.decode(m.encode_payload(data))
    assert len(images) == 3 and m.stored_payload(images) == data
    assert images[0].width == 192 and images[0].height <= 65_535


def test_lockstep_agrees_with_serial(monkeypatch):
    data = np.random.default_rng(2).integers(0, 256, 576 * 3, dtype=np.uint8).tobytes()
    media = m.encode_payload(data)
    want = m.feature(m.decode(media))
    monkeypatch.setattr(m, "_lockstep", lambda *a: None)
    assert m.feature(m.decode(media)) == want


def _colour_image(rng: random.Random):
    """A 4:2:0 image with AC coefficients, written here bit by bit, and its luminance DC values."""
    counts, symbols = (0, 0, 0, 0, 12) + (0,) * 11, tuple(range(12))
    ac_counts, ac_symbols = (0, 0, 0, 5) + (0,) * 12, (0x00, 0x01, 0x12, 0x35, 0xF0)
    dc, ac = m._codes(counts, symbols), m._codes(ac_counts, ac_symbols)
    bits, luma = [], np.zeros((4, 4), int)
    put = lambda v, n: bits.append(format(v, f"0{n}b") if n else "")
    last = [0, 0, 0]
    for y in range(2):
        for x in range(2):
            for c, v, h in [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (2, 0, 0)]:
                value = rng.randrange(-60, 60)
                d = value - last[c]
                last[c] = value
                size = abs(d).bit_length()
                put(*dc[size])
                put(d if d >= 0 else d + (1 << size) - 1, size)
                for s in rng.sample([0x01, 0x12, 0x35, 0xF0], 2):
                    put(*ac[s])
                    put(rng.randrange(1 << (s & 15)), s & 15)
                put(*ac[0])
                if c == 0:
                    luma[2 * y + v, 2 * x + h] = value
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    data = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\0")
    frame = struct.pack(">BHHB", 8, 30, 27, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + m._segment(0xDB, b"\0" + bytes([16]) + b"\1" * 63) + m._segment(0xC0, frame) + m._segment(0xC4, b"\0" + bytes(counts) + bytes(symbols) + b"\x10" + bytes(ac_counts) + bytes(ac_symbols)) + m._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9", luma


def test_interleaved_colour_with_ac():
    for seed in range(20):
        media, luma = _colour_image(random.Random(seed))
        (image,) = m.decode(media)
        assert (image.width, image.height) == (27, 30)
        assert (image.thumbnail() == np.clip(luma * 2 + 128, 0, 255)).all()


@pytest.mark.parametrize("bad", [b"x", b"\xff\xd8", b"\xff\xd8\xff\xd9", b"\xff\xd8" + m._segment(0xC2, b"\0" * 9) + b"\xff\xd9"])
def test_other_bytes_raise(bad):
    with pytest.raises((ValueError, struct.error)):
        m.decode(bad)


def test_query_columns(spark):
    texts = ["hello", "hello", None, "", "z" * 200_000]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = {r["doc_id"]: r for r in m.stored_texts(docs, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        data = m.padded(t)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len((t or "").encode()), len(data))
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-32:])
    assert rows[0][1:] == rows[1][1:] and rows[2][1:] == rows[3][1:]
    assert m.stored_texts(docs.limit(0), ["doc_id"]).count() == 0
    again = m.media_columns(spark.createDataFrame([(1, bytearray(m.encode_payload(m.padded("a")))), (2, None)], "id int, media binary"), ["id"]).orderBy("id").collect()
    assert again[0]["width"] == 192 and again[1]["feature"] is None


def test_long_streams_are_read_in_linear_time(monkeypatch):
    import time

    times = []
    for mb in (4, 16):
        payload = m.padded("abcdefghij" * (mb << 17))
        stream = m.encode_payload(payload)
        began = time.perf_counter()
        assert m.stored_payload(m.decode(stream)) == payload
        times.append(time.perf_counter() - began)
    assert times[1] < 8 * times[0] + 0.5
    monkeypatch.setattr(m, "LOOK", 8)  # the window grows until the scan ends
    small = m.padded("some text " * 500)
    assert m.stored_payload(m.decode(m.encode_payload(small))) == small
