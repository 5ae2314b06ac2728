import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from sheetspark.llm import jpeg, media


def test_round_trip():
    rng = random.Random(2)
    texts = ["", None, "a", "é" * 288, "x" * 576, "y" * 577, bytes(range(128)).decode() * 50, "word " * 40_000]
    for text, row in zip(texts, media.describe(texts, keep=True)):
        raw = (text or "").encode()
        payload = jpeg.pad(raw)
        assert len(payload) % 576 == 0 and payload.startswith(raw) and set(payload[len(raw) :]) <= {255}
        assert row[:4] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert row[4] == len(row[7]) and row[5] == hashlib.sha256(row[7]).hexdigest()
    for n in (1, 3, 9, 100):
        payload = rng.randbytes(576 * n)
        (head, coefficients), = jpeg.decode([jpeg.encode(payload)])
        assert jpeg.payload_of(head, coefficients) == payload


def slow_coefficients(head, data):
    """A decoder of one scan without restarts, bit by bit."""
    raw = data[head.scan : data.index(b"\xff\xd9", head.scan)].replace(b"\xff\0", b"\xff")
    bits = "".join(f"{b:08b}" for b in raw) + "1" * 32
    at, predicted, out = 0, 0, []

    def symbol(table):
        nonlocal at
        found = int(table[int(bits[at : at + 16], 2)])
        at += found >> 8
        return found & 255

    def value(size):
        nonlocal at
        text, at = bits[at : at + size], at + size
        return 0 if not size else int(text, 2) if text[0] == "1" else int(text, 2) - (1 << size) + 1

    for _ in range(head.across * head.down):
        block, k = [0] * 64, 1
        predicted += value(symbol(head.tables[head.dc]))
        block[0] = predicted
        while k < 64:
            s = symbol(head.tables[head.ac])
            if s == 0:
                break
            k += s >> 4
            block[k] = value(s & 15)
            k += 1
        out.append(block)
    return np.array(out)


def coded(values, table):
    """Bits of a symbol and its value by a table {symbol: code}."""
    symbol, v, size = values
    return table[symbol] + (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else "")


def ordinary_jpeg(rng, across, down):
    """A grey image with runs of zeros, end-of-block codes and no restart intervals."""
    dc = {s: f"{s:04b}" for s in range(12)}
    symbols = [0, 0xF0, *[r << 4 | s for r in range(3) for s in range(1, 6)]]
    ac = {s: f"{i:05b}" for i, s in enumerate(symbols)}
    bits, before = "", 0
    for _ in range(across * down):
        now = rng.randint(-200, 200)
        size = abs(now - before).bit_length()
        bits, before, k = bits + coded((size, now - before, size), dc), now, 1
        while k < 64 and rng.random() < 0.9:
            run, size = rng.randint(0, 2), rng.randint(1, 5)
            if rng.random() < 0.1 and k + 16 < 64:
                bits, k = bits + ac[0xF0], k + 16
                continue
            if k + run > 63:
                break
            v = rng.randint(1 << (size - 1), (1 << size) - 1) * rng.choice((1, -1))
            bits, k = bits + coded((run << 4 | size, v, size), ac), k + run + 1
        if k < 64:
            bits += ac[0]
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    segment = jpeg._segment
    return b"".join([
        b"\xff\xd8", segment(0xDB, b"\0" + b"\4" * 64),
        segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + b"\1\x11\0"),
        segment(0xC4, b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))),
        segment(0xC4, b"\x10" + bytes([0, 0, 0, 0, len(symbols)] + [0] * 11) + bytes(symbols)),
        segment(0xDA, b"\1\1\0\0\x3f\0"), scan, b"\xff\xd9",
    ])


def test_decoder_on_ordinary_images():
    rng = random.Random(9)
    files = [ordinary_jpeg(rng, a, d) for a, d in ((1, 1), (3, 2), (7, 5))]
    for data, (head, coefficients) in zip(files, jpeg.decode(files)):
        assert np.array_equal(coefficients, slow_coefficients(head, data))
        assert jpeg.thumbnail(head, coefficients).shape == (head.down, head.across)


def test_bad_files():
    for bad in (b"GIF89a", b"\xff\xd8\xff\xc2" + struct.pack(">HBHHB", 11, 8, 8, 8, 1) + b"\1\x11\0"):
        with pytest.raises(ValueError):
            jpeg.decode([bad])


def test_table(spark):
    rows = [(1, "same", 0), (2, "same", 1), (3, None, 2), (None, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature int")
    got = {r[0]: tuple(r)[1:] for r in media.media(df).collect()}
    assert got[1] == got[2] and got[3] == got[None] and got[3][:2] == (0, 576)
    assert media.media(df.limit(0)).count() == 0
