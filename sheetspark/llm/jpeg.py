"""Bytes as baseline JPEG images: lossless storage in coefficients, decoding and thumbnails in numpy.

``encode`` stores bytes as the quantised coefficients of a grey baseline image, one byte each. The
256 values of a byte are the 256 coefficient values of magnitude class 8: byte ``b`` is ``b`` for
``b >= 128`` and ``b - 255`` below, whose eight extra bits are the byte itself. Every block of 64
coefficients is a restart interval, so that a block can be decoded by itself.

``decode`` is a decoder of baseline scans for any Huffman tables and any restart interval of grey
images: it parses the markers, then decodes all restart intervals of all images of a batch side by
side, one symbol of each at a time, in numpy. Luminance thumbnails come from the DC coefficients
alone.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

UNIT = 576  # payload bytes come in multiples of it: nine blocks
_HIGHEST = 8000  # rows of blocks; 65,535 pixels are the format's limit


def pad(data: bytes) -> bytes:
    """``data`` and bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def shape(blocks: int) -> tuple[int, int]:
    """Blocks across and down of an image that holds ``blocks`` blocks."""
    across = 3 * max(1, -(-blocks // (3 * _HIGHEST)), int((blocks / 9) ** 0.5))
    return across, -(-blocks // across)


def encode(payload: bytes) -> bytes:
    """The JPEG file of a payload, whose length is a multiple of 64."""
    across, down = shape(len(payload) // 64)
    blocks = np.zeros((across * down, 64), np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    scan = np.zeros((len(blocks), 74), np.uint8)
    for i in range(0, len(blocks), 1 << 14):
        # one Huffman code, the bit 0, for "class 8, no zeros before": nine bits a coefficient, 72 bytes a block
        some = blocks[i : i + (1 << 14)]
        bits = np.zeros((len(some), 64, 9), np.uint8)
        bits[:, :, 1:] = np.unpackbits(some, axis=1).reshape(len(some), 64, 8)
        scan[i : i + len(some), :72] = np.packbits(bits.reshape(len(some), 576), axis=1)
    scan[:, 72] = 0xFF
    scan[:, 73] = 0xD0 + np.arange(len(blocks)) % 8
    flat = scan.reshape(-1)[:-2]
    stuffed = np.flatnonzero(flat == 0xFF)
    stuffed = stuffed[stuffed % 74 != 72]
    out = np.insert(flat, stuffed + 1, 0) if len(stuffed) else flat
    one_code = bytes([1] + [0] * 15 + [8])
    head = [
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _segment(0xFE, b"payload %d" % len(payload)),
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + b"\1\x11\0"),
        _segment(0xC4, b"\0" + one_code),
        _segment(0xC4, b"\x10" + one_code),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ]
    return b"".join(head) + out.tobytes() + b"\xff\xd9"


class Header:
    """What the markers of a grey baseline image say."""

    def __init__(self, data: bytes):
        self.payload = None
        self.tables: dict[int, np.ndarray] = {}
        self.quant: dict[int, np.ndarray] = {}
        self.restart = 0
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at = 2
        while True:
            mark, kind, size = struct.unpack_from(">BBH", data, at)
            if mark != 0xFF:
                raise ValueError("marker expected")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xC0:
                precision, self.height, self.width, parts = struct.unpack_from(">BHHB", body)
                if precision != 8 or parts != 1:
                    raise ValueError("only grey images of 8 bits are stored here")
                self.quant_id = body[8]
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif kind == 0xC4:
                while body:
                    lengths = body[1:17]
                    n = sum(lengths)
                    self.tables[body[0]] = code_table(lengths, body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind == 0xDB:
                while body:
                    wide = 64 * (1 + (body[0] >> 4))
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + wide], ">u2" if body[0] >> 4 else np.uint8).astype(np.int64)
                    body = body[1 + wide :]
            elif kind == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif kind == 0xFE and body.startswith(b"payload "):
                self.payload = int(body[8:])
            elif kind == 0xDA:
                self.dc, self.ac = body[2] >> 4, 0x10 | body[2] & 15
                break
        self.scan = at
        self.across, self.down = -(-self.width // 8), -(-self.height // 8)


@lru_cache(64)
def code_table(lengths: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits that may come: the symbol and, above eight bits, the length of its code; 0: none."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for size, n in enumerate(lengths, 1):
        for symbol in symbols[at : at + n]:
            table[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | symbol
            code += 1
        at, code = at + n, code << 1
    return table


def intervals(data: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a scan without stuffing, and where each restart interval begins in them, the end included."""
    raw = np.frombuffer(data, np.uint8)[start:]
    marks = np.flatnonzero(raw[:-1] == 0xFF)
    follow = raw[marks + 1]
    end = marks[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7))]
    end = int(end[0]) if len(end) else len(raw)
    inside = marks < end
    marks, follow = marks[inside], follow[inside]
    keep = np.ones(end, bool)
    keep[marks[follow == 0] + 1] = False
    restarts = marks[follow != 0]
    keep[restarts] = keep[restarts + 1] = False
    begins = np.zeros(len(restarts) + 2, np.int64)
    dropped = np.cumsum(~keep)
    begins[1:-1] = restarts + 2 - dropped[restarts + 1] if len(restarts) else 0
    begins[-1] = int(keep.sum())
    return raw[:end][keep], begins


def decode(files: list[bytes]) -> list[tuple[Header, np.ndarray]]:
    """Of each file its header and its quantised coefficients, blocks x 64 in stored order."""
    heads = [Header(f) for f in files]
    tables: dict[int, int] = {}  # by identity: the heads keep them
    stacked: list[np.ndarray] = []
    streams, begin, base, blocks, first_block, dc_of, ac_of = [], [], 0, [], 0, [], []
    spans = []
    for head, data in zip(heads, files):
        own, begins = intervals(data, head.scan)
        total, per = head.across * head.down, head.restart or head.across * head.down
        n = -(-total // per)
        if len(begins) - 1 != n:
            raise ValueError("restart intervals are missing")
        ids = []
        for key in (head.dc, head.ac):
            table = head.tables[key]
            if (index := tables.setdefault(id(table), len(stacked))) == len(stacked):
                stacked.append(table)
            ids.append(index)
        streams.append(own)
        begin.append((begins[:-1] + base) * 8)
        counts = np.full(n, per, np.int64)
        counts[-1] = total - per * (n - 1)
        blocks.append(np.column_stack([counts, first_block + per * np.arange(n, dtype=np.int64)]))
        dc_of.append(np.full(n, ids[0] << 16, np.int64))
        ac_of.append(np.full(n, ids[1] << 16, np.int64))
        spans.append((first_block, first_block + total))
        base, first_block = base + len(own), first_block + total
    # one bits past the end, as the format fills up
    stream = np.concatenate([*streams, np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
    window = stream[:-3] << 24 | stream[1:-2] << 16 | stream[2:-1] << 8 | stream[3:]
    table, out = np.concatenate(stacked), np.zeros((first_block, 64), np.int32)
    at, info = np.concatenate(begin), np.concatenate(blocks)
    dc_at, ac_at = np.concatenate(dc_of), np.concatenate(ac_of)
    predicted = np.zeros(len(at), np.int64)
    lanes = np.arange(len(at))
    for step in range(int(info[:, 0].max(initial=0))):
        lanes = lanes[info[lanes, 0] > step]
        _decode_block(window, table, at, lanes, dc_at, ac_at, predicted, out, info[lanes, 1] + step)
    return [(head, out[a:b]) for head, (a, b) in zip(heads, spans)]


def _bits(window: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The next 16 bits at each bit position, and more below them: 25 bits at least are right."""
    return window[at >> 3] << (at & 7).astype(np.uint32)


def _value(window: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value of ``size`` extra bits at each position; class 0 is the value 0."""
    extra = (_bits(window, at).astype(np.uint64) >> (32 - size).astype(np.uint64)).astype(np.int64)
    return np.where(extra >> np.maximum(size - 1, 0) & 1, extra, extra - (1 << size) + 1)


def _decode_block(window, table, at, lanes, dc_at, ac_at, predicted, out, rows) -> None:
    """The next block of each lane: ``at`` moves on, ``out[rows]`` gets the coefficients."""
    here = at[lanes]
    found = table[dc_at[lanes] + (_bits(window, here) >> 16)]
    if not found.all():
        raise ValueError("a code of no symbol")
    size = (found & 255).astype(np.int64)
    here = here + (found >> 8)
    predicted[lanes] += _value(window, here, size)
    out[rows, 0] = predicted[lanes]
    here += size
    own, k, ac = np.arange(len(lanes)), np.ones(len(lanes), np.int64), ac_at[lanes]
    while len(own):
        pos = here[own]
        found = table[ac[own] + (_bits(window, pos) >> 16)]
        if not found.all():
            raise ValueError("a code of no symbol")
        symbol, pos = found & 255, pos + (found >> 8)
        size, place = (symbol & 15).astype(np.int64), k[own] + (symbol >> 4)
        if (place[size > 0] > 63).any():
            raise ValueError("too many coefficients in a block")
        some = size > 0
        if some.all():
            out[rows[own], place] = _value(window, pos, size)
        else:
            out[rows[own][some], place[some]] = _value(window, pos[some], size[some])
        here[own] = pos + size
        k[own] = np.where(symbol == 0, 64, place + 1)  # symbol 0 ends the block
        own = own[k[own] < 64]
    at[lanes] = here


def payload_of(head: Header, coefficients: np.ndarray) -> bytes:
    """The bytes that ``encode`` stored."""
    values = coefficients.reshape(-1)[: head.payload]
    return np.where(values >= 0, values, values + 255).astype(np.uint8).tobytes()


def thumbnail(head: Header, coefficients: np.ndarray) -> np.ndarray:
    """Luminance of each block from its DC coefficient, down x across, 0 to 255."""
    dc = coefficients[:, 0].astype(np.int64) * int(head.quant[head.quant_id][0])
    return np.clip(np.rint(dc / 8) + 128, 0, 255).astype(np.uint8).reshape(head.down, head.across)


def thumbnail_hash(image: np.ndarray, side: int = 8) -> str:
    """64 bits as hexadecimal digits: whether each cell of a grid of means is above their mean."""
    rows = np.linspace(0, image.shape[0], side + 1).astype(int)
    cols = np.linspace(0, image.shape[1], side + 1).astype(int)
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    total[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
    top, left = np.minimum(rows[:-1], image.shape[0] - 1), np.minimum(cols[:-1], image.shape[1] - 1)
    bottom, right = np.maximum(rows[1:], top + 1), np.maximum(cols[1:], left + 1)
    sums = total[np.ix_(bottom, right)] - total[np.ix_(top, right)] - total[np.ix_(bottom, left)] + total[np.ix_(top, left)]
    means = sums // np.outer(bottom - top, right - left)
    return np.packbits((means * side * side > means.sum()).reshape(-1)).tobytes().hex()


def feature(head: Header, coefficients: np.ndarray) -> str:
    """Width x height in pixels, the hash of the DC thumbnail and its CRC."""
    image = thumbnail(head, coefficients)
    return f"{head.width}x{head.height}:{thumbnail_hash(image)}:{zlib.crc32(image.tobytes()):08x}"
