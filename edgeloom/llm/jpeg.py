"""Luma of sequential Huffman JPEG frames (8 bits a sample), as motion-JPEG files hold them.

Quantisation and Huffman tables, sampling factors and restart intervals are read from each frame; frames without Huffman tables use
the standard ones, as motion-JPEG allows. Progressive, arithmetic and lossless frames and damaged scans raise ValueError.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

# fixed values: the zigzag order of coefficients (ITU-T T.81, figure 5)
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])

# fixed values: the standard Huffman tables (ITU-T T.81, annex K.3) by class * 16 + destination: codes of each length from 1 to 16, and all symbols
STANDARD = {
    0x00: (
        (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0),
        "00 01 02 03 04 05 06 07 08 09 0a 0b",
    ),
    0x01: (
        (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0),
        "00 01 02 03 04 05 06 07 08 09 0a 0b",
    ),
    0x10: (
        (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 "
        "18 19 1a 25 26 27 28 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 "
        "74 75 76 77 78 79 7a 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 "
        "ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
    0x11: (
        (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 "
        "25 f1 17 18 19 1a 26 27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a "
        "73 74 75 76 77 78 79 7a 82 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 "
        "b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
}


def standard(slot: int) -> tuple[bytes, bytes]:
    """(codes of each length, symbols) of a standard table; the slot is class * 16 + destination."""
    lengths, symbols = STANDARD[slot]
    return bytes(lengths), bytes.fromhex(symbols)


def cosines() -> np.ndarray:
    k, x = np.mgrid[:8, :8]
    return (np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)).astype(np.float32)


_DCT = cosines()


def samples(coefficients: np.ndarray) -> np.ndarray:
    """Coefficients (..., 64) in zigzag order to samples (..., 64), by inverse zigzag and cosine transforms."""
    placed = np.zeros(coefficients.shape, np.float32)
    placed[..., ZIGZAG] = coefficients
    square = placed.reshape(-1, 8, 8)
    return np.clip(np.rint(_DCT.T @ square @ _DCT) + 128, 0, 255).astype(np.uint8).reshape(coefficients.shape)


@lru_cache(maxsize=64)
def _codes(lengths: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, symbol) by the next 16 bits; length 0 where no code fits."""
    found: list[tuple[int, int]] = []
    at = 0
    for length, count in enumerate(lengths, 1):
        for symbol in symbols[at : at + count]:
            found += [(length, symbol)] * (1 << 16 - length)
        at += count
    if len(found) > 1 << 16 or at > len(symbols):
        raise ValueError("no prefix code")
    return found + [(0, 0)] * ((1 << 16) - len(found))


def _quantisers(body: bytes, into: dict[int, np.ndarray]) -> None:
    at = 0
    while at < len(body):
        wide, slot = body[at] >> 4, body[at] & 15
        size = 128 if wide else 64
        into[slot] = np.frombuffer(body[at + 1 : at + 1 + size], ">u2" if wide else np.uint8).astype(np.int32)
        if len(into[slot]) != 64:
            raise ValueError("quantisation table ends early")
        at += 1 + size


def _huffman(body: bytes, into: dict[int, tuple[bytes, bytes]]) -> None:
    at = 0
    while at < len(body):
        lengths = body[at + 1 : at + 17]
        end = at + 17 + sum(lengths)
        into[body[at]] = (lengths, body[at + 17 : end])
        at = end


def _windows(data: bytes) -> list[int]:
    """The 32 bits that begin at each byte, with ones after the end."""
    raw = np.frombuffer(data + b"\xff" * 8, np.uint8).astype(np.uint32)
    return (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).tolist()


def _interval(data: bytes, order: list[tuple[int, list, list]], units: int, coefficients: list[list[list[int]]]) -> None:
    """Decode a restart interval of `units` units; `order` gives (component, DC codes, AC codes) of each block of a unit."""
    windows, p = _windows(data), 0
    before = dict.fromkeys((c for c, _, _ in order), 0)
    for _ in range(units):
        for component, dc, ac in order:
            block = [0] * 64
            k, codes = 0, dc
            while k < 64:
                length, symbol = codes[windows[p >> 3] >> 16 - (p & 7) & 0xFFFF]
                if not length:
                    raise ValueError("unknown code")
                p += length
                if k:
                    run, size = symbol >> 4, symbol & 15
                    if not size and run < 15:
                        break
                    k += run
                else:
                    size = symbol
                if size > 15 or k > 63:
                    raise ValueError("coefficient out of range")
                if size:
                    value = windows[p >> 3] >> 32 - (p & 7) - size & (1 << size) - 1
                    p += size
                    block[k] = value if value >> size - 1 else value - (1 << size) + 1
                if not k:
                    before[component] += block[0]
                    block[0] = before[component]
                    codes = ac
                k += 1
            coefficients[component].append(block)
            if p > 8 * len(data):
                raise ValueError("scan ends early")


def luma(data: bytes) -> np.ndarray:
    """The first component of a frame, shape (height, width)."""
    quantisers: dict[int, np.ndarray] = {}
    tables = {slot: standard(slot) for slot in STANDARD}
    shape, parts, restart, at = None, [], 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one belongs")
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            _quantisers(body, quantisers)
        elif marker == 0xC4:
            _huffman(body, tables)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            bits, height, width, count = struct.unpack_from(">BHHB", body)
            shape = (height, width)
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
            if bits != 8 or not height or not width or not all(h and v for _, h, v, _ in parts):
                raise ValueError("a form of frame that is not read")
        elif marker in range(0xC2, 0xD0) and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a sequential Huffman frame")
        elif marker == 0xDA:
            end = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]", re.S).search(data, at)
            stop = end.start() if end else len(data)
            chosen = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            if shape is None:
                raise ValueError("a scan before its frame")
            if parts[0][0] in (name for name, _ in chosen):
                return _first(data[at:stop], chosen, parts, shape, quantisers, tables, restart)
            at = stop
    raise ValueError("no scan of the first component")


def _first(scan: bytes, chosen: list, parts: list, shape: tuple[int, int], quantisers: dict, tables: dict, restart: int) -> np.ndarray:
    high, wide = max(v for _, _, v, _ in parts), max(h for _, h, _, _ in parts)
    places = {name: k for k, (name, _, _, _) in enumerate(parts)}
    _, h, v, slot = parts[0]
    rows, columns = -(-shape[0] * v // high), -(-shape[1] * h // wide)  # samples of the component
    order = []
    for name, table in chosen:
        _, across, down, _ = parts[places[name]]
        blocks = across * down if len(chosen) > 1 else 1
        order += [(places[name], _codes(*tables[table >> 4]), _codes(*tables[0x10 | table & 15]))] * blocks
    if len(chosen) > 1:
        down, across = -(-shape[0] // (8 * high)), -(-shape[1] // (8 * wide))
    else:  # a scan of one component goes block by block
        down, across, h, v = -(-rows // 8), -(-columns // 8), 1, 1
    units, coefficients = down * across, [[] for _ in parts]
    pieces = re.split(rb"\xff+[\xd0-\xd7]", scan) if restart else [scan]
    step = restart or units
    if len(pieces) < -(-units // step):
        raise ValueError("scan ends early")
    for k, first in enumerate(range(0, units, step)):
        _interval(pieces[k].replace(b"\xff\0", b"\xff"), order, min(step, units - first), coefficients)
    blocks = samples(np.array(coefficients[0], np.int32) * quantisers[slot])
    grid = blocks.reshape(down, across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)
    return grid[:rows, :columns]
