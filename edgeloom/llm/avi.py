"""Byte payloads as motion-JPEG video in AVI files, and timed clips of such files.

A payload's unit is a quantised coefficient: each block of 8 x 8 pixels holds 64 bytes. The Huffman tables give the one code
of a coefficient of magnitude category 8, which has 8 free bits, 8 bits of length; restart markers after each block keep DC values
absolute. So frames are baseline JPEG, every byte stays aligned, and bytes read back are the bytes stored. A frame has BLOCKS blocks;
the last one is padded, and an INFO chunk keeps the payload's length.

`clips` parses the RIFF chunks and the index, decodes the intra frames to pixels (frames of other writers by `jpeg.luma`), and cuts
where the histogram difference of neighbouring frames exceeds mean + DEVIATIONS * standard deviation of the differences around it
(and FLOOR). Files beyond one RIFF segment (OpenDML) are read up to the end of the first.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .common import text_of

UNIT, COLUMNS, ROWS = 64, 4, 4
BLOCKS = COLUMNS * ROWS
FRAME = BLOCKS * UNIT
RATE, BINS, AROUND, DEVIATIONS, FLOOR = 25, 32, 4, 1.5, 0.15
CODE = 0x00


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head() -> bytes:
    quant = _segment(0xDB, b"\0" + b"\1" * 64)
    frame = _segment(0xC0, struct.pack(">BHHB", 8, ROWS * 8, COLUMNS * 8, 1) + b"\1\x11\0")
    lengths = bytes(7) + b"\1" + bytes(8)  # one code, of 8 bits
    tables = _segment(0xC4, b"\0" + lengths + b"\x08") + _segment(0xC4, b"\x10" + lengths + b"\x08")
    restart = _segment(0xDD, struct.pack(">H", 1))
    return b"\xff\xd8" + quant + frame + tables + restart + _segment(0xDA, b"\1\1\0\0\x3f\0")


HEAD, TAIL = _head(), b"\xff\xd9"


def _bits(values: np.ndarray) -> np.ndarray:
    """Extra bits of category 8 and coefficients are one to one: 128..255 stand for themselves, 0..127 for -255..-128."""
    return values.astype(np.int16) - np.where(values < 128, 255, 0).astype(np.int16)


def encode_frame(data: bytes) -> bytes:
    """A JPEG of FRAME bytes."""
    coded = np.zeros((BLOCKS, UNIT, 2), np.uint8)
    coded[:, :, 0] = CODE
    coded[:, :, 1] = np.frombuffer(data, np.uint8).reshape(BLOCKS, UNIT)
    parts = [HEAD]
    for k, block in enumerate(coded):
        parts.append(block.tobytes().replace(b"\xff", b"\xff\0"))
        if k < BLOCKS - 1:
            parts.append(bytes((0xFF, 0xD0 + k % 8)))
    return b"".join(parts) + TAIL


def decode_frame(jpeg: bytes) -> np.ndarray:
    """The bytes of a frame, shape (BLOCKS, UNIT). Rejects files that differ from the stored form."""
    if not jpeg.startswith(HEAD) or not jpeg.endswith(TAIL):
        raise ValueError("not a frame of this form")
    scan = jpeg[len(HEAD) : -2]
    for k in range(8):
        scan = scan.replace(bytes((0xFF, 0xD0 + k)), b"")  # a data byte 0xFF is followed by 0, never by a marker
    pairs = np.frombuffer(scan.replace(b"\xff\0", b"\xff"), np.uint8).reshape(BLOCKS, UNIT, 2)
    if (pairs[:, :, 0] != CODE).any():
        raise ValueError("unknown code")
    return pairs[:, :, 1]


def pixels(blocks: np.ndarray) -> np.ndarray:
    """Frames (n, BLOCKS, UNIT) of stored bytes to pixels (n, BLOCKS, 64)."""
    return jpeg.samples(_bits(blocks))


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI of a payload, whose length is a positive multiple of UNIT."""
    frames = [encode_frame(payload[k : k + FRAME].ljust(FRAME, b"\0")) for k in range(0, len(payload), FRAME)]
    width, height, most = COLUMNS * 8, ROWS * 8, max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ISRC", str(len(payload)).encode()))
    movie, index, at = [b"movi"], [], 4
    for jpeg in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
        movie.append(_chunk(b"00dc", jpeg))
        at += len(movie[-1])
    return _chunk(b"RIFF", b"AVI " + header + info + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, byte after the last) of the chunks of data[at:end]."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("a chunk is longer than its file")
        yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


def frames_of(data: bytes) -> tuple[list[bytes], int | None, float]:
    """(JPEG frames, payload length where one is kept, seconds a frame) of an AVI's first video stream.

    Frames are found by the index, whose offsets count from the movie list or from the file; without an index, by walking the
    movie list. A frame of no bytes repeats the one before it.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI")
    movie, end, entries, length, step = 0, 0, [], None, 1 / RATE
    for name, a, b in _chunks(data, 12, len(data)):
        kind = data[a : a + 4]
        if name == b"LIST" and kind == b"hdrl":
            for inner, c, _ in _chunks(data, a + 4, b):
                if inner == b"avih":
                    step = struct.unpack_from("<I", data, c)[0] / 1e6
        elif name == b"LIST" and kind == b"INFO":
            length = next((int(data[c:d].rstrip(b"\0")) for inner, c, d in _chunks(data, a + 4, b) if inner == b"ISRC"), None)
        elif name == b"LIST" and kind == b"movi":
            movie, end = a, b
        elif name == b"idx1":
            entries = [(name, at, size) for name, _, at, size in struct.iter_unpack("<4sIII", data[a:b])]
    if entries:
        base = movie if any(data[movie + at : movie + at + 4] == name for name, at, _ in entries[:1]) else 0
        found = [(name, base + at + 8, base + at + 8 + size) for name, at, size in entries]
    else:
        found = list(_movie(data, movie + 4, end))
    video = [(name, a, b) for name, a, b in found if name[2:] in (b"dc", b"db")]
    frames: list[bytes] = []
    for name, a, b in video:
        if name == video[0][0]:
            frames.append(data[a:b] if b > a or not frames else frames[-1])
    return frames, length, step


def _movie(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Chunks of a movie list and of the record lists in it."""
    for name, a, b in _chunks(data, at, end):
        if name == b"LIST":
            yield from _chunks(data, a + 4, b)
        else:
            yield name, a, b


def read_avi(data: bytes) -> tuple[bytes, np.ndarray, float]:
    """(payload, frames of stored bytes, seconds a frame) of a file of `write_avi`."""
    jpegs, length, step = frames_of(data)
    stored = np.stack([decode_frame(x) for x in jpegs]) if jpegs else np.zeros((0, BLOCKS, UNIT), np.uint8)
    return stored.tobytes()[:length], stored, step


def histograms(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of frames (n, ...) of pixels: shares of BINS ranges of luma (n, BINS), mean luma (n)."""
    n = len(frames)
    flat = frames.reshape(n, -1)
    cells = (flat // (256 // BINS)).astype(np.int64) + np.arange(n)[:, None] * BINS
    return np.bincount(cells.ravel(), minlength=n * BINS).reshape(n, BINS) / flat.shape[1], flat.mean(1)


def cuts(distance: np.ndarray) -> np.ndarray:
    """Indices of the first frame after each cut."""
    if not len(distance):
        return np.zeros(0, np.int64)
    ones = np.ones(2 * AROUND + 1)
    middle = slice(AROUND, AROUND + len(distance))
    n, total, squares = (np.convolve(x, ones)[middle] for x in (np.ones(len(distance)), distance, distance**2))
    mean = total / n
    limit = np.maximum(FLOOR, mean + DEVIATIONS * np.sqrt(np.maximum(0, squares / n - mean**2)))
    return np.flatnonzero(distance > limit) + 1


def clip_rows(data: bytes) -> list[tuple[int, float, float, int, float]]:
    """(clip, start and end in seconds, frames, mean luma) of an AVI, frame by frame for files of other writers."""
    jpegs, _, step = frames_of(data)
    if all(x.startswith(HEAD) for x in jpegs):
        return _clips(read_avi(data)[1], step)
    shares, means = zip(*(histograms(jpeg.luma(x)[None]) for x in jpegs), strict=True)
    return _cut(np.concatenate(shares), np.concatenate(means), step)


def _clips(stored: np.ndarray, step: float) -> list[tuple[int, float, float, int, float]]:
    return _cut(*histograms(pixels(stored)), step) if len(stored) else []


def _cut(shares: np.ndarray, luma: np.ndarray, step: float) -> list[tuple[int, float, float, int, float]]:
    """Shots, cut where half the L1 distance of neighbouring histograms is high for its surroundings."""
    distance = np.abs(np.diff(shares, axis=0)).sum(1) / 2
    edges = [0, *cuts(distance).tolist(), len(shares)]
    return [(k, round(a * step, 3), round(b * step, 3), b - a, round(float(luma[a:b].mean()), 3)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def padded(text: str) -> tuple[int, bytes]:
    data = text.encode()
    return len(data), data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\0")


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): texts as AVI files; a null text counts as empty, whose payload is one unit of zeros."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [padded(x) for x in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": [n for n, _ in made], "media": [write_avi(p) for _, p in made]})

    return docs.select("doc_id", text_of(docs).alias("text")).mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """(doc_id, clip, start_s, end_s, frames, luma, error) of a table with doc_id and media.

    Motion-JPEG of any writer is read. Null media and files without frames give no rows; files that cannot be read give one row
    with the reason in `error` and nulls for the clip.
    """

    def of(data: bytes) -> list[tuple]:
        try:
            return [(*row, None) for row in clip_rows(data)]
        except (ValueError, LookupError, struct.error) as problem:
            return [(None, None, None, None, None, str(problem) or type(problem).__name__)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column("doc_id"), batch.column("media"), strict=True):
                rows = of(data.as_py()) if data.is_valid else []
                if rows:
                    columns = zip(*rows, strict=True)
                    ids = pa.array([doc.as_py()] * len(rows), doc.type)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, _CLIP, strict=True))], names=["doc_id", "clip", "start_s", "end_s", "frames", "luma", "error"])

    schema = "clip int, start_s double, end_s double, frames int, luma double, error string"
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {dict(media.dtypes)['doc_id']}, {schema}")


_CLIP = (pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.string())
_DIGEST = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query: texts are stored and read back in one pass, so no media travel between stages."""

    def one(text: str) -> tuple:
        n, payload = padded(text)
        media = write_avi(payload)
        back, stored, step = read_avi(media)
        found = _clips(stored, step)
        feature = ";".join(f"{a:.3f}-{b:.3f}:{frames}:{luma:.3f}" for _, a, b, frames, luma in found)
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * len(_DIGEST)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, _DIGEST, strict=True))], names=["doc_id", *_DIGEST.names])

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {schema}")
