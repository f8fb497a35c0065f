"""Motion-JPEG of another encoder (the JVM's) through the decoder, and files that cannot be read."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from edgeloom.llm import avi, jpeg

WIDTH, HEIGHT = 37, 21


def picture(k: int) -> np.ndarray:
    """A smooth picture with an edge, (HEIGHT, WIDTH, 3)."""
    y, x = np.mgrid[:HEIGHT, :WIDTH]
    made = np.stack([120 + 60 * np.sin(x / 9 + k), 110 + 50 * np.cos(y / 7), 90 + x + y], -1)
    made[: HEIGHT // 2, : WIDTH // 3] -= 40
    return np.clip(made, 0, 255).astype(int)


def encoded(spark, pixels: np.ndarray, gray: bool, quality: float = 0.9) -> bytes:
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(pixels.shape[1], pixels.shape[0], 10 if gray else 1)
    for y, row in enumerate(pixels.tolist()):
        for x, (r, g, b) in enumerate(row):
            if gray:
                image.getRaster().setSample(x, y, 0, r)
            else:
                image.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    settings = writer.getDefaultWriteParam()
    settings.setCompressionMode(2)  # explicit
    settings.setCompressionQuality(quality)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), settings)
    stream.close()
    return bytes(out.toByteArray())


def without_tables(data: bytes) -> bytes:
    """A frame less its Huffman tables, as cameras write motion-JPEG."""
    at, kept = 2, [data[:2]]
    while data[at + 1] != 0xDA:
        size = struct.unpack_from(">H", data, at + 2)[0] + 2
        if data[at + 1] != 0xC4:
            kept.append(data[at : at + size])
        at += size
    return b"".join(kept) + data[at:]


def file_of(frames: list[bytes], index: str = "movie") -> bytes:
    main = struct.pack("<14I", 40_000, 0, 0, 0x10, len(frames), 0, 1, 0, WIDTH, HEIGHT, 0, 0, 0, 0)
    header = avi._chunk(b"LIST", b"hdrl" + avi._chunk(b"avih", main))
    start = 12 + len(header) + 8
    movie, entries, at = [b"movi"], [], 4
    for x in frames:
        entries.append(struct.pack("<4sIII", b"00dc", 0x10, at + (start if index == "file" else 0), len(x)))
        movie.append(avi._chunk(b"00dc", x))
        at += len(movie[-1])
        movie.append(avi._chunk(b"01wb", b"sound"))
        at += len(movie[-1])
    tail = avi._chunk(b"idx1", b"".join(entries)) if index else b""
    return avi._chunk(b"RIFF", b"AVI " + header + avi._chunk(b"LIST", b"".join(movie)) + tail)


def test_standard_tables_equal_the_jvm_s(spark):
    known = spark._jvm.javax.imageio.plugins.jpeg.JPEGHuffmanTable
    for slot, table in ((0, known.StdDCLuminance), (1, known.StdDCChrominance), (16, known.StdACLuminance), (17, known.StdACChrominance)):
        lengths, symbols = jpeg.standard(slot)
        assert list(symbols) == list(table.getValues())
        assert [n for n in lengths] == list(table.getLengths()) + [0] * (16 - len(table.getLengths()))


@pytest.mark.parametrize("quality", [0.3, 0.95])
def test_gray_frames(spark, quality):
    pixels = picture(1)
    data = encoded(spark, pixels, True, quality)
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data)).getRaster()
    wanted = np.array([[image.getSample(x, y, 0) for x in range(WIDTH)] for y in range(HEIGHT)])
    assert np.abs(jpeg.luma(data).astype(int) - wanted).max() <= 1
    assert (jpeg.luma(without_tables(data)) == jpeg.luma(data)).all()


def test_colour_frames(spark):
    pixels = picture(2)
    made = jpeg.luma(encoded(spark, pixels, False, 0.95)).astype(float)
    assert made.shape == (HEIGHT, WIDTH)
    assert np.abs(made - pixels @ [0.299, 0.587, 0.114]).max() < 12
    assert np.abs(made - pixels @ [0.299, 0.587, 0.114]).mean() < 2


def test_own_frames_through_the_general_decoder():
    data = bytes(np.random.default_rng(1).integers(0, 256, avi.FRAME, dtype=np.uint8))
    blocks = avi.pixels(avi.decode_frame(avi.encode_frame(data))[None])[0]
    wanted = blocks.reshape(avi.ROWS, avi.COLUMNS, 8, 8).transpose(0, 2, 1, 3).reshape(avi.ROWS * 8, avi.COLUMNS * 8)
    assert (jpeg.luma(avi.encode_frame(data)) == wanted).all()


@pytest.mark.parametrize("index", ["movie", "file", ""])
def test_clips_of_other_writers(spark, index):
    dark, light = encoded(spark, picture(0) // 4, True), encoded(spark, picture(0) // 4 + 150, True)
    rows = avi.clips(spark.createDataFrame([(7, bytearray(file_of([dark] * 10 + [b""] + [light] * 9, index)))], "doc_id long, media binary")).collect()
    assert [(r.clip, r.start_s, r.end_s, r.frames, r.error) for r in rows] == [(0, 0.0, 0.44, 11, None), (1, 0.44, 0.8, 9, None)]


def test_unreadable_media_are_told(spark):
    whole = encoded(spark, picture(0), True)
    progressive = whole.replace(b"\xff\xc0", b"\xff\xc2", 1)
    made = file_of([whole] * 3)
    cases = [
        (1, b"no video"), (2, made[: len(made) // 2]), (3, file_of([progressive])), (4, file_of([whole[: len(whole) // 2]])), (5, b""),
        (6, None), (7, made), (8, file_of([])), (None, b"RIFF\x04\0\0\0AVI "), (9, file_of([whole[:4]])),
    ]
    rows = avi.clips(spark.createDataFrame([(k, x and bytearray(x)) for k, x in cases], "doc_id long, media binary")).collect()
    assert {r.doc_id for r in rows if r.error} >= {1, 2, 3, 4, 9} and all(r.clip is None for r in rows if r.error)
    assert [(r.doc_id, r.clip, r.frames) for r in rows if not r.error] == [(7, 0, 3)]
    assert avi.clips(spark.createDataFrame([], "doc_id long, media binary")).count() == 0
