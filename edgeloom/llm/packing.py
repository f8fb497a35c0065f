"""Bounded-space online packing of token ids into training sequences.

Each partition keeps at most WINDOWS open windows. A document's full windows leave at once; its remainder goes to the open
window that it fits best. When it fits none and no further window may open, the fullest one leaves: its gap is filled with the
remainder's first tokens, or stays as padding if it is at most SLACK. At a partition's end the open windows are joined, with cuts, into full ones and
one rest; the rests of GROUP partitions are merged in the same way. State a task: WINDOWS windows, never a partition's tokens.

A null text counts as empty and yields its end token alone. Rows of one doc_id are packed one by one.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of, written

WINDOWS, SLACK, GROUP = 32, 16, 64
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long"
_encoders: dict[str, object] = {}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    A text is cut where white space follows other characters, and where a run of Latin letters ends before a character that is no letter,
    digit or underscore; the vocabulary's own pattern always ends a piece there, so ids of cuts join to the ids of the text.
    Cuts repeat: their ids stay in a memo of at most MEMO entries, emptied when full.
    """

    CUT = re.compile(r"\s*[A-Za-zÀ-ÖØ-öø-ÿ]+(?!\w)|\s*\S+|\s+").findall
    #: White space for Python alone; such texts are encoded whole.
    ODD = re.compile("[\x1c-\x1f]").search
    MEMO = 500_000

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, bytes] = {}

    def new(self, cut: str) -> bytes:
        if len(self.memo) >= self.MEMO:
            self.memo.clear()
        ids = self.memo[cut] = array("I", self.encoding.encode_ordinary(cut)).tobytes()
        return ids

    def ids(self, text: str, end: bytes) -> np.ndarray:
        if self.ODD(text):
            return np.array([*self.encoding.encode_ordinary(text), int.from_bytes(end, "little")], "<u4")
        known, new = self.memo.get, self.new
        return np.frombuffer(b"".join([known(cut) or new(cut) for cut in self.CUT(text)]) + end, "<u4")


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, pattern)
    return _encoders[path]


class Packer:
    """Places pieces (doc_id, start, ids, doc_tokens) into windows of `size`; `rows` has what left, with sequence ids from `first` on."""

    def __init__(self, size: int, first: int):
        self.size, self.next = size, first
        self.open: list[list[tuple]] = []
        self.fill: list[int] = []
        self.rows: list[tuple] = []

    def leave(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at, None, None))
            at += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        size, total = self.size, len(ids)
        start = total // size * size
        for at in range(0, start, size):
            self.leave([(doc, at, ids[at : at + size], total)])
        rest = total - start
        if not rest:
            return
        fits = [f for f in self.fill if f + rest <= size]
        if fits:
            k = self.fill.index(max(fits))
        else:
            if len(self.open) >= WINDOWS:
                k = self.fill.index(max(self.fill))
                gap = size - self.fill[k]
                if gap > SLACK:
                    self.open[k].append((doc, start, ids[start : start + gap], total))
                    start, rest = start + gap, rest - gap
                self.leave(self.open.pop(k))
                self.fill.pop(k)
            k = len(self.open)
            self.open.append([])
            self.fill.append(0)
        self.open[k].append((doc, start, ids[start:], total))
        self.fill[k] += rest
        if self.fill[k] == size:
            self.leave(self.open.pop(k))
            self.fill.pop(k)

    def close(self) -> list[tuple]:
        """Joins the open windows into full ones; the rest."""
        rest = join([p for w in self.open for p in w], self)
        self.open, self.fill = [], []
        return rest


def join(pieces: list[tuple], packer: Packer) -> list[tuple]:
    window: list[tuple] = []
    room = packer.size
    for doc, start, ids, total in pieces:
        while len(ids):
            part = ids[:room]
            window.append((doc, start, part, total))
            start, ids, room = start + len(part), ids[len(part) :], room - len(part)
            if not room:
                packer.leave(window)
                window, room = [], packer.size
    return window


def _pack(path: str, pattern: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, ids, last = Packer(size, part << 32), encoder(path, pattern).ids, end.to_bytes(4, "little")

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * 9
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(columns)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packer.add(doc, ids(text.as_py(), last))
                if len(packer.rows) > 20_000:
                    yield rows()
        for doc, start, rest, total in packer.close():
            packer.rows.append((doc, start, len(rest), None, total, None, None, rest.tobytes(), part))
        yield rows()

    return run


def _merge(size: int):
    """Grouped mapper: the rests of some partitions."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "doc_id", "start"], kind="stable")
        packer = Packer(size, (1 << 62) | int(frame["part"].iloc[0]) // GROUP << 32)
        rest = join([(None if pd.isna(r.doc_id) else int(r.doc_id), int(r.start), np.frombuffer(r.ids, "<u4"), int(r.doc_tokens)) for r in frame.itertuples()], packer)
        if rest:
            packer.leave(rest)
        return pd.DataFrame(packer.rows, columns=[x.split()[0] for x in _SCHEMA.split(", ")]).drop(columns=["ids", "part"]).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, vocabulary: str, pattern: str, size: int = 2048, end: int = 1) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    vocabulary: path of a file of byte-pair ranks on every machine; pattern: its splitting pattern; end: the id put after each document.
    """
    slim = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    packed = written(slim.mapInArrow(_pack(vocabulary, pattern, size, end), _SCHEMA), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rest = packed.filter("sequence_id IS NULL")
    merged = rest.groupBy(F.floor(F.col("part") / GROUP)).applyInPandas(_merge(size), _SCHEMA.partition(", ids b")[0])
    return packed.filter("sequence_id IS NOT NULL").select(columns).unionByName(merged.select(columns))
