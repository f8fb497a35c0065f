"""Quality by random indexing: word vectors from their neighbours, pooled per document, read by a network of two layers whose temperature is calibrated.

1. A text is cut into runs of letters and digits and runs of other marks. Lower-cased runs are hashed to one of WORDS places; each place has a fixed
   sparse vector of -1, 0 and 1 (its index vector). A word's vector is the sum of the index vectors of the two runs on either side of it, over all
   documents: each task adds up integers, Spark adds up the tasks' tables, which WORDS * SIZE bounds. Vectors are centred, scaled to length one and rounded to
   integers, so that sums over them do not depend on their order.
2. A document is pooled from whole text: the mean vector of its runs and the length of it, the mean likeness of neighbouring runs, shares of equal neighbours, of
   distinct runs and of the shapes of runs (case, digits, length), and the number of runs.
3. A network of two layers (tanh, softmax) is trained in numpy on at most SAMPLE rows of each label, chosen by a hash of doc_id; rows weigh as all labelled rows do.
   A fifth of them is left out: it tells the best step and the temperature by which logits are divided.

A text without runs scores the share of label 1. Without rows of both labels every score is that share (0 without any label). A null text counts as empty;
labels of doc_ids that no document has are ignored, repeated label rows of a doc_id count once (the largest); rows of one doc_id are scored one by one. `score` and `predicted`
replace input columns of these names, all others pass. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .textops import BYTES, SPACE, _Powers, chunks, mix
from .toxicity import held_out

SAMPLE, LINE = 5_000, 0.3
WORDS, SIZE, SIGNS, NEAR, SCALE = 1 << 14, 64, 8, 2, 1 << 10
HIDDEN, EPOCHS, RATE, DECAY = 24, 300, 0.02, 1e-3
#: Bytes of texts and runs that are worked on at once.
PIECE, RUNS = 1 << 19, 1 << 16
_SHAPES = 28

_UPPER, _LOWER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _LOWER[128:] = _DIGIT[48:58] = True
_MARK[:128] = ~(_UPPER | _LOWER | _DIGIT | SPACE)[:128]


def index_vectors() -> np.ndarray:
    """WORDS rows of SIZE small integers: SIGNS places of each, drawn by a hash, get -1 or 1."""
    drawn = mix(np.arange(WORDS * SIGNS, dtype=np.uint64) + np.uint64(1 << 40)).reshape(WORDS, SIGNS)
    made = np.zeros((WORDS, SIZE), np.int8)
    for k in range(SIGNS):
        np.add.at(made, (np.arange(WORDS), (drawn[:, k] % np.uint64(SIZE)).astype(np.int64)), np.where(drawn[:, k] >> np.uint64(63), 1, -1).astype(np.int8))
    return made


class Runs(NamedTuple):
    word: np.ndarray
    row: np.ndarray
    shape: np.ndarray


def runs(data: np.ndarray, offsets: np.ndarray) -> Runs:
    """Place, text and shape of each run of letters and digits or of marks."""
    n = len(data)
    if n == 0:
        return Runs(*(np.zeros(0, np.int64) for _ in range(3)))
    kind = np.where(SPACE[data], 0, np.where(_MARK[data], 2, 1)).astype(np.int8)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    begin = np.flatnonzero(change)
    end = np.r_[begin[1:], n]
    real = kind[begin] > 0
    start, end = begin[real], end[real]
    up, down = _Powers.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[data] * up[:n], out=total[1:])
    word = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)) % np.uint64(WORDS)
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags[data])])[np.stack([start, end])], axis=0)[0]
    upper, lower, digits, size = count(_UPPER), count(_LOWER), count(_DIGIT), end - start
    case = np.select([upper + lower == 0, upper == 0, (lower == 0) & (upper > 1), (upper == 1) & _UPPER[data[start]]], [4, 0, 2, 1], 3)
    shape = np.where(kind[start] == 2, 25 + np.minimum(size, 3) - 1, case * 5 + np.searchsorted([2, 4, 8, 16], size, "right"))
    return Runs(word.astype(np.int64), np.searchsorted(offsets, start, "right") - 1, shape)


def neighbours(found: Runs, index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, their numbers of runs, sums of the index vectors around them), a block of runs at a time."""
    for at in range(0, len(found.word), RUNS):
        low, high = max(0, at - NEAR), min(len(found.word), at + RUNS + NEAR)
        own, row, vectors = found.word[at : at + RUNS], found.row[low:high], index[found.word[low:high]]
        around = np.zeros((high - low, SIZE), np.int8)
        for k in range(1, NEAR + 1):
            same = (row[k:] == row[:-k])[:, None]
            around[k:] += vectors[:-k] * same
            around[:-k] += vectors[k:] * same
        around = around[at - low : at - low + len(own)]
        order = np.argsort(own, kind="stable")
        places, starts = np.unique(own[order], return_index=True)
        yield places, np.diff(np.r_[starts, len(own)]), np.add.reduceat(around[order], starts, dtype=np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """WORDS rows of SIZE integers of at most SCALE in size: centred and scaled sums of neighbours over all documents."""
    names = [f"d{k}" for k in range(SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums, counts = index_vectors(), np.zeros((WORDS, SIZE), np.int64), np.zeros(WORDS, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch, "text", PIECE):
                for places, n, around in neighbours(runs(data, offsets), index):
                    counts[places] += n
                    sums[places] += around
        some = np.flatnonzero(counts)
        if len(some):
            columns = [some.astype(np.int32), counts[some], *(np.ascontiguousarray(sums[some, k]) for k in range(SIZE))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "n", *names])

    parts = docs.select(text_of(docs).alias("text")).mapInArrow(run, f"place int, n bigint, {', '.join(f'{c} bigint' for c in names)}")
    whole = parts.groupBy("place").agg(*(F.sum(c).alias(c) for c in ("n", *names))).toArrow()  # WORDS rows at most
    vectors = np.zeros((WORDS, SIZE))
    if whole.num_rows:
        at, n = (whole.column(c).to_numpy() for c in ("place", "n"))
        sums = np.stack([whole.column(c).to_numpy() for c in names], 1).astype(np.float64)
        mean = sums / n[:, None]
        centred = mean - sums.sum(0) / n.sum()
        vectors[at] = centred / np.maximum(np.sqrt((centred**2).sum(1, keepdims=True)), 1e-9)
    return np.rint(vectors * SCALE).astype(np.int16)


FEATURES = SIZE + _SHAPES + 5


def pooled(found: Runs, rows: int, vectors: np.ndarray) -> np.ndarray:
    """FEATURES numbers of each of `rows` texts; zeros without runs. Sums are of integers, so equal texts have equal numbers."""
    n = np.bincount(found.row, minlength=rows)
    mean, like, equal = np.zeros((rows, SIZE), np.int64), np.zeros(rows), np.zeros(rows)
    for at in range(0, len(found.word), RUNS):
        word, row = found.word[at : at + RUNS + 1], found.row[at : at + RUNS + 1]
        each = vectors[word]
        m = min(RUNS, len(found.word) - at)
        texts, starts = np.unique(row[:m], return_index=True)
        mean[texts] += np.add.reduceat(each[:m], starts, dtype=np.int64)
        pair = np.flatnonzero(row[1:] == row[:-1])
        likeness = np.einsum("ij,ij->i", each[:-1], each[1:], dtype=np.int32)[pair]
        like += np.bincount(row[pair], likeness.astype(np.float64), rows)
        equal += np.bincount(row[pair], word[pair] == word[pair + 1], rows)
    least = np.maximum(n, 1)
    shapes = np.bincount(found.row * _SHAPES + found.shape, minlength=rows * _SHAPES).reshape(rows, _SHAPES) / least[:, None]
    distinct = np.bincount(np.unique(found.row * WORDS + found.word) // WORDS, minlength=rows) / least
    centre = mean / (SCALE * least[:, None])
    pairs = np.maximum(n - 1, 1)
    other = np.stack([np.sqrt((centre**2).sum(1)), like / (SCALE * SCALE * pairs), equal / pairs, distinct, np.log1p(n)], 1)
    return np.concatenate([centre, shapes, other], 1) * (n > 0)[:, None]


class Network(NamedTuple):
    shift: np.ndarray
    spread: np.ndarray
    first: np.ndarray
    start: np.ndarray
    second: np.ndarray
    end: np.ndarray
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(np.clip((x - self.shift) / self.spread, -8, 8) @ self.first + self.start)
        return hidden @ self.second + self.end

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of label 1, with temperature."""
        z = self.logits(x) / self.temperature
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))


def gradients(parameters: list[np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted cross entropy of the two layers with decay of both matrices, and its derivatives. x is scaled, weights sum up to one."""
    first, start, second, end = parameters
    hidden = np.tanh(x @ first + start)
    z = hidden @ second + end
    z = z - z.max(1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    loss = -(weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum() + DECAY / 2 * ((first**2).sum() + (second**2).sum())
    back = p.copy()
    back[np.arange(len(y)), y] -= 1
    back *= weight[:, None]
    below = back @ second.T * (1 - hidden**2)
    return float(loss), [x.T @ below + DECAY * first, below.sum(0), hidden.T @ back + DECAY * second, back.sum(0)]


def temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(temperature, loss): the divisor of logits with the least weighted cross entropy, by narrowing a range of its logarithm."""
    gap = (logits[:, 1] - logits[:, 0]) * np.where(y == 1, 1, -1)
    loss = lambda t: float((weight * np.logaddexp(0, -gap / math.exp(t))).sum() / weight.sum())
    low, high = math.log(0.25), math.log(20)
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2), loss((low + high) / 2)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, left: np.ndarray) -> Network:
    """The network by Adam steps on rows that are not `left`; the left ones choose the step and the temperature (all rows do if a part lacks a label)."""
    kept = [~left, left] if all(len(set(y[part].tolist())) == 2 for part in (left, ~left)) else [np.ones(len(y), bool)] * 2
    shift = x[kept[0]].mean(0)
    spread = x[kept[0]].std(0)
    spread = np.where(spread > 1e-9, spread, np.inf)
    scaled = [np.clip((x[part] - shift) / spread, -8, 8) for part in kept]
    draw = np.random.default_rng(11)
    parameters = [draw.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 2)), np.zeros(2)]
    mean, square = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    share = weight[kept[0]] / weight[kept[0]].sum()
    best = (math.inf, parameters, 1.0)
    for step in range(1, EPOCHS + 1):
        _, found = gradients(parameters, scaled[0], y[kept[0]], share)
        mean = [0.9 * m + 0.1 * g for m, g in zip(mean, found, strict=True)]
        square = [0.99 * s + 0.01 * g * g for s, g in zip(square, found, strict=True)]
        parameters = [p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8) for p, m, s in zip(parameters, mean, square, strict=True)]
        if step % 10 == 0:
            logits = np.tanh(scaled[1] @ parameters[0] + parameters[1]) @ parameters[2] + parameters[3]
            divisor, loss = temperature(logits, y[kept[1]], weight[kept[1]])
            if loss < best[0]:
                best = (loss, parameters, divisor)
    return Network(shift, spread, *best[1], best[2])


class Model(NamedTuple):
    vectors: np.ndarray
    network: Network | None
    share: float

    def scores(self, found: Runs, rows: int) -> np.ndarray:
        """A score for each text, rounded to nine digits."""
        made = np.full(rows, self.share)
        some = np.bincount(found.row, minlength=rows) > 0
        if self.network is not None and some.any():
            made[some] = self.network.probability(pooled(found, rows, self.vectors)[some])
        return np.round(made, 9)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Word vectors from all of docs; the network from labelled rows that are not held out, at most `sample` of each label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label IN (0, 1)").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {int(r.label): int(r.n) for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = [counts.get(0, 0), counts.get(1, 0)]
    share = n[1] / max(1, sum(n))
    if not all(n):
        return Model(np.zeros((WORDS, SIZE), np.int16), None, share)
    vectors = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)  # WORDS * SIZE small integers
    by_hash = lambda label: known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = by_hash(0).union(by_hash(1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(picked), "doc_id")  # 2 * sample rows at most

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch, "text", PIECE):
                part = batch.slice(at, to - at)
                x = pooled(runs(data, offsets), to - at, sent.value)
                left = [zlib.crc32(b"left:" + data[a:b].tobytes()) % 5 == 0 for a, b in zip(offsets, offsets[1:])]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in ("doc_id", "label")] + [pa.array(left), lists], names=["doc_id", "label", "left", "x"])

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed = list(frames)
        every = pd.concat(listed, ignore_index=True) if listed else pd.DataFrame({"label": []})
        if every["label"].nunique() < 2:
            return
        x, y = np.stack(every["x"].to_list()), every["label"].to_numpy().astype(np.int64)
        order = np.lexsort((*x.T[::-1], every["doc_id"].to_numpy()))
        x, y, left = x[order], y[order], every["left"].to_numpy()[order]
        weight = (np.array(n) / np.bincount(y, minlength=2))[y]
        made = fit(x, y, weight, left)
        yield pd.DataFrame({"part": range(7), "values": [np.asarray(p, "<f8").tobytes() for p in made]})

    pooled_rows = rows.mapInArrow(pool, "doc_id bigint, label int, left boolean, x array<double>")
    parts = {r["part"]: np.frombuffer(r["values"], "<f8") for r in pooled_rows.repartition(1).mapInPandas(learn, "part int, values binary").collect()}
    if not parts:
        return Model(vectors, None, share)
    network = Network(parts[0], parts[1], parts[2].reshape(FEATURES, HIDDEN), parts[3], parts[4].reshape(HIDDEN, 2), parts[5], float(parts[6][0]))
    return Model(vectors, network, share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from LINE on), which replace input columns of these names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted", "__text").withColumn("__text", text_of(docs))
    names = [c for c in docs.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.scores(runs(data, offsets), to - at) for at, to, data, offsets in chunks(batch, "__text", PIECE)]
            found = np.concatenate([np.zeros(0), *scores])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(found), pa.array((found >= LINE).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", "predicted"])

    schema = T.StructType([*docs.select(names).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample))
