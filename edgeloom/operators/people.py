"""Edge selection and models of many people: tasks hold rows of people, not blocks of edges, and only moments leave them.

A person is one row of arrays (edges, scores and folds by iteration, covariates). A first pass over the rows adds up means and centred products of edges, covariates
and scores by part; the masks of all training parts follow from them, numbers of the size edges x iterations x folds. A second pass sums each person's edges over the
masks and keeps means and centred products of the two strengths and the score, from which models, predictions, r and mse follow. Partial results are combined by
their means (Chan, Golub and LeVeque), so values far from zero and constant columns lose no digits. Nothing grows with the people but the rows themselves.

Ranks in a training part are window counts: rows up to the value less those of the part held out. A tied one is stored with a minus sign.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import critical_distance, critical_r
from ..sources.shared import written
from . import engine

#: Numbers of a slice of iterations (edges times folds times iterations), numbers of one step of a task.
MOST, STEP = 1_000_000, 500_000


class Moments:
    """Count, means and centred products of edges x, covariates z and scores y of some rows; with_other combines two."""

    def __init__(self, n, mx, mz, my, xx, xz, zz, xy, zy, yy):
        self.n, self.mx, self.mz, self.my, self.xx, self.xz, self.zz, self.xy, self.zy, self.yy = n, mx, mz, my, xx, xz, zz, xy, zy, yy

    @classmethod
    def of(cls, x: np.ndarray, z: np.ndarray, y: np.ndarray) -> Moments:
        n = len(x)
        mean = lambda v: v.mean(0) if n else np.zeros(v.shape[1])
        mx, mz, my = mean(x), mean(z), mean(y)
        x, z, y = x - mx, z - mz, y - my
        return cls(float(n), mx, mz, my, (x * x).sum(0), x.T @ z, z.T @ z, x.T @ y, z.T @ y, (y * y).sum(0))

    def with_other(self, o: Moments) -> Moments:
        n = self.n + o.n
        if not self.n or not o.n:
            return self if self.n else o
        dx, dz, dy, w = o.mx - self.mx, o.mz - self.mz, o.my - self.my, self.n * o.n / n
        means = [m + d * (o.n / n) for m, d in ((self.mx, dx), (self.mz, dz), (self.my, dy))]
        products = [(self.xx, o.xx, dx * dx), (self.xz, o.xz, np.outer(dx, dz)), (self.zz, o.zz, np.outer(dz, dz)), (self.xy, o.xy, np.outer(dx, dy)), (self.zy, o.zy, np.outer(dz, dy)), (self.yy, o.yy, dy * dy)]
        return Moments(n, *means, *(a + b + w * d for a, b, d in products))

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.n, len(self.mx), len(self.mz), len(self.my)], *(np.ravel(v) for v in (self.mx, self.mz, self.my, self.xx, self.xz, self.zz, self.xy, self.zy, self.yy))])

    @classmethod
    def from_flat(cls, v: np.ndarray) -> Moments:
        e, k, i = (int(s) for s in v[1:4])
        shapes = [(e,), (k,), (i,), (e,), (e, k), (k, k), (e, i), (k, i), (i,)]
        ends = np.cumsum([4] + [int(np.prod(s)) for s in shapes])
        return cls(v[0], *(v[a:b].reshape(s) for a, b, s in zip(ends, ends[1:], shapes)))  # noqa: B905


class Sides:
    """The same of two strengths and a score for many iterations at once: rows are n, means of (pos, neg, y), products pp, nn, yy, pn, py, ny."""

    @staticmethod
    def of(p: np.ndarray, q: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = len(p)
        if not n:
            return np.zeros((10, y.shape[1]))
        means = [v.mean(0) for v in (p, q, y)]
        p, q, y = (v - m for v, m in zip((p, q, y), means, strict=True))
        s = lambda a, b: np.einsum("ij,ij->j", a, b)
        return np.stack([np.full(y.shape[1], float(n)), *means, s(p, p), s(q, q), s(y, y), s(p, q), s(p, y), s(q, y)])

    @staticmethod
    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[0] + b[0]
        share, w = b[0] / np.maximum(n, 1), a[0] * b[0] / np.maximum(n, 1)
        p, q, y = (b[k] - a[k] for k in (1, 2, 3))
        return np.stack([n, *(a[k] + share * d for k, d in ((1, p), (2, q), (3, y))), *(a[k] + b[k] + w * d for k, d in zip(range(4, 10), (p * p, q * q, y * y, p * q, p * y, q * y), strict=True))])


def training_ranks(rows: DataFrame, by: list[str], value: str, folds: list[int]) -> DataFrame:
    """rows with `ranks`: twice the mean rank of the value among the rows of `by` without each fold; negative where it is tied there."""
    order = W.partitionBy(*by).orderBy(value)
    upto, same = order.rangeBetween(W.unboundedPreceding, W.currentRow), order.rangeBetween(W.currentRow, W.currentRow)
    held = lambda h: F.sum((F.col("fold") == h).cast("int"))

    def one(h: int):
        below, equal = F.count("*").over(upto) - held(h).over(upto), F.count("*").over(same) - held(h).over(same)
        return (F.when(equal > 1, -1).otherwise(1) * (2 * below - equal + 1)).cast("int")

    return rows.withColumn("ranks", F.array(*map(one, folds)))


class Run:
    """What a run knows beforehand: edges, folds, iterations and those that share a plan of folds."""

    def __init__(self, edges: DataFrame, outcome: DataFrame, names: list[str]):
        sign = [F.bit_xor(F.xxhash64("subject_row", "fold")).alias("a"), F.bit_xor(F.xxhash64(F.lit(7), "fold", "subject_row")).alias("b")]
        found = sorted(outcome.groupBy("iter").agg(F.count("*").alias("n"), *sign).collect(), key=lambda r: r["iter"])  # a row an iteration
        self.iters = np.array([r["iter"] for r in found], np.int64)
        seen: dict[tuple, int] = {}
        self.plan = np.array([seen.setdefault((r["n"], r["a"], r["b"]), len(seen)) for r in found], np.int64)
        self.folds = sorted(r[0] for r in outcome.select("fold").distinct().collect())
        self.edges = np.array(sorted(r[0] for r in edges.select("edge_id").distinct().collect()), np.int64)
        self.names, self.ranks, self.types = names, False, dict(outcome.dtypes) | {"edge_id": dict(edges.dtypes)["edge_id"]}

    def part(self, places: np.ndarray, ranks: bool) -> Run:
        own = object.__new__(Run)
        own.__dict__.update(self.__dict__ | {"iters": self.iters[places], "plan": self.plan[places], "ranks": ranks})
        return own

    def parts(self, ranks: bool) -> list[Run]:
        """Slices of iterations of at most MOST numbers; with ranks a slice has one plan."""
        each = max(1, MOST // max(1, len(self.edges) * len(self.folds)))
        groups = [np.flatnonzero(self.plan == k) for k in np.unique(self.plan)] if ranks else [np.arange(len(self.iters))]
        return [self.part(g[at : at + each], ranks) for g in groups for at in range(0, len(g), each)]

    def plans(self) -> Iterator[tuple[int, np.ndarray]]:
        for k in np.unique(self.plan):
            yield int(k), np.flatnonzero(self.plan == k)


def rows_of_people(edges: DataFrame, outcome: DataFrame, covariates: DataFrame | None, run: Run) -> DataFrame:
    """One row a person: x by edge, iters, fold and y by iteration, z; with ranks also those of each training part, one fold after the other."""
    extra = ["ranks"] if run.ranks else []
    scored = outcome.filter(F.col("iter").between(int(run.iters.min()), int(run.iters.max()))).select("subject_row", "iter", "fold", "y")
    if run.ranks:  # iterations of one plan need not follow each other
        scored = scored.filter(F.col("iter").isin(run.iters.tolist()))
    x = edges.select("subject_row", "edge_id", "value")
    if run.ranks:
        own = scored.filter(F.col("iter") == int(run.iters[0])).select("subject_row", "fold")
        x, scored = training_ranks(x.join(own, "subject_row"), ["edge_id"], "value", run.folds), training_ranks(scored, ["iter"], "y", run.folds)
    gathered = lambda key, *c: F.sort_array(F.collect_list(F.struct(key, *c))).alias("v")
    x = x.groupBy("subject_row").agg(gathered("edge_id", "value", *extra)).select("subject_row", F.col("v.value").alias("x"), *([F.flatten("v.ranks").alias("xr")] if run.ranks else []))
    y = scored.groupBy("subject_row").agg(gathered("iter", "fold", "y", *extra)).select("subject_row", F.col("v.iter").cast("array<long>").alias("iters"), F.col("v.fold").cast("array<long>").alias("folds"), F.col("v.y").cast("array<double>").alias("y"), *([F.flatten("v.ranks").alias("yr")] if run.ranks else []))
    people = y.join(x, "subject_row", "left")
    if covariates is not None:
        z = covariates.select("subject_row", F.array(*(F.col(c).cast("double") for c in run.names)).alias("z"))
        if run.ranks:
            long = covariates.select("subject_row", F.posexplode(F.array(*(F.col(c).cast("double") for c in run.names))).alias("place", "value")).join(own, "subject_row")
            ranked = training_ranks(long, ["place"], "value", run.folds).groupBy("subject_row").agg(gathered("place", "ranks"))
            z = z.join(ranked.select("subject_row", F.flatten("v.ranks").alias("zr")), "subject_row")
        people = people.join(z, "subject_row", "left")
    return written(people, "people")


def steps(batches: Iterator[pa.RecordBatch], run: Run) -> Iterator[dict[str, np.ndarray]]:
    """Arrays of a few people at a time: people, x, y and fold (NaN and -1 where somebody takes no part), z; ranks by people, column and fold."""
    e, i, h, k = len(run.edges), len(run.iters), len(run.folds), len(run.names)
    size = max(1, STEP // max(1, (e + i) * (h if run.ranks else 1)))
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            batch = whole.slice(at, size)
            n = batch.num_rows

            def matrix(name: str, shape: tuple[int, ...], message: str) -> np.ndarray:
                column = batch.column(name)  # noqa: B023
                values = column.flatten().to_numpy(zero_copy_only=False)
                if column.null_count or len(values) != n * int(np.prod(shape)) or np.isnan(values).any():  # noqa: B023
                    raise ValueError(message)
                return values.reshape(n, *shape)  # noqa: B023

            step = {"people": batch.column("subject_row").to_numpy(zero_copy_only=False), "x": matrix("x", (e,), "a person lacks an edge"), "z": matrix("z", (k,), "a person lacks a covariate") if k else np.zeros((n, 0))}
            rows = np.repeat(np.arange(n), batch.column("iters").value_lengths().to_numpy(zero_copy_only=False))
            iters = batch.column("iters").flatten().to_numpy(zero_copy_only=False)
            place = np.searchsorted(run.iters, iters)
            step["y"], step["fold"] = np.full((n, i), np.nan), np.full((n, i), -1, np.int64)
            step["y"][rows, place] = batch.column("y").flatten().to_numpy(zero_copy_only=False)
            step["fold"][rows, place] = batch.column("folds").flatten().to_numpy(zero_copy_only=False)
            if run.ranks:
                step["xr"] = matrix("xr", (e, h), "a person lacks an edge")
                step["yr"] = np.zeros((n, i, h), np.int32)
                step["yr"][rows, place] = batch.column("yr").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), h)
                step["zr"] = matrix("zr", (k, h), "a person lacks a covariate") if k else np.zeros((n, 0, h))
            yield step


def _merged(combine: Callable) -> Callable:
    """Mapper over frames of (plan, part, v): one row a key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[tuple[int, int], np.ndarray] = {}
        for f in frames:
            for plan, part, v in zip(f["plan"], f["part"], f["v"], strict=True):
                v = np.asarray(v)
                have[plan, part] = combine(have[plan, part], v) if (plan, part) in have else v
        if have:
            yield pd.DataFrame({"plan": [k[0] for k in have], "part": [k[1] for k in have], "v": list(have.values())})

    return run


_SUMS = "plan long, part long, v array<double>"


def summed(people: DataFrame, sums: Callable, combine: Callable) -> DataFrame:
    """(plan, part, v) over all people: sums gives (plan, part, v) of a step, combine joins two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[tuple[int, int], np.ndarray] = {}
        for plan, part, v in sums(batches):
            have[plan, part] = combine(have[plan, part], v) if (plan, part) in have else v
        if have:
            yield pa.RecordBatch.from_pydict({"plan": pa.array([k[0] for k in have], pa.int64()), "part": pa.array([k[1] for k in have], pa.int64()), "v": pa.array(list(have.values()), pa.list_(pa.float64()))})

    return people.mapInArrow(run, _SUMS).repartition("plan", "part").mapInPandas(_merged(combine), _SUMS)


def independent(gram: np.ndarray) -> list[int]:
    """Columns that raise the rank of (1, columns before them), in order, from their centred products."""
    kept: list[int] = []
    for i in range(len(gram)):
        left = gram[i, i]
        if kept:
            left -= gram[i, kept] @ np.linalg.solve(gram[np.ix_(kept, kept)], gram[kept, i])
        if left > 1e-10 * max(gram[i, i], np.finfo(float).tiny):
            kept.append(i)
    return kept


def first_pass(people: DataFrame, run: Run) -> dict[tuple[int, int], Moments]:
    """Moments by (plan, part). Parts are folds; with ranks they are training parts (the place of the fold held out), and below 0 raw covariates by fold."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        for s in steps(batches, run):
            for plan, places in run.plans():
                fold = s["fold"][:, places[0]]
                for at, h in enumerate(run.folds):
                    here = fold == h
                    if not run.ranks:
                        yield plan, at, Moments.of(s["x"][here], s["z"][here], s["y"][here][:, places]).flat()
                        continue
                    train = (fold >= 0) & ~here
                    x, y, z = (s[c][train][:, :, at] for c in ("xr", "yr", "zr"))
                    part = Moments.of(np.abs(x) / 2.0, np.abs(z) / 2.0, np.abs(y) / 2.0).flat()
                    yield plan, at, np.concatenate([part, (x < 0).sum(0), (y < 0).sum(0)])
                    none = np.zeros((int(here.sum()), 0))
                    yield plan, -1 - at, np.concatenate([Moments.of(none, s["z"][here], none).flat(), np.zeros(len(run.edges) + len(run.iters))])

    tail = len(run.edges) + len(run.iters) if run.ranks else 0

    def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        cut = len(a) - tail
        return np.concatenate([Moments.from_flat(a[:cut]).with_other(Moments.from_flat(b[:cut])).flat(), a[cut:] + b[cut:]])

    found = {}
    for r in summed(people, sums, combine).collect():  # at most MOST numbers and the covariates' share of them
        v = np.array(r["v"])
        m = Moments.from_flat(v[: len(v) - tail])
        m.x_ties, m.y_ties = v[len(v) - tail : len(v) - len(run.iters)] > 0, v[len(v) - len(run.iters) :] > 0
        found[r["plan"], r["part"]] = m
    return found


def selected(m: Moments, p: float, ranks: bool, raw: Moments | None) -> tuple[np.ndarray, np.ndarray]:
    """(positive, negative) edges by iterations of a training part, as kernel.Fold selects them. raw: its covariates, with ranks."""
    n, k = int(m.n), len(m.mz)
    xx, yy, xy, rank = m.xx, m.yy, m.xy, 0
    left_x, left_y = xx, yy
    if k:
        kept = independent(raw.zz / max(raw.n, 1)) if ranks else list(range(k))
        zz, xz, zy, mz = m.zz[np.ix_(kept, kept)], m.xz[:, kept], m.zy[kept], m.mz[kept]
        scale = np.sqrt(np.diag(zz))
        live = scale > 1e-12 * (1 + np.abs(mz * n))
        zz, xz, zy = zz[np.ix_(live, live)] / np.outer(scale[live], scale[live]), xz[:, live] / scale[live], zy[live] / scale[live][:, None]
        value, vector = np.linalg.eigh(zz) if live.any() else (np.zeros(0), np.zeros((0, 0)))
        good = value > 1e-10
        turn = vector[:, good] / np.sqrt(value[good])
        qx, qy, rank = xz @ turn, turn.T @ zy, int(good.sum())
        xy, left_x, left_y = xy - qx @ qy, xx - (qx * qx).sum(1), yy - (qy * qy).sum(0)
    # rounding alone is left
    lives = lambda left, whole, mean: (left > 1e-10 * whole) & (np.sqrt(np.maximum(left, 0)) > 1e-13 * np.sqrt(n) * (1 + np.sqrt(whole / max(n, 1) + mean * mean)))
    a, b = lives(left_x, xx, m.mx), lives(left_y, yy, m.my)
    r = xy / np.outer(np.where(a, np.sqrt(np.maximum(left_x, 0)), np.inf), np.where(b, np.sqrt(np.maximum(left_y, 0)), np.inf))
    cut = critical_r(p, max(n - rank - 2, 0))
    if not ranks or k:
        return r > cut, r < -cut
    distance, whole = xx[:, None] + yy - 2 * xy, (n**3 - n) // 3
    exact = np.round(np.minimum(distance, whole - distance)) <= critical_distance(p, n)
    chosen = np.where(m.x_ties[:, None] | m.y_ties, np.abs(r) > cut, exact)
    return chosen & (r > 0), chosen & (r < 0)


def masks(found: dict[tuple[int, int], Moments], run: Run, p: float) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(positive, negative) edges by the plan's iterations, for each (plan, place of the fold held out) that the plan has."""
    made = {}
    for plan, places in run.plans():
        own = {at: found[plan, at] for at in range(len(run.folds)) if (plan, at) in found}
        held = [at for at in own if found[plan, -1 - at if run.ranks else at].n]
        for at in held:
            others = [t for t in range(len(run.folds)) if t != at]
            if run.ranks:
                train, raw = own[at], reduce(Moments.with_other, [found[plan, -1 - t] for t in others]) if others and run.names else None
            else:
                train, raw = reduce(Moments.with_other, [own[t] for t in others if t in own and own[t].n]) if len(held) > 1 else None, None
            if train is None or train.n <= 1:  # nothing is selected without a training part
                made[plan, at] = (np.zeros((len(run.edges), len(places)), bool),) * 2
            else:
                made[plan, at] = selected(train, p, run.ranks, raw)
    return made


def _strengths(s: dict[str, np.ndarray], run: Run, chosen: dict) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(plan, place of the fold held out, places of iterations, people of the plan, pos, neg) of a step."""
    for plan, places in run.plans():
        own = s["fold"][:, places[0]] >= 0
        for at in range(len(run.folds)):
            if (plan, at) in chosen:
                up, down = chosen[plan, at]
                yield plan, at, places, own, s["x"][own] @ up, s["x"][own] @ down


def _prepared(edges: DataFrame, outcome: DataFrame, p: float, covariates: DataFrame | None, names: list[str], ranks: bool) -> Iterator[tuple[Run, DataFrame, dict]]:
    whole = Run(edges, outcome, names if covariates is not None else [])
    for run in whole.parts(ranks):
        people = rows_of_people(edges, outcome, covariates, run)
        yield run, people, masks(first_pass(people, run), run, p)


def strengths(edges: DataFrame, outcome: DataFrame, p: float, covariates: DataFrame | None, names: list[str], ranks: bool) -> DataFrame:
    """(iter, held, subject_row, fold, y, pos, neg) of every person, as kernel.block_strengths gives them."""
    made = []
    for run, people, chosen in _prepared(edges, outcome, p, covariates, names, ranks):
        sent = edges.sparkSession.sparkContext.broadcast((run, chosen))

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            run, chosen = sent.value
            for s in steps(batches, run):
                for _, at, places, own, pos, neg in _strengths(s, run, chosen):
                    n, i = pos.shape
                    columns = {"iter": np.tile(run.iters[places], n), "held": np.full(n * i, run.folds[at]), "subject_row": np.repeat(s["people"][own], i), "fold": s["fold"][own][:, places].ravel(), "y": s["y"][own][:, places].ravel(), "pos": pos.ravel(), "neg": neg.ravel()}
                    yield pa.RecordBatch.from_pydict(columns)

        t = run.types
        long = people.mapInArrow(rows, f"iter long, held long, subject_row {t['subject_row']}, fold long, y double, pos double, neg double")
        made.append(long.select(F.col("iter").cast(t["iter"]).alias("iter"), F.col("held").cast(t["fold"]).alias("held"), "subject_row", F.col("fold").cast(t["fold"]).alias("fold"), "y", "pos", "neg"))
    return reduce(DataFrame.unionByName, made)


def votes(edges: DataFrame, outcome: DataFrame, p: float, need: int) -> DataFrame:
    """(iter, edge_id, sign, votes): edges that at least `need` folds select."""
    made = []
    for run, _, chosen in _prepared(edges, outcome, p, None, [], False):
        total = np.zeros((2, len(run.edges), len(run.iters)), np.int64)
        places = dict(run.plans())
        for (plan, _), sides in chosen.items():
            for side in (0, 1):
                total[side][:, places[plan]] += sides[side]
        side, edge, i = np.nonzero(total >= max(1, need))
        frame = pd.DataFrame({"iter": run.iters[i], "edge_id": run.edges[edge], "sign": np.where(side == 0, 1, -1), "votes": total[side, edge, i]})
        made.append(edges.sparkSession.createDataFrame(frame, f"iter {run.types['iter']}, edge_id {run.types['edge_id']}, sign int, votes long"))
    return reduce(DataFrame.unionByName, made)


def cross_validate(edges: DataFrame, outcome: DataFrame, p: float, covariates: DataFrame | None, names: list[str], ranks: bool) -> DataFrame:
    """(iter, model, r, mse), as engine.measure gives them for the strengths of all people."""
    made = []
    for run, people, chosen in _prepared(edges, outcome, p, covariates, names, ranks):
        sent = edges.sparkSession.sparkContext.broadcast((run, chosen))

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[tuple[int, int, np.ndarray]]:
            run, chosen = sent.value
            for s in steps(batches, run):
                for plan, at, places, own, pos, neg in _strengths(s, run, chosen):
                    held, y = s["fold"][own][:, places[0]] == run.folds[at], s["y"][own][:, places]
                    for side, rows in ((0, ~held), (1, held)):
                        yield plan, 2 * at + side, Sides.of(pos[rows], neg[rows], y[rows]).ravel()

        def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return Sides.joined(a.reshape(10, -1), b.reshape(10, -1)).ravel()

        def table(frames: Iterator[pd.DataFrame], run=run) -> Iterator[pd.DataFrame]:
            places = dict(run.plans())
            for f in frames:
                for plan, part, v in zip(f["plan"], f["part"], f["v"], strict=True):
                    found = pd.DataFrame(dict(zip(_CELLS, np.asarray(v).reshape(10, -1), strict=True)))
                    yield found.assign(iter=run.iters[places[plan]], held=run.folds[part // 2], test=part % 2 == 1)

        cells = summed(people, sums, combine).mapInPandas(table, f"iter {run.types['iter']}, held {run.types['fold']}, test boolean, " + ", ".join(f"{c} double" for c in _CELLS))
        made.append(cells.filter("n > 0"))
    return measured(reduce(DataFrame.unionByName, made))


_CELLS = ["n", "mp", "mn", "my", "pp", "nn", "yy", "pn", "py", "ny"]


def measured(cells: DataFrame) -> DataFrame:
    """(iter, model, r, mse) of means and centred products by iteration, fold held out and side."""
    c, by = F.col, ["iter", "held"]
    per = lambda name: (c(name) / c("n"))
    train = cells.filter("NOT test").select(*by, "mp", "mn", "my", per("pp").alias("vp"), per("nn").alias("vn"), per("pn").alias("cpn"), per("py").alias("cpy"), per("ny").alias("cny"))
    both = cells.filter("test").join(engine.solved(train, by), by, "left")
    line = lambda a, b, d: F.struct(c(a).alias("a"), b.alias("b"), d.alias("d"))
    none = F.lit(0.0)
    models = {"positive": line("ap", c("bp"), none), "negative": line("an", none, c("bn")), "combined": line("ac", c("cp"), c("cn"))}
    long = both.select("iter", "n", "mp", "mn", "my", "pp", "nn", "yy", "pn", "py", "ny", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), v.alias("v")) for m, v in models.items()))).alias("m"))
    a, b, d = c("m.v.a"), c("m.v.b"), c("m.v.d")
    long = long.select("iter", c("m.model").alias("model"), "n", "my", "yy", (a + b * c("mp") + d * c("mn")).alias("mean"), (b * b * c("pp") + 2 * b * d * c("pn") + d * d * c("nn")).alias("ff"), (b * c("py") + d * c("ny")).alias("fy")).filter("mean IS NOT NULL")
    whole = W.partitionBy("iter", "model")
    apart = {v: c(v) - F.sum(c("n") * c(v)).over(whole) / F.sum("n").over(whole) for v in ("mean", "my")}
    gap = c("my") - c("mean")
    long = long.withColumns({"missed": c("yy") - 2 * c("fy") + c("ff") + c("n") * gap * gap, "du": apart["mean"], "dy": apart["my"]})
    summed = long.groupBy("iter", "model").agg(F.sum("n").alias("n"), F.sum(c("ff") + c("n") * c("du") ** 2).alias("ff"), F.sum(c("yy") + c("n") * c("dy") ** 2).alias("yy"), F.sum(c("fy") + c("n") * c("du") * c("dy")).alias("fy"), F.sum("missed").alias("missed"), F.max(F.abs("mean")).alias("top"))
    live = (c("ff") > 1e-26 * c("n") * c("top") * c("top")) & (c("ff") > 0) & (c("yy") > 0)
    return summed.select("iter", "model", F.try_divide("fy", F.when(live, F.sqrt("ff") * F.sqrt("yy"))).alias("r"), (c("missed") / c("n")).alias("mse"))
