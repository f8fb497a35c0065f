"""Block kernel for many permutations: edge selection in training parts and network strengths as matrix products over blocks of edges.

The relational form (:mod:`.engine`, :mod:`.adjusted`) multiplies edges by people and iterations. Here a task holds one block of edges as a matrix of people by edges,
prepares it once a fold (centred, ranked, or projected on what the covariates of the training part leave), and multiplies it with the matrix of people by
iterations; only sums over the block's selected edges leave it. A task adds up its blocks before they are shuffled: one pair of arrays for each iteration and fold.
Models, predictions and p-values stay relational. Both forms agree to 1e-10.

Scores go to every task in slices of iterations, so that a slice and its sums are at most MOST numbers; a slice reads the edges once. Iterations may differ in
people and folds (samples of a learning curve, repeated partitions); those that share them share the preparation of a fold.
Every person must have every edge; a missing cell is an error.

A block holds all people, so this form is for few people and many edges. With more people than edges (and than MANY) tasks hold people instead, see :mod:`.people`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import critical_distance, critical_r, exact_ends
from . import engine, people

#: Edges of a block, iterations of one matrix product, numbers of a slice of iterations (scores times folds).
BLOCK, CHUNK, MOST = 2_048, 500, 20_000_000
#: People up to which a block may hold them all.
MANY = 200


def by_people(edges: DataFrame, outcome: DataFrame) -> bool:
    """Whether people are the long side."""
    n = outcome.select("subject_row").distinct().count()
    return n > MANY and n > edges.select("edge_id").distinct().count()


def ranked(v: np.ndarray) -> np.ndarray:
    """Ranks from 1 in each column, ties sharing their mean rank."""
    order = np.argsort(v, axis=0, kind="stable")
    s = np.take_along_axis(v, order, 0)
    fresh = np.ones(s.shape, bool)
    fresh[1:] = s[1:] != s[:-1]
    n = len(v)
    # groups of ties, numbered through all columns
    group = np.cumsum(fresh.T.ravel()) - 1
    place = np.tile(np.arange(1.0, n + 1), v.shape[1])
    mean = np.bincount(group, place) / np.bincount(group)
    out = np.empty(v.shape)
    np.put_along_axis(out, order, mean[group].reshape(v.shape[1], n).T, 0)
    return out


def tied(v: np.ndarray) -> np.ndarray:
    """Whether a column holds a value twice."""
    s = np.sort(v, axis=0)
    return (s[1:] == s[:-1]).any(0)


def independent(z: np.ndarray) -> list[int]:
    """Columns that raise the rank of (1, columns before them), in order."""
    kept: list[int] = []
    gram = np.cov(z.T, bias=True).reshape(z.shape[1], z.shape[1])
    for i in range(z.shape[1]):
        left = gram[i, i]
        if kept:
            left -= gram[i, kept] @ np.linalg.solve(gram[np.ix_(kept, kept)], gram[kept, i])
        if left > 1e-10 * max(gram[i, i], np.finfo(float).tiny):
            kept.append(i)
    return kept


def basis(z: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the centred columns of z, brought to one scale first."""
    c = z - z.mean(0)
    scale = np.sqrt((c * c).sum(0))
    live = scale > 1e-12 * (1 + np.abs(z.sum(0)))
    c = c[:, live] / scale[live]
    value, vector = np.linalg.eigh(c.T @ c) if live.any() else (np.zeros(0), np.zeros((0, 0)))
    good = value > 1e-10
    return c @ (vector[:, good] / np.sqrt(value[good]))


class Fold:
    """The edges of a block in one training part, prepared once for all iterations."""

    def __init__(self, x: np.ndarray, train: np.ndarray, p: float, z: np.ndarray | None, ranks: bool):
        self.train, self.ranks, self.n, self.q = train, ranks, int(train.sum()), None
        self.plain_ranks = ranks and z is None
        a = x[train]
        size = np.abs(a).max(0)
        if ranks:
            self.tied, a = tied(a), ranked(a)
            size = np.abs(a).max(0)
        if z is not None:
            own = z[train]
            self.q = basis(ranked(own[:, independent(own)]) if ranks else own)
        rank = 0 if self.q is None else self.q.shape[1]
        self.cut = critical_r(p, max(self.n - rank - 2, 0))
        if self.plain_ranks:
            self.raw, self.whole, self.least, self.p = a, (self.n**3 - self.n) // 3, critical_distance(p, self.n), p
        self.unit = self._unit(a, size)

    def _unit(self, v: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Columns centred, without the covariates' part, of length one; zeros where rounding alone is left."""
        c = v - v.mean(0)
        whole = (c * c).sum(0)
        if self.q is not None and self.q.shape[1]:
            c = c - self.q @ (self.q.T @ c)
        left = (c * c).sum(0)
        live = (left > 1e-10 * whole) & (np.sqrt(left) > 1e-13 * np.sqrt(self.n) * (1 + size))
        return c / np.where(live, np.sqrt(left), np.inf)

    def selected(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges by iterations that correlate positively beyond the critical value, negatively)."""
        b = y[self.train]
        ties = tied(b) if self.plain_ranks else None
        b = ranked(b) if self.ranks else b
        r = self.unit.T @ self._unit(b, np.abs(b).max(0))
        if not self.plain_ranks:
            return r > self.cut, r < -self.cut
        distance = (self.raw**2).sum(0)[:, None] + (b**2).sum(0) - 2 * self.raw.T @ b
        if self.n < 10:
            chosen = self._small(distance, b)
            return chosen & (r > 0), chosen & (r < 0)
        exact = np.round(np.minimum(distance, self.whole - distance)) <= self.least
        chosen = np.where(self.tied[:, None] | ties, np.abs(r) > self.cut, exact)
        return chosen & (r > 0), chosen & (r < 0)

    def _small(self, distance: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Edges by iterations beyond the ends of their exact distribution, found once for each pair of patterns of ties."""
        patterns = lambda v: np.unique(np.sort(np.round(2 * v).astype(int), axis=0), axis=1, return_inverse=True)
        (first, edge), (second, iteration) = patterns(self.raw), patterns(b)
        ends = np.array([[exact_ends(tuple(x.tolist()), tuple(y.tolist()), self.p) for y in second.T] for x in first.T])
        near, far = (ends[edge.ravel()[:, None], iteration.ravel(), k] for k in (0, 1))
        return (distance <= near + 0.1) | (distance >= far - 0.1)


class Scores:
    """A slice of iterations: people, iterations, scores (people by iterations, NaN where somebody takes no part) and the plans of folds."""

    def __init__(self, outcome: DataFrame, covariates: DataFrame | None, names: list[str]):
        rows = outcome.select("iter", "subject_row", "fold", "y").toPandas()  # at most MOST rows
        self.people, self.iters = np.sort(rows["subject_row"].unique()), np.sort(rows["iter"].unique())
        at = (np.searchsorted(self.people, rows["subject_row"]), np.searchsorted(self.iters, rows["iter"]))
        self.y = np.full((len(self.people), len(self.iters)), np.nan)
        fold = np.full(self.y.shape, -1, np.int64)
        self.y[at], fold[at] = rows["y"], rows["fold"]
        # iterations that share people and folds, as (folds, their places); most runs have one such plan
        shared, which = np.unique(fold, axis=1, return_inverse=True) if fold.size else (fold, np.zeros(0, np.int64))
        self.plans = [(shared[:, k], np.flatnonzero(which.ravel() == k)) for k in range(shared.shape[1])]
        self.z = None
        if covariates is not None:
            table = covariates.select("subject_row", *names).toPandas().set_index("subject_row")  # one row a person
            self.z = table.loc[self.people, names].to_numpy(float)

    def masks(self, x: np.ndarray, p: float, ranks: bool, chunk: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(held fold, places of iterations, positive, negative edges by iterations) of a block."""
        for folds, places in self.plans:
            for held in np.unique(folds[folds >= 0]):
                train = (folds >= 0) & (folds != held)
                fold = Fold(x, train, p, self.z, ranks) if train.sum() > 1 else None  # nothing is selected without a training part
                for at in range(0, len(places), chunk):
                    part = places[at : at + chunk]
                    yield held, part, *(fold.selected(self.y[:, part]) if fold else [np.zeros((x.shape[1], len(part)), bool)] * 2)


def matrix(frame: pd.DataFrame, people: np.ndarray) -> np.ndarray:
    x = frame.pivot(index="subject_row", columns="edge_id", values="value").reindex(people)
    if np.isnan(x.to_numpy()).any():
        raise ValueError("a person lacks an edge")
    return x


def slices(outcome: DataFrame, most: int) -> list[DataFrame]:
    """outcome by ranges of iterations with at most `most` numbers each (scores times folds), one iteration at least."""
    about = outcome.groupBy("iter").agg(F.count("*").alias("n")).agg(F.min("iter").alias("low"), F.max("iter").alias("high"), F.max("n").alias("n"), F.count("*").alias("iters")).first()
    if not about["iters"]:
        return [outcome]
    folds = outcome.select("fold").distinct().count()
    each = max(1, most // max(1, about["n"] * folds))
    if about["iters"] <= each:
        return [outcome]
    starts = range(about["low"], about["high"] + 1, each)
    return [outcome.filter(F.col("iter").between(s, s + each - 1)) for s in starts]


def added_up(keys: list[str], columns: list[str]):
    """Mapper over frames: arrays of equal keys, added up over all that a task holds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list[np.ndarray]] = {}
        for f in frames:
            for *key, arrays in zip(*(f[k] for k in keys), zip(*(f[c] for c in columns), strict=True), strict=True):
                have = sums.get(tuple(key))
                if have is None:
                    sums[tuple(key)] = [np.array(a) for a in arrays]
                else:
                    for total, a in zip(have, arrays, strict=True):
                        total += a
        if sums:
            yield pd.DataFrame({k: [key[j] for key in sums] for j, k in enumerate(keys)} | {c: [v[j] for v in sums.values()] for j, c in enumerate(columns)})

    return run


def array_sum(column: str, size: Column | int) -> Column:
    """Sum of a group's arrays by position, as an aggregate; as many arrays a group as tasks."""
    nothing = F.array_repeat(F.lit(0.0), size)
    return F.aggregate(F.collect_list(column), nothing, lambda total, v: F.zip_with(total, v, lambda s, t: s + t)).alias(column)


def _blocks(edges: DataFrame, block: int):
    return edges.select("subject_row", "edge_id", "value", F.expr(f"edge_id div {block}").alias("block")).groupBy("block")


def _one_slice(edges: DataFrame, outcome: DataFrame, p: float, covariates: DataFrame | None, names: list[str], ranks: bool, block: int, chunk: int) -> DataFrame:
    scores = Scores(outcome, covariates, names)
    sent = edges.sparkSession.sparkContext.broadcast(scores)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = sent.value
        x = matrix(frame, own.people).to_numpy()
        made = [pd.DataFrame({"iter": own.iters[part], "held": held, "pos": list((x @ up).T), "neg": list((x @ down).T)}) for held, part, up, down in own.masks(x, p, ranks, chunk)]
        return pd.concat(made, ignore_index=True)

    types = dict(outcome.dtypes)
    schema = f"iter {types['iter']}, held {types['fold']}, pos array<double>, neg array<double>"
    sums = _blocks(edges, block).applyInPandas(run, schema).mapInPandas(added_up(["iter", "held"], ["pos", "neg"]), schema)
    whole = sums.groupBy("iter", "held").agg(array_sum("pos", len(scores.people)), array_sum("neg", len(scores.people)))
    cells = whole.select("iter", "held", F.posexplode(F.arrays_zip("pos", "neg")).alias("place", "v"))
    order = edges.sparkSession.createDataFrame(pd.DataFrame({"place": np.arange(len(scores.people)), "subject_row": scores.people}), f"place int, subject_row {types['subject_row']}")
    named = cells.join(F.broadcast(order), "place").select("iter", "held", "subject_row", "v.pos", "v.neg")  # one row a person
    return named.join(outcome, ["iter", "subject_row"]).select("iter", "held", "subject_row", "fold", "y", "pos", "neg")


def block_strengths(edges: DataFrame, outcome: DataFrame, p: float, block: int = BLOCK, chunk: int = CHUNK, covariates: DataFrame | None = None, names: list[str] | None = None, ranks: bool = False) -> DataFrame:
    """(iter, held, subject_row, fold, y, pos, neg), as engine.strengths gives them for the masks of engine.select_edges.

    edges: (subject_row, edge_id, value); outcome: (iter, subject_row, fold, y). With covariates (subject_row, names...) masks are those of adjusted.select_adjusted,
    with ranks those of adjusted.rank_masks, with both those of adjusted.rank_partial_correlations.
    """
    if by_people(edges, outcome):
        return people.strengths(edges, outcome, p, covariates, names or [], ranks)
    parts = [_one_slice(edges, part, p, covariates, names or [], ranks, block, chunk) for part in slices(outcome, MOST)]
    return reduce(DataFrame.unionByName, parts)


def block_votes(edges: DataFrame, outcome: DataFrame, p: float, need: int, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(iter, edge_id, sign, votes): edges that at least `need` folds select; all folds of an edge meet in its block, so nothing else is shuffled."""
    if by_people(edges, outcome):
        return people.votes(edges, outcome, p, need)
    types, edge_type = dict(outcome.dtypes), dict(edges.dtypes)["edge_id"]

    def one(part: DataFrame) -> DataFrame:
        sent = edges.sparkSession.sparkContext.broadcast(Scores(part, None, []))

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            own = sent.value
            x = matrix(frame, own.people)
            votes = np.zeros((2, x.shape[1], len(own.iters)), np.int64)
            for _, span, up, down in own.masks(x.to_numpy(), p, False, chunk):
                votes[0][:, span] += up
                votes[1][:, span] += down
            side, edge, i = np.nonzero(votes >= max(1, need))
            return pd.DataFrame({"iter": own.iters[i], "edge_id": x.columns.to_numpy()[edge], "sign": np.where(side == 0, 1, -1), "votes": votes[side, edge, i]})

        return _blocks(edges, block).applyInPandas(run, f"iter {types['iter']}, edge_id {edge_type}, sign int, votes long")

    return reduce(DataFrame.unionByName, [one(part) for part in slices(outcome, MOST)])


def cross_validate(edges: DataFrame, outcome: DataFrame, p: float, block: int = BLOCK, **more) -> DataFrame:
    """(iter, model, r, mse), as engine.cross_validate measures it."""
    if by_people(edges, outcome):
        return people.cross_validate(edges, outcome, p, more.get("covariates"), more.get("names") or [], more.get("ranks", False))
    return engine.measure(block_strengths(edges, outcome, p, block, **more))
