"""N-gram Jaccard join by prefix trees.

1. A map over whole texts gives each document's set of k-word shingles (64-bit hashes) and its candidate tokens. Documents
   with equal sets become one class, which its smallest doc_id represents.
2. Global order of tokens: first those with a hash below pool_share of the hash range, by document frequency and hash, then all
   others by hash. Two sets as similar as the threshold share a token among the first n - ceil(threshold * n) + 1 of each
   (prefix filter), so representatives are joined into blocks by the rare tokens of their prefixes. A set whose prefix holds
   tokens of its own only, as most texts without copies do, is in no block.
3. The sets of a cell go into a compressed prefix tree, in an order of tokens common to the cell (frequent ones first, so that
   similar sets share long paths). Queries walk it from the root with the overlap that a path shares, and leave subtrees whose remaining
   lengths can't reach the threshold. First a block's centre asks, then growing batches of sets that are not known to reach it; a link is found from
   either end, so sets that reach the centre need not ask.
4. Small blocks share cells. A block of more than CELL tokens is dealt into parts of about that size, each a cell. Centres of parts
   are joined in the same way, again and again, until one is left. Only sets that by then stand outside the largest component of their block are
   sent on, to the parts that hold one of their prefix tokens, in chunks of about CELL tokens. So no task holds more than about two times CELL tokens
   (or one longer set), and a very large group of near copies costs in proportion to its size as far as centres reach it.
5. Components of all links, by distributed star steps.

Sets without shingles link with nothing. Rows of one doc_id are answered by their own texts: alike ones alike, different ones as documents
of their own. A null doc_id has a null component and links nobody. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import marked, small_batches, text_of, written
from .components import components
from .textops import chunks, lists, mix, shingle_sets

#: Tokens in one task's prefix tree; rows of tokens that queries of one batch are looked up in; pairs of a query and a token at a time.
CELL, MARKS, TOUCHED = 200_000, 1 << 25, 1 << 22
#: Tokens of the first piece of a long path; each further piece has twice as many.
PIECE = 32


def pool_share(num: int, den: int) -> float:
    """Share of the hash range whose tokens have their document frequency counted: twice that of a prefix, so that most prefixes lie inside it."""
    return min(0.45, 2 * (den - num) / den)


def prefix_length(n, num: int, den: int):
    return n - (num * n + den - 1) // den + 1


def _sums(starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
    """Two sums of hashes that identify each set."""
    total = np.zeros((2, len(value) + 1), np.uint64)
    np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)), out=total[0, 1:])
    np.cumsum(mix(value + np.uint64(0x14057B7EF767814F)), out=total[1, 1:])
    return [(t[ends] - t[starts]).view(np.int64) for t in total]


def _texts(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, where each set starts and ends, hashes) of the texts of a batch."""
    for at, to, data, offsets in chunks(batch, "text"):
        starts, value = shingle_sets(data, offsets, k)
        bounds = starts if len(starts) == to - at + 1 else np.r_[starts, len(value)]
        yield at, to, bounds[:-1], bounds[1:], value


def _sketch(k: int, num: int, den: int):
    """Mapper: set size, two sums that identify the set, prefix length, size of the pool part, candidate tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.uint64(int(pool_share(num, den) * 2**64))
        for batch in batches:
            for at, to, starts, ends, value in _texts(batch, k):
                n = ends - starts
                below = np.r_[0, np.cumsum(value < limit)]
                pool = below[ends] - below[starts]
                p = np.where(n > 0, prefix_length(n, num, den), 0)
                take = np.maximum(pool, p)  # hashes are sorted in each row: the pool comes first
                keep = np.arange(len(value)) - np.repeat(starts, n) < np.repeat(take, n)
                numbers = (n, *_sums(starts, ends, value), p, pool)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), *(pa.array(x.astype(np.int64)) for x in numbers), lists(np.r_[0, np.cumsum(take)], value[keep])], names=["doc_id", "n", "s1", "s2", "p", "pool", "tokens"])

    return run


def _sets(k: int):
    """Mapper: the whole shingle sets of texts that are the set (s1, s2) of their row; all columns but these and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c not in ("text", "s1", "s2")]
            for at, to, starts, ends, value in _texts(batch, k):
                part = batch.slice(at, to - at)
                same = np.logical_and(*(part.column(c).to_numpy() == x for c, x in zip(("s1", "s2"), _sums(starts, ends, value), strict=True)))
                made = pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists(np.r_[starts, ends[-1:]], value)], names=[*names, "tokens"])
                yield made.filter(pa.array(same))

    return run


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = int(self.up[x])
        return x

    def roots(self) -> np.ndarray:
        found = self.up
        while (found != (found := self.up[found])).any():
            pass
        return found

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The integers start[k], ..., start[k] + size[k] - 1 of all k, in this order."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class PrefixTree:
    """A compressed prefix tree for each block. A node's edge spells tokens [first, last) of the set `of`; long edges are cut into pieces.

    sets: positions of the members; starts, n, token: where each set's ascending tokens lie.
    """

    def __init__(self, sets: np.ndarray, block: np.ndarray, starts: np.ndarray, n: np.ndarray, token: np.ndarray):
        raw = token.astype(">u4").tobytes()
        sets = np.array(sorted(sets.tolist(), key=lambda x: (block[x], raw[4 * starts[x] : 4 * starts[x + 1]])), np.int64)
        a, b = sets[:-1], sets[1:]
        least = np.minimum(n[a], n[b])
        differs = token[_spread(starts[a], least)] != token[_spread(starts[b], least)]
        shared = least.copy()
        at = np.repeat(np.arange(len(a)), least)[differs]
        np.minimum.at(shared, at, (np.flatnonzero(differs) - np.repeat(np.cumsum(least) - least, least)[differs]))
        self.roots: dict[int, int] = {}
        parent, first, last, of, self_end = [], [], [], [], []

        def node(up: int, begin: int, end: int, owner: int) -> int:
            parent.append(up), first.append(begin), last.append(end), of.append(owner)
            return len(parent) - 1

        path: list[int] = []
        for k, x in enumerate(sets.tolist()):
            if k == 0 or block[x] != block[sets[k - 1]]:
                path = [node(-1, 0, 0, x)]
                self.roots[int(block[x])] = path[0]
                depth = 0
            else:
                depth = int(shared[k - 1])
                below = -1
                while last[path[-1]] > depth:
                    below = path.pop()
                if last[path[-1]] < depth:  # the paths part inside an edge
                    cut = node(parent[below], first[below], depth, of[below])
                    parent[below], first[below] = cut, depth
                    path.append(cut)
            size, piece = int(n[x]), PIECE
            while depth < size:
                end = min(size, depth + piece)
                path.append(node(path[-1], depth, end, x))
                depth, piece = end, 2 * piece
            self_end.append(path[-1])
        self.first, self.last, self.of, up = (np.array(v, np.int64) for v in (first, last, of, parent))
        m = len(up)
        order = np.argsort(up, kind="stable")  # children of a node lie together, roots come first
        self.child, self.fan = order, np.searchsorted(up[order], np.arange(m + 1))
        ended = np.array(self_end, np.int64)
        by = np.argsort(ended, kind="stable")
        self.ended, self.ends = sets[by], np.searchsorted(ended[by], np.arange(m + 1))
        self.longest, self.shortest = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max)
        np.maximum.at(self.longest, ended, n[sets]), np.minimum.at(self.shortest, ended, n[sets])
        for v in np.argsort(-self.last, kind="stable").tolist():  # children end below their parents
            if up[v] >= 0:
                self.longest[up[v]] = max(self.longest[up[v]], self.longest[v])
                self.shortest[up[v]] = min(self.shortest[up[v]], self.shortest[v])
        self.tokens = int((self.last - self.first).sum())

    def walk(self, queries: np.ndarray, block: np.ndarray, starts: np.ndarray, n: np.ndarray, token: np.ndarray, vocabulary: int, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, member) whose similarity reaches num / den, a set with itself included."""
        queries = queries[np.isin(block[queries], np.fromiter(self.roots, np.int64, len(self.roots)))]
        spread = max(1, min(MARKS // max(1, vocabulary), TOUCHED // max(1, self.tokens)))
        for at in range(0, len(queries), spread):
            q = queries[at : at + spread]
            size, begins = n[q], np.r_[0, np.cumsum(n[q])]
            keys = np.repeat(np.arange(len(q)), size) * vocabulary + token[_spread(starts[q], size)]  # ascending
            marked = np.zeros(len(q) * vocabulary, bool)
            marked[keys] = True
            who, here, overlap = np.arange(len(q)), np.array([self.roots[int(b)] for b in block[q]], np.int64), np.zeros(len(q), np.int64)
            while len(who):
                fan = self.fan[here + 1] - self.fan[here]
                down = self.child[_spread(self.fan[here], fan)]
                who, overlap = np.repeat(who, fan), np.repeat(overlap, fan)
                # length bounds first: they ask for no token
                own = size[who]
                fits = (den * own >= num * self.shortest[down]) & (den * self.longest[down] >= num * own)
                who, overlap, down = who[fits], overlap[fits], down[fits]
                if not len(who):
                    break
                length = self.last[down] - self.first[down]
                lie = starts[self.of[down]] + self.first[down]
                spelled = np.repeat(who * vocabulary, length) + token[_spread(lie, length)]
                overlap = overlap + np.add.reduceat(marked[spelled].astype(np.int64), np.cumsum(length) - length)
                own, depth = size[who], self.last[down]
                missed = depth - overlap  # of the path
                skipped = np.searchsorted(keys, who * vocabulary + token[lie + length - 1], "right") - begins[who] - overlap  # of the query
                going = (den * (own - skipped) >= num * (own + missed)) & (den * (self.longest[down] - missed) >= num * (self.longest[down] + skipped))
                who, here, overlap = who[going], down[going], overlap[going]
                count = self.ends[here + 1] - self.ends[here]
                asks, both = np.repeat(who, count), np.repeat(overlap, count)
                other = self.ended[_spread(self.ends[here], count)]
                good = den * both >= num * (size[asks] + n[other] - both)
                if good.any():
                    yield q[asks[good]], other[good]


def _turn(block: np.ndarray, most: int) -> np.ndarray:
    """Whether a place is among the first `most` of its block; blocks ascend."""
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    return np.arange(len(block)) - np.repeat(first, np.diff(np.r_[first, len(block)])) < most


def trie_links(block: np.ndarray, starts: np.ndarray, value: np.ndarray, num: int, den: int, asks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(position of the smallest set that each set reaches over links within its block, positions of the blocks' centres).

    block: ids of the sets' blocks, 0.. and ascending; starts: len(block) + 1 offsets into value, the distinct tokens of each set.
    asks: sets that stand in no tree; then they alone ask, and links among members are not searched for.
    """
    m, n = len(block), np.diff(starts)
    forest = _Forest(m)
    owner = np.repeat(np.arange(m), n)
    # order of tokens: frequent ones of the block first; places in this order name the tokens
    order = np.lexsort((value, block[owner]))
    b, v = block[owner][order], value[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1])
    group = np.cumsum(fresh) - 1
    frequency = np.bincount(group)
    rank = np.empty(len(frequency), np.int64)
    rank[np.lexsort((-frequency, b[fresh]))] = np.arange(len(frequency))
    token, often = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    token[order], often[order] = rank[group], frequency[group]
    token = token[np.lexsort((token, owner))]
    # a block's centre shares most tokens with its other sets, for its length
    score = np.add.reduceat(often, starts[:-1]) / n - n * 1e-9
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    centre = np.lexsort((-score, block))[first]
    members = np.arange(m) if asks is None else np.flatnonzero(~asks)
    tree = PrefixTree(members, block, starts, n, token)

    def ask(chosen: np.ndarray) -> None:
        for x, y in tree.walk(chosen, block, starts, n, token, len(frequency), num, den):
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                if forest.up[i] != forest.up[j]:
                    forest.link(i, j)

    if asks is not None:
        ask(np.flatnonzero(asks))
        return forest.roots(), centre
    middle, asked, turn = centre[np.searchsorted(first, np.arange(m), "right") - 1], np.zeros(m, bool), 1
    ask(centre)
    asked[centre] = True
    while True:
        root = forest.roots()
        near = root == root[middle]
        apart = np.flatnonzero(~near & ~asked)
        if not len(apart):
            return root, centre
        # some sets that stand apart, and as many that reach the centre: these may link what the centre does not
        open_ = np.isin(block, block[apart])
        others = np.flatnonzero(near & ~asked & open_)
        chosen = np.r_[apart[_turn(block[apart], turn)], others[_turn(block[others], turn)]]
        ask(np.sort(chosen))
        asked[chosen] = True
        turn *= 2


def _cell(num: int, den: int):
    """Grouped mapper: of a cell's sets, the smallest doc_id that each reaches, and whether it is its block's centre; sets that only ask have `asks`."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["block", "doc_id", "asks"], kind="stable").drop_duplicates(["block", "doc_id"])  # rows alike
        sizes = frame["tokens"].map(len).to_numpy()
        value = np.concatenate([np.asarray(x, np.int64) for x in frame["tokens"]]).view(np.uint64)
        _, block = np.unique(frame["block"].to_numpy(), return_inverse=True)
        ids, asks = frame["doc_id"].to_numpy(), frame["asks"].to_numpy(bool)
        root, centre = trie_links(block, np.r_[0, np.cumsum(sizes)], value, num, den, asks if asks.any() else None)
        return pd.DataFrame({"block": frame["block"].to_numpy(), "doc_id": ids, "root": ids[root], "centre": np.isin(np.arange(len(ids)), centre)})

    return run


_FOUND = "block long, doc_id long, root long, centre boolean"


def _joined(sets: DataFrame, cell: list[str], num: int, den: int) -> DataFrame:
    """Cells of (block, doc_id, tokens, asks, cell...) through the tree."""
    return sets.groupBy(*cell).applyInPandas(_cell(num, den), _FOUND)


def _large_blocks(sets: DataFrame, prefix: DataFrame, num: int, den: int) -> DataFrame:
    """(id, component) of the sets (block, parts, part, doc_id, n, tokens) of blocks dealt into parts; prefix: (doc_id, token)."""
    part = written(_joined(sets.withColumn("asks", F.lit(False)), ["block", "part"], num, den), "within")
    links = part.select(F.col("doc_id").alias("u"), F.col("root").alias("v"))
    centres = part.filter("centre").select("block", "doc_id")
    while True:  # each round leaves a CELL-th of the tokens
        weight = sets.join(centres.select("doc_id"), "doc_id", "left_semi").groupBy("block").agg(F.sum("n").alias("weight"), F.count("*").alias("sets")).filter("sets > 1")
        now = sets.drop("part", "parts").join(centres.select("doc_id"), "doc_id", "left_semi").join(weight, "block")
        # at least halves what is left, also where each set is as long as a cell
        pools = F.least(F.ceil(F.col("weight") / CELL), F.ceil(F.col("sets") / 2))
        now = now.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("centre")), pools)).withColumn("asks", F.lit(False))
        met = written(_joined(now, ["block", "part"], num, den), "centres")
        if met.isEmpty():
            break
        links = links.union(met.select(F.col("doc_id").alias("u"), F.col("root").alias("v")))
        centres = met.filter("centre").select("block", "doc_id")
    first = written(components(links), "first")
    placed = sets.select("block", "parts", "part", "doc_id", "n").join(first.withColumnRenamed("id", "doc_id"), "doc_id")
    main = placed.groupBy("block", "component").agg(F.count("*").alias("sets")).groupBy("block").agg(F.max_by("component", F.struct("sets", "component")).alias("main"))
    apart = written(placed.join(main, "block").filter("component <> main").select("block", "part", "doc_id", "n"), "apart")
    holds = prefix.join(placed.select("block", "part", "doc_id"), "doc_id").select("block", "token", F.col("part").alias("into")).distinct()
    routes = prefix.join(apart, "doc_id").join(holds, ["block", "token"]).filter("into <> part").select("block", "doc_id", "n", F.col("into").alias("part")).distinct()
    routes = written(routes, "routes")
    chunks_ = written(routes.groupBy("block", "part").agg(F.ceil(F.sum("n") / CELL).cast("long").alias("chunks")), "chunks")
    chunk = F.pmod(F.xxhash64("doc_id", F.lit("chunk")), F.col("chunks"))
    asking = routes.join(chunks_, ["block", "part"]).select("block", "part", chunk.alias("chunk"), "doc_id").join(sets.select("doc_id", "tokens"), "doc_id").withColumn("asks", F.lit(True))
    asked = sets.join(chunks_, ["block", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("asks", F.lit(False))
    columns = ["block", "part", "chunk", "doc_id", "tokens", "asks"]
    late = _joined(asked.select(columns).unionByName(asking.select(columns)), ["block", "part", "chunk"], num, den)
    late = written(late.filter("doc_id <> root").select(F.col("doc_id").alias("u"), F.col("root").alias("v")), "late")
    if late.isEmpty():
        return first
    return components(first.select(F.col("id").alias("u"), F.col("component").alias("v")).union(late))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id; links are den * intersection >= num * union of the k-word shingle sets.

    Null and blank texts have no shingles and link with nothing; equal sets always link. Other columns are ignored.
    """
    base = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    sketch = base.mapInArrow(_sketch(k, num, den), "doc_id long, n long, s1 long, s2 long, p long, pool long, tokens array<long>")
    sketch = written(sketch.withColumn("row", F.monotonically_increasing_id()), "sketch")
    # a class of equal sets is named by a row of its smallest doc_id
    first = F.min(F.struct("doc_id", "row")).alias("first")
    classes = written(sketch.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(first).select("n", "s1", "s2", "first.*"), "classes")
    reps = sketch.join(classes.select("row"), "row", "left_semi")
    postings = reps.select("row", F.explode("tokens").alias("token"))
    inside = f"(token >= 0 AND token < {int(pool_share(num, den) * 2**64)})"  # the share of the unsigned range is under a half
    counted = postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = postings.join(counted, "token").select("row", "token", F.when(F.expr(inside), F.col("df")).otherwise(F.lit(None)).alias("df"))
    shared = shared.join(reps.select("row", "p", "pool"), "row")
    # of a set's pool tokens, those that no other set has come first; they take `own` places of the prefix
    seen = W.partitionBy("row")
    ranked = shared.withColumn("own", F.col("pool") - F.count("df").over(seen)).withColumn("place", F.row_number().over(seen.orderBy(F.col("df").asc_nulls_last(), "token")))
    prefix = written(ranked.filter("place + own <= p").select("row", "token"), "prefix")
    least = prefix.groupBy("token").agg(F.min("row").alias("v"), F.max("row").alias("w")).filter("v < w")
    blocks = written(components(prefix.join(least, "token").select(F.col("row").alias("u"), "v").distinct()), "blocks")
    members = blocks.withColumnRenamed("id", "row").join(classes, "row")
    weight = members.groupBy("component").agg(F.sum("n").alias("weight"))
    parts = F.ceil(F.col("weight") / CELL).cast("long")
    plan = written(members.join(weight, "component").select("row", F.col("component").alias("block"), parts.alias("parts"), "weight", "doc_id", "n", "s1", "s2"), "plan")
    most, tokens = plan.agg(F.max("parts"), F.sum("n")).first()
    if most:
        # texts of blocks alone cross the shuffle, once
        texts = marked(base, "doc_id", plan.select("doc_id")).join(plan.drop("weight"), "doc_id").select("row", "block", "parts", "n", "s1", "s2", "text")
        sets = written(texts.mapInArrow(_sets(k), "row long, block long, parts long, n long, tokens array<long>").withColumnRenamed("row", "doc_id"), "sets")
        pool = F.pmod(F.xxhash64("block"), F.lit(-(-tokens // CELL)))
        found = _joined(sets.filter("parts = 1").withColumns({"pool": pool, "asks": F.lit(False)}), ["pool"], num, den).select(F.col("doc_id").alias("row"), F.col("root").alias("component"))
        if most > 1:
            large = sets.filter("parts > 1").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
            large = written(large.dropDuplicates(["doc_id"]), "large")
            found = found.unionByName(_large_blocks(large, prefix.withColumnRenamed("row", "doc_id"), num, den).withColumnRenamed("id", "row"))
        found = written(found, "found")
        smallest = found.join(classes.select("row", "doc_id"), "row").groupBy("component").agg(F.min("doc_id").alias("component_id"))
        classes = classes.join(found.join(smallest, "component").select("row", "component_id"), "row", "left")
    else:
        classes = classes.withColumn("component_id", F.lit(None).cast("long"))
    classes = classes.select("n", "s1", "s2", F.coalesce("component_id", "doc_id").alias("component_id"))
    # sums of hashes name a set: few rows share one but for copies, whose skew a join with one row a class can split
    joined = sketch.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
