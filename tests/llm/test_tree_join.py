"""The prefix tree and the join around it against all pairs; every link is found by walking a tree."""

from __future__ import annotations

import numpy as np
import pytest

from edgeloom.llm import jaccard_join as join

from . import brute


def _all_pairs(sets, block, num, den, ok=lambda i, j: True):
    reach = list(range(len(sets)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if block[i] == block[j] and ok(i, j) and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(reach[i], reach[j])
            changed |= reach[i] != low or reach[j] != low
            reach[i] = reach[j] = low
    return reach


def _family(draw, blocks, most):
    sets, block = [], []
    for b in range(blocks):
        base = draw.integers(0, 400, 40)
        for _ in range(draw.integers(1, most)):
            x = base.copy()
            n = draw.integers(0, 7)
            x[draw.integers(0, 40, n)] = draw.integers(0, 400, n)
            sets.append(set(x[: draw.integers(20, 41)].tolist() if draw.random() < 0.3 else x.tolist()))
            block.append(b)
    return sets, np.array(block), np.r_[0, np.cumsum([len(s) for s in sets])], np.array([v for s in sets for v in sorted(s)], np.uint64)


@pytest.mark.parametrize("piece", [1, 4, 32])
def test_tree_finds_all_links_and_no_others(monkeypatch, piece):
    monkeypatch.setattr(join, "PIECE", piece)
    walked, walk = [], join.PrefixTree.walk

    def counted(self, queries, *more):
        walked.append(len(queries))
        yield from walk(self, queries, *more)

    monkeypatch.setattr(join.PrefixTree, "walk", counted)
    draw = np.random.default_rng(piece)
    for _ in range(25):
        sets, block, starts, value = _family(draw, int(draw.integers(1, 4)), 40)
        walked.clear()
        root, centre = join.trie_links(block, starts, value, 85, 100)
        assert root.tolist() == _all_pairs(sets, block, 85, 100)
        assert sorted(block[centre]) == sorted(set(block.tolist()))
        # each set that does not reach its block's centre has asked the tree itself
        assert sum(walked) >= (root != root[centre[block]]).sum() + len(centre)
        asks = draw.random(len(sets)) < 0.3
        root, _ = join.trie_links(block, starts, value, 85, 100, asks)
        assert root.tolist() == _all_pairs(sets, block, 85, 100, lambda i, j, asks=asks: asks[i] != asks[j])


def test_similar_sets_share_paths():
    base = np.arange(500, dtype=np.uint64)
    sets = [np.unique(np.r_[base[base % 97 != k], np.uint64(1000 + k)]) for k in range(40)]
    starts, value = np.r_[0, np.cumsum([len(s) for s in sets])], np.concatenate(sets)
    n = np.diff(starts)
    _, token = np.unique(value, return_inverse=True)
    tree = join.PrefixTree(np.arange(40), np.zeros(40, int), starts, n, np.concatenate([np.sort(token[a:b]) for a, b in zip(starts, starts[1:], strict=False)]))
    assert tree.tokens < len(value)
    ends = {int(x): k for k in range(len(tree.ends) - 1) for x in tree.ended[tree.ends[k] : tree.ends[k + 1]]}
    assert sorted(ends) == list(range(40))


def _rows(draw, groups, copies):
    rows = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(60)]
        for _ in range(copies):
            x = list(base)
            for _ in range(draw.integers(0, 3)):
                x[draw.integers(0, 60)] = f"new{draw.integers(0, 10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(x)))
    return rows


def test_blocks_dealt_into_parts(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = [*_rows(draw, 3, 60), *((1000 + k, " ".join(f"u{k}x{j}" for j in range(20))) for k in range(30))]
    # a chain: neighbours are alike, the ends are not, so no centre reaches all
    chain = [f"c{k}" for k in range(400)]
    rows += [(2000 + k, " ".join(chain[4 * k : 4 * k + 100])) for k in range(60)]
    wanted = brute.components(rows, 4, 85, 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for cell in (150, 1_000, 10**9):
        monkeypatch.setattr(join, "CELL", cell)
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in join.jaccard_components(docs, 4, 85, 100).collect()}
        assert found == wanted, cell
    assert len({c for d, (_, c) in wanted.items() if d >= 2000}) == 1


def test_repeated_rows_and_one_doc_id_with_two_texts(spark, monkeypatch):
    monkeypatch.setattr(join, "CELL", 100)
    a, b = (" ".join(f"{x}{k}" for k in range(50)) for x in "ab")
    rows = [(9, a), (9, a), (7, a + " end"), (7, b), (8, b + " end"), (None, a), (None, a), (3, None), (3, ""), (5, "one two"), (5, "one two"), (6, "One  TWO")]
    made = join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in made)
    none = [(-1, 47, None)] * 2
    assert found == [*none, (3, 0, 3), (3, 0, 3), (5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 47, 7), (7, 48, 7), (8, 48, 7), (9, 47, 7), (9, 47, 7)]
