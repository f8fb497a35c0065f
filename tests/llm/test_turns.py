"""Conversation repair against a plain walk over states, on the driver's table, odd rows and long conversations; the algebra of its matrices."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product as every

import pytest
from pyspark.sql import functions as F

from edgeloom.llm import turns
from edgeloom.llm.common import table

SMALL = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, key string, at long, node string"
WORD = r"[^\x20\x09-\x0D]"


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        yield from [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()


def repaired(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash of one conversation, by keeping the best (cost, audit, text) of each state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, digest(r[2], r[3])))
    named = [r[1] for r in rows if r[1] is not None]
    gaps = max(named) - min(named) + 1 - len(set(named)) if named else 0
    counts, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, set()
    best = {0: (0, "", ())}

    def insert(best):
        for _ in range(4):
            for i, (cost, audit, text) in list(best.items()):
                j, role = (3, "assistant") if i == 2 else (2, "user")
                best[j] = min(best.get(j, (10**9,)), (cost + 5, audit + "I", (*text, f"{role}:")))
        return best

    for _, _, role, text in rows:
        words = re.findall(WORD, text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else None if words[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        ahead: dict = {}
        for i, (cost, audit, made) in insert(best).items():
            offers = [(i, 2, "D", None)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if i == 0 and role[:1] == "s":
                    offers.append((1, more, "K", role))
                j, wanted = (3, "assistant") if i == 2 else (2, "user")
                offers.append((j, 1 + more, "R", wanted))
                if role[:1] == wanted[0]:
                    offers.append((j, more, "K", role))
            for j, price, edit, kept in offers:
                ahead[j] = min(ahead.get(j, (10**9,)), (cost + price, audit + edit, made if kept is None else (*made, f"{kept}:{text}")))
        best = ahead
    cost, audit, made = min(v for k, v in insert(best).items() if k in (0, 3))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


def wanted(rows):
    found = {conv: [] for conv, *_ in rows}
    for r in damage(rows):
        found[r[0]].append(r)
    return {conv: repaired(own) for conv, own in found.items()}


def made(df):
    rows = df.collect()
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def random_rows(seed, conversations, turns_each):
    draw = random.Random(seed)
    texts = ["Hello there.", "what now?", "cut off", "", " \n", "Hello there.", "ends! \t", None, "ß.", "other words.", "x" * 300]
    return [(c, draw.choice([k, k, k, k + 3, None]), draw.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None, "User"]), draw.choice(texts) if draw.random() < 0.5 else f"text {draw.random()}.") for c in range(conversations) for k in range(draw.randint(1, turns_each))]


def test_repair_on_the_drivers_table(spark):
    conversations = table(spark, SMALL, "conversations")
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    assert made(turns.repair(turns.damaged(conversations), every=conversations)) == wanted(rows)


@pytest.mark.parametrize("chunk, fan", [(256, 256), (2, 2), (3, 5)])
def test_repair_of_odd_rows_in_trees_of_any_shape(spark, chunk, fan):
    """Null conv_ids, turns, roles and texts, ties, repeats, unknown roles; one conversation holds half of all rows."""
    rows = random_rows(3, 40, 9) + [(None, *r[1:]) for r in random_rows(4, 3, 4)] + [(1000, *r[1:]) for r in random_rows(5, 1, 1)] + [(7_777, k, ("user", "assistant")[k % 2], f"turn {k % 90}.") for k in range(220)]
    rows += [(500 + k, k, "user", None) for k in range(30)]  # some lose their only row
    docs = spark.createDataFrame([(*r, "k", 1, "n") for r in rows], SCHEMA)
    found = made(turns.repair(turns.damaged(docs), every=docs, chunk=chunk, fan=fan))
    assert found == wanted(rows)
    assert any(v[6] == "" for v in found.values())


def test_repaired_turns_hold_the_text(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "no answer?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "alone."), (2, 1, "user", "So?"), (2, 2, "assistant", "It is.")]
    docs = spark.createDataFrame([(*r, "k", 1, "n") for r in rows], SCHEMA)
    texts = {}
    for r in turns.repaired_turns(docs, chunk=2, fan=2).orderBy("conv_id", "node").collect():
        texts.setdefault(r.conv_id, []).append(r.pieces)
    assert {k: "\n".join(v) for k, v in texts.items()} == {"1": "user:no answer?\nassistant:Yes.", "2": "user:So?\nassistant:It is."}


def test_repair_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turns.repair(turns.damaged(empty), every=empty).count() == 0


def test_products_are_associative_and_shapes_of_trees_agree():
    draw = random.Random(1)
    for _ in range(300):
        a, b, c = (turns.chunk_matrix("".join(draw.choices(turns.CODES, k=draw.randint(1, 7)))) for _ in range(3))
        assert turns.times(turns.times(a, b), c) == turns.times(a, turns.times(b, c))
    codes = "".join(draw.choices(turns.CODES, k=500))
    one_by_one = turns.IDENTITY
    for c in codes:
        one_by_one = turns.times(one_by_one, turns.turn_matrix(c))
    assert turns.chunk_matrix(codes) == one_by_one
    parts = [turns.chunk_matrix(codes[k : k + 100]) for k in range(0, 500, 100)]
    states = turns.path(parts, 0, 3)
    assert "".join(m[4 * i + j][1] for m, i, j in zip(parts, states, states[1:])) == one_by_one[3][1]


def test_audits_of_all_short_conversations():
    """Every sequence of up to three codes against all edits that give an allowed order."""
    for n in range(4):
        for codes in every("abcdefgh", repeat=n):
            assert turns.best_end(turns.chunk_matrix("".join(codes)))[:2] == _tried(codes)


def _tried(codes):
    """The least (cost, audit) over all edits, at most two insertions at each place."""
    found = []
    allowed = re.compile("(s?(ua)+)?")
    for edits in every(*([(0, "D"), (1, "K"), (2, "R"), (3, "R")] for _ in codes)):
        if any(turns.CODES.index(c) % 3 == 2 and e[1] != "D" for c, e in zip(codes, edits)):
            continue
        pieces, cost = [], 0
        for c, (kind, letter) in zip(codes, edits):
            role, fault = divmod(turns.CODES.index(c), 3)
            cost += {"D": 2, "K": 0, "R": 1}[letter] + (5 if fault == 1 and letter != "D" else 0)
            pieces.append(("" if kind == 0 else "suax"[role] if kind == 1 else "ua"[kind - 2], letter))
        for inserted in every(("", "u", "a", "ua", "au"), repeat=len(codes) + 1):
            roles = inserted[0] + "".join(p[0] + x for p, x in zip(pieces, inserted[1:]))
            if allowed.fullmatch(roles):
                audit = "I" * len(inserted[0]) + "".join(p[1] + "I" * len(x) for p, x in zip(pieces, inserted[1:]))
                found.append((cost + 5 * sum(map(len, inserted)), audit))
    return min(found)


def test_digests_of_rows_are_those_of_the_plain_version(spark):
    row = spark.createDataFrame([(1, 0, "uß", "t:x", "k", 1, "n")], SCHEMA).withColumn("length", F.length("role"))
    assert turns._ordered(row, 4).first().digest == digest("uß", "t:x")
