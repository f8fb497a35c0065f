"""Repair of conversations by a min-plus matrix scan.

Editing a conversation walks four states: nothing yet (0), after the system's turn (1), after a user's (2), after an assistant's (3). A turn is
a 4x4 matrix over (cost, audit): cell (i, j) is the cheapest edit that takes state i to state j, its initials as the audit, least in ASCII
among equal costs; each matrix starts with the closure over insertions. Min and "add costs, join audits" form a semiring here: two audits
of the same turns from one state to another have equally many letters but for insertions, which cost, so of equal costs none is the start
of another, and joining keeps their order. Products are associative, so turns are multiplied in a balanced tree:
CHUNK turns of a conversation at a time, then FAN matrices at a time, until each conversation has one. The way back gives each node its
first and last state, and each chunk walks its own cell's audit over its own turns. No task holds a conversation's turns or texts; the row of a conversation
holds its audit, a letter a turn. Texts of long conversations are hashed as a stream of their chunks.

Turns are ordered by a range partition on (conversation, turn, digest), so a long conversation is spread over tasks from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, written

#: Turns of a chunk, matrices of a node.
CHUNK, FAN = 256, 256
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
ACCEPTED = (0, 3)
ROLES = {0: "user", 1: "user", 2: "assistant", 3: "user"}
#: States that state i can lead to, itself included.
AHEAD = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))
Cell = tuple[int, str] | None
Matrix = tuple[Cell, ...]

_WORD = r"[^\x20\x09-\x0D]"


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: the least (cost, audit) over the state between."""
    cells: list[Cell] = [None] * 16
    for i in range(4):
        for j in AHEAD[i]:
            best = None
            for k in AHEAD[i]:
                x, y = a[4 * i + k], b[4 * k + j]
                if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                    made = (x[0] + y[0], x[1] + y[1])
                    best = made if best is None or made < best else best
            cells[4 * i + j] = best
    return tuple(cells)


IDENTITY: Matrix = tuple((0, "") if i == j else None for i in range(4) for j in range(4))


def _closure() -> Matrix:
    """Insertions, none included: a user's turn before an assistant's, an assistant's after a user's."""
    step: list[Cell] = list(IDENTITY)
    for i, j in ((0, 2), (1, 2), (2, 3), (3, 2)):
        step[4 * i + j] = (INSERT, "I")
    twice = times(tuple(step), tuple(step))
    return times(twice, twice)


CLOSURE = _closure()
#: Codes of turns: initial of the role (s, u, a, any other) and fault (none, truncated, one that must go).
CODES = "abcdefghijkl"


def code(initial: Column, must_go: Column, truncated: Column) -> Column:
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.substring(F.lit(CODES), role * 3 + F.when(must_go, 2).when(truncated, 1).otherwise(0) + 1, F.lit(1))


@lru_cache(None)
def turn_matrix(letter: str) -> Matrix:
    role, fault = divmod(CODES.index(letter), 3)
    edits: list[Cell] = [(DELETE, "D") if i == j else None for i in range(4) for j in range(4)]

    def offer(i: int, j: int, cost: int, audit: str) -> None:
        cell = (cost + (TRUNCATED if fault == 1 else 0), audit)
        edits[4 * i + j] = min(cell, edits[4 * i + j] or cell)

    if fault != 2:
        if role == 0:
            offer(0, 1, 0, "K")
        for i, j in ((0, 2), (1, 2), (2, 3), (3, 2)):
            offer(i, j, REROLE, "R")
            if (role, j) in ((1, 2), (2, 3)):
                offer(i, j, 0, "K")
    return times(CLOSURE, tuple(edits))


def product(matrices: list[Matrix]) -> Matrix:
    """Of a balanced tree over the matrices in order."""
    while len(matrices) > 1:
        matrices = [times(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0] if matrices else IDENTITY


@lru_cache(50_000)
def _piece(codes: str) -> Matrix:
    return turn_matrix(codes) if len(codes) == 1 else times(_piece(codes[: len(codes) // 2]), _piece(codes[len(codes) // 2 :]))


def chunk_matrix(codes: str) -> Matrix:
    """The product of a chunk's turns; blocks of eight turns, which recur, are remembered."""
    return product([_piece(codes[k : k + 8]) for k in range(0, len(codes), 8)])


def illegal_pairs(codes: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    roles = ["suax"[CODES.index(c) // 3] for c in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def best_end(m: Matrix) -> tuple[int, str, int, str]:
    """(cost, audit, state before the last insertions, those insertions) of a whole conversation."""
    found = []
    for j in range(4):
        for end in ACCEPTED:
            if m[j] is not None and CLOSURE[4 * j + end] is not None:
                (cost, audit), (more, tail) = m[j], CLOSURE[4 * j + end]
                found.append((cost + more, audit + tail, j, tail))
    return min(found)


def path(matrices: list[Matrix], first: int, last: int) -> list[int]:
    """States between the matrices of the least (cost, audit) from first to last, both included."""
    at: dict[int, tuple[int, str, tuple[int, ...]]] = {first: (0, "", (first,))}
    for m in matrices:
        ahead: dict[int, tuple[int, str, tuple[int, ...]]] = {}
        for i, (cost, audit, states) in at.items():
            for j in AHEAD[i]:
                if m[4 * i + j] is not None:
                    made = (cost + m[4 * i + j][0], audit + m[4 * i + j][1], (*states, j))
                    if j not in ahead or made[:2] < ahead[j][:2]:
                        ahead[j] = made
        at = ahead
    return list(at[last][2])


def rewritten(audit: str, state: int, turns: Iterator[tuple[str, str]]) -> Iterator[str]:
    """role:text of the turns that an audit keeps, changes or inserts, from a state on."""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES[state]
        state = 1 if state == 0 and edit == "K" and role[:1] == "s" else 3 if state == 2 else 2
        yield f"{role}:{text}"


_CELLS = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
_MATRIX = "matrix array<struct<cost:bigint,audit:string>>"


def _stored(m: Matrix) -> list[dict | None]:
    return [None if c is None else {"cost": c[0], "audit": c[1]} for c in m]


def _loaded(cells: list[dict | None]) -> Matrix:
    return tuple(None if c is None else (c["cost"], c["audit"]) for c in cells)


def _rows(batches: Iterable[pa.RecordBatch], columns: list[str], each: int = 256) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, each):
            part = batch.slice(at, each)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of rows; a batch ends when its texts exceed `most` characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row.values() if isinstance(v, str))
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with planted faults, chosen by crc32 of conv_id:turn by twenty; a null counts as one space.

    0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    made = conversations.select("conv_id", "turn", lot.alias("lot"), text("role").alias("role"), text("text").alias("text")).filter("lot <> 0")
    hurt = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = made.withColumns({"text": hurt, "role": F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))})
    return made.withColumn("copy", F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("lot", "copy")


def _ordered(turns: DataFrame, chunk: int) -> DataFrame:
    """turns with key, digest, `at` (the order of all rows) and `chunk`, at most `chunk` rows of a conversation in one partition, as a table."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    made = turns.select(key.alias("key"), "turn", role.alias("role"), text.alias("text"))
    made = made.withColumn("digest", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    order = ["key", F.col("turn").asc_nulls_first(), "digest"]
    placed = made.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    placed = placed.withColumns({"blank": ~F.col("text").rlike(_WORD), "truncated": ~last.isin(".", "!", "?"), "chunk": F.expr(f"at div {chunk}")})
    return written(placed, "turns")


def _faults(turns: DataFrame) -> DataFrame:
    """(key, chunk, at, turn, blank, duplicate, truncated, code): the first fault of each turn. Digests that recur are few; only they are joined."""
    seen = turns.groupBy("key", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    slim = turns.select("key", "digest", "chunk", "at", "turn", "blank", "truncated", F.substring("role", 1, 1).alias("initial"))
    again = slim.join(seen, ["key", "digest"], "left").withColumn("duplicate", ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
    again = again.withColumn("truncated", F.col("truncated") & ~F.col("blank") & ~F.col("duplicate"))
    return again.select("key", "chunk", "at", "turn", "blank", "duplicate", "truncated", code(F.col("initial"), F.col("blank") | F.col("duplicate"), F.col("truncated")).alias("code"))


def _chunks(faults: DataFrame) -> DataFrame:
    """(key, node, codes, first, last, illegal, matrix) of each chunk."""
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "")  # CHUNK rows at most
    listed = faults.groupBy("key", F.col("chunk").alias("node")).agg(codes.alias("codes"))
    schema = pa.schema([("key", pa.string()), ("node", pa.int64()), ("codes", pa.string()), ("illegal", pa.int64()), ("matrix", _CELLS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ({"key": k, "node": n, "codes": c, "illegal": illegal_pairs(c), "matrix": _stored(chunk_matrix(c))} for k, n, c in _rows(batches, ["key", "node", "codes"]))
        yield from _batches(made, schema, 1 << 18)

    return written(listed.mapInArrow(run, f"key string, node bigint, codes string, illegal bigint, {_MATRIX}"), "chunks")


def _parents(nodes: DataFrame, fan: int) -> DataFrame:
    """(key, node, children, matrix): `fan` neighbours of a conversation at a time."""
    placed = nodes.select("key", "node", "matrix").withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("node")) - 1)
    listed = placed.groupBy("key", F.expr(f"bigint(place div {fan})").alias("up")).agg(F.array_sort(F.collect_list(F.struct("place", "node", "matrix"))).alias("children"))  # fan entries at most
    joined = listed.select("key", F.col("up").alias("node"), F.transform("children", lambda c: c["node"]).alias("children"), F.transform("children", lambda c: c["matrix"]).alias("matrices"))
    schema = pa.schema([("key", pa.string()), ("node", pa.int64()), ("children", pa.list_(pa.int64())), ("matrices", pa.list_(_CELLS)), ("matrix", _CELLS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, children, matrices in _rows(batches, ["key", "node", "children", "matrices"], 16):
            made = {"key": key, "node": node, "children": children, "matrices": matrices, "matrix": _stored(product([_loaded(m) for m in matrices]))}
            yield pa.RecordBatch.from_pylist([made], schema)

    cells = "array<struct<cost:bigint,audit:string>>"
    return written(joined.mapInArrow(run, f"key string, node bigint, children array<bigint>, matrices array<{cells}>, matrix {cells}"), "nodes")


def _down(chosen: DataFrame, parents: DataFrame) -> DataFrame:
    """(key, node, first, last, tail) of the children of chosen nodes."""
    schema = pa.schema([("key", pa.string()), ("node", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("tail", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            for key, first, last, tail, children, matrices in _rows(batches, ["key", "first", "last", "tail", "children", "matrices"], 16):
                states = path([_loaded(m) for m in matrices], first, last)
                for k, child in enumerate(children):
                    yield {"key": key, "node": child, "first": states[k], "last": states[k + 1], "tail": tail if k + 1 == len(children) else ""}

        yield from _batches(made(), schema)

    joined = chosen.join(parents.select("key", "node", "children", "matrices"), ["key", "node"])
    return joined.mapInArrow(run, "key string, node bigint, first int, last int, tail string")


def _ends(top: DataFrame) -> DataFrame:
    """(key, node, cost, audit, first, last, tail) of conversations with one node each."""
    schema = pa.schema([("key", pa.string()), ("node", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("tail", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            for key, node, matrix in _rows(batches, ["key", "node", "matrix"]):
                cost, audit, last, tail = best_end(_loaded(matrix))
                yield {"key": key, "node": node, "cost": cost, "audit": audit, "first": 0, "last": last, "tail": tail}

        yield from _batches(made(), schema)

    return top.select("key", "node", "matrix").mapInArrow(run, "key string, node bigint, cost bigint, audit string, first int, last int, tail string")


def _texts(turns: DataFrame, leaves: DataFrame) -> DataFrame:
    """(key, node, pieces): repaired `role:text` of each chunk, newline-joined; empty if nothing is left. Texts cross one shuffle, by chunk."""
    rows = turns.select("key", F.col("chunk").alias("node"), "at", "role", "text", F.lit(None).cast("int").alias("state"))
    head = leaves.select("key", "node", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"), F.col("first").alias("state"))
    both = rows.unionByName(head).repartition("key", "node").sortWithinPartitions("key", "node", "at")
    schema = pa.schema([("key", pa.string()), ("node", pa.int64()), ("pieces", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            rows = _rows(batches, ["key", "node", "at", "role", "text", "state"])
            head = next(rows, None)
            while head is not None:
                key, node, _, _, audit, state = head
                following: list[tuple | None] = [None]

                def turns() -> Iterator[tuple[str, str]]:
                    for row in rows:
                        if row[2] == -1:
                            following[0] = row
                            return
                        yield row[3], row[4]

                own = turns()
                pieces = "\n".join(rewritten(audit, state, own))
                next(own, None)  # the head of the next chunk
                yield {"key": key, "node": node, "pieces": pieces}
                head = following[0]

        yield from _batches(made(), schema)

    return both.mapInArrow(run, "key string, node bigint, pieces string")


def _hashes(pieces: DataFrame) -> DataFrame:
    """(key, repaired_sha256): the hash of a conversation's chunks as one stream, newline between those that are not empty."""
    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            current, digest, began = None, hashlib.sha256(), False
            for key, text in _rows(batches, ["key", "pieces"], 16):
                if key != current:
                    if current is not None:
                        yield {"key": current, "repaired_sha256": digest.hexdigest()}
                    current, digest, began = key, hashlib.sha256(), False
                if text:
                    digest.update(("\n" if began else "").encode() + text.encode())
                    began = True
            if current is not None:
                yield {"key": current, "repaired_sha256": digest.hexdigest()}

        yield from _batches(made(), schema)

    return pieces.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key string, repaired_sha256 string")


def _scan(turns: DataFrame, fan: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, whole conversations with cost and audit, repaired texts by chunk)."""
    chunks = _chunks(_faults(turns))
    levels, top = [], chunks
    while top.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] not in (None, 1):
        top = _parents(top, fan)
        levels.append(top)
    ends = written(_ends(top), "ends")
    chosen = ends.select("key", "node", "first", "last", "tail")
    for level in reversed(levels):
        chosen = written(_down(chosen, level), "chosen")
    own = F.element_at("matrix", F.col("first") * 4 + F.col("last") + 1)["audit"]
    leaves = chunks.join(chosen, ["key", "node"]).select("key", "node", "first", F.concat(own, "tail").alias("audit"))
    return chunks, ends, _texts(turns, leaves)


def repaired_turns(conversations: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(conv_id, node, pieces): the repaired turns of each conversation, `role:text`, newline-joined by chunk in order; conv_id as a string, null for null."""
    pieces = _scan(_ordered(conversations, chunk), fan)[2]
    return pieces.filter("pieces <> ''").select(F.when(F.col("key") != " ", F.col("key")).alias("conv_id"), "node", "pieces")


def repair(conversations: DataFrame, every: DataFrame | None = None, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation.

    conversations: (conv_id, turn, role, text, ...), other columns are ignored. every: a table whose conv_ids each get a row (default: conversations).
    Rows follow by turn, nulls first; rows of one turn by a digest of role and text, rows alike are adjacent there. A null conv_id is a conversation of its own,
    a null role or text counts as one space, so such a text is blank. A conversation without rows has zeros, an empty audit and the hash of nothing. An
    empty table gives an empty result.
    """
    known = (conversations if every is None else every).select("conv_id").distinct().withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    turns = _ordered(conversations, chunk)
    chunks, ends, pieces = _scan(turns, fan)
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    whole = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    faults = _faults(turns).groupBy("key").agg(F.coalesce(whole, F.lit(0)).cast("long").alias("gaps"), *map(count, ("blank", "duplicate", "truncated")))
    # neighbours across chunks: the last code of one and the first of the next
    initial = lambda c: F.expr(f"(instr('{CODES}', {c}) - 1) div 3")
    edge = F.lag(F.right("codes", F.lit(1))).over(W.partitionBy("key").orderBy("node"))
    edges = chunks.withColumns({"before": edge, "after": F.left("codes", F.lit(1))})
    pair = F.concat_ws("", *(F.substring(F.lit("suax"), initial(c).cast("int") + 1, F.lit(1)) for c in ("before", "after")))
    broken = (F.col("before").isNotNull() & ~pair.isin("su", "ua", "au")).cast("long")
    illegal = edges.groupBy("key").agg(F.sum(F.col("illegal") + broken).alias("illegal"))
    found = known.join(faults, "key", "left").join(illegal, "key", "left").join(ends.select("key", "cost", "audit"), "key", "left").join(_hashes(pieces), "key", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return found.withColumns(zero | nothing).select("conv_id", *zero, *nothing)
