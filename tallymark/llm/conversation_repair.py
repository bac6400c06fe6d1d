"""Repair of the structure of conversations by cheapest edits.

A conversation's rows in order are the layers of a graph whose nodes are (rows
read, what the repaired conversation ends in: nothing, system, user, assistant)
and whose arcs are edits with costs of 0 to 3.  Dial's bucket queue, which such
small integers allow, gives every node's distance to the end; a walk from the
start along tight arcs, the ASCII-least first, is the audit.

A conversation may be of any length, so it is cut into blocks: the rows of one
conversation in one range of the sorted table, BLOCK at most.  A block by itself
gives the distances from each state before it to each after it; those 16 numbers
are composed block by block, backwards for the distances, forwards for the state
that the audit really enters a block with.  Only conversations that may lie in
several blocks take that way.  What must be one stream, the repaired text of one
conversation, flows through a task in order and is never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialise

#: Rows of a block at most.
BLOCK = 4096
#: What a repaired conversation ends in.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of edits, and what a cut-off row adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Distances from each state to the end when no row is left: a user's or assistant's turn must be inserted.
END = (0, 2 * INSERT, INSERT, 0)
#: What a turn of a user or an assistant leads to.
TURN = (USER, USER, ASSISTANT, USER)
#: Codes of items: the role's initial, plus CUT if the text is cut off; GONE stands for a run of rows that must be deleted.
INITIALS, CUT, GONE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}, 4, 8
FAR = 1 << 60
_SOLID = "[^\\x20\\x09-\\x0D]"


# --------------------------------------------------------------------------- paths


def distances(codes: bytes, after: tuple[int, ...] | list[int]) -> list[int]:
    """Distance to the end of each node (item, state), at 4 * item + state; ``after``: of the states behind the last item (FAR: no way).

    Deleting what must be deleted is free here: it is the same for all ways.
    """
    n = len(codes)
    far = [FAR] * (4 * n + 4)
    buckets: list[list[int]] = [[]]

    def reach(node: int, d: int) -> None:
        if d < far[node]:
            far[node] = d
            while len(buckets) <= d - base:
                buckets.append([])
            buckets[d - base].append(node)

    base = min(after)
    for state, d in enumerate(after):
        if d < FAR:
            reach(4 * n + state, d)
    d = base
    while d - base < len(buckets):
        for node in buckets[d - base]:  # grows while it is read: arcs may cost nothing
            if far[node] != d:
                continue
            item, to = divmod(node, 4)
            before = (NOTHING, SYSTEM, ASSISTANT) if to == USER else (USER,) if to == ASSISTANT else ()
            for state in before:
                reach(4 * item + state, d + INSERT)
            if not item:
                continue
            code, row = codes[item - 1], 4 * item - 4
            if code == GONE:
                reach(row + to, d)
                continue
            reach(row + to, d + DELETE)
            spoilt, role = (TRUNCATED if code & CUT else 0), code & 3
            if to == SYSTEM and role == SYSTEM:
                reach(row + NOTHING, d + spoilt)
            for state in before:
                reach(row + state, d + spoilt + (0 if role == to else REROLE))
        buckets[d - base] = []
        d += 1
    return far


def walk(codes: bytes, runs: list[int], far: list[int], state: int, last: bool) -> tuple[str, int, int]:
    """(the ASCII-least of the cheapest audits, the state it ends in, its cost) from ``state`` to behind the last item."""
    letters, cost, item = [], 0, 0
    while item < len(codes) or last and state in (SYSTEM, USER):
        node = 4 * item + state
        if item < len(codes):
            code = codes[item]
            if code == GONE:  # deleting is never dearer here than inserting first, and comes first in ASCII
                letters.append("D" * runs[item])
                cost += DELETE * runs[item]
                item += 1
                continue
            if far[node] == far[node + 4] + DELETE:
                letters.append("D")
                cost += DELETE
                item += 1
                continue
        turn = TURN[state]
        if far[node] == far[4 * item + turn] + INSERT:
            letters.append("I")
            cost += INSERT
            state = turn
            continue
        spoilt, role = (TRUNCATED if code & CUT else 0), code & 3
        if role == SYSTEM and state == NOTHING and far[node] == far[4 * item + 4 + SYSTEM] + spoilt:
            state, letter, price = SYSTEM, "K", spoilt
        else:
            state, letter, price = turn, *(("K", spoilt) if role == turn else ("R", spoilt + REROLE))
        letters.append(letter)
        cost += price
        item += 1
    return "".join(letters), state, cost


# --------------------------------------------------------------------------- rows


def damage(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): what is left of the rows after faults that the crc32 of `conv_id:turn` chooses; nulls in that, in role and in text are one space.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes ``.!?`` out of
    it, 3 repeats the row, 4 makes its role ``user``.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn))), F.lit(20)).alias("kind")
    rows = conversations.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), kind).filter("kind != 0")
    told = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    said = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv", "turn", said.alias("role"), told.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def judged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, turn, role, text, copies) with equal rows put together; and, without texts, what is wrong with them: blank, cut (last character not ``.!?``) and again (role and text came at an earlier turn).

    Equal rows meet after they have been counted where they are, and the first
    place of each role and text comes back by a join on keys that are unique, so
    neither depends on how long a conversation is.
    """
    d = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    d = d.withColumns({"sha": F.unhex(F.sha2("text", 256)), "blank": ~F.col("text").rlike(_SOLID), "cut": ~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")})
    d = materialise(d, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"))
    firsts = d.groupBy("conv", "role", "sha").agg(F.min(place).alias("first"))
    firsts = firsts.select(*[F.col(c).alias(f"{c}_") for c in ("conv", "role", "sha")], F.when(F.col("first.known"), F.col("first.at")).alias("turn_"), F.lit(False).alias("again"))
    same = F.lit(True)
    for c in ("conv", "turn", "role", "sha"):
        same = same & d[c].eqNullSafe(firsts[f"{c}_"])
    slim = d.select("conv", "turn", "role", "sha", "copies", "blank", "cut").join(firsts, same, "left")
    return d, slim.select("conv", "turn", "role", "sha", "copies", "blank", "cut", F.coalesce("again", F.lit(True)).alias("again"))


def _by_place(*more) -> list:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("sha").asc(), *more]


def blocks(slim: DataFrame) -> DataFrame:
    """The rows as blocks, in the order of conversation, turn (null first), role and SHA-256 of the text.

    A block is ``whole`` if its conversation is certainly in no other one: it is
    neither the first nor the last of its range, nor was it cut.
    """
    first = "turn long, role string, sha binary"  # of the block's first row
    fields = _schema(slim, f"block long, whole boolean, codes binary, runs array<long>, illegal long, first string, last string, {first}")
    arrow = [pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, conv, kind, held, out = TaskContext.get().partitionId() << 33, None, None, None, []

        def close(whole: bool) -> None:
            nonlocal number, held
            if held:
                out.append((conv, number, whole and not held["split"], bytes(held["codes"]), held["runs"], held["illegal"], held["initial"], held["last"], *held["key"]))
                number += 1
            held = None

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *arrow])], fields.names)

        started, split, leading = False, False, True
        for batch in batches:
            kind = batch.column(0).type
            for key, turn, role, sha, copies, blank, cut, again in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or key != conv:
                    close(not leading)
                    leading, started, split, conv = not started, True, False, key
                elif held and len(held["codes"]) >= BLOCK:
                    held["split"] = split = True
                    close(False)
                initial = role[:1]
                if held is None:
                    held = {"codes": bytearray(), "runs": [], "illegal": 0, "initial": initial, "last": None, "key": (turn, role, sha), "split": split}
                pair = (held["last"] or "") + initial if held["last"] is not None else "ua"
                held["illegal"] += (pair not in ("su", "ua", "au")) + (initial + initial not in ("su", "ua", "au")) * (copies - 1)
                held["last"] = initial
                if not blank and not again:
                    held["codes"].append(INITIALS.get(initial, 0) | (CUT if cut else 0))
                    held["runs"].append(1)
                    copies -= 1
                if copies:
                    held["codes"].append(GONE)
                    held["runs"].append(copies)
                if len(out) >= 1024:
                    yield batch_of()
        close(False)
        if out:
            yield batch_of()

    return slim.select("conv", "turn", "role", "sha", "copies", "blank", "cut", "again").repartitionByRange(*_by_place()).sortWithinPartitions(*_by_place()).mapInArrow(lean(run), fields)


# --------------------------------------------------------------------------- whole conversations


def _schema(df: DataFrame, ddl: str) -> T.StructType:
    """conv, as ``df`` has it, and the fields of ``ddl``."""
    return T.StructType([df.schema["conv"], *T.StructType.fromDDL(ddl)])


def _each(df: DataFrame, columns: list[str], schema: T.StructType, types: list[pa.DataType], make) -> DataFrame:
    """mapInArrow where ``make(rows)`` turns the stream of rows (tuples of ``columns``) into a stream of rows; the first column keeps its type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [kind, *types])], schema.names)

        out, size = [], 0
        for row in make(rows()):
            out.append(row)
            size += 64 + sum(len(v) for v in row if isinstance(v, (str, bytes)))
            if size >= 4 << 20:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    return df.select(*columns).mapInArrow(lean(run), schema)


def _solve_whole(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, block, codes, runs, illegal in rows:
        audit, _, cost = walk(codes, runs, distances(codes, END), NOTHING, True)
        yield conv, block, audit, cost, illegal


def _matrices(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From each state before the block (first index) to each behind it."""
    for conv, block, codes in rows:
        ways = [distances(codes, [0 if s == to else FAR for s in range(4)])[:4] for to in range(4)]
        yield conv, block, [ways[to][s] for s in range(4) for to in range(4)]


def _backwards(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Distances behind each block; rows come by conversation, last block first.  Distances are kept relative: only their differences matter."""
    conv, after = None, None
    for key, block, ways in rows:
        if after is None or key != conv:
            conv, after, last = key, list(END), True
        yield key, block, after, last
        after = [min(w + d for w, d in zip(ways[4 * s : 4 * s + 4], after)) for s in range(4)]
        after, last = [d - min(after) for d in after], False


def _walks(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From each state before the block, one audit."""
    for conv, block, codes, runs, after, last in rows:
        far = distances(codes, after)
        audits, ends, costs = zip(*(walk(codes, runs, far, state, last) for state in range(4)))
        yield conv, block, list(audits), list(ends), list(costs)


def _forwards(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The state that each block is entered with, and whether its first row follows the one before it illegally; rows come by conversation, first block first."""
    conv, state, before = None, None, None
    for key, block, ends, first, last in rows:
        if state is None or key != conv:
            conv, state, before = key, NOTHING, None
        yield key, block, state, int(before is not None and before + first not in ("su", "ua", "au"))
        state, before = ends[state], last


def solve(pieces: DataFrame) -> DataFrame:
    """(conv, block, audit, cost, illegal) of every block of :func:`blocks`; a block's audit ends with the edit of its last row, that of the last block at the end."""
    of = lambda ddl: _schema(pieces, f"block long, {ddl}")
    whole = _each(pieces.filter("whole"), ["conv", "block", "codes", "runs", "illegal"], of("audit string, cost long, illegal long"), [pa.int64(), pa.string(), pa.int64(), pa.int64()], _solve_whole)
    parts = pieces.filter("NOT whole")
    ways = _each(parts, ["conv", "block", "codes"], of("ways array<long>"), [pa.int64(), pa.list_(pa.int64())], _matrices)
    ways = ways.repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    after = _each(ways, ways.columns, of("after array<long>, is_last boolean"), [pa.int64(), pa.list_(pa.int64()), pa.bool_()], _backwards)
    types = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    walks = _each(parts.join(after.drop("conv"), "block"), ["conv", "block", "codes", "runs", "after", "is_last"], of("audits array<string>, ends array<long>, costs array<long>"), types, _walks)
    walks = materialise(walks.join(parts.select("block", "first", "last", "illegal"), "block"), "walks")
    sorted_walks = walks.select("conv", "block", "ends", "first", "last").repartition("conv").sortWithinPartitions("conv", "block")
    entered = _each(sorted_walks, sorted_walks.columns, of("state int, across long"), [pa.int64(), pa.int32(), pa.int64()], _forwards)
    chosen = walks.join(entered.drop("conv"), "block")
    pick = lambda c: F.element_at(c, F.col("state") + 1)
    return whole.unionByName(chosen.select("conv", "block", pick("audits").alias("audit"), pick("costs").alias("cost"), (F.col("illegal") + F.col("across")).alias("illegal")))


# --------------------------------------------------------------------------- results


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(turns with their texts, what is wrong with them, blocks, edits of the blocks) of (conv, turn, role, text, copies); all are written tables."""
    turns, slim = judged(rows)
    slim = materialise(slim, "judged")
    pieces = materialise(blocks(slim), "blocks")
    return turns, slim, pieces, materialise(solve(pieces), "edits")


def repaired(turns: DataFrame, pieces: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, turn, role, text, edit) of the repaired conversations: a row for each turn that is kept (K), given another role (R) or inserted (I; turn null, text empty).

    Rows come by conversation and in order, each conversation in one partition, through which it only flows: a block's audit arrives just before the texts it is about.
    """
    audits = pieces.select("conv", "block", "turn", "role", "sha").join(edits.select("block", "audit"), "block")
    audits = audits.select("conv", "turn", "role", "sha", F.lit(0).alias("kind"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"))
    both = audits.unionByName(turns.select("conv", "turn", "role", "sha", F.lit(1).alias("kind"), "text", "copies"))
    both = both.repartition("conv").sortWithinPartitions(*_by_place(F.col("kind").asc()))

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, audit, at, state, started = None, "", 0, NOTHING, False

        def inserted() -> Iterator[tuple]:
            nonlocal at, state
            while audit[at : at + 1] == "I":
                at, state = at + 1, TURN[state]
                yield conv, None, "user" if state == USER else "assistant", "", "I"

        for key, turn, role, kind, text, copies in rows:
            if not started or key != conv:
                yield from inserted()
                conv, state, started = key, NOTHING, True
            if not kind:
                audit, at = text, 0
                continue
            yield from inserted()
            letter, at = audit[at], at + copies  # further copies are deleted, and nothing is inserted between them
            if letter == "D":
                continue
            if letter == "K" and state == NOTHING and role[:1] == "s":
                state = SYSTEM
            else:
                state = TURN[state]
                if letter == "R":
                    role = "user" if state == USER else "assistant"
            yield key, turn, role, text, letter
        yield from inserted()

    return _each(both, ["conv", "turn", "role", "kind", "text", "copies"], _schema(turns, "turn long, role string, text string, edit string"), [pa.int64(), pa.string(), pa.string(), pa.string()], make)


def digests(rows: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) over the rows of :func:`repaired`, as they come: the SHA-256 of all ``role:text``, joined by newlines."""

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, running = None, None
        for key, role, text in rows:
            if running is not None and key == conv:
                running.update(b"\n")
            else:
                if running is not None:
                    yield conv, running.hexdigest()
                conv, running = key, hashlib.sha256()
            running.update(f"{role}:{text}".encode())
        if running is not None:
            yield conv, running.hexdigest()

    return _each(rows, ["conv", "role", "text"], _schema(rows, "repaired_sha256 string"), [pa.string()], make)


def repair(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations of a table, in rows of :func:`repaired`; null roles and texts are one space, a null id is a conversation of its own."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns, _, pieces, edits = plan(conversations.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(1).cast("long").alias("copies")))
    return repaired(turns, pieces, edits).toDF(conv_id, turn, role, text, "edit")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation, after :func:`damage`.

    Rows alike in turn go by role, then by the SHA-256 of their text; copies of
    a row are next to each other, and all but the first are duplicates.  A null
    id is a conversation of its own; null turns come first and have no part in
    gaps; empty and blank texts are blank.  A conversation of which no row is
    left has zeros, an empty audit and the hash of an empty string; an empty
    table gives an empty one.  Other columns of the table play no part.
    """
    turns, slim, pieces, edits = plan(damage(conversations))
    extra = lambda first: F.col("copies") - F.when(first, 1).otherwise(0)
    fresh = ~F.col("blank") & ~F.col("again")
    counts = slim.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(extra(fresh))).alias("duplicate"),
        F.sum((fresh & F.col("cut")).cast("long")).alias("truncated"),
    )
    in_order = F.array_sort(F.collect_list(F.struct("block", "audit")))
    totals = edits.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(in_order, lambda b: b["audit"]), "").alias("audit"))
    out = conversations.select(F.col("conv_id")).distinct()
    for table in (counts, totals, digests(repaired(turns, pieces, edits))):
        table = table.withColumnRenamed("conv", "of")
        out = out.join(table, out["conv_id"].eqNullSafe(table["of"]), "left").drop("of")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: DuckDB SQL for the rows of :func:`damage_and_repair`: the best rest of the audit for each state, row by row from the last; ``V`` holds it for the states in their order.
ORACLE = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT * EXCLUDE key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(key) + 1), lambda i: CAST(ord(key[i]) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM h, range(2) AS t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER w AS n, left(role, 1) AS i, lag(left(role, 1)) OVER w AS before,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, blank OR again AS gone, CAST(cut AS INT) AS t, CASE WHEN i IN ('s', 'u', 'a') THEN i ELSE '' END AS k FROM o),
a(conv_id, n, v0, v1, v2, v3) AS (
    SELECT conv_id, max(n) + 1, {'c': 0, 'a': ''}, {'c': 4, 'a': 'II'}, {'c': 2, 'a': 'I'}, {'c': 0, 'a': ''} FROM r GROUP BY conv_id
  UNION ALL
    SELECT conv_id, n, least(b0, {'c': 2 + w2.c, 'a': 'I' || w2.a}), least(b1, {'c': 2 + w2.c, 'a': 'I' || w2.a}), w2, least(b3, {'c': 2 + b2.c, 'a': 'I' || b2.a}) FROM (SELECT *, least(b2, {'c': 2 + b3.c, 'a': 'I' || b3.a}) AS w2 FROM (
    SELECT r.conv_id, r.n,
        CASE WHEN gone THEN {'c': 3 + v0.c, 'a': 'D' || v0.a} ELSE least({'c': 3 + v0.c, 'a': 'D' || v0.a}, {'c': 2 + t + v2.c, 'a': 'R' || v2.a},
            CASE k WHEN 's' THEN {'c': t + v1.c, 'a': 'K' || v1.a} WHEN 'u' THEN {'c': t + v2.c, 'a': 'K' || v2.a} ELSE {'c': 999999999, 'a': ''} END) END AS b0,
        CASE WHEN gone THEN {'c': 3 + v1.c, 'a': 'D' || v1.a} ELSE least({'c': 3 + v1.c, 'a': 'D' || v1.a}, {'c': 2 + t + v2.c, 'a': 'R' || v2.a}, {'c': CASE k WHEN 'u' THEN t + v2.c ELSE 999999999 END, 'a': 'K' || v2.a}) END AS b1,
        CASE WHEN gone THEN {'c': 3 + v2.c, 'a': 'D' || v2.a} ELSE least({'c': 3 + v2.c, 'a': 'D' || v2.a}, {'c': 2 + t + v3.c, 'a': 'R' || v3.a}, {'c': CASE k WHEN 'a' THEN t + v3.c ELSE 999999999 END, 'a': 'K' || v3.a}) END AS b2,
        CASE WHEN gone THEN {'c': 3 + v3.c, 'a': 'D' || v3.a} ELSE least({'c': 3 + v3.c, 'a': 'D' || v3.a}, {'c': 2 + t + v2.c, 'a': 'R' || v2.a}, {'c': CASE k WHEN 'u' THEN t + v2.c ELSE 999999999 END, 'a': 'K' || v2.a}) END AS b3
    FROM a JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.n = a.n - 1))),
best AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM a WHERE n = 1),
l AS (SELECT conv_id, j, audit[j] AS e, sum(CASE WHEN audit[j] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j ROWS UNBOUNDED PRECEDING) AS n FROM best, range(1, len(audit) + 1) AS t(j)),
p AS (SELECT l.conv_id, j, e, r.role, r.text, row_number() OVER w AS place, first_value(CASE WHEN e = 'K' AND r.i = 's' THEN 1 ELSE 0 END) OVER w AS lead FROM l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.n = l.n
    WHERE e <> 'D' WINDOW w AS (PARTITION BY l.conv_id ORDER BY j)),
x AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha FROM p GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
    coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS q LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM q.conv_id
"""
