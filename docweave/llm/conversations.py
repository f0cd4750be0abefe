"""Repair of conversations' structure by iterative-deepening A*.

A conversation's rows are legal when the initials of their roles read
(s?(ua)+)?. The search walks (row, grammar state) depth first, tries edits in
ASCII order (Delete, Insert, Keep, Rerole) under a bound on the cost and, when
it fails, starts again with the least cost that went over the bound. A table of
failed states keeps, across bounds, what each state is known to cost at least;
the first path that is accepted is thus the cheapest and, of the cheapest, the
ASCII-least.

Rows pass Spark twice: first without texts (a turn, an initial, a fault and a
digest), which gives each conversation's edits; then with texts, sorted behind
their conversation's edits, so that the repaired rows are hashed as they stream
by. What a task holds of a conversation is two bytes a row, whatever its texts.
A conversation of more than SEGMENT rows is searched segment by segment from
its end, each from all grammar states, with what follows as the price of
leaving the segment in a state; this is exact and linear in the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import staged

SPACE = " \t\n\x0b\x0c\r"
SEGMENT = 512
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Letters and faults that make up a row's code: letter * 4 + fault.
LETTERS, FAULTS = "suax", ("", "blank", "duplicate", "truncated")
#: Grammar states: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_INSERTED = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
#: What an end in each state still costs: the rows that have to be inserted.
_END = (0, 2 * INSERT, INSERT, 0)


def _moves(code: int, state: int) -> tuple:
    """(initial, cost, rows passed, next state) of the edits of a row, in ASCII order."""
    letter, fault = LETTERS[code // 4], FAULTS[code % 4]
    out = [("D", DELETE, 1, state), ("I", INSERT, 0, _INSERTED[state])]
    if fault in ("", "truncated"):
        extra, kept = TRUNCATED if fault else 0, _KEPT[letter].get(state)
        if kept is not None:
            out.append(("K", extra, 1, kept))
        if kept != _INSERTED[state]:  # else keeping the row does the same for less
            out.append(("R", REROLE + extra, 1, _INSERTED[state]))
    return tuple(out)


_MOVES = {(code, state): _moves(code, state) for code in range(16) for state in range(4)}
_LAST = {state: (("I", INSERT, 0, _INSERTED[state]),) for state in range(4)}


def _least(codes: bytes, ends: tuple) -> list[int]:
    """What (row, state) costs at least, at row * 4 + state: each row's cheapest edit, and one edit for each pair of legal
    rows that follow each other with one initial. One system row may stay if nothing came before it."""
    need = [0] * (4 * len(codes)) + list(ends)
    total, system, pending, floor = 0, 0, "", min(ends)
    for i in range(len(codes) - 1, -1, -1):
        letter, fault = LETTERS[codes[i] // 4], FAULTS[codes[i] % 4]
        if fault:
            total += DELETE
        elif letter in "ua":
            if letter == pending:
                total, pending = total + 1, ""
            else:
                pending = letter
        else:
            total, pending, system = total + REROLE, "", system | (letter == "s")
        need[4 * i : 4 * i + 4] = [total - system + floor] + [total + floor] * 3
    return need


def _search(codes: bytes, start: int, ends: tuple, need: list[int], last: bool) -> tuple[int, str, int]:
    """(cost, edits, final state) from a state on, ends being what a final state costs; need is raised as states fail.
    Only behind the last segment may rows be inserted at the end."""
    n, bound = len(codes), need[start]
    stop = (START, ASSISTANT) if last else range(4)
    while True:
        if not n and start in stop and ends[start] <= bound:
            return ends[start], "", start
        path, stack = [], [[0, start, bound, 0, 1 << 60]]
        while stack:
            frame = stack[-1]
            i, state, budget, at, over = frame
            moves = _MOVES[codes[i], state] if i < n else _LAST[state] if last else ()
            deeper = False
            while at < len(moves):
                letter, cost, step, after = moves[at]
                at += 1
                low = need[4 * (i + step) + after]
                if low > budget - cost:
                    over = min(over, cost + low)
                    continue
                path.append((letter, cost))
                if i + step == n and after in stop:  # low is the price of stopping here
                    return sum(c for _, c in path) + ends[after], "".join(x for x, _ in path), after
                frame[3], frame[4], deeper = at, over, True
                stack.append([i + step, after, budget - cost, 0, 1 << 60])
                break
            if deeper:
                continue
            if over > need[4 * i + state]:
                need[4 * i + state] = over
            stack.pop()
            if stack:
                _, cost = path.pop()
                stack[-1][4] = min(stack[-1][4], cost + need[4 * i + state])
        bound = need[start]


@lru_cache(1 << 14)
def _short(codes: bytes) -> tuple[int, str]:
    return _search(codes, START, _END, _least(codes, _END), True)[:2]


def cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, edits) of a conversation, given the codes of its rows."""
    if len(codes) <= SEGMENT:
        return _short(codes)
    ends, done, last = _END, [], True
    for lo in range((len(codes) - 1) // SEGMENT * SEGMENT, -1, -SEGMENT):
        part = codes[lo : lo + SEGMENT]
        need = _least(part, ends)
        found = [_search(part, state, ends, need, last) for state in (range(4) if lo else (START,))]
        done.append(found)
        ends, last = tuple(cost for cost, _, _ in found), False
    state, edits = START, []
    for found in reversed(done):
        _, part, state = found[state]
        edits.append(part)
    return done[-1][0][0], "".join(edits)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, pa.RecordBatch]]:
    """(key, whether it is another one than before, rows) for each stretch of equal values of the first column."""
    before, started = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0)
        rank = key.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(rank)]):
            value = key[lo].as_py()
            yield value, not started or value != before, batch.slice(lo, hi - lo)
            before, started = value, True


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, code; code null where the row only says that there is the conversation) in order, to one row a conversation."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    out: list[tuple] = []
    key, codes, low, high, turns = None, bytearray(), None, None, 0

    def close():
        seen = np.frombuffer(bytes(codes), np.uint8)
        fault, letter = np.bincount(seen % 4, minlength=4), seen // 4
        pairs = letter[:-1] * 4 + letter[1:]
        legal = [LETTERS.index(a) * 4 + LETTERS.index(b) for a, b in ("su", "ua", "au")]
        cost, audit = cheapest(bytes(codes))
        out.append((key, high - low + 1 - turns if turns else 0, int(fault[1]), int(fault[2]), int(fault[3]), int((~np.isin(pairs, legal)).sum()), cost, audit))

    def flush():
        columns = list(zip(*out)) or [()] * len(names)
        types = [*[pa.int64()] * 7, pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        out.clear()
        return batch

    open_ = False
    for value, new, rows in _runs(batches):
        if new:
            if open_:
                close()
            if len(out) >= 4096:
                yield flush()
            key, codes, low, high, turns, open_ = value, bytearray(), None, None, 0, True
        code = rows.column(2).drop_null()
        codes += code.to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
        turn = rows.column(1).filter(rows.column(2).is_valid()).drop_null().to_numpy(zero_copy_only=False)
        if len(turn):
            turns += int((turn[1:] != turn[:-1]).sum()) + (high is None or int(turn[0]) != high)
            low, high = int(turn[0]) if low is None else low, int(turn[-1])
    if open_:
        close()
    yield flush()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, edits or null, role, text), each conversation's edits first, to (conv_id, repaired_sha256)."""
    out: list[tuple] = []
    audit, at, state, digest, lines = "", 0, START, None, 0
    name = {USER: b"user", ASSISTANT: b"assistant"}

    def put(role: bytes, text: bytes) -> None:
        nonlocal lines
        digest.update(b"\n" * bool(lines) + role + b":" + text)
        lines += 1

    def insert() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = _INSERTED[state]
            put(name[state], b"")
            at += 1

    def flush():
        columns = list(zip(*out)) or [(), ()]
        batch = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], ["conv_id", "repaired_sha256"])
        out.clear()
        return batch

    key = None
    for value, new, rows in _runs(batches):
        if new:
            if digest is not None:
                insert()
                out.append((key, digest.hexdigest()))
            if len(out) >= 4096:
                yield flush()
            key, audit, at, state, digest, lines = value, rows.column(1)[0].as_py(), 0, START, hashlib.sha256(), 0
            rows = rows.slice(1)
        for role, text in zip(rows.column(2), rows.column(3)):
            insert()
            edit, role = audit[at], role.as_py()
            at += 1
            if edit == "K":
                state = _KEPT[role[0]][state]
                put(role.encode(), text.as_py().encode())
            elif edit == "R":
                state = _INSERTED[state]
                put(name[state], text.as_py().encode())
    if digest is not None:
        insert()
        out.append((key, digest.hexdigest()))
    yield flush()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of rows with some of them damaged, by a checksum of conversation and turn: no copy
    of a row that is dropped, two of one that is repeated. Nulls of role and text, and in the checksum, are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce(F.col("text").cast("string"), space)
    kept = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("hit"))
    return kept.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).alias("copies"),
    )


def _code(letter: Column, fault: Column) -> Column:
    number = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    return (number * 4 + fault).cast("byte")


def repaired(rows: DataFrame) -> DataFrame:
    """One row a conv_id of rows (conv_id, turn, role, text, copies): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's rows are taken by turn, nulls first, then by role and by
    the text's digest. Null roles and texts count as one space; a role whose
    initial is not s, u or a, an empty one included, fits nowhere. Rows without
    conv_id are one conversation. Rows of no copies only tell that there is the
    conversation; without any other, its audit is empty. A very long text is
    read once and hashed as it is; an empty table gives no rows.
    """
    space = F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), "copies")
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    plain = F.rtrim("text", F.lit(SPACE))
    own = F.when(plain == "", 1).when(~F.right(plain, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    marked = rows.select("conv_id", "turn", "role", "digest", own.alias("own"), F.explode(F.when(F.col("copies") < 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("copies")))).alias("copy"))
    order = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"), "copy")
    again = (F.row_number().over(order) > 1) & (F.col("own") != 1)
    there = marked.filter("copy > 0").select("conv_id", "turn", "role", "digest", F.when(again, 2).otherwise(F.col("own")).alias("fault"), again.alias("again"))
    there = there.select("conv_id", "turn", _code(F.substring("role", 1, 1), F.col("fault")).alias("code"), "role", "digest", "again")
    absent = marked.filter("copy = 0").select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("byte").alias("code"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit(False).alias("again"))
    narrow = there.unionByName(absent).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "again").select("conv_id", "turn", "code")
    found = staged(narrow.mapInArrow(_edits, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "edits")

    nothing = lambda c: F.lit(None).cast(c)
    first = found.select("conv_id", "audit", nothing("string").alias("role"), nothing("string").alias("text"), F.lit(0).alias("kind"), nothing("long").alias("turn"), nothing("binary").alias("digest"))
    texts = rows.filter("copies > 0").select("conv_id", nothing("string").alias("audit"), "role", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("kind"), "turn", "digest")
    wide = first.unionByName(texts.withColumn("kind", F.lit(1))).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest")
    hashes = wide.select("conv_id", "audit", "role", "text").mapInArrow(_hashes, "conv_id long, repaired_sha256 string")
    return found.join(hashes.withColumnRenamed("conv_id", "h"), F.col("conv_id").eqNullSafe(F.col("h"))).drop("h")
