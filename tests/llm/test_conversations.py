import hashlib
import random
import re
import zlib

import pytest

from docweave.llm import conversations

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if hit == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(hit, text))
        out += [row] * {0: 0, 3: 2}.get(hit, 1)
    return out


def best(faults, roles):
    """(cost, edits) by dynamic programming over every edit sequence without pointless insertions."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(states):
        for _ in range(2):
            states = {q: min(v for v in [states.get(q), *((c + 5, e + "I") for p, (c, e) in states.items() if follow[p] == q)] if v) for q in {*states, *(follow[p] for p in states)}}
        return states

    states = {"": (0, "")}
    for fault, role in zip(faults, roles):
        after = {}
        for q, (cost, edits) in inserted(states).items():
            options = [(2, "D", q)]
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                if role[:1] == follow[q] or (role[:1] == "s" and q == ""):
                    options.append((extra, "K", role[:1]))
                options.append((1 + extra, "R", follow[q]))
            for more, edit, to in options:
                after[to] = min(after.get(to, (10**9, "")), (cost + more, edits + edit))
        states = after
    return min(v for q, v in inserted(states).items() if q in ("", "a"))


def expected(rows):
    convs = {r[0]: [] for r in rows}
    for r in damage(rows):
        convs[r[0]].append(r)
    out = []
    for conv, each in convs.items():
        each.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
        faults, seen = [], set()
        for _, _, role, text in each:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in each if r[1] is not None]
        cost, edits = best(faults, [r[2] for r in each])
        lines, at, state = [], 0, ""
        for e in edits:
            want = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            name = {"u": "user", "a": "assistant"}[want]
            if e == "I":
                lines, state = [*lines, name + ":"], want
                continue
            if e == "K":
                lines, state = [*lines, each[at][2] + ":" + each[at][3]], each[at][2][0]
            elif e == "R":
                lines, state = [*lines, name + ":" + each[at][3]], want
            at += 1
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(each, each[1:])]
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(rows):
    return sorted(map(tuple, conversations.repaired(conversations.damaged(rows)).collect()), key=str)


def test_conversations_match_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    assert found(rows) == expected([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


def test_edge_rows(spark):
    long = "many words " * 20_000
    rows = [
        (1, 0, "user", None), (1, 1, None, "Hi."), (1, 2, "assistant", long), (None, None, None, None), (None, 1, "user", "Hi!"), (None, 1, "user", "Hi!"), (2, None, "system", "Be brief."), (2, None, "user", "Why?"),
        (2, 5, "assistant", "So.  \n"), (2, 9, "tool", "x。"), (3, 0, "system", "Only."), (4, 0, "", "Empty role."), (4, 1, "user", " "), (5, 3, "user", "a."), (5, 3, "user", "b."), (5, 3, "assistant", "c."), (6, -4, "user", "..."), (6, 4, "usher", "!?"),
    ] + [(k, 0, "user", "Gone?") for k in range(100, 140)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id long, turn long, role string, text string, digest string, copies int")
    got = found(df)
    assert got == expected(rows)
    assert any(r[7] == "" and r[6] == 0 for r in got)  # all of some conversation's rows were dropped
    assert found(df.limit(0)) == []


@pytest.mark.parametrize("segment", [512, 3])
def test_search_is_cheapest_and_least(monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    conversations._short.cache_clear()
    draw = random.Random(4)
    for _ in range(2000):
        codes = bytes(draw.choice([0, 4, 8, 4, 8, 12, 3, 5, 6, 7, 11, 9]) for _ in range(draw.randint(0, 14)))
        want = best([conversations.FAULTS[c % 4] for c in codes], [conversations.LETTERS[c // 4] for c in codes])
        assert conversations.cheapest(codes) == want


def test_long_conversation(spark):
    draw = random.Random(8)
    rows = [(1, t, draw.choice(["user", "assistant", "user", "assistant", "system"]), draw.choice(["Yes.", "No", "", f"{t}!", f"{t}?"])) for t in range(3000)]
    assert found(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == expected(rows)
