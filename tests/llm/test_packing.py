import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docweave.llm import packing, text, queries


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(docs, got, tokenizer):
    texts = defaultdict(list)
    for i, text in docs.select("doc_id", "text").collect():
        texts[i].append(text or "")
    want = []
    for i, each in texts.items():
        for text in each:
            ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
            edges = [0, *range(len(ids) % 1024 or min(len(ids), 1024), len(ids) + 1, 1024)]
            want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    room = defaultdict(list)
    for r in got:
        room[r.sequence_id].append((r.offset, r.length))
    for placed in room.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    return len(room), -(-total // 1024)


def test_documents(documents, tokenizer):
    used, least = check(documents, queries.pack_documents(documents).collect(), tokenizer)
    assert used <= least * 1.02 + 1


def test_edges(spark, edge, empty, tokenizer):
    check(edge, queries.pack_documents(edge).collect(), tokenizer)
    assert queries.pack_documents(empty).count() == 0
    odd = spark.createDataFrame([(1, "a <|endoftext|> b  c  d  e 'll don't\n\n x"), (2, "\x85 　x é Š à y"), (3, "  lead  trail  "), (4, "€   á b")], "doc_id long, text string")
    check(odd, queries.pack_documents(odd).collect(), tokenizer)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits)[1]] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("kind, rows_a_task", [("even", 150), ("short", 100_000), ("half", 150)])
def test_rounds_fill_about_as_well_as_one_by_one(spark, kind, rows_a_task):
    from docweave.llm.text import staged

    rng = np.random.default_rng(5)
    lengths = {"even": rng.integers(1, 101, 800), "short": np.minimum(100, rng.geometric(0.1, 800)), "half": rng.integers(45, 56, 400)}[kind].tolist()
    rows = [(i, int(n)) for i, n in enumerate(lengths)]
    parts = staged(spark.createDataFrame(rows, "pid long, length long").repartition(3), "parts").withColumn("name", -F.col("pid"))
    got = packing.packed(parts, 100, rows_a_task).collect()
    room = defaultdict(list)
    for r in got:
        room[r.sequence_id].append((r.offset, r.length))
    assert sorted((-r.name, r.length) for r in got) == rows
    for placed in room.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 100
    assert len(room) <= best_fit_decreasing(lengths, 100) * 1.03 + 1


def test_a_slot_takes_the_largest_free_piece_below_it():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 400):
        rows = sorted(zip(rng.integers(1, 30, n).tolist(), (rng.random(n) < 0.5).tolist()))
        size, is_slot = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], bool)
        stack, pairs, slots = [], set(), []
        for i, (_, closes) in enumerate(rows):
            if not closes:
                stack.append(i)
            elif stack:
                pairs.add((stack.pop(), i))
            else:
                slots.append(i)
        piece, slot, slots_left, pieces_left = packing.matched(size, is_slot)
        assert set(zip(piece.tolist(), slot.tolist())) == pairs
        assert slots_left.tolist() == slots and pieces_left.tolist() == stack[::-1]
        # Cut into ranges and matched across them, the same slots and pieces are used.
        cuts = sorted(rng.integers(0, n + 1, 5).tolist())
        left, used = [], len(pairs)
        inner = 0
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, n])):
            p, _, s, o = packing.matched(size[a:b], is_slot[a:b])
            inner += len(p)
            left.append((part, len(s), len(o)))
        assert inner + sum(e - f for _, f, e, _, _ in packing.across(left)) == used


def test_chunks_with_one_hash_are_told_apart(spark, tokenizer, monkeypatch):
    pattern = "a"
    for _ in range(10):
        pattern += pattern.translate(str.maketrans("ab", "ba"))
    other = pattern.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"x {pattern} y"), (2, f"x {other} y"), (3, "one two"), (4, "six ten")], "doc_id long, text string")
    check(docs, queries.pack_documents(docs).collect(), tokenizer)
    path = public_tokenizers.path
    chunks = packing.Chunks(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    monkeypatch.setattr(packing, "word_hashes", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["one two three", "two one", "a bb ccc dddd eeeee", ""]
    buf, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    for _ in range(2):
        assert [x.tolist() for x in chunks.rows(buf, off)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_text_of_several_mb(spark, tokenizer):
    docs = spark.createDataFrame([(1, "word and other words " * 150_000 + "x" * 100_000), (2, "short")], "doc_id long, text string")
    check(docs, queries.pack_documents(docs).collect(), tokenizer)


def test_workers_give_back_what_they_freed(spark):
    """After a task that filled and freed many small pieces of memory, with one kept above them, the worker is small again."""

    def big(batches):
        held = [bytes(1000) for _ in range(200_000)]
        keep.append(bytes(1000))
        del held
        yield from batches

    keep, sizes = [], {}
    for name, run in (("plain", big), ("releasing", text.releasing(big))):
        list(run(iter([])))
        sizes[name] = int(open("/proc/self/statm").read().split()[1]) * 4 >> 10
    assert sizes["releasing"] < sizes["plain"] - 100, sizes
