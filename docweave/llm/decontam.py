"""Benchmark decontamination by Wu-Manber search over words.

Test strings are the runs of `window` consecutive words of a benchmark item (an
item with fewer words is one string). For each length m a shift table, keyed by
the hash of a block of two words, says how many words the end of the search
window may move; positions that no string can end at are skipped. Where the
shift is zero, the hash of the last m words selects the strings that may end
there, and their words are compared byte by byte. All stretches of a slice of
documents are searched in step, so a step is a few array operations.

The benchmark is the query set: it is read in blocks of at most BLOCK_STRINGS
strings, each block is broadcast (its size is bounded) and searched in a pass
of its own over all documents, without a shuffle.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ALNUM, LOWER, fresh, pieces, releasing, sequence_hash, word_hashes, words

WINDOW = 10
BLOCK_STRINGS = 200_000
_STRETCH = 64
_SHIFT_BITS = 20


def _strings(text: str | None, window: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each test string of an item: its words joined by a space, and their hashes."""
    buf = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = words(buf, np.array([0, len(buf)]), ALNUM)
    if len(starts):
        h, raw = word_hashes(buf, starts, ends), buf.tobytes()
        each = [raw[i:j] for i, j in zip(starts, ends)]
        m = min(window, len(each))
        for i in range(len(each) - m + 1):
            yield b" ".join(each[i : i + m]), h[i : i + m]


def _table(strings: dict[bytes, tuple[np.ndarray, set[str]]]) -> list[tuple]:
    """For each length: (m, words in a block, shift table, sorted hashes of whole strings, their strings and items)."""
    by_length = defaultdict(list)
    for text, (h, items) in strings.items():
        by_length[len(h)].append((text, h, sorted(items)))
    out = []
    for m, found in sorted(by_length.items()):
        block = min(2, m)
        shift = np.full(1 << _SHIFT_BITS, m - block + 1, np.uint8)
        hashes = np.stack([h for _, h, _ in found])
        for end in range(block - 1, m):
            key = sequence_hash(hashes[:, end - block + 1 : end + 1].ravel(), block)[::block]
            np.minimum.at(shift, (key & np.uint64((1 << _SHIFT_BITS) - 1)).astype(np.int64), m - 1 - end)
        whole = sequence_hash(hashes.ravel(), m)[::m]
        bucket = defaultdict(list)
        for key, (text, _, items) in zip(whole.tolist(), found):
            bucket[key].append((text, items))
        out.append((m, block, shift, np.sort(whole), dict(bucket)))
    return out


def _blocks(benchmark: DataFrame, window: int, limit: int) -> Iterator[list[tuple]]:
    strings: dict[bytes, tuple[np.ndarray, set[str]]] = {}
    for item, text in benchmark.toLocalIterator():
        for key, h in _strings(text, window):
            strings.setdefault(key, (h, set()))[1].add(str(item))
            if len(strings) >= limit:  # also amid a long item
                yield _table(strings)
                strings = {}
    if strings:
        yield _table(strings)


def _search(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, h: np.ndarray, table: list[tuple]) -> list[tuple[int, int, list[str]]]:
    """(first word, length, items) of each occurrence in a slice."""
    found = []
    for m, block, shift, whole, bucket in table:
        lo, hi = first[:-1] + m - 1, first[1:]
        lanes = np.maximum(0, -(-(hi - lo) // _STRETCH))
        if not lanes.sum():
            continue
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(lo, lanes) + nth * _STRETCH
        stop = np.minimum(at + _STRETCH, np.repeat(hi, lanes))
        move = shift[(sequence_hash(h, block) & np.uint64((1 << _SHIFT_BITS) - 1)).astype(np.int64)]
        hits = []
        while len(at):
            step = move[at - block + 1]
            hits.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        ends_at = np.concatenate(hits)
        key = sequence_hash(h, m)[ends_at - m + 1]
        place = np.minimum(np.searchsorted(whole, key), len(whole) - 1)
        for end, k in zip(ends_at[whole[place] == key].tolist(), key[whole[place] == key].tolist()):
            head = end - m + 1
            text = b" ".join(buf[starts[i] : ends[i]].tobytes() for i in range(head, end + 1))
            found += [(head, m, items) for string, items in bucket[k] if string == text]
    return found


def _scanner(table, kept: int, with_hits: bool):
    """Adds to each row of (columns..., text, n_words, ranges, items) what one block's strings hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pickle.loads(table.value) if table is not None else []
        for batch in batches:
            texts = batch.column(kept)
            n_words = np.zeros(len(texts), np.int64)
            ranges: list[list] = batch.column(kept + 2).to_pylist() if with_hits else [[] for _ in range(len(texts))]
            items: list[list] = batch.column(kept + 3).to_pylist() if with_hits else [[] for _ in range(len(texts))]
            for lo, hi, buf, off in pieces(texts):
                low = LOWER[buf]
                starts, ends, first = words(low, off, ALNUM)
                n_words[lo:hi] = np.diff(first)
                for head, m, names in _search(low, starts, ends, first, word_hashes(low, starts, ends), strings) if len(starts) else ():
                    row = int(np.searchsorted(first, head, "right")) - 1
                    ranges[lo + row].append(int(head - first[row]) << 16 | m)
                    items[lo + row] += names
            for row, more in enumerate(ranges):
                if more:
                    items[row] = sorted(set(items[row]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: kept + 1], pa.array(n_words), pa.array(ranges, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], [str(i) for i in range(kept + 4)])

    return run


def occurrences(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_strings: int = BLOCK_STRINGS) -> DataFrame:
    """docs with n_words, ranges (array of first word << 16 | words, one for each occurrence) and items (sorted distinct ids) added.

    Null texts have no words. Columns of docs that bear the added names are
    dropped. An empty benchmark, or one without words, hits nothing; repeated
    items and strings shared by items each count for every item; a very long
    text is searched whole, in one task.
    """
    spark = docs.sparkSession
    added = ["n_words", "ranges", "items"]
    columns = [c for c in docs.columns if c not in added]
    kept, work = len(columns), fresh("__text", columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema) + f", `{work}` string, n_words long, ranges array<long>, items array<string>"
    now = docs.select(*columns, F.col(text_col).cast("string").alias(work))
    any_block = False
    for table in _blocks(benchmark.select(item_col, item_text_col), window, block_strings):
        now = now.mapInArrow(releasing(_scanner(spark.sparkContext.broadcast(pickle.dumps(table)), kept, any_block)), schema)
        any_block = True
    if not any_block:
        now = now.mapInArrow(_scanner(None, kept, False), schema)
    return now.drop(work)


def _covered(ranges: list[int]) -> int:
    """Words that lie in at least one of the ranges."""
    total, reach = 0, -1
    for x in sorted(ranges):
        head, end = x >> 16, (x >> 16) + (x & 0xFFFF)
        total += max(0, end - max(head, reach))
        reach = max(reach, end)
    return total


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each document."""
    found = occurrences(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", "ranges", "items")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(3).to_pylist()
            hit = [_covered(r) if r else 0 for r in batch.column(2).to_pylist()]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array([n > 0 for n in hit])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text holds no test string, with their columns, whatever their names; rows without text stay."""
    clash = {"n_words", "ranges", "items"} & set(docs.columns)
    own = {c: fresh(f"__own_{c}", docs.columns) for c in clash}
    clean = occurrences(docs.withColumnsRenamed(own), benchmark, own.get(text_col, text_col)).filter(F.size("ranges") == 0).drop("n_words", "ranges", "items")
    return clean.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
