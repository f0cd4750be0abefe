"""SimHash near-duplicates, found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A (23 bits), B (23 bits) and C (18
bits). The perfect binary Golay code assigns to a 23-bit segment every
codeword within distance 4 (one or six 12-bit indices); two segments that
differ in at most two bits share one of them. Pigeonhole over at most four
differing bits leaves three cases, each with an equi-join key:

* A and B differ in at most two bits each. Where C differs in at most two, one
  of its three parts of 6 bits is equal: (index of A, index of B, part of C);
  where C differs in three or more, A or B is equal and the other differs in at
  most one: (A itself, index of B) or (B itself, index of A);
* A differs in three or more, so B and C differ in at most one bit together:
  (B itself, a half of C), or (C itself, index of B);
* B differs in three or more: (A itself, a half of C), or (C, index of A).

Keys have 30 bits or more and a fingerprint has at most 136 of them, so a key of
n evenly spread distinct fingerprints holds about n * 36 / 2^30 of them: 34 at
10^9, 1,000 at 3 * 10^10.

Rows are distinct fingerprints, so copies never multiply. A key's run of
fingerprints is verified in the task that holds it while it is short; the
fingerprints of longer runs are linked through the points that lie within two
bits of both ends (2,081 rows a fingerprint, and at most as many in a point's
group), which is exact and linear however large a cluster is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .text import LOWER, NOT_SPACE, joined, meet, pieces, signed, staged, words

SHINGLE_WORDS = 4
MAX_BITS = 4
#: A key's run of at most so many fingerprints is compared pair by pair in its task.
SHORT_RUN = 1024
SEED = 42


def shingle_hashes(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each row's shingles, and each row's first shingle (one entry more than rows)."""
    low = LOWER[buf]
    starts, ends, first = words(low, off, NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    text, begin, end = joined(low, starts, ends, NOT_SPACE)
    count = np.diff(first)
    shingles = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    row_first = np.concatenate([[0], np.cumsum(shingles)])
    head = np.arange(row_first[-1]) + np.repeat(first[:-1] - row_first[:-1], shingles)
    tail = head + np.repeat(np.minimum(count, k) - 1, shingles)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[i:j], SEED) for i, j in zip(begin[head].tolist(), end[tail].tolist())), np.uint64, len(head)), row_first


def simhashes(h: np.ndarray, row_first: np.ndarray) -> np.ndarray:
    """One fingerprint a row: a bit is set where over half of the row's hashes have it."""
    count = np.diff(row_first)
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, row_first[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * sums > count[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of each row; null and wordless texts have fingerprint zero."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [simhashes(*shingle_hashes(buf, off)) for _, _, buf, off in pieces(batch.column(1), 1 << 19)]
            fp = np.concatenate(done) if done else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(fp))], ["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each bit, syndrome tables by byte, and the error pattern of each syndrome, for the (23, 12) code."""
    generator = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
    column = []
    for bit in range(23):
        rest = 1 << bit
        for at in range(22, 10, -1):
            if rest >> at & 1:
                rest ^= generator << (at - 11)
        column.append(rest)
    columns = np.array(column, np.int64)
    tables = np.zeros((3, 256), np.int64)
    for part in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and part * 8 + bit < 23:
                    tables[part, value] ^= columns[part * 8 + bit]
    error = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            error[np.bitwise_xor.reduce(columns[list(bits)])] = sum(1 << b for b in bits)
    return columns, tables, error


def golay_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 24) codeword indices within distance 4 of 23-bit x, and which of them are the first of their kind in the row."""
    columns, tables, error = golay()
    x = x.astype(np.int64)
    syndrome = tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16]
    flips = np.concatenate([[0], 1 << np.arange(23)])
    near = syndrome[:, None] ^ np.concatenate([[0], columns])
    index = np.sort((x[:, None] ^ flips ^ error[near]) >> 11, axis=1)
    fresh = np.ones(index.shape, bool)
    fresh[:, 1:] = index[:, 1:] != index[:, :-1]
    return index, fresh


def candidate_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, key): the rows by which fingerprints that differ in at most four bits meet."""
    f = fp.view(np.uint64)
    a = (f & np.uint64(0x7FFFFF)).astype(np.int64)
    b = (f >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (f >> np.uint64(46)).astype(np.int64)
    (ia, fa), (ib, fb) = golay_keys(a), golay_keys(b)
    ra, ka = np.nonzero(fa)[0], ia[fa]
    rb, kb = np.nonzero(fb)[0], ib[fb]
    na, nb = np.bincount(ra, minlength=len(f)), np.bincount(rb, minlength=len(f))
    # Every index of A with every index of B of the same fingerprint.
    reach = nb[ra]
    left = np.repeat(np.arange(len(ra)), reach)
    right = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach) + (np.cumsum(nb) - nb)[ra[left]]
    every = np.arange(len(f))
    both, of = ka[left] << 18 | kb[right] << 6, ra[left]
    thirds = [(of, both | c[of] >> shift & 63) for shift in (0, 6, 12)]
    halves = [(every, x << 9 | c >> shift & 511) for x in (a, b) for shift in (0, 9)]
    found = [*thirds, (rb, a[rb] << 12 | kb), (ra, b[ra] << 12 | ka), *halves, (rb, c[rb] << 12 | kb), (ra, c[ra] << 12 | ka)]
    return np.concatenate([row for row, _ in found]), np.concatenate([key | n << 40 for n, (_, key) in enumerate(found, 1)])


def _roots(run: np.ndarray) -> np.ndarray:
    """(r, n) fingerprints of r runs: for each the least place in its run that chains of links reach."""
    near = np.bitwise_count((run[:, :, None] ^ run[:, None, :]).view(np.uint64)) <= MAX_BITS
    n = run.shape[1]
    root = np.broadcast_to(np.arange(n), run.shape)
    while True:
        least = np.where(near, root[:, None, :], n).min(axis=2)
        least = np.take_along_axis(least, least, axis=1)
        if np.array_equal(least, root):
            return root
        root = least


def _verify_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key: links within short runs as (a, b), members of long runs as (a, null)."""

    def emit(a, b, long_run):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, long_run])), pa.array(np.concatenate([b, long_run]), mask=np.r_[np.zeros(len(b), bool), np.ones(len(long_run), bool)])], ["a", "b"])

    def settle(key, fp):
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[edge, len(key)])
        links, over = [np.zeros((0, 2), np.int64)], [fp[s : s + n] for s, n in zip(edge[size > SHORT_RUN], size[size > SHORT_RUN])]
        for n in np.unique(size[(size > 1) & (size <= SHORT_RUN)]):
            for begin in np.array_split(edge[size == n], max(1, (size == n).sum() * n * n // 2_000_000)):
                run = fp[begin[:, None] + np.arange(n)]
                root = _roots(run)
                which, place = np.nonzero(root != np.arange(n))
                links.append(np.stack([run[which, place], run[which, root[which, place]]], axis=1))
        links = np.concatenate(links)
        return emit(links[:, 0], links[:, 1], np.concatenate(over) if over else np.zeros(0, np.int64))

    key = fp = np.zeros(0, np.int64)
    hot = None  # the key of a run that is known to be long; its members go out as they come
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
        if hot is not None:
            cut = int(np.searchsorted(key, hot, "right"))
            yield emit(np.zeros(0, np.int64), np.zeros(0, np.int64), fp[:cut])
            key, fp = key[cut:], fp[cut:]
            hot = hot if not len(key) else None
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield settle(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
        if len(key) > SHORT_RUN:
            hot = int(key[0])
            yield emit(np.zeros(0, np.int64), np.zeros(0, np.int64), fp)
            key = fp = np.zeros(0, np.int64)
    if len(key):
        yield settle(key, fp)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs that span every group of distinct fingerprints `fp` that chains of MAX_BITS or fewer differing bits connect."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(fp), 2048):
                part = np.ascontiguousarray(fp[lo : lo + 2048])
                row, key = candidate_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])

    runs = distinct.select("fp").mapInArrow(keys, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = staged(runs.mapInArrow(_verify_runs, "a long, b long"), "links")
    short = found.filter("b is not null")
    masks = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))]
    ball = F.split(F.lit(",".join(str(m - (1 << 64) if m >> 63 else m) for m in masks)), ",").cast("array<bigint>")
    members = found.filter("b is null").select("a").distinct()
    points = members.select("a", F.explode(ball).alias("mask")).select(F.col("a").bitwiseXOR(F.col("mask")).alias("point"), "a")
    nearest = points.groupBy("point").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1")
    # Spark takes the exploded rows for as few as the members and would broadcast them.
    far = points.hint("merge").join(nearest.hint("merge"), "point").filter("a != b").select("a", "b").distinct()
    return short.unionByName(far).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Null, empty and wordless texts all have fingerprint zero and are linked
    like any others; an empty table gives an empty table; rows with equal ids
    each get a row and are not linked by their id. A row without id takes part
    in links; component_id is null only if none of its component has an id.
    Only the two named columns are read.
    """
    marked = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    groups = connected_components(links(nodes))
    named = nodes.join(groups, nodes["fp"] == groups["id"], "left").select("fp", "least", "copies", "component")
    least = named.filter("component is not null").groupBy("component").agg(F.min("least").alias("of_all"))
    classes = named.join(least, "component", "left").select("fp", "copies", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("of_all")).alias("component_id"))
    met = meet(marked, staged(classes, "classes"), ["fp"], "copies", ["doc_id"])
    return met.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
