"""SimHash near-duplicates by five-word shingles and a verified similarity of 0.8, found through soft Golay decoding.

A document is its set of distinct 5-word shingles. Its fingerprint has SEGMENTS
segments of 23 bits, each bit the side of a hyperplane that the set's sum lies
on, and how far it lies from the plane is kept while the keys are made. At a
similarity of 0.8 about 15 % of the bits differ, so no segment can be asked to
stay within a few of them. The bits that differ are mostly those near their
plane, though: of the codewords within distance 4 of a segment (one or six),
those come first whose corrections are the least sure bits.

Two neighbouring segments make a pair, and a key is a pair with a codeword index
for each half. A document has the KEYS cheapest keys of all its pairs, so a text
with doubtful bits in one place uses more keys there. Pigeonhole over the pairs:
two documents meet if in one of PAIRS pairs the errors are such that both list
the same two codewords. By simulation of the bits, 95 % of the documents at a
similarity of 0.8 meet directly and 99 % at 0.85; in a group, one link suffices.

A key of n evenly spread sets holds about n * 5 / 2^24 of them, 300 at 10^9.
Within a key FILTER_BITS bits of the fingerprints are compared, and what is near
enough is confirmed on the full sets. Runs of a key with more than RUN rows are
compared in overlapping blocks of RUN rows, in the order of the fingerprints. A
run with more near pairs than rows (and than CROWD) is crowded: there a row
offers the row with the most neighbours or, if that is too far, its nearest at
first, so a run gives about a pair a row at most. Once these are confirmed and
grouped, all other pairs of such runs, of long ones and of those that lie on a
task's edge that no chain of links connects are compared (rest()), by WIDE_BITS
more bits, each pair under the least key that it shares, and what is near enough
by both counts is confirmed too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .simhash import golay
from .text import may_be_in, mixed, pieces, releasing, signed, staged

#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
PAIRS, KEYS = 16, 80
SEGMENTS = 2 * PAIRS
#: Codewords listed for a segment.
LISTED = 4
#: Shingles are counted, with a sign, in so many cells before they are projected on the hyperplanes.
CELLS = 1024
#: Bits compared before sets are, and how many may differ: at a similarity of 0.8, 19.3 on average and 4 standard deviations more.
FILTER_BITS, MAX_DIFFER = 128, 36
#: Bits compared besides where all pairs of a crowd are, and how many of all bits may differ then: 107 on average at a similarity of
#: 0.8 and 4 standard deviations more.
WIDE_BITS, MAX_WIDE = 576, 147
RUN, CROWD = 1024, 16
_ROWS = 256
_EMPTY = xxhash.xxh3_128_digest(b"")


def planes() -> np.ndarray:
    """(CELLS, SEGMENTS * 23) odd numbers of one byte, the same everywhere."""
    width = SEGMENTS * 23
    raw = mixed(np.arange(1, CELLS * width // 8 + 1, dtype=np.uint64)).astype("<u8").view(np.uint8)
    return (2.0 * raw - 255).reshape(CELLS, width)


def margins(h: np.ndarray, first: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """(rows, SEGMENTS * 23): on which side of each hyperplane the row's set lies, and how far. Whole numbers, so exact."""
    rows = len(first) - 1
    of = np.repeat(np.arange(rows), np.diff(first))
    spread = mixed(h * np.uint64(0x9E3779B97F4A7C15))
    cell, sign = (spread & np.uint64(CELLS - 1)).astype(np.int64), np.where(spread >> np.uint64(63), 1.0, -1.0)
    return np.bincount(of * CELLS + cell, sign, rows * CELLS).reshape(rows, CELLS) @ plane


def decoded(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, LISTED) codeword indices of 23-bit segments and their costs, the sum of the margins of the bits they correct; cost
    is infinite where a segment has fewer codewords within distance 4."""
    columns, tables, error = golay()
    x = ((margin > 0) << np.arange(23)).sum(axis=1)
    syndrome = tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16]
    flips = np.concatenate([[0], 1 << np.arange(23)])
    wrong = np.sort(flips ^ error[syndrome[:, None] ^ np.concatenate([[0], columns])], axis=1)
    none = 1 << 23
    wrong[:, 1:][wrong[:, 1:] == wrong[:, :-1]] = none
    wrong = np.sort(wrong, axis=1)[:, :6].astype("<u4")
    bits = np.unpackbits(wrong.view(np.uint8).reshape(len(x), 6, 4), axis=2, bitorder="little")[:, :, :23]
    cost = np.matmul(bits.astype(np.float64), np.abs(margin)[:, :, None])[:, :, 0]
    cost[wrong == none] = np.inf
    order = np.argsort(cost, axis=1, kind="stable")[:, :LISTED]
    return (x[:, None] ^ np.take_along_axis(wrong.astype(np.int64), order, 1)) >> 11, np.take_along_axis(cost, order, 1)


def keys(margin: np.ndarray) -> np.ndarray:
    """(rows, KEYS) keys of each row, -1 where it has fewer."""
    n = len(margin)
    index, cost = decoded(margin.reshape(n * SEGMENTS, 23))
    index, cost = index.reshape(n, PAIRS, 2, LISTED), cost.reshape(n, PAIRS, 2, LISTED)
    key = np.arange(PAIRS)[:, None, None] << 24 | index[:, :, 0, :, None] << 12 | index[:, :, 1, None, :]
    total = (cost[:, :, 0, :, None] + cost[:, :, 1, None, :]).reshape(n, -1)
    best = np.argpartition(total, KEYS, axis=1)[:, :KEYS]
    return np.where(np.isfinite(np.take_along_axis(total, best, 1)), np.take_along_axis(key.reshape(n, -1), best, 1), -1)


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, sig) of (doc_id, text): the size and name of each row's set, and its keys between FILTER_BITS and
    WIDE_BITS of its fingerprint. The empty set has a name and no sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = planes()
        for batch in batches:
            sizes, names, sigs = [], [], []
            for _, _, buf, off in pieces(batch.column(1), 1 << 19):
                h, first = minhash.shingle_sets(buf, off)
                sizes.append(np.diff(first))
                names += [name or _EMPTY for name in minhash.set_names(h, first)]
                for lo in range(0, len(first) - 1, _ROWS):
                    part = first[lo : lo + _ROWS + 1]
                    margin = margins(h[part[0] : part[-1]], part - part[0], plane)
                    bits = np.packbits(margin[:, : FILTER_BITS + WIDE_BITS] > 0, axis=1)
                    few = FILTER_BITS // 8
                    sigs += [f[:few].tobytes() + k.tobytes() + f[few:].tobytes() if some else None for f, k, some in zip(bits, keys(margin).astype("<i4"), np.diff(part) > 0)]
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(names, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n", "key", "sig"])

    return docs.mapInArrow(releasing(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, key binary, sig binary")


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (key, sig) to a row for each of their keys: (at, f1, f2, k1, k2), the halves of FILTER_BITS and of the node's name."""
    width = FILTER_BITS // 8
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            name, sig = (np.frombuffer(b"".join(batch.column(c).slice(lo, 4096).to_pylist()), np.uint8) for c in (0, 1))
            sig = sig.reshape(len(name) // 16, -1)
            at = np.ascontiguousarray(sig[:, width : width + 4 * KEYS]).view("<i4")
            row, place = np.nonzero(at >= 0)
            halves = [x[row] for side in (np.ascontiguousarray(sig[:, :width]), name.reshape(-1, 16)) for x in side.view("<i8").T]
            yield pa.RecordBatch.from_arrays([pa.array(at[row, place]), *map(pa.array, halves)], ["at", "f1", "f2", "k1", "k2"])


def _near_in_runs(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(r, n, 2) fingerprints of r runs to pairs (run, i, j, differing bits) that are near enough, and whether each run is
    crowded: then it gives a pair a row at most."""
    r, n, _ = f.shape
    differ = np.zeros((r, n, n), np.int64)
    for half in range(2):
        differ += np.bitwise_count((f[:, :, None, half] ^ f[:, None, :, half]).view(np.uint64))
    differ[:, np.arange(n), np.arange(n)] = FILTER_BITS + 1
    near = differ <= MAX_DIFFER
    crowded = near.sum(axis=(1, 2)) > 2 * max(CROWD, n)
    run, i, j = np.nonzero(np.triu(near) & ~crowded[:, None, None])
    if crowded.any():
        some = np.flatnonzero(crowded)
        near, far = near[some], differ[some]
        hub = near.sum(axis=2).argmax(axis=1)
        other = np.where(near[np.arange(len(some)), hub], hub[:, None], far.argmin(axis=2))
        of, row = np.nonzero(np.take_along_axis(near, other[:, :, None], 2)[:, :, 0])
        run, i, j = np.r_[run, some[of]], np.r_[i, row], np.r_[j, other[of, row]]
    return run, i, j, differ[run, i, j], crowded


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (at, f1, f2, k1, k2) in order to pairs (a, b, agree, null), and (null, null, null, at) for each run of which not all
    pairs were offered: those over RUN or crowded, and the first and last of a task, which others may hold the rest of. One run
    of at most RUN rows is held beside a batch."""

    def partial(found: np.ndarray) -> pa.RecordBatch:
        none = lambda kind: pa.nulls(len(found), kind)
        return pa.RecordBatch.from_arrays([none(pa.binary()), none(pa.binary()), none(pa.int32()), pa.array(found.astype(np.int32))], ["a", "b", "agree", "at"])

    def settle(at: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        size = np.diff(np.r_[edge, len(at)])
        yield partial(at[edge[size > RUN]])
        # A run's blocks overlap by half.
        long = [(s + d, min(RUN, n - d)) for s, n in zip(edge[size > RUN].tolist(), size[size > RUN].tolist()) for d in range(0, n - RUN // 2, RUN // 2)]
        begin = np.concatenate([edge[size <= RUN], np.array([s for s, _ in long], np.int64)])
        size = np.concatenate([size[size <= RUN], np.array([n for _, n in long], np.int64)])
        for n in np.unique(size[size > 1]):
            some = begin[size == n]
            for part in np.array_split(some, max(1, len(some) * n * n // 2_000_000)):
                if len(part):
                    rows = data[part[:, None] + np.arange(n)]
                    run, i, j, differ, crowded = _near_in_runs(rows[:, :, :2])
                    yield partial(at[part[crowded]])
                    ends = [np.ascontiguousarray(rows[run, x, 2:]).tobytes() for x in (i, j)]
                    names = [[e[p : p + 16] for p in range(0, len(e), 16)] for e in ends]
                    both = sorted({(min(a, b), max(a, b), d) for a, b, d in zip(*names, differ.tolist())})
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in both], pa.binary()), pa.array([x[1] for x in both], pa.binary()), pa.array([FILTER_BITS - x[2] for x in both], pa.int32()), pa.nulls(len(both), pa.int32())], ["a", "b", "agree", "at"])

    last = None
    at, data = np.zeros(0, np.int32), np.zeros((0, 4), np.int64)
    for batch in batches:
        if batch.num_rows:
            ends = batch.column(0).to_numpy(zero_copy_only=False)[[0, -1]]
            if last is None:
                yield partial(ends[:1])
            last = ends[1:]
        at = np.concatenate([at, batch.column(0).to_numpy(zero_copy_only=False)])
        data = np.concatenate([data, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(1, 5)], axis=1)])
        if not len(at):
            continue
        cut = int(np.searchsorted(at, at[-1], "left"))
        yield from settle(at[:cut], data[:cut])
        at, data = at[cut:], data[cut:]
        if len(at) > 2 * RUN:
            yield from settle(at, data)
            at, data = at[-RUN // 2 :], data[-RUN // 2 :]
    yield from settle(at, data)
    if last is not None:
        yield partial(last)


def _keyed(nodes: DataFrame) -> DataFrame:
    return nodes.filter("sig is not null").select("key", "sig").mapInArrow(_key_rows, "at int, f1 long, f2 long, k1 long, k2 long")


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b, agree), (at)): pairs of nodes (key, sig) that share a key and differ in few enough of FILTER_BITS, each once, and
    the keys that not all pairs were offered of."""
    # A key's rows lie together in the order of their fingerprints; the range of a crowded key may span tasks.
    found = _keyed(nodes).repartitionByRange("at", "f1").sortWithinPartitions("at", "f1", "f2").mapInArrow(_candidates, "a binary, b binary, agree int, at int")
    found = staged(found, "found")
    return staged(found.filter("a is not null").groupBy("a", "b").agg(F.max("agree").alias("agree")), "candidates"), found.filter("a is null").select("at").distinct()


def rest(nodes: DataFrame, groups: DataFrame, crowded: DataFrame) -> DataFrame:
    """(a, b), each once: all pairs of nodes (key, sig) that share one of the keys `crowded` (at), differ in few enough bits and
    are not in one of groups (key, component). A run is dealt to tasks in parts of RUN rows that meet the whole run. Nodes
    whose sig ends with its keys are compared by FILTER_BITS alone."""
    crowded = staged(crowded, "crowded")
    hashed = lambda df: df.withColumn("__h", F.xxhash64("at"))
    few = may_be_in(hashed(_keyed(nodes)), hashed(crowded), "__h").filter("__may").drop("__may", "__h").join(crowded, "at", "left_semi")
    wide = [f"w{i}" for i in range(WIDE_BITS // 64)]
    halves = nodes.filter("sig is not null").select("key", "sig").mapInArrow(_halved, "key binary, k1 long, k2 long, " + ", ".join(f"{w} long" for w in wide))
    named = halves.join(groups, "key", "left").select("k1", "k2", "key", *wide, F.coalesce(F.col("component").cast("string"), F.hex("key")).alias("of"))
    rows = staged(few.join(named, ["k1", "k2"]).select("at", "f1", "f2", *wide, "key", "of"), "crowd")
    # A run that lies in one group has nothing to compare.
    sizes = rows.groupBy("at").agg(F.count("*").alias("n"), F.min("of").alias("x"), F.max("of").alias("y")).filter("x != y")
    parts = F.ceil(F.col("n") / RUN).cast("int")
    open_ = staged(rows.join(sizes.select("at", parts.alias("parts")), "at"), "open")
    # Two rows of different groups keep all keys that they share open, so the least of these is among the `ats` of both.
    held = open_.groupBy("key").agg(F.collect_list("at").alias("ats"))
    open_, columns = open_.join(held, "key"), ("f1", "f2", *wide, "key", "of", "ats")
    one = open_.select("at", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), *(F.col(c).alias(f"{c}_a") for c in columns))
    two = open_.select("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"{c}_b") for c in columns))
    differ = lambda names: sum(F.bit_count(F.col(f"{f}_a").bitwiseXOR(F.col(f"{f}_b"))) for f in names)
    near = (differ(("f1", "f2")) <= MAX_DIFFER) & (differ(("f1", "f2", *wide)) <= MAX_WIDE)
    least = F.array_min(F.array_intersect("ats_a", "ats_b")) == F.col("at")
    met = one.join(two, ["at", "part"]).filter((F.col("key_a") < F.col("key_b")) & (F.col("of_a") != F.col("of_b")) & near & least)
    return met.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (key, sig) to the halves of their names and the wide bits behind their keys, zeros where there are none."""
    begin = FILTER_BITS // 8 + 4 * KEYS
    for batch in batches:
        both = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, 2)
        wide = np.frombuffer(b"".join(s[begin:].ljust(WIDE_BITS // 8, b"\0") for s in batch.column(1).to_pylist()), "<i8").reshape(len(both), -1)
        columns = [pa.array(np.ascontiguousarray(c)) for c in (*both.T, *wide.T)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "k1", "k2", *(f"w{i}" for i in range(WIDE_BITS // 64))])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Texts of fewer than five words are one shingle, their whole sequence. Null,
    empty and wordless texts are a group of their own. Rows with equal sets are
    linked whatever their ids; rows that repeat an id each get a row and are not
    linked by it; a row without id takes part in links. A very long text is read
    whole; an empty table gives no rows. Only the two named columns are read.
    """
    crowded = []

    def find(nodes: DataFrame) -> DataFrame:
        found, keys = candidates(nodes)
        crowded.append(keys)
        return found

    return minhash.near_duplicates(docs, id_col, text_col, marked, find, PERCENT, lambda nodes, groups: rest(nodes, groups, crowded[0]))
