"""Repeated byte strings from a sparse enhanced suffix array and its common-prefix interval tree.

Suffixes are sampled: of each run of bytes that could be a repeated string of
`min_length` bytes, the suffix that begins at the 96-gram with the smallest hash
is taken, so equal strings hold sampled suffixes at equal places (about one
suffix in 150 bytes). Suffixes whose 96-gram occurs once are dropped. A suffix
is bounded by its context: what a string of min_length bytes around it can
reach on the left and on the right.

The contexts of one 96-gram, sorted by their right side, are a piece of the
suffix array. A stack scan over the common prefixes of neighbours yields the
intervals of the common-prefix tree from the deepest up. Where an interval joins
its children, suffixes of different children are held against each other in the
order of their left sides: where left extensions differ, the pair bounds a
maximal repeat, whose occurrences are all suffixes of the interval that share
the left extension. The smaller child is merged into the larger one, so n
suffixes cost n log n comparisons, not n squared.

Equal contexts are one class with a count, however many occurrences it has, and
the bytes of a class are fetched once, and only where a gram has several. A
96-gram with more than LARGE different contexts is not scanned in one task: its
contexts are cut into their strings of min_length bytes, which are counted.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import blocks, minimizers, mixed, pieces, sequence_hash, signed, staged, text_id, wide_hashes

MIN_LENGTH = 400
GRAM = 96
#: Contexts of one gram that are scanned in one task: 35 MB of them.
LARGE = 50_000


def _ends(off: np.ndarray) -> np.ndarray:
    return np.repeat(off[1:], np.diff(off))


def _grams(buf: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM bytes."""
    return sequence_hash(mixed(blocks(buf)[: len(buf) - 7]), GRAM // 8, step=8)


def _samples(string: bytes, min_length: int) -> set[int]:
    """Where suffixes are sampled in every occurrence of the string, whatever stands around it."""
    buf = np.frombuffer(string, np.uint8)
    h = _grams(buf)
    return set(minimizers(h, min_length - GRAM + 1, np.ones(len(h), bool)).tolist())


def _bounds(off: np.ndarray, row: np.ndarray, at: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the contexts of suffixes at `at`."""
    return np.maximum(off[row], at - (min_length - GRAM)), np.minimum(off[row + 1], at + min_length)


def _sampled(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, buf, off in pieces(batch.column(2), 1 << 19):
                if len(buf) < min_length:
                    continue
                h = _grams(buf)
                at = minimizers(h, min_length - GRAM + 1, np.arange(len(buf)) + min_length <= _ends(off))
                row = np.searchsorted(off, at, "right") - 1
                a, b = _bounds(off, row, at, min_length)
                c1, c2 = wide_hashes(buf.tobytes(), a, b, at - a).T
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[at])), pa.array(signed(c1)), pa.array(signed(c2)), pa.array(t1[lo:hi][row]), pa.array(t2[lo:hi][row]), pa.array((at - off[row]).astype(np.int32)), pa.array((at - a).astype(np.int32)), pa.array((b - at).astype(np.int32))], ["h", "c1", "c2", "t1", "t2", "p", "l", "r"])

    return run


def _contexts(min_length: int):
    """(text, classes (h, c1, c2, n, p)): each class with the bytes left and right of its suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1)
            bounds, field = wanted.offsets.to_numpy(), wanted.values.field
            h, c1, c2, n, place = (field(k) for k in range(5))
            place = place.to_numpy()
            for lo, hi, buf, off in pieces(batch.column(0), 1 << 19):
                raw = buf.tobytes()
                each = np.arange(bounds[lo], bounds[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
                at = off[row] + place[each]
                real = at + GRAM <= off[row + 1]
                each, row, at = pa.array(each[real]), row[real], at[real]
                a, b = _bounds(off, row, at, min_length)
                cuts = lambda i, j: pa.array([raw[x:y] for x, y in zip(i.tolist(), j.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(x.take(each) for x in (h, c1, c2, n)), cuts(a, at), cuts(at, b)], ["h", "c1", "c2", "n", "left", "right"])

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def interval_scan(lefts: list[bytes], rights: list[bytes], counts: list[int], min_length: int, groups: list | None = None) -> list[tuple[int, int]]:
    """(left, right) reach of the repeated strings around each suffix; (0, 0) if there is none.

    rights are in order; lefts are the left contexts read backwards; (left,
    right) are distinct, counts say how often each occurs. A string is repeated
    if it is at least min_length long and occurs twice. groups gets (left,
    right, members) of each maximal repeat.
    """
    n = len(rights)
    order = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for place, i in enumerate(order):
        rank[i] = place
    reach = [(0, 0)] * n

    def note(i: int, left: int, right: int) -> None:
        reach[i] = max(reach[i][0], left), max(reach[i][1], right)

    def merged(one: list[int], two: list[int], depth: int, found: list[tuple[int, int]]) -> list[int]:
        """Joins two children (ranks in order) of an interval of common prefix `depth`, testing left extensions."""
        large, small = (one, two) if len(one) >= len(two) else (two, one)
        least = max(0, min_length - depth)
        for r in small:
            at = bisect_left(large, r)
            for near in (at - 1, at):
                if 0 <= near < len(large):
                    i, j = order[r], order[large[near]]
                    left = _common(lefts[i], lefts[j])
                    if left >= least:
                        note(i, left, depth)
                        note(j, left, depth)
                        if groups is not None:
                            found.append((i, left))
        return sorted(large + small)  # two sorted runs: linear

    def expand(members: list[int], depth: int, found: list[tuple[int, int]]) -> None:
        """All suffixes of a complete interval that share the left extension of a pair."""
        for i, left in dict.fromkeys(found):
            a = b = bisect_left(members, rank[i])
            while a and _common(lefts[order[members[a - 1]]], lefts[i]) >= left:
                a -= 1
            while b + 1 < len(members) and _common(lefts[order[members[b + 1]]], lefts[i]) >= left:
                b += 1
            groups.append((left, depth, [order[r] for r in members[a : b + 1]]))

    for i in range(n):
        if counts[i] > 1 and len(lefts[i]) + len(rights[i]) >= min_length:
            note(i, len(lefts[i]), len(rights[i]))
            if groups is not None:
                groups.append((len(lefts[i]), len(rights[i]), [i]))
    # Open intervals: common prefix, members so far, pairs that bound maximal repeats.
    stack: list[tuple[int, list[int], list[tuple[int, int]]]] = []
    for i in range(n):
        depth = _common(rights[i], rights[i + 1]) if i + 1 < n else 0
        members, found = [rank[i]], []
        while stack and stack[-1][0] > depth:
            joint, before, found = stack.pop()
            members = merged(before, members, joint, found)
            expand(members, joint, found)
            found = []
        if stack and stack[-1][0] == depth and depth:
            _, before, found = stack.pop()
            members = merged(before, members, depth, found)
        stack.append((depth, members, found))
    return reach


def _scan(min_length: int, with_groups: bool):
    """Batches sorted by (h, right, left), equal rows (of a repeated document) as one: the reach of each class, or a mark that its gram has too many classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]):
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["h", "c1", "c2", "l", "r", "repeats"])

        def settle(group: list[tuple]) -> list[tuple]:
            groups: list | None = [] if with_groups else None
            lefts, rights = [g[4][::-1] for g in group], [g[5] for g in group]
            reach = interval_scan(lefts, rights, [g[3] for g in group], min_length, groups)
            names: list[list[str]] = [[] for _ in group]
            for left, right, members in groups or ():
                string = lefts[members[0]][:left][::-1] + rights[members[0]][:right]
                if left not in _samples(string, min_length):
                    continue  # not sampled in all occurrences; the suffix that is reports the string
                digest = hashlib.sha256(string).hexdigest()
                for m in members:
                    names[m].append(f"{digest}:{left}:{right}")
            return [(g[0], g[1], g[2], l, r, sorted(set(x))) for g, (l, r), x in zip(group, reach, names) if l + r]

        now, group, large = None, [], False
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now:
                    out += [] if large else settle(group)
                    now, group, large = row[0], [], False
                if group and group[-1][1:3] == row[1:3]:
                    continue
                group.append(row)
                if len(group) > LARGE or large:
                    out += [(g[0], g[1], g[2], -1, -1, []) for g in group]
                    group, large = [], True
            yield emit(out)
        yield emit([] if large else settle(group))

    return run


def _strings(min_length: int):
    """Every string of min_length bytes of each context: (k1, k2, h, c1, c2, n, l, r)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c1, c2, n, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                buf = np.frombuffer(left + right, np.uint8)
                at = np.arange(len(buf) - min_length + 1)
                each = mixed(buf.astype(np.uint64) + np.uint64(1))
                k1, k2 = sequence_hash(each, min_length, 1), sequence_hash(each, min_length, 2)
                same = lambda x: pa.array(np.full(len(at), x))
                yield pa.RecordBatch.from_arrays([pa.array(signed(k1)), pa.array(signed(k2)), same(h), same(c1), same(c2), same(n), pa.array((len(left) - at).astype(np.int32)), pa.array((at + min_length - len(left)).astype(np.int32))], ["k1", "k2", "h", "c1", "c2", "n", "l", "r"])

    return run


def _found(docs: DataFrame, id_col: str, text_col: str, min_length: int, with_groups: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences (t1, t2, p, l, r, repeats), names (id, t1, t2), identified documents)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("id", "text", *text_id())
    names = staged(rows.select("id", "t1", "t2"), "names")
    suffixes = rows.select("t1", "t2", "text").mapInArrow(_sampled(min_length), "h long, c1 long, c2 long, t1 long, t2 long, p int, l int, r int")
    where = F.xxhash64("t1", "t2", "p")
    again = suffixes.groupBy("h").agg(F.min(where).alias("least"), F.max(where).alias("most")).filter("least != most").select("h")
    spots = staged(suffixes.join(again, "h", "left_semi").distinct(), "spots")
    every = spots.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "p")).alias("at"), F.first("l").alias("l"), F.first("r").alias("r"))
    every = staged(every, "every")
    several = every.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h")
    # Alone in its gram, a class that occurs twice is repeated as far as its context goes.
    alone = every.join(several, "h", "left_anti").filter((F.col("n") > 1) & (F.col("l") + F.col("r") >= min_length))
    wanted = every.join(several, "h", "left_semi").groupBy("at.t1", "at.t2").agg(F.collect_list(F.struct("h", "c1", "c2", "n", F.col("at.p").alias("p"))).alias("classes"))
    chosen = names.groupBy("t1", "t2").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id")).alias("first"))
    chosen = chosen.join(wanted, ["t1", "t2"]).select(F.col("first.id").alias("id"), "t1", "t2", "classes")
    same = (F.col("r.t1") == F.col("w.t1")) & (F.col("r.t2") == F.col("w.t2")) & F.col("r.id").eqNullSafe(F.col("w.id"))
    texts = rows.alias("r").join(chosen.alias("w"), same).select("r.text", "w.classes")
    classes = staged(texts.mapInArrow(_contexts(min_length), "h long, c1 long, c2 long, n long, left binary, right binary"), "classes")
    scanned = staged(classes.repartition("h").sortWithinPartitions("h", "right", "left").mapInArrow(_scan(min_length, with_groups), "h long, c1 long, c2 long, l int, r int, repeats array<string>"), "scanned")
    large = classes.join(scanned.filter("l < 0").select("h", "c1", "c2"), ["h", "c1", "c2"], "left_semi")
    strings = large.select("h", "c1", "c2", "n", "left", "right").mapInArrow(_strings(min_length), "k1 long, k2 long, h long, c1 long, c2 long, n long, l int, r int")
    who = F.xxhash64("h", "c1", "c2")
    twice = strings.groupBy("k1", "k2").agg(F.min(who).alias("least"), F.max(who).alias("most"), F.max("n").alias("n")).filter("least != most or n > 1").select("k1", "k2")
    counted = strings.join(twice, ["k1", "k2"], "left_semi").groupBy("h", "c1", "c2").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    none = F.array().cast("array<string>")
    named = F.array(F.concat_ws(":", F.sha2(F.concat_ws(":", "c1", "c2"), 256), "l", "r")) if with_groups else none
    reach = scanned.filter("l >= 0").unionByName(counted.withColumn("repeats", none)).unionByName(alone.select("h", "c1", "c2", "l", "r", named.alias("repeats")))
    return spots.drop("l", "r").join(reach, ["h", "c1", "c2"]).select("t1", "t2", "p", "l", "r", "repeats"), names, rows


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(repeat, t1, t2, doc_id, start, length): all occurrences of the maximal repeats, in bytes, one row for each
    occurrence in each document that holds the text (bounded by the context of a suffix; repeats in a gram with
    more than LARGE contexts are left to without_repeats)."""
    found, names, _ = _found(docs, id_col, text_col, min_length, True)
    each = found.select("t1", "t2", "p", F.explode("repeats").alias("repeat")).withColumn("part", F.split("repeat", ":"))
    left, right = F.col("part")[1].cast("long"), F.col("part")[2].cast("long")
    return each.select(F.col("part")[0].alias("repeat"), "t1", "t2", (F.col("p") - left).alias("start"), (left + right).alias("length")).distinct().join(names.withColumnRenamed("id", "doc_id"), ["t1", "t2"])


def _cleaned(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            copy, spans = batch.column(2).to_pylist(), batch.column(3)
            for lo, hi, buf, off in pieces(batch.column(1)):
                raw = buf.tobytes()
                for row in range(hi - lo):
                    text = raw[off[row] : off[row + 1]]
                    n_bytes.append(len(text))
                    runs: list[list[int]] = []
                    if copy[lo + row] and len(text) >= min_length:
                        runs = [[0, len(text)]]
                    elif spans[lo + row].is_valid:
                        for s in spans[lo + row].as_py():
                            if runs and s["lo"] <= runs[-1][1]:
                                runs[-1][1] = max(runs[-1][1], s["hi"])
                            else:
                                runs.append([s["lo"], s["hi"]])
                    edges = [0, *(x for r in runs for x in r), len(text)]
                    n_removed.append(sum(b - a for a, b in runs))
                    n_spans.append(len(runs))
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_bytes): texts without the bytes of strings of min_length bytes that also start elsewhere.

    Null and empty texts have no bytes; shorter texts stay whole. Rows count
    each as a document, so rows that repeat a text (with or without the id) are
    removed whole if they are long enough. An empty table gives no rows; only
    the two named columns are read.
    """
    found, names, rows = _found(docs, id_col, text_col, min_length, False)
    spans = found.groupBy("t1", "t2").agg(F.array_sort(F.collect_set(F.struct((F.col("p") - F.col("l")).alias("lo"), (F.col("p") + F.col("r")).alias("hi")))).alias("spans"))
    copies = names.groupBy("t1", "t2").agg(F.count("*").alias("n")).filter("n > 1").select("t1", "t2", F.lit(True).alias("copy"))
    marks = spans.join(copies, ["t1", "t2"], "full_outer")
    # By id and text, so that the rows of a text with many copies spread.
    marks = names.distinct().join(marks, ["t1", "t2"]).select("id", "t1", "t2", F.coalesce("copy", F.lit(False)).alias("copy"), F.when(F.col("copy").isNull(), F.col("spans")).alias("spans"))
    on = (F.col("r.t1") == F.col("m.t1")) & (F.col("r.t2") == F.col("m.t2")) & F.col("r.id").eqNullSafe(F.col("m.id"))
    whole = rows.alias("r").join(marks.alias("m"), on, "left").select("r.id", "r.text", F.coalesce("m.copy", F.lit(False)).alias("copy"), "m.spans")
    kind = rows.schema["id"].dataType.simpleString()
    return whole.mapInArrow(_cleaned(min_length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_bytes binary")


def summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each document."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
