"""Repeated word windows, found level by level at doubling lengths.

Levels are the lengths window / 2^k, the shortest first. Of the runs of a
level's length that lie in a window, each window takes the one with the smallest
hash (equal windows choose at equal places; about one run in six is chosen). A
run that occurs once in the corpus is dropped, and with it all windows that
chose it. Only windows whose runs are repeated at one level go on to the level
of twice the length, and the search ends with the level of whole windows or as
soon as no candidate is left. Longer levels would add nothing to what is
removed: a longer repeated string is a chain of repeated windows.

On the last level the windows that chose one run make up a stretch of text.
Equal stretches are a class; all its occurrences but the first start later, so
they are covered whole. Single windows are compared only where a run has
stretches of several classes, and there only those of each class's first
occurrence.

Words are compared through 128 bits: two independently seeded hashes, in which
every step is mixed, so that no pattern of words cancels out.

Counts and minima are combined before they are shuffled, and rows meet repeated
keys in joins that deal a very frequent key to several tasks. Texts are shuffled
only if they may hold a repeated run. Copies of a text are searched once: every
row but the first of equal texts is removed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import NOT_SPACE, discard, joined, may_be_in, meet, minimum_at, mixed, pieces, sequence_hash, signed, staged, text_id, word_hashes, words

WINDOW = 20
#: No level is shorter than this, unless the window is shorter than twice as many words.
SHORTEST = 10
_SEEN = 500_000


def levels(window: int) -> list[int]:
    """The lengths from the shortest level to the window."""
    if window < 2 or window % 2:
        raise ValueError("the window has to be an even number of words")
    out = [window // 2, window]
    while out[0] % 2 == 0 and out[0] // 2 >= SHORTEST:
        out.insert(0, out[0] // 2)
    return out


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, t1, t2): null texts are empty, a null id is an id of its own."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("id", "text", *text_id())


def _candidates(h: np.ndarray, first: np.ndarray, window: int, length: int, places: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """The words at which windows begin, and where each window's chosen run of `length` words begins; with places (row,
    word in the row), only windows whose chosen run begins at one of these."""
    stop = np.repeat(first[1:], np.diff(first))
    begins = np.flatnonzero(np.arange(len(h)) + window <= stop)
    at = minimum_at(sequence_hash(h, length), window - length + 1)[begins]
    if places is None:
        return begins, at
    row, word = places
    wanted = np.zeros(len(h) + 1, bool)
    p = first[row] + word
    wanted[p[p < first[row + 1]]] = True
    return begins[wanted[at]], at[wanted[at]]


def _texts(batches: Iterator[pa.RecordBatch], text: int, lists: int | None, window: int):
    """(batch, first row, starts, ends, first word of each row, word hashes, entries of the list column by row) of each slice with words."""
    for batch in batches:
        entries = batch.column(lists) if lists is not None else None
        for lo, hi, buf, off in pieces(batch.column(text)):
            starts, ends, first = words(buf, off, NOT_SPACE)
            if len(starts) >= window:
                held = None
                if entries is not None:
                    bounds = entries.offsets.to_numpy()[lo : hi + 1]
                    held = np.repeat(np.arange(hi - lo), np.diff(bounds)), entries.values.slice(bounds[0], bounds[-1] - bounds[0])
                yield batch, lo, starts, ends, first, word_hashes(buf, starts, ends), held


def _runs(window: int, length: int, before: int | None):
    """(t1, t2, text and, from the second level on, places) -> the runs (h, t1, p) that windows choose. A task takes a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch, lo, _, _, first, h, held in _texts(batches, 2, 3 if before else None, window):
            begins, at = _candidates(h, first, window, before, (held[0], held[1].to_numpy())) if before else _candidates(h, first, window, length, None)
            if before:
                at = minimum_at(sequence_hash(h, length), window - length + 1)[begins]
            if not len(at):
                continue
            at = at[np.r_[True, at[1:] != at[:-1]]]
            row = np.searchsorted(first, at, "right") - 1
            t1, t2 = (batch.column(k).to_numpy()[lo : lo + len(first) - 1] for k in (0, 1))
            fresh = np.ones(len(t1), bool)
            for i, key in enumerate(zip(t1.tolist(), t2.tolist())):
                fresh[i] = key not in seen
                seen.add(key)
            if len(seen) > _SEEN:
                seen.clear()
            at, row = at[fresh[row]], row[fresh[row]]
            yield pa.RecordBatch.from_arrays([pa.array(signed(sequence_hash(h, length)[at])), pa.array(t1[row]), pa.array((at - first[row]).astype(np.int32))], ["h", "t1", "p"])

    return run


def _stretches(window: int, length: int):
    """(ord, text, places) -> (h, c, ord, s, n): n windows from word s on choose one run; h stands for the run, c for all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, _, _, first, h, held in _texts(batches, 1, 2, window):
            begins, at = _candidates(h, first, window, length, (held[0], held[1].to_numpy()))
            if not len(at):
                continue
            edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # windows that choose the same run follow one another
            s, n = begins[edge], np.diff(np.r_[edge, len(at)])
            # The first and the last window hold all words of a stretch.
            k = sequence_hash(h, window, 1)
            c = mixed(k[s] + mixed(k[s + n - 1] + n.astype(np.uint64)))
            row = np.searchsorted(first, s, "right") - 1
            order = batch.column(0).to_numpy()[lo + row]
            yield pa.RecordBatch.from_arrays([pa.array(signed(sequence_hash(h, length)[at[edge]])), pa.array(signed(c)), pa.array(order), pa.array((s - first[row]).astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "c", "ord", "s", "n"])

    return run


def _windows(window: int):
    """(ord, text, ranges (s, n)) -> (k1, k2, ord, s) of every window of the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, _, _, first, h, held in _texts(batches, 1, 2, window):
            row, ranges = held
            s, n = (ranges.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            fits = s + n + window - 1 <= np.diff(first)[row]
            row, s, n = row[fits], s[fits], n[fits]
            if not len(row):
                continue
            at = np.repeat(first[row] + s - (np.cumsum(n) - n), n) + np.arange(n.sum())
            row = np.repeat(row, n)
            k1, k2 = sequence_hash(h, window), sequence_hash(h, window, 1)
            yield pa.RecordBatch.from_arrays([pa.array(signed(k1[at])), pa.array(signed(k2[at])), pa.array(batch.column(0).to_numpy()[lo + row]), pa.array((at - first[row]).astype(np.int32))], ["k1", "k2", "ord", "s"])

    return run


def _with_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of wanted (id, t1, t2, ...), each once a row of wanted unless rows repeat it with the id."""
    same = (F.col("r.t1") == F.col("w.t1")) & (F.col("r.t2") == F.col("w.t2")) & F.col("r.id").eqNullSafe(F.col("w.id"))
    some = may_be_in(rows, wanted, "t1").filter("__may").drop("__may").dropDuplicates(["id", "t1", "t2"])
    return wanted.alias("w").join(some.alias("r"), same)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(rows (id, t1, t2, copy, ranges) of the texts with a window that starts earlier, the identified documents).

    ranges are (s, n): the n windows from word s on start earlier; copy marks a
    row whose whole text stands in an earlier row. Rows are told apart by id and
    text; earlier is the smaller id (null first), of one id the smaller t1, t2.
    """
    lengths = levels(window)
    rows = _identified(docs, id_col, text_col)
    names = staged(rows.select("id", "t1", "t2"), "names")
    classes = names.groupBy("t1", "t2").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id")).alias("first"))
    done: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        done.append(staged(df, name))
        return done[-1]

    # Levels below the window: runs that occur once are dropped.
    places, before = None, None
    for length in lengths[:-1]:
        texts = rows.select("t1", "t2", "text")
        if before:
            texts = may_be_in(texts, places, "t1").filter("__may").drop("__may").join(places, "t1").select("t1", "t2", "text", "places")
        runs = texts.mapInArrow(_runs(window, length, before), "h long, t1 long, p int")
        again = keep(runs.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1"), "again")
        places = keep(meet(runs, again, ["h"], "k", ["t1", "p"], "left_semi").groupBy("t1").agg(F.array_sort(F.collect_set("p")).alias("places")), "places")
        before = length
        if places.isEmpty():
            break

    # ord numbers the texts that are left in their order, whatever the type of the id.
    chosen = classes.join(places, "t1").select("first.some", "first.id", "t1", "t2", "places")
    chosen = keep(chosen.orderBy("some", "id", "t1", "t2").withColumn("ord", F.monotonically_increasing_id()), "chosen")
    stretches = _with_texts(rows, chosen.select("id", "t1", "t2", "ord", "places")).select("ord", "text", "places")
    stretches = keep(stretches.mapInArrow(_stretches(window, before), "h long, c long, ord long, s int, n int"), "stretches")
    where = F.struct("ord", "s")
    kinds = keep(stretches.groupBy("h", "c").agg(F.min(F.struct("ord", "s", "n")).alias("least"), F.count("*").alias("k")), "kinds")
    shared = keep(kinds.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "shared")
    copied = meet(stretches, kinds.filter("k > 1"), ["h", "c"], "k", ["ord", "s"]).filter("ord != least.ord or s != least.s").select("ord", "s", "n")

    # The last level: windows whose runs have several kinds of surroundings.
    firsts = meet(kinds, shared, ["h"], "m", ["c"], "left_semi").groupBy("least.ord").agg(F.collect_list(F.struct("least.s", "least.n")).alias("spans"))
    texts = _with_texts(rows, chosen.join(firsts, "ord").select("id", "t1", "t2", "ord", "spans")).select("ord", "text", "spans")
    single = keep(texts.mapInArrow(_windows(window), "k1 long, k2 long, ord long, s int"), "windows")
    earliest = keep(single.groupBy("k1", "k2").agg(F.min(where).alias("least"), F.count("*").alias("k")).filter("k > 1"), "earliest")
    later = meet(single, earliest, ["k1", "k2"], "k", ["ord", "s"]).filter("ord != least.ord or s != least.s").select("ord", "s", F.lit(1).alias("n"))

    ranges = copied.unionByName(later).groupBy("ord").agg(F.array_sort(F.collect_set(F.struct("s", "n"))).alias("ranges"))
    ranges = chosen.join(ranges, "ord").select(F.col("t1").alias("r1"), F.col("t2").alias("r2"), "ranges")
    # The first row of equal texts carries the ranges, the others are copies.
    ranked = names.join(classes, ["t1", "t2"]).select("id", "t1", "t2", F.coalesce(F.col("id") != F.col("first.id"), F.col("id").isNotNull() & F.col("first.id").isNull()).alias("copy")).distinct()
    found = ranked.join(ranges, (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2")) & ~F.col("copy"), "left")
    found = staged(found.filter("copy or ranges is not null").select("id", "t1", "t2", "copy", "ranges"), "found")
    for table in [names, *done]:
        discard(table)
    return found, rows


def _cleaned(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            removed = np.zeros(batch.num_rows, np.int64)
            kept: list[str] = []
            copy, ranges_of = batch.column(2).to_pylist(), batch.column(3)
            for lo, hi, buf, off in pieces(batch.column(1)):
                starts, ends, first = words(buf, off, NOT_SPACE)
                n_words[lo:hi] = np.diff(first)
                text, begin, end = joined(buf, starts, ends, NOT_SPACE) if len(starts) else (b"", starts, ends)
                for row in range(hi - lo):
                    a, b = first[row], first[row + 1]
                    if copy[lo + row] and b - a >= window:
                        removed[lo + row] = b - a
                        kept.append("")
                    elif ranges_of[lo + row].is_valid and b > a:
                        s, n = np.array([(x["s"], x["n"]) for x in ranges_of[lo + row].as_py()]).T
                        cover = np.zeros(b - a + 1, np.int64)
                        np.add.at(cover, s, 1)
                        np.add.at(cover, s + n - 1 + window, -1)
                        stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                        removed[lo + row] = b - a - len(stay)
                        kept.append(b" ".join(text[i:j] for i, j in zip(begin[a + stay].tolist(), end[a + stay].tolist())).decode())
                    else:
                        kept.append(text[begin[a] : end[b - 1]].decode() if b > a else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(removed), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): texts without the words of windows that start earlier; words are joined by one space.

    Null and empty texts have no words; texts shorter than a window stay whole.
    Earlier is the smaller id, then the smaller position; a null id comes
    first, and different texts with one id are documents of their own, in the
    order of their hashes. Rows that repeat both id and text count as one
    document and are treated alike. A very long text is worked on whole, in one
    task. An empty table gives no rows; only the two named columns are read.
    """
    found, rows = repeated_windows(docs, id_col, text_col, window)
    kind = rows.schema["id"].dataType.simpleString()
    on = (F.col("r.t1") == F.col("f.t1")) & (F.col("r.t2") == F.col("f.t2")) & F.col("r.id").eqNullSafe(F.col("f.id"))
    marked = may_be_in(rows, found, "t1")
    ranges = found.schema["ranges"].dataType
    plain = marked.filter("not __may").select("id", "text", F.lit(False).alias("copy"), F.lit(None).cast(ranges).alias("ranges"))
    hit = marked.filter("__may").alias("r").join(found.alias("f"), on, "left").select("r.id", "r.text", F.coalesce("f.copy", F.lit(False)).alias("copy"), "f.ranges")
    return plain.unionByName(hit).mapInArrow(_cleaned(window), f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each document."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
