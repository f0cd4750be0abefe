"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bulk-synchronous best-fit. Pieces are taken in classes of halving length, the
longest first. In a round, the pieces of a class and the gaps of the open
sequences are sorted together by size into ranges; a gap that can hold several
pieces of the class stands in the sort with a slot for each. Each task sweeps
its range: going up, a slot takes the largest piece below it that no smaller
slot took, so a piece goes to its successor among the free slots. What a sweep
leaves over at the edges of its range is matched across ranges by rank: the
n-th slot left there belongs to the n-th piece left below. Then the gaps shrink
by what they took and the round repeats, until the class is used up; where no
gap can hold any of its pieces, new sequences are opened.

All rows stay on the executors. The driver sees how many rows each range left
over and how many gaps there are of each size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import pieces, releasing, same_bytes, staged, word_hashes

CAPACITY = 1024
EOS = 2
_CACHED = 300_000
_SLICE = 1 << 19

#: Bytes beside which a single space may end and begin a token chunk: not white space,
#: and not a byte that may belong to a non-ASCII white-space character.
_BEFORE, _AFTER = np.ones(256, bool), np.ones(256, bool)
for _b in (*range(0x21), 0x7F, 0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F):
    _BEFORE[_b] = False
for _b in (*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3):
    _AFTER[_b] = False


class Chunks:
    """Ids of text chunks, remembered by hash. A chunk begins at a document's start or at a single space between
    two words; the byte-level pre-tokeniser always splits there, so chunks are tokenised apart."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.n = self.used = self.used_raw = 0
        self.ids, self.raw = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint8)
        self.start, self.size, self.raw_start, self.raw_size = (np.zeros(1 << 14, np.int64) for _ in range(4))

    def add(self, texts: list[bytes]) -> np.ndarray:
        """Tokenises chunks and remembers them with their bytes; their numbers."""
        encoded = [self.encode(t.decode()) for t in texts]
        sizes, lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)), np.fromiter(map(len, texts), np.int64, len(texts))
        total, total_raw = int(sizes.sum()), int(lengths.sum())
        while self.n + len(texts) > len(self.start):
            self.start, self.size, self.raw_start, self.raw_size = (np.concatenate([x, x]) for x in (self.start, self.size, self.raw_start, self.raw_size))
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        while self.used_raw + total_raw > len(self.raw):
            self.raw = np.concatenate([self.raw, self.raw])
        self.ids[self.used : self.used + total] = np.fromiter((i for e in encoded for i in e), np.uint32, total)
        self.raw[self.used_raw : self.used_raw + total_raw] = np.frombuffer(b"".join(texts), np.uint8)
        own = np.arange(self.n, self.n + len(texts))
        self.size[own], self.raw_size[own] = sizes, lengths
        self.start[own] = self.used + np.cumsum(sizes) - sizes
        self.raw_start[own] = self.used_raw + np.cumsum(lengths) - lengths
        self.n, self.used, self.used_raw = self.n + len(texts), self.used + total, self.used_raw + total_raw
        return own

    def tokens(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, one after another, and each row's first id (one entry more than rows)."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        cut = buf == 0x20
        cut[1:] &= _BEFORE[buf[:-1]]
        cut[:-1] &= _AFTER[buf[1:]]
        cut[-1] = False
        cut[off[:-1][off[:-1] < off[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(buf)]
        key, first, which = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.at) > _CACHED:
            self.clear()
        known = np.fromiter((self.at.get(k, -1) for k in key.tolist()), np.int64, len(key))
        new = np.flatnonzero(known < 0)
        raw = buf.tobytes()
        texts = lambda at: [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        if len(new):
            known[new] = self.add(texts(first[new]))
            self.at.update(zip(key[new].tolist(), known[new].tolist()))
        chunk = known[which]
        # A hash only finds a chunk; its bytes decide.
        length = ends - starts
        other = np.flatnonzero((self.raw_size[chunk] != length) | ~same_bytes(buf, starts, self.raw, self.raw_start[chunk], np.minimum(length, self.raw_size[chunk])))
        if len(other):
            chunk[other] = self.add(texts(other))
        size = self.size[chunk]
        reach = np.cumsum(size)
        ids = self.ids[np.arange(reach[-1]) + np.repeat(self.start[chunk] - (reach - size), size)]
        return ids, np.r_[0, reach][np.searchsorted(starts, off)]

    def rows(self, buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each row."""
        ids, at = self.tokens(buf, off)
        raw = buf.tobytes()
        odd = any(s in raw for s in self.special)
        for row in range(len(off) - 1):
            text = raw[off[row] : off[row + 1]] if odd else b""
            if odd and any(s in text for s in self.special):
                yield np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[at[row] : at[row + 1]]


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int = CAPACITY, eos: int = EOS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as ids and a final `eos`, the longer ones cut; of a cut document the first piece is the short one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(json_path, ranks_path, pattern)
        for batch in batches:
            row, piece, start, length, crc, n = [], [], [], [], [], 0
            for _, _, buf, off in pieces(batch.column(1), _SLICE):
                for ids in chunks.rows(buf, off):
                    raw = np.append(ids, np.uint32(eos)).astype("<u4").tobytes()
                    total = len(raw) // 4
                    edges = [0, *range(total % capacity or min(total, capacity), total + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        row.append(n)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    n += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(releasing(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def matched(size: np.ndarray, is_slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces and slots in order of size, pieces before slots of their size: (pieces and the slots that take them, slots
    left in order, pieces left from the largest down). A slot takes the last free piece before it, as a closing bracket does."""
    depth = np.cumsum(np.where(is_slot, -1, 1))
    level = depth + is_slot
    order = np.argsort(level, kind="stable")
    pair = np.flatnonzero(~is_slot[order[:-1]] & is_slot[order[1:]] & (level[order[:-1]] == level[order[1:]])) if len(order) else np.zeros(0, np.int64)
    piece, slot = order[pair], order[pair + 1]
    free = np.ones(len(size), bool)
    free[piece] = free[slot] = False
    return piece, slot, np.flatnonzero(free & is_slot), np.flatnonzero(free & ~is_slot)[::-1]


_SWEPT = "part int, pid long, length int, seq long, slot int, room int, rank long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, is_slot, key, slot, room) of a range in order -> matches, and with a null on one side what is left."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    size, is_slot, key, nth, room = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches]) for k in range(5))
    piece, slot, slots_left, pieces_left = matched(size, is_slot)
    part = TaskContext.get().partitionId()

    def rows(p, s, rank):
        n = len(s) if p is None else len(p)
        none = lambda kind: pa.nulls(n, kind)
        of_piece = [none(pa.int64()), none(pa.int32())] if p is None else [pa.array(key[p]), pa.array(size[p].astype(np.int32))]
        of_slot = [none(pa.int64()), none(pa.int32()), none(pa.int32())] if s is None else [pa.array(key[s]), pa.array(nth[s].astype(np.int32)), pa.array(room[s].astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), *of_piece, *of_slot, pa.array(rank) if rank is not None else none(pa.int64())], [x.split()[0] for x in _SWEPT.split(", ")])

    yield rows(piece, slot, None)
    yield rows(None, slots_left, np.arange(len(slots_left)))
    yield rows(pieces_left, None, np.arange(len(pieces_left)))


def across(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(range of the slots, first rank, end, range of the pieces, what to add to a slot's rank) from (range, slots left, pieces
    left) of each range in order: slots take what lower ranges left, the nearest first."""
    waiting: list[list[int]] = []  # [range, next rank, pieces]
    out = []
    for part, slots, own in sorted(left):
        at = 0
        while at < slots and waiting:
            below = waiting[-1]
            n = min(slots - at, below[2])
            out.append((part, at, at + n, below[0], below[1] - at))
            at, below[1], below[2] = at + n, below[1] + n, below[2] - n
            if not below[2]:
                waiting.pop()
        if own:
            waiting.append([part, 0, own])
    return out


#: Rows of a range, and the length up to which pieces are one class.
ROWS_A_TASK = 200_000
LAST_CLASS = 16


def packed(parts: DataFrame, capacity: int = CAPACITY, rows_a_task: int | None = None) -> DataFrame:
    """The pieces with sequence_id and offset. parts is a written table with a number `pid` for each piece."""
    spark, tasks = parts.sparkSession, lambda n: max(1, -(-n // (rows_a_task or ROWS_A_TASK)))
    # Of the longest pieces no two share a sequence, so each opens its own, named by the piece; those opened later count down from -1.
    long = parts.filter(F.col("length") > capacity // 2)
    placed = [long.select("pid", F.col("pid").alias("seq"), F.lit(0).alias("offset"))]
    gaps = staged(long.select(F.col("pid").alias("seq"), (capacity - F.col("length")).cast("int").alias("room")).filter("room > 0"), "gaps")
    opened, hi = 0, capacity // 2
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    while hi:
        lo = hi // 2 if hi > LAST_CLASS else 0
        waiting = parts.filter((F.col("length") > lo) & (F.col("length") <= hi)).select("pid", F.col("length").cast("int").alias("length"))
        own = {length: n for length, n in counts.items() if lo < length <= hi}
        n_waiting, total, least = sum(own.values()), sum(length * n for length, n in own.items()), min(own, default=0)
        tight = True
        while n_waiting:
            rooms = {r["room"]: r["n"] for r in gaps.filter(F.col("room") >= least).groupBy("room").agg(F.count("*").alias("n")).collect()}
            if not rooms:
                # As many new sequences as the pieces need at least; for what these leave over, one for each slot that is missing.
                more = max(-(-total // capacity), -(-n_waiting // (capacity // (lo + 1)))) if tight else -(-n_waiting // (capacity // hi))
                tight = False
                fresh = spark.range(opened, opened + more, numPartitions=tasks(more)).select((-1 - F.col("id")).alias("seq"), F.lit(capacity).alias("room"))
                gaps = gaps.unionByName(fresh)
                opened += more
                rooms[capacity] = more
            # Gaps that any piece of the class fits are offered from the smallest up, until they have a slot for each piece.
            most, n_slots, sure = hi - 1, sum(n for room, n in rooms.items() if room < hi), 0
            for room in sorted(r for r in rooms if r >= hi):
                if sure >= n_waiting:
                    break
                most, sure = room, sure + rooms[room] * (room // hi)
            offered = gaps.filter((F.col("room") >= least) & (F.col("room") <= most)).withColumn("slots", F.greatest(F.lit(1), F.floor(F.col("room") / hi)).cast("int"))
            slot = offered.select("seq", "room", "slots", F.explode(F.sequence(F.lit(1), F.col("slots"))).alias("slot"))
            size = F.least(F.lit(hi), F.when(F.col("slot") < F.col("slots"), F.lit(hi)).otherwise(F.col("room") - (F.col("slots") - 1) * hi))
            both = waiting.select(F.col("length").alias("size"), F.lit(False).alias("is_slot"), F.col("pid").alias("key"), F.lit(0).alias("slot"), F.lit(0).alias("room")).unionByName(slot.select(size.cast("int").alias("size"), F.lit(True).alias("is_slot"), F.col("seq").alias("key"), "slot", "room"))
            order = ["size", "is_slot", "key", "slot"]
            n = tasks(n_waiting + n_slots + sure)
            ranges = both.repartitionByRange(n, *order) if n > 1 else both.coalesce(1)
            swept = staged(ranges.sortWithinPartitions(*order).mapInArrow(_sweep, _SWEPT), "swept")
            left = swept.groupBy("part").agg(F.count_if(F.col("pid").isNull()).alias("slots"), F.count_if(F.col("seq").isNull()).alias("pieces"), F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.expr("seq is not null"), F.col("length"))), F.lit(0)).alias("length"), F.min(F.when(F.expr("seq is null"), F.col("length"))).alias("least"))
            left = left.collect()
            links = across([(r["part"], r["slots"], r["pieces"]) for r in left])
            n_now, length_now = sum(r["n"] - r["slots"] - r["pieces"] for r in left), sum(r["length"] for r in left)
            least = min((r["least"] for r in left if r["pieces"]), default=0)
            found = swept.filter("pid is not null and seq is not null").select("pid", "length", "seq", "slot", "room")
            rest = swept.filter("seq is null").select("part", "rank", "pid", "length")
            if links:
                link = F.broadcast(spark.createDataFrame(links, "part int, first long, end long, piece_part int, shift long"))
                slots = swept.filter("pid is null").select("part", "rank", "seq", "slot", "room").join(link, "part").filter("rank >= first and rank < end")
                slots = slots.select(F.col("piece_part").alias("part"), (F.col("rank") + F.col("shift")).alias("rank"), "seq", "slot", "room")
                met = staged(rest.join(slots, ["part", "rank"]).select("pid", "length", "seq", "slot", "room"), "met")
                more_now, more_length = met.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
                n_now, length_now = n_now + more_now, length_now + more_length
                found, rest = found.unionByName(met), rest.join(met, "pid", "left_anti")
            before = F.sum("length").over(Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
            now = staged(found.select("pid", "length", "seq", (capacity - F.col("room") + F.coalesce(before, F.lit(0))).cast("int").alias("offset")), "placed")
            placed.append(now.drop("length"))
            taken = now.groupBy("seq").agg(F.sum("length").alias("taken"))
            gaps = staged(gaps.join(taken, "seq", "left").select("seq", (F.col("room") - F.coalesce("taken", F.lit(0))).cast("int").alias("room")).filter("room > 0"), "gaps")
            n_waiting, total = n_waiting - n_now, total - length_now
            waiting = rest.select("pid", "length")
        hi = lo
    where = placed[0]
    for more in placed[1:]:
        where = where.unionByName(more)
    return parts.join(where, "pid").select(*(c for c in parts.columns if c != "pid"), F.col("seq").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int = CAPACITY, eos: int = EOS) -> DataFrame:
    """Pieces of all documents with the sequence and offset each is placed at.

    Null and empty texts are one piece that holds only `eos`. Rows with equal
    ids, or without id, are packed each on their own; of equal lengths any may
    come first; a very long text is tokenised whole, in one task; an empty
    table gives no rows. Only doc_id and text are read.
    """
    parts = token_pieces(docs, json_path, ranks_path, pattern, capacity, eos)
    return packed(staged(parts.withColumn("pid", F.monotonically_increasing_id()), "pieces"), capacity)
