"""Byte-level text kernels shared by the operators of this subpackage.

Everything here works on the UTF-8 buffer of a whole Arrow batch, a slice of
about a megabyte at a time, so memory is bounded by the slice (or by one text
that is longer than a slice) and no Python code runs per character.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

SLICE_BYTES = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words as runs of bytes that are not one of the six ASCII white-space characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words as runs of lower-case letters, digits and non-ASCII bytes (after LOWER).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: computed once, lineage cut, safe against lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    spark = table.sparkSession.sparkContext
    path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, at whose end the memory that it freed goes back to the system. Python workers stay for later stages, and the C
    library would keep for each of them what its largest task took."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return whole


def fresh(name: str, columns: list[str]) -> str:
    """name with as many underscores as it takes to clash with none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) of at most `limit` bytes, or of one longer row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def pieces(column, limit: int = SLICE_BYTES):
    """(lo, hi, bytes, offsets from 0) for each slice of the rows of a string column."""
    buf, off = utf8(column)
    for lo, hi in slices(off, limit):
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def words(buf: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and each row's first word (one entry more than rows)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = member[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = off[:-1][off[:-1] < off[1:]]
    first[full] = inside[full]
    full = off[1:][off[:-1] < off[1:]] - 1
    last[full] = inside[full]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, member: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The slice with one space after each word instead of what stood there, and the words' new starts and ends."""
    buf, keep = buf.copy(), member[buf]
    gap = ends[ends < len(buf)]
    gap = gap[~keep[gap]]
    buf[gap] = 0x20
    keep[gap] = True
    place = np.cumsum(keep) - 1
    return buf[keep].tobytes(), place[starts], place[ends - 1] + 1


def text_id() -> list[Column]:
    """The two halves t1 and t2 of a 128-bit identity of the column `text`."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


#: Cells of the bitmap of may_be_in(): 8 MB at most, whatever the keys.
_CELLS = 1 << 26


def may_be_in(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """rows with __may: false where the hash in `column` is surely not among those of keys, so that such rows need not be
    shuffled to meet them. A bitmap of a fixed size is broadcast; the more keys, the more rows it lets through."""
    cell = F.pmod(F.col(column), F.lit(_CELLS)) + 1
    bits = keys.select(F.bitmap_bucket_number(cell).alias("__bucket"), F.bitmap_bit_position(cell).alias("__at")).groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    met = rows.withColumn("__bucket", F.bitmap_bucket_number(cell)).join(F.broadcast(bits), "__bucket", "left")
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.withColumn("__may", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("__bucket", "__bits")


#: A key with more rows than this, and than a thousandth of all, is dealt to SALTS tasks in meet().
HOT_ROWS = 4096
SALTS = 128


def meet(rows: DataFrame, keys: DataFrame, on: list[str], count: str, spread: list[str], how: str = "inner") -> DataFrame:
    """rows joined with distinct keys (a staged table) whose column `count` says how many rows have the key.

    Keys with very many rows, of which there are at most a thousand, are dealt to several tasks by a salt from the
    columns `spread` of the rows; so a key that a third of all rows have doesn't end in one task.
    """
    total = keys.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = keys.filter(F.col(count) > max(HOT_ROWS, total // 1000)).select(*on).withColumn("__hot", F.lit(True))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(F.lit(0))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("__salt", salt).drop("__hot")
    copies = keys.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).otherwise(F.array(F.lit(0).cast("bigint"))))).drop("__hot")
    return dealt.join(copies, [*on, "__salt"], how).drop("__salt")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def blocks(buf: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte as a number; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges. Each block of eight bytes passes through mixed(), so ranges of up to eight bytes
    collide with none of their own length, and no pattern of bytes cancels out as it does in a sum of powers."""
    size = ends - starts
    h = mixed(size.astype(np.uint64) * _FACTOR)
    wide = blocks(buf)
    at = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    for k in range(0, LONG_WORD, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        h[at] = mixed(h[at] ^ (wide[starts[at] + k] & _FIRST_BYTES[np.minimum(size[at] - k, 8)]))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return h


def same_bytes(one: np.ndarray, a: np.ndarray, two: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from a on in one equal those from b on in two, for each entry."""
    left, right = blocks(one), blocks(two)
    same, at, k = np.ones(len(size), bool), np.arange(len(size)), 0
    while len(at):
        at = at[size[at] > k]
        mask = _FIRST_BYTES[np.minimum(size[at] - k, 8)]
        bad = ((left[a[at] + k] ^ right[b[at] + k]) & mask) != 0
        same[at[bad]] = False
        at = at[~bad]
        k += 8
    return same


def wide_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(n, 2) halves of 128-bit hashes of byte ranges, for ranges that are few beside the bytes."""
    digest = xxhash.xxh3_128_digest
    each = [digest(raw[a:b], seed) for a, b, seed in zip(starts.tolist(), ends.tolist(), seeds.tolist())]
    return np.frombuffer(b"".join(each), "<u8").reshape(-1, 2)


def sequence_hash(h: np.ndarray, k: int, salt: int = 0, step: int = 1) -> np.ndarray:
    """Hashes of all runs of k entries of h that stand `step` apart; every joint of two parts is mixed."""
    n = len(h) - (k - 1) * step
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, width = mixed(h ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) if salt else h, 1
    out, at, bits = None, 0, k
    while bits:
        if bits & 1:
            part = done[at * step : at * step + n]
            out = part if out is None else mixed(out * _FACTOR + part)
            at += width
        bits >>= 1
        if bits:
            done = mixed(done[: -width * step] * _FACTOR + done[width * step :])
            width *= 2
    return mixed(out)


def minimum_at(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` consecutive entries, by its beginning, where its smallest entry stands (the last of equals).

    What is chosen in a run depends on its content alone, so equal runs choose
    at equal places.
    """
    n = len(h)
    if n < width:
        return np.zeros(0, np.int64)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - 1, -1, -1, dtype=np.uint64)
    padded = -(-n // width) * width
    grid = np.full(padded, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = key
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return n - 1 - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def minimizers(h: np.ndarray, width: int, begins: np.ndarray) -> np.ndarray:
    """The places that minimum_at() gives for runs that begin where `begins` is true."""
    at = minimum_at(h, width)
    at = at[begins[: len(at)]]
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
