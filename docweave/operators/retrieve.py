"""Similarity top-k of questions against chunks, exact and approximate, and the default embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Questions that one task holds: at 384 floats, 25 MB with their k best so far.
BLOCK = 16_384
#: Chunks that a task streams past its questions, roughly.
PART = 1 << 18
#: Distances that are in memory at a time.
_CELLS = 1 << 22


def _scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * q @ c.T))
    if metric == "cosine":
        q, c = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) for x in (q, c))
    return 1 - q @ c.T


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


class _Nearest:
    """The k nearest chunks so far of a block of questions, ties by chunk_id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, skip_self: bool):
        self.ids, self.vectors, self.k, self.skip_self = ids, vectors, k, skip_self
        self.row, self.far, self.at = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.worst = np.full(len(ids), np.inf)

    def add(self, chunk_id: np.ndarray, far: np.ndarray) -> None:
        if self.skip_self:
            far[self.ids[:, None] == chunk_id[None]] = np.inf
        limit = self.worst
        if far.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(far, self.k - 1, axis=1)[:, self.k - 1])
        row, col = np.nonzero((far <= limit[:, None]) & np.isfinite(far))
        row, dist, at = np.concatenate([self.row, row]), np.concatenate([self.far, far[row, col]]), np.concatenate([self.at, chunk_id[col]])
        order = np.lexsort((at, dist, row))
        row, dist, at = row[order], dist[order], at[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        keep = place < self.k
        self.row, self.far, self.at = row[keep], dist[keep], at[keep]
        last = place == self.k - 1
        self.worst[row[last]] = dist[last]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.at), pa.array(self.far)], ["question_id", "chunk_id", "distance"])


def _search(decode, metric: str, decimals: int, k: int, skip_self: bool):
    """Streams rows (cell, size, kind, id, vector, code), the questions (kind 0) of a cell and size before its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, vectors, near = None, [], [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else []
            for lo, hi in zip(edge, [*edge[1:], len(key)]):
                part, kind = batch.slice(lo, hi - lo), int(key[lo, 2])
                if tuple(key[lo, :2]) != cell:
                    if near is not None:
                        yield near.rows()
                    cell, ids, vectors, near = tuple(key[lo, :2]), [], [], None
                if kind == 0:
                    ids.append(part.column(3).to_numpy(zero_copy_only=False))
                    vectors.append(_matrix(part.column(4)))
                    continue
                if not ids:
                    continue  # no question has vectors of this size
                if near is None:
                    near = _Nearest(np.concatenate(ids), np.concatenate(vectors), k, skip_self)
                step = max(1, _CELLS // len(near.ids))
                for at in range(0, len(part), step):
                    some = part.slice(at, step)
                    stored = _matrix(some.column(4)) if decode is None else decode(some.column(5))
                    near.add(some.column(3).to_numpy(zero_copy_only=False), np.round(_scores(near.vectors, stored, metric), decimals))
        if near is not None:
            yield near.rows()

    return run


def _met(questions: DataFrame, chunks: DataFrame, k: int, metric: str, decimals: int, skip_self: bool, decode=None) -> DataFrame:
    """(question_id, chunk_id, distance, rn): the k nearest of a grid of blocks of questions and parts of chunks (chunk_id, size,
    embedding or code).

    A task holds a block of questions and streams a part of the chunks past
    them, keeping k a question; what it kept is merged in one shuffle. Neither
    side passes through the driver, and the plan is the same for any number of
    either.
    """
    blocks = max(1, -(-questions.count() // BLOCK))
    parts = max(chunks.sparkSession.sparkContext.defaultParallelism // blocks, -(-chunks.count() // PART), 1)
    none = lambda kind: F.lit(None).cast(kind)
    double = any(df.schema["embedding"].dataType.simpleString() == "array<double>" for df in (questions, chunks) if "embedding" in df.columns)
    kind = "array<double>" if double else "array<float>"
    code = F.col("code") if decode else none("binary").alias("code")
    vector = (none(kind) if decode else F.col("embedding").cast(kind)).alias("vector")
    spread = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    asked = questions.filter("size(embedding) > 0").select(F.col("question_id").cast("long").alias("id"), F.size("embedding").alias("size"), F.col("embedding").cast(kind).alias("vector"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(spread(parts)))
    stored = chunks.select(F.col("chunk_id").cast("long").alias("id"), "size", vector, code)
    stored = stored.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(spread(blocks)))
    cell = (F.col("block") * parts + F.col("part")).alias("cell")
    both = asked.select(cell, "size", F.lit(0).alias("kind"), "id", "vector", none("binary").alias("code")).unionByName(stored.select(cell, "size", F.lit(1).alias("kind"), "id", "vector", "code"))
    grid = both.repartition(blocks * parts, "cell").sortWithinPartitions("cell", "size", "kind")
    near = grid.mapInArrow(_search(decode, metric, decimals, k, skip_self), "question_id long, chunk_id long, distance double")
    order = Window.partitionBy("question_id").orderBy("distance", "chunk_id")
    return near.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


def knn(questions: DataFrame, chunks: DataFrame, k: int = 20, metric: str = "cosine", decimals: int = 9, skip_self: bool = True) -> DataFrame:
    """(question_id, chunk_id, distance, rn): the k nearest chunks of each question, ties by chunk_id.

    Questions (question_id long, embedding) are a stated query set, held
    against all chunks in blocks. Questions that match nothing for want of a
    vector, or of chunks of its size, are those that unsearchable() reports.
    """
    stored = chunks.filter("size(embedding) > 0").select("chunk_id", F.size("embedding").alias("size"), "embedding")
    return _met(questions.select("question_id", "embedding"), stored, k, metric, decimals, skip_self)


def unsearchable(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, size) of the questions that no chunk can be held against: size of the vector, 0 if there is none."""
    size = F.coalesce(F.greatest(F.size("embedding"), F.lit(0)), F.lit(0)).alias("size")
    return questions.select("question_id", size).join(chunks.select(size).filter("size > 0").distinct(), "size", "left_anti").select("question_id", "size")


#: Rows that codebooks are fitted on, at most about: a bounded sample, while every row is indexed.
SAMPLE = 20_000
#: Numbers in a subvector, centres of a codebook, rounds of its fit.
PART_DIMS, CENTRES, ROUNDS = 2, 256, 15


def _centres(rows: pd.DataFrame) -> pd.DataFrame:
    """k-means over the subvectors of one place."""
    x = np.stack(rows["v"].to_numpy()).astype(np.float64)
    x = x[np.lexsort(x.T)]
    centre = np.unique(x, axis=0)
    if len(centre) > CENTRES:
        centre = centre[np.linspace(0, len(centre) - 1, CENTRES).astype(int)]
        for _ in range(ROUNDS):
            near = np.argmin((centre * centre).sum(1)[None] - 2 * x @ centre.T, axis=1)
            n = np.bincount(near, minlength=len(centre))
            sums = np.stack([np.bincount(near, x[:, d], len(centre)) for d in range(x.shape[1])], axis=1)
            centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centre)
    return pd.DataFrame({"place": rows["place"].iloc[0], "centre": range(len(centre)), "v": list(centre.astype(np.float32))})


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def codebooks(chunks: DataFrame, dims: int, seed: int = 1) -> list[np.ndarray]:
    """The centres of each place's subvectors, fitted by a task a place on a sample of at most about SAMPLE rows. They have at
    most CENTRES * dims numbers, whatever the chunks."""
    rows = chunks.filter(F.size("embedding") == dims)
    total = rows.count()
    rows = rows.sample(SAMPLE / total, seed) if total > SAMPLE else rows
    v = F.col("embedding").cast("array<double>")
    size = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-30))
    places = rows.select(F.transform(v, lambda x: x / size).alias("v")).select(F.explode(F.sequence(F.lit(0), F.lit(-(-dims // PART_DIMS) - 1))).alias("place"), "v")
    cut = places.select("place", F.slice("v", F.col("place") * PART_DIMS + 1, F.lit(PART_DIMS)).alias("v"))
    found = cut.groupBy("place").applyInPandas(_centres, "place int, centre int, v array<float>").collect()
    books: dict[int, list] = {}
    for place, _, v in sorted(found, key=lambda r: r[:2]):
        books.setdefault(place, []).append(v)
    return [np.array(books[p], np.float64) for p in sorted(books)]


def coded(chunks: DataFrame, books: list[np.ndarray], dims: int) -> DataFrame:
    """(chunk_id, size, code): a byte a subvector, the number of its nearest centre. This is the index: an eighth of the vectors' size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column(1))) if len(batch) else np.zeros((0, dims))
            parts = [np.argmin((b * b).sum(1)[None] - 2 * x[:, PART_DIMS * p : PART_DIMS * (p + 1)] @ b.T, axis=1) for p, b in enumerate(books)]
            code = np.stack(parts, axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), dims, np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], ["chunk_id", "size", "code"])

    rows = chunks.filter(F.size("embedding") == dims).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(run, "chunk_id long, size int, code binary")


def knn_coded(questions: DataFrame, chunks: DataFrame, index: DataFrame, books: list[np.ndarray], k: int = 20, shortlist: int | None = None, skip_self: bool = True) -> tuple[DataFrame, DataFrame]:
    """((question_id, chunk_id, distance, rn), the pairs whose exact distance was taken): an approximate knn() for cosine distance.

    Distances to what the codes stand for (each byte is looked up in its
    codebook, and the products of all parts are one matrix product) give a
    short list of each question, by default six times k, whose exact distances
    decide.
    """
    width = len(books)

    def decode(codes: pa.Array) -> np.ndarray:
        at = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, width)
        return np.concatenate([book[at[:, p]] for p, book in enumerate(books)], axis=1)

    dims = sum(b.shape[1] for b in books)
    asked = questions.filter(F.size("embedding") == dims).select("question_id", "embedding")
    short = _met(asked, index, shortlist or 6 * k, "cosine", 9, skip_self, decode).select("question_id", "chunk_id")
    own = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").alias("c"))
    pairs = short.join(asked.select(F.col("question_id").cast("long").alias("question_id"), F.col("embedding").alias("q")), "question_id").join(own, "chunk_id")
    near = pairs.select("question_id", "chunk_id", F.round(T.distance(F.col("q"), F.col("c")), 9).alias("distance"))
    order = Window.partitionBy("question_id").orderBy("distance", "chunk_id")
    return near.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k), near


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_questions, recall): the share of the exact hits that were found, over all questions."""
    hit = found.select("question_id", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["question_id", "chunk_id"], "left").agg(F.count_distinct("question_id").alias("n_questions"), (F.count("hit") / F.count("*")).alias("recall"))


def hashed_embedding(dims: int = 384):
    """The default embedding: hashed words, counted and scaled to unit length. A model is plugged in the same way."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from zlib import crc32

        known: dict[str, int] = {}
        for batch in texts:
            out = np.zeros((len(batch), dims), np.float32)
            for row, text in enumerate(batch):
                for word in (text or "").lower().split():
                    if word not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[word] = crc32(word.encode())
                    h = known[word]
                    out[row, h % dims] += 1 - 2 * (h >> 31)
            size = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.Series(list(out / np.where(size > 0, size, 1)))

    return embed


def chunk_rows(raw: DataFrame) -> DataFrame:
    """Stored metadata as chunk columns: missing texts are empty, missing numbers 0, an empty media URL is null."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c)
    return raw.select(
        F.col("chunk_id").cast("string"), *(text(c) for c in ("element_id", "graph_node_id", "document", "filename", "label")), *(number(c) for c in ("page_no", "page_position", "ref_position")),
        F.nullif(F.col("minio_url"), F.lit("")).alias("minio_url"), F.col("distance").cast("double"),
    )


def compatible(df: DataFrame, dims: int, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with vectors of the wanted size and model, the others)."""
    fits = F.coalesce(F.size("embedding") == dims, F.lit(False))
    if model is not None:
        fits &= F.coalesce(F.col("model") == model, F.lit(False))
    return df.filter(fits), df.filter(~fits)
