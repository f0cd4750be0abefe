"""Search by words: an inverted index as tables, and BM25 with block-max bounds.

A posting's impact is what its term adds to the score of its chunk. A term's
postings lie in bands of impact, and a band in as many parts as its size asks
for, so that no term, however frequent, is one task's work. For each term the
index knows the greatest impact of each band and an impact that at least k
chunks reach. That gives a search, before it reads a posting, a score that its
k-th hit has at least; terms that cannot bring a chunk there on their own, and
bands whose best posting cannot, are skipped. Where many questions ask for
frequent terms, the pairs to be scored grow with questions times chunks; these
searches hold blocks of questions against parts of the chunks, each in the
memory of a task, and no pair is shuffled that is not among a part's k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .skew import SHARE, spread_join

K1, B = 1.2, 0.75
BANDS = 16
#: Keeps bounds on the safe side of rounding.
_SLACK = 1e-6
#: Postings of all asked terms up to which pairs are looked up in the index one by one; beyond, blocks are held against parts.
LOOKUPS = 1 << 22
#: Questions of a block and postings of a part, roughly.
BLOCK, PART = 16_384, 1 << 20


class Index(NamedTuple):
    """postings (term, band, part, chunk_id, tf, impact), bands (term, band, top, parts), terms (term, df, top, reached)."""

    postings: DataFrame
    bands: DataFrame
    terms: DataFrame
    k: int


def words(text: Column) -> Column:
    """Runs of a-z of the lower-cased text, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def index(chunks: DataFrame, k: int = 20, part: int = SHARE) -> Index:
    """The index of chunks (chunk_id, document), for searches of up to k hits. Chunks without a word count in the averages."""
    sized = chunks.select("chunk_id", words(F.col("document")).alias("words"))
    total = sized.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    n, mean = total["n"], total["mean"] or 1.0
    # Rows that share a chunk_id are one text: their words and sizes add up.
    sized = sized.groupBy("chunk_id").agg(F.flatten(F.collect_list("words")).alias("words"))
    counts = stored(sized.select("chunk_id", F.size("words").alias("size"), F.explode("words").alias("term")).groupBy("chunk_id", "size", "term").agg(F.count("*").alias("tf")), "counts")
    df = stored(counts.groupBy("term").agg(F.count("*").alias("df")), "terms")
    weight = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (K1 + 1)
    share = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean)))
    met = spread_join(counts, df, ["term"], "df", ["chunk_id"]).select("term", "chunk_id", "tf", "df", share.alias("share"), (weight * share).alias("impact"))
    parts = F.greatest(F.ceil(F.col("df") / part), F.lit(1))
    banded = met.select("term", F.floor(F.col("share") * BANDS).cast("int").alias("band"), F.pmod(F.xxhash64("chunk_id"), parts).cast("int").alias("part"), "chunk_id", "tf", "impact")
    postings = stored(banded, "postings")
    found = postings.groupBy("term", "band").agg(F.count("*").alias("n"), F.max("impact").alias("top"), F.min("impact").alias("low"))
    above = F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("band")))
    bands = stored(found.withColumn("above", above).join(df, "term").select("term", "band", "top", "low", "above", "df", parts.cast("int").alias("parts")), "bands")
    terms = bands.groupBy("term").agg(F.max("df").alias("df"), F.max("top").alias("top"), F.coalesce(F.max(F.when(F.col("above") >= k, F.col("low"))), F.lit(0.0)).alias("reached"))
    return Index(postings, bands.select("term", "band", "top", "parts"), stored(terms, "terms"), k)


def asked_terms(questions: DataFrame, text: str = "question") -> DataFrame:
    """(question_id, term): the distinct words of each question."""
    return questions.select("question_id", F.explode(F.array_distinct(words(F.col(text)))).alias("term"))


def scores(pairs: DataFrame, asked: DataFrame, found: Index) -> DataFrame:
    """(question_id, chunk_id, score) of pairs (question_id, chunk_id); a pair without a common word has none."""
    wanted = pairs.select("question_id", "chunk_id").join(asked, "question_id")
    impacts = found.postings.select("term", "chunk_id", "impact")
    return wanted.join(impacts, ["term", "chunk_id"]).groupBy("question_id", "chunk_id").agg(F.round(F.sum("impact"), 6).alias("score"))


def candidates(asked: DataFrame, found: Index) -> DataFrame:
    """(question_id, chunk_id): every chunk that can be among a question's k best, and few others."""
    known = asked.join(found.terms, "term")
    every = Window.partitionBy("question_id")
    rising = every.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0)
    bound = known.select("question_id", "term", "top", F.max("reached").over(every).alias("least"), F.sum("top").over(rising).alias("upto"), F.sum("top").over(every).alias("most"))
    needed = bound.filter(F.col("upto") >= F.col("least") - _SLACK).select("question_id", "term", (F.col("least") - (F.col("most") - F.col("top")) - _SLACK).alias("at_least"))
    read = needed.join(found.bands, "term").filter(F.col("top") >= F.col("at_least"))
    parts = read.select("question_id", "term", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return parts.join(found.postings.select("term", "band", "part", "chunk_id"), ["term", "band", "part"]).select("question_id", "chunk_id").distinct()


def _best(k: int):
    """Streams rows (cell, kind, id, word, value), the words of the questions (kind 0) of a cell before the postings of its chunks."""

    def hits(asked: np.ndarray, postings: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        # asked (question_id, word, times), postings (chunk_id, word) with their impacts: the k best of each question, ties by chunk_id.
        ids, at = np.unique(postings[0], return_inverse=True)
        order = np.argsort(postings[1], kind="stable")
        at, impact, words = at[order], values[order], postings[1][order]
        asked = asked[:, np.argsort(asked[0], kind="stable")]
        low, high = np.searchsorted(words, asked[1], "left"), np.searchsorted(words, asked[1], "right")
        edge = np.flatnonzero(np.r_[True, asked[0][1:] != asked[0][:-1]])
        out = []
        for lo, hi in zip(edge, [*edge[1:], len(asked[0])]):
            lists = [(at[a:b], impact[a:b] * n) for a, b, n in zip(low[lo:hi], high[lo:hi], asked[2][lo:hi]) if a < b]
            if not lists:
                continue
            total = np.bincount(np.concatenate([x for x, _ in lists]), np.concatenate([x for _, x in lists]), len(ids))
            found = np.flatnonzero(total)
            score = np.floor(total[found] * 1e6 + 0.5) / 1e6
            if len(found) > k:
                among = score >= np.partition(score, len(score) - k)[len(score) - k]
                found, score = found[among], score[among]
            first = np.lexsort((found, -score))[:k]
            out.append((np.full(len(first), asked[0][lo]), ids[found[first]], score[first]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["question_id", "chunk_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, ([], [])

        def close() -> Iterator[pa.RecordBatch]:
            if all(held):
                asked, postings = (np.concatenate([h[0] for h in side], axis=1) for side in held)
                times, values = (np.concatenate([h[1] for h in side]) for side in held)
                yield from hits(np.vstack([asked, times.astype(np.int64)]), postings, values)

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)], axis=1)
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else []
            for lo, hi in zip(edge, [*edge[1:], len(key)]):
                if key[lo, 0] != cell:
                    yield from close()
                    cell, held = key[lo, 0], ([], [])
                part = batch.slice(lo, hi - lo)
                held[key[lo, 1]].append((np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]), part.column(4).to_numpy(zero_copy_only=False)))
        yield from close()

    return run


def _held(asked: DataFrame, found: Index, postings: int, k: int) -> DataFrame:
    """(question_id, chunk_id, score): the k best of each question in each part of the chunks, on a grid of blocks of questions and
    parts of the postings of asked terms (so many are to be dealt out). A task holds a block and a part."""
    times = asked.groupBy("question_id", "term").agg(F.count("*").cast("double").alias("times"))
    words = stored(asked.select("term").distinct().join(found.terms.select("term", "df"), "term").withColumn("word", F.monotonically_increasing_id()), "words")
    blocks = max(1, -(-asked.select("question_id").distinct().count() // BLOCK))
    parts = max(asked.sparkSession.sparkContext.defaultParallelism // blocks, -(-postings // PART), 1)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("block") * parts + F.col("part")).alias("cell")
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    sides = [
        times.join(words, "term").select(F.col("question_id").cast("long").alias("id"), "word", F.col("times").alias("value"), dealt("question_id", blocks).alias("block"), spread(parts).alias("part")),
        spread_join(found.postings.select("term", "chunk_id", "impact"), words, ["term"], "df", ["chunk_id"]).select(F.col("chunk_id").cast("long").alias("id"), "word", F.col("impact").alias("value"), dealt("chunk_id", parts).alias("part"), spread(blocks).alias("block")),
    ]
    questions, chunks = (df.filter("id is not null").select(cell, F.lit(kind).alias("kind"), "id", "word", "value") for kind, df in enumerate(sides))
    grid = questions.unionByName(chunks).repartition(blocks * parts, "cell").sortWithinPartitions("cell", "kind")
    return grid.mapInArrow(_best(k), "question_id long, chunk_id long, score double")


def bm25(questions: DataFrame, found: Index, k: int = 20) -> DataFrame:
    """(question_id, chunk_id, score, rn): the k best chunks of each question (question_id, question) that share a word with it,
    ties by chunk_id."""
    if k > found.k:
        raise ValueError(f"the index is made for {found.k} hits at most")
    asked = stored(asked_terms(questions), "asked")
    postings = asked.select("term").distinct().join(found.terms, "term").agg(F.sum("df").alias("held")).crossJoin(asked.join(found.terms, "term").agg(F.sum("df").alias("read"))).first()
    met = _held(asked, found, postings["held"], k) if (postings["read"] or 0) > LOOKUPS else scores(candidates(asked, found), asked, found)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return met.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)
