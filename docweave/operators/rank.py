"""Second-stage ranking and grouping of hits by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reranked(hits: DataFrame, k: int = 10, score: str = "score", prior: str = "rn") -> DataFrame:
    """hits with rerank rank rr <= k: by score, descending, ties in their former order; a missing score counts as 0."""
    order = Window.partitionBy("question_id").orderBy(F.coalesce(score, F.lit(0.0)).desc(), prior)
    return hits.withColumn("rr", F.row_number().over(order)).filter(F.col("rr") <= k)


def at_least(ranked: DataFrame, score: float) -> DataFrame:
    """The ranked hits of a minimum score; the first of each question stays whatever it has."""
    return ranked.filter((F.col("score") >= score) | (F.col("rr") == 1))


def best(score: Column) -> Column:
    return F.coalesce(F.max(score), F.lit(0.0))


def by_document(ranked: DataFrame) -> DataFrame:
    """(question_id, filename, best_score, n_chunks, chunks, group_rank): groups by best score, first seen first; chunks by score."""
    chunk = F.struct((-F.coalesce("score", F.lit(0.0))).alias("order"), "rr", "chunk_id", "element_id", "score")
    groups = ranked.groupBy("question_id", "filename").agg(best(F.col("score")).alias("best_score"), F.count("*").alias("n_chunks"), F.min("rr").alias("seen"), F.array_sort(F.collect_list(chunk)).alias("chunks"))
    order = Window.partitionBy("question_id").orderBy(F.desc("best_score"), "seen")
    return groups.withColumn("group_rank", F.row_number().over(order)).drop("seen")
