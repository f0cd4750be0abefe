"""Retrieval and citation quality, and comparison of runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed quality targets.
TARGETS = {"faithfulness": 0.85, "context_precision": 0.80, "context_recall": 0.75, "answer_relevancy": 0.85, "answer_correctness": 0.80}


def retrieval(hits: DataFrame, golden: DataFrame, k: int) -> DataFrame:
    """(question_id, context_precision, context_recall) of the first k hits against the golden chunks."""
    found = hits.filter(F.col("rn") <= k).join(golden.withColumn("hit", F.lit(1)), ["question_id", "chunk_id"], "left")
    by_q = found.groupBy("question_id").agg(F.count("hit").alias("n_hit"))
    total = golden.groupBy("question_id").agg(F.count("*").alias("n_relevant"))
    return total.join(by_q, "question_id", "left").select("question_id", F.round(F.coalesce("n_hit", F.lit(0)) / k, 6).alias("context_precision"), F.round(F.coalesce("n_hit", F.lit(0)) / F.col("n_relevant"), 6).alias("context_recall"))


def citation_validity(references: DataFrame, resolved: DataFrame) -> DataFrame:
    """(question_id, n_cited, n_resolved, share): cited ids and those that resolve."""
    known = resolved.select("question_id", F.col("element_id").alias("ref_id"), F.lit(1).alias("ok"))
    return references.join(known, ["question_id", "ref_id"], "left").groupBy("question_id").agg(F.count("*").alias("n_cited"), F.count("ok").alias("n_resolved"), F.round(F.count("ok") / F.count("*"), 6).alias("share"))


def compare(now: DataFrame, before: DataFrame, targets: DataFrame) -> DataFrame:
    """(metric, value, previous, change, below): metrics of two runs, flagged where they miss their target."""
    joined = now.join(before.withColumnRenamed("value", "previous"), "metric", "left").join(targets, "metric", "left")
    return joined.select("metric", "value", "previous", F.round(F.col("value") - F.col("previous"), 6).alias("change"), F.coalesce(F.col("value") < F.col("target"), F.lit(False)).alias("below"))


def latency(events: DataFrame, key: str, seconds: str, share: float = 0.95) -> DataFrame:
    return events.groupBy(key).agg(F.round(F.percentile(F.col(seconds), share), 6).alias("p95"), F.count("*").alias("n"))


#: Size of a quantile sketch, and by how much of all values the rank of its quantiles may be off (at 99 % confidence 0.003).
SKETCH_SIZE, RANK_ERROR = 1600, 0.006


def sketched(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, sketch): a quantile sketch of a bounded size for each key, made where the rows are and merged. Sketches of
    parts (hours, runs) can be stored and merged again, so past values are not read a second time."""
    return events.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_SIZE)).alias("sketch"))


def quantiles(sketches: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """(keys, quantile, n) of sketches, those of a key merged; the quantile's rank is within RANK_ERROR of share."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*keys, F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias("quantile"), F.kll_sketch_get_n_double("sketch").alias("n"))


def answer_report(answers: DataFrame, references: DataFrame, resolved: DataFrame, text: str = "response", chars_a_token: int = 4) -> DataFrame:
    """One row for a run: n_answers, unsupported_rate (answers that cite nothing that resolves), n_tokens, tokens_a_query."""
    backed = citation_validity(references, resolved).filter("n_resolved > 0").select("question_id", F.lit(True).alias("backed"))
    each = answers.select("question_id", F.floor(F.length(text) / chars_a_token).alias("tokens")).join(backed, "question_id", "left")
    return each.agg(F.count("*").alias("n_answers"), F.round(F.avg(F.col("backed").isNull().cast("double")), 6).alias("unsupported_rate"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"), F.round(F.avg("tokens"), 6).alias("tokens_a_query"))


def exact_quantile(rows: DataFrame, value: str, share: float = 0.5):
    """The least value that at least a share of the values of rows do not exceed; None where there is none.

    A sketch names a narrow band of values that holds it, so only that band is
    sorted, over the cluster; should the sketch have been unlucky, all are.
    """
    known = rows.select(F.col(value).alias("v")).filter("v is not null")
    at = lambda x: F.kll_sketch_get_quantile_double("s", F.lit(min(max(x, 0.0), 1.0)))
    ends = known.agg(F.kll_sketch_agg_double(F.col("v").cast("double"), F.lit(SKETCH_SIZE)).alias("s"), F.count("*").alias("n"))
    ends = ends.filter("n > 0").select("n", at(share - 2 * RANK_ERROR).alias("lo"), at(share + 2 * RANK_ERROR).alias("hi")).first()
    if ends is None:
        return None
    place = max(1, math.ceil(share * ends["n"]))
    v = F.col("v").cast("double")
    under, within = known.agg(F.count_if(v < ends["lo"]), F.count_if(v.between(ends["lo"], ends["hi"]))).first()
    if under < place <= under + within:
        known, place = known.filter(v.between(ends["lo"], ends["hi"])), place - under
    return known.orderBy("v").offset(place - 1).limit(1).first()[0]
