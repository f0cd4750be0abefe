"""From answers to citations and images, selections, messages and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import scope


def references(responses: DataFrame, ids: Column) -> DataFrame:
    """(question_id, ref_id, ordinal): each id once, numbered by its first place in the text."""
    each = responses.select("question_id", F.posexplode(ids).alias("pos", "ref_id"))
    first = each.groupBy("question_id", "ref_id").agg(F.min("pos").alias("pos"))
    return first.withColumn("ordinal", F.row_number().over(Window.partitionBy("question_id").orderBy("pos"))).drop("pos")


def last_chunk(hits: DataFrame) -> DataFrame:
    """Of several chunks of an element the lowest-ranked one."""
    return hits.groupBy("question_id", "element_id").agg(F.max_by(F.struct("chunk_id", "filename", "page_no", "document", "minio_url"), "rr").alias("chunk"))


def citations(responses: DataFrame, hits: DataFrame, elements: DataFrame) -> DataFrame:
    """(question_id, ordinal, element_id, filename, page_no, text_excerpt): chunks first, else section elements; what resolves nowhere is dropped.

    elements: (question_id, node_id, filename, page_no, text, ord) of the sections of each question; the first of a node counts.
    """
    refs = references(responses, T.cited_ids(F.col("response"))).withColumnRenamed("ref_id", "element_id")
    first = elements.groupBy("question_id", F.col("node_id").alias("element_id")).agg(F.min_by(F.struct("filename", "page_no", "text"), "ord").alias("e"))
    found = refs.join(last_chunk(hits), ["question_id", "element_id"], "left").join(first, ["question_id", "element_id"], "left")
    pick = lambda a, b: F.when(F.col("chunk").isNotNull(), F.col(a)).otherwise(F.col(b))
    kept = found.filter("chunk is not null or e is not null").select("question_id", "ordinal", "element_id", F.coalesce(pick("chunk.filename", "e.filename"), F.lit("")).alias("filename"), F.coalesce(pick("chunk.page_no", "e.page_no"), F.lit(0)).alias("page_no"), T.cut(F.coalesce(pick("chunk.document", "e.text"), F.lit("")), 150).alias("text_excerpt"))
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy("question_id").orderBy("ordinal")))


def media_map(elements: DataFrame, hits: DataFrame) -> DataFrame:
    """(question_id, element_id, minio_url): the first URL of each element, section elements before chunks."""
    one = elements.filter("minio_url is not null").select("question_id", F.col("node_id").alias("element_id"), "minio_url", F.lit(0).alias("source"), F.col("ord").cast("long").alias("at"))
    two = hits.filter("minio_url is not null").select("question_id", "element_id", "minio_url", F.lit(1).alias("source"), F.col("rr").cast("long").alias("at"))
    return one.unionByName(two).groupBy("question_id", "element_id").agg(F.min_by("minio_url", F.struct("source", "at")).alias("minio_url"))


def images(responses: DataFrame, media: DataFrame) -> DataFrame:
    """(question_id, ordinal, element_id, minio_url as media path)."""
    refs = references(responses, T.pictured_ids(F.col("response"))).withColumnRenamed("ref_id", "element_id")
    found = refs.join(media, ["question_id", "element_id"]).withColumn("minio_url", T.media_path(F.col("minio_url")))
    return found.withColumn("ordinal", F.row_number().over(Window.partitionBy("question_id").orderBy("ordinal")))


def answered(responses: DataFrame, max_rounds: int = 3) -> DataFrame:
    """responses with next_query (null if none is asked for or the rounds are used up) and the answer without markers.

    `round` counts the retrievals so far, the first included.
    """
    asked = T.follow_up(F.col("response"))
    return responses.withColumn("next_query", F.when(F.col("round") < max_rounds, asked)).withColumn("answer", T.without_follow_ups(F.col("response")))


def selected(hits: DataFrame, selections: DataFrame, first_pass: bool = True, fallback: int = 3) -> DataFrame:
    """(question_id, element_id, ord): the selected hits in rank order; without selection, or on a later pass, the best three.
    Where hits say their doc_id, it stays beside the element."""
    order = Window.partitionBy("question_id").orderBy("rr", "chunk_id")
    key = ["question_id", *scope(hits), "element_id"]
    ranked = hits.groupBy(*key).agg(F.min("rr").alias("rr"), F.min("chunk_id").alias("chunk_id"))
    top = hits.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= fallback).groupBy(*key).agg(F.min("ord").alias("ord"))
    if not first_pass:
        return top
    chosen = ranked.join(selections.select("question_id", "element_id").distinct(), ["question_id", "element_id"], "left_semi").select(*key, F.row_number().over(order).alias("ord"))
    rest = top.join(chosen.select("question_id").distinct(), "question_id", "left_anti")
    return chosen.unionByName(rest)


def toggled(hits: DataFrame, selections: DataFrame, choices: DataFrame) -> DataFrame:
    """(question_id, element_id): selections after whole documents were switched on or off; choices are (question_id, filename, on)."""
    inside = hits.join(choices, ["question_id", "filename"]).select("question_id", "element_id", "on")
    kept = selections.select("question_id", "element_id").join(inside.filter("not on"), ["question_id", "element_id"], "left_anti")
    return kept.unionByName(inside.filter("on").drop("on")).distinct()


def selected_or_all(hits: DataFrame, selections: DataFrame) -> DataFrame:
    """(question_id, element_id): the selected elements among the hits, all of them for a question without selection."""
    each = hits.select("question_id", "element_id").distinct()
    picked = selections.select("question_id", "element_id").distinct()
    none = each.join(picked.select("question_id").distinct(), "question_id", "left_anti")
    return each.join(picked, ["question_id", "element_id"], "left_semi").unionByName(none)


def first_per_section(chosen: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Of (question_id, element_id, section_id, ord) the first element of each section that `seen` (question_id, section_id) doesn't hold."""
    key = ["question_id", *scope(chosen, *([] if seen is None else [seen])), "section_id"]
    order = Window.partitionBy("question_id", *scope(chosen), "section_id").orderBy("ord", "element_id")
    first = chosen.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
    return first if seen is None else first.join(seen.select(*key), key, "left_anti")


def last_messages(messages: DataFrame, n: int = 6) -> DataFrame:
    order = Window.partitionBy("thread_id").orderBy(F.desc("turn"))
    return messages.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n).drop("n")


def prompt_messages(prompts: DataFrame, history: DataFrame, system: str) -> DataFrame:
    """(thread_id, ord, role, content): system, history in order, user; prompts are (thread_id, prompt)."""
    head = prompts.select("thread_id", F.lit(-1).cast("long").alias("ord"), F.lit("system").alias("role"), F.lit(system).alias("content"))
    tail = prompts.select("thread_id", F.lit((1 << 62)).cast("long").alias("ord"), F.lit("user").alias("role"), F.col("prompt").alias("content"))
    middle = history.join(prompts.select("thread_id"), "thread_id", "left_semi").select("thread_id", F.col("turn").cast("long").alias("ord"), "role", "content")
    both = head.unionByName(middle).unionByName(tail)
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("thread_id").orderBy("ord")))


def appended(history: DataFrame, exchanges: DataFrame) -> DataFrame:
    """history with the pair (question, answer) of each thread added as its next two turns."""
    last = history.groupBy("thread_id").agg(F.max("turn").alias("last"))
    base = exchanges.join(last, "thread_id", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    pair = F.inline(F.array(F.struct((F.col("last") + 1).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct((F.col("last") + 2).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content"))))
    return history.unionByName(base.select("thread_id", pair))


def numbered(chosen: DataFrame) -> DataFrame:
    """The source number of each element in its question's prompt."""
    return chosen.withColumn("alias", F.dense_rank().over(Window.partitionBy("question_id").orderBy("ord", "element_id")))


def split_valid(rows: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows); a rule that is null counts as broken."""
    ok = F.coalesce(rule, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def within_budget(rows: DataFrame, budget: int, size: Column) -> DataFrame:
    """The rows of each question, by ord, whose running size stays within the budget."""
    run = Window.partitionBy("question_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(run)).filter(F.col("running") <= budget)


def since_reset(events: DataFrame) -> DataFrame:
    """(thread_id, text, n_tokens): tokens after the last reset of each thread, in order. events: (thread_id, seq, kind, payload)."""
    epochs = events.withColumn("epoch", F.sum((F.col("kind") == "reset").cast("int")).over(Window.partitionBy("thread_id").orderBy("seq")))
    last = epochs.groupBy("thread_id").agg(F.max("epoch").alias("epoch"))
    tokens = epochs.join(last, ["thread_id", "epoch"]).filter("kind = 'token'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda x: x["payload"]), "")
    return last.select("thread_id").join(tokens.groupBy("thread_id").agg(joined.alias("text"), F.count("*").alias("n_tokens")), "thread_id", "left").select("thread_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
