"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame that run() writes as Parquet and reads again. All but
the last return the columns of documents. Every stage gives no rows for an
empty table, takes rows without id and rows that repeat, and works on a very
long text whole, in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import decontam, exactdedup, langid, queries, similar
from docweave.llm.text import fresh, staged
from docweave.session import ready, table

#: A text is rejected if it has no letter, if no language holds this share of its letters (which takes six languages
#: at least to happen), or if it fits its language less than langid.fit_bounds() asks for.
MIN_LANGUAGE_SCORE = 0.2

#: Bytes of rows that a Python worker is handed at once. The worker and the JVM hold several copies of them, and an executor
#: keeps what a stage took at its peak for all later ones.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def _bounded(spark: SparkSession) -> SparkSession:
    """Lowers the bytes of a batch for the session, unless it has a value of its own; a longer row is a batch of its own."""
    if ready(spark).conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return spark


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts that fit a learned language; the model and the bounds come from the labelled rows of docs.

    Texts that are null, empty or without a letter go, and all texts where no row is labelled. Repeated rows share their fate.
    """
    _bounded(spark)
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    taught = docs.filter(~langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("own_lang"), "text")
    learned = langid.labelled(taught, model, with_spans=False, with_fit=True).filter("own_lang = lang_pred")
    bounds = staged(langid.fit_bounds(learned), "bounds")
    columns = {c: f"own_{c}" for c in docs.columns}
    # Labelled twice, as a written copy of the labelled texts would take their size on disk.
    named = langid.labelled(docs.withColumnsRenamed(columns), model, "own_text", with_spans=False, with_fit=True)
    bounded = named.join(F.broadcast(bounds), "lang_pred", "left")
    fits = (F.col("fit") >= F.coalesce("min_fit", F.lit(0))) & (F.col("script_share") >= F.coalesce("min_script_share", F.lit(0)))
    kept = bounded.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE) & fits)
    return kept.select(*(F.col(f"own_{c}").alias(c) for c in docs.columns))


def _by_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs with one more column, its name), written: an identity of each row that orders by doc_id, nulls last, and then by
    place. Equal rows, rows without id and different texts with one id are all told apart by it."""
    row = fresh("row", docs.columns)
    place = F.monotonically_increasing_id().alias("at")
    return staged(docs.withColumn(row, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", place)), "rows"), row


def _without(rows: DataFrame, row: str, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """rows but for those whose identity is the doc_id of a dropped one."""
    gone = dropped.select(F.col("doc_id.at").alias("gone_at"))
    named = rows.select(F.struct(*columns).alias("own"), F.col(f"{row}.at").alias("own_at"))
    return named.join(gone, F.col("own_at") == F.col("gone_at"), "left_anti").select("own.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that are equal but for white space; null counts as empty.

    The longest text stays, then the smallest id (null last), then the first row.
    """
    _bounded(spark)
    rows, row = _by_row(docs)
    return _without(rows, row, exactdedup.exact_groups(rows, row).filter("not kept"), docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates (a similarity of 0.8 or more of their five-word shingles, found through
    fingerprints and confirmed): the smallest id (null last), then the first row.

    Texts without a word, null included, are a group of their own.
    """
    _bounded(spark)
    rows, row = _by_row(docs)
    return _without(rows, row, similar.near_duplicates(rows, row).filter("not kept"), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no test string of the benchmark; texts without a word hold none and stay."""
    return decontam.decontaminated(docs, table(_bounded(spark), sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the remaining documents lies in the training sequences; a text that is null or empty is one end token."""
    _bounded(spark)
    return queries.pack_documents(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontamination", decontamination), ("packing", packing)]

#: Language prediction, fingerprints and token ids can't be expressed in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
