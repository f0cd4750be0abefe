"""Exact deduplication as a stateful stream.

Rows arrive as a stream of (digest, identifier, size, locator). A keyed
aggregation without watermark keeps, for each digest, the best row's
identifier and content locator and how many rows came; its state never expires
and lives on disk (RocksDB, saved to the shared folder with every batch). A
key's rows are combined before they are shuffled, so a digest that holds a
third of all rows costs one state row per task. The arrivals come in several
micro-batches, each of which restores what the earlier ones left. Where a
digest was hit more than once, the least and the greatest of its whole
normalised texts are compared (combined before they are shuffled), and should
they differ the digest is split by its texts. Only DataFrame operations are
used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .text import may_be_in, meet, shared_dir, staged

#: State on disk. Stores are many and small, so they don't allocate space ahead, and a batch saves its changes only.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Micro-batches that the arrivals are dealt to at least, if they come in so many files.
BATCHES = 3


def without_space(text: Column) -> Column:
    """text without the six ASCII white-space characters; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def digest_of(plain: Column) -> Column:
    return F.sha2(plain, 256)


def _best(size: str, row_id: str) -> Column:
    """Of the rows of a group, the one with the greatest size, then the smallest id."""
    return F.min_by(F.struct(F.col(row_id).alias("keep_id"), F.col("locator"), F.col(size).alias("keep_size")), F.struct((-F.col(size)).alias("size"), F.col(row_id).isNull().alias("none"), F.col(row_id).alias("id")))


def remembered(path: str, schema: StructType) -> DataFrame:
    """(digest, keep_id, locator, keep_size, group_size): the keyed state after the arrivals written at path have streamed through it."""
    spark = SparkSession.getActiveSession()
    root = f"{shared_dir(spark)}/exact-{uuid.uuid4().hex}"
    files = len(spark.read.schema(schema).parquet(path).inputFiles())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, files // BATCHES)).parquet(path)
    state = stream.groupBy("digest").agg(_best("size", "row_id").alias("best"), F.count("*").alias("group_size"))

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/state/batch={number}")

    before = {key: spark.conf.get(key, None) for key in _STATE}
    for key, value in _STATE.items():
        spark.conf.set(key, value)
    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{root}/stream").trigger(availableNow=True).foreachBatch(land).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    landed_as = f"digest string, best struct<keep_id:{schema['row_id'].dataType.simpleString()},locator:string,keep_size:int>, group_size long, batch long"
    spark.createDataFrame([], landed_as).drop("batch").write.parquet(f"{root}/state/batch=-1")
    landed = spark.read.schema(landed_as).parquet(f"{root}/state")
    # Each batch lands the digests it changed; the last one to do so holds their state.
    last = landed.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("last"))
    return last.select("digest", "last.best.keep_id", "last.best.locator", "last.best.keep_size", "last.group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, keep_locator) for each row of docs.

    Texts are equal when they are identical without ASCII white space; null
    counts as empty. Of equal texts the row with the most code points, then the
    smallest id, stays; a null id loses ties. Rows that repeat both id and length
    count each and share their fate. keep_locator is the file that holds the
    row that stays (empty where docs come from no file). A very long text is
    hashed and compared whole; an empty table gives no rows. Only the two named
    columns are read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    plain = docs.select("row_id", without_space(F.col("text")).alias("plain"), F.coalesce(F.length("text"), F.lit(0)).alias("size"), F.input_file_name().alias("locator"))
    arrivals = plain.select(digest_of(F.col("plain")).alias("digest"), "row_id", "size", "locator")
    root = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    arrivals.write.parquet(root)
    arrivals = spark.read.schema(arrivals.schema).parquet(root)
    state = staged(remembered(root, arrivals.schema), "state")

    # Whole texts of the digests that were hit again; other rows are not shuffled.
    cell = F.xxhash64("digest").alias("cell")
    texts = plain.select(digest_of(F.col("plain")).alias("digest"), "row_id", "plain", "size", "locator").select("*", cell)
    hit = may_be_in(texts, state.filter("group_size > 1").select(cell), "cell").filter("__may")
    wrong = staged(hit.groupBy("digest").agg(F.min("plain").alias("least"), F.max("plain").alias("most")).filter("least != most").select("digest"), "wrong")
    kept = F.col("row_id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size"))
    shown = lambda rows, locator: rows.select(F.col("row_id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"), F.col(locator).alias("keep_locator"))
    known = state.withColumnRenamed("locator", "keep_locator")
    if wrong.isEmpty():
        return shown(meet(arrivals, known, ["digest"], "group_size", ["row_id", "size"]), "keep_locator")
    split = texts.join(wrong, "digest")
    groups = split.groupBy("digest", "plain").agg(_best("size", "row_id").alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("digest", "plain", "best.keep_id", F.col("best.locator").alias("keep_locator"), "best.keep_size", "group_size")
    right = meet(arrivals.join(wrong, "digest", "left_anti"), known, ["digest"], "group_size", ["row_id", "size"])
    return shown(right, "keep_locator").unionByName(shown(split.join(groups, ["digest", "plain"]), "keep_locator"))
