"""Reading and writing the engine's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHUNK).parquet(path)


def nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.NODE).parquet(path)


def union_nodes(*by_tag: DataFrame) -> DataFrame:
    """One table of nodes from one table a tag, whatever columns each has."""
    out = by_tag[0]
    for more in by_tag[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PARENT_OF).parquet(path)


def documents_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row an element of extracted documents, with the document's metadata and the element's place `pos`; a file holds a
    document or, without multi_line, one on each line."""
    rows = spark.read.schema(schemas.EXTRACTED).option("multiLine", multi_line).json(path)
    return rows.select("metadata.*", F.posexplode("elements").alias("pos", "element")).select("filename", "type_file", "total_pages", "pos", "element.*")


def golden(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row a golden chunk of a question."""
    return spark.read.schema(schemas.GOLDEN).option("multiLine", multi_line).json(path).select("question", "expected_answer", F.explode_outer("chunk_ids").alias("chunk_id"))


def media(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(object_name, length, content) of the files below path; the content is read only if it is selected. Files of no bytes are not
    seen by the reader and so count as missing."""
    root = path.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.substring_index("path", root.split(":", 1)[-1].lstrip("/"), -1).alias("object_name"), "length", "content")


def write_objects(objects: DataFrame, path: str) -> None:
    """Writes (object_name, content binary) below path, one file an object, by the tasks that hold the rows.

    Names that are null or not safe are left out. A file is written aside and
    renamed, so a task that runs again leaves one whole object.
    """
    safe = objects.filter(T.is_object_name(F.col("object_name"))).select("object_name", "content")

    def put(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}") if not path.startswith("file:/") else (fs.LocalFileSystem(), path.split(":", 1)[1])
        root = "/" + root.lstrip("/")
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{root}/{name}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                aside = f"{target}.{uuid.uuid4().hex}"
                with store.open_output_stream(aside) as out:
                    out.write(content or b"")
                store.move(aside, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    safe.mapInArrow(put, "n long").agg(F.sum("n")).collect()


def with_media(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Image references with the stored object; unsafe names and missing objects stay, with nulls."""
    name = F.when(T.is_object_name(F.col("object_name")), F.col("object_name"))
    return refs.withColumn("__name", name).join(objects.withColumnRenamed("object_name", "__found"), F.col("__name") == F.col("__found"), "left").drop("__name", "__found")


def response_deltas(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deltas (thread_id, seq, token) before the line that ends each thread, error lines) of NDJSON (thread_id, seq, value)."""
    parsed = lines.withColumn("p", F.from_json("value", schemas.RESPONSE_LINE))
    ends = parsed.filter("p.done").groupBy("thread_id").agg(F.min("seq").alias("stop"))
    deltas = parsed.filter("p.error is null").join(ends, "thread_id", "left").filter("stop is null or seq <= stop")
    return deltas.select("thread_id", "seq", F.coalesce("p.message.content", F.lit("")).alias("token")), parsed.filter("p.error is not null or p is null").select("thread_id", "seq", "value")


def decoded(value: Column) -> Column:
    """An event line `data: {...}` as (token, reset, done, answer); other lines are null."""
    return F.when(value.startswith("data:"), F.from_json(F.trim(F.substring(value, 6, 1 << 30)), schemas.EVENT_LINE))


def encoded(kind: Column, payload: Column) -> Column:
    """The event line of a kind and payload."""
    body = F.when(kind == "token", F.to_json(F.struct(payload.alias("token")))).when(kind == "reset", F.to_json(F.struct(F.lit(True).alias("reset")))).otherwise(F.to_json(F.struct(F.lit(True).alias("done"), payload.alias("answer"))))
    return F.concat(F.lit("data: "), body)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(o) for o in order))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(rows: DataFrame, path: str, key: str, partition: str, *order: str) -> None:
    """Replaces the rows of the keys that rows bring, the last of each key; repeating it changes nothing.

    The partitions that the new rows or the old rows of their keys lie in are
    written anew, so a key that moves leaves its old partition. One writer at a
    time; a reader may see some partitions before others.
    """
    spark = rows.sparkSession
    new, emptied = rows, []
    if _exists(spark, path):
        old = spark.read.parquet(path).select(*rows.columns)
        moved = old.join(rows.select(key).distinct(), key, "left_semi").select(partition)
        touched = moved.unionByName(rows.select(partition)).distinct()
        new = old.join(touched, partition, "left_semi").select(*rows.columns).unionByName(rows)
        emptied = moved.distinct()
    kept = latest(new, key, *order)
    aside = f"{path.rstrip('/')}__new-{uuid.uuid4().hex}"
    kept.write.parquet(aside)
    kept = spark.read.schema(kept.schema).parquet(aside)
    # Partitions from which all rows have moved away, a list no longer than that of the partitions.
    gone = [r[0] for r in emptied.join(kept.select(partition).distinct(), partition, "left_anti").collect()] if emptied else []
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    jvm = spark.sparkContext._jvm
    for value in gone:
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(partition, None if value is None else str(value))
        _delete(spark, f"{path.rstrip('/')}/{name}")
    _delete(spark, aside)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def replace_documents(rows: DataFrame, path: str, partition: str) -> None:
    """Writes the documents that rows hold anew and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def readiness(sources: dict[str, DataFrame]) -> DataFrame:
    """(status, services): every source has rows -> ok, else degraded."""
    first, *more = [df.limit(1).agg(F.lit(name).alias("name"), (F.count("*") > 0).alias("up")) for name, df in sources.items()]
    for df in more:
        first = first.unionByName(df)
    return first.agg(F.when(F.bool_and("up"), "ok").otherwise("degraded").alias("status"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "up")))).alias("services"))


def catalog(nodes_: DataFrame, n: int = 50) -> DataFrame:
    return nodes_.filter("tag = 'Document'").select("node_id", "filename").orderBy("node_id").limit(n)


def with_history(questions: DataFrame, messages: DataFrame, n: int = 6) -> DataFrame:
    """questions (question_id, ...) with `history`, the last n messages of the thread of that name, in order."""
    last = Window.partitionBy("thread_id").orderBy(F.desc("turn"))
    kept = messages.withColumn("__n", F.row_number().over(last)).filter(F.col("__n") <= n)
    listed = kept.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("history"))
    none = F.array().cast(listed.schema["history"].dataType)
    return questions.join(listed, F.col("question_id") == F.col("thread_id"), "left").drop("thread_id").withColumn("history", F.coalesce("history", none))


def thread_state(events: DataFrame) -> DataFrame:
    """(thread_id, seq, kind): the last event of each thread, which says whether it is open."""
    return events.groupBy("thread_id").agg(F.max_by(F.struct("seq", "kind"), "seq").alias("last")).select("thread_id", "last.*")


def updated_state(state: DataFrame, events: DataFrame) -> DataFrame:
    """state after more events, which may be late or repeated."""
    return thread_state(state.unionByName(events.select("thread_id", "seq", "kind")))
