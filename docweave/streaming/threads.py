"""Streams of threads: event lines, tokens with reset, selections that resume waiting questions, repeated delivery, ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources import tables


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """The stream (token, reset, done, answer) of `data:` lines in the files that arrive at path."""
    lines = spark.readStream.text(path)
    return lines.select(tables.decoded(F.col("value")).alias("e")).filter("e is not null").select("e.*")


class Tokens(StatefulProcessor):
    """A thread's tokens as a map by seq, and beside it the seq of the last reset and whether it is done.

    A batch writes the tokens that it brings and no others; what is stored is
    read when the text is put together. A thread that hears nothing for
    `wait_ms` is forgotten.
    """

    def __init__(self, wait_ms: int | None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tokens = handle.getMapState("tokens", "seq long", "payload string")
        self.mark = handle.getValueState("mark", "floor long, done boolean")

    def handleInputRows(self, key, rows, timerValues):
        floor, done = self.mark.get() if self.mark.exists() else (-1, False)
        if done:
            for _ in rows:  # late events of a finished thread
                pass
            return
        held = {k[0]: v[0] for k, v in self.tokens.iterator()} if self.tokens.exists() else {}
        events = pd.concat(list(rows)).sort_values("seq")
        for seq, kind, payload in zip(events["seq"].tolist(), events["kind"], events["payload"]):
            if done or seq <= floor or seq in held:
                continue
            if kind == "reset":
                floor = seq
                for k in [k for k in held if k < seq]:
                    del held[k]
                    self.tokens.removeKey((k,))
            elif kind == "done":
                done = True
                held = {k: v for k, v in held.items() if k < seq}
            else:
                held[seq] = payload or ""
                self.tokens.updateValue((seq,), (held[seq],))
        self.mark.update((floor, done))
        if done:
            self.tokens.clear()
        if self.wait_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not done:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        order = sorted(held)
        yield pd.DataFrame({"thread_id": [key[0]], "text": ["".join(held[k] for k in order)], "n_tokens": [len(order)], "done": [done]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.tokens.clear()
        self.mark.clear()
        return iter(())

    def close(self) -> None:
        pass


def accumulated(events: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """(thread_id, text, n_tokens, done) after each batch, for streams of (thread_id string, seq long, kind, payload).

    A reset drops what has a smaller seq; tokens are joined in the order of
    seq, whichever batch brings them, so a late one takes its place; a seq that
    came before is ignored. After done nothing is added, and the state keeps no
    text. With wait_ms, a thread that is silent for so long is forgotten. The
    stream has to run with the state on disk, as landed() does.
    """
    mode = "None" if wait_ms is None else "ProcessingTime"
    return events.groupBy("thread_id").transformWithStateInPandas(Tokens(wait_ms), "thread_id string, text string, n_tokens long, done boolean", "update", mode)


def resumed(questions: DataFrame, selections: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Questions (thread_id, question, asked_at) joined with their selection (thread_id, element_ids, chosen_at), each thread
    once. A selection without a question, or one that comes later than `wait`, matches nothing."""
    q = questions.withWatermark("asked_at", wait).alias("q")
    s = selections.withWatermark("chosen_at", wait).dropDuplicatesWithinWatermark(["thread_id"]).alias("s")
    on = F.expr(f"q.thread_id = s.thread_id and s.chosen_at >= q.asked_at and s.chosen_at <= q.asked_at + interval {wait}")
    return q.join(s, on).select("q.thread_id", "question", "element_ids", "asked_at", "chosen_at")


def delivered_once(rows: DataFrame, key: str, time: str, within: str = "1 hour") -> DataFrame:
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, partition: str, *order: str, every: str | None = None):
    """Brings new and changed files at source into the target table, the last row of a key winning; a batch that is run again
    changes nothing. Runs once over what is there, or every so often (as '30 seconds')."""

    def land(batch: DataFrame, number: int) -> None:
        tables.upsert(batch, target, key, partition, *order)

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


#: State in RocksDB, whose size memory does not bound; a batch saves its changes only.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def started(writer: DataStreamWriter, spark: SparkSession, idle: bool = True) -> StreamingQuery:
    """Starts a stream with its state on disk. A stream takes its settings when it starts, so the session has its own again at once.
    Without idle, no batch runs for want of rows: a stream with timers that takes what is there would not end otherwise."""
    settings = STATE | {"spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower()}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def landed(stream: DataFrame, path: str, mode: str = "append", arrivals: Iterable[Callable[[], None]] = (lambda: None,), idle: bool = True) -> DataFrame:
    """The rows of every micro-batch, with its number in `batch`: after each arrival the stream takes what is there and ends,
    and the next goes on from its checkpoint."""
    spark = stream.sparkSession

    def land(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    for arrive in arrivals:
        arrive()
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(land)
        started(writer, spark, idle).awaitTermination()
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows/batch=-1")
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/rows")
