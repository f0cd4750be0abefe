"""Versioned tables, changed files, state of threads, corpora from JSON, sketches."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docweave.operators import evaluate
from docweave.plans import pipelines
from docweave.sources import tables, versioned
from docweave.streaming import threads


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_versions_upserts_and_replacements(spark, tmp_path):
    table, schema = versioned.Table(spark, f"{tmp_path}/t", "id", 4), "id long, v int, text string"
    with pytest.raises(ValueError):
        table.read()
    assert table.upsert(spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "a2")], schema), "v") == 1
    new = spark.createDataFrame([(1, 0, "late"), (3, 1, "c"), (2, 5, None)], schema)
    for n in (2, 3):
        assert table.upsert(new, "v") == n
        assert rows_of(table.read().select("id", "v")) == [(1, 2), (2, 5), (3, 1)]
    assert rows_of(table.read(1)) == [(1, 2, "a2"), (2, 1, "b")]
    table.replace(spark.createDataFrame([(2, 7, "x"), (2, 8, "y")], schema))
    assert rows_of(table.read()) == [(1, 2, "a2"), (2, 7, "x"), (2, 8, "y"), (3, 1, "c")]
    table.upsert(spark.createDataFrame([], schema), "v")
    assert table.read().count() == 4
    assert table.vacuum(keep=1) > 0 and table.read().count() == 4
    assert [p for p in os.listdir(tmp_path / "t") if p.startswith("_aside")] == []


def test_a_writer_that_fails_leaves_the_last_version(spark, tmp_path, monkeypatch):
    table = versioned.Table(spark, f"{tmp_path}/t", "id", 2)
    table.upsert(spark.createDataFrame([(1, 1), (2, 1)], "id long, v int"), "v")

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(versioned.Table, "_publish", fails)
    with pytest.raises(RuntimeError):
        table.upsert(spark.createDataFrame([(1, 2), (3, 2)], "id long, v int"), "v")
    assert table.version() == 1 and rows_of(table.read()) == [(1, 1), (2, 1)]
    monkeypatch.undo()
    assert table.upsert(spark.createDataFrame([(1, 2), (3, 2)], "id long, v int"), "v") == 2
    assert rows_of(table.read()) == [(1, 2), (2, 1), (3, 2)]


def test_two_writers_from_one_version(spark, tmp_path, monkeypatch):
    table = versioned.Table(spark, f"{tmp_path}/t", "id", 2)
    table.upsert(spark.createDataFrame([(1, 1)], "id long, v int"), "v")
    publish, raced = versioned.Table._publish, []

    def late(self, version, manifest):
        if not raced:
            raced.append(True)
            table.upsert(spark.createDataFrame([(2, 1)], "id long, v int"), "v")
        publish(self, version, manifest)

    monkeypatch.setattr(versioned.Table, "_publish", late)
    assert versioned.Table(spark, f"{tmp_path}/t", "id", 2).upsert(spark.createDataFrame([(3, 1)], "id long, v int"), "v") == 3
    assert rows_of(table.read()) == [(1, 1), (2, 1), (3, 1)]


def test_only_changed_files_are_read(spark, tmp_path):
    src, schema = tmp_path / "src", "id long, v int"
    src.mkdir()
    table = versioned.Table(spark, f"{tmp_path}/t", "id", 2)
    put = lambda name, rows, at: (pd.DataFrame(rows, columns=["id", "v"]).astype({"v": "int32"}).to_parquet(src / name), os.utime(src / name, (at, at)))
    put("a.parquet", [(1, 1)], 1000)
    put("b.parquet", [(2, 1)], 1000)
    assert versioned.ingest(spark, f"{src}", schema, table, "v") == 2
    assert versioned.ingest(spark, f"{src}", schema, table, "v") == 0 and table.version() == 1
    (src / "a.parquet").write_bytes(b"not parquet any more")  # unchanged by its time, so never opened
    os.utime(src / "a.parquet", (1000, 1000))
    put("b.parquet", [(2, 2), (4, 2)], 2000)
    put("c.parquet", [(3, 1)], 2000)
    assert versioned.ingest(spark, f"{src}", schema, table, "v") == 2
    assert rows_of(table.read()) == [(1, 1), (2, 2), (3, 1), (4, 2)]
    assert table.side("cursor").count() == 3


def test_silent_threads_are_forgotten(spark, tmp_path):
    schema = "thread_id string, seq long, kind string, payload string"
    src = f"{tmp_path}/events"
    spark.createDataFrame([], schema).write.parquet(src)
    put = lambda *rows: lambda: spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    arrivals = [put(("a", 1, "token", "x")), put(("b", 1, "token", "y")), put(("a", 2, "token", "z"))]
    stream = threads.accumulated(spark.readStream.schema(schema).parquet(src), wait_ms=1)
    texts = [r.text for r in threads.landed(stream, f"{tmp_path}/out", "update", arrivals, idle=False).filter("thread_id = 'a'").orderBy("batch").collect()]
    assert texts == ["x", "z"]
    kept = threads.accumulated(spark.readStream.schema(schema).parquet(src))
    assert {r.thread_id: r.text for r in threads.landed(kept, f"{tmp_path}/kept", "update").collect()} == {"a": "xz", "b": "y"}


def test_objects_written_and_read(spark, tmp_path):
    rows = [("images/a.png", b"one"), ("images/deep/b.png", b"two"), ("../out.png", b"no"), (None, b"no")]
    tables.write_objects(spark.createDataFrame(rows, "object_name string, content binary"), f"{tmp_path}/m")
    found = tables.media(spark, f"{tmp_path}/m")
    assert sorted((r.object_name, bytes(r.content)) for r in found.collect()) == [("images/a.png", b"one"), ("images/deep/b.png", b"two")]
    assert "content" not in found.select("object_name", "length")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_build_from_extracted_json(spark, tmp_path):
    box = lambda left, top: {"l": left, "t": top, "r": left + 1, "b": top + 1}
    elements = [
        {"label": "section_header", "text": "1 Intro", "page_no": 1}, {"label": "text", "text": "Hello", "page_no": 1}, {"label": "picture", "text": "", "page_no": 1, "bbox": box(10, 10), "minio_url": "http://store/bucket/own.png"},
        {"label": "table", "text": "a|b", "page_no": 1, "bbox": box(500, 500)}, {"label": "caption", "text": "Figure 1", "page_no": 1, "bbox": box(20, 30)}, {"label": "caption", "text": "Far", "page_no": 1, "bbox": box(5000, 0)},
        {"label": "section_header", "text": "1.1 Deeper", "page_no": 2}, {"label": "code", "text": "x = 1", "content": "raw", "page_no": 2}, {"text": None, "label": None},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {"filename": "paper", "type_file": "pdf"}, "elements": elements}, indent=1))
    (tmp_path / "none.json").write_text(json.dumps({"metadata": {"filename": "empty"}, "elements": []}))
    built = pipelines.build_extracted(tables.documents_json(spark, f"{tmp_path}"), base_url="s3://media/")
    rows = {r.ord: r for r in built["elements"].collect()}
    assert [rows[i].line for i in range(9)] == ["1 Intro", "Hello", "Figure 1", "", "Figure 1", "Far", "1.1 Deeper", "x = 1", ""]
    assert [rows[i].par_ord for i in range(9)] == [None, 0, 0, 0, 0, 0, 0, 6, 6] and rows[3].content == "a|b" and rows[7].content == "raw"
    assert [(rows[i].page_no, rows[i].page_position, rows[i].ref_position) for i in (0, 4, 6, 8)] == [(1, 0, 0), (1, 4, 3), (2, 0, 5), (1, 6, 1)]
    assert [(r.src, r.dst) for r in built["linked_to"].collect()] == [(rows[4].id, rows[2].id)]
    urls = {r.node_id: r.minio_url for r in built["nodes"].collect()}
    assert urls[rows[2].id] == "http://store/bucket/own.png" and urls[rows[3].id].startswith("s3://media/images/doc_paper/") and "doc_paper" in urls
    assert {r.dst: r.src for r in built["parent_of"].collect()}[rows[7].id] == rows[6].id
    assert built["chunks"].count() == 7


def test_sketches_are_as_near_as_stated(spark):
    events = spark.range(200_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 7).alias("part"), F.pow(F.col("id") % 9973, F.lit(2)).alias("v"))
    found = evaluate.quantiles(evaluate.sketched(events, ["k", "part"], "v"), ["k"], 0.95).collect()
    assert sum(r.n for r in found) == 200_000
    for r in found:
        rank = events.filter((F.col("k") == r.k) & (F.col("v") <= r["quantile"])).count() / r.n
        assert abs(rank - 0.95) <= evaluate.RANK_ERROR


def test_exact_quantiles(spark, monkeypatch):
    import math

    rows = spark.range(5000).select(F.when(F.col("id") % 9 != 0, (F.col("id") * 7919) % 1009).alias("v"))
    plain = sorted(i * 7919 % 1009 for i in range(5000) if i % 9)
    for share in (0.0, 0.01, 0.5, 0.95, 1.0):
        want = plain[max(1, math.ceil(share * len(plain))) - 1]
        assert evaluate.exact_quantile(rows, "v", share) == want
    monkeypatch.setattr(evaluate, "RANK_ERROR", -0.1)  # a band that misses it
    assert evaluate.exact_quantile(rows, "v", 0.5) == plain[math.ceil(0.5 * len(plain)) - 1]
    assert evaluate.exact_quantile(rows.filter("v is null"), "v") is None
