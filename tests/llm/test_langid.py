from pyspark.sql import functions as F

from docweave.llm import langid, queries


def test_held_out_accuracy(spark):
    got = queries.op8_viterbi_language(spark, "/root/testdata/sf0.01").filter("held_out").alias("p").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert got.filter("score < 0 or score > 1").count() == 0


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    part = {r.lang: r.text[:300] for r in docs.filter("n_chars > 400").dropDuplicates(["lang"]).collect()}
    mixed = spark.createDataFrame([(1, f"{part['en']} {part['fr']} {part['de']}")], "doc_id long, text string")
    spans = langid.labelled(mixed, model).first().lang_spans
    assert [s.lang for s in spans] == ["en", "fr", "de"]


def test_paths_match_plain_viterbi(spark):
    import numpy as np

    model = langid.Model(["a", "b", "c"], np.ones((3, langid.BUCKETS)), np.ones((3, langid.SCRIPTS)))
    rng = np.random.default_rng(2)
    scores = (rng.normal(size=(60, 3)) * 9).astype(np.float32)
    first = np.array([0, 0, 25, 26, 60])
    got = model.paths(scores, first)
    for lo, hi in zip(first, first[1:]):
        if lo == hi:
            continue
        best, back = scores[lo].copy(), []
        for s in scores[lo + 1 : hi]:
            move = best[None, :] - langid.SWITCH * (1 - np.eye(3, dtype=np.float32))
            back.append(move.argmax(1))
            best = move.max(1) + s
        path = [int(best.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        value = lambda p: sum(scores[lo + i, x] for i, x in enumerate(p)) - langid.SWITCH * sum(x != y for x, y in zip(p, p[1:]))
        assert abs(value(path[::-1]) - value(got[lo:hi].tolist())) < 1e-2


def test_edges(edge, empty):
    model = langid.train(edge.filter("lang is not null"))
    rows = langid.labelled(edge, model).collect()
    assert len(rows) == edge.count()
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 10)} == {1: "und", 2: "und", 3: "und", 10: "und"}
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.labelled(edge, nothing).collect()} == {"und"}
    assert langid.labelled(empty, model).count() == 0
