"""Recall of the coded search with a short list that is a small share of the chunks."""

import numpy as np

from docweave.operators import retrieve


def test_recall_with_a_short_list_of_a_hundredth(spark):
    x = np.random.default_rng(3).normal(size=(4000, 32))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "chunk_id long, embedding array<float>")
    asked = v.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "question_id")
    books = retrieve.codebooks(v, 32)
    found, _ = retrieve.knn_coded(asked, v, retrieve.coded(v, books, 32), books, k=20, shortlist=40)
    assert retrieve.recall(found, retrieve.knn(asked, v, 20)).first()["recall"] >= 0.95
