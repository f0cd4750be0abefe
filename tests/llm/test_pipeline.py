import sys

import pyarrow as pa
import pytest
import test_decontam
import test_exactdedup
import test_similar
from pyspark.sql import functions as F

from docweave.llm import langid, similar


@pytest.fixture(scope="module")
def pipeline(request):
    root = str(request.config.rootpath)
    if root not in sys.path:
        sys.path.insert(0, root)
    import corpus_pipeline

    return corpus_pipeline


def test_run_matches_plain_stages(spark, sf, documents, pipeline):
    got = {r.doc_id for r in pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    model = langid.train(documents.filter(~langid.held_out(F.col("doc_id"))))
    named = langid.labelled(documents, model, with_spans=False)
    rows = [(r.doc_id, r.text) for r in named.filter(f"lang_pred != 'und' and score >= {pipeline.MIN_LANGUAGE_SCORE}").collect()]
    keep = {r[0] for r in test_exactdedup.expected(rows) if r[3]}
    rows = [r for r in rows if r[0] in keep]
    keep = {r[0] for r in test_similar.expected(rows) if r[3]}
    rows = [r for r in rows if r[0] in keep]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got == {r[0] for r in test_decontam.expected(rows, items) if not r[5]}


def test_stages_keep_columns_and_stand_edge_rows(spark, sf, edge, empty, pipeline):
    for docs in (edge, empty):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
    assert pipeline.STAGES[-1][1](spark, empty, sf).count() == 0
    assert similar.near_duplicates(edge).count() == edge.count()


def test_columns_of_any_name_stay(spark, sf, edge, pipeline):
    docs = edge.select("*", *(F.lit(i).alias(c) for i, c in enumerate(["__at", "__row", "row", "own", "gone_at", "__gone"])))
    for stage in (pipeline.exact, pipeline.near):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.select("row", "__at").distinct().collect() == [(2, 0)]


def test_language_rejects_unlearned_languages_and_noise(spark, sf, documents, pipeline):
    import random

    rng = random.Random(1)
    noise = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n))
    strange = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        *(noise(n) for n in (5, 40, 1000)),
    ]
    columns = ["doc_id", "text", "lang"]
    clean = documents.select(*columns)
    docs = clean.unionByName(spark.createDataFrame([(-1 - i, x, None) for i, x in enumerate(strange)], clean.schema))
    got = {r.doc_id for r in pipeline.language(spark, docs, sf).select("doc_id").collect()}
    assert not [x for i, x in enumerate(strange) if -1 - i in got]
    assert got == {r.doc_id for r in clean.filter("text rlike '\\\\p{L}'").collect()}


def test_dedup_stages_decide_by_row(spark, sf, edge, pipeline):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, long), (1, long), (2, f"{long}\n"), (None, long), (5, "alpha beta gamma delta"), (5, long), (6, "epsilon zeta eta theta"), (None, "iota kappa lambda mu"), (None, "iota kappa lambda mu")]
    want = [(2, f"{long}\n"), (5, "alpha beta gamma delta"), (6, "epsilon zeta eta theta"), (None, "iota kappa lambda mu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, pipeline.exact(spark, docs, sf).collect()), key=key) == sorted(want, key=key)
    want[0] = (1, long)
    assert sorted(map(tuple, pipeline.near(spark, docs, sf).collect()), key=key) == sorted(want, key=key)
    # Rows 1 to 3 have no word, two of the three rows "Word" repeat one; 6 and 7 are equal without white space.
    got = pipeline.exact(spark, edge, sf).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in got) == ["10", "3", "4", "5", "7", "8", "9"]
    got = [r.doc_id for r in pipeline.near(spark, edge, sf).collect()]
    assert got.count(4) == 1 and got.count(None) == got.count(2) == got.count(3) == 0 and len(got) == len(set(got))


def test_workers_are_handed_few_bytes_at_once(spark, sf, pipeline):
    """A stage of the pipeline leaves the session with batches of 8 MB; a longer row comes alone."""

    def n_bytes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    docs = spark.range(40, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("words "), 200_000).alias("text"))
    pipeline.decontamination(spark, docs, sf)
    sizes = [r.n for r in docs.mapInArrow(n_bytes, "n long").collect()]
    assert len(sizes) >= 5 and max(sizes) < 12 << 20
