"""Small cases of the engine's rules, written by hand."""

import json

import pytest
from pyspark.sql import functions as F

from docweave import schemas
from docweave.functions import markdown as M
from docweave.functions import text as T
from docweave.operators import answer, corpus, graph, rank, retrieve
from docweave.plans import pipelines
from docweave.sources import tables
from docweave.streaming import threads

CRUMB = "array<struct<node_id:string,label:string,text:string>>"
ELEMENT = "array<struct<node_id:string,label:string,text:string,minio_url:string,sequence:int,page_no:int>>"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_group_by_document(spark):
    hits = spark.createDataFrame([(1, "abc123", "e1", "one.pdf", 0.92, 1), (1, "def456", "e2", "one.pdf", 0.75, 2), (1, "ghi789", "e3", "two.pdf", 0.30, 3)], "question_id long, chunk_id string, element_id string, filename string, score double, rr int")
    got = [(r.filename, r.best_score, len(r.chunks)) for r in rank.by_document(hits).orderBy("group_rank").collect()]
    assert got == [("one.pdf", 0.92, 2), ("two.pdf", 0.30, 1)]
    assert rank.by_document(hits.limit(0)).count() == 0
    assert rank.by_document(hits.withColumn("score", F.lit(None).cast("double"))).agg(F.max("best_score")).first()[0] == 0.0


def test_missing_scores_outrank_negative_ones_and_ties_keep_their_order(spark):
    hits = spark.createDataFrame([(1, "a", -1.0, 1), (1, "b", None, 2), (1, "c", 0.0, 3)], "question_id long, chunk_id string, score double, rn int")
    assert [r.chunk_id for r in rank.reranked(hits, 3).orderBy("rr").collect()] == ["b", "c", "a"]


def test_section_markdown(spark):
    df = spark.createDataFrame([([("doc_test", "document", "test.pdf"), ("sec1", "section_header", "3. Architecture")], [("para1", "paragraph", "Texte", None, 0, 1), ("img1", "picture", "", "http://x/documents/a.png", 1, 1), ("c1", "code", "x = 1", None, 2, 1), ("li", "list_item", "", None, 3, 1), ("cap", "caption", "Fig", None, 4, 1)], "3.1 Composants")], f"b {CRUMB}, e {ELEMENT}, t string")
    got = df.select(M.section_markdown(F.col("b"), F.col("e"), F.col("t"))).first()[0]
    assert got == "[Contexte] test.pdf > 3. Architecture\n\n\n## 3.1 Composants\n\n\nTexte [src:para1]\n\n[img:img1]\n\n```\nx = 1\n```\n[src:c1]\n\n_Fig_ [src:cap]"
    none = df.select(M.section_markdown(F.array().cast(CRUMB), F.array().cast(ELEMENT), F.col("t"))).first()[0]
    assert none == ""
    assert value(spark, M.with_orphan(F.lit("m"), F.lit("own"), F.lit(False))) == "m\n\nown"
    assert value(spark, M.with_orphan(F.lit(""), F.lit("own"), F.lit(False))) == "own"
    assert value(spark, M.with_orphan(F.lit("m"), F.lit("own"), F.lit(True))) == "m"


def test_urls(spark):
    url = "http://minio:9000/documents/images/livre/abc123def0_picture.png"
    assert value(spark, T.object_name(F.lit(url))) == "images/livre/abc123def0_picture.png"
    assert value(spark, T.object_name(F.lit("http://minio:9000/documents"))) is None
    assert value(spark, T.object_name(F.lit(url + "?X-Amz-Signature=1#top"))) == "images/livre/abc123def0_picture.png"
    assert value(spark, T.media_path(F.lit(url + "?a=b/c"))) == "/media/images/livre/abc123def0_picture.png"
    assert value(spark, T.media_path(F.lit(url))) == "/media/images/livre/abc123def0_picture.png"
    assert value(spark, T.media_path(F.lit("http://example.com/foo"))) == "http://example.com/foo"


@pytest.mark.parametrize(("text", "element", "node"), [("abc123def0", True, True), ("abc123", False, False), ('abc"; DROP SPACE x;', False, False), ("doc_été 1.(a)-b", False, True), ("doc_", False, False), (None, False, False), ("doc_a\n", False, False)])
def test_ids(spark, text, element, node):
    assert value(spark, T.is_element_id(F.lit(text).cast("string"))) is element
    assert value(spark, T.is_node_id(F.lit(text).cast("string"))) is node


def test_object_names_and_strip(spark):
    assert value(spark, T.is_object_name(F.lit("images/é-1/a_b.png"))) is True
    assert value(spark, T.is_object_name(F.lit("images/é (1)/a.png"))) is False
    assert value(spark, T.is_object_name(F.lit("images/../a.png"))) is False
    assert value(spark, T.stripped(F.lit("  x\ty \n"))) == "x\ty"


def test_follow_ups(spark):
    said = "A search_vectors('it's') b search_vectors(\"two\") "
    assert value(spark, T.follow_up(F.lit(said))) == "it's"
    assert value(spark, T.without_follow_ups(F.lit(said))) == "A  b"
    rows = spark.createDataFrame([(1, said)], "question_id long, response string")
    assert answer.answered(rows.withColumn("round", F.lit(3))).first().next_query is None
    assert answer.answered(rows.withColumn("round", F.lit(2))).first().next_query == "it's"


@pytest.fixture(scope="module")
def small_graph(spark):
    nodes = [("doc_a", "Document", None, None, None, None, "a.pdf"), ("s1", "SectionHeader", "section_header", "One", None, 1, None), ("s2", "SectionHeader", "section_header", "Two", None, 2, None), ("p1", "Paragraph", "paragraph", "text", None, 1, None), ("p2", "Paragraph", None, None, None, None, None), ("o", "Paragraph", "paragraph", "alone", None, 3, None), ("x", "Group", "", "", None, 0, None), ("y", "Group", "", "", None, 0, None)]
    nodes += [(f"d{i}", "Group", "", "", None, 0, None) for i in range(14)]
    edges = [("doc_a", "s1", 1), ("s1", "s2", 1), ("s2", "p1", 2), ("s2", "p2", None), ("s1", "p1", 9), ("doc_a", "o", 2), ("x", "y", 1), ("y", "x", 1), ("s1", "d0", 5)] + [(f"d{i}", f"d{i + 1}", 1) for i in range(13)]
    return graph.normalised(spark.createDataFrame(nodes, schemas.NODE)), spark.createDataFrame(edges, schemas.PARENT_OF)


def test_climb(spark, small_graph):
    nodes, edges = small_graph
    starts = spark.createDataFrame([(i,) for i in ("p1", "s2", "s1", "o", "x", "ghost", "d13", "d5")], "element_id string")
    got = {r.element_id: r for r in graph.climb(starts, edges, nodes).collect()}
    assert {k: v.section_id for k, v in got.items()} == {"p1": "s2", "s2": "s1", "s1": "s1", "o": "o", "x": "x", "ghost": "ghost", "d13": "d13", "d5": "s1"}
    assert [b.label for b in got["o"].breadcrumbs] == ["document"] and got["x"].hops == 10
    full = {r.element_id: [b.text for b in r.breadcrumbs] for r in graph.climb(starts.filter("element_id = 'p1'"), edges, nodes, full=True).collect()}
    assert full == {"p1": ["a.pdf", "One", "Two"]}


def test_children_keep_rows_without_label_or_sequence(spark, small_graph):
    nodes, edges = small_graph
    got = graph.ordered_children(graph.children(spark.createDataFrame([("s2",)], "section_id string"), edges, nodes)).first().elements
    assert [(e.node_id, e.sequence, e.label) for e in got] == [("p2", 0, ""), ("p1", 2, "paragraph")]


def test_reconstructed(spark, small_graph):
    nodes, edges = small_graph
    good, bad = pipelines.reconstructed(spark.createDataFrame([("doc_a",), ('no"',)], "element_id string"), edges, nodes)
    assert [r.element_id for r in bad.collect()] == ['no"']
    assert good.first().element_id == "doc_a"


def test_selection_fallback(spark):
    hits = spark.createDataFrame([(q, f"e{c}", c, c) for q in (1, 2) for c in range(1, 6)], "question_id long, element_id string, chunk_id long, rr int")
    chosen = spark.createDataFrame([(1, "e4"), (1, "e2"), (1, "zz")], "question_id long, element_id string")
    got = sorted((r.question_id, r.ord, r.element_id) for r in answer.selected(hits, chosen).collect())
    assert got == [(1, 1, "e2"), (1, 2, "e4"), (2, 1, "e1"), (2, 2, "e2"), (2, 3, "e3")]
    later = sorted(r.element_id for r in answer.selected(hits, chosen, first_pass=False).filter("question_id = 1").collect())
    assert later == ["e1", "e2", "e3"]


def test_prompt_and_history(spark):
    ctx = spark.createDataFrame([(1, 1, "e1", "a > b", "MD")], "question_id long, ord int, element_id string, path string, markdown string")
    text = pipelines.prompts(spark.createDataFrame([(1, "Why?")], "question_id long, question string"), ctx).first().prompt
    assert "\n---\nSource 1 — e1\nChemin : a > b\n\nMD\n---\n" in text and "\n\nQuestion de l'utilisateur : Why?\n\n" in text
    past = spark.createDataFrame([("t", i, "user", str(i)) for i in range(8)], "thread_id string, turn int, role string, content string")
    assert sorted(r.turn for r in answer.last_messages(past).collect()) == [2, 3, 4, 5, 6, 7]
    more = answer.appended(past, spark.createDataFrame([("t", "q", "a"), ("u", "q", "a")], "thread_id string, question string, answer string"))
    assert sorted((r.thread_id, r.turn) for r in more.filter("turn > 7 or thread_id = 'u'").collect()) == [("t", 8), ("t", 9), ("u", 0), ("u", 1)]


def test_knn_exact_and_approximate(spark, sf):
    import numpy as np

    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = v.filter("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "question_id")
    rows = {r.chunk_id: np.array(r.embedding) for r in v.collect()}
    exact = {}
    for r in retrieve.knn(q, v, 20).collect():
        exact.setdefault(r.question_id, set()).add(r.chunk_id)
    ids = sorted(rows)
    m = np.stack([rows[i] for i in ids])
    for i, near in exact.items():
        d = {j: round(1 - float(x), 9) for j, x in zip(ids, m @ rows[i] / np.linalg.norm(m, axis=1) / np.linalg.norm(rows[i])) if j != i}
        assert near == set(sorted(d, key=lambda j: (d[j], j))[:20])
    books = retrieve.codebooks(v, m.shape[1])
    index = retrieve.coded(v, books, m.shape[1])
    assert index.count() == len(ids)
    near, pairs = retrieve.knn_coded(q, v, index, books)
    assert pairs.count() == q.count() * 120  # the short lists
    one = retrieve.recall(near, retrieve.knn(q, v, 20)).first()
    assert one.n_questions == q.count() and one.recall >= 0.95
    assert retrieve.knn_coded(q, v, index.limit(0), books)[0].count() == 0
    assert retrieve.knn(q.limit(0), v, 20).count() == 0


def test_knn_blocks_parts_and_sizes(spark, monkeypatch):
    """More than one block of questions and part of chunks, two sizes of vectors, ties, rows without a vector."""
    import numpy as np

    monkeypatch.setattr(retrieve, "BLOCK", 7)
    monkeypatch.setattr(retrieve, "PART", 50)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 2 + i % 2)]) for i in range(300)] + [(300, None), (301, [])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    got = sorted(map(tuple, retrieve.knn(df.filter("chunk_id % 10 < 2").withColumnRenamed("chunk_id", "question_id"), df, 5, "l2", 6).collect()))
    want = []
    for q, v in rows:
        if q % 10 < 2 and v:
            far = sorted((round(float(np.linalg.norm(np.subtract(v, w))), 6), c) for c, w in rows if w and len(w) == len(v) and c != q)[:5]
            want += [(q, c, d, n) for n, (d, c) in enumerate(far, 1)]
    assert got == sorted(want)


def test_header_numbers(spark):
    rows = spark.createDataFrame([("2.1.3 Title", 3), ("4) x", 1), ("IV. x", 1), ("b) x", 2), ("None", None)], "h string, depth int")
    assert all(r.depth == r.got for r in rows.withColumn("got", T.numbering_depth(F.col("h"))).collect())


def test_json_documents_golden_media(spark, tmp_path):
    doc = {"metadata": {"filename": "a.pdf", "type_file": "pdf", "total_pages": 2}, "elements": [{"id": "e1", "label": "text", "text": "x", "page_no": 1, "bbox": {"l": 1, "t": 2, "r": 3, "b": 4}}, {"id": "e2", "label": "picture"}]}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text(json.dumps(doc, indent=1))
    got = tables.documents_json(spark, f"{tmp_path}/docs").orderBy("pos").collect()
    assert [(r.filename, r.pos, r.id) for r in got] == [("a.pdf", 0, "e1"), ("a.pdf", 1, "e2")] and got[0].bbox.b == 4
    (tmp_path / "golden.json").write_text(json.dumps([{"question": "q", "expected_answer": "a", "chunk_ids": ["1", "2"]}]))
    assert tables.golden(spark, f"{tmp_path}/golden.json").count() == 2
    (tmp_path / "media" / "images").mkdir(parents=True)
    (tmp_path / "media" / "images" / "a.png").write_bytes(b"png")
    refs = spark.createDataFrame([("images/a.png",), ("images/none.png",), ("../x",)], "object_name string")
    found = {r.object_name: r.content for r in tables.with_media(refs, tables.media(spark, f"{tmp_path}/media")).collect()}
    assert {k: v and bytes(v) for k, v in found.items()} == {"images/a.png": b"png", "images/none.png": None, "../x": None}


def test_response_deltas(spark):
    lines = [("t", 0, '{"message":{"content":"a"},"done":false}'), ("t", 1, '{"message":{"content":"b"},"done":true}'), ("t", 2, '{"message":{"content":"late"}}'), ("u", 0, '{"error":"no model"}')]
    good, bad = tables.response_deltas(spark.createDataFrame(lines, "thread_id string, seq long, value string"))
    assert [r.token for r in good.orderBy("seq").collect()] == ["a", "b"] and [r.thread_id for r in bad.collect()] == ["u"]


def test_upsert_twice_is_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([("a", 1, "old", "p"), ("b", 1, "x", "q")], "id string, v int, text string, part string")
    tables.upsert(rows, path, "id", "part", "v")
    new = spark.createDataFrame([("a", 2, "new", "p"), ("c", 1, "y", "p")], "id string, v int, text string, part string")
    for _ in range(2):
        tables.upsert(new, path, "id", "part", "v")
    assert sorted((r.id, r.text) for r in spark.read.parquet(path).collect()) == [("a", "new"), ("b", "x"), ("c", "y")]


def test_upsert_of_a_key_that_moves(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "id string, part string, v int"
    for rows in ([("k", "A", 1), ("m", "C", 1)], [("k", "B", 2)], [("k", "B", 2)]):
        tables.upsert(spark.createDataFrame(rows, schema), path, "id", "part", "v")
        now = sorted((r.id, r.part, r.v) for r in spark.read.parquet(path).collect())
    assert now == [("k", "B", 2), ("m", "C", 1)]
    assert [p.name for p in tmp_path.iterdir() if "__new" in p.name] == []


def test_late_tokens_take_their_place(spark, tmp_path):
    schema = "thread_id string, seq long, kind string, payload string"
    for part in ([("t", 3, "token", "c"), ("t", 1, "token", "lost")], [("t", 4, "token", "d"), ("t", 3, "token", "again")], [("t", 2, "reset", None)], [("t", 6, "done", None), ("t", 5, "token", "e")], [("t", 1, "token", "x")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    rows = threads.landed(threads.accumulated(stream), f"{tmp_path}/out", "update").orderBy("batch").collect()
    assert [(r.text, r.n_tokens, r.done) for r in rows] == [("lostc", 2, False), ("lostcd", 3, False), ("cd", 2, False), ("cde", 3, True)]


def test_subtree_has_no_last_level(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1) for i in range(25)], schemas.PARENT_OF)
    root = spark.createDataFrame([("n0",)], "node_id string")
    assert graph.subtree(root, edges).agg(F.max("depth")).first()[0] == 25
    assert graph.subtree(root, edges, 3).agg(F.max("depth")).first()[0] == 3


def test_streams(spark, tmp_path):
    schema = "thread_id string, seq long, kind string, payload string"
    events = [("t", 1, "token", "lost"), ("t", 2, "reset", None), ("t", 3, "token", "a"), ("t", 4, "token", "b"), ("t", 5, "done", None), ("t", 6, "token", "late"), ("u", 1, "token", "x")]
    src = f"{tmp_path}/events"
    for part in (events[:3], events[3:], events[2:4]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = threads.accumulated(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    threads.started(stream.writeStream.outputMode("update").format("memory").queryName("acc").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True), spark).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != threads.STATE["spark.sql.streaming.stateStore.providerClass"]
    last = {r.thread_id: r for r in spark.table("acc").collect()}
    assert (last["t"].text, last["t"].done, last["u"].text) == ("ab", True, "x")
    batch = answer.since_reset(spark.createDataFrame(events, schema).filter("kind != 'token' or seq < 6"))
    assert {r.thread_id: r.text for r in batch.collect()} == {"t": "ab", "u": "x"}

    q = spark.createDataFrame([("t", "why", "2024-01-01 00:00:00"), ("w", "when", "2024-01-01 00:00:00")], "thread_id string, question string, at string").withColumn("asked_at", F.to_timestamp("at")).drop("at")
    s = spark.createDataFrame([("t", ["e"], "2024-01-01 00:10:00"), ("t", ["e"], "2024-01-01 00:11:00"), ("ghost", ["e"], "2024-01-01 00:10:00")], "thread_id string, element_ids array<string>, at string").withColumn("chosen_at", F.to_timestamp("at")).drop("at")
    q.write.parquet(f"{tmp_path}/q")
    s.write.parquet(f"{tmp_path}/s")
    joined = threads.resumed(spark.readStream.schema(q.schema).parquet(f"{tmp_path}/q"), spark.readStream.schema(s.schema).parquet(f"{tmp_path}/s"))
    query = joined.writeStream.format("memory").queryName("res").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.thread_id for r in spark.table("res").collect()] == ["t"]

    for _ in range(2):  # the second run finds nothing new
        threads.ingest(spark, src, schema, f"{tmp_path}/landed", f"{tmp_path}/c3", "seq", "thread_id", "kind").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/landed").count() >= 6


def test_build_corpus_and_resume(spark):
    lines = spark.createDataFrame([(1, 0, "Head", "section_header", 1, 1), (1, 1, "Body text", "paragraph", None, 1), (1, 2, " ", "paragraph", None, 1)], "doc_id long, ord int, line string, label string, lvl int, page_no int")
    chunks, nodes, edges = pipelines.build_corpus(lines)
    assert chunks.count() == 2 and nodes.count() == 4 and edges.count() == 3
    assert abs(sum(x * x for x in chunks.first().embedding) - 1) < 1e-5
    body = chunks.filter("document = 'Body text'").first().chunk_id
    ranked = spark.createDataFrame([(7, body, body, 1, "doc_1.txt", 1, "Body text", None)], "question_id long, element_id string, chunk_id string, rr int, filename string, page_no int, document string, minio_url string")
    threads_ = spark.createDataFrame([("x", 7)], "thread_id string, question_id long")
    chosen = spark.createDataFrame([(7, body), (8, body)], "question_id long, element_id string")
    seen = []

    def respond(prompts, hits, number):
        seen.extend(r.prompt for r in prompts.collect())
        return prompts.select("question_id", F.lit(f"[src:{body}] [src:ffff] search_vectors('more')").alias("response"))

    got = pipelines.resume(threads_, chosen, ranked, spark.createDataFrame([(7, "Q")], "question_id long, question string"), edges, graph.normalised(nodes), respond, lambda asked, number: ranked)
    assert len(seen) == 3 and all(p.count(f"Body text [src:{body}]") == 1 for p in seen)
    assert [r.question_id for r in got["rejected"].collect()] == [8]
    final = got["answers"].first()
    assert (final["round"], final.answer) == (3, f"[src:{body}] [src:ffff]")
    assert [(r.ordinal, r.element_id, r.filename, r.text_excerpt) for r in got["citations"].collect()] == [(1, body, "doc_1.txt", "Body text")]
    assert got["contexts"].count() == 1 and got["images"].count() == 0


def test_parents_by_header_stack(spark):
    rows = [(1, i, lvl) for i, lvl in enumerate([None, 1, None, 2, None, 3, 2, None, 1, None])]
    got = corpus.with_parents(spark.createDataFrame(rows, "doc_id long, ord int, lvl int")).orderBy("ord").collect()
    assert [r.par_ord for r in got] == [None, None, 1, 1, 3, 3, 1, 6, None, 8]


def test_simple_answers_keep_repeated_sections(spark, small_graph):
    nodes, edges = small_graph
    nodes = nodes.withColumn("node_id", F.when(F.length("node_id") < 5, F.rpad("node_id", 10, "0")).otherwise(F.col("node_id"))).withColumn("node_id", F.regexp_replace("node_id", "^[spoxyd]", "f"))
    name = lambda c: F.when(F.length(c) < 5, F.regexp_replace(F.rpad(c, 10, "0"), "^[spoxyd]", "f")).otherwise(F.col(c)).alias(c)
    edges = edges.filter("src like 's%' and dst like 's%' or src = 'doc_a' or dst like 'p%'").select(name("src"), name("dst"), "sequence")
    chosen = spark.createDataFrame([(1, "f100000000", 1), (1, "f200000000", 2), (2, "bad id!", 1)], "question_id long, element_id string, ord int")
    questions = spark.createDataFrame([(1, "Q1"), (2, "Q2"), (3, "Q3")], "question_id long, question string")
    made, none = pipelines.answer_simple(questions, chosen, edges, nodes)
    assert made.count() == 1 and "Source 2" in made.first().prompt
    assert sorted(r.question_id for r in none.collect()) == [2, 3]


def test_chunk_rows(spark):
    raw = spark.createDataFrame([("c", "e", None, "t", None, None, "7", None, "x", "", 0.5)], "chunk_id string, element_id string, graph_node_id string, document string, filename string, label string, page_no string, page_position string, ref_position string, minio_url string, distance double")
    got = retrieve.chunk_rows(raw).first()
    assert (got.graph_node_id, got.filename, got.page_no, got.page_position, got.ref_position, got.minio_url) == ("", "", 7, 0, 0, None)


def test_replacing_one_document_leaves_the_others(spark, tmp_path):
    path = f"{tmp_path}/docs"
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "doc string, text string")
    tables.replace_documents(rows, path, "doc")
    tables.replace_documents(rows.filter("doc = 'a'").withColumn("text", F.lit("new")), path, "doc")
    assert sorted((r.doc, r.text) for r in spark.read.parquet(path).collect()) == [("a", "new"), ("b", "y")]


def test_search_and_evaluation(spark):
    chunks = spark.createDataFrame([(i, [float(i == 1), float(i != 1)], f"text {i}", f"f{i % 2}") for i in range(4)], "chunk_id long, embedding array<float>, document string, filename string").withColumn("element_id", F.lit("e"))
    questions = spark.createDataFrame([(9, "text 1", [1.0, 0.0]), (8, "", [1.0, 0.0])], "question_id long, question string, embedding array<float>")
    hits, bad = pipelines.search(questions, chunks, 2)
    assert [r.question_id for r in bad.collect()] == [8]
    assert hits.filter("rn = 1").first().chunk_id == 1
    assert pipelines.search(questions, chunks, 51)[0].count() == 0
    assert pipelines.sources(questions, chunks, 2).count() >= 1
    golden = spark.createDataFrame([(9, 1)], "question_id long, chunk_id long")
    before = spark.createDataFrame([("context_recall", 0.5)], "metric string, value double")
    got = {r.metric: (r.value, r.change, r.below) for r in pipelines.evaluated(hits, golden, before, 2).collect()}
    assert got == {"context_precision": (0.5, None, True), "context_recall": (1.0, 0.5, False)}


def test_prompt_order_and_budget(spark):
    rows = spark.createDataFrame([(1, o, 10) for o in range(5)], "question_id long, ord int, size int")
    assert sorted(r.ord for r in answer.within_budget(rows, 30, F.col("size")).collect()) == [0, 1, 2]
    made = answer.prompt_messages(spark.createDataFrame([("t", "P")], "thread_id string, prompt string"), spark.createDataFrame([("t", 3, "user", "h"), ("z", 1, "user", "no")], "thread_id string, turn int, role string, content string"), "S")
    assert [(r.role, r.content) for r in made.orderBy("ord").collect()] == [("system", "S"), ("user", "h"), ("user", "P")]


def test_knn_searches_questions_of_every_vector_size(spark):
    unit = lambda n, i: [float(i == j) for j in range(n)]
    chunks = spark.createDataFrame([(10 * n + i, unit(n, i)) for n in (3, 4) for i in range(n)], "chunk_id long, embedding array<double>")
    # One stray vector comes first; none of another size, of no size or null may take others with it.
    rows = [(100, unit(3, 1)), *((200 + i, unit(4, i)) for i in range(4)), (300, unit(7, 0)), (301, []), (302, None), (101, unit(3, 2))]
    questions = spark.createDataFrame(rows, "question_id long, embedding array<double>").coalesce(1)
    got = {r.question_id: r.chunk_id for r in retrieve.knn(questions, chunks, 1).collect()}
    assert got == {100: 31, 101: 32, **{200 + i: 40 + i for i in range(4)}}
    assert {tuple(r) for r in retrieve.unsearchable(questions, chunks).collect()} == {(300, 7), (301, 0), (302, 0)}
