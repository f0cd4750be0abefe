"""Queries against their SQL where elements of several documents share an id."""

from collections import Counter

import duckdb
import pytest

from docweave.operators import corpus, graph, lexical
from docweave.operators.skew import narrowed
from docweave.plans import queries as engine

PAD = "x" * 50
#: Headers (line 0) of two documents with one id, and a header with the id of another document's second line.
HEADERS, MIXED = [(62500, 207950), (387441, 609348)], [(1017113, 173172), (189958, 217084), (238806, 2364632)]

#: Documents whose second line, PAD, has one id.
SECONDS = [(3445810, 6087990), (2575087, 5129030), (1398787, 3712729), (3933737, 4170237), (2163611, 3098367), (791674, 6908897), (1588166, 4747148), (1426965, 2711496)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("shared")
    docs = [(0, "a\nb"), (4, "Zero"), (5, None), (6, "Head\n" + "v " * 50)]
    for a, b in HEADERS:
        docs += [(a, f"T\n{PAD}{'A' * 20}"), (b, f"T\nyy{PAD}{'B' * 20}\nU")]
    for a, b in MIXED:
        docs += [(a, f"T\nzz{PAD}{'A' * 20}\nlast"), (b, f"S\n{PAD}{'B' * 20}\n{'q' * 70}")]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    # A vector for each line that there can be of each document.
    con.execute(f"create table embeddings as select range as vec_id, [1.0::float, (range % 7)::float] as embedding, 0 as label from range({3 * len(docs)})")
    con.execute("create or replace table documents as select row_number() over () - 1 as place, * from documents")
    for t in ("documents", "embeddings"):
        con.execute(f"copy {t} to '{path}/{t}.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", ["climb_two_levels", "subtree_by_interval", "node_parents", "root_filter", "nodes", "edges", "node_text", "doc_of_element"])
def test_joins_by_id_alone(spark, folder, name):
    path, con = folder
    df = engine.queries()[name](spark, path)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({engine.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, df.select(cols).collect())) == Counter(want)


@pytest.mark.parametrize("name", ["children_ordered", "section_markdown", "read_document"])
def test_counts_where_the_order_is_open(spark, folder, name):
    """Rows that share an id are tied in the order, which their SQL leaves open; each is there."""
    path, con = folder
    key = "root" if name == "read_document" else "section_id"
    got = engine.queries()[name](spark, path).select(key, "n").collect()
    assert Counter(map(tuple, got)) == Counter(con.execute(f"select {key}, n from ({engine.oracle_sql()[name]})").fetchall())


def test_climb_of_tied_sections(spark, tmp_path):
    """Two ways of one length, to a header of each document: the SQL leaves the choice open, the query takes the greatest id."""
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(d, f"Head\n{PAD}{'A' * 20}") for pair in SECONDS for d in pair])
    con.execute(f"copy documents to '{tmp_path}/documents.parquet'")
    sql = engine.oracle_sql()["climb_two_levels"].replace("arg_max(section, hops)", "arg_max(section, {'h': hops, 's': section})")
    got = Counter(map(tuple, engine.queries()["climb_two_levels"](spark, str(tmp_path)).select("element_id", "section_id", "hops").collect()))
    assert got == Counter(con.execute(sql).fetchall()) and len(got) == 3 * len(SECONDS)


@pytest.mark.parametrize("step", [1, 1000])
def test_chunks_of_dense_and_sparse_numbers(spark, folder, tmp_path, step):
    path, con = folder
    con.execute(f"copy (select vec_id * {step} as vec_id, embedding, label from embeddings) to '{tmp_path}/embeddings.parquet'")
    con.execute(f"copy documents to '{tmp_path}/documents.parquet'")
    other = duckdb.connect()
    for t in ("documents", "embeddings"):
        other.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    df = engine.queries()["chunk_metadata"](spark, str(tmp_path))
    cols = sorted(df.columns)
    want = other.execute(f"select {', '.join(cols)} from ({engine.oracle_sql()['chunk_metadata']})").fetchall()
    assert want and Counter(map(tuple, df.select(cols).collect())) == Counter(want)


def test_outline_is_that_of_windows(spark):
    levels = [[0, 1, 2, 0, 3, 0, 1, 3, 0], [], [3, 2, 1, 0], [0]]
    rows = spark.createDataFrame([(d, i, x or None) for d, doc in enumerate(levels) for i, x in enumerate(doc)], "doc_id int, ord int, lvl int")
    want = {(r.doc_id, r.ord): (r.par_ord, r.ref_position + 1) for r in corpus.positions(corpus.with_parents(rows).withColumn("page_no", rows.ord)).collect()}
    docs = spark.createDataFrame([(d, [x or None for x in doc]) for d, doc in enumerate(levels)], "doc_id int, lvl array<int>")
    got = {(r.doc_id, i): (p.par, p.seq) for r in docs.select("doc_id", corpus.outlined(docs.lvl).alias("p")).collect() for i, p in enumerate(r.p)}
    assert got == want


@pytest.mark.parametrize("name", ["contexts_of_elements", "chunk_scan", "chunk_metadata"])
def test_chunks_of_shared_ids(spark, tmp_path, name):
    """Elements with a chunk whose id another document's element has, as a paragraph whose parent shares its id with a header."""
    a, b = MIXED[1]
    con, n = duckdb.connect(), max(MIXED[1]) + 1
    con.execute(f"create table documents as select range as doc_id, case range when {a} then 'T\nzz{PAD}{'A' * 20}\nlast' when {b} then 'S\n{PAD}{'B' * 20}\n{'q' * 70}' end as text from range({n})")
    con.execute(f"create table embeddings as select d + k.range * {n} as vec_id, [1.0::float] as embedding, 0 as label from (values ({a}), ({b})) v(d), range(3) k")
    for t in ("documents", "embeddings"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    df = engine.queries()[name](spark, str(tmp_path))
    # Texts of tied children are open in their order.
    cols = ["element_id", "section_id"] if name == "contexts_of_elements" else sorted(df.columns)
    got = Counter(map(tuple, df.select(cols).collect()))
    assert got == Counter(con.execute(f"select {', '.join(cols)} from ({engine.oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("lookups", [1 << 22, 0])
def test_words_of_chunks_with_shared_ids(spark, tmp_path, monkeypatch, lookups):
    """A chunk that stands twice, as its element's id is shared, has its words and its size twice, and asks for its words twice."""
    monkeypatch.setattr(lexical, "LOOKUPS", lookups)
    a, b = MIXED[1]
    con, n = duckdb.connect(), max(MIXED[1]) + 3
    con.execute(f"create table documents as select range as doc_id, case range when {a} then 'T\nzz{PAD}{'A' * 20}\nlast t' when {b} then 'S\n{PAD}{'B' * 20} t t\n{'q ' * 70}' end as text from range({n})")
    con.execute(f"create table embeddings as select d + k.range * {n} as vec_id, [1.0::float] as embedding, 0 as label from (values ({a}), ({b})) v(d), range(150) k")
    for t in ("documents", "embeddings"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    columns = "question_id, chunk_id, score, rn"
    got = engine.queries()["bm25_topk"](spark, str(tmp_path)).selectExpr(*columns.split(", ")).collect()
    assert got and Counter(map(tuple, got)) == Counter(con.execute(f"select {columns} from ({engine.oracle_sql()['bm25_topk']})").fetchall())


def test_narrowed_keeps_all_that_meet(spark):
    rows, keys = spark.range(5000).selectExpr("cast(id as string) as a", "id"), spark.range(0, 6000, 7).selectExpr("cast(id as string) as k")
    kept = narrowed(rows, "a", keys, "k")
    assert kept.columns == rows.columns and 715 <= kept.count() < 800
    assert kept.join(keys, kept.a == keys.k).count() == 715
    assert narrowed(rows, "a", keys.limit(0), "k").count() == 0


def test_climb_from_few_starts_is_the_climb(spark):
    """Chains, a second parent, a cycle and a missing node: what lies above is taken out level by level, each row once."""
    edges = [(f"n{i}", f"n{i + 1}", 1) for i in range(14)] + [("x", "n5", 2), ("n2", "x", 1), ("c1", "c0", 1), ("c0", "c1", 1), ("lost", "z", 1), ("n3", "lost", 1)]
    nodes = [(f"n{i}", "Document" if not i else "SectionHeader" if i % 4 == 0 else "Group", "", f"t{i}") for i in range(15)] + [(k, "Group", "", k) for k in ("x", "c0", "c1", "z")] + [("n5", "Paragraph", "", "again")]
    up, n = spark.createDataFrame(edges, "src string, dst string, sequence int"), spark.createDataFrame(nodes, "node_id string, tag string, label string, text string")
    starts = spark.createDataFrame([("n14",), ("n7",), ("c0",), ("z",), ("none",)], "element_id string")
    for kw in ({"every": True}, {"full": True}):
        plain, few = (Counter(map(str, graph.climb(starts, up, n, **kw, few=few).collect())) for few in (False, True))
        assert plain == few, kw
