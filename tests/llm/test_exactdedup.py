import hashlib
import re
from collections import defaultdict

import pytest

from docweave.llm import exactdedup


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i))
    out = []
    for plain, each in groups.items():
        most, _, keep = min(each, key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, keep, len(each), i == keep and size == most, hashlib.sha256(plain.encode()).hexdigest()) for size, _, i in each]
    return sorted(out, key=str)


def test_documents_and_edges(documents, edge, empty):
    for docs in (documents, edge):
        assert sorted((tuple(r)[:5] for r in exactdedup.exact_groups(docs).collect()), key=str) == expected(docs.select("doc_id", "text").collect())
    assert exactdedup.exact_groups(empty).count() == 0


@pytest.fixture()
def one_digest(monkeypatch):
    monkeypatch.setattr(exactdedup, "digest_of", lambda plain: exactdedup.F.sha2(exactdedup.F.lit("same"), 256))


def test_equal_digests_of_different_texts_are_split(spark, one_digest):
    docs = spark.createDataFrame([(1, "ab"), (2, "a b"), (3, "cd"), (4, "c d "), (5, "ef"), (5, "ef")], "doc_id long, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exactdedup.exact_groups(docs).collect())
    assert got == [(1, 2, 2), (2, 2, 2), (3, 4, 2), (4, 4, 2), (5, 5, 2), (5, 5, 2)]


def test_equal_digests_of_rows_without_id_are_split(spark, one_digest):
    docs = spark.createDataFrame([(None, "ab"), (None, "cd e"), (3, "xyzxyz")], "doc_id long, text string")
    assert sorted((str(r.keep_id), r.group_size) for r in exactdedup.exact_groups(docs).collect()) == [("3", 1), ("None", 1), ("None", 1)]


def test_of_rows_with_one_id_the_longest_stays(spark):
    docs = spark.createDataFrame([(7, "a b"), (7, "ab"), (8, "a b"), (9, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept) for r in exactdedup.exact_groups(docs).collect()) == [(7, False), (7, True), (8, False), (9, True)]


def test_state_is_restored_by_later_batches(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/docs"
    rows = [(5, "a b"), (4, "c d")], [(3, "ab"), (6, "e")], [(9, "a  b"), (2, "cd"), (1, None)]
    for part in rows:
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    landed = []
    remembered = exactdedup.remembered
    monkeypatch.setattr(exactdedup, "remembered", lambda *a: landed.append(remembered(*a)) or landed[0])
    docs = spark.read.parquet(path)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))  # a task for each file
    try:
        got = exactdedup.exact_groups(docs).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, expected([r for part in rows for r in part])))
    state = landed[0].inputFiles()
    assert len({re.search(r"batch=(\d+)", f)[1] for f in state if "batch=-1" not in f}) >= 3
    assert {r.doc_id for r in got if r.keep_locator and r.doc_id == 9} == {9}


def test_a_group_of_many_copies_is_dealt_to_several_tasks(spark, monkeypatch):
    from docweave.llm import text

    monkeypatch.setattr(text, "HOT_ROWS", 10)
    rows = [(i % 150, f"same text {' ' * (i % 3)}") for i in range(300)] + [(i, f"own {i}") for i in range(150, 200)]
    got = exactdedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows)
