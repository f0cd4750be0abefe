import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from docweave.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, change=False):
    lower = None if r["text"] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
    return h(*(field(r[f]) for f in ("doc_id", "source", "lang", "n_chars")), field(lower if change else r["text"]))


def climbed(level):
    """Digest above a list of digests and, for each, the (left, right) siblings of every step."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 8 * 8 : k // 8 * 8 + 8]
            paths[i].append((run[: k % 8], run[k % 8 + 1 :]))
        level, at = [h(*level[k : k + 8]) for k in range(0, len(level), 8)], [k // 8 for k in at]
    return level[0], paths


def expected(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    inner = {}
    for lang in order:
        trees[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        inner[lang] = climbed([leaf(r) for r in trees[lang]])
    root, outer = climbed([inner[lang][0] for lang in order])
    out = []
    for lang, beyond in zip(order, outer):
        for r, path in zip(trees[lang], inner[lang][1]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            fold, proof = leaf(r, hit), ""
            for left, right in path + beyond:
                fold, proof = h(*left, fold, *right), proof + "".join(left + right)
            out.append((r["doc_id"], leaf(r), inner[lang][0], root, h(proof), fold, fold == root))
    return sorted(out, key=str)


def found(docs):
    return sorted(map(tuple, merkle.proofs(docs).collect()), key=str)


@pytest.mark.parametrize("low", [4, 1])
def test_documents_match_plain_trees(documents, monkeypatch, low):
    monkeypatch.setattr(merkle, "LOW", low)
    monkeypatch.setattr(merkle, "BLOCK", 8**low)
    got = found(documents)
    assert got == expected([r.asDict() for r in documents.collect()])
    assert {r[-1] for r in got} == {True, False}


def test_high_nodes_of_one_large_tree(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LOW", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 50 != 7, "en").alias("lang"), F.lit(3).alias("n_chars"), F.lit("ABC").alias("text"))
    assert found(docs) == expected([r.asDict() for r in docs.collect()])


def test_edge_rows(spark, edge, empty):
    docs = edge.withColumn("n_chars", F.length("text"))
    more = docs.unionByName(docs.select("doc_id", "text", F.concat(F.lit("x"), "doc_id").alias("lang"), "source", "fp", "score", "n_chars"))
    assert found(more) == expected([r.asDict() for r in more.collect()])
    assert merkle.proofs(empty.withColumn("n_chars", F.length("text"))).count() == 0
    one = docs.filter("doc_id = 9")
    assert found(one) == expected([r.asDict() for r in one.collect()])
