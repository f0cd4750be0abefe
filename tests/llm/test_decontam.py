import hashlib
import re

from pyspark.sql import functions as F

from docweave.llm import decontam

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def split(text):
    return WORD.findall((text or "").encode().translate(LOW))


def expected(docs, items):
    strings = {}
    for item, text in items:
        w = split(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            strings.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    lengths = {len(s) for s in strings}
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (key := tuple(w[i : i + m])) in strings:
                    hit |= set(range(i, i + m))
                    found |= strings[key]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_documents_match_brute_force(spark, sf, documents):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = rows(decontam.contamination(documents, bench))
    assert got == expected(documents.select("doc_id", "text").collect(), bench.select("item_id", "text").collect())
    assert any(r[5] for r in got)


def test_edges_short_items_and_blocks(spark, edge, empty):
    bench = spark.createDataFrame([(1, "A, b c d E f g h i j K"), (2, "dolor lorem"), (2, "straße"), (3, None), (4, "?"), (5, "word"), (6, "word")], "item_id long, text string")
    want = expected(edge.select("doc_id", "text").collect(), bench.collect())
    assert rows(decontam.contamination(edge, bench)) == want
    in_blocks = decontam.occurrences(edge, bench, block_strings=1)
    assert sorted(map(str, (r["items"] for r in in_blocks.collect()))) == sorted(map(str, (r["items"] for r in decontam.occurrences(edge, bench).collect())))
    assert decontam.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(edge, bench.limit(0)).collect())
    clean = decontam.decontaminated(edge.withColumnRenamed("score", "items"), bench)
    assert clean.columns == edge.withColumnRenamed("score", "items").columns
    assert clean.count() == sum(not r[5] for r in want)


def test_columns_of_any_name_and_a_long_item_in_several_blocks(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words[20:40]), "a", "b", 3), (2, "x " + " ".join(words[:8]), "a", "b", 4), (3, None, None, None, None)], "doc_id long, text string, __text string, items string, n_words int")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.decontaminated(docs, bench).collect()) == [2, 3]
    assert decontam.decontaminated(docs, bench).columns == docs.columns
    found = decontam.occurrences(docs.select("doc_id", "text", "__text"), bench, block_strings=7).select("doc_id", F.size("ranges").alias("n"), "items").collect()
    assert sorted((r.doc_id, r.n, r["items"]) for r in found) == [(1, 11, ["1"]), (2, 0, []), (3, 0, [])]
