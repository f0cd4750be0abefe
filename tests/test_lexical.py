import math
import random
import re
from collections import Counter

import pytest

from docweave.operators import lexical, skew


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(6)
    rare = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    return {i: " ".join(["The"] * draw.randint(0, 3) + ["of"] * draw.randint(0, 2) + draw.sample(rare, draw.randint(0, 12))) for i in range(400)} | {400: None, 401: "", 402: "The, THE the 7"}


def plain(texts, question, k):
    tokens = {i: re.findall("[a-z]+", (t or "").lower()) for i, t in texts.items()}
    mean, df = sum(map(len, tokens.values())) / len(tokens), Counter(w for t in tokens.values() for w in set(t))
    out = []
    for i, t in tokens.items():
        tf, score = Counter(t), 0.0
        for w in set(re.findall("[a-z]+", question.lower())):
            if tf[w]:
                score += math.log(1 + (len(tokens) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean))
        if score:
            out.append((-round(score, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.mark.parametrize("share", [65_536, 8])
def test_bm25_matches_plain_scores(spark, monkeypatch, texts, share):
    monkeypatch.setattr(skew, "SHARE", share)
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, document string")
    asked = {1: "the of waa wab", 2: "THE of", 3: "wzz nothing", 4: "", 5: "wac wad wae waf the"}
    questions = spark.createDataFrame(list(asked.items()), "question_id long, question string")
    index = lexical.index(chunks, 5, share)
    if share == 8:
        assert index.postings.filter("term = 'the'").select("part").distinct().count() > 10
    got = {}
    for r in lexical.bm25(questions, index, 5).orderBy("question_id", "rn").collect():
        got.setdefault(r.question_id, []).append((r.chunk_id, r.score))
    for q, text in asked.items():
        want = plain(texts, text, 5)
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in want]
        assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got.get(q, []), want))
    terms = lexical.asked_terms(questions.filter("question_id in (1, 5)"))
    every = terms.join(index.postings, "term").select("question_id", "chunk_id").distinct().count()
    assert lexical.candidates(terms, index).count() < every / 2  # frequent words' postings were skipped
    with pytest.raises(ValueError):
        lexical.bm25(questions, index, 6)


def test_bm25_in_blocks_and_parts_is_that_of_lookups(spark, monkeypatch, texts):
    """Questions held against parts of the chunks give no more than k rows a part, and the hits of the lookups."""
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, document string")
    asked = [(i, t) for i, t in enumerate(["the of waa wab", "THE of", "wzz nothing", "", "wac wad wae waf the", "the"])] + [(5, "the of")]
    questions = spark.createDataFrame(asked, "question_id long, question string")
    index = lexical.index(chunks, 5)
    want = sorted(map(tuple, lexical.bm25(questions, index, 5).collect()))
    for name, value in (("LOOKUPS", 0), ("BLOCK", 2), ("PART", 100)):
        monkeypatch.setattr(lexical, name, value)
    terms = lexical.asked_terms(questions)
    met = lexical._held(terms, index, 700, 5).groupBy("question_id").count()
    assert all(5 <= r["count"] <= 5 * 7 for r in met.filter("question_id in (0, 1, 4, 5)").collect())
    got = sorted(map(tuple, lexical.bm25(questions, index, 5).collect()))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, want))


def test_bm25_of_nothing(spark):
    chunks = spark.createDataFrame([], "chunk_id long, document string")
    questions = spark.createDataFrame([(1, "any")], "question_id long, question string")
    assert lexical.bm25(questions, lexical.index(chunks), 3).count() == 0


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", 10)
    rows = spark.range(100).selectExpr("id", "case when id < 80 then 'hot' else concat('k', id % 3) end as k")
    keys = rows.groupBy("k").count().withColumnRenamed("count", "n")
    assert sorted(map(tuple, skew.spread_join(rows, keys, ["k"], "n", ["id"]).select("id", "k", "n").collect())) == sorted(map(tuple, rows.join(keys, "k").select("id", "k", "n").collect()))
