import hashlib
import re

import pytest

from docweave.llm import substrings


def expected(rows, n):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][2:]))
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode()) for r in rows]
    first, out = {}, []
    for i in order:
        for s in range(len(split[i]) - n + 1):
            first.setdefault(tuple(split[i][s : s + n]), (rows[i], s))
    for i, row in enumerate(rows):
        w, gone = split[i], set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] != (row, s):
                gone |= set(range(s, s + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((row[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_documents_match_brute_force(documents):
    got = sorted(map(tuple, substrings.summary(documents).collect()), key=str)
    assert got == expected(documents.select("doc_id", "text").collect(), 20)
    assert any(0 < r[2] < r[1] for r in got)


def test_edges(edge, empty):
    got = sorted(map(tuple, substrings.summary(edge).collect()), key=str)
    assert got == expected(edge.select("doc_id", "text").collect(), 20)
    assert substrings.summary(empty).count() == 0
    with pytest.raises(ValueError):
        substrings.repeated_windows(edge, window=7)


def test_planted_passages(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 3)))
    passage = [[word() for _ in range(n)] for n in (19, 20, 21, 45)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(0, 60))]
        for p in rng.sample(passage, rng.randint(0, 3)):
            text += p + [word() for _ in range(rng.randint(0, 5))]
        rows.append((rng.randint(0, 10**6), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substrings.summary(docs).collect()), key=str) == expected(rows, 20)


def identified(spark, rows):
    """rows in the order that the operator gives to different texts of one id."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, [tuple(r) for r in substrings._identified(docs, "doc_id", "text").select("id", "text", "t1", "t2").collect()]


def test_null_ids_and_different_texts_of_one_id(spark):
    word = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(None, word(0, 30) + " x " + word(0, 29)), (None, word(5, 30)), (7, word(100, 170)), (7, word(200, 240) + " " + word(200, 225)), (7, word(0, 25)), (8, word(110, 140))]
    docs, known = identified(spark, rows)
    got = sorted(map(tuple, substrings.summary(docs).collect()), key=str)
    assert got == expected(known, 20)
    assert (7, 70, 0) in [r[:3] for r in got]


def test_words_that_a_sum_of_powers_takes_for_equal(spark):
    pattern = "a"
    for _ in range(10):
        pattern += pattern.translate(str.maketrans("ab", "ba"))
    other = pattern.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(19)]
    docs, known = identified(spark, [(1, " ".join([*around, pattern])), (2, " ".join([*around, other]))])
    assert [r[2] for r in sorted(substrings.summary(docs).collect())] == [0, 0]


@pytest.mark.parametrize("window", [2, 4, 40])
def test_levels(spark, window):
    import random

    rng = random.Random(window)
    word = lambda: rng.choice("abc") if window < 40 else f"w{rng.randint(0, 400)}"
    passage = [word() for _ in range(120)]
    rows = []
    for i in range(40):
        a = rng.randint(0, 100)
        rows.append((rng.choice([i, 3]), " ".join([word() for _ in range(rng.randint(0, 30))] + passage[a : a + rng.randint(0, 80)] + [word()])))
    docs, known = identified(spark, rows)
    got = sorted(tuple(r)[:3] for r in substrings.without_repeats(docs, window=window).collect())
    assert got == sorted(r[:3] for r in expected(known, window))
    assert substrings.levels(40) == [10, 20, 40] and substrings.levels(20) == [10, 20]


def test_frequent_run_is_dealt_to_several_tasks(spark, monkeypatch):
    from docweave.llm import text

    monkeypatch.setattr(text, "HOT_ROWS", 10)
    passage = " ".join(f"p{i}" for i in range(30))
    docs, known = identified(spark, [(i, f"{i}a {i}b {passage} {i}c {i}d") for i in range(200)])
    assert sorted(map(tuple, substrings.summary(docs).collect()), key=str) == expected(known, 20)


def test_a_text_of_several_mb(spark):
    long = " ".join(f"w{i}" for i in range(600_000))
    rows = [(1, long), (2, "x " + long[len(long) // 2 :]), (3, "short")]
    got = sorted(tuple(r)[:3] for r in substrings.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(rows[1][1].split())
    assert got == [(1, 600_000, 0), (2, n, n - 2 if long[len(long) // 2 - 1] != " " else n - 1), (3, 1, 0)]
