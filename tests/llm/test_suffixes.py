import hashlib
import random
from collections import Counter, defaultdict

from docweave.llm import suffixes


def expected(rows, n):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(hashlib.md5(x[s : s + n]).digest() for x in raw for s in range(len(x) - n + 1))
    out = []
    for (doc_id, _), x in zip(rows, raw):
        cover, spans, removed = -1, 0, bytearray(len(x))
        for s in range(len(x) - n + 1):
            if seen[hashlib.md5(x[s : s + n]).digest()] > 1:
                removed[s : s + n] = b"\1" * n
        kept = bytes(b for b, r in zip(x, removed) if not r)
        spans = sum(1 for i, r in enumerate(removed) if r and (i == 0 or not removed[i - 1]))
        out.append((doc_id, len(x), sum(removed), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_documents_match_brute_force(documents):
    got = sorted(map(tuple, suffixes.summary(documents).collect()), key=str)
    assert got == expected(documents.select("doc_id", "text").collect(), 400)
    assert any(0 < r[2] < r[1] for r in got)


def test_edges(edge, empty):
    got = sorted(map(tuple, suffixes.summary(edge).collect()), key=str)
    assert got == expected(edge.select("doc_id", "text").collect(), 400)
    assert suffixes.summary(empty).count() == 0


def planted(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    passage = [some(n) for n in (399, 400, 401, 650)] + ["xy" * 300]
    rows = []
    for i in range(80):
        text = some(rng.randint(0, 300))
        for p in rng.sample(passage, rng.randint(0, 3)):
            cut = rng.randint(0, 30)
            text += p[cut:] + some(rng.randint(0, 40))
        rows.append((i, text))
    return rows


def test_planted_passages_scanned_and_counted(spark, monkeypatch):
    rows = planted(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows, 400)
    assert sorted(map(tuple, suffixes.summary(docs).collect()), key=str) == want
    scan = suffixes._scan
    monkeypatch.setattr(suffixes, "_scan", lambda *a: lambda batches, f=scan(*a): (suffixes.__dict__.__setitem__("LARGE", 3), f(batches))[1])
    assert sorted(map(tuple, suffixes.summary(docs).collect()), key=str) == want


def test_repeats_have_all_their_occurrences(spark):
    rows = planted(9)[:30]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = defaultdict(set)
    for r in suffixes.maximal_repeats(docs).collect():
        found[r.repeat].add((r.doc_id, r.start, r.length))
    texts = dict(rows)
    assert found
    for places in found.values():
        doc, start, length = next(iter(places))
        string = texts[doc][start : start + length]
        assert length >= 400 and all(texts[d][s : s + n] == string for d, s, n in places)
        everywhere = {(d, s, length) for d, t in rows for s in range(len(t) - length + 1) if t.startswith(string, s)}
        assert places == everywhere
