import re

import numpy as np
import pytest

from docweave.llm import minhash
from docweave.llm.components import connected_components
from test_simhash import components


def shingles(text):
    raw = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(rows):
    rows = [(r[0], shingles(r[1])) for r in rows]
    sets = sorted({s for _, s in rows if s}, key=sorted)
    linked = []
    for i, x in enumerate(sets):
        for y in sets[i + 1 :]:
            if 100 * min(len(x), len(y)) >= 85 * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= 85 * (len(x) + len(y) - common):
                    linked.append((sets.index(x), sets.index(y)))
    group = components(linked, range(len(sets)))
    of = {s: group[i] for i, s in enumerate(sets)}
    least = {}
    for i, s in rows:
        if s and i is not None:
            least[of[s]] = min(i, least.get(of[s], i))
    each = [(i, len(s), least.get(of[s]) if s else i) for i, s in rows]
    return sorted(((i, n, c, i == c) for i, n, c in each), key=str)


def found(docs, **names):
    return sorted(map(tuple, minhash.near_duplicates(docs, **names).collect()), key=str)


def test_documents_match_brute_force(documents):
    assert found(documents) == expected(documents.select("doc_id", "text").collect())


def test_edge_rows(edge, empty):
    assert found(edge) == expected(edge.select("doc_id", "text").collect())
    assert found(empty) == []


def test_rows_without_id_keep_links_and_shared_ids_do_not_link(spark):
    base = [f"w{i}" for i in range(200)]
    a, c = " ".join(base[:190]), " ".join(base[18:])
    b, other = " ".join(base[9:195]), " ".join(f"v{i}" for i in range(100))
    docs = spark.createDataFrame([(1, a), (None, b), (9, c), (3, other), (9, other), (None, "lonely row")], "own long, body string")
    got = found(docs, id_col="own", text_col="body")
    assert got == expected(docs.collect())
    assert (9, 178, 1, False) in got and (9, 96, 3, False) in got and (None, 1, None, True) in got


def edited(rng, words, changes):
    out = list(words)
    for at in rng.choice(len(out), changes, replace=False):
        out[at] = f"e{rng.integers(1 << 30)}"
    return " ".join(out)


@pytest.mark.parametrize("crowd,few", [(16, 20_000), (4, 0)])
def test_crowded_regions_lose_no_link(spark, monkeypatch, crowd, few):
    """Many texts share three quarters of their words, some are copies of one with few edits, and one group is dense."""
    monkeypatch.setattr(minhash, "_candidates", lambda batches, f=minhash._candidates: (minhash.__dict__.__setitem__("CROWD", crowd), f(batches))[1])
    monkeypatch.setattr(minhash, "FEW_LINKS", few)
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(150)]
    own = [[*common, *(f"u{k}x{i}" for i in range(50))] for k in range(150)]
    texts = [" ".join(w) for w in own] + [edited(rng, own[k], 3) for k in range(0, 60)]
    dense = [f"d{i}" for i in range(200)]
    texts += [edited(rng, dense, int(rng.integers(0, 4))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(docs) == expected(docs.collect())


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(1000)]
    raw = [t.encode() for t in (" ".join(base), edited(rng, base, 20))]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h, first = minhash.shingle_sets(buf, off)
    x, y = (shingles(t.decode()) for t in raw)
    assert np.diff(first).tolist() == [len(x), len(y)]
    sig = minhash.signatures(h, first)
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.12


def test_components_in_one_task_and_in_rounds(spark):
    rng = np.random.default_rng(7)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))] + chain + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    rounds, one = (sorted(map(tuple, connected_components(df, in_task=n).collect())) for n in (0, 1000))
    assert one == rounds == sorted(components([e for e in edges if None not in e and e[0] != e[1]]).items())
