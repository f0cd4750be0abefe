import re

import numpy as np
import pytest
import xxhash

from docweave.llm import simhash

MASK = (1 << 64) - 1


def components(pairs, nodes=()):
    parent = {n: n for n in nodes}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in pairs:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def fingerprint(text):
    raw = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def close(values):
    arr = np.array(values, np.uint64)
    return [(int(arr[i]), int(arr[i + 1 + j])) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4)]


def expected(rows):
    fp = [(r[0], fingerprint(r[1])) for r in rows]
    group = components(close(sorted({f for _, f in fp})), {f for _, f in fp})
    least = {}
    for i, f in fp:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    return sorted(((i, f"{f:016x}", least.get(group[f])) for i, f in fp), key=str)


def test_documents_match_brute_force(documents):
    got = simhash.near_duplicates(documents).collect()
    assert sorted(map(tuple, got), key=str) == expected(documents.select("doc_id", "text").collect())


def test_edge_rows(edge, empty):
    got = simhash.near_duplicates(edge).collect()
    assert sorted(map(tuple, got), key=str) == expected(edge.select("doc_id", "text").collect())
    assert simhash.near_duplicates(empty).count() == 0


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 23, 300)
    flip = np.array([sum(1 << int(b) for b in rng.choice(23, rng.integers(0, 3), replace=False)) for _ in x])
    a, b = simhash.golay_keys(x)[0], simhash.golay_keys(x ^ flip)[0]
    assert all(set(p) & set(q) for p, q in zip(a.tolist(), b.tolist()))
    assert {int(simhash.golay_keys(x[i : i + 1])[1].sum()) for i in range(300)} == {1, 6}


@pytest.mark.parametrize("short_run", [1024, 48])
def test_random_and_dense_fingerprints(spark, monkeypatch, short_run):
    verify = simhash._verify_runs
    monkeypatch.setattr(simhash, "_verify_runs", lambda batches, f=verify: (simhash.__dict__.__setitem__("SHORT_RUN", short_run), f(batches))[1])
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 120, dtype=np.uint64) * np.uint64(2)]
    fps = set(base)
    for x in base[:100]:
        fps |= {x ^ sum(1 << int(b) for b in rng.choice(64, e, replace=False)) for e in (1, 2, 3, 4, 5)}
    fps |= {base[0] ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(400)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in sorted(fps)], "fp long")
    got = [(r.a & MASK, r.b & MASK) for r in simhash.links(df).collect()]
    assert components(got) == components(close(sorted(fps)))


def test_links_run_over_fingerprints(spark, monkeypatch):
    """Rows without id carry links; rows that share an id are not linked by it."""
    rows = [(2, 0), (5, 0x0F), (5, 0x0F0F0F0F0F), (1, 0xFF << 40), (None, 0x0F << 40), (9, 0), (None, 0x7 << 20)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select("doc_id", "fp"))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    least = components(close(sorted({f for _, f in rows})), {f for _, f in rows})
    ids = {g: min((i for i, f in rows if least[f] == g and i is not None), default=None) for g in set(least.values())}
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((i, ids[least[f]]) for i, f in rows), key=str)
    assert (5, 5) in [(r.doc_id, r.component_id) for r in got]
