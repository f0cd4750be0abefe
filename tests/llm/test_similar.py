import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import minhash, similar
from docweave.llm.simhash import golay
from test_minhash import edited, shingles
from test_simhash import components


def expected(rows):
    """Smallest id of each row's group, by comparing all pairs of sets."""
    rows = [(r[0], shingles(r[1])) for r in rows]
    sets = sorted({s for _, s in rows}, key=sorted)
    linked = []
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            y = sets[j]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                common = len(x & y)
                if 5 * common >= 4 * (len(x) + len(y) - common):
                    linked.append((i, j))
    group = components(linked, range(len(sets)))
    of = {s: group[i] for i, s in enumerate(sets)}
    least = {}
    for i, s in rows:
        if i is not None:
            least[of[s]] = min(i, least.get(of[s], i))
    each = [(i, len(s), least.get(of[s])) for i, s in rows]
    return sorted(((i, n, c, i == c) for i, n, c in each), key=str)


def found(docs):
    return sorted(map(tuple, similar.near_duplicates(docs).collect()), key=str)


def test_documents_match_brute_force(documents):
    assert found(documents) == expected(documents.select("doc_id", "text").collect())


def test_edge_rows(edge, empty):
    assert found(edge) == expected(edge.select("doc_id", "text").collect())
    assert found(empty) == []


def test_codewords_are_those_within_four_bits_by_cost():
    columns, _, _ = golay()
    rng = np.random.default_rng(5)
    margin = rng.standard_normal((50, 23))
    index, cost = similar.decoded(margin)
    check = lambda v: np.bitwise_xor.reduce(columns[[b for b in range(23) if v >> b & 1]], initial=0)
    words = np.array([top << 11 | int(check(top << 11)) for top in range(4096)])
    assert all(check(int(w)) == 0 for w in words[::97])
    bits = words[:, None] >> np.arange(23) & 1
    for row, got, costs in zip(margin, index, cost):
        wrong = bits != (row > 0)
        near = np.flatnonzero(wrong.sum(axis=1) <= 4)
        want = sorted((float(np.abs(row)[wrong[w]].sum()), int(w)) for w in near)[: similar.LISTED]
        some = np.isfinite(costs)
        assert got[some].tolist() == [w for _, w in want]
        np.testing.assert_allclose(costs[some], [c for c, _ in want], atol=1e-9)


@pytest.mark.parametrize("changes", [3, 5])
def test_scattered_edits_are_found(spark, changes):
    rng = np.random.default_rng(changes)
    base = [[f"w{k}" for k in rng.integers(0, 5000, 260)] for _ in range(250)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(1000 + i, edited(rng, w, changes)) for i, w in enumerate(base)]
    want, got = expected(rows), found(spark.createDataFrame(rows, "doc_id long, text string"))
    links = {r[0] for r in want if r[2] != r[0]}
    hit = {r[0] for r in got if r[2] != r[0]}
    assert len(links) > 100 and hit <= links and len(hit) >= 0.95 * len(links)


def test_large_group_of_copies_that_all_differ(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))] + [(i, edited(rng, base, int(rng.integers(1, 6)))) for i in range(1, 1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = similar.near_duplicates(docs).agg(F.sum((F.col("component_id") == 0).cast("int")), F.count("*")).first()
    assert tuple(got) == (1500, 1500)


def test_crowded_runs_lose_no_pair(spark):
    """A crowd of 60 fingerprints, all near each other under one key: its own candidates are few, the rest has all pairs that no
    group holds."""
    rng = np.random.default_rng(11)
    base, width = rng.integers(0, 2, similar.FILTER_BITS), similar.FILTER_BITS // 8
    rows = []
    for i in range(60):
        bits = base.copy()
        bits[rng.choice(similar.FILTER_BITS, 9, replace=False)] ^= 1
        at = np.full(similar.KEYS, -1, "<i4")
        at[0] = 5
        rows.append((bytes([i]) * 16, np.packbits(bits).tobytes() + at.tobytes()))
    nodes = spark.createDataFrame(rows, "key binary, sig binary")
    groups = spark.createDataFrame([(rows[i][0], 1) for i in range(50)], "key binary, component long")
    found, crowded = similar.candidates(nodes)
    assert len(rows[0][1]) == width + 4 * similar.KEYS and found.count() < 60 * 59 // 2
    assert [r.at for r in crowded.collect()] == [5]
    got = {(bytes(r.a), bytes(r.b)) for r in similar.rest(nodes, groups, crowded).collect()}
    assert got == {(rows[i][0], rows[j][0]) for j in range(60) for i in range(j) if j >= 50}


def test_confirmed_rest_joins_groups(spark):
    texts = {0: "a b c d e f g h", 1: "a b c d e f g h", 2: "p q r s t u v", 3: "a b c d e f g h i", 4: "z y x w v"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    marked = similar.marked(docs)
    nodes = marked.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"))
    key = {r.doc_id: bytes(r.key) for r in marked.collect()}
    groups = spark.createDataFrame([(key[2], 7), (key[3], 7)], "key binary, component long")
    more = spark.createDataFrame([(key[0], key[3]), (key[0], key[4])], "a binary, b binary")
    out = {bytes(r.key): r.component for r in minhash.completed(docs, nodes, groups, more, 80).collect()}
    assert set(out) == {key[0], key[2], key[3]} and len({bytes(c) for c in out.values()}) == 1


def test_a_crowd_gives_a_pair_a_row_and_its_pairs_once(spark):
    """Runs with many near pairs are told as crowded, however few rows they have; a pair that shares two keys comes once, and
    not at all if the bits behind the keys are too far apart."""
    rng = np.random.default_rng(12)
    base, total = rng.integers(0, 2, similar.FILTER_BITS + similar.WIDE_BITS), similar.FILTER_BITS // 8
    rows = []
    for i in range(14):
        bits = base.copy()
        bits[rng.choice(similar.FILTER_BITS, 9, replace=False)] ^= 1
        if i == 0:
            bits[similar.FILTER_BITS :] = rng.integers(0, 2, similar.WIDE_BITS)
        at, packed = np.full(similar.KEYS, -1, "<i4"), np.packbits(bits).tobytes()
        at[:2] = 5, 9
        rows.append((bytes([i]) * 16, packed[:total] + at.tobytes() + packed[total:]))
    nodes = spark.createDataFrame(rows, "key binary, sig binary").coalesce(1)
    found, crowded = similar.candidates(nodes)
    assert found.count() <= 14 * 2 and sorted(r.at for r in crowded.collect()) == [5, 9]
    none = spark.createDataFrame([], "key binary, component long")
    got = [(bytes(r.a), bytes(r.b)) for r in similar.rest(nodes, none, crowded).collect()]
    assert sorted(got) == sorted((rows[i][0], rows[j][0]) for j in range(14) for i in range(1, j))
