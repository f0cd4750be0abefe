"""MinHash near-duplicates through an LSH forest.

A document is its set of distinct 5-word shingles, as 64-bit hashes; documents
with one set are one node, named by a 128-bit digest of the set, so copies
never multiply. A node's signature holds a byte of each of TREES * WIDTH
min-hashes. Each tree is an order of all signatures: the signature turned so
that the tree's own WIDTH bytes come first and the others follow, sorted by
range over the cluster.

Candidates are neighbours by their longest common prefix. How deep two
signatures have to agree depends on the region: they are a pair where those
that share their common prefix are at most CROWD, so a prefix of LEAST bytes is
enough where few share it, while in a crowded region (a common passage) only
deeper, smaller groups count. Each signature is also paired with the ones next
to it in every order. Both need CROWD rows around a row only, so a task
streams through its range whatever the size of a region, and a region may span
any number of tasks. At the limit of 0.85 a pair shares LEAST bytes in none of
the twelve orders once in 100,000; where regions are crowded with texts of
three quarters the same shingles, once in some thousand.

Candidates whose signatures agree too little are left out, by five standard
deviations below the limit. All others are confirmed on the full sets, but for
pairs that chains of confirmed links already connect: first each node's
best pair, then also the node with the most links beside its candidates, then
all that remain. Where candidates turn out to be apart, each is held against
the node with the most links beside the other, until that finds nothing more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .text import LOWER, NOT_SPACE, may_be_in, meet, mixed, pieces, sequence_hash, staged, word_hashes, words

SHINGLE_WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
TREES, WIDTH = 12, 10
POSITIONS = TREES * WIDTH
LEAST, CROWD = 3, 16
#: Equal bytes that a candidate needs: the limit's share less five standard deviations.
AGREE = int(POSITIONS * PERCENT / 100 - 5 * (POSITIONS * PERCENT / 100 * (1 - PERCENT / 100)) ** 0.5)
#: Rounds in which each node offers its best pairs only.
BEST_ROUNDS = 2
#: Links between groups that one task merges; more take rounds over the cluster.
FEW_LINKS = 20_000
_FACTORS = mixed(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles as ascending hashes, row after row, and each row's first one (one entry more than rows)."""
    low = LOWER[buf]
    starts, ends, first = words(low, off, NOT_SPACE)
    count = np.diff(first)
    rows = len(count)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    h = word_hashes(low, starts, ends)
    of = np.repeat(np.arange(rows), count)
    runs = sequence_hash(h, k)
    whole = np.flatnonzero(np.arange(len(runs)) + k <= first[1:][of[: len(runs)]])
    short = np.flatnonzero((count > 0) & (count < k))
    few = [sequence_hash(h[first[r] : first[r + 1]], int(count[r]), int(count[r]))[0] for r in short]
    row, value = np.concatenate([of[whole], short]), np.concatenate([runs[whole], np.array(few, np.uint64)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])]
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(rows + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, POSITIONS) bytes; rows without shingles have zeros."""
    out = np.zeros((len(first) - 1, POSITIONS), np.uint8)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for p, factor in enumerate(_FACTORS):
            out[some, p] = mixed(np.minimum.reduceat(h * factor, first[some])) & np.uint64(0xFF)
    return out


def set_names(h: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each row's set, null for an empty one."""
    return [xxhash.xxh3_128_digest(h[a:b].tobytes()) if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, sig) of (doc_id, text): the size, name and signature of each row's set; key and sig are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for _, _, buf, off in pieces(batch.column(1), 1 << 19):
                h, first = shingle_sets(buf, off)
                key = set_names(h, first)
                sizes.append(np.diff(first))
                keys += key
                sigs += [s.tobytes() if k is not None else None for s, k in zip(signatures(h, first), key)]
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n", "key", "sig"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, key binary, sig binary")


def _pairs_of(tree: np.ndarray, sig: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, agreeing bytes) of the candidates with lo <= i < hi among rows in order."""
    n = len(sig)
    differ = sig[1:] != sig[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), POSITIONS).astype(np.int16)
    lcp[tree[1:] != tree[:-1]] = -1
    # The depth that CROWD + 1 rows from s on have in common; pairs at no greater depth lie in a crowd.
    padded = np.concatenate([np.full(CROWD, -1, np.int16), lcp, np.full(2 * CROWD, -1, np.int16)])
    crowd = np.lib.stride_tricks.sliding_window_view(padded, CROWD).min(axis=1)
    found = []
    for d in range(1, CROWD):
        if n <= d:
            break
        common = np.lib.stride_tricks.sliding_window_view(lcp, d).min(axis=1)
        i = np.arange(len(common))
        # Windows of CROWD + 1 rows that hold both i and i + d begin from i + d - CROWD to i.
        around = np.lib.stride_tricks.sliding_window_view(crowd, CROWD - d + 1).max(axis=1)[i + d]
        take = (common >= LEAST) & (around < common)
        if d == 1:
            take |= common >= LEAST
        i = np.flatnonzero(take & (i >= lo) & (i < hi))
        found.append(np.stack([i, i + d], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    agree = np.concatenate([(sig[p[:, 0]] == sig[p[:, 1]]).sum(axis=1) for p in np.array_split(pairs, max(1, len(pairs) >> 16))])
    good = agree >= AGREE
    return pairs[good, 0], pairs[good, 1], agree[good]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, turned, key) in order to pairs (a, b, agree), a < b. Only some rows before and behind are held."""
    tree, sig, key = np.zeros(0, np.int32), np.zeros((0, POSITIONS), np.uint8), pa.array([], pa.binary())
    done = 0

    def settle(hi: int) -> pa.RecordBatch:
        i, j, agree = _pairs_of(tree, sig, done, hi)
        ends = [key.take(pa.array(x)).to_pylist() for x in (i, j)]
        both = [(a, b) if a < b else (b, a) for a, b in zip(*ends)]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in both], pa.binary()), pa.array([b for _, b in both], pa.binary()), pa.array(agree.astype(np.int32))], ["a", "b", "agree"])

    for batch in batches:
        if not batch.num_rows:
            continue
        turned = batch.column(1)
        data = np.frombuffer(b"".join(turned.to_pylist()), np.uint8).reshape(-1, POSITIONS)
        tree, sig = np.concatenate([tree, batch.column(0).to_numpy(zero_copy_only=False)]), np.concatenate([sig, data])
        key = pa.concat_arrays([key, batch.column(2)])
        hi = len(sig) - 2 * CROWD
        if hi > done:
            yield settle(hi)
            drop = max(0, hi - 2 * CROWD)
            tree, sig, key, done = tree[drop:], sig[drop:], key.slice(drop), hi - drop
    if len(sig) > done:
        yield settle(len(sig))


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b, agree): candidate pairs, each once, of nodes (key, sig). Nodes with one signature are paired with the least of them."""
    same = staged(nodes.groupBy("sig").agg(F.min("key").alias("least"), F.count("*").alias("n")), "signatures")
    star = meet(nodes.select("sig", "key"), same.filter("n > 1"), ["sig"], "n", ["key"]).filter("key != least")
    turned = F.expr(f"concat(substring(sig, tree * {WIDTH} + 1), substring(sig, 1, tree * {WIDTH}))")
    orders = same.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), F.col("least").alias("key"), "sig").select("tree", turned.alias("turned"), "key")
    found = orders.repartitionByRange("tree", "turned").sortWithinPartitions("tree", "turned").mapInArrow(_candidates, "a binary, b binary, agree int")
    found = found.unionByName(star.select(F.col("least").alias("a"), F.col("key").alias("b"), F.lit(POSITIONS).alias("agree")))
    return staged(found.groupBy("a", "b").agg(F.max("agree").alias("agree")), "candidates")


def _texts(docs: DataFrame, nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, key, text) of keys: a number for each, and a text that has the set, found by the node's least doc_id."""
    wanted = keys.join(nodes.select("key", "least"), "key").withColumn("id_hash", F.xxhash64("least"))
    wanted = staged(wanted, "wanted")
    near = may_be_in(docs.withColumn("id_hash", F.xxhash64("doc_id")), wanted.select("id_hash"), "id_hash").filter("__may").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [k for _, _, buf, off in pieces(batch.column(1), 1 << 19) for k in set_names(*shingle_sets(buf, off))]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), batch.column(0), batch.column(1)], ["key", "doc_id", "text"])

    read = near.mapInArrow(run, f"key binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string").filter("key is not null")
    met = read.join(wanted, "key").filter(F.col("doc_id").eqNullSafe(F.col("least"))).select("key", "text").dropDuplicates(["key"])
    return staged(met.select(F.monotonically_increasing_id().alias("id"), "key", "text"), "texts")


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text of a, text of b) to the pairs that are similar enough, by their full sets."""
    for batch in batches:
        sides = []
        for column in (2, 3):
            sides.append([h[first[r] : first[r + 1]] for _, _, buf, off in pieces(batch.column(column), 1 << 19) for h, first in [shingle_sets(buf, off)] for r in range(len(off) - 1)])
        keep = []
        for x, y in zip(*sides):
            less, more = sorted((len(x), len(y)))
            common = len(np.intersect1d(x, y, assume_unique=True)) if 100 * less >= percent * more else 0
            keep.append(100 * common >= percent * (less + more - common))
        kept = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    asked = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return staged(asked.mapInArrow(lambda batches: _confirm(batches, percent), "a long, b long"), "links")


def _best(pairs: DataFrame) -> DataFrame:
    """Each node's pair with the greatest weight."""
    best = F.max(F.struct("weight", "a", "b")).alias("p")
    return pairs.withColumn("node", F.explode(F.array("a", "b"))).groupBy("node").agg(best).select("p.a", "p.b").distinct()


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs that no chain of links connects."""
    for c in ("a", "b"):
        pairs = pairs.join(groups.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
    return pairs.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).drop("of_a", "of_b")


def _merged(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """groups after more links: those between groups are merged as links of whole groups."""
    if groups is None:
        return staged(connected_components(links, in_task=FEW_LINKS), "groups")
    for c in ("a", "b"):
        links = links.join(groups.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
    between = links.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).filter("a != b").distinct()
    more = connected_components(between, in_task=FEW_LINKS).select(F.col("id").alias("component"), F.col("component").alias("now"))
    moved = groups.join(more, "component", "full_outer")
    return staged(moved.select(F.coalesce("id", "component").alias("id"), F.coalesce("now", "component").alias("component")).distinct(), "groups")


def _by_way_of(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, weight): for each pair (x, y) both ways, x with the node that y is linked with that has the most links; weight
    counts the pairs that lead there. In a crowd of copies that are like their source but less like each other, the source
    is among the few candidates of some copies only, and the others find it through them."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("b").agg(F.count("*").alias("n"))
    star = both.join(degree, "b").groupBy("a").agg(F.max(F.struct("n", "b")).alias("s")).select("a", F.col("s.b").alias("star"))
    ways = pairs.select(F.col("a").alias("x"), F.col("b").alias("a")).unionByName(pairs.select(F.col("b").alias("x"), "a"))
    found = ways.join(star, "a").filter("x != star")
    return found.groupBy(F.least("x", "star").alias("a"), F.greatest("x", "star").alias("b")).agg(F.count("*").alias("weight"))


def components(docs: DataFrame, nodes: DataFrame, find: Callable[[DataFrame], DataFrame] = candidates, percent: int = PERCENT) -> DataFrame:
    """(key, component): the nodes that have a link, and a number that those share which chains of links connect."""
    found = find(nodes)
    none = docs.sparkSession.createDataFrame([], "key binary, component long")
    if found.isEmpty():
        return none
    texts = _texts(docs, nodes, found.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    number = lambda c: texts.select(F.col("key").alias(c), F.col("id").alias(f"{c}_id"))
    numbered = found.join(number("a"), "a").join(number("b"), "b")
    pairs = staged(numbered.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), F.col("agree").cast("long").alias("weight")), "pairs")

    links, groups, asked, left = None, None, None, pairs
    for turn in range(BEST_ROUNDS + 1):
        chosen = left if turn == BEST_ROUNDS else _best(left)
        if turn:
            ways = _by_way_of(left, links)
            chosen = chosen.select("a", "b").unionByName(_best(ways) if turn < BEST_ROUNDS else ways.select("a", "b")).distinct()
            chosen = _apart(chosen.join(asked, ["a", "b"], "left_anti"), groups)
        chosen = staged(chosen.select("a", "b"), "chosen")
        new = _confirmed(chosen, texts, percent)
        links = new if links is None else links.unionByName(new)
        asked = chosen if asked is None else asked.unionByName(chosen)
        groups = _merged(groups, new)
        left = staged(_apart(pairs.join(asked, ["a", "b"], "left_anti") if turn < BEST_ROUNDS else pairs, groups), "left")
        if left.isEmpty():
            break
    else:
        while True:
            more = staged(_apart(_by_way_of(left, links).join(asked, ["a", "b"], "left_anti"), groups).select("a", "b"), "more")
            if more.isEmpty():
                break
            new = _confirmed(more, texts, percent)
            if new.isEmpty():
                break
            links, asked, groups = links.unionByName(new), asked.unionByName(more), _merged(groups, new)
            left = staged(_apart(left, groups), "left")
    return groups.join(texts.select("id", "key"), "id").select("key", "component")


def completed(docs: DataFrame, nodes: DataFrame, groups: DataFrame, more: DataFrame, percent: int) -> DataFrame:
    """groups (key, component) after the pairs (a, b) of nodes in different groups, all of which are confirmed on the full sets."""
    more = staged(more, "more")
    if more.isEmpty():
        return groups
    texts = _texts(docs, nodes, more.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    pairs = more
    for c in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("key").alias(c), F.col("id").alias(f"{c}_id")), c)
    links = _confirmed(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), texts, percent)
    if links.isEmpty():
        return groups
    for c in ("a", "b"):
        links = links.join(texts.select(F.col("id").alias(c), F.col("key").alias(f"key_{c}")), c).drop(c)
    groups = staged(groups, "groups")
    least = groups.groupBy("component").agg(F.min("key").alias("least"))
    edges = links.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).unionByName(groups.join(least, "component").select(F.col("key").alias("a"), F.col("least").alias("b")))
    return connected_components(edges).withColumnRenamed("id", "key")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mark: Callable[[DataFrame], DataFrame] = marked,
    find: Callable[[DataFrame], DataFrame] = candidates,
    percent: int = PERCENT,
    rest: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; mark names the sets and find gives the pairs to confirm.
    Where find may leave out pairs, rest gives all those of nodes that the groups so far keep apart.

    A null, empty or wordless text has no shingles, is linked with nothing and
    is its own component. Rows with equal sets are linked whatever their ids;
    rows that repeat an id each get a row and are not linked by it. A row
    without id takes part in links; component_id is null only if none of its
    component has an id. A very long text is read whole; an empty table gives
    no rows. Only the two named columns are read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(mark(docs), "marked")
    some = rows.filter("key is not null")
    nodes = staged(some.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("sig").alias("sig")), "nodes")
    groups = components(docs, nodes, find, percent)
    if rest is not None:
        groups = completed(docs, nodes, groups, rest(nodes, groups), percent)
    grouped = groups.join(nodes.select("key", "least"), "key")
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "component").select("key", "component_id", F.lit(True).alias("linked"))
    classes = nodes.join(named, "key", "left").select("key", "copies", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    met = meet(some.select("doc_id", "n", "key"), staged(classes, "classes"), ["key"], "copies", ["doc_id"])
    alone = rows.filter("key is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = met.select("doc_id", "n", "component_id").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
