"""Merkle manifest of a dataset, and its proofs by a recursive query.

A leaf is the SHA-256 of a row's fields. The leaves of a language, by doc_id,
are hashed in runs of RUN, level by level, to a subroot; the subroots, by
language, likewise to the root. What was built is stored as parent-linked node
rows: a node holds its run's digests side by side, its parent and its place in
the parent's run. One recursive SQL query climbs from every leaf: each step
joins the node above, appends the siblings found there and folds the hash that
comes from below into the run.

Places are found without a window over all rows: rows are range-sorted, and
what lies before a part is added up from one row a part. Nodes whose subtree
has more than BLOCK leaves are stored once a block of leaves, so a step of the
climb never brings more than BLOCK rows to one key, even though all leaves of
a language (which may be most of the table) end in one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch
from .text import staged

RUN = 8
#: Levels below which a node is stored once; RUN**LOW leaves make a block.
LOW = 4
BLOCK = RUN**LOW
#: Bytes of a stored digest. Wherever digests are hashed, they are written as hex text.
WIDTH = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(raw: Column) -> Column:
    return F.unhex(F.sha2(raw, 256))


def shown(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(fields: dict[str, Column]) -> Column:
    """Each field as `-` if null, else as its length in bytes, `:` and the value; hashed together."""
    each = (F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (fields[f].cast("string") for f in FIELDS))
    return hashed(F.concat(*each))


def tampered(doc_id: Column) -> Column:
    """Whether a row is among those that the check lower-cases; never without id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))


def ranged(rows: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, written in the order of by and order with `part` and `at`, (part, by, n, shift)): at + shift is a row's place
    among those with the same `by`, from 0. There is a row of the second table for each part and value of by in it."""
    sort = [*by, *order]
    inside = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    inside = staged(inside.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranged")
    parts = inside.groupBy("part", *by).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return inside, staged(parts.select("part", *by, "n", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")), "parts")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """Of (tree, idx, size, hash), size being the tree's number of leaves: (tree, idx, size, hash, run) for each level above."""
    out, now = [], leaves.select("tree", "idx", "size", "hash")
    left = leaves.agg(F.max("size")).first()[0] or 0
    while left > 1:
        child = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        run = F.aggregate(child, F.lit(b""), lambda seen, c: F.concat(seen, c["hash"]))
        above = now.filter("size > 1").groupBy("tree", F.floor(F.col("idx") / RUN).alias("idx")).agg(F.ceil(F.max("size") / RUN).alias("size"), run.alias("run"))
        now = staged(above.withColumn("hash", hashed(shown(F.col("run")))), "level")
        out.append(now)
        left = -(-left // RUN)
    return out


def _id(*parts) -> Column:
    return F.concat_ws("/", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def _blocks(size: Column) -> Column:
    """The last block of a tree of so many leaves."""
    return F.floor((size - 1) / BLOCK)


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, bytes | None]:
    """(leaves, nodes, root) of docs (FIELDS).

    leaves: doc_id, leaf, start (the leaf, tampered with where tampered() says
    so), tree, idx, parent, place, subroot (for a tree that is one leaf). nodes:
    id, parent, place, run, subroot (where the node is one). parent is null at
    the root. An empty table has no root.
    """
    field = {f: F.col(f) for f in FIELDS}
    other = field | {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    key = F.coalesce(F.concat(F.lit("v"), F.col("lang").cast("string")), F.lit("n"))
    rows = docs.select("doc_id", key.alias("key"), leaf(field).alias("leaf"), F.when(tampered(F.col("doc_id")), leaf(other)).alias("other"), F.monotonically_increasing_id().alias("row"))
    inside, parts = ranged(staged(rows, "leaves"), ["key"], ["doc_id", "leaf", "row"])
    keys, key_parts = ranged(parts.select("key").distinct(), [], ["key"])
    trees = keys.join(key_parts.select("part", "shift"), "part").select("key", (F.col("at") + F.col("shift")).alias("tree"))
    trees = staged(trees.join(parts.groupBy("key").agg(F.sum("n").alias("leaves")), "key"), "trees")
    placed = parts.drop("n").join(trees, "key")
    leaves = inside.join(placed, ["part", "key"]).select("doc_id", "leaf", F.coalesce("other", "leaf").alias("start"), "tree", (F.col("at") + F.col("shift")).alias("idx"), F.col("leaves").alias("size"))
    leaves = staged(leaves, "placed")

    inner = levels(leaves.withColumnRenamed("leaf", "hash"))
    tops = leaves.filter("size = 1").select("tree", F.col("leaf").alias("hash"))
    for level in inner:
        tops = tops.unionByName(level.filter("size = 1").select("tree", "hash"))
    tops = staged(tops, "subroots")
    n_trees = tops.count()
    if not n_trees:
        return leaves, None, None
    outer = levels(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).alias("size"), "hash"))
    root = (outer[-1] if outer else tops).select("hash").first()[0]

    def above(level: int, tree: Column, idx: Column, block: Column) -> dict[str, Column]:
        """Parent and place of the node idx on a level of a tree that has more levels."""
        parent = _id(tree, level + 1, F.floor(idx / RUN)) if level < LOW else _id(tree, level + 1, F.concat(F.lit("@"), block.cast("string")))
        return {"parent": parent, "place": (idx % RUN).cast("int")}

    def beyond(tree: Column, block: Column) -> dict[str, Column]:
        """Parent and place of a subroot."""
        return {"parent": _id("root", 1, tree, block) if outer else F.lit(None).cast("string"), "place": (tree % RUN).cast("int")}

    def linked(level: int, rows: DataFrame, top: str, block: Column) -> DataFrame:
        tree, idx = F.col("tree"), F.col("idx")
        inside_, out = above(level, tree, idx, block), beyond(tree, block)
        return rows.withColumns({c: F.when(F.col("size") > 1, inside_[c]).otherwise(out[c]) for c in ("parent", "place")}).withColumn("subroot", F.when(F.col("size") == 1, F.col(top)))

    span = trees.select("tree", F.sequence(F.lit(0).cast("bigint"), _blocks(F.col("leaves"))).alias("blocks"))
    nodes = []
    for k, rows in enumerate(inner, 1):
        if k <= LOW:
            at = rows.withColumns({"block": F.floor(F.col("idx") / RUN ** (LOW - k)), "id": _id(F.col("tree"), k, F.col("idx"))})
        else:
            wide = RUN ** (k - LOW)
            last = F.least((F.col("idx") + 1) * wide - 1, _blocks(F.col("leaves")))
            at = rows.join(trees.select("tree", "leaves"), "tree").withColumn("block", F.explode(F.sequence(F.col("idx") * wide, last)))
            at = at.withColumn("id", _id(F.col("tree"), k, F.concat(F.lit("@"), F.col("block").cast("string"))))
        nodes.append(linked(k, at, "hash", F.col("block")))
    for k, rows in enumerate(outer, 1):
        below = span.select("tree", F.explode("blocks").alias("block"), F.floor(F.col("tree") / RUN**k).alias("idx"))
        at = rows.select("idx", "run", "size").join(below, "idx")
        parent = F.when(F.col("size") > 1, _id("root", k + 1, F.col("tree"), F.col("block")))
        nodes.append(at.select(_id("root", k, F.col("tree"), F.col("block")).alias("id"), parent.alias("parent"), (F.col("idx") % RUN).cast("int").alias("place"), "run", F.lit(None).cast("binary").alias("subroot")))
    columns = ["id", "parent", "place", "run", "subroot"]
    stored = None
    for part in nodes:
        part = part.select(*columns)
        stored = part if stored is None else stored.unionByName(part)
    if stored is None:
        stored = docs.sparkSession.createDataFrame([], "id string, parent string, place int, run binary, subroot binary")
    return linked(0, leaves, "leaf", F.floor(F.col("idx") / BLOCK)), staged(stored, "nodes"), root


_CLIMB = f"""
WITH RECURSIVE climb (tree, idx, level, doc_id, leaf, folded, parent, place, siblings, subroot) AS (
    SELECT tree, idx, 0, doc_id, leaf, start, parent, place, CAST('' AS BINARY), subroot FROM {{leaves}}
    UNION ALL
    SELECT c.tree, c.idx, c.level + 1, NULL, NULL,
        unhex(sha2(lower(hex(concat(substring(n.run, 1, {WIDTH} * c.place), c.folded, substring(n.run, {WIDTH} * c.place + {WIDTH + 1})))), 256)),
        n.parent, n.place, concat(substring(n.run, 1, {WIDTH} * c.place), substring(n.run, {WIDTH} * c.place + {WIDTH + 1})), n.subroot
    FROM climb c JOIN {{nodes}} n ON n.id = c.parent)
SELECT max(doc_id) AS doc_id, max(leaf) AS leaf, max(subroot) AS subroot, max_by(folded, level) AS folded_root,
    sha2(lower(array_join(transform(array_sort(collect_list(struct(level, siblings))), s -> hex(s.siblings)), '')), 256) AS proof_sha256
FROM climb GROUP BY tree, idx"""


def _side_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one, whose recursive queries may return any number of rows."""
    side = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            side.conf.set(name, value)
    side.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return side


def proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of docs (FIELDS; other columns are ignored).

    Null fields count as `-` in a leaf. Null languages are a tree of their own,
    the first; null ids come first in their tree and are never tampered with;
    rows with equal ids are ordered by their leaf, and equal rows each have a
    place. A very long text is hashed whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    leaves, nodes, root = manifest(docs.select(*FIELDS))
    if root is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    side, path = _side_session(spark), scratch(spark, "proofs")
    at = staged(leaves.select("tree", "idx", "doc_id", "leaf", "start", "parent", "place", "subroot"), "anchors")
    names = {"leaves": at, "nodes": nodes}
    for name, df in names.items():
        side.read.schema(df.schema).parquet(df._staged_at).createOrReplaceTempView(name)
    side.sql(_CLIMB.format(leaves="leaves", nodes="nodes")).write.parquet(path)
    found = spark.read.parquet(path)
    digest = F.lit(root)
    return found.select("doc_id", shown(F.col("leaf")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), shown(digest).alias("root"), "proof_sha256", shown(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == digest).alias("verified"))
