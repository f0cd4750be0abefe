"""Connected components of an edge table by alternating large-star and small-star rounds.

Edges never meet in one task: a round is two grouped minima (combined before
the shuffle) and two joins whose skewed side Spark can split. Each round's
edges are written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of numbers to (id, component), by smallest neighbours and jumps."""
    ends = [np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(2)]) for b in batches if b.num_rows]
    if not ends:
        return
    ids, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(ids))
    while True:
        new = root.copy()
        np.minimum.at(new, root[x], root[y])
        np.minimum.at(new, root[y], root[x])
        new = np.minimum(new, new[root])
        while (jump := new[new] < new).any():
            new = np.where(jump, new[new], new)
        if np.array_equal(new, root):
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", in_task: int = 0) -> DataFrame:
    """(id, component) for each id in the edges; component is the smallest id reachable.

    Null ends and loops are ignored; an empty table gives an empty table. Edges
    of numbers that are at most in_task, which is a bound on one task's memory,
    take one task instead of rounds; the result is the same.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a != b")
    now = staged(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _state(now)
    if 0 < seen[0] <= in_task:
        return now.select("a", "b").coalesce(1).mapInArrow(_in_one_task, "id long, component long")
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        was, seen = seen, _state(now)
        if was == seen:
            break
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
