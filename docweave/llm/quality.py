"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees grown on the labelled rows give paths; each path from the root to a node
is a rule, a conjunction of thresholds. A logistic regression with an L1
penalty weighs the rules and drops most of them. The rules that remain are
compiled into one Spark column expression, so scoring a row needs its
statistics and no model object.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, NOT_SPACE, pieces, staged, word_hashes, words

TREES = 24
DEPTH = 3
LASSO = 0.002

STATISTICS = ["log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "stop", "bar", "bang", "non_ascii", "distinct_words", "top_word", "line_words", "space", "word_symbol_end"]


def _share(mask: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(mask)]
    return (total[off[1:]] - total[off[:-1]]) / np.maximum(size, 1)


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:'\"?()-"]] = True


def _statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a slice; of texts without bytes or words they are zero."""
    size = np.diff(off)
    out = np.zeros((len(size), len(STATISTICS)))
    if not len(buf):
        return out
    starts, ends, first = words(buf, off, NOT_SPACE)
    count = np.diff(first)
    row = np.repeat(np.arange(len(size)), count)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(count)
    out[:, 2] = np.bincount(row, ends - starts, len(size)) / np.maximum(count, 1)
    for k, mask in ((3, (buf >= 0x41) & (buf <= 0x5A)), (4, (buf >= 0x30) & (buf <= 0x39)), (5, _SYMBOL[buf]), (6, (buf == 0x2E) | (buf == 0x2C)), (7, buf == 0x7C), (8, buf == 0x21), (9, buf >= 0x80), (13, ~NOT_SPACE[buf])):
        out[:, k] = _share(mask, off, size)
    if len(starts):
        low = LOWER[buf]
        h = word_hashes(low, starts, ends)
        order = np.lexsort((h, row))
        h, at = h[order], row[order]
        edge = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])])
        run = np.diff(np.r_[edge, len(h)])
        out[:, 10] = np.bincount(at[edge], minlength=len(size)) / np.maximum(count, 1)
        most = np.zeros(len(size))
        np.maximum.at(most, at[edge], run)
        out[:, 11] = most / np.maximum(count, 1)
        out[:, 14] = np.bincount(row, _SYMBOL[buf[ends - 1]], len(size)) / np.maximum(count, 1)
    lines = 1 + (np.r_[0, np.cumsum(buf == 0x0A)][off[1:]] - np.r_[0, np.cumsum(buf == 0x0A)][off[:-1]])
    out[:, 12] = count / lines
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, one double for each of STATISTICS) of whole texts; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_statistics(buf, off) for _, _, buf, off in pieces(batch.column(1))]
            found = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(STATISTICS)))], ["doc_id", *STATISTICS])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most rather than above, threshold), ...


def tree_rules(description: str) -> list[Rule]:
    """The path to each node of the trees, as Spark prints them; conditions on one side of a statistic are merged."""
    path: list[tuple[str, bool, float]] = []
    rules: dict[Rule, None] = {}
    for line in description.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.eE0-9]+)\)", line)
        if not found:
            continue
        depth = len(found[1]) - 4
        del path[max(0, depth) :]
        path.append((STATISTICS[int(found[2])], found[3] == "<=", float(found[4])))
        merged: dict[tuple[str, bool], float] = {}
        for name, most, value in path:
            old = merged.get((name, most), value)
            merged[name, most] = min(old, value) if most else max(old, value)
        rules[tuple(sorted((n, m, v) for (n, m), v in merged.items()))] = None
    return list(rules)


def rule_column(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, ((F.col(n) <= v) if most else (F.col(n) > v) for n, most, v in rule))


@dataclass
class RuleEnsemble:
    """score = logistic(bias + the weights of the rules that hold)."""

    bias: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.weights.items():
            total = total + F.when(rule_column(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(rows: DataFrame, label: str = "label", seed: int = 7) -> RuleEnsemble:
    """A rule ensemble for the 0/1 column `label` of rows with STATISTICS.

    Where only one label occurs (or none), the score is constant: the share of
    label 1, smoothed by one row of each.
    """
    rows = staged(rows.filter(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), *STATISTICS), "training")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n, ones = sum(counts.values()), counts.get(1.0, 0)
    if len(counts) < 2:
        return RuleEnsemble(float(np.log((ones + 1) / (n - ones + 1))), {})
    featured = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"), *STATISTICS)
    weight = F.when(F.col("label") == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="sqrt", seed=seed, weightCol="weight").fit(featured.withColumn("weight", weight))
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return RuleEnsemble(float(np.log((ones + 1) / (n - ones + 1))), {})
    held = rows.select("label", array_to_vector(F.array(*(rule_column(r).cast("double") for r in rules))).alias("features")).persist()
    try:
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=40).fit(held)
    finally:
        held.unpersist()
    weights = {r: float(w) for r, w in zip(rules, lasso.coefficients.toArray()) if w}
    return RuleEnsemble(float(lasso.intercept), weights)


def scored(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, RuleEnsemble]:
    """((doc_id, STATISTICS, score) of each row of docs, the ensemble), learned from the labelled rows where `learn` (over doc_id) holds.

    Null and empty texts have statistics of zero and are scored like any other.
    Null labels are ignored; of repeated labels of an id the mean decides, 0.5
    counting as 1. Repeated rows get equal scores; rows without id are scored and
    teach nothing; the statistics of a very long text are taken whole, in one
    task; an empty table gives no rows.
    """
    table = staged(statistics(docs, id_col, text_col), "statistics")
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    ensemble = fit(table.filter(learn).join(marks, "doc_id"))
    return table.withColumn("score", ensemble.score()), ensemble
