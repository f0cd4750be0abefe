"""From extracted lines to elements, headers' hierarchy, graph tables and caption links."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LEVELS = 3
RESOURCES = ("picture", "table")
#: Where objects are stored unless a caller says otherwise.
BASE_URL = "http://minio:9000/documents/"


def with_parents(lines: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Elements (doc_id, ord, lvl; lvl null but for headers) with par_ord: the last header before that is shallower, null for
    none. Each level is a running maximum, so a document's rows are passed once."""
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("lvl") == k, F.col("ord"))).over(before) for k in range(1, levels + 1)]
    named = lines.select("*", *(c.alias(f"__m{k}") for k, c in enumerate(last, 1)))
    upto = lambda n: F.greatest(*(F.col(f"__m{k}") for k in range(1, n + 1))) if n > 1 else (F.col("__m1") if n else F.lit(None).cast("int"))
    parent = reduce(lambda c, k: c.when(F.col("lvl") == k, upto(k - 1)), range(1, levels + 1), F.when(F.lit(False), F.lit(None).cast("int"))).otherwise(upto(levels))
    return named.withColumn("par_ord", parent).drop(*(f"__m{k}" for k in range(1, levels + 1)))


def _outline(levels: pa.Array) -> pa.Array:
    """Lists of header levels (0 for what is no header) to lists of (par, seq): what with_parents() and the order under a parent say."""
    flat, first = levels.flatten().to_numpy(zero_copy_only=False), np.asarray(levels.offsets) - levels.offsets[0].as_py()
    n = len(flat)
    begin = np.repeat(first[:-1], np.diff(first))
    at, parent = np.arange(n), np.full(n, -1)
    for k in range(1, int(flat.max(initial=0)) + 1):
        last = np.maximum.accumulate(np.r_[-1, np.where(flat == k, at, -1)])[:-1]
        parent = np.where((flat == 0) | (flat > k), np.maximum(parent, last), parent)
    parent = np.where(parent < begin, -1, parent)
    # Siblings have the same parent or, without one, the same document; their order is that of the lines.
    key = np.where(parent < 0, n + begin, parent)
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order][1:] != key[order][:-1]] if n else np.zeros(0, bool)
    seq = np.zeros(n, np.int64)
    seq[order] = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1 if n else seq[order]
    par = pa.array((parent - begin).astype(np.int32), mask=parent < 0)
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([par, pa.array(seq.astype(np.int32))], ["par", "seq"]))


def outlined(levels: Column) -> Column:
    """(par, seq) of each line of a document, from the array of its lines' levels (null for what is no header): the place of
    the parent, null for none, and the number under it, from 1. The rows of a document never leave it, so nothing is shuffled."""

    @F.arrow_udf("array<struct<par:int,seq:int>>")
    def outline(levels: pa.Array) -> pa.Array:
        return _outline(levels)

    return outline(F.transform(levels, lambda x: F.coalesce(x.cast("int"), F.lit(0))))


def positions(elements: DataFrame) -> DataFrame:
    """page_position and ref_position: places on the page and under the parent, from 0."""
    page = Window.partitionBy("doc_id", "page_no").orderBy("ord")
    under = Window.partitionBy("doc_id", "par_ord").orderBy("ord")
    return elements.withColumn("page_position", F.row_number().over(page) - 1).withColumn("ref_position", F.row_number().over(under) - 1)


def caption_links(captions: DataFrame, resources: DataFrame, reach: float = 300) -> DataFrame:
    """(doc_id, page_no, ord, resource, distance): the nearest resource on a caption's page within reach, ties by place."""
    r = resources.select("doc_id", "page_no", F.col("ord").alias("resource"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = captions.join(r, ["doc_id", "page_no"]).withColumn("distance", T.manhattan(F.col("x"), F.col("y"), F.col("rx"), F.col("ry"))).filter(F.col("distance") <= reach)
    order = Window.partitionBy("doc_id", "page_no", "ord").orderBy("distance", "resource")
    return near.withColumn("n", F.row_number().over(order)).filter("n = 1").select("doc_id", "page_no", "ord", "resource", "distance")


def linked_to(links: DataFrame, elements: DataFrame, relation: str = "CAPTION_OF") -> DataFrame:
    """(doc_id, src, dst, relation) edges of caption links, by the ids of elements (doc_id, ord, id)."""
    ids = elements.select("doc_id", "ord", "id")
    captions = links.join(ids, ["doc_id", "ord"]).select("doc_id", F.col("resource").alias("ord"), F.col("id").alias("src"))
    return captions.join(ids, ["doc_id", "ord"]).select("doc_id", "src", F.col("id").alias("dst"), F.lit(relation).alias("relation"))


def graph_tables(elements: DataFrame, documents: DataFrame, base_url: str = BASE_URL) -> tuple[DataFrame, DataFrame]:
    """(nodes, parent_of) of elements (doc_id, ord, id, label, line, page_no, par_ord) and documents (doc_id; filename
    if it isn't doc_<doc_id>.txt). Both keep doc_id, which names a node together with its id. Media objects lie below base_url, unless
    elements say where (minio_url). Elements that know their parent's id and their sequence (parent, sequence) are taken at their word."""
    tag = F.replace(F.initcap(F.replace("label", F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    made = F.concat(F.lit(base_url), T.image_object(F.concat(F.lit("doc_"), "doc_id"), F.col("id"), F.col("label")))
    stored = F.coalesce(F.nullif("minio_url", F.lit("")), made) if "minio_url" in elements.columns else made
    url = F.when(F.col("label").isin(*RESOURCES), stored)
    inner = elements.select("doc_id", F.col("id").alias("node_id"), tag.alias("tag"), "label", F.col("line").alias("text"), url.alias("minio_url"), "page_no", F.lit(None).cast("string").alias("filename"))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    file = F.col("filename") if "filename" in documents.columns else F.concat(name, F.lit(".txt"))
    outer = documents.select("doc_id", name.alias("node_id"), F.lit("Document").alias("tag"), F.lit("document").alias("label"), file.alias("text"), F.lit(None).cast("string").alias("minio_url"), F.lit(0).alias("page_no"), file.alias("filename"))
    if {"parent", "sequence"} <= set(elements.columns):
        return inner.unionByName(outer), elements.select("doc_id", F.coalesce("parent", name).alias("src"), F.col("id").alias("dst"), "sequence")
    header = elements.select(F.col("doc_id").alias("d"), F.col("ord").alias("o"), F.col("id").alias("parent"))
    child = Window.partitionBy("doc_id", "par_ord").orderBy("ord")
    linked = elements.withColumn("sequence", F.row_number().over(child)).join(header, (F.col("doc_id") == F.col("d")) & (F.col("par_ord") == F.col("o")), "left")
    return inner.unionByName(outer), linked.select("doc_id", F.coalesce("parent", name).alias("src"), F.col("id").alias("dst"), "sequence")


def from_extracted(rows: DataFrame, levels: int = LEVELS, reach: float = 300) -> tuple[DataFrame, DataFrame]:
    """(elements, linked_to) of extracted documents, as documents_json() reads them.

    A header's level is the depth of its number, 1 without one, `levels` at
    most. A resource takes the text of the nearest caption that is linked with
    it, and its own text, if it says no content, becomes its content. Elements
    without page stand on page 1; without box, at its corner. elements: doc_id
    (the file name), ord, id, label, line, content, type, page_no, lvl, par_ord,
    page_position, ref_position, minio_url, filename.
    """
    box = lambda side: F.coalesce(F.col(f"bbox.{side}"), F.lit(0.0))
    base = rows.select(
        F.col("filename").alias("doc_id"), F.col("pos").alias("ord"), F.coalesce("label", F.lit("text")).alias("label"), F.coalesce("text", F.lit("")).alias("line"), "content", F.coalesce("page_no", F.lit(1)).alias("page_no"),
        box("l").alias("x"), box("t").alias("y"), "minio_url", "filename",
    )
    depth = F.least(F.coalesce(T.numbering_depth(F.col("line")), F.lit(1)), F.lit(levels))
    on_page = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("ord")) - 1
    named = base.withColumn("lvl", F.when(F.col("label") == "section_header", depth)).withColumn("id", T.element_id(F.col("doc_id"), F.col("page_no"), on_page, F.col("line")))
    placed = positions(with_parents(named, levels))
    links = caption_links(placed.filter("label = 'caption'"), placed.filter(F.col("label").isin(*RESOURCES)), reach)
    said = links.join(placed.select("doc_id", "ord", "line"), ["doc_id", "ord"]).groupBy("doc_id", F.col("resource").alias("ord")).agg(F.min_by("line", F.struct("distance", "ord")).alias("caption"))
    resource = F.col("label").isin(*RESOURCES)
    told = placed.join(said, ["doc_id", "ord"], "left").withColumn("content", F.when(resource, F.coalesce("content", F.nullif("line", F.lit("")))).otherwise(F.col("content")))
    told = told.withColumn("line", F.when(resource, F.coalesce("caption", F.lit(""))).otherwise(F.col("line"))).withColumn("type", F.when(resource, "resource").otherwise("text"))
    return told.drop("x", "y", "caption"), linked_to(links, placed)
