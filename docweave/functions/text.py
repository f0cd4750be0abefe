"""Text rules as Spark columns: ids, paths, cuts, citations, markers, coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns.
ELEMENT_ID = r"^[a-f0-9]{10}\z"
NODE_ID = r"(?U)^(?:[a-f0-9]{10}|doc_[\w\-. ()]{1,59})\z"
OBJECT_NAME = r"(?U)^[\w\-./]+\z"
CITED = r"\[src:([a-f0-9]+)\]"
PICTURED = r"\[img:([a-f0-9]+)\]"
FOLLOW_UP = r"""search_vectors\(["'](.+?)["']\)"""
PII = [(r"[\w.+-]+@[\w-]+\.[\w.]+", "<email>"), (r"\+?\d[\d -]{7,}\d", "<number>")]


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def stripped(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def cut(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def is_element_id(x: Column) -> Column:
    return F.coalesce(x.rlike(ELEMENT_ID), F.lit(False))


def is_node_id(x: Column) -> Column:
    return F.coalesce(x.rlike(NODE_ID), F.lit(False))


def is_object_name(x: Column) -> Column:
    return F.coalesce(x.rlike(OBJECT_NAME) & ~x.contains(".."), F.lit(False))


def element_id(doc: Column, page: Column, position: Column, text: Column) -> Column:
    """Ten hex digits of a hash of where an element stands and how it begins."""
    return F.substring(F.sha2(F.concat_ws("|", doc, page.cast("string"), position.cast("string"), cut(text, 50)), 256), 1, 10)


def object_name(url: Column) -> Column:
    """The part of a URL's path after the bucket, without query and fragment; null if there is none."""
    return blank_to_null(F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]+/[^/?#]+/([^?#]+)", 1))


def media_path(url: Column) -> Column:
    """/media/<object name>; a URL without one stays as it is."""
    return F.coalesce(F.concat(F.lit("/media/"), object_name(url)), url)


def image_object(stem: Column, element: Column, label: Column) -> Column:
    return F.concat(F.lit("images/"), stem, F.lit("/"), element, F.lit("_"), label, F.lit(".png"))


def cited_ids(response: Column) -> Column:
    return F.regexp_extract_all(response, F.lit(CITED), F.lit(1))


def pictured_ids(response: Column) -> Column:
    return F.regexp_extract_all(response, F.lit(PICTURED), F.lit(1))


def follow_up(response: Column) -> Column:
    """The first query that the answer asks to search for; null if it asks for none."""
    return blank_to_null(F.regexp_extract(response, FOLLOW_UP, 1))


def without_follow_ups(response: Column) -> Column:
    return stripped(F.regexp_replace(response, FOLLOW_UP, ""))


def masked(x: Column) -> Column:
    for pattern, name in PII:
        x = F.regexp_replace(x, pattern, name)
    return x


def sentences(x: Column) -> Column:
    return F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: stripped(s) != "")


def score_band(score: Column) -> Column:
    return F.when(score > 0.5, "green").when(score > 0.2, "orange").otherwise("red")


def tokens(x: Column) -> Column:
    """Distinct runs of a-z of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0)))


def overlap(question: Column, text: Column) -> Column:
    """Share of the question's tokens that the text has: the default second-stage score."""
    q = tokens(question)
    return F.round(F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1)), 6)


def numbering_depth(header: Column) -> Column:
    """Depth of a section number at the start of a header: decimal by its parts, roman 1, alphabetic 2; else null."""
    number = F.regexp_extract(header, r"^((?:\d+\.)*\d+|[IVXLC]+|[A-Za-z])[.)]?\s", 1)
    return F.when(number == "", F.lit(None)).when(number.rlike(r"^\d"), F.size(F.split(number, r"\."))).when(number.rlike(r"^[IVXLC]+$"), 1).otherwise(2)


def thread_id(question_id: Column) -> Column:
    """A repeatable thread name."""
    return F.substring(F.sha2(question_id.cast("string"), 256), 1, 32)


def flipped(y: Column, height: Column) -> Column:
    """A vertical coordinate counted from the other edge of the page."""
    return height - y


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def primitive(value: Column, kind: str) -> Column:
    """string, int or null as they are; anything else as its text."""
    return value.try_cast("bigint") if kind == "int" else value.cast("string")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "ip":
        return 1 - dot(a, b)
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
