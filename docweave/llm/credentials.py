"""Secret scanning with multipart credential linking, in DataFrame operations.

Base spans (assigned secrets, access ids, long hex) are reported as they are.
Weak candidates (short assigned values, account names, long base64-like words,
endpoints) are reported only when a complementary part co-occurs: an interval
join within a document links identifiers with secrets and endpoints with
secrets whose starts lie at most SCOPE code points apart. The join is an
equi-join on document and scope cell, as a semi join, so no pairs are emitted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import staged

#: Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a run of hex digits is a match of the shorter pattern in one piece
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18

#: Weak parts: an account name that something is set to, a base64-like word, an address.
ACCOUNT = r"""(?i:access_?key|client_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,64}"""
BLOB = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x20\x09-\x0D"'<>]+"""
WEAK_VALUE = 6
SCOPE = 200

KINDS = ["assign", "access", "hex", "weak", "account", "blob", "endpoint"]
ROLE = {"assign": "secret", "hex": "secret", "weak": "secret", "blob": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,own:int>>"


def _matches(text: Column, pattern: str, rank: int, own: int = 0) -> Column:
    """All leftmost non-overlapping matches as (start, rank, end, kind, own); own is the length of group `own`.

    The pieces between the matches and the matches themselves, in turn, add up
    to the text, so their lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    owned = F.regexp_extract_all(text, F.lit(pattern), F.lit(own)) if own else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), owned.alias("own"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["0"])
        end = start + F.coalesce(F.length(part["1"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(KINDS[rank]).alias("kind"), F.coalesce(F.length(part["2"]), F.lit(0)).alias("own"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    parts = F.transform(parts, lambda p: F.struct(p["gap"].alias("0"), p["hit"].alias("1"), p["own"].alias("2")))
    none = F.array().cast(_SPAN)
    total = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    # The last piece has no match after it.
    return F.when(text.rlike(pattern), F.filter(total, lambda s: s["end"] > s["start"])).otherwise(none)


def _named(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, rank, end, kind, own) of the base spans, and of these with the linked weak ones.

    Null texts are empty. Rows with equal ids are scanned each on their own;
    rows that also repeat the text get equal spans; an empty table gives no
    rows. Only the two named columns are read. Places are in code points.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    t = F.col("text")
    found = rows.select(
        "doc_id",
        F.xxhash64("text").alias("t1"),
        _matches(t, ASSIGN, 0, 2).alias("assign"),
        F.when(t.contains("AKIA"), _matches(t, ACCESS, 1)).otherwise(F.array().cast(_SPAN)).alias("access"),
        _matches(t, HEX, 2).alias("hex"),
        _matches(t, ACCOUNT, 4).alias("account"),
        _matches(t, BLOB, 5).alias("blob"),
        F.when(t.contains("://"), _matches(t, ENDPOINT, 6)).otherwise(F.array().cast(_SPAN)).alias("endpoint"),
    )
    is_set = lambda s: s["own"] >= ASSIGN_VALUE
    as_weak = lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end"), F.lit("weak").alias("kind"), s["own"].alias("own"))
    base = F.concat(F.filter("assign", is_set), F.filter("access", lambda s: s["end"] - s["start"] >= ACCESS_LENGTH), "hex")
    weak = F.concat(F.transform(F.filter("assign", lambda s: ~is_set(s) & (s["own"] >= WEAK_VALUE)), as_weak), "account", "blob", "endpoint")
    found = staged(found.select("doc_id", "t1", F.array_sort(base).alias("base"), weak.alias("weak")), "spans")

    role = reduce(lambda c, k: c.when(F.col("s.kind") == k, ROLE[k]), ROLE, F.when(F.lit(False), ""))
    parts = found.filter(F.size("weak") > 0).select(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "t1").alias("doc"), F.col("weak"), F.col("base"))
    weak_parts = parts.select("doc", F.explode("weak").alias("s")).withColumn("role", role)
    all_parts = parts.select("doc", F.explode(F.concat("weak", "base")).alias("s")).withColumn("role", role)
    cell = F.floor(F.col("s.start") / scope)
    reach = weak_parts.select("doc", "s", "role", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    other = all_parts.select(F.col("doc").alias("d2"), F.col("s.start").alias("at"), F.col("role").alias("other"), cell.alias("c2"))
    # Of a pair one part is a secret and the other is not.
    linked = reach.join(other, (F.col("doc") == F.col("d2")) & (F.col("cell") == F.col("c2")) & (F.abs(F.col("s.start") - F.col("at")) <= scope) & ((F.col("role") == "secret") != (F.col("other") == "secret")), "left_semi")
    added = linked.groupBy("doc").agg(F.collect_set("s").alias("linked"))
    joined = found.withColumn("doc", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "t1")).join(added, "doc", "left")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(_SPAN)))).alias("spans"))


def summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each document."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))
