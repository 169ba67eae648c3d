"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans are found by pattern alone. Weak candidates, a long token of mixed characters or an endpoint, are common in clean
text and are reported only where complementary parts co-occur: a token within ``REACH`` code points of an access identifier,
an endpoint within ``REACH`` of both an access identifier and a secret. The interval join is a sorted sweep: all parts of a
document by position, each with the nearest part of the other kind before and after it, so no pairs are made.

A text is scanned once. Parts go to rows by a number that each row of the input has for itself, so ids that are null or
repeated do not meet, and no document, however long, meets another. Positions are code points, ends exclusive.

Defined results: a null or empty text has no spans; overlapping spans of different kinds are all reported, of one kind the
leftmost; a weak candidate that overlaps a base span is not reported again; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Code points between two parts of one credential at most.
REACH = 300

# The patterns, in the order in which kinds are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/=_-]{24,}"
ENDPOINT = r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
KINDS = ("assign", "access", "hex", "token", "endpoint")


def _parts(text: Column, kind: str, pattern: str, wanted: Column, value: Column | None = None) -> Column:
    """Matches of a pattern as (kind, place, code points before it since the last, length, length of the value)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    value = found if value is None else value
    rows = F.zip_with(
        F.arrays_zip(gaps.alias("gap"), found.alias("found")), value, lambda x, v: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("size"), F.length(v).alias("value"), x["found"].alias("text"))
    )
    return F.when(wanted, F.filter(rows, lambda x: x["size"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,gap:int,size:int,value:int,text:string>>"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_assign, n_access, n_hex, base and all (arrays of ``kind:start:end``)."""
    text = F.col("__text")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    access = text.contains("AKIA")
    parts = F.concat(
        _parts(text, "assign", ASSIGN, text.rlike(ASSIGN), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))),
        _parts(text, "access", ACCESS, access),
        _parts(text, "hex", HEX, text.rlike(HEX)),
        _parts(text, "token", TOKEN, access),
        _parts(text, "endpoint", ENDPOINT, access & text.contains("://")),
    )
    flat = rows.select(id_col, "__row", F.posexplode_outer(parts).alias("__at", "p")).select(id_col, "__row", "__at", "p.*")
    before = W.Window.partitionBy("__row", "kind").orderBy("__at").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    flat = flat.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    is_kind = lambda *names: F.col("kind").isin([KINDS.index(n) for n in names])
    mixed = F.col("text").rlike("[A-Z]") & F.col("text").rlike("[a-z]") & F.col("text").rlike("[0-9]")
    # What fails loses its kind but stays a row, so that a document with nothing else is not lost.
    holds = is_kind("access", "hex", "endpoint") | (is_kind("assign") & (F.col("value") >= 12)) | (is_kind("token") & mixed)
    flat = flat.withColumn("kind", F.when(holds, F.col("kind")))

    # The sweep. Ends of earlier parts are taken as a running maximum, starts of later ones as a minimum from the far side.
    line = W.Window.partitionBy("__row").orderBy("start", "kind")
    up, down = line.rowsBetween(W.Window.unboundedPreceding, -1), line.rowsBetween(1, W.Window.unboundedFollowing)
    near = lambda cond: (F.coalesce(F.col("start") - F.max(F.when(cond, F.col("end"))).over(up) <= REACH, F.lit(False)) | F.coalesce(F.min(F.when(cond, F.col("start"))).over(down) - F.col("end") <= REACH, F.lit(False)))
    base = is_kind("assign", "access", "hex")
    covered = F.coalesce(F.max(F.when(base, F.col("end"))).over(up) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(base, F.col("start"))).over(down) < F.col("end"), F.lit(False))
    swept = flat.withColumn("by_access", near(is_kind("access"))).withColumn("by_secret", near(is_kind("assign", "token"))).withColumn("covered", covered)
    linked = (is_kind("token") & F.col("by_access") | is_kind("endpoint") & F.col("by_access") & F.col("by_secret")) & ~F.col("covered")
    swept = swept.withColumn("name", F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), "start", "end"))
    item = F.struct("start", "kind", "name")
    names = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, item))), lambda x: x["name"])
    count = lambda name: F.count(F.when(is_kind(name), 1)).alias(f"n_{name}")
    return swept.groupBy("__row").agg(F.first(id_col).alias(id_col), count("assign"), count("access"), count("hex"), names(base).alias("base"), names(base | linked).alias("all")).drop("__row")
