"""WARC records and the resolution of not-modified revisits.

A revisit says that a server answered "not modified", so its payload is that of an earlier
capture. It is joined to the latest earlier full response of the same canonical URL; the
validators of both must agree (entity tags by weak comparison, else the modification date,
else the payload digest), and the headers that a not-modified answer may replace are taken from it.

The as-of join never gives a URL to one task: a URL's records are cut into slices of time, the last
full response of every slice is carried to the next ones through a small summary, and only
a slice is ordered. Payloads do not take part; their digest and length do.

Defined results for odd input: a null URL or time matches nothing, a text that is no URL is
its own canonical form; of records at one time the smaller id is earlier; repeated records
are resolved one by one; a repeated header counts by its last line; null headers are none.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from .graph import kept_table

CRLF = "\r\n"
#: Headers that a not-modified answer may replace (fixed values, lower case).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not change a page (fixed values; a trailing * is any ending).
TRACKING = "^(utm_[^=]*|fbclid|gclid|ref|sessionid|phpsessid|jsessionid|sid)(=|$)"
#: Seconds of a slice of time.
SLICE = 86400

HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Host without case, user, www and default port; path; sorted query without tracking. No scheme, no fragment."""
    plain = F.trim(url)
    shape = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda k: F.regexp_extract(plain, shape, k)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), "^[^@]*@|:(80|443)?$", ""), r"^www[0-9]*\.", "")
    host = F.regexp_replace(host, ":(80|443)$", "")
    path = F.regexp_replace(part(2), "/+$", "")
    kept = F.filter(F.split(F.regexp_replace(part(3), r"^\?", ""), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(plain.rlike(shape), whole).otherwise(plain)


def header_lines(lines: Column) -> Column:
    """Headers (lower-case name, value) of an array of lines; lines without a colon are none."""
    some = F.filter(lines, lambda x: F.instr(x, F.lit(":")) > 1)
    return F.transform(some, lambda x: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"),
        F.trim(F.substring(x, F.instr(x, F.lit(":")) + 1, F.length(x))).alias("value"),
    ))


def header(headers: Column, name: str) -> Column:
    """Last value of a header, null where there is none."""
    return F.try_element_at(F.filter(headers, lambda h: h["name"] == name), F.lit(-1))["value"]


def record_text(fields: Column, status: Column, headers: Column, body: Column) -> Column:
    """A WARC record around an HTTP answer; ``fields`` and ``headers`` are arrays of lines."""
    http = F.concat(F.lit("HTTP/1.1 "), status, F.lit(CRLF), F.array_join(F.array_compact(headers), CRLF), F.lit(CRLF * 2), body)
    return let(http, lambda h: F.concat(
        F.lit(f"WARC/1.1{CRLF}"), F.array_join(F.array_compact(fields), CRLF),
        F.lit(f"{CRLF}Content-Length: "), F.octet_length(h).cast("string"), F.lit(CRLF * 2), h, F.lit(CRLF * 2),
    ))


def _after(text: Column, head: Column, tail: int = 0) -> Column:
    """What follows ``head`` and an empty line, less ``tail`` bytes at the end; by bytes, so nothing is counted through."""
    begin = F.octet_length(head) + len(CRLF) * 2
    length = F.greatest(F.octet_length(text) - begin - tail, F.lit(0))
    return F.substring(text.cast("binary"), begin + 1, length)


def parsed(text: Column) -> Column:
    """WARC fields, HTTP status, headers and payload (bytes) of a record as one struct."""
    gap = CRLF * 2

    def body(p: Column) -> Column:
        rest = _after(p["text"], p["head"]).cast("string")
        return let(F.struct(p["head"].alias("head"), rest.alias("rest"), F.substring_index(rest, gap, 1).alias("http")), http)

    def http(p: Column) -> Column:
        lines = F.split(p["http"], CRLF)
        return F.struct(
            header_lines(F.split(p["head"], CRLF)).alias("fields"),
            F.regexp_extract(lines[0], r"^HTTP/\S+ (\d{3})", 1).alias("status"),
            header_lines(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("headers"),
            _after(p["rest"], p["http"], len(gap)).alias("payload"),
        )

    return let(F.struct(text.alias("text"), F.substring_index(text, gap, 1).alias("head")), body)


def records(texts: DataFrame, column: str = "record") -> DataFrame:
    """Records (record_id, type, url, fetched, status, headers, digest, length) of WARC texts.

    A digest that the record names is taken, else that of its payload.
    """
    whole = texts.select(parsed(F.col(column)).alias("p"))
    field = lambda name: header(F.col("p.fields"), name)
    own = F.concat(F.lit("sha256:"), F.sha2(F.col("p.payload"), 256))
    return whole.select(
        F.regexp_extract(field("warc-record-id"), r"([0-9]+)>?$", 1).try_cast("long").alias("record_id"),
        field("warc-type").alias("type"), field("warc-target-uri").alias("url"),
        F.unix_timestamp(F.try_to_timestamp(field("warc-date"), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))).alias("fetched"),
        F.col("p.status").try_cast("int").alias("status"), F.col("p.headers").alias("headers"),
        F.coalesce(field("warc-payload-digest"), F.when(field("warc-type") == "response", own)).alias("digest"),
        F.octet_length("p.payload").cast("long").alias("length"),
    )


def merged(old: Column, new: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    """Headers of the response with the permitted ones of the revisit, one per name, by name."""
    fresh = F.filter(new, lambda h: h["name"].isin(*permitted))
    names = F.array_sort(F.array_distinct(F.concat(old["name"], fresh["name"])))
    both = F.concat(old, fresh)
    return let(F.struct(names.alias("names"), both.alias("both")), lambda p: F.transform(
        p["names"], lambda n: F.struct(n.alias("name"), F.element_at(F.filter(p["both"], lambda h: h["name"] == n), -1)["value"].alias("value"))
    ))


def latest_response(events: DataFrame, slice_seconds: int = SLICE) -> DataFrame:
    """Adds ``base``: the latest full response of the URL before each record, as a struct."""
    full = (F.col("type") == "response") & (F.col("status") == 200)
    facts = F.struct("record_id", "fetched", "headers", "digest", "length")
    placed = events.withColumns({
        "slice": F.floor(F.col("fetched") / slice_seconds), "own": F.when(full & F.col("fetched").isNotNull(), facts),
    }).withColumn("at", F.struct("canonical_url", "slice"))
    last = placed.filter("own is not null").groupBy("at").agg(
        F.max_by("own", F.struct(F.col("own.fetched"), F.col("own.record_id"))).alias("last")
    )
    # one row per URL and slice with any record: what earlier slices leave behind
    slices = placed.select("at").distinct().join(last, "at", "left")
    earlier = Window.partitionBy("at.canonical_url").orderBy("at.slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("at", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    inside = Window.partitionBy("at").orderBy("fetched", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(carried, "at").withColumn(
        "base", F.coalesce(F.last("own", ignorenulls=True).over(inside), F.col("carried"))
    ).drop("own", "at", "slice", "carried")


def resolve(table: DataFrame, permitted: tuple[str, ...] = PERMITTED, slice_seconds: int = SLICE) -> DataFrame:
    """One row per revisit: outcome, response, merged headers, digest and length of the payload.

    Outcomes: resolved, mismatch (validators differ), unverified (no validator on both
    sides), no_response (no earlier full response).
    """
    narrow = table.select(
        "record_id", "type", "url", "fetched", "status",
        F.coalesce("headers", F.array().cast(HEADERS)).alias("headers"), "digest", "length",
    ).withColumn("canonical_url", canonical_url(F.col("url")))
    narrow = kept_table(narrow, "records")  # used several times; the payloads are read once
    none = F.array().cast(HEADERS)
    usable = F.col("canonical_url").isNotNull() & F.col("fetched").isNotNull()
    found = latest_response(narrow.filter(usable), slice_seconds).filter("type = 'revisit'")
    lost = narrow.filter(~usable).filter("type = 'revisit'")
    both = found.unionByName(lost, allowMissingColumns=True)
    base = F.coalesce(F.col("base.headers"), none)
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    compared = F.coalesce(
        weak(header(F.col("headers"), "etag")) == weak(header(base, "etag")),
        header(F.col("headers"), "last-modified") == header(base, "last-modified"),
        F.col("digest") == F.col("base.digest"),
    )
    outcome = (
        F.when(F.col("base").isNull(), "no_response").when(compared.isNull(), "unverified").when(compared, "resolved").otherwise("mismatch")
    )
    judged = both.withColumn("outcome", outcome)
    when_resolved = lambda c: F.when(F.col("outcome") == "resolved", c)
    return judged.select(
        "record_id", "url", "canonical_url", "fetched", "outcome",
        when_resolved(F.col("base.record_id")).alias("response_id"),
        when_resolved(merged(base, F.col("headers"), permitted)).alias("headers"),
        when_resolved(F.col("base.digest")).alias("payload_digest"),
        when_resolved(F.col("base.length")).alias("payload_length"),
    )


def header_text(headers: Column) -> Column:
    return F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
