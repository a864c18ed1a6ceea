"""Not-modified revisits of a crawl resolved to the response that they stand for.

A revisit (a 304 without body) takes the latest full response of the same canonical URL from
before it. Its validators must agree: entity tags by weak comparison, without tags on both sides
the modification dates. Where they agree, its permitted headers replace the stored ones; headers
that describe the body or the connection stay as they were stored.

The join is an as-of join by windows: times are cut into slices of about ``SLICE_ROWS`` records
of the whole crawl, the last response of every (URL, slice) is carried forward over slices, and
inside a slice a window finds the last response before each revisit. A URL with a third of all
records is spread over its slices.

Defined results: a null URL, or no earlier response, gives outcome ``no_response``; validators
missing on either side give ``no_validator``; a response at the very time of a revisit is not
earlier; of responses at one time the highest record id counts; repeated rows resolve alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.common import materialize

SLICE_ROWS = 4_000
# fixed values: headers that a 304 may not replace
BODY_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization",
    "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
_SITE = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, www, default port, fragment, trailing slashes and tracking parameters, the
    parameters sorted."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    host = F.lower(F.regexp_extract(bare, _SITE + r"([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, _SITE + r"[^/?]*([^?]*)", 1), r"/+$", "")
    kept = F.filter(F.split(F.regexp_extract(bare, r"(?s)\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_"))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolved(records: DataFrame) -> DataFrame:
    """One row per revisit: (record_id, url_key, time, response_id, outcome, headers, payload_bytes).

    ``records`` has record_id, url, time (seconds), kind ('response' or 'revisit'), etag,
    last_modified, headers (map of lower-case names) and payload_bytes."""
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url_key"), F.col("time").cast("long").alias("time"), "kind", "etag", "last_modified", "headers",
        F.col("payload_bytes").cast("long").alias("payload_bytes"),
    )
    rows = materialize(rows.where("kind IN ('response', 'revisit')"), "records")
    span = rows.agg(F.min("time").alias("low"), F.max("time").alias("high"), F.count("*").alias("n")).first()
    slices = max(1, -(-span["n"] // SLICE_ROWS))
    width = max(1, -(-((span["high"] or 0) - (span["low"] or 0) + 1) // slices))
    response = F.when(F.col("kind") == "response", F.struct("time", "record_id", "etag", "last_modified", "headers", "payload_bytes"))
    known = rows.where("url_key IS NOT NULL AND time IS NOT NULL").withColumns({"slice": F.floor((F.col("time") - F.lit(span["low"] or 0)) / width).cast("long"), "response": response})
    last = known.where("kind = 'response'").groupBy("url_key", "slice").agg(F.max_by("response", F.struct("time", "record_id")).alias("last"))
    # a row per (URL, slice) that has any record, so a slice without a response passes the last one on
    seen = known.where("kind = 'revisit'").select("url_key", "slice").distinct()
    carried = seen.join(last, ["url_key", "slice"], "full").withColumn(
        "carried", F.last("last", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    )
    # at one time revisits come first: a response of that time is not earlier
    order = Window.partitionBy("url_key", "slice").orderBy("time", F.col("kind") == "response", "record_id")
    inside = known.withColumn("inside", F.last("response", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).where("kind = 'revisit'").drop("response")
    found = inside.join(carried.select("url_key", "slice", "carried"), ["url_key", "slice"], "left").withColumn("match", F.coalesce("inside", "carried"))
    lost = rows.where("kind = 'revisit' AND (url_key IS NULL OR time IS NULL)")
    wanted = ["record_id", "url_key", "time", "etag", "last_modified", "headers"]
    matched = found.select(*wanted, "match").unionByName(lost.select(*wanted), allowMissingColumns=True)
    tags = F.col("etag").isNotNull() & F.col("match.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("match.last_modified").isNotNull()
    same = F.when(tags, _tag(F.col("etag")) == _tag(F.col("match.etag"))).when(dates, F.col("last_modified") == F.col("match.last_modified"))
    outcome = F.when(F.col("match").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("changed")
    fresh = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*BODY_HEADERS))
    stored = F.map_filter(F.coalesce("match.headers", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(F.col("fresh"), k))
    merged = matched.withColumns({"outcome": outcome, "fresh": fresh})
    good = F.col("outcome") == "resolved"
    return merged.select(
        "record_id", "url_key", "time", F.col("match.record_id").alias("response_id"), "outcome", F.when(good, F.map_concat(stored, F.col("fresh"))).alias("headers"),
        F.when(good, F.col("match.payload_bytes")).alias("payload_bytes"),
    )
