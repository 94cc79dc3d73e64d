"""WARC revisit records: as-of resolution to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.llm.common import ascii_lower

#: Response headers that a 304 may update in the stored response (RFC 9111, section 3.2, and RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name a visitor's way, not a resource.
TRACKING = "^(utm_[^=]*|gclid|fbclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """The lookup key of a url, after the manner of crawl indexes; null for null.

    Scheme, fragment, user, a leading www and default ports go, A-Z in the host
    are lower-cased, tracking parameters are left out and the others sorted, and
    an empty path becomes /. A trailing slash of a longer path goes.
    """
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "(?s)#.*", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = ascii_lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "(?<=.)/+$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def weak_equal(a: Column, b: Column) -> Column:
    """Weak comparison of entity tags."""
    return F.regexp_replace(a, "^W/", "") == F.regexp_replace(b, "^W/", "")


def resolve_revisits(captures: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """Each row of captures with the full response that it stands for.

    captures: record_id, url, captured_at (timestamp), kind ('response' or
    'revisit'), headers (map<string,string>, lower-case names). For a
    not-modified revisit it is the latest response of the same canonical url
    captured strictly earlier; among those of one instant, the greatest
    record_id. Returns record_id, canonical_url, kind, ref_id, outcome and headers:

    - full: a response, with its own headers and id;
    - resolved: a strong or weak etag agrees, or, where either lacks one, the last-modified does; the response's headers with the revisit's PERMITTED ones merged over them;
    - unchecked: neither validator is on both sides; headers merged likewise;
    - mismatch: a validator differs; ref_id is the response looked at, headers the revisit's own;
    - missing: no earlier response, a null url or a null time; ref_id is null.

    Other kinds are returned as missing. The as-of join is split by (url, time
    bucket): a bucket's last response is carried forward over the far fewer
    bucket rows, so one busy url is spread over its buckets. Rows without a url or
    time take no part in it, however many they are. Only ids and headers move,
    never payloads. Repeated rows each get a row.
    """
    rows = captures.select(
        "record_id", "captured_at", "kind", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        canonical_url(F.col("url")).alias("canonical_url"),
    )
    usable = F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull()
    response = F.col("kind") == "response"
    lost = rows.where(~usable).select(
        "record_id", "canonical_url", "kind", F.when(response, F.col("record_id")).alias("ref_id"), F.when(response, "full").otherwise("missing").alias("outcome"), "headers",
    )
    rows = rows.where(usable)
    key = [F.col("canonical_url").alias("k"), F.floor(F.unix_timestamp("captured_at") / bucket_seconds).alias("b")]
    candidate = F.when(response, F.struct("captured_at", "record_id", "headers"))
    rows = rows.select("*", *key).withColumn("own", candidate)
    order = F.struct("own.captured_at", "own.record_id")
    last = rows.where("own is not null").groupBy("k", "b").agg(F.max_by("own", order).alias("last"))
    seen = rows.select("k", "b").distinct().join(last, ["k", "b"], "left")
    carried = seen.withColumn("carried", F.last("last", ignorenulls=True).over(W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1))).select("k", "b", "carried")
    joined = rows.join(carried, ["k", "b"])
    # responses of the same instant are not earlier: a range frame up to just before it
    micros = F.unix_micros("captured_at")
    inside = W.partitionBy("k", "b").orderBy("micros").rangeBetween(W.unboundedPreceding, -1)
    joined = joined.withColumn("micros", micros).withColumn("best", F.max(F.when(F.col("own").isNotNull(), F.struct("own.captured_at", "own.record_id"))).over(inside))
    # the headers of the found response: by its id, within the bucket, or the carried one
    refs = rows.where("own is not null").select("k", "b", F.col("own.captured_at").alias("at"), F.col("own.record_id").alias("ref"), F.col("own.headers").alias("ref_headers")).groupBy("k", "b", "at", "ref").agg(F.first("ref_headers").alias("ref_headers"))
    on = (F.col("j.k") == F.col("r.k")) & (F.col("j.b") == F.col("r.b")) & (F.col("j.best.captured_at") == F.col("r.at")) & (F.col("j.best.record_id") == F.col("r.ref")) & (F.col("j.kind") == "revisit")
    found = joined.alias("j").join(refs.alias("r"), on, "left").select("j.*", "r.ref", "r.ref_headers")
    ref_id = F.coalesce("ref", "carried.record_id")
    stored = F.coalesce("ref_headers", "carried.headers")
    ok = F.col("kind") == "revisit"
    found = found.withColumn("ref_id", F.when(ok, ref_id)).withColumn("stored", F.when(ok, stored))
    tag, tag0 = F.try_element_at("headers", F.lit("etag")), F.try_element_at("stored", F.lit("etag"))
    mod, mod0 = F.try_element_at("headers", F.lit("last-modified")), F.try_element_at("stored", F.lit("last-modified"))
    by_tag, by_time = weak_equal(tag, tag0), mod == mod0
    outcome = (
        F.when(F.col("kind") == "response", "full")
        .when(F.col("ref_id").isNull(), "missing")
        .when(by_tag.isNotNull(), F.when(by_tag, "resolved").otherwise("mismatch"))
        .when(by_time.isNotNull(), F.when(by_time, "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    found = found.withColumn("outcome", outcome)
    found = found.select(
        "record_id", "canonical_url", "kind", F.when(F.col("kind") == "response", F.col("record_id")).otherwise(F.col("ref_id")).alias("ref_id"), "outcome",
        F.when(F.col("outcome").isin("resolved", "unchecked"), merged).otherwise(F.col("headers")).alias("headers"),
    )
    return found.unionByName(lost)


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl log of a table of pages (page_id, url, html): a full response and a later 304 for each page.

    Page n is fetched at second 60 * n, and asked for again a day later. The
    etag is the MD5 of the html, in its weak form in every other recheck; some
    fifth of the rechecks bring only last-modified, a 13th (n % 13 = 6) neither
    validator. A seventh (n % 7 = 3) of the responses are missing from the log,
    and an 11th (n % 11 = 5) of the pages have changed by the recheck, which then
    has the new etag and date. No payload is in the log.
    """
    changed, bare, gone = F.col("page_id") % 11 == 5, F.col("page_id") % 13 == 6, F.col("page_id") % 7 == 3
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    day = F.timestamp_seconds(F.col("page_id") * 60)
    later = F.timestamp_seconds(F.col("page_id") * 60 + 86_400)
    new = F.concat(F.lit('"'), F.md5(F.concat(F.coalesce("html", F.lit("")), F.lit("changed"))), F.lit('"'))
    own = pages.select("page_id", "url", etag.alias("tag"), F.when(changed, new).otherwise(etag).alias("tag2"), day.alias("t"), later.alias("t2"))
    modified = F.date_format(F.col("t"), "yyyy-MM-dd'T'HH:mm:ss")
    date = F.date_format(F.col("t2"), "yyyy-MM-dd'T'HH:mm:ss")
    full = F.map_filter(F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), F.col("tag"), F.lit("last-modified"), modified, F.lit("date"), modified), lambda _, v: v.isNotNull())
    weak = F.when(F.col("page_id") % 2 == 1, F.concat(F.lit("W/"), F.col("tag2"))).otherwise(F.col("tag2"))
    again = F.map_filter(F.create_map(F.lit("content-type"), F.lit("none"), F.lit("etag"), F.when(~bare & (F.col("page_id") % 5 != 4), weak), F.lit("last-modified"), F.when(~bare, F.when(changed, date).otherwise(modified)), F.lit("date"), date), lambda _, v: v.isNotNull())
    record = F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), F.col("t").alias("captured_at"), F.lit("response").alias("kind"), full.alias("headers")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), F.col("t2").alias("captured_at"), F.lit("revisit").alias("kind"), again.alias("headers")),
    )
    return own.select("url", F.inline(F.when(gone, F.slice(record, 2, 1)).otherwise(record)))
