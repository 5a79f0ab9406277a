"""WARC: resolution of not-modified revisit records.

A revisit (a revisit record, or a 304 answer stored as a response) is joined, as of its date, to the latest
earlier full response for the same canonical URL. Only a 200 is a full response: errors, redirects, parts
and 304 answers hold nothing that a later 304 could speak of, so they are passed over. The revisit's
validators must agree with that response: the entity tag if it has one (weak comparison), else the
modification date. The resolved record takes the response's status, payload and headers, updated by those
headers that a 304 may change.

The as-of join has no window over a whole URL: records fall into blocks of time, the last full response of
each (URL, block) is carried over the blocks of its URL, and only a block's own records are ordered. There
are so many blocks that the most frequent URL has about ``PER_BLOCK`` records in each (at most
``MOST_BLOCKS``). So one URL with a third of all records is many tasks.

Edge cases: a revisit without an earlier full response is ``unmatched``; with other validators
``mismatch``; without validators ``unvalidated`` (and resolved). Records with equal dates are ordered by
record id. A null URL matches nothing. A null date sorts before all others; a null kind counts as a
response, a null status as none. Null headers count as none. Payloads stay where they are, only their
digests travel, so their length does not matter. An empty table gives an empty result. Rows that repeat
are each resolved; of equal ids and dates any may be the base, as they are equal. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

PER_BLOCK, MOST_BLOCKS = 50_000, 4096
#: Header fields that a 304 answer may carry for the stored response (fixed values, RFC 9110 section 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that do not select content (fixed values).
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and a default port, path without a final slash, query parameters
    sorted and without tracking ones; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _header(name: str) -> Column:
    return F.element_at("headers", name)


def _tag(c: Column) -> Column:
    return F.regexp_replace(c, "^W/", "")


def _block(rows: DataFrame) -> Column:
    """The number of a record's block of time: blocks hold equally many records."""
    hottest = rows.groupBy("canonical_url").count().agg(F.max("count")).first()[0] or 0
    n = min(MOST_BLOCKS, hottest // PER_BLOCK)
    cuts = (rows.agg(F.percentile_approx("date", [i / n for i in range(1, n)], 100 * n)).first()[0] or []) if n > 1 else []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    table = F.array(*[F.lit(c) for c in cuts])
    # binary search; beyond the end get() is null and the step is not taken
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, x: F.when(F.get(table, at + x - 1) <= F.col("date"), at + x).otherwise(at))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records: record_id long, url string, date long, kind string (response or revisit), status int,
    headers map<string, string> with lower-case names, payload_digest string. Other columns are ignored.

    One row per record: record_id, canonical_url, base_id, resolution, status, headers, payload_digest.
    A response is its own base, with resolution ``full`` for a 200 and ``other`` for any other status.
    """
    rows = materialize(
        records.select(
            "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.coalesce("date", F.lit(-(1 << 62))).alias("date"), "status",
            (F.coalesce(F.col("kind") == "revisit", F.lit(False)) | F.coalesce(F.col("status") == 304, F.lit(False))).alias("again"),
            F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "payload_digest",
        ),
        "warc",
    )
    full = ~F.col("again") & (F.col("status") == 200) & F.col("canonical_url").isNotNull()
    base = F.when(full, F.struct("date", "record_id", "status", "headers", "payload_digest"))
    rows = rows.select("*", _block(rows).alias("block"), base.alias("base"))
    # the last response of each block, carried to the later blocks of its URL
    lasts = rows.where(full).groupBy("canonical_url", "block").agg(F.max(F.struct(F.col("date"), F.col("record_id"))).alias("k"), F.max_by("base", F.struct(F.col("date"), F.col("record_id"))).alias("base"))
    carried = rows.select("canonical_url", "block").distinct().join(lasts.select("canonical_url", "block", "base"), ["canonical_url", "block"], "left")
    before = Window.partitionBy("canonical_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("canonical_url", "block", F.last("base", True).over(before).alias("carried"))
    inside = Window.partitionBy("canonical_url", "block").orderBy("date", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    with_base = rows.withColumn("near", F.last("base", True).over(inside)).join(carried, ["canonical_url", "block"], "left")
    asof = with_base.select("record_id", "canonical_url", "again", "status", "headers", "payload_digest", F.coalesce("near", "carried").alias("b"))

    tag, stored_tag = _tag(_header("etag")), _tag(F.element_at("b.headers", "etag"))
    date, stored_date = _header("last-modified"), F.element_at("b.headers", "last-modified")
    agrees = F.when(tag.isNotNull(), tag.eqNullSafe(stored_tag)).when(date.isNotNull(), date.eqNullSafe(stored_date))
    resolution = (
        F.when(~F.col("again"), F.when(F.col("status") == 200, "full").otherwise("other")).when(F.col("b").isNull(), "unmatched").when(agrees.isNull(), "unvalidated").when(agrees, "resolved").otherwise("mismatch")
    )
    told = asof.select("*", resolution.alias("resolution")).select("*", F.col("resolution").isin("resolved", "unvalidated").alias("ok"))
    changed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter("b.headers", lambda k, v: ~F.map_contains_key(changed, k))
    return told.select(
        "record_id", "canonical_url", F.when(~F.col("again"), F.col("record_id")).when(F.col("ok"), F.col("b.record_id")).alias("base_id"), "resolution",
        F.when(F.col("ok"), F.col("b.status")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("ok"), F.map_concat(kept, changed)).otherwise(F.col("headers")).alias("headers"),
        F.when(F.col("ok"), F.col("b.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )


def crawl_log(pages: DataFrame) -> DataFrame:
    """Records of a crawl that fetched every page once and asked for it again later: the answer to the
    second request is a 304 with the page's validators, stored as a revisit or (every ninth) as a response.
    In between, every third page once gave an error and every fifth a redirect. Pages whose canonical URLs
    agree share a history."""
    url, digest, page = F.col("url"), F.md5(F.coalesce("html", F.lit(""))), F.col("page_id")
    size = F.length(F.coalesce("html", F.lit(""))).cast("string")
    tag, nothing = F.concat(F.lit('"'), digest, F.lit('"')), F.lit(None).cast("string")

    def record(number: int, date: Column, kind: Column, status: int, payload: Column, *headers: Column) -> Column:
        return F.struct((page * 4 + number).alias("record_id"), url.alias("url"), date.alias("date"), kind.alias("kind"), F.lit(status).alias("status"), F.create_map(*headers).alias("headers"), payload.alias("payload_digest"))

    name, response = F.lit, F.lit("response")
    full = record(0, page * 3600, response, 200, digest, name("content-type"), name("text/html"), name("content-length"), size, name("etag"), tag, name("cache-control"), name("max-age=60"))
    again = record(
        1, page * 3600 + 1800 + (page % 11) * 36_000_000, F.when(page % 9 == 0, response).otherwise("revisit"), 304, nothing, name("content-length"), name("0"), name("etag"), F.concat(name("W/"), tag), name("cache-control"), name("max-age=600")
    )
    error = record(2, page * 3600 + 900, response, 404, nothing, name("content-length"), name("0"))
    moved = record(3, page * 3600 + 1200, response, 301, nothing, name("location"), url)
    records = F.array(full, again, F.when(page % 3 == 0, error), F.when(page % 5 == 0, moved))
    return pages.select(F.explode(F.array_compact(records)).alias("r")).select("r.*")


def op2_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the crawl log of all pages, resolved."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = resolve_revisits(crawl_log(pages))
    return out.select(
        "record_id", "canonical_url", "base_id", "resolution", "status", _header("etag").alias("etag"), _header("cache-control").alias("cache_control"), _header("content-length").alias("content_length"), _header("content-type").alias("content_type"), "payload_digest"
    )


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS dg, length(coalesce(html, '')) AS n,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
c AS (
  SELECT page_id, dg, n,
         regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS head,
         list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)'))) AS q
  FROM p),
u AS (SELECT page_id, dg, n, head || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM c),
r AS (
  SELECT page_id * 4 AS record_id, canonical_url, page_id * 3600 AS date, 200 AS status, dg, n FROM u
  UNION ALL
  SELECT page_id * 4 + 1, canonical_url, page_id * 3600 + 1800 + (page_id % 11) * 36000000, 304, dg, n FROM u
  UNION ALL
  SELECT page_id * 4 + 2, canonical_url, page_id * 3600 + 900, 404, NULL, 0 FROM u WHERE page_id % 3 = 0
  UNION ALL
  SELECT page_id * 4 + 3, canonical_url, page_id * 3600 + 1200, 301, NULL, NULL FROM u WHERE page_id % 5 = 0),
a AS (
  SELECT *, last_value(CASE WHEN status = 200 THEN {'id': record_id, 'dg': dg, 'n': n} END IGNORE NULLS) OVER (PARTITION BY canonical_url ORDER BY date, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
  FROM r),
s AS (
  SELECT *, CASE WHEN status = 200 THEN 'full' WHEN status <> 304 THEN 'other' WHEN b IS NULL THEN 'unmatched' WHEN b.dg = dg THEN 'resolved' ELSE 'mismatch' END AS resolution FROM a)
SELECT record_id, canonical_url,
       CASE WHEN status <> 304 THEN record_id WHEN resolution = 'resolved' THEN b.id END AS base_id, resolution,
       (CASE WHEN resolution = 'resolved' THEN 200 ELSE status END)::INTEGER AS status,
       CASE WHEN status = 200 THEN '"' || dg || '"' WHEN status = 304 THEN 'W/"' || dg || '"' END AS etag,
       CASE WHEN status = 200 THEN 'max-age=60' WHEN status = 304 THEN 'max-age=600' END AS cache_control,
       CASE WHEN status = 304 AND resolution <> 'resolved' THEN '0' WHEN resolution = 'resolved' THEN b.n::VARCHAR ELSE n::VARCHAR END AS content_length,
       CASE WHEN status = 200 OR resolution = 'resolved' THEN 'text/html' END AS content_type,
       CASE WHEN status = 200 THEN dg WHEN resolution = 'resolved' THEN b.dg END AS payload_digest
FROM s
"""
