"""WARC: resolving not-modified revisits.

A revisit record says that a page was unchanged. It is resolved by an as-of join: the latest full response of the same
canonical URL strictly before it. Digests, entity tags (weak comparison) or modification dates have to agree, in this
order of preference; then the revisit's permitted headers replace the response's.

The as-of join is a running maximum, not a join of pairs: responses and revisits of a URL stand in order of time, cut
into time buckets, so that a URL with a third of all records is many small sorts; what a bucket inherits from earlier
ones comes from a small table of each bucket's last response. Buckets end at quantiles of all records' times, so stray times don't
fill one bucket; records of one and the same time share a bucket. Payloads take no part; they are reached by record id.

Records with null URL or time are never matched: such a revisit has outcome no_response. Several responses at the same
latest time: the one of greatest record_id, with null ids behind all others. A null header map counts as empty. Header names are compared
without case and come out in lower case; of several spellings of a name in one record the last one's value counts. Repeated rows are resolved one by one.
Empty tables give empty results; columns beyond RECORD are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import fresh, table

RECORD = ("record_id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers")
#: Buckets hold about this many records; there are at most MOST_BUCKETS, found to this part of a bucket.
BUCKET_ROWS, MOST_BUCKETS, EXACTNESS = 50_000, 10_000, 0.1
#: Headers that a not-modified reply must not replace (connection-bound, or bound to the stored payload).
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that don't change a page.
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(?:=|$)"


def canonical_url(url):
    """Without scheme, www, default port, fragment, tracking parameters and closing slash; host in lower case,
    parameters in order."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), r"^www[0-9]*\.", ""), ":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def lower_names(headers):
    """A header map with names in lower case; of several spellings the last one's value."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value")))
    later = lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda x: x.key == e.key))
    return F.map_from_entries(F.element_at(F.transform(F.array(entries), later), 1))


def time_bounds(known: DataFrame) -> list[int]:
    """Where buckets of about BUCKET_ROWS records end, found to EXACTNESS of a bucket; one bound at least."""
    n = known.count()
    many = min(MOST_BUCKETS, max(2, -(-n // BUCKET_ROWS)))
    at = known.select(F.percentile_approx("ts", [i / many for i in range(1, many)], int(many / EXACTNESS))).first()[0]
    return sorted(set(at or [0]))


def resolve(records: DataFrame) -> DataFrame:
    """A row per revisit: record_id, url_key, ts, outcome, base_id, base_ts, headers (the response's, merged if resolved)."""
    r = records.select(*RECORD).withColumn("url_key", canonical_url(F.col("url")))
    known = r.where("url_key IS NOT NULL AND ts IS NOT NULL AND kind IN ('response', 'revisit')")
    edges = sorted({float(x) for x in time_bounds(known)})
    by_time = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="at", outputCol="bucket")
    known = by_time.transform(known.withColumn("at", F.col("ts").cast("double"))).drop("at")
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))
    rank = F.when(F.col("kind") == "response", F.struct("ts", "record_id"))
    lasts = known.where("kind = 'response'").groupBy("url_key", "bucket").agg(F.max_by(full, rank).alias("last"))
    has_revisit = known.where("kind = 'revisit'").select("url_key", "bucket").distinct()
    marks = lasts.join(has_revisit.withColumn("asked", F.lit(True)), ["url_key", "bucket"], "full")
    over = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inherited = marks.withColumn("inherited", F.last("last", ignorenulls=True).over(over)).where("asked").select("url_key", "bucket", "inherited")
    inside = Window.partitionBy("url_key", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    found = (
        known.withColumn("own", F.max_by(full, rank).over(inside))
        .where("kind = 'revisit'")
        .join(inherited, ["url_key", "bucket"], "left")
        .withColumn("base", F.coalesce("own", "inherited"))
        .drop("own", "inherited", "bucket")
    )
    lost = r.where("kind = 'revisit' AND (url_key IS NULL OR ts IS NULL)").withColumn("base", F.lit(None).cast(found.schema["base"].dataType))
    every = found.unionByName(lost)
    strong = lambda tag: F.regexp_replace(tag, "^W/", "")
    both = lambda name: F.col(name).isNotNull() & F.col(f"base.{name}").isNotNull()
    agrees = (
        F.when(both("digest"), F.col("digest") == F.col("base.digest"))
        .when(both("etag"), strong(F.col("etag")) == strong(F.col("base.etag")))
        .when(both("last_modified"), F.col("last_modified") == F.col("base.last_modified"))
    )
    outcome = F.when(F.col("base").isNull(), "no_response").when(agrees.isNull(), "no_validator").when(agrees, "resolved").otherwise("validator_mismatch")
    own = F.map_filter(lower_names(F.col("headers")), lambda k, v: ~k.isin(*NOT_MERGED))
    rest = F.map_filter(lower_names(F.col("base.headers")), lambda k, v: ~F.array_contains(F.map_keys(own), k))
    return every.withColumn("outcome", outcome).select(
        "record_id", "url_key", "ts", "outcome", F.col("base.record_id").alias("base_id"), F.col("base.ts").alias("base_ts"),
        F.when(F.col("outcome") == "resolved", F.map_concat(rest, own)).alias("headers"),
    )


def with_payload(resolved: DataFrame, payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Resolved revisits with the response's payload; payloads: record_id, payload."""
    name = fresh(resolved, payload)
    return resolved.join(payloads.select(F.col("record_id").alias("base_id"), F.col(payload).alias(name)), "base_id", "left")


#: The crawl made of `pages`: each page is a full response, and is revisited this much later.
STEP, LATER = 10, 40_005


def crawl(pages: DataFrame) -> DataFrame:
    """WARC records of a pages table: a response and a later not-modified revisit of each page."""
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    text = lambda s: F.lit(s).cast("string")
    response = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", (STEP * F.col("page_id")).alias("ts"), text("response").alias("kind"), tag.alias("etag"),
        text(None).alias("last_modified"), text(None).alias("digest"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("ETag"), tag, F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    revisit = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url", (STEP * F.col("page_id") + LATER).alias("ts"), text("revisit").alias("kind"),
        F.concat(F.lit("W/"), tag).alias("etag"), text(None).alias("last_modified"), text(None).alias("digest"),
        F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("ETag"), F.concat(F.lit("W/"), tag), F.lit("Cache-Control"), F.lit("max-age=3600"), F.lit("X-Checked"), F.col("page_id").cast("string")).alias("headers"),
    )
    return response.unionByName(revisit)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(crawl(table(spark, sf_dir, "pages")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e.key, F.lit(": "), e.value))
    return out.select(
        F.shiftright(F.col("record_id"), 1).alias("page_id"), "url_key", "ts", "outcome", F.shiftright("base_id", 1).alias("base_page_id"), "base_ts",
        F.array_join(pairs, "\n").alias("headers"),
    )


ORACLE = r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u,
  '"' || substr(md5(html), 1, 16) || '"' AS tag, strlen(html) AS n FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www[0-9]*\.', ''), ':(?:80|443)$', '') || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS hp,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(?:=|$)'))), '&') AS q FROM p),
k AS (SELECT page_id, tag, n, hp || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url_key FROM c),
a AS (SELECT r.page_id, r.url_key, r.tag, 10 * r.page_id + 40005 AS ts, max(b.page_id) AS base_page_id
  FROM k r LEFT JOIN k b ON r.url_key = b.url_key AND 10 * b.page_id < 10 * r.page_id + 40005 GROUP BY ALL)
SELECT a.page_id, a.url_key, a.ts, CASE WHEN base_page_id IS NULL THEN 'no_response' WHEN a.tag = b.tag THEN 'resolved' ELSE 'validator_mismatch' END AS outcome,
  base_page_id, 10 * base_page_id AS base_ts,
  CASE WHEN a.tag = b.tag THEN 'cache-control: max-age=3600' || chr(10) || 'content-length: ' || b.n || chr(10) || 'content-type: text/html' || chr(10) || 'etag: W/' || a.tag || chr(10) || 'x-checked: ' || a.page_id END AS headers
FROM a LEFT JOIN k b ON b.page_id = a.base_page_id
"""
