"""Operator 3: not-modified revisits resolved by an as-of join.

A revisit of a URL stands for the latest full response of the same canonical URL
before it.  Its validators are checked against that response's, and the headers
that a 304 may change are merged into the stored ones.

Time is cut into slices of about equal numbers of captures: the join looks inside
a (URL, slice) by a window, and earlier slices hand over one row each, so that even
one URL with a third of all captures is spread over many tasks, and a capture dated
centuries off moves no other one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SLICES = 128
# Query parameters that don't name a resource, and header fields that a 304 must not change.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|msclkid|ref|sessionid|phpsessid)(=|$)"
FORBIDDEN = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
    "content-encoding", "content-length", "content-range", "content-type",
)
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def canonical_url(url: Column) -> Column:
    """Host, path and sorted query, without scheme, user, www., default port, fragment and tracking parameters.

    What has no scheme is only trimmed and freed of its fragment; null stays null.
    """
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(u, _SCHEME + r"([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, _SCHEME + r"[^/?]*([^?]*)", 1), r"/index\.html?$", "/"), r"/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(u.rlike(_SCHEME), F.concat(host, F.when(path == "", "/").otherwise(path), query)).otherwise(u)


def lowered(headers: Column) -> Column:
    """A header map with lower-case names; of equal names the last value counts. Null is empty."""
    h = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    entries = F.map_entries(h)
    names = F.array_distinct(F.transform(F.map_keys(h), lambda k: F.lower(F.trim(k))))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == n), -1)["value"]))


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers with those of a 304 in place of its own, but for the forbidden ones; names in lower case."""
    permitted = F.map_filter(update, lambda k, v: ~k.isin(*FORBIDDEN) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(permitted), k)), permitted)


def _check(rev: Column, res: Column) -> Column:
    """The verdict on two lower-case header maps."""
    tag = lambda h: F.regexp_replace(F.trim(F.try_element_at(h, F.lit("etag"))), "^W/", "")
    date = lambda h: F.trim(F.try_element_at(h, F.lit("last-modified")))
    return (
        F.when(tag(rev).isNotNull() & tag(res).isNotNull(), F.when(tag(rev) == tag(res), "resolved").otherwise("etag-mismatch"))
        .when(date(rev).isNotNull() & date(res).isNotNull(), F.when(date(rev) == date(res), "resolved").otherwise("date-mismatch"))
        .otherwise("unverified")
    )


def resolve_revisits(captures: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row per revisit: record_id, url, canonical_url, ts, refers_to, verdict, digest, headers.

    captures needs record_id, url, ts (timestamp), kind ('response' is a full
    one, 'revisit' a 304; others are ignored), headers map<string,string> and
    digest; further columns are not read.  refers_to is the response of the
    greatest ts strictly before the revisit, of equal ones that of the greatest
    record_id.  The verdict is resolved, etag-mismatch, date-mismatch, unverified
    (no validator in common) or unresolved (no earlier response, or a null URL or
    ts).  Entity tags are compared weakly and go before dates.  digest and merged
    headers come from the response if resolved or unverified; else digest is null
    and headers are the revisit's own.  Repeated rows stay.
    """
    c = captures.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "url", canonical_url(F.col("url")).alias("canonical_url"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "kind", lowered(F.col("headers")).alias("headers"), "digest"
    )
    cuts = c.agg(F.percentile_approx("us", [i / slices for i in range(1, slices)], 1000)).first()[0] if slices > 1 else None
    # A time's slice is the number of cuts up to it; captures of one time are in one slice.
    cuts = F.array(*(F.lit(x) for x in sorted(set(cuts or ())))).cast("array<long>")
    usable = F.col("canonical_url").isNotNull() & F.col("us").isNotNull()
    c = c.withColumn("slice", F.size(F.filter(cuts, lambda x: x <= F.col("us"))))
    stored = F.struct("us", "record_id", "headers_text", "digest")
    # Maps can't be compared, so the response's headers travel as text behind the columns that decide.
    c = c.withColumn("headers_text", F.to_json("headers"))
    full = F.when(F.col("kind") == "response", stored)
    known = c.where(usable)
    inside = Window.partitionBy("canonical_url", "slice").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    seen = known.withColumn("near", F.max(full).over(inside)).where("kind = 'revisit'")
    last = known.where("kind = 'response'").groupBy("canonical_url", "slice").agg(F.max(stored).alias("last"))
    # A revisit's slice may hold no response: slices of revisits take part in the handing over.
    asked = known.where("kind = 'revisit'").select("canonical_url", "slice").distinct()
    steps = last.unionByName(asked.withColumn("last", F.lit(None).cast(last.schema["last"].dataType))).groupBy("canonical_url", "slice").agg(F.max("last").alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = steps.withColumn("far", F.max("last").over(before)).where("far is not null").select("canonical_url", "slice", "far")
    found = seen.join(handed, ["canonical_url", "slice"], "left").withColumn("res", F.coalesce("near", "far")).drop("near", "far")
    lost = c.where((F.col("kind") == "revisit") & ~F.coalesce(usable, F.lit(False))).withColumn("res", F.lit(None).cast(found.schema["res"].dataType))
    rows = found.unionByName(lost.select(*found.columns))
    theirs = F.from_json("res.headers_text", "map<string,string>")
    rows = rows.withColumn("verdict", F.when(F.col("res").isNull(), "unresolved").otherwise(_check(F.col("headers"), theirs)))
    good = F.col("verdict").isin("resolved", "unverified")
    return rows.select(
        "record_id", "url", "canonical_url", "ts", F.col("res.record_id").alias("refers_to"), "verdict",
        F.when(good, F.col("res.digest")).alias("digest"), F.when(good, merged_headers(theirs, F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture log of pages: each one's full response and a revisit a week later under another form of its URL.

    Half the pages, by the URL's hash, have a second response after three days,
    with another body, and a second revisit after two weeks.  What a revisit
    carries as validators follows from that hash too: the entity tag of the
    page's latest response, a weak one, only the date, nothing, or a stale tag.
    """
    html, name = F.coalesce("html", F.lit("")), F.md5(F.coalesce("url", F.lit("")))
    case, twice = F.substring(name, 1, 1), F.substring(name, 2, 1) < "8"
    at, day = F.col("page_id") * 60, 86400

    def parts(body: Column) -> tuple[Column, Column, Column]:
        h = F.md5(body)
        return h, F.concat(F.lit('"'), F.substring(h, 1, 16), F.lit('"')), F.concat(F.lit("version "), F.substring(h, 17, 4))

    def capture(k: int, kind: str, url: Column, when: Column, headers: Column, digest: Column) -> Column:
        one = F.struct((F.col("page_id") * 4 + k).cast("long").alias("record_id"), url.alias("url"), F.timestamp_seconds(when).alias("ts"), F.lit(kind).alias("kind"), headers.alias("headers"), digest.alias("digest"))
        return one if k in (0, 2) else F.when(twice, one)

    def response(k: int, body: Column, when: Column) -> Column:
        h, tag, date = parts(body)
        headers = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(body).cast("string"), F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("Date"), when.cast("string"))
        return capture(k, "response", F.col("url"), when, headers, h)

    def revisit(k: int, when: Column) -> Column:
        _, tag, date = parts(F.concat(html, F.when(twice, F.lit("2")).otherwise("")))
        headers = F.map_filter(F.create_map(
            F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Date"), when.cast("string"),
            F.lit("ETag"), F.when(case < "8", tag).when(case < "c", F.concat(F.lit("W/"), tag)).when(case == "f", F.lit('"stale"')),
            F.lit("Last-Modified"), F.when(case < "e", date),
        ), lambda _, v: v.isNotNull())
        return capture(k, "revisit", F.concat("url", F.lit("#again")), when, headers, F.lit(None).cast("string"))

    each = F.array(response(0, html, at), response(1, F.concat(html, F.lit("2")), at + 3 * day), revisit(2, at + 7 * day), revisit(3, at + 14 * day))
    return pages.select(F.inline(F.filter(each, lambda x: x.isNotNull())))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of all pages resolved; headers as sorted lines."""
    r = resolve_revisits(captures_of(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return r.select("record_id", "canonical_url", "refers_to", "verdict", "digest", lines.alias("headers"))


QUERIES = {"op3_warc_revisits": op3_warc_revisits}

ORACLE_SQL = {
    "op3_warc_revisits": r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, substr(md5(coalesce(url, '')), 1, 1) AS k, substr(md5(coalesce(url, '')), 2, 1) < '8' AS twice, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
c AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|msclkid|ref|sessionid|phpsessid)(=|$)'))) AS q FROM p),
r AS (
  SELECT *, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END ELSE u END AS canonical_url FROM c),
b AS (SELECT page_id * 4 AS record_id, canonical_url, page_id * 60 AS ts, html FROM r UNION ALL SELECT page_id * 4 + 1, canonical_url, page_id * 60 + 259200, html || '2' FROM r WHERE twice),
s AS (SELECT record_id, canonical_url, ts, md5(html) AS h, octet_length(encode(html)) AS n, '"' || substr(md5(html), 1, 16) || '"' AS tag, 'version ' || substr(md5(html), 17, 4) AS date FROM b),
x AS (
  SELECT page_id * 4 + e AS record_id, canonical_url, page_id * 60 + 604800 * (e - 1) AS ts, k, md5(html || CASE WHEN twice THEN '2' ELSE '' END) AS h FROM r, (VALUES (2), (3)) AS t(e) WHERE e = 2 OR twice),
v AS (
  SELECT record_id, canonical_url, ts, CASE WHEN k < '8' THEN '"' || substr(h, 1, 16) || '"' WHEN k < 'c' THEN 'W/"' || substr(h, 1, 16) || '"' WHEN k = 'f' THEN '"stale"' END AS vtag,
    CASE WHEN k < 'e' THEN 'version ' || substr(h, 17, 4) END AS vdate FROM x),
j AS (
  SELECT v.record_id, v.canonical_url, v.ts, vtag, vdate, s.record_id AS found, s.n, s.h, s.tag, s.date,
    row_number() OVER (PARTITION BY v.record_id ORDER BY s.ts DESC, s.record_id DESC) AS k
  FROM v LEFT JOIN s ON v.canonical_url = s.canonical_url AND s.ts < v.ts),
w AS (
  SELECT *, CASE WHEN found IS NULL THEN 'unresolved' WHEN vtag IS NOT NULL THEN CASE WHEN regexp_replace(vtag, '^W/', '') = tag THEN 'resolved' ELSE 'etag-mismatch' END
    WHEN vdate IS NOT NULL THEN CASE WHEN vdate = date THEN 'resolved' ELSE 'date-mismatch' END ELSE 'unverified' END AS verdict FROM j WHERE k = 1)
SELECT record_id, canonical_url, found AS refers_to, verdict, CASE WHEN verdict IN ('resolved', 'unverified') THEN h END AS digest,
  'cache-control: max-age=60' || chr(10) || CASE WHEN verdict IN ('resolved', 'unverified')
    THEN 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || coalesce(vtag, tag) || chr(10) || 'last-modified: ' || coalesce(vdate, date)
    ELSE 'content-length: 0' || chr(10) || 'date: ' || ts || CASE WHEN vtag IS NOT NULL THEN chr(10) || 'etag: ' || vtag ELSE '' END || CASE WHEN vdate IS NOT NULL THEN chr(10) || 'last-modified: ' || vdate ELSE '' END END AS headers
FROM w
""",
}
