"""A capture relation derived from the tables `events` and `pages`, for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capweave.functions import urls
from capweave.schema import once


def captures_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture an event, of page event_id % count(pages); times are cut to the hour, so ties occur."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("page_url"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    total = F.broadcast(pages.agg(F.count("*").alias("n_pages")))  # one row
    e = events.crossJoin(total).withColumn("page_id", F.col("event_id") % F.col("n_pages")).join(pages, "page_id")
    origin, kind = F.regexp_extract("page_url", r"^(https?://[^/?#]+)", 1), F.col("page_id") % 10
    url = (
        F.when(kind == 0, F.concat(origin, F.lit("/robots.txt"))).when(kind == 1, F.concat(origin, F.lit("/post-sitemap.xml")))
        .when(kind == 2, F.concat(origin, F.lit("/img/"), F.col("page_id").cast("string"), F.lit(".PNG"))).otherwise(F.col("page_url"))
    )
    status = F.when(F.col("event_type").isin("view", "click"), "200").when(F.col("event_type") == "purchase", "301").when(F.col("event_type") == "signup", "404").otherwise("-")
    mime = (
        F.when(F.col("status") == "-", "warc/revisit").when(kind == 0, "text/plain").when(kind == 1, "application/xml").when(kind == 2, "image/png")
        .when(kind == 3, "Text/HTML; charset=UTF-8").when(kind == 4, F.lit(None).cast("string")).otherwise("text/html")
    )
    detected = F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("string")).when(kind == 2, "image/png").when(kind == 1, "application/xml").when(kind == 0, "text/plain").otherwise("text/html")
    folder = F.when(kind == 0, "robotstxt").when(F.col("status") != "200", "crawldiagnostics").otherwise("warc")
    filename = F.when(F.col("event_id") % 11 == 0, "custom/part.warc.gz").otherwise(F.concat(
        F.lit("crawl-data/CC-MAIN-2024-05/segments/"), F.col("user_id").cast("string"), F.lit("/"), folder,
        F.lit("/CC-MAIN-20240101000000-20240101030000-"), F.lpad((F.col("event_id") % 100).cast("string"), 5, "0"), F.lit(".warc.gz")))
    v = once(e, url=url, status=status)
    v = once(v, urlkey=urls.surt(F.col("url")))
    return v.select(
        "urlkey", F.date_format(F.date_trunc("hour", "ts"), "yyyyMMddHHmmss").alias("timestamp"), "url", mime.alias("mime"), detected.alias("mime_detected"), "status",
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.upper(F.md5(F.col("url").cast("binary")))).alias("digest"),
        (F.floor(F.col("value") * 100) + 1).cast("string").alias("length"), (F.col("event_id") * 1000).cast("string").alias("offset"), filename.alias("filename"),
        (F.col("event_id") % 4).cast("int").alias("file_ord"), F.floor(F.col("event_id") / 4).cast("long").alias("line_number"), F.col("event_id").alias("seq"),
    )


#: the same view in DuckDB SQL, to stand before a query
CTE = r"""WITH cap_p AS (SELECT page_id, url AS page_url FROM pages), cap_n AS (SELECT count(*) AS n FROM pages),
cap_e AS (SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, p.page_url, p.page_id, p.page_id % 10 AS kind, regexp_extract(p.page_url, '^(https?://[^/?#]+)', 1) AS origin
  FROM events e, cap_n, cap_p p WHERE p.page_id = e.event_id % cap_n.n),
cap_u AS (SELECT *, CASE kind WHEN 0 THEN origin || '/robots.txt' WHEN 1 THEN origin || '/post-sitemap.xml' WHEN 2 THEN origin || '/img/' || page_id || '.PNG' ELSE page_url END AS url,
  CASE WHEN event_type IN ('view', 'click') THEN '200' WHEN event_type = 'purchase' THEN '301' WHEN event_type = 'signup' THEN '404' ELSE '-' END AS status FROM cap_e),
cap_h AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '^www\.', '') AS host,
  CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS bare_path,
  regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme FROM cap_u),
captures AS (SELECT array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || bare_path || query AS urlkey, strftime(date_trunc('hour', ts), '%Y%m%d%H%M%S') AS timestamp, url,
  CASE WHEN status = '-' THEN 'warc/revisit' WHEN kind = 0 THEN 'text/plain' WHEN kind = 1 THEN 'application/xml' WHEN kind = 2 THEN 'image/png' WHEN kind = 3 THEN 'Text/HTML; charset=UTF-8' WHEN kind = 4 THEN NULL ELSE 'text/html' END AS mime,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN kind = 2 THEN 'image/png' WHEN kind = 1 THEN 'application/xml' WHEN kind = 0 THEN 'text/plain' ELSE 'text/html' END AS mime_detected, status,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE upper(md5(url)) END AS digest, CAST(CAST(floor(value * 100) AS BIGINT) + 1 AS VARCHAR) AS length, CAST(event_id * 1000 AS VARCHAR) AS "offset",
  CASE WHEN event_id % 11 = 0 THEN 'custom/part.warc.gz' ELSE 'crawl-data/CC-MAIN-2024-05/segments/' || user_id || '/' || CASE WHEN kind = 0 THEN 'robotstxt' WHEN status <> '200' THEN 'crawldiagnostics' ELSE 'warc' END
    || '/CC-MAIN-20240101000000-20240101030000-' || lpad(CAST(event_id % 100 AS VARCHAR), 5, '0') || '.warc.gz' END AS filename,
  CAST(event_id % 4 AS INTEGER) AS file_ord, event_id // 4 AS line_number, event_id AS seq, host, bare_path, bare_path || query AS path_query, scheme,
  list_filter([lower(trim(split_part(mime_x, ';', 1))), lower(trim(split_part(det_x, ';', 1)))], lambda x: x IS NOT NULL AND x <> '') AS mimes
  FROM (SELECT *, CASE WHEN status = '-' THEN 'warc/revisit' WHEN kind = 0 THEN 'text/plain' WHEN kind = 1 THEN 'application/xml' WHEN kind = 2 THEN 'image/png' WHEN kind = 3 THEN 'Text/HTML; charset=UTF-8' WHEN kind = 4 THEN NULL ELSE 'text/html' END AS mime_x,
    CASE WHEN event_id % 3 = 0 THEN NULL WHEN kind = 2 THEN 'image/png' WHEN kind = 1 THEN 'application/xml' WHEN kind = 0 THEN 'text/plain' ELSE 'text/html' END AS det_x FROM cap_h))
"""
