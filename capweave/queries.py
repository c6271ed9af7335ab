"""The registered queries, each with the DuckDB SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capweave.functions import urls, values
from capweave.operators import allowlist, filters, requests
from capweave.operators.filters import Named, named
from capweave.operators.match import UrlPattern
from capweave.operators.order import latest_per_key
from capweave.operators.pages import at_or_after
from capweave.plans import derive, query
from capweave.plans.fixture import CTE, captures_view
from capweave.sources import packed
from capweave.sources.text import parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None, build: Callable[[DataFrame], DataFrame]) -> None:
    """build takes the capture view; sql may select from `captures`."""
    QUERIES[name] = lambda spark, sf_dir: build(captures_view(spark, sf_dir))
    if sql is not None:
        ORACLE[name] = CTE + sql


_ROW = ["seq", "urlkey", "timestamp", "status"]
_ROW_SQL = "seq, urlkey, timestamp, status"
# fixed values of the named filters, written out for the SQL
ASSET_EXT = """('.7z', '.avi', '.avif', '.bmp', '.br', '.css', '.eot', '.gif', '.gz', '.ico', '.jpeg', '.jpg', '.js', '.json', '.map', '.mjs', '.mov', '.mp3',
  '.mp4', '.otf', '.pdf', '.png', '.rar', '.svg', '.tar', '.tgz', '.ttf', '.wasm', '.webm', '.webp', '.woff', '.woff2', '.zip')"""
ASSET_MIME = """('application/javascript', 'application/ecmascript', 'application/font-woff', 'application/font-woff2', 'application/pdf', 'application/vnd.ms-fontobject',
  'application/x-font-ttf', 'application/x-javascript', 'image/svg+xml', 'text/css', 'text/javascript', 'text/ecmascript')"""
TEXT_MIME = """('text/plain', 'text/html', 'text/xml', 'application/xml', 'application/xhtml+xml', 'application/rss+xml', 'application/atom+xml',
  'application/rdf+xml', 'text/markdown', 'text/x-markdown', 'text/x-web-markdown')"""
METADATA_BASE = "('ads.txt', 'app-ads.txt', 'browserconfig.xml', 'humans.txt', 'manifest.json', 'opensearch.xml', 'robots.txt', 'security.txt', 'site.webmanifest')"

# --- keys and scalar functions
c = F.col
register("surt_key", "SELECT seq, urlkey AS key FROM captures", lambda v: v.select("seq", urls.surt(c("url")).alias("key")))
register("canonical_host", "SELECT seq, host FROM captures", lambda v: v.select("seq", urls.url_host(c("url")).alias("host")))
_BASE_SQL = r"CASE WHEN regexp_matches(raw_path, '^/+$') THEN '/' ELSE regexp_extract(raw_path, '([^/]+)/*$', 1) END"
_RAW = r"(SELECT *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS raw_path FROM captures)"
register(
    "url_path_ext", rf"SELECT seq, raw_path AS path, base, lower(regexp_extract(base, '^\.*[^.].*?(\.[^.]*)$', 1)) AS ext FROM (SELECT *, {_BASE_SQL} AS base FROM {_RAW})",
    lambda v: v.select("seq", urls.url_path(c("url")).alias("path"), urls.path_basename(urls.url_path(c("url"))).alias("base"), urls.path_extension(urls.url_path(c("url"))).alias("ext")),
)
register(
    "prefix_key_range", f"SELECT {_ROW_SQL} FROM captures WHERE (urlkey >= 'com,example)' AND urlkey < 'com,example*') OR (urlkey >= 'com,example,' AND urlkey < 'com,example-')",
    lambda v: v.where(UrlPattern.of("*.example.com").in_key_ranges(c("urlkey"))).select(*_ROW),
)
_FN = r"'^crawl-data/([^/]+)/segments/([^/]+)/(warc|robotstxt|crawldiagnostics)/(.+)-(\d{5})\.warc\.gz$'"
register(
    "filename_parts",
    f"SELECT seq, nullif(regexp_extract(filename, {_FN}, 1), '') AS crawl, nullif(regexp_extract(filename, {_FN}, 2), '') AS segment, coalesce(nullif(regexp_extract(filename, {_FN}, 3), ''), 'fallback') AS kind, nullif(regexp_extract(filename, {_FN}, 4), '') AS pair, nullif(regexp_extract(filename, {_FN}, 5), '') AS number FROM captures",
    lambda v: v.select("seq", urls.filename_parts(c("filename")).alias("p")).select("seq", "p.*"),
)
register("urlkey_inverse", "SELECT seq, host AS key_host, bare_path AS key_path FROM captures", lambda v: v.select("seq", urls.key_host(c("urlkey")).alias("key_host"), urls.key_path(c("urlkey")).alias("key_path")))
register("warc_url", "SELECT seq, 'https://data.commoncrawl.org/' || filename AS warc_url FROM captures", lambda v: v.select("seq", urls.warc_url(c("filename")).alias("warc_url")))
register(
    "crawl_path", "SELECT seq, filename LIKE 'crawl-data/CC-MAIN-____-__/%' AS is_crawl FROM captures", lambda v: v.select("seq", urls.is_crawl_path(c("filename")).alias("is_crawl")))
register(
    "ts_pad",
    """SELECT seq, t, t || substr('19780101000000', length(t) + 1) AS low, CASE WHEN length(t) > 6 THEN t || substr('29991231235959', length(t) + 1)
       ELSE substr(t || substr('29991231235959', length(t) + 1), 1, 6) || strftime(last_day(strptime(substr(t || substr('29991231235959', length(t) + 1), 1, 6) || '01', '%Y%m%d')), '%d') || '235959' END AS high
       FROM (SELECT seq, substr(timestamp, 1, CAST(CASE seq % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 10 END AS INTEGER)) AS t FROM captures)""",
    lambda v: v.select("seq", F.substring(c("timestamp"), F.lit(1), F.when(c("seq") % 3 == 0, 4).when(c("seq") % 3 == 1, 6).otherwise(10)).alias("t")).select("seq", "t", values.pad_low(c("t")).alias("low"), values.pad_high(c("t")).alias("high")),
)
register("to_time", "SELECT seq, CAST(epoch(strptime(timestamp, '%Y%m%d%H%M%S')) AS BIGINT) AS epoch FROM captures", lambda v: v.select("seq", F.unix_timestamp(values.instant(c("timestamp"))).alias("epoch")))
register(
    "byte_range", """SELECT seq, CAST("offset" AS BIGINT) AS start_byte, CAST("offset" AS BIGINT) + CAST(length AS BIGINT) - 1 AS end_byte FROM captures""",
    lambda v: v.select("seq", values.byte_range(c("offset"), c("length")).alias("r")).select("seq", c("r.start").alias("start_byte"), c("r.end").alias("end_byte")),
)
register("revisit", "SELECT seq, coalesce(mime = 'warc/revisit', false) OR status = '-' AS revisit FROM captures", lambda v: v.select("seq", values.is_revisit(c("mime"), c("status")).alias("revisit")))
register("mime_types", "SELECT seq, array_to_string(mimes, '|') AS mimes FROM captures", lambda v: v.select("seq", F.array_join(values.mime_types(c("mime"), c("mime_detected")), "|").alias("mimes")))
register("digest_check", "SELECT seq, regexp_full_match(digest, '[A-Z2-7]{32}') AS canonical FROM captures", lambda v: v.select("seq", values.is_canonical_digest(c("digest")).alias("canonical")))

# --- URL patterns
_sel = lambda *a, **k: lambda v: query.captures(v, *a, fields=_ROW, **k)
_FIRST = "(SELECT min(host) FROM captures WHERE host LIKE '%.example.com' AND bare_path = '/robots.txt')"


def _on_first_host(make):
    """A query whose pattern is made from the least host under example.com that has a robots.txt (one row, read first)."""

    def build(v: DataFrame) -> DataFrame:
        first = v.select("url", urls.url_host(c("url")).alias("h")).where(c("h").endswith(".example.com") & c("url").endswith("/robots.txt")).agg(F.min("h")).first()[0]
        return make(v, first)

    return build


register("match_exact", f"SELECT {_ROW_SQL} FROM captures WHERE host = {_FIRST} AND path_query = '/robots.txt'", _on_first_host(lambda v, h: query.captures(v, f"{h}/robots.txt", fields=_ROW)))
register("match_prefix", f"SELECT {_ROW_SQL} FROM captures WHERE host = {_FIRST} AND starts_with(path_query, '/r')", _on_first_host(lambda v, h: query.captures(v, f"http://WWW.{h}/r*".replace("http://", ""), fields=_ROW)))
register("match_host", f"SELECT {_ROW_SQL} FROM captures WHERE host = {_FIRST}", _on_first_host(lambda v, h: query.captures(v, h, match="host", fields=_ROW)))
register("match_domain", f"SELECT {_ROW_SQL} FROM captures WHERE host = 'example.com' OR host LIKE '%.example.com'", _sel("*.example.com"))
register("match_scheme", f"SELECT {_ROW_SQL} FROM captures WHERE scheme = 'https' AND (host = 'example.org' OR host LIKE '%.example.org')", _sel("https://example.org/", match="domain"))
register(
    "match_urlkey_fallback", f"SELECT {_ROW_SQL} FROM captures WHERE CASE WHEN seq % 17 = 0 THEN starts_with(urlkey, 'org,example)') OR starts_with(urlkey, 'org,example,') ELSE scheme = 'https' AND (host = 'example.org' OR host LIKE '%.example.org') END",
    lambda v: query.captures(v.withColumn("url", F.when(c("seq") % 17 != 0, c("url"))), "https://example.org/", match="domain", fields=_ROW),
)
register("match_with_key_ranges", f"SELECT {_ROW_SQL} FROM captures WHERE host = 'example.net' OR host LIKE '%.example.net'", _sel("*.example.net", use_key_ranges=True))

# --- field filters
for _name, _filter, _sql in (
    ("flt_contains", "url:example.org", "coalesce(url, '') LIKE '%example.org%'"), ("flt_not_contains", "!mime:html", "NOT contains(coalesce(mime, ''), 'html')"),
    ("flt_eq", "=status:200", "status = '200'"), ("flt_ne", "!=mime:text/html", "coalesce(mime, '') <> 'text/html'"),
    ("flt_regex", "~status:^[34]0[14]$", "regexp_matches(status, '^[34]0[14]$')"), ("flt_not_regex", "!~mime-detected:^(text|image)/", "NOT regexp_matches(coalesce(mime_detected, ''), '^(text|image)/')"),
):
    register(_name, f"SELECT {_ROW_SQL} FROM captures WHERE {_sql}", _sel(filters=[_filter]))
register("flt_in", f"SELECT {_ROW_SQL} FROM captures WHERE status IN ('301', '404') AND coalesce(mime, '') IN ('', 'text/html')", _sel(filters={"status": ["301", "404"], "mime": ["", "text/html"]}))
register("flt_missing_equals_empty", f"SELECT {_ROW_SQL} FROM captures WHERE coalesce(digest, '') = ''", _sel(filters=["=digest:"]))
register("flt_callable", f"SELECT {_ROW_SQL} FROM captures WHERE CAST(length AS BIGINT) > 5000 AND status = '200'", _sel(filters=[lambda df: c("length").cast("long") > 5000, "=status:200"]))

# --- named filters
_ASSET = f"(len(list_filter(mimes, lambda m: m IN {ASSET_MIME} OR starts_with(m, 'audio/') OR starts_with(m, 'font/') OR starts_with(m, 'image/') OR starts_with(m, 'video/')))" + rf" > 0 OR lower(regexp_extract(base, '^\.*[^.].*?(\.[^.]*)$', 1)) IN {ASSET_EXT})"
_META = f"(lower(base) IN {METADATA_BASE} OR (contains(lower(base), 'sitemap') AND (regexp_matches(lower(base), '\\.xml(\\.gz)?$') OR len(list_filter(mimes, lambda m: m IN ('text/xml', 'application/xml') OR ends_with(m, '+xml'))) > 0)) OR starts_with(lower(raw_path), '/.well-known/'))"
_TEXT = f"(len(list_filter(mimes, lambda m: m IN {TEXT_MIME})) > 0)"
_WARC = "contains(filename, '/warc/')"
_EXTRACT = f"(status = '200' AND {_WARC} AND {_TEXT} AND NOT {_ASSET} AND NOT {_META})"
_WITH_BASE = f"(SELECT *, {_BASE_SQL} AS base FROM {_RAW})"
_NAMED_SQL = {"status_200": "status = '200'", "html": "list_contains(mimes, 'text/html')", "text_like": _TEXT, "asset_like": _ASSET, "site_metadata": _META, "warc": _WARC, "extractable_text": _EXTRACT}
for _name, _sql in _NAMED_SQL.items():
    register(f"named_{_name}", f"SELECT {_ROW_SQL} FROM {_WITH_BASE} WHERE {_sql}", _sel(filters=[named(_name)]))
register("named_expression", f"SELECT {_ROW_SQL} FROM {_WITH_BASE} WHERE {_TEXT} AND NOT {_META} AND status = '200'", _sel(filters=filters.parse_expression("+text_like, -site_metadata ,status_200")))

# --- ranges, order, limits, projection, counts
register("ts_range", f"SELECT {_ROW_SQL} FROM captures WHERE timestamp >= '20240105000000' AND timestamp <= '20240120235959'", _sel(from_="20240105", to="20240120"))
register("ts_range_month", f"SELECT {_ROW_SQL} FROM captures WHERE status = '404' AND timestamp >= '20240101000000' AND timestamp <= '20240131235959'", _sel(from_="202401", to="202401", filters=["=status:404"]))
register("sort_timestamp_topk", f"SELECT {_ROW_SQL} FROM captures ORDER BY timestamp, file_ord, line_number LIMIT 25", _sel(sort="timestamp", limit=25))
register("sort_reverse_topk", f"SELECT {_ROW_SQL} FROM captures ORDER BY timestamp DESC, file_ord DESC, line_number DESC LIMIT 25", _sel(sort="reverse_timestamp", limit="25"))
register(
    "closest_topk", f"SELECT {_ROW_SQL} FROM captures WHERE status = '200' ORDER BY abs(epoch(strptime(timestamp, '%Y%m%d%H%M%S')) - epoch(TIMESTAMP '2024-01-15 00:00:00')), timestamp, file_ord, line_number LIMIT 20",
    _sel(closest="20240115", filters=["=status:200"], limit=20),
)
register("native_limit", f"SELECT {_ROW_SQL} FROM captures WHERE status <> '200' ORDER BY file_ord, line_number LIMIT 30", _sel(filters=["!=status:200"], limit=30))
register("limit_zero", f"SELECT {_ROW_SQL} FROM captures LIMIT 0", _sel(limit=0))
register("project_fields", 'SELECT url, mime_detected, "offset", status FROM captures', lambda v: query.captures(v, fields=["url,mime-detected", "offset", "no-such-field", "status"]))
register("row_json", """SELECT '{"seq":' || seq || ',"status":"' || status || '"' || coalesce(',"mime":"' || mime || '"', '') || '}' AS value FROM captures""", lambda v: derive.jsonl(v.select("seq", "status", "mime")))
register("text_lines", "SELECT concat_ws(' ', status, timestamp, url) AS value FROM captures", derive.text_lines)
register("count_matches", "SELECT count(*) AS captures FROM captures WHERE host = 'example.com' OR host LIKE '%.example.com'", lambda v: query.count(v, "*.example.com", limit=3))
register("count_collapsed", "SELECT count(DISTINCT urlkey) AS captures FROM captures WHERE status = '200'", lambda v: query.count(v, filters=["=status:200"], collapse="urlkey"))
register(
    "derive_summary", """SELECT count(*) AS record_count, CAST(sum(CAST(length AS BIGINT)) AS BIGINT) AS length_sum, CAST(sum(CAST("offset" AS BIGINT)) AS BIGINT) AS offset_sum, min(urlkey) AS first_key, max(urlkey) AS last_key FROM captures""",
    packed.summarise,
)
register("file_key_ranges", "SELECT file_ord, min(urlkey) AS first_key, max(urlkey) AS last_key, count(*) AS record_count FROM captures GROUP BY file_ord", lambda v: packed.key_ranges(v, "file_ord"))
register(
    "dictionary_ids", "SELECT field, value, CAST(row_number() OVER (PARTITION BY field ORDER BY value) AS INTEGER) AS id FROM (SELECT DISTINCT 'status' AS field, status AS value FROM captures UNION SELECT DISTINCT 'mime', mime FROM captures WHERE mime IS NOT NULL)",
    lambda v: _dictionaries(v, ["status", "mime"]),
)


def _dictionaries(v: DataFrame, names: list[str]) -> DataFrame:
    """Distinct values of each field, numbered from 1 in order."""
    from pyspark.sql import Window

    pairs = v.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c(n).alias("value")) for n in names])).alias("p")).select("p.*").where("value is not null").distinct()
    return pairs.withColumn("id", F.row_number().over(Window.partitionBy("field").orderBy("value")))


# --- collapse, pages
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY urlkey ORDER BY timestamp DESC, file_ord DESC, line_number DESC) AS rn FROM {src} WHERE {where}) WHERE rn = 1"
register("collapse_latest", f"SELECT {_ROW_SQL} FROM ({_LATEST.format(src='captures', where='true')})", _sel(collapse="urlkey"))
register("collapse_filtered", f"SELECT {_ROW_SQL} FROM ({_LATEST.format(src='captures', where="status = '200'")})", _sel(collapse="urlkey", collapse_order="latest", filters=["=status:200"]))
register("collapse_limit", f"SELECT {_ROW_SQL} FROM ({_LATEST.format(src='captures', where='true')}) ORDER BY urlkey LIMIT 15", _sel(collapse="urlkey", limit=15))


def _second_page(v: DataFrame, keys: list[str], rows: DataFrame, size: int) -> DataFrame:
    """The second page, from the position that the first one's look-ahead gives."""
    first = rows.orderBy(*keys).select(*keys).limit(size + 1).collect()
    if len(first) <= size:
        return rows.limit(0).select(*_ROW)
    return rows.where(at_or_after([c(k) for k in keys], [first[size][k] for k in keys])).orderBy(*keys).limit(size).select(*_ROW)


register("page_two", f"SELECT {_ROW_SQL} FROM captures WHERE status = '200' ORDER BY file_ord, line_number LIMIT 40 OFFSET 40", lambda v: _second_page(v, ["file_ord", "line_number"], query.selected(v, filters=["=status:200"]), 40))
register("collapsed_page_two", f"SELECT {_ROW_SQL} FROM ({_LATEST.format(src='captures', where='true')}) ORDER BY urlkey LIMIT 20 OFFSET 20", lambda v: _second_page(v, ["urlkey"], latest_per_key(v), 20))

# --- derive and requests
_RULES = ["*.example.com/r", "# comment", "", "example.org", "*.example.net"]
register(
    "allowlist", f"SELECT {_ROW_SQL} FROM captures WHERE ((host = 'example.com' OR host LIKE '%.example.com') AND starts_with(bare_path, '/r')) OR host = 'example.org' OR host = 'example.net' OR host LIKE '%.example.net'",
    lambda v: allowlist.allowed(v, allowlist.parse_lines(_RULES)).select(*_ROW),
)
register(
    "sorted_violations", "SELECT file_ord, line_number, urlkey, previous_urlkey FROM (SELECT *, lag(urlkey) OVER (PARTITION BY file_ord ORDER BY line_number) AS previous_urlkey FROM captures) WHERE previous_urlkey > urlkey",
    lambda v: derive.sorted_violations(v, "file_ord"),
)
register(
    "grouping_violations", "SELECT file_ord, first_key, last_key, record_count, previous_last_key FROM (SELECT *, lag(last_key) OVER (ORDER BY file_ord) AS previous_last_key FROM (SELECT file_ord, min(urlkey) AS first_key, max(urlkey) AS last_key, count(*) AS record_count FROM captures GROUP BY file_ord)) WHERE previous_last_key > first_key",
    derive.grouping_violations,
)
register(
    "encode_violations",
    """SELECT urlkey, file_ord, line_number, field, value, reason FROM (
       SELECT urlkey, file_ord, line_number, 'digest' AS field, digest AS value, 'not a canonical base-32 SHA-1' AS reason FROM captures WHERE digest IS NOT NULL AND NOT regexp_full_match(digest, '[A-Z2-7]{32}')
       UNION ALL SELECT urlkey, file_ord, line_number, 'mime', mime, 'missing' FROM captures WHERE mime IS NULL
       UNION ALL SELECT urlkey, file_ord, line_number, 'length', '-' || length, 'not a non-negative integer' FROM captures WHERE seq % 17 = 0)""",
    lambda v: packed.violations(v.withColumn("length", F.when(c("seq") % 17 == 0, F.concat(F.lit("-"), c("length"))).otherwise(c("length")))),
)
register(
    "preview_counts", f"SELECT (SELECT count(*) FROM captures) AS total_count, count(*) AS selected_count, (SELECT count(*) FROM captures) - count(*) AS filtered_count FROM {_WITH_BASE} WHERE {_EXTRACT}",
    lambda v: derive.preview(v, derive.Plan(named="extractable_text")).drop("raw_bytes"),
)
register(
    "derive_collapsed", f"SELECT {_ROW_SQL} FROM ({_LATEST.format(src=_WITH_BASE, where=f"{_EXTRACT} AND (host = 'example.com' OR host LIKE '%.example.com')")})",
    lambda v: derive.Plan(named="extractable_text", only_urls=allowlist.parse_lines(["*.example.com"]), collapse="urlkey").select(v).select(*_ROW),
)
register("cdxj_roundtrip", "SELECT urlkey, timestamp, url, mime, mime_detected, status, digest, length, \"offset\", filename, file_ord, line_number FROM captures", lambda v: _roundtrip(v))


def _roundtrip(v: DataFrame) -> DataFrame:
    """Rows written as text lines and parsed again."""
    lines = v.select(derive.cdxj_line(v).alias("value"), F.lit("memory").alias("source_path"), "line_number", "file_ord")
    return parse(lines, headers=False).select("urlkey", "timestamp", "url", "mime", "mime_detected", "status", "digest", "length", "offset", "filename", "file_ord", "line_number")


register(
    "range_requests", """SELECT seq, 'https://data.commoncrawl.org/' || filename AS url, '/' || filename AS path, 'bytes=' || "offset" || '-' || (CAST("offset" AS BIGINT) + CAST(length AS BIGINT) - 1) AS range_header FROM captures WHERE seq % 13 <> 0""",
    lambda v: requests.with_range_request(v.withColumn("filename", F.when(c("seq") % 13 != 0, c("filename"))), "https://data.commoncrawl.org/", "skip").select("seq", "request.url", "request.path", "request.range_header"),
)
register(
    "missing_fields", """SELECT seq, concat_ws(',', CASE WHEN seq % 13 = 0 THEN 'filename' END, CASE WHEN seq % 17 = 0 THEN 'offset' END, CASE WHEN seq % 19 = 0 THEN 'length' END) AS missing FROM captures""",
    lambda v: _broken(v).select("seq", F.array_join(requests.missing_fields(_broken(v)), ",").alias("missing")),
)


def _broken(v: DataFrame) -> DataFrame:
    return v.withColumn("filename", F.when(c("seq") % 13 != 0, c("filename"))).withColumn("offset", F.when(c("seq") % 17 == 0, F.lit("x")).otherwise(c("offset"))).withColumn("length", F.when(c("seq") % 19 == 0, F.lit("0")).otherwise(c("length")))


# --- the flagship: latest extractable-text capture of each key under a domain in a month's first days
register(
    "flagship", f"SELECT seq, urlkey, timestamp, url, status FROM ({_LATEST.format(src=_WITH_BASE, where=f"{_EXTRACT} AND (host = 'example.com' OR host LIKE '%.example.com') AND timestamp >= '20240101000000' AND timestamp <= '20240120235959'")})",
    lambda v: query.captures(v, "*.example.com", from_="20240101", to="20240120", filters=[Named("extractable_text")], collapse="urlkey", fields=["seq", "urlkey", "timestamp", "url", "status"]),
)
