"""Selection, order, collapse, pages, requests and allow-lists over small corpora."""

import re

import pytest
from pyspark.sql import functions as F

from capweave.operators import allowlist, filters, pages, requests
from capweave.operators.filters import FilterSet, named, parse_expression, split_cli_filters
from capweave.operators.match import UrlPattern
from capweave.plans.query import captures, count
from capweave.schema import CAPTURE_SCHEMA, FIELDS, InvalidCursor, UnrequestableCapture, UnsupportedCollapse, UnsupportedPageQuery


def relation(spark, rows):
    """Rows as dicts; native order is list order."""
    out = [tuple(r.get(f) for f in FIELDS) + (r.get("extras"), "memory", i + 1, 0) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, CAPTURE_SCHEMA)


def row(url, timestamp="20240101000000", **more):
    host = url.split("://")[-1].split("/")[0]
    return {"url": url, "urlkey": ",".join(reversed(host.split("."))) + ")/" + "/".join(url.split("://")[-1].split("/")[1:]), "timestamp": timestamp, "status": "200", "mime": "text/html", **more}


@pytest.fixture(scope="module")
def site(spark):
    return relation(spark, [row("https://example.org/"), row("https://example.org/blog/"), row("https://example.org/newsletter"), row("http://example.org/news"), row("https://www.blog.example.org/x"), row("https://other.com/"), row("https://notexample.org/")]).cache()


def picked(df):
    return [r["url"] for r in df.orderBy("line_number").collect()]


def test_match_modes(site):
    assert picked(captures(site, "example.org/news*")) == ["https://example.org/newsletter", "http://example.org/news"]
    assert picked(captures(site, "example.org")) == ["https://example.org/"]
    assert len(picked(captures(site, "example.org", match="host"))) == 4
    assert len(picked(captures(site, "*.example.org"))) == 5
    assert picked(captures(site, "http://example.org/*")) == ["http://example.org/news"]
    assert len(picked(captures(site, "*.example.org/ignored"))) == 5
    with pytest.raises(ValueError):
        captures(site, "x", match="fuzzy")


def test_key_ranges_and_fallback(spark, site):
    p = UrlPattern.of("*.example.org")
    assert p.key_ranges() == [("org,example)", "org,example*"), ("org,example,", "org,example-")]
    assert UrlPattern.of("example.org/a").key_ranges() == [("org,example)/a", "org,example)/a ")]
    without = site.withColumn("url", F.lit(None).cast("string"))
    assert without.where(p.predicate(without)).count() == 5
    assert captures(site, "*.example.org", use_key_ranges=True).count() == 5


def test_field_filters(spark):
    df = relation(spark, [row("http://e.com/1", mime=None), row("http://e.com/2", status="404", extras={"x-note": "hello\nworld"}), row("http://e.com/3", mime_detected="image/png")])
    n = lambda *f: captures(df, filters=list(f)).count()
    assert n("=mime:") == 1 and n("!=mime:text/html") == 1 and n("!mime:html") == 1 and n("status:40") == 1
    assert n("~x-note:^world$") == 1 and n("!~x-note:hello") == 2 and n("=mime-detected:image/png") == 1 and n("=mime_detected:image/png") == 1
    assert n({"status": ["404", 200]}) == 3 and n({"status": re.compile("^4")}) == 1 and n({"status": 404}, "url:2") == 1
    assert n(lambda d: F.col("line_number") > 1) == 2
    for bad in ("nocolon", ":x"):
        with pytest.raises(ValueError):
            FilterSet(bad)
    with pytest.raises(ValueError):
        FilterSet(3.5)


def test_named_filters_corpus(spark):
    ok = {"filename": "crawl/warc/a.warc.gz"}
    cases = [
        (row("http://e.com/a", **ok), True), (row("http://e.com/a", mime="text/plain", **ok), True), (row("http://e.com/a", mime=None, mime_detected="application/xhtml+xml", **ok), True),
        (row("http://e.com/a.JS", **ok), False), (row("http://e.com/a?v=1.js", **ok), True), (row("http://e.com/robots.txt", mime="text/plain", **ok), False), (row("http://e.com/.well-known/x", **ok), False),
        (row("http://e.com/sitemap-1.xml", mime="text/xml", **ok), False), (row("http://e.com/sitemap", mime="application/rss+xml", **ok), False), (row("http://e.com/sitemap", **ok), True),
        (row("http://e.com/a", mime="text/html", mime_detected="application/pdf", **ok), False), (row("http://e.com/a", status="404", **ok), False), (row("http://e.com/a", filename="x/crawldiagnostics/y"), False),
        (row("http://e.com/a", mime="Text/HTML; charset=utf-8", **ok), True), (row("http://e.com/a", mime=None, **ok), False), (row("http://e.com/a", mime="image/svg+xml", **ok), False),
    ]
    df = relation(spark, [c for c, _ in cases])
    got = {r["line_number"] for r in captures(df, filters=[named("extractable_text")]).collect()}
    assert got == {i + 1 for i, (_, want) in enumerate(cases) if want}
    kept = captures(df, filters=[named("extractable_text", positive=False)]).count()
    assert kept == len(cases) - len(got)


def test_expressions_and_cli_filters():
    assert [t.stable_name for t in parse_expression(" +html, -warc,, status_200")] == ["html", "-warc", "status_200"]
    for bad in ("nope", "+", "html,-"):
        with pytest.raises(ValueError):
            parse_expression(bad)
    kinds = [type(x).__name__ for x in split_cli_filters("html,=status:200")]
    assert kinds == ["Named", "FieldFilter"]
    assert split_cli_filters("url:a,b")[0].operand == "a,b"
    assert FilterSet([named("html"), "=a:b"]).signature() == FilterSet([named("html"), "=a:b"]).signature()
    with pytest.raises(ValueError):
        FilterSet(lambda d: F.lit(True)).signature()


def test_custom_registry(spark, site):
    own = {"short": lambda df: F.length("url") < 20}
    assert captures(site, filters=[named("short")], registry=own).count() == 1
    with pytest.raises(ValueError):
        captures(site, filters=[named("short")])


@pytest.fixture(scope="module")
def days(spark):
    return relation(spark, [row("http://e.com/d", f"202401{d:02d}000000") for d in (3, 1, 5, 2, 4)] + [row("http://e.com/d", "20240105000000")]).cache()


def test_order_and_limits(days):
    order = lambda **k: [(r["timestamp"][6:8], r["line_number"]) for r in captures(days, **k).collect()]
    assert order(sort="timestamp", limit=2) == [("01", 2), ("02", 4)]
    assert order(sort="reverse_timestamp", limit=2) == [("05", 6), ("05", 3)]
    assert order(closest="20240103", limit="3") == [("03", 1), ("02", 4), ("04", 5)]
    assert order(closest="20240103", sort="timestamp")[0] == ("03", 1)
    assert order(limit=2) == [("03", 1), ("01", 2)] and order(limit=0) == []
    assert order(from_="20240102", to="20240103", sort="timestamp") == [("02", 4), ("03", 1)]
    for bad in ({"limit": -1}, {"limit": "x"}, {"sort": "size"}, {"cursor": "x"}, {"filter_signature": "x"}, {"from_": "yesterday"}):
        with pytest.raises(ValueError):
            captures(days, **bad)


def test_bad_timestamps(spark):
    df = relation(spark, [row("http://e.com/", "bad"), row("http://e.com/", None), row("http://e.com/", "2024")])
    assert captures(df).count() == 3 and captures(df, from_="2023").count() == 1
    with pytest.raises(Exception, match="invalid timestamp"):
        captures(df, strict=True).collect()


def test_projection(days):
    assert captures(days, fields=["url,status", "nope", "mime-detected"]).columns == ["url", "status", "nope", "mime_detected"]
    assert captures(days.drop("extras"), fields="url,nope").columns == ["url"]


def test_collapse(spark):
    df = relation(spark, [row("http://e.com/a", "2024"), row("http://e.com/b", "2023"), row("http://e.com/a", "2025", status="404"), row("http://e.com/b", "2023"), row("http://e.com/a", "2024")])
    got = lambda **k: sorted((r["urlkey"], r["line_number"]) for r in captures(df, collapse="urlkey", **k).collect())
    assert got() == [("com,e)/a", 3), ("com,e)/b", 4)]
    assert got(filters=["=status:200"]) == [("com,e)/a", 5), ("com,e)/b", 4)]
    assert got(limit=1) == [("com,e)/a", 3)]
    assert count(df, collapse="urlkey").first()[0] == 2 and count(df, limit=1).first()[0] == 5
    for bad in ({"collapse": "url"}, {"collapse": "urlkey", "collapse_order": "first"}, {"collapse_order": "latest"}, {"collapse": "urlkey", "sort": "timestamp"}, {"collapse": "urlkey", "closest": "2024"}, {"collapse": "urlkey", "packed": False}):
        with pytest.raises(UnsupportedCollapse):
            captures(df, **bad)


def walk(df, **options):
    out, cursor = [], None
    while True:
        p = pages.page(df, cursor=cursor, index_signature="same", **options)
        out.append([r["line_number"] for r in p])
        cursor = p.next_cursor
        if p.exhausted:
            return out


def test_pages_concatenate_to_the_query(spark):
    df = relation(spark, [row(f"http://e.com/{i % 4}", f"20240{1 + i % 3}", status="200" if i % 5 else "404") for i in range(23)])
    for size in (1, 3, 22, 23, 50):
        assert sum(walk(df, page_size=size), []) == list(range(1, 24))
    assert sum(walk(df, page_size=4, filters=["=status:200"]), []) == [i + 1 for i in range(23) if i % 5]
    collapsed = walk(df, page_size=3, collapse="urlkey")
    whole = [r["line_number"] for r in captures(df, collapse="urlkey").orderBy("urlkey").collect()]
    assert [len(p) for p in collapsed] == [3, 1] and sum(collapsed, []) == whole


def test_page_rules_and_cursors(spark, days):
    first = captures(days, page_size=2, fields="line_number")
    assert [r[0] for r in first] == [1, 2] and len(first) == 2 and not first.exhausted
    second = captures(days, page_size=3, cursor=first.next_cursor)
    assert [r["line_number"] for r in second] == [3, 4, 5]
    with pytest.raises(InvalidCursor, match="another query"):
        captures(days, page_size=2, cursor=first.next_cursor, filters=["=status:200"])
    with pytest.raises(InvalidCursor, match="another index"):
        pages.page(days, page_size=2, cursor=first.next_cursor, index_signature="other")
    for bad in ("", "junk", pages.PREFIX + "????", first.next_cursor[:-3] + "abc", first.next_cursor.upper()):
        with pytest.raises(InvalidCursor):
            captures(days, page_size=2, cursor=bad)
    for bad in ({"sort": "timestamp"}, {"closest": "2024"}, {"packed": False}):
        with pytest.raises(UnsupportedPageQuery):
            captures(days, page_size=2, **bad)
    for bad in ({"limit": 1}, {"page_size": 0}, {"filters": [lambda d: F.lit(True)]}):
        with pytest.raises(ValueError):
            captures(days, **{"page_size": 2} | bad)
    assert len(captures(days, page_size=2, filters=[lambda d: F.lit(True)], filter_signature="all")) == 2


def test_requests(spark):
    crawl = "crawl-data/CC-MAIN-2024-05/segments/1/warc/a.warc.gz"
    df = relation(spark, [row("http://e.com/1", filename=crawl, offset="654", length="321"), row("http://e.com/2", filename="", offset="-1", length="0")])
    r = requests.with_range_request(df, on_missing="skip").first()["request"]
    assert (r["url"], r["range_header"], tuple(r["range"]), r["port"], r["https"]) == (f"https://data.commoncrawl.org/{crawl}", "bytes=654-974", (654, 974), 443, True)
    assert r["headers"] == {"Range": "bytes=654-974"} and r["origin"] == "https://data.commoncrawl.org"
    local = requests.with_range_request(df, "http://localhost:9000/mirror/", "skip").first()["request"]
    assert (local["url"], local["path"], local["port"], local["host"]) == (f"http://localhost:9000/mirror/{crawl}", f"/mirror/{crawl}", 9000, "localhost")
    assert df.select(requests.missing_fields(df)).collect()[1][0] == ["filename", "offset", "length"]
    with pytest.raises(Exception, match="capture lacks filename, offset, length"):
        requests.with_range_request(df, "http://x.org").collect()
    with pytest.raises(Exception, match="base_url is required"):
        requests.with_range_request(df.withColumn("filename", F.lit("own/file")).limit(1)).collect()
    for bad in ("ftp://x", "//x", "http://x?y", "http://x#y", "http:///"):
        with pytest.raises(ValueError):
            requests.base_url(bad)
    with pytest.raises(ValueError):
        requests.requests(df, fields="url")
    with pytest.raises(ValueError):
        requests.with_range_request(df, on_missing="ignore")
    with pytest.raises(UnrequestableCapture) as e:
        requests.check_requestable({"filename": "x", "offset": "a", "length": "1"})
    assert e.value.missing_fields == ["offset"]
    assert requests.requests(df, "e.com/1", base="http://x.org").count() == 1


def test_allowlist(spark, monkeypatch):
    df = relation(spark, [row("https://example.com/docs/a"), row("https://www.blog.example.com/"), row("http://example.org/x?y"), {"urlkey": "com,example)/docs/b?q", "timestamp": "2024"}, row("http://xexample.com/")])
    pick = lambda *lines: [r["line_number"] for r in allowlist.allowed(df, allowlist.parse_lines(lines)).orderBy("line_number").collect()]
    for limit, single in ((100_000, 32), (100_000, 0), (0, 0)):  # rule by rule, and both ways of joining
        monkeypatch.setattr(allowlist, "BROADCAST_RULES", limit)
        monkeypatch.setattr(allowlist, "SINGLE_RULES", single)
        assert pick("example.com/docs") == [1, 4] and pick("*.example.com") == [1, 2, 4] and pick("example.org") == [3]
        assert pick("# none", "") == [] and pick("https://WWW.example.com", "*.example.com/docs") == [1, 4]
    with pytest.raises(ValueError, match="rules:2: invalid"):
        allowlist.parse_lines(["ok.com", "http://*x.com/"], "rules")
    a, b = allowlist.parse_lines(["b.com", "a.com/x", "b.com"]), allowlist.parse_lines(["a.com/x", "b.com"])
    assert allowlist.signature(a) == allowlist.signature(b) and allowlist.signature(a)["count"] == 2


def test_vocabularies():
    assert len(filters.TEXT_MIMES) == 11 and len(filters.ASSET_MIMES) == 12 and len(filters.ASSET_EXTENSIONS) == 33 and len(filters.METADATA_BASENAMES) == 9
