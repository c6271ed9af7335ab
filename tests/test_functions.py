"""URL, key and timestamp rules: literals and columns agree, and hold in the odd cases."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from capweave.functions import urls, values

URLS = [
    # url, host, path and query, key
    ("http://www.Example.com/A?b=C#d", "example.com", "/A?b=C", "com,example)/A?b=C"),
    ("https://user:pw@sub.example.org:8080/x/y", "sub.example.org", "/x/y", "org,example,sub)/x/y"),
    ("example.net", "example.net", "/", "net,example)/"),
    ("www2.example.net/a", "www2.example.net", "/a", "net,example,www2)/a"),
    ("http://example.com.", "example.com", "/", "com,example)/"),
    ("http://example.com?q=1", "example.com", "/?q=1", "com,example)/?q=1"),
    ("http://example.com/?", "example.com", "/?", "com,example)/?"),
    ("http://example.com/path*", "example.com", "/path", "com,example)/path"),
    ("*.example.com/x", "example.com", "/x", "com,example)/x"),
    ("  http://example.com/t \n", "example.com", "/t", "com,example)/t"),
    ("http://example.com/a*#frag", "example.com", "/a*", "com,example)/a*"),
    ("http://[::1]:80/v6", "[::1]", "/v6", "[::1])/v6"),
]


def test_url_columns_and_literals_agree(spark):
    rows = spark.createDataFrame([(u,) for u, *_ in URLS], "url string")
    got = rows.select(urls.url_host(F.col("url")), urls.url_path_query(F.col("url")), urls.surt(F.col("url"))).collect()
    for (url, host, path, key), r in zip(URLS, got):
        assert tuple(r) == (host, path, key), url
        literal = urls.parse_literal(url)
        assert (literal.host, literal.path, literal.surt) == (host, path, key), url


@pytest.mark.parametrize("url", ["http://a b/c", "http://exämple.com/", "http://e.com/%zz", "http://e.com/<x>"])
def test_what_is_no_url_has_no_parts(spark, url):
    r = spark.createDataFrame([(url,)], "url string").select(urls.url_host(F.col("url")), urls.surt(F.col("url"))).first()
    assert tuple(r) == (None, None)


def test_url_path_and_names(spark):
    cases = {
        "http://e.com/a/foo.js?v=1.css": ("/a/foo.js", "foo.js", ".js"), "http://e.com/.profile": ("/.profile", ".profile", ""), "http://e.com/.profile.SH": ("/.profile.SH", ".profile.SH", ".sh"),
        "http://e.com/foo.": ("/foo.", "foo.", "."), "http://e.com/a.b/": ("/a.b/", "a.b", ".b"), "http://e.com/noext": ("/noext", "noext", ""), "http://e.com": ("", "", ""),
        "http://a b/c.js?x": ("http://a b/c.js", "c.js", ".js"), "plain/path.gz": ("plain/path.gz", "path.gz", ".gz"),
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string")
    p = urls.url_path(F.col("url"))
    got = rows.select("url", p.alias("p"), urls.path_basename(p).alias("b"), urls.path_extension(p).alias("e")).collect()
    assert {r["url"]: (r["p"], r["b"], r["e"]) for r in got} == cases


def test_long_urls_do_not_overflow(spark):
    url = "http://example.com/" + "a%20b/" * 20_000
    assert spark.createDataFrame([(url,)], "url string").select(urls.url_host(F.col("url"))).first()[0] == "example.com"


def test_filename_and_key_inverse(spark):
    rows = spark.createDataFrame([("crawl-data/CC-MAIN-2024-05/segments/17.9/warc/CC-MAIN-1-2-00042.warc.gz", "com,example,a)/x?y"), ("custom/a.warc.gz", "nokey"), (None, None)], "f string, k string")
    got = rows.select(urls.filename_parts(F.col("f")).alias("p"), urls.key_host(F.col("k")).alias("h"), urls.key_path(F.col("k")).alias("q"), urls.is_crawl_path(F.col("f")).alias("c")).collect()
    assert tuple(got[0]["p"]) == ("CC-MAIN-2024-05", "17.9", "warc", "CC-MAIN-1-2", "00042") and (got[0]["h"], got[0]["q"], got[0]["c"]) == ("a.example.com", "/x", True)
    assert got[1]["p"]["kind"] == "fallback" and got[1]["h"] is None and got[2]["h"] is None and got[2]["c"] is False


@given(st.text(min_size=1, max_size=8), st.text(max_size=4))
def test_prefix_successor_bounds_all_extensions(prefix, more):
    after = urls.prefix_successor(prefix)
    if after is not None and not any(0xD800 <= ord(c) < 0xE000 for c in prefix + more):
        assert prefix + more < after


def test_timestamp_pads(spark):
    for t, low, high in (("2024", "20240101000000", "20241231235959"), ("202402", "20240201000000", "20240229235959"), ("20240210", "20240210000000", "20240210235959"), ("20240230", "20240230000000", "20240230235959"), ("20240101123456", "20240101123456", "20240101123456")):
        assert values.normalize_timestamp(t) == low and values.normalize_timestamp(t, high=True) == high
        r = spark.createDataFrame([(t,)], "t string").select(values.pad_low(F.col("t")), values.pad_high(F.col("t"))).first()
        assert tuple(r) == (low, high)
    for bad in ("", "2024-01", "x", "123456789012345"):
        with pytest.raises(ValueError):
            values.normalize_timestamp(bad)
    assert values.normalize_timestamp(None) is None


def test_numbers_mimes_and_digests(spark):
    rows = spark.createDataFrame([("007", "10", "Text/HTML; charset=x", " ", "A" * 32), ("-5", "x", None, "image/PNG", "A" * 31 + "1"), (None, "1", "warc/revisit", None, None)], "o string, n string, m string, d string, g string")
    got = rows.select(values.byte_range(F.col("o"), F.col("n")).alias("r"), values.whole_number(F.col("o")).alias("o"), values.mime_types(F.col("m"), F.col("d")).alias("m"), values.is_canonical_digest(F.col("g")).alias("g"), values.is_revisit(F.col("m"), F.lit("200")).alias("v")).collect()
    assert tuple(got[0]["r"]) == (7, 16) and got[0]["m"] == ["text/html"] and got[0]["g"] and not got[0]["v"]
    assert got[1]["r"] is None and got[1]["o"] == -5 and got[1]["m"] == ["image/png"] and not got[1]["g"]
    assert got[2]["r"] is None and got[2]["v"]


@given(st.binary(min_size=20, max_size=20))
def test_base32_round_trip(raw):
    assert values.base32_decode(values.base32_encode(raw)) == raw
