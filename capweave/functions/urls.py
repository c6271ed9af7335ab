"""URLs and keys as Column expressions, with the same rules for literal patterns on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
_BLANK = r"[\s\x00]"
#: before the host: blanks, a wildcard, a scheme if there is one, user and password
_LEAD = rf"^{_BLANK}*(?:\*\.)?(?:[A-Za-z][A-Za-z0-9+.\-]*://)?"
_HOST = _LEAD + r"(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]*)"
#: path and query, up to a fragment or one final wildcard
_REST = _LEAD + rf"[^/?#]*([^#]*?)(?:#[\s\S]*|\*?{_BLANK}*)$"
_NAMED_SCHEME = rf"^{_BLANK}*(?:\*\.)?([A-Za-z][A-Za-z0-9+.\-]*)://"
_PLAIN = r"[!#$&-;=?-\[\]_a-z~]*+"
#: what may be a URI: no blanks inside, ASCII, no odd signs, no bare percent
_VALID = rf"^{_BLANK}*{_PLAIN}(?:%[0-9A-Fa-f]{{2}}{_PLAIN})*+{_BLANK}*$"
_INVALID = r"[^!-~]|[\"<>\\^`{|}]|%(?![0-9A-Fa-f]{2})"
CRAWL_PATH = r"(^|/)(crawl-data|cc-index/collections)/CC-MAIN-\d{4}-\d{2}(/|$)"
_FILENAME = r"^crawl-data/([^/]+)/segments/([^/]+)/(warc|robotstxt|crawldiagnostics)/(.+)-(\d{5})\.warc\.gz$"


def _extract(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group)


def canonical_host(host: Column) -> Column:
    """Lower case, without one final dot and without a leading www."""
    return F.regexp_replace(F.lower(host), r"^www\.(?=.)|\.$", "")


def host_to_surt(host: Column) -> Column:
    """Labels of the canonical host from the top down, joined by commas."""
    return F.array_join(F.reverse(F.split(canonical_host(host), r"[.]", -1)), ",")


def valid(url: Column) -> Column:
    return url.rlike(_VALID)


def url_scheme(url: Column) -> Column:
    """The scheme that the text itself names, lower-cased, else empty."""
    return F.lower(_extract(url, _NAMED_SCHEME))


def url_host(url: Column) -> Column:
    """The canonical host; null where the text is no URL, which then matches nothing."""
    return F.when(valid(url), canonical_host(_extract(url, _HOST)))


def url_path_query(url: Column) -> Column:
    """Path (at least /) and query, without fragment; null where the text is no URL. A leading / is put before a bare query."""
    return F.when(valid(url), F.regexp_replace(_extract(url, _REST), r"^(?!/)", "/"))


def surt(url: Column) -> Column:
    """The key of a URL: reversed host, a closing parenthesis, path and query."""
    return F.concat(host_to_surt(url_host(url)), F.lit(")"), url_path_query(url))


def url_path(url: Column) -> Column:
    """The path alone, possibly empty; of what is no URI, the text before a query or fragment."""
    text = F.coalesce(url, F.lit(""))
    path = _extract(text, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)")
    return F.when(text.rlike(rf"^{_PLAIN}(?:%[0-9A-Fa-f]{{2}}{_PLAIN})*+$"), path).otherwise(_extract(text, r"^([^?#]*)"))


def path_basename(path: Column) -> Column:
    """The last part of a path, final slashes ignored."""
    return F.when(path.rlike("^/+$"), F.lit("/")).otherwise(_extract(path, r"([^/]+)/*$"))


def path_extension(path: Column) -> Column:
    """The extension with its dot, lower-cased; names that begin with a dot have none of their own."""
    return F.lower(_extract(path_basename(path), r"^\.*[^.].*?(\.[^.]*)$"))


def warc_url(filename: Column, base_url: str = "https://data.commoncrawl.org") -> Column:
    return F.concat(F.lit(base_url.rstrip("/") + "/"), F.regexp_replace(filename, r"^/+", ""))


def is_crawl_path(path: Column) -> Column:
    return F.coalesce(path.rlike(CRAWL_PATH), F.lit(False))


def filename_parts(filename: Column) -> Column:
    """struct(crawl, segment, kind, pair, number) of a WARC file name; nulls where it has another form, kind fallback."""
    fits = filename.rlike(_FILENAME)
    part = lambda i: F.when(fits, _extract(filename, _FILENAME, i))
    return F.struct(part(1).alias("crawl"), part(2).alias("segment"), F.when(fits, part(3)).otherwise("fallback").alias("kind"), part(4).alias("pair"), part(5).alias("number"))


def key_host(urlkey: Column) -> Column:
    """The host that a key stands for, else null."""
    host = F.array_join(F.reverse(F.split(_extract(urlkey, r"^([^)]+)\)"), ",", -1)), ".")
    return F.when(urlkey.rlike(r"^[^)]+\)"), canonical_host(host))


def key_path(urlkey: Column) -> Column:
    """The path that a key stands for, without query."""
    path = _extract(urlkey, r"^[^)]+\)([^?#]*)")
    return F.when(urlkey.rlike(r"^[^)]+\)"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


@dataclass(frozen=True)
class Url:
    """A literal pattern's parts, by the rules of the expressions above."""

    scheme: str | None
    host: str
    path: str

    @property
    def surt(self) -> str:
        return f"{surt_host(self.host)}){self.path}"


def literal_host(host: str) -> str:
    return re.sub(r"^www\.", "", re.sub(r"\.$", "", host.lower()))


def surt_host(host: str) -> str:
    return ",".join(reversed(literal_host(host).split(".")))


def parse_literal(text: str) -> Url:
    text = re.sub(r"\*$", "", re.sub(r"^\*\.", "", text.strip()))
    if re.search(_INVALID, text):
        host, slash, rest = text.partition("/")
        return Url(None, literal_host(host), f"/{rest}" if slash else "/")
    scheme, rest = re.match(_NAMED_SCHEME, text), re.match(_REST, text)[1]
    return Url(scheme[1].lower() if scheme else None, literal_host(re.match(_HOST, text)[1]), rest if rest.startswith("/") else f"/{rest}")


def prefix_successor(prefix: str) -> str | None:
    """The least string over all that begin with the prefix, in code-point order; null if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        point = ord(prefix[i])
        if point < 0x10FFFF:
            point = 0xE000 if point == 0xD7FF else point + 1
            return prefix[:i] + chr(point)
    return None
