"""Field filters and named filters as predicates."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capweave.functions import urls, values
from capweave.schema import field

_FIELD_FILTER = re.compile(r"(!~|!=|=|~|!)?([^:]+):(.*)", re.S)
_NAME = re.compile(r"[a-z][a-z0-9_]*")
VOCABULARY_VERSION = 1

# fixed values of the named filters
TEXT_MIMES = (
    "text/plain", "text/html", "text/xml", "application/xml", "application/xhtml+xml", "application/rss+xml", "application/atom+xml",
    "application/rdf+xml", "text/markdown", "text/x-markdown", "text/x-web-markdown",
)
XML_MIMES = ("text/xml", "application/xml")
ASSET_MIMES = (
    "application/javascript", "application/ecmascript", "application/font-woff", "application/font-woff2", "application/pdf", "application/vnd.ms-fontobject",
    "application/x-font-ttf", "application/x-javascript", "image/svg+xml", "text/css", "text/javascript", "text/ecmascript",
)
ASSET_MIME_PREFIXES = ("audio/", "font/", "image/", "video/")
ASSET_EXTENSIONS = (
    ".7z", ".avi", ".avif", ".bmp", ".br", ".css", ".eot", ".gif", ".gz", ".ico", ".jpeg", ".jpg", ".js", ".json", ".map", ".mjs", ".mov", ".mp3",
    ".mp4", ".otf", ".pdf", ".png", ".rar", ".svg", ".tar", ".tgz", ".ttf", ".wasm", ".webm", ".webp", ".woff", ".woff2", ".zip",
)
METADATA_BASENAMES = ("ads.txt", "app-ads.txt", "browserconfig.xml", "humans.txt", "manifest.json", "opensearch.xml", "robots.txt", "security.txt", "site.webmanifest")


def _text(df: DataFrame, name: str) -> Column:
    """A field's value; a missing one is the empty string."""
    return F.coalesce(field(df, name).cast("string"), F.lit(""))


@dataclass(frozen=True)
class FieldFilter:
    """field, modifier ('' contains, '=' equals, '~' regular expression, each with '!'; 'in' a list) and operand."""

    field: str
    modifier: str
    operand: object

    @classmethod
    def parse(cls, text: str) -> FieldFilter:
        m = _FIELD_FILTER.fullmatch(text)
        if not m:
            raise ValueError(f"invalid filter: {text!r}")
        if (m[1] or "") in ("~", "!~"):
            re.compile(m[3])
        return cls(m[2], m[1] or "", m[3])

    def predicate(self, df: DataFrame) -> Column:
        value = _text(df, self.field)
        if self.modifier == "in":
            return value.isin(list(self.operand))
        positive = {"": value.contains(self.operand), "=": value == self.operand, "~": value.rlike(f"(?m){self.operand}")}[self.modifier.removeprefix("!")]
        return ~positive if self.modifier.startswith("!") else positive

    def signature(self) -> list:
        return ["field", self.field, self.modifier, sorted(self.operand) if self.modifier == "in" else self.operand]


def from_mapping(filters: Mapping) -> list[FieldFilter]:
    """{field: value | compiled pattern | list of values}."""
    out = []
    for name, want in filters.items():
        if isinstance(want, re.Pattern):
            flags = "".join(f for f, bit in (("i", re.I), ("s", re.S), ("x", re.X)) if want.flags & bit)
            out.append(FieldFilter(name, "~", f"(?{flags})" * bool(flags) + want.pattern))
        elif isinstance(want, (list, tuple, set, frozenset)):
            out.append(FieldFilter(name, "in", tuple(str(x) for x in want)))
        else:
            out.append(FieldFilter(name, "=", str(want)))
    return out


@dataclass(frozen=True)
class Named:
    """A named filter and whether it must hold."""

    name: str
    positive: bool = True

    @property
    def stable_name(self) -> str:
        return self.name if self.positive else f"-{self.name}"

    def signature(self) -> list:
        return ["named", VOCABULARY_VERSION, self.stable_name]


def named(name: str, positive: bool = True) -> Named:
    return Named(name, positive)


def _mimes(df: DataFrame) -> Column:
    return values.mime_types(field(df, "mime"), field(df, "mime_detected"))


def status_200(df: DataFrame) -> Column:
    return _text(df, "status") == "200"


def html(df: DataFrame) -> Column:
    return F.array_contains(_mimes(df), "text/html")


def text_like(df: DataFrame) -> Column:
    return F.arrays_overlap(_mimes(df), F.array(*map(F.lit, TEXT_MIMES)))


def asset_like(df: DataFrame) -> Column:
    is_asset = lambda m: reduce(lambda a, b: a | b, (m.startswith(p) for p in ASSET_MIME_PREFIXES), m.isin(*ASSET_MIMES))
    extension = urls.path_extension(urls.url_path(field(df, "url")))
    return F.exists(_mimes(df), is_asset) | extension.isin(*ASSET_EXTENSIONS)


def site_metadata(df: DataFrame) -> Column:
    path = urls.url_path(field(df, "url"))
    base = F.lower(urls.path_basename(path))
    xml = F.exists(_mimes(df), lambda m: m.isin(*XML_MIMES) | m.endswith("+xml"))
    sitemap = base.contains("sitemap") & (base.rlike(r"\.xml(?:\.gz)?$") | xml)
    return base.isin(*METADATA_BASENAMES) | sitemap | F.lower(path).startswith("/.well-known/")


def warc(df: DataFrame) -> Column:
    return _text(df, "filename").contains("/warc/")


def extractable_text(df: DataFrame) -> Column:
    return status_200(df) & warc(df) & text_like(df) & ~asset_like(df) & ~site_metadata(df)


REGISTRY: dict[str, Callable[[DataFrame], Column]] = {f.__name__: f for f in (status_200, html, text_like, asset_like, site_metadata, warc, extractable_text)}


def _check_name(name: str, registry: Mapping) -> None:
    if not _NAME.fullmatch(name) or name not in registry:
        raise ValueError(f"unknown filter {name!r}; there are {', '.join(sorted(registry))}")


def parse_expression(expression: str, registry: Mapping = REGISTRY) -> list[Named]:
    """'+name,-name,name'; blanks are dropped."""
    out = []
    for term in (t.strip() for t in expression.split(",")):
        if term:
            name = term[1:] if term[0] in "+-" else term
            if not name:
                raise ValueError(f"empty term in {expression!r}")
            _check_name(name, registry)
            out.append(Named(name, term[0] != "-"))
    return out


class FilterSet:
    """Filters of mixed kinds, all of which must hold.

    A string is a field filter; Named (or named()) a named filter; a mapping field filters by value; a callable takes
    the DataFrame and returns a Column (a Python UDF inside it works, slowly).
    """

    def __init__(self, filters=None, registry: Mapping | None = None) -> None:
        self.registry = dict(REGISTRY) | dict(registry or {})
        items = [] if filters is None else list(filters) if isinstance(filters, (list, tuple)) else [filters]
        self.items: list = []
        for x in items:
            if x is None:
                continue
            if isinstance(x, str):
                self.items.append(FieldFilter.parse(x))
            elif isinstance(x, Mapping):
                self.items += from_mapping(x)
            elif isinstance(x, (FieldFilter, Named)):
                self.items.append(x)
            elif callable(x):
                self.items.append(x)
            else:
                raise ValueError(f"unsupported filter: {x!r}")
        for x in self.items:
            if isinstance(x, Named):
                _check_name(x.name, self.registry)

    def predicate(self, df: DataFrame) -> Column:
        parts = []
        for x in self.items:
            if isinstance(x, Named):
                hit = self.registry[x.name](df)
                parts.append(hit if x.positive else ~hit)
            else:
                parts.append(x.predicate(df) if isinstance(x, FieldFilter) else x(df))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    @property
    def stable(self) -> bool:
        return all(isinstance(x, (FieldFilter, Named)) for x in self.items)

    def signature(self, given=None) -> list:
        """What identifies the filters from one run to the next; callables need a given signature."""
        if not self.stable and given is None:
            raise ValueError("a callable filter needs an explicit filter_signature")
        return [x.signature() if isinstance(x, (FieldFilter, Named)) else ["given", given] for x in self.items]


def split_cli_filters(text: str) -> list:
    """One --filter argument: a list of named terms, one field filter, or both by commas if the first part is a named term."""
    first = text.split(",", 1)[0].strip()
    is_named = lambda t: (t[1:] if t[:1] in "+-" else t) in REGISTRY
    if "," in text and ":" in text and is_named(first):
        return [x for part in text.split(",") for x in split_cli_filters(part.strip())]
    return [FieldFilter.parse(text)] if ":" in text else parse_expression(text)
