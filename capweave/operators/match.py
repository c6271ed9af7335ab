"""URL patterns as predicates over capture rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capweave.functions import urls
from capweave.schema import field

MODES = ("exact", "prefix", "host", "domain")


@dataclass(frozen=True)
class UrlPattern:
    """A pattern and its mode: *.x is a domain, x* a prefix, anything else exact, unless a mode is given."""

    text: str
    mode: str

    @classmethod
    def of(cls, text: str, match: str | None = None) -> UrlPattern:
        mode = match or ("domain" if text.startswith("*.") else "prefix" if text.endswith("*") else "exact")
        if mode not in MODES:
            raise ValueError(f"unsupported match: {mode!r}")
        return cls(text, mode)

    @property
    def url(self) -> urls.Url:
        return urls.parse_literal(self.text)

    def key_ranges(self) -> list[tuple[str, str | None]]:
        """Half-open ranges of stored keys that matching rows of a consistent index have."""
        host, key = urls.surt_host(self.url.host), self.url.surt
        starts = {"domain": [f"{host})", f"{host},"], "host": [f"{host})"], "prefix": [key]}.get(self.mode)
        if starts is None:
            return [(key, f"{key} ")]
        return [(s, urls.prefix_successor(s)) for s in starts]

    def on_url(self, url: Column) -> Column:
        want, host, path = self.url, urls.url_host(url), urls.url_path_query(url)
        hit = {
            "exact": lambda: (host == want.host) & (path == want.path),
            "prefix": lambda: (host == want.host) & path.startswith(want.path),
            "host": lambda: host == want.host,
            "domain": lambda: F.concat(F.lit("."), host).endswith(f".{want.host}"),
        }[self.mode]()
        if want.scheme:
            hit = (urls.url_scheme(url) == want.scheme) & hit
        return F.coalesce(hit, F.lit(False))

    def on_key(self, urlkey: Column) -> Column:
        host, key = urls.surt_host(self.url.host), self.url.surt
        hit = {
            "exact": lambda: urlkey == key,
            "prefix": lambda: urlkey.startswith(key),
            "host": lambda: urlkey.startswith(f"{host})"),
            "domain": lambda: urlkey.startswith(f"{host})") | urlkey.startswith(f"{host},"),
        }[self.mode]()
        return F.coalesce(hit, F.lit(False))

    def in_key_ranges(self, urlkey: Column) -> Column:
        """Plain comparisons, which reach the Parquet scan."""
        out = F.lit(False)
        for low, high in self.key_ranges():
            out = out | ((urlkey >= low) & (urlkey < high) if high is not None else urlkey >= low)
        return out

    def predicate(self, df: DataFrame, use_key_ranges: bool = False) -> Column:
        """Rows match by URL; rows without one by key. Key ranges, if the caller trusts the stored keys, only narrow that."""
        url, urlkey = field(df, "url"), field(df, "urlkey")
        hit = F.when(url.isNotNull(), self.on_url(url)).otherwise(self.on_key(urlkey))
        return self.in_key_ranges(urlkey) & hit if use_key_ranges else hit
