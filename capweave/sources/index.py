"""Opening an index: one relation over files of one kind."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as data_field

from pyspark.sql import DataFrame, SparkSession

from capweave.operators.match import UrlPattern
from capweave.plans import query
from capweave.sources import packed, zipnum
from capweave.sources.files import expand
from capweave.sources.text import read_text


@dataclass
class Index:
    """Files as one capture relation, in sorted path order."""

    spark: SparkSession
    paths: list[str]
    kind: str
    parser: Callable[[DataFrame], DataFrame] | None = None
    strict: bool = True
    line_numbers: bool = True
    trust_keys: bool = False  # use stored keys to skip files and blocks
    options: dict = data_field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, *paths: str, **options) -> Index:
        kind, found = expand(spark, *paths)
        return cls(spark, found, kind, **options)

    def rows(self, pattern: UrlPattern | None = None) -> DataFrame:
        if self.kind == "packed":
            return self.stores(pattern, 0, len(self.paths))
        whole = lambda paths: read_text(self.spark, paths, self.parser, self.strict, self.line_numbers)
        if self.trust_keys and pattern is not None and self.parser is None:
            return zipnum.pruned(self.spark, self.paths, pattern, whole)
        return whole(self.paths)

    def stores(self, pattern: UrlPattern | None, start: int, end: int) -> DataFrame:
        return packed.read_packed(self.spark, self.paths[start:end], pattern if self.trust_keys else None, start)

    def captures(self, url: str | None = None, **options):
        pattern = UrlPattern.of(url, options.get("match")) if url is not None else None
        if self.kind == "packed" and options.get("page_size") is not None:
            from capweave.operators import pages

            options["page_parts"] = pages.Parts(len(self.paths), lambda a, b: self.stores(pattern, a, b), packed.signature(self.spark, self.paths))
        return query.captures(self.rows(pattern), url, use_key_ranges=self.trust_keys, packed=self.kind == "packed", **options)

    def count(self, url: str | None = None, **options) -> DataFrame:
        pattern = UrlPattern.of(url, options.get("match")) if url is not None else None
        return query.count(self.rows(pattern), url, use_key_ranges=self.trust_keys, **options)
