"""Pages by keyset position, with durable cursors.

A cursor holds the position of the first row not yet returned, and digests of the index and the query it belongs to.
Its checksum shows damage; it is no proof of who wrote it.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass, field as data_field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from capweave.functions import values
from capweave.operators.filters import FilterSet
from capweave.operators.match import UrlPattern
from capweave.operators.order import check_collapse, latest_per_key, project, whole
from capweave.schema import InvalidCursor, UnsupportedPageQuery, field, native_columns

PREFIX, VERSION = "cwcur1_", 1


@dataclass(frozen=True)
class CapturePage:
    """The rows of a page; no next cursor means that nothing is left."""

    rows: tuple[Row, ...]
    next_cursor: str | None = None

    def __iter__(self):
        return iter(self.rows)

    def __len__(self) -> int:
        return len(self.rows)

    @property
    def exhausted(self) -> bool:
        return self.next_cursor is None


@dataclass(frozen=True)
class Parts:
    """An index of several stores, whose native order is store by store: a page needs those from its position on, until it is full."""

    n: int
    rows: Callable[[int, int], DataFrame]
    signature: list


@dataclass(frozen=True)
class Cursor:
    index: str
    query: str
    position: list = data_field(default_factory=list)

    def encode(self) -> str:
        payload = {"version": VERSION, "index": self.index, "query": self.query, "position": self.position}
        body = {"payload": payload, "sha256": values.digest_of(payload)}
        return PREFIX + base64.urlsafe_b64encode(values.canonical_json(body).encode()).decode().rstrip("=")

    @classmethod
    def decode(cls, token: str) -> Cursor:
        if not isinstance(token, str) or not token.startswith(PREFIX):
            raise InvalidCursor("malformed cursor")
        try:
            raw = token.removeprefix(PREFIX)
            body = json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)))
            payload, checksum = body["payload"], body["sha256"]
        except (ValueError, KeyError, TypeError) as error:
            raise InvalidCursor("malformed cursor") from error
        if values.digest_of(payload) != checksum:
            raise InvalidCursor("cursor checksum mismatch")
        if not isinstance(payload, dict) or payload.get("version") != VERSION:
            raise InvalidCursor("unsupported cursor version")
        if not isinstance(payload.get("position"), list) or not payload["position"]:
            raise InvalidCursor("malformed cursor position")
        return cls(payload["index"], payload["query"], payload["position"])


def index_digest(df: DataFrame, signature=None) -> str:
    """What the rows come from: a given signature, else the names and lengths of the input files."""
    if signature is not None:
        return values.digest_of(signature)
    spark = df.sparkSession
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = []
    for f in sorted(df.inputFiles()):
        p = path(f)
        files.append([f, p.getFileSystem(conf).getFileStatus(p).getLen()])
    return values.digest_of(files)


def query_digest(url, pattern: UrlPattern | None, from_, to, filters: FilterSet, given, grouped: bool) -> str:
    return values.digest_of({
        "url": url, "match": pattern and pattern.mode, "from": values.normalize_timestamp(from_), "to": values.normalize_timestamp(to, high=True),
        "filters": filters.signature(given), "collapse": ["urlkey", "latest"] if grouped else None,
    })


def at_or_after(columns: list[Column], position: list) -> Column:
    """Row-wise comparison with a position, most significant column first; the first column alone also prunes."""
    out = F.lit(True)
    for c, p in reversed(list(zip(columns, position, strict=True))):
        out = (c > F.lit(p)) | ((c == F.lit(p)) & out)
    return (columns[0] >= F.lit(position[0])) & out


def page(df: DataFrame, url: str | None = None, *, match=None, from_=None, to=None, filters=None, registry=None, fields=None, closest=None, sort=None, limit=None, collapse=None, collapse_order=None,
         page_size=None, cursor: str | None = None, filter_signature=None, packed: bool = True, index_signature=None, order: list[str] | None = None, use_key_ranges: bool = False, parts: Parts | None = None) -> CapturePage:
    """One page. order: the columns of the keyset, together unique (default: the native order; a collapsed page goes by key)."""
    from capweave.plans.query import selected

    if limit is not None:
        raise ValueError("choose limit or page_size, not both")
    if sort is not None or closest is not None:
        raise UnsupportedPageQuery("pages follow the native order only")
    if not packed:
        raise UnsupportedPageQuery("pages are for packed indexes")
    size = whole(page_size, "page_size", 1)
    grouped = check_collapse(collapse, collapse_order)
    pattern = UrlPattern.of(url, match) if url is not None else None
    chosen = FilterSet(filters, registry)
    given = index_signature if index_signature is not None or parts is None else parts.signature
    query, index = query_digest(url, pattern, from_, to, chosen, filter_signature, grouped), index_digest(df, given)
    names = ["urlkey"] if grouped else order or native_columns(df)
    if not names:
        raise UnsupportedPageQuery("pages need columns that order the rows")
    keys, position = [f"_pos{i}" for i in range(len(names))], None
    if cursor is not None:
        had = Cursor.decode(cursor)
        if had.index != index:
            raise InvalidCursor("the cursor belongs to another index")
        if had.query != query:
            raise InvalidCursor("the cursor belongs to another query")
        if len(had.position) != len(keys):
            raise InvalidCursor("malformed cursor position")
        position = had.position

    def found(df: DataFrame, most: int) -> list[Row]:
        rows = selected(df, url, match, from_, to, chosen, use_key_ranges=use_key_ranges)
        at = [F.coalesce(field(rows, "urlkey"), F.lit(""))] if grouped else [F.col(c) for c in names]
        if grouped and position and position[0]:
            rows = rows.where(field(rows, "urlkey") >= position[0])  # reaches the scan
        rows = rows.withColumns(dict(zip(keys, at)))
        if position is not None:
            rows = rows.where(at_or_after([F.col(k) for k in keys], position))
        if grouped:
            rows = latest_per_key(rows)
        shown = project(rows.drop(*keys), fields).columns
        out = rows.select(*keys, F.struct(*[field(rows, c).alias(c) if c not in rows.columns else F.col(c) for c in shown]).alias("_row"))
        return out.orderBy(*keys).limit(most).collect()

    if parts is None or grouped or names[0] != "store_ord":
        got = found(df, size + 1)  # a page and one more
    else:
        got, at, step = [], position[0] if position else 0, 1
        while at < parts.n and len(got) <= size:
            got += found(parts.rows(at, at + step), size + 1 - len(got))
            at, step = at + step, 2 * step
    following = Cursor(index, query, [got[size][k] for k in keys]).encode() if len(got) > size else None
    return CapturePage(tuple(r["_row"] for r in got[:size]), following)
