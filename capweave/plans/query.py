"""The capture query: predicates, then collapse or order, then limit, then projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capweave.functions import values
from capweave.operators.filters import FilterSet
from capweave.operators.match import UrlPattern
from capweave.operators.order import check_collapse, latest_per_key, ordered, project, whole
from capweave.schema import UnsupportedCollapse, field


def selected(df: DataFrame, url: str | None = None, match: str | None = None, from_=None, to=None, filters=None, registry=None, use_key_ranges: bool = False, strict: bool = False) -> DataFrame:
    """The rows that all predicates accept. strict: a malformed timestamp is an error, not a row out of range."""
    chosen = filters if isinstance(filters, FilterSet) else FilterSet(filters, registry)
    keep = chosen.predicate(df)
    if url is not None:
        keep = UrlPattern.of(url, match).predicate(df, use_key_ranges) & keep
    t = field(df, "timestamp")
    if from_ is not None or to is not None:
        keep = values.in_range(t, from_, to) & keep
    if strict:
        bad = t.isNotNull() & ~t.rlike("^[0-9]{1,14}$")
        keep = F.when(bad, F.raise_error(F.concat(F.lit("invalid timestamp: "), t)).cast("boolean")).otherwise(keep)
    return df.where(keep)


def captures(df: DataFrame, url: str | None = None, *, match: str | None = None, from_=None, to=None, filters=None, registry=None, fields=None, closest=None, sort: str | None = None, limit=None,
             collapse: str | None = None, collapse_order: str | None = None, page_size=None, cursor=None, filter_signature=None, use_key_ranges: bool = False, strict: bool = False, packed: bool = True, page_parts=None):
    """Rows of a capture relation, lazily; with page_size one page (see pages.page). All options are checked at once.

    packed=False says that the rows come from text, where collapse and pages were never offered.
    """
    if page_size is not None:
        from capweave.operators import pages

        return pages.page(df, url, match=match, from_=from_, to=to, filters=filters, registry=registry, fields=fields, closest=closest, sort=sort, limit=limit, collapse=collapse, collapse_order=collapse_order,
                          page_size=page_size, cursor=cursor, filter_signature=filter_signature, packed=packed, use_key_ranges=use_key_ranges, parts=page_parts)
    if cursor is not None:
        raise ValueError("cursor requires page_size")
    if filter_signature is not None:
        raise ValueError("filter_signature requires page_size")
    n = whole(limit, "limit")
    grouped = check_collapse(collapse, collapse_order, sort, closest)
    if grouped and not packed:
        raise UnsupportedCollapse("collapse is for packed indexes")
    rows = selected(df, url, match, from_, to, filters, registry, use_key_ranges, strict)
    if grouped:
        rows = latest_per_key(rows)
        if n is not None:
            rows = rows.orderBy(F.coalesce(field(rows, "urlkey"), F.lit("")))
    elif closest is not None or sort is not None or n is not None:
        rows = ordered(rows, sort, closest)
    return project(rows if n is None else rows.limit(n), fields)


def count(df: DataFrame, url: str | None = None, *, collapse: str | None = None, collapse_order: str | None = None, **options) -> DataFrame:
    """One row, captures: how many rows match, or how many keys with collapse; limit, order and fields play no part."""
    for name in ("limit", "sort", "closest", "fields"):
        options.pop(name, None)
    rows = selected(df, url, **options)
    if check_collapse(collapse, collapse_order):
        return rows.agg(F.count_distinct(F.coalesce(field(rows, "urlkey"), F.lit(""))).alias("captures"))
    return rows.agg(F.count("*").alias("captures"))
