"""Orders, limits, projection and collapse of capture rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capweave.functions import values
from capweave.schema import UnsupportedCollapse, field, field_names, has_field, native_columns

SORTS = ("timestamp", "reverse_timestamp")


def whole(value, what: str, least: int = 0) -> int | None:
    """An option given as a number or decimal string."""
    if value is None:
        return None
    if isinstance(value, bool) or not re.fullmatch(r"[0-9]+", str(value)) or int(value) < least:
        raise ValueError(f"{what} must be {'a positive' if least else 'a non-negative'} integer")
    return int(value)


def native_order(df: DataFrame, descending: bool = False) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in native_columns(df)]


def closest_distance(df: DataFrame, target: str) -> Column:
    """Seconds between a row's timestamp and the target, both padded low, in UTC."""
    at = F.try_to_timestamp(F.lit(values.normalize_timestamp(target)), F.lit("yyyyMMddHHmmss"))
    return F.abs(F.unix_timestamp(values.instant(field(df, "timestamp"))) - F.unix_timestamp(at))


def ordered(df: DataFrame, sort: str | None = None, closest: str | None = None) -> DataFrame:
    """A total order: closest wins over sort, ties go to the native order (reversed with a reverse sort)."""
    t = F.coalesce(field(df, "timestamp"), F.lit(""))
    if closest is not None:
        return df.orderBy(closest_distance(df, closest).asc_nulls_last(), t, *native_order(df))
    if sort is None:
        return df.orderBy(*native_order(df)) if native_columns(df) else df
    if sort not in SORTS:
        raise ValueError(f"unsupported sort: {sort!r}")
    return df.orderBy(t, *native_order(df)) if sort == "timestamp" else df.orderBy(t.desc(), *native_order(df, descending=True))


def project(df: DataFrame, fields) -> DataFrame:
    """An ordered subset; fields that the rows can't have are dropped."""
    if fields is None:
        return df
    names = list(dict.fromkeys(n for n in field_names(fields) if has_field(df, n)))
    return df.select(*[field(df, n).alias(n) for n in names])


def check_collapse(collapse, collapse_order=None, sort=None, closest=None) -> bool:
    """Whether to collapse; the options must go together."""
    if collapse is None:
        if collapse_order is not None:
            raise UnsupportedCollapse("collapse_order needs collapse")
        return False
    if collapse != "urlkey" or collapse_order not in (None, "latest"):
        raise UnsupportedCollapse(f"unsupported collapse: {collapse!r}, {collapse_order!r}")
    if sort is not None or closest is not None:
        raise UnsupportedCollapse("collapse can't be combined with sort or closest")
    return True


def latest_per_key(df: DataFrame) -> DataFrame:
    """One row a key: the greatest timestamp, of equals the later row. Rank-1 windows are cut before their shuffle."""
    key = F.coalesce(field(df, "urlkey"), F.lit(""))
    best = Window.partitionBy(key).orderBy(F.coalesce(field(df, "timestamp"), F.lit("")).desc(), *native_order(df, descending=True))
    return df.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")
