"""Timestamps, numbers and small field views as Column expressions."""

from __future__ import annotations

import calendar
import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the pads of short timestamps
LOW, HIGH = "19780101000000", "29991231235959"


def normalize_timestamp(value, high: bool = False) -> str | None:
    """A literal of 1 to 14 digits as 14 digits; the high pad of a month ends on its last day."""
    if value is None:
        return None
    text = str(value)
    if not re.fullmatch(r"[0-9]{1,14}", text):
        raise ValueError(f"invalid timestamp: {value!r}")
    if not high:
        return text + LOW[len(text) :]
    padded = text + HIGH[len(text) :]
    if len(text) > 6:
        return padded
    year, month = int(padded[:4]), int(padded[4:6])
    if not 1 <= month <= 12:
        raise ValueError(f"invalid timestamp: {value!r}")
    return f"{padded[:6]}{calendar.monthrange(max(year, 1), month)[1]:02d}{padded[8:]}"


def pad_low(t: Column) -> Column:
    """14 digits; null for what is no timestamp."""
    return F.when(t.rlike("^[0-9]{1,14}$"), F.concat(t, F.substring(F.lit(LOW), F.length(t) + 1, F.lit(14))))


def pad_high(t: Column) -> Column:
    padded = F.concat(t, F.substring(F.lit(HIGH), F.length(t) + 1, F.lit(14)))
    month_end = F.date_format(F.last_day(F.try_to_date(F.concat(F.substring(padded, 1, 6), F.lit("01")), "yyyyMMdd")), "dd")
    short = F.concat(F.substring(padded, 1, 6), month_end, F.substring(padded, 9, 6))
    return F.when(t.rlike("^[0-9]{1,14}$"), F.when(F.length(t) > 6, padded).otherwise(short))


def instant(t: Column) -> Column:
    """The moment (UTC session) of a timestamp; null for what is none."""
    return F.try_to_timestamp(pad_low(t), F.lit("yyyyMMddHHmmss"))


def in_range(t: Column, low: str | None = None, high: str | None = None) -> Column:
    """Inclusive comparison of padded strings; without bounds everything is in range, with one null is not."""
    out = F.lit(True)
    if low is not None:
        out = out & (pad_low(t) >= F.lit(normalize_timestamp(low)))
    if high is not None:
        out = out & (pad_low(t) <= F.lit(normalize_timestamp(high, high=True)))
    return F.coalesce(out, F.lit(False))


def whole_number(c: Column) -> Column:
    """A decimal integer as a long; null for anything else."""
    return F.when(c.rlike(r"^-?[0-9]+$"), c.try_cast("bigint"))


def byte_range(offset: Column, length: Column) -> Column:
    """struct(start, end), both inclusive; null if either is no number."""
    a, n = whole_number(offset), whole_number(length)
    return F.when(a.isNotNull() & n.isNotNull(), F.struct(a.alias("start"), (a + n - 1).alias("end")))


def is_revisit(mime: Column, status: Column) -> Column:
    return F.coalesce(mime == "warc/revisit", F.lit(False)) | F.coalesce(status == "-", F.lit(False))


def mime_types(mime: Column, detected: Column) -> Column:
    """The media types of both fields, without parameters, lower-cased, none empty."""
    short = lambda x: F.lower(F.regexp_replace(F.substring_index(x, ";", 1), r"^\s+|\s+$", ""))
    return F.filter(F.array(short(mime), short(detected)), lambda x: x.isNotNull() & (x != ""))


def is_canonical_digest(digest: Column) -> Column:
    """32 base-32 characters: 160 bits exactly, so no spare ones."""
    return digest.rlike("^[A-Z2-7]{32}$")


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_encode(raw: bytes) -> str:
    import base64

    return base64.b32encode(raw).decode().rstrip("=")


def base32_decode(text: str) -> bytes:
    import base64

    if not re.fullmatch(r"[A-Z2-7]*", text):
        raise ValueError(f"not canonical base 32: {text!r}")
    raw = base64.b32decode(text + "=" * (-len(text) % 8))
    if base32_encode(raw) != text:
        raise ValueError(f"not canonical base 32: {text!r}")
    return raw


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest_of(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()
