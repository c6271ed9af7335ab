"""HTTP range requests from captures."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capweave.functions import urls, values
from capweave.plans.query import captures
from capweave.schema import UnrequestableCapture, field

CRAWL_BASE_URL = "https://data.commoncrawl.org"


def base_url(text: str) -> str:
    """An absolute http(s) URL without query and fragment, final slashes dropped."""
    u = urlsplit(str(text))
    if u.scheme not in ("http", "https") or not u.hostname or re.search(r"\s", str(text)):
        raise ValueError("base_url must be an absolute http or https URL")
    if u.query or u.fragment or "?" in text or "#" in text:
        raise ValueError("base_url must not include a query string or fragment")
    return str(text).rstrip("/")


def missing_fields(df: DataFrame) -> Column:
    """Names of the fields that a request lacks, in order."""
    offset, length = values.whole_number(field(df, "offset")), values.whole_number(field(df, "length"))
    lacks = [
        F.when(F.coalesce(field(df, "filename"), F.lit("")) == "", F.lit("filename")),
        F.when(~F.coalesce(offset >= 0, F.lit(False)), F.lit("offset")),
        F.when(~F.coalesce(length > 0, F.lit(False)), F.lit("length")),
    ]
    return F.filter(F.array(*lacks), lambda x: x.isNotNull())


def with_range_request(df: DataFrame, base: str | None = None, on_missing: str = "raise", index_paths=()) -> DataFrame:
    """df with a struct column `request`. base: given, else of a public crawl if the index's paths or a row's file look like one."""
    if on_missing not in ("raise", "skip"):
        raise ValueError(f"unsupported on_missing: {on_missing!r}")
    if base is None and any(re.search(urls.CRAWL_PATH, p) for p in index_paths):
        base = CRAWL_BASE_URL
    fixed = base_url(base) if base is not None else None
    filename = field(df, "filename")
    root = F.lit(fixed) if fixed is not None else F.when(urls.is_crawl_path(filename), F.lit(CRAWL_BASE_URL))
    origin = F.regexp_extract(root, r"^([A-Za-z]+://[^/]*)", 1)
    below = F.regexp_replace(F.regexp_replace(F.substring(root, F.length(origin) + 1, F.length(root)), r"^/+", ""), r"/+$", "")
    path = F.concat(F.lit("/"), F.when(below == "", "").otherwise(F.concat(below, F.lit("/"))), F.regexp_replace(F.regexp_replace(filename, r"^/+", ""), r"/+$", ""))
    scheme = F.lower(F.regexp_extract(root, r"^([A-Za-z]+)://", 1))
    host = F.regexp_extract(root, r"^[A-Za-z]+://(?:[^/@]*@)?(\[[^\]]*\]|[^/:]*)", 1)
    port = F.regexp_extract(root, r"^[A-Za-z]+://[^/]*:(\d+)(?:/|$)", 1)
    offset, length = values.whole_number(field(df, "offset")), values.whole_number(field(df, "length"))
    range_ = F.struct(offset.alias("start"), (offset + length - 1).alias("end"))
    header = F.concat(F.lit("bytes="), offset.cast("string"), F.lit("-"), (offset + length - 1).cast("string"))
    request = F.struct(
        F.lit("GET").alias("method"), F.concat(origin, path).alias("url"), scheme.alias("scheme"), host.alias("host"),
        F.when(port != "", port.try_cast("int")).otherwise(F.when(scheme == "https", 443).otherwise(80)).alias("port"),
        origin.alias("origin"), path.alias("path"), F.lit(None).cast("string").alias("query"), path.alias("request_uri"), (scheme == "https").alias("https"),
        F.create_map(F.lit("Range"), header).alias("headers"), filename.alias("filename"), offset.alias("offset"), length.alias("length"), range_.alias("range"), header.alias("range_header"),
    )
    lacks = missing_fields(df)
    rows = df.where(F.size(lacks) == 0) if on_missing == "skip" else df
    failed = F.concat(F.lit("capture lacks "), F.array_join(lacks, ", "))
    unknown = F.raise_error(F.lit("base_url is required for captures of no known crawl"))
    checked = F.when(F.size(lacks) > 0, F.raise_error(failed)).when(root.isNull(), unknown).otherwise(F.lit("ok"))
    return rows.withColumn("request", F.when(checked == "ok", request))


def requests(df: DataFrame, url: str | None = None, *, base: str | None = None, on_missing: str = "raise", index_paths=(), fields=None, **options) -> DataFrame:
    """Range requests of the captures that a query selects."""
    if fields is not None:
        raise ValueError("fields is not supported for requests")
    unknown = set(options) - {"limit", "from_", "to", "filters", "closest", "match", "sort", "registry"}
    if unknown:
        raise ValueError(f"unsupported for requests: {', '.join(sorted(unknown))}")
    return with_range_request(captures(df, url, **options), base, on_missing, index_paths)


def check_requestable(row: dict) -> None:
    """The driver's check of one row."""
    number = lambda x: int(x) if re.fullmatch(r"-?[0-9]+", str(x)) else None
    offset, length = number(row.get("offset")), number(row.get("length"))
    lacks = [n for n, bad in (("filename", not row.get("filename")), ("offset", offset is None or offset < 0), ("length", length is None or length <= 0)) if bad]
    if lacks:
        raise UnrequestableCapture(lacks)
