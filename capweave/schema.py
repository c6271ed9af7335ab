"""The logical capture relation: columns, field names and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = (
    "urlkey", "timestamp", "url", "mime", "mime_detected", "status", "digest", "redirect",
    "meta", "length", "offset", "filename", "charset", "languages", "truncated",
)
#: columns that place a row: which packed store (only there), which file, which line of it; together the native order
NATIVE = ("store_ord", "file_ord", "line_number")
#: default columns of CSV output
CSV_FIELDS = ("urlkey", "timestamp", "url", "status", "mime", "digest", "length", "offset", "filename")

CAPTURE_SCHEMA = T.StructType(
    [T.StructField(f, T.StringType()) for f in FIELDS]
    + [T.StructField("extras", T.MapType(T.StringType(), T.StringType())), T.StructField("source_path", T.StringType()), T.StructField("line_number", T.LongType()), T.StructField("file_ord", T.IntegerType())]
)


class CaptureError(Exception):
    """Base of this library's errors."""


class ParseError(CaptureError):
    """A row can't be read."""


class InvalidCursor(CaptureError):
    """A page cursor is malformed, altered, or belongs to another index or query."""


class UnsupportedCollapse(CaptureError):
    """Collapse can't be combined with the other options."""


class UnsupportedPageQuery(CaptureError):
    """Pages can't be combined with the other options."""


class UnrequestableCapture(CaptureError):
    """A capture lacks what a range request needs."""

    def __init__(self, missing_fields: list[str]) -> None:
        super().__init__(f"capture lacks {', '.join(missing_fields)}")
        self.missing_fields = list(missing_fields)


class EncodeError(CaptureError):
    """Rows that the packed store does not accept."""


def field_name(name: str) -> str:
    """The column name of a field: mime-detected and mime_detected are one."""
    return name.strip().replace("-", "_")


def field_names(fields) -> list[str]:
    """An ordered list from names, lists of names and comma-separated names."""
    flat = [fields] if isinstance(fields, str) else list(fields)
    return [field_name(x) for f in flat for x in str(f).split(",") if x.strip()]


def has_field(df: DataFrame, name: str) -> bool:
    return field_name(name) in df.columns or "extras" in df.columns


def field(df: DataFrame, name: str) -> Column:
    """A field's column: a known one, else the extra of that name as written, else null."""
    column = field_name(name)
    if column in df.columns:
        return F.col(f"`{column}`")
    if "extras" in df.columns:
        return F.coalesce(F.col("extras")[name], F.col("extras")[column])
    return F.lit(None).cast("string")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however often they are used later: no rule moves expressions through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def native_columns(df: DataFrame) -> list[str]:
    return [c for c in NATIVE if c in df.columns]
