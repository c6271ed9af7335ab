"""CDX and CDXJ text as a capture relation, parsed by native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capweave.schema import FIELDS, once
from capweave.sources.files import Files

#: fixed values: the letters of a CDX header, and the order without one
FIELD_CODES = {
    "N": "urlkey", "b": "timestamp", "a": "url", "m": "mime", "s": "status", "k": "digest", "r": "redirect", "M": "meta", "S": "length", "V": "offset", "g": "filename",
}
DEFAULT_ORDER = ("urlkey", "timestamp", "url", "mime", "status", "digest", "redirect", "meta", "length", "offset", "filename")
_KNOWN = {f: sorted({f, f.replace("_", "-")}) for f in FIELDS}


#: what a line is stripped of: white space and NUL
BLANK = " \t\n\x0b\x0c\r\x00"


def at_path(df: DataFrame, names: list[tuple[str, int]], out: str) -> DataFrame:
    """df with the number of each row's file (column source_path) out of a list of the driver's, one row a file."""
    listed = df.sparkSession.createDataFrame(names, f"_path string, {out} int")
    key = F.regexp_replace("source_path", r"^[a-z0-9]+:/*", "/")
    return df.join(F.broadcast(listed), key == F.col("_path"), "left").drop("_path")


def read_lines(spark: SparkSession, paths: list[str], line_numbers: bool = True) -> DataFrame:
    """(value, source_path, file_ord, line_number) of text or gzip files.

    A line's number is its place in its split plus the lines of the file's splits before it. Where no file can be split and each
    has a partition of its own, the place alone is the number; else the counts of splits, a small table, are read first. No line
    moves. Without line numbers the column holds a number that only orders lines.
    """
    raw = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    files = Files(spark)
    rows = at_path(raw, [(files.uri(p), i) for i, p in enumerate(sorted(paths))], "file_ord")
    if not line_numbers:
        return rows.withColumn("line_number", F.col("_id") + 1).drop("_id", "_block")
    if all(p.lower().endswith(".gz") for p in paths) and raw.rdd.getNumPartitions() == len(paths):
        return rows.withColumn("line_number", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_block")
    blocks = raw.groupBy("source_path", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    j = rows.join(F.broadcast(blocks), ["source_path", "_block"])  # one row a split
    return j.withColumn("line_number", F.col("_id") - F.col("_first") + F.col("_before") + 1).drop("_id", "_block", "_first", "_before")


def parse(lines: DataFrame, strict: bool = True, headers: bool = True) -> DataFrame:
    """Lines to captures: CDXJ, JSON alone, or columns by the file's header. strict: a bad row is an error, else `corrupt` holds it.

    headers: whether lines may be headers; they are found first, by a scan of their own. Each line is split and its JSON read once.
    """
    rows = once(lines, _line=F.btrim("value", F.lit(BLANK))).where((F.col("_line") != "") & ~F.col("_line").startswith("#"))
    fields = F.array(*map(F.lit, DEFAULT_ORDER))
    if headers:
        codes = F.split(F.regexp_replace(F.btrim("value", F.lit(BLANK)), r"^CDX\s+", ""), r"\s+", -1)
        table = F.create_map(*[F.lit(x) for kv in FIELD_CODES.items() for x in kv])
        found = lines.where(F.col("value").rlike(r"^[\s\x00]*CDX\s+[^\s\x00]"))
        found = found.select("source_path", F.struct("line_number", F.transform(codes, lambda c: F.coalesce(F.try_element_at(table, c), c)).alias("fields")).alias("h"))
        found = found.groupBy("source_path").agg(F.sort_array(F.collect_list("h")).alias("_headers"))  # headers are few
        rows = rows.where(~F.col("_line").rlike(r"^CDX\s+\S")).join(F.broadcast(found), "source_path", "left")
        past = F.filter("_headers", lambda h: h["line_number"] < F.col("line_number"))
        fields = F.when(F.col("_headers").isNull(), fields).otherwise(F.coalesce(F.try_element_at(past, F.lit(-1))["fields"], fields))

    whole = F.col("_line").startswith("{")
    rows = once(rows, _parts=F.when(~whole, F.split("_line", r"\s+", 3)), _fields=fields)
    cdxj = F.coalesce((F.size("_parts") == 3) & F.get("_parts", F.lit(2)).startswith("{"), F.lit(False))
    body = F.when(whole, F.col("_line")).when(cdxj, F.get("_parts", F.lit(2)))
    texts = F.when(~whole & ~cdxj, F.split("_line", r"\s+", F.size("_fields")))
    rows = once(rows, _json=F.from_json(body, "map<string,string>"), _values=texts)
    bad = F.coalesce(F.when(F.col("_values").isNull(), F.col("_json").isNull()).otherwise(F.size("_values") < F.least(F.lit(2), F.size("_fields"))), F.lit(False))
    data = F.coalesce("_json", F.map_from_arrays(F.slice("_fields", 1, F.size("_values")), "_values"))
    if strict:
        data = F.when(bad, F.raise_error(F.concat(F.lit("can't read row: "), F.col("_line"))).cast("map<string,string>")).otherwise(data)
    rows = once(rows, _data=data, _bad=bad)
    value = lambda f: F.coalesce(*[F.try_element_at("_data", F.lit(n)) for n in _KNOWN[f]])
    prefix = {"urlkey": F.when(cdxj, F.get("_parts", F.lit(0))), "timestamp": F.when(cdxj, F.get("_parts", F.lit(1)))}
    known = [n for names in _KNOWN.values() for n in names]
    out = [(F.coalesce(value(f), prefix[f]) if f in prefix else value(f)).alias(f) for f in FIELDS]
    extras = F.map_filter("_data", lambda k, v: ~k.isin(*known)).alias("extras")
    tail = ["source_path", "line_number", "file_ord"]
    return rows.select(*out, extras, *tail, *([] if strict else [F.when(F.col("_bad"), F.col("_line")).alias("corrupt")]), F.col("value").alias("raw"))


def read_text(spark: SparkSession, paths: list[str], parser: Callable[[DataFrame], DataFrame] | None = None, strict: bool = True, line_numbers: bool = True) -> DataFrame:
    return (parser or (lambda lines: parse(lines, strict)))(read_lines(spark, paths, line_numbers))
