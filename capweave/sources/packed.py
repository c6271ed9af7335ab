"""The packed store: Parquet clustered by key, with a manifest of each file's key range."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from capweave.functions import values
from capweave.operators.match import UrlPattern
from capweave.schema import FIELDS, EncodeError, field
from capweave.sources.files import FileInfo, Files
from capweave.sources.text import at_path

MANIFEST, MANIFEST_VERSION = "_capture_manifest.json", 1
REQUIRED = ("url", "mime", "status", "length", "offset", "filename")


def _checks(df: DataFrame) -> list[Column]:
    """(field, value, reason) of each check of a row; no reason, no fault."""
    text = lambda f: F.coalesce(field(df, f), F.lit(""))
    number = lambda f: F.when((text(f) != "") & ~F.coalesce(values.whole_number(field(df, f)) >= 0, F.lit(False)), F.lit("not a non-negative integer"))
    bad = lambda name, reason: F.struct(F.lit(name).alias("field"), field(df, name).cast("string").alias("value"), reason.alias("reason"))
    checks = [bad(f, F.when(text(f) == "", F.lit("missing"))) for f in REQUIRED]
    checks += [bad("urlkey", F.when(text("urlkey") == "", F.lit("missing")))]
    t = text("timestamp")
    real = t.rlike("^[0-9]{14}$") & F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss")).isNotNull()
    checks += [bad("timestamp", F.when(~F.coalesce(real, F.lit(False)), F.lit("not a 14-digit time")))]
    checks += [bad("url", F.when((text("url") != "") & ~text("url").rlike("^(?i)https?://"), F.lit("not http or https")))]
    checks += [bad(f, number(f)) for f in ("length", "offset")]
    checks += [bad("digest", F.when((text("digest") != "") & ~values.is_canonical_digest(text("digest")), F.lit("not a canonical base-32 SHA-1")))]
    return checks


def violations(df: DataFrame) -> DataFrame:
    """One row for each field of each row that the packed store does not accept: urlkey, field, value, reason and where it stands."""
    where = [c for c in ("source_path", "line_number", "file_ord") if c in df.columns]
    return df.select(field(df, "urlkey").alias("urlkey"), *where, F.inline(F.array(*_checks(df)))).where("reason is not null")


def checked(df: DataFrame) -> DataFrame:
    """df, unless a row is not accepted."""
    first = violations(df).limit(1).collect()
    if first:
        r = first[0].asDict()
        raise EncodeError(f"{r.get('source_path', '')}:{r.get('line_number', '')} {r['urlkey']}: {r['field']} {r['value']!r}: {r['reason']}")
    return df


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(set(df.columns) & set(FIELDS))])


def marks(h: Column) -> list[Column]:
    """Count and an order-free hash of rows of a hash each."""
    return [F.count("*").alias("record_count"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")]


def write_packed(df: DataFrame, path: str, force: bool = False, check: bool = True, files: int | None = None, max_records: int = 0) -> dict:
    """Writes df clustered by key; returns records, files, sums and the fingerprint of the rows. Published as a whole: written beside its
    place, verified, renamed. What goes in is counted, hashed and checked on its way to the file, so df is not read again for it."""
    spark, store = df.sparkSession, Files(df.sparkSession)
    if store.exists(path) and not force:
        raise FileExistsError(path)
    rows = df.drop("raw", "corrupt", "store_ord")
    order = [c for c in ("urlkey", "timestamp", "file_ord", "line_number") if c in rows.columns]
    dealt = rows.repartitionByRange(files, "urlkey") if files else rows.repartitionByRange("urlkey")
    seen = Observation()
    bad = reduce(Column.__or__, [c["reason"].isNotNull() for c in _checks(dealt)]) if check else F.lit(False)
    dealt = dealt.observe(seen, *marks(row_hash(dealt)), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad"))
    temp = f"{path.rstrip('/')}.writing"
    writer = dealt.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd")
    (writer.option("maxRecordsPerFile", max_records) if max_records else writer).parquet(temp)
    expected = seen.get
    if expected.pop("bad"):
        store.delete(temp)
        checked(df)
    written = spark.read.parquet(temp)
    got = written.agg(*marks(row_hash(written)), *_sums(written)).first().asDict()
    if any(got[k] != v for k, v in expected.items()):
        # a part that was written twice after a loss counts twice: the source decides
        if any(got[k] != v for k, v in rows.agg(*marks(row_hash(rows))).first().asDict().items()):
            store.delete(temp)
            raise OSError(f"{temp} holds {got['record_count']} of {expected['record_count']} records, or others")
    store.rename(temp, path, force)
    entries = build_manifest(spark, path)
    return got | {"files": len(entries)}


def _sums(df: DataFrame) -> list[Column]:
    n = lambda f: F.coalesce(F.sum(values.whole_number(field(df, f)).cast("decimal(38,0)")), F.lit(0)).cast("long")
    return [n("length").alias("length_sum"), n("offset").alias("offset_sum"), F.min("urlkey").alias("first_key"), F.max("urlkey").alias("last_key")]


def summarise(df: DataFrame) -> DataFrame:
    """record_count, length_sum, offset_sum, first_key and last_key in one row."""
    return df.agg(F.count("*").alias("record_count"), *_sums(df))


def key_ranges(df: DataFrame, by: str = "source_path") -> DataFrame:
    """first_key, last_key and record_count of each file."""
    return df.groupBy(by).agg(F.min("urlkey").alias("first_key"), F.max("urlkey").alias("last_key"), F.count("*").alias("record_count"))


def build_manifest(spark: SparkSession, path: str) -> list[dict]:
    store = Files(spark)
    sizes = {f.name: f.size for f in store.walk(path)}
    rows = spark.read.parquet(path).select("urlkey", F.col("_metadata.file_name").alias("file"))
    entries = [r.asDict() | {"bytes": sizes[r["file"]]} for r in key_ranges(rows, "file").collect()]  # one row a file
    entries.sort(key=lambda e: (e["first_key"] or "", e["last_key"] or "", e["file"]))
    store.write(f"{path}/{MANIFEST}", json.dumps({"version": MANIFEST_VERSION, "files": entries}, sort_keys=True))
    return entries


def read_manifest(spark: SparkSession, path: str) -> list[dict] | None:
    """Entries that still fit their files (by size); null if there is no manifest of a known version."""
    store = Files(spark)
    if not store.exists(f"{path}/{MANIFEST}"):
        return None
    try:
        data = json.loads(store.read(f"{path}/{MANIFEST}"))
    except ValueError:
        return None
    if data.get("version") != MANIFEST_VERSION:
        return None
    sizes = {f.name: f.size for f in store.walk(path)}
    return [e for e in data["files"] if sizes.get(e["file"]) == e["bytes"]]


def prune(spark: SparkSession, path: str, pattern: UrlPattern) -> list[str]:
    """The data files that may hold a pattern's keys; files without a fitting entry always stay."""
    store = Files(spark)
    known = {e["file"]: e for e in (read_manifest(spark, path) or [])}
    info = store.info(path)
    if info is not None and not info.is_dir:
        return [path]

    def may(e: dict | None) -> bool:
        return e is None or any(e["last_key"] >= low and (high is None or e["first_key"] < high) for low, high in pattern.key_ranges())

    return [f.path for f in store.walk(path) if f.name.endswith(".parquet") and may(known.get(f.name))]


def signature(spark: SparkSession, paths: list[str]) -> list:
    """The stores' data files and their lengths."""
    return [[f.path, f.size] for p in paths for f in data_files(spark, p)]


def data_files(spark: SparkSession, path: str) -> list[FileInfo]:
    store = Files(spark)
    info = store.info(path)
    return [info] if info is not None and not info.is_dir else [f for f in store.walk(path) if f.name.endswith(".parquet")]


def read_packed(spark: SparkSession, paths: list[str], pattern: UrlPattern | None = None, first: int = 0) -> DataFrame:
    """The packed captures with store_ord, their store's place in the list (from `first` on): rows of several stores may have equal
    files and lines. With a pattern (and trusted keys) only files whose key range can hold it."""
    whole = lambda: spark.read.parquet(*paths)
    kept = None if pattern is None else [prune(spark, p, pattern) for p in paths]
    if kept is not None and not any(kept):
        return whole().limit(0).withColumn("store_ord", F.lit(first))
    rows = whole() if kept is None else spark.read.parquet(*[f for k in kept for f in k])
    if len(paths) == 1:
        return rows.withColumn("store_ord", F.lit(first))
    files = Files(spark)
    named = [(files.uri(f), first + i) for i, p in enumerate(paths) for f in (kept[i] if kept else [x.path for x in data_files(spark, p)])]
    own = "source_path" in rows.columns
    rows = rows.withColumnRenamed("source_path", "_own") if own else rows
    rows = at_path(rows.withColumn("source_path", F.col("_metadata.file_path")), named, "store_ord").drop("source_path")
    return rows.withColumnRenamed("_own", "source_path") if own else rows
