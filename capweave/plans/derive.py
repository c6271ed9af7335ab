"""Deriving smaller indexes: filter, allow-list, collapse, validate, write; one input or many with a ledger."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field as data_field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from capweave.functions import values
from capweave.operators import allowlist
from capweave.operators.filters import FilterSet, parse_expression
from capweave.operators.order import check_collapse, latest_per_key
from capweave.schema import FIELDS, CaptureError, field, native_columns
from capweave.sources import packed
from capweave.sources.files import Files
from capweave.sources.text import read_text

STATES = ("pending", "processing", "complete", "delete_pending", "deleted", "failed")
LEDGER_VERSION = 1


@dataclass
class Plan:
    """What a derive job keeps. Strings in `named` are expressions of named filters; field filters go in `where`."""

    named: object = None
    where: object = None
    only_urls: list | None = None
    collapse: str | None = None
    collapse_order: str | None = None
    registry: dict = data_field(default_factory=dict)
    filter_signature: object = None

    def __post_init__(self) -> None:
        check_collapse(self.collapse, self.collapse_order)
        terms = [] if self.named is None else list(self.named) if isinstance(self.named, (list, tuple)) else [self.named]
        known = FilterSet(None, self.registry).registry
        self._named = FilterSet([t for x in terms for t in (parse_expression(x, known) if isinstance(x, str) else [x])], self.registry)
        self._where = FilterSet(self.where)

    def keep(self, df: DataFrame) -> Column:
        return self._named.predicate(df) & self._where.predicate(df)

    def select(self, df: DataFrame) -> DataFrame:
        """Predicates, then the allow-list, then the collapse: an older row that passes can win."""
        rows = df.where(self.keep(df))
        if self.only_urls is not None:
            rows = allowlist.allowed(rows, self.only_urls)
        return latest_per_key(rows) if self.collapse else rows

    def signature(self) -> dict:
        return {
            "named": self._named.signature(self.filter_signature), "where": self._where.signature(self.filter_signature),
            "only_urls": allowlist.signature(self.only_urls) if self.only_urls is not None else None, "collapse": ["urlkey", "latest"] if self.collapse else None,
        }


def sorted_violations(df: DataFrame, by: str = "source_path", place: str = "line_number") -> DataFrame:
    """Rows whose key is missing or less than the one before it in their file."""
    w = Window.partitionBy(by).orderBy(place)
    before = F.lag("urlkey").over(w)
    rows = df.select(by, place, "urlkey").withColumn("previous_urlkey", before)
    return rows.where(F.col("urlkey").isNull() | (F.col("urlkey") == "") | (F.col("previous_urlkey") > F.col("urlkey")))


def grouping_violations(df: DataFrame, by: str = "file_ord") -> DataFrame:
    """Files whose first key is less than the last key of the file before, so that keys are not grouped in file order."""
    ranges = packed.key_ranges(df, by)
    return ranges.withColumn("previous_last_key", F.lag("last_key").over(Window.orderBy(by))).where("previous_last_key > first_key")  # one row a file


def preview(df: DataFrame, plan: Plan) -> DataFrame:
    """total, selected and filtered counts and the selected rows' bytes, in one row, nothing written."""
    total = df.agg(F.count("*").alias("total_count"))
    chosen = plan.select(df).agg(F.count("*").alias("selected_count"), F.coalesce(F.sum(raw_bytes(df)), F.lit(0)).alias("raw_bytes"))
    return total.crossJoin(chosen).select("total_count", "selected_count", (F.col("total_count") - F.col("selected_count")).alias("filtered_count"), "raw_bytes")


def fingerprint(df: DataFrame) -> DataFrame:
    """Count and an order-free hash of the selected rows; equal for the same rows however they are dealt."""
    return df.agg(*packed.marks(packed.row_hash(df)))


def cdxj_line(df: DataFrame) -> Column:
    """The row as text: the raw line if there is one, else key, timestamp and JSON of the fields present."""
    names = {"mime_detected": "mime-detected"}
    body = F.to_json(F.struct(*[field(df, f).alias(names.get(f, f)) for f in FIELDS if f in df.columns and f not in ("urlkey", "timestamp")]))
    line = F.concat_ws(" ", F.coalesce(field(df, "urlkey"), F.lit("-")), F.coalesce(field(df, "timestamp"), F.lit("-")), body)
    return F.coalesce(F.col("raw"), line) if "raw" in df.columns else line


def raw_bytes(df: DataFrame) -> Column:
    return F.octet_length(cdxj_line(df)) + 1


def write_cdxj(df: DataFrame, path: str, gzip: bool = True, force: bool = False) -> int:
    """Text shards in native order, read back and compared with the lines that went in; returns the records written."""
    rows = df.orderBy(*native_columns(df)) if native_columns(df) else df
    lines, h, seen = rows.select(cdxj_line(df).alias("value")), F.xxhash64("value"), Observation()
    lines.observe(seen, *packed.marks(h)).write.mode("overwrite" if force else "errorifexists").option("compression", "gzip" if gzip else "none").text(path)
    got = df.sparkSession.read.text(path).agg(*packed.marks(h)).first().asDict()
    if got != seen.get and got != lines.agg(*packed.marks(h)).first().asDict():  # a part written twice after a loss counts twice
        raise OSError(f"{path} does not hold the lines that were written")
    return got["record_count"]


def jsonl(df: DataFrame) -> DataFrame:
    """One JSON object a row, absent fields left out."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def text_lines(df: DataFrame) -> DataFrame:
    """'status timestamp url', absent ones dropped."""
    return df.select(F.concat_ws(" ", field(df, "status"), field(df, "timestamp"), field(df, "url")).alias("value"))


#: writers by format; a caller may add its own
WRITERS: dict[str, Callable[..., object]] = {"packed": lambda df, path, force: packed.write_packed(df, path, force, check=False), "cdxj": lambda df, path, force: write_cdxj(df, path, True, force)}


BUILT_IN = tuple(WRITERS)  # these verify what they write


def output_name(source: str, fmt: str = "packed", beside: bool = False) -> str:
    """cdx-00000.gz to cdx-00000.parquet; text beside its source gets .filtered before its ending."""
    stem = re.sub(r"(\.cdxj?)?(\.gz)?$", "", source.rpartition("/")[2], flags=re.I)
    if fmt == "packed":
        return f"{stem}.parquet"
    ending = source.rpartition("/")[2][len(stem) :]
    return f"{stem}{'.filtered' if beside else ''}{ending or '.cdxj'}"


@dataclass
class Entry:
    source: str
    output: str
    state: str = "pending"
    source_size: int = 0
    source_modified: int = 0
    record_count: int | None = None
    fingerprint: dict | None = None
    error: str | None = None


class Ledger:
    """The durable state of a batch: one JSON file, replaced as a whole at every step."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.files, self.path = Files(spark), path

    def load(self) -> dict | None:
        if not self.files.exists(self.path):
            return None
        data = json.loads(self.files.read(self.path))
        if data.get("version") != LEDGER_VERSION or not all(e.get("state") in STATES for e in data["entries"]):
            raise CaptureError(f"{self.path} is no ledger of this version")
        return data

    def save(self, plan: str, entries: list[Entry]) -> None:
        self.files.write(self.path, json.dumps({"version": LEDGER_VERSION, "plan": plan, "entries": [asdict(e) for e in entries]}, sort_keys=True))


def batch(spark: SparkSession, sources: list[str], output: str, plan: Plan, fmt: str = "packed", ledger: str | None = None, resume: bool = False, force: bool = False, delete_sources: bool = False,
          strict: bool = True, check: bool = True, sorted_input: bool = False, progress: Callable[[Entry], None] | None = None) -> list[Entry]:
    """Derives each text shard into `output`, one output for each, resumable shard by shard.

    A collapse is over all inputs together: winners are picked once, kept beside the outputs until all are done, and every shard
    takes its own. An output is done when it was written, read back and found to hold the planned rows; sources are deleted only
    when all outputs are. sorted_input: a shard whose keys are missing or fall is an error.
    """
    files = Files(spark)
    sources = sorted(set(sources))
    top = output.rstrip("/")
    state = lambda s: (i.size, i.modified) if (i := files.info(s)) else (-1, 0)
    entries = [Entry(s, f"{top}/{output_name(s, fmt, s.rpartition('/')[0] == top)}", "pending", *state(s)) for s in sources]
    outputs = [e.output for e in entries]
    if len(set(outputs)) < len(outputs) or set(outputs) & set(sources) or (ledger or "") in {*outputs, *sources}:
        raise ValueError("outputs collide with each other, with inputs or with the ledger")
    signature = values.digest_of({"plan": plan.signature(), "format": fmt, "sources": sources, "outputs": outputs})
    book = Ledger(spark, ledger or f"{output.rstrip('/')}/_derive_ledger.json")
    if (old := book.load()) is not None:
        if not resume:
            raise ValueError(f"{book.path} exists; resume or remove it")
        if old["plan"] != signature:
            raise ValueError("the ledger belongs to another plan")
        entries = [Entry(**e) for e in old["entries"]]
    book.save(signature, entries)

    open_ = [e for e in entries if e.state not in ("complete", "delete_pending", "deleted")]
    selection = f"{top}/_selection-{signature[:16]}"
    if plan.collapse and open_ and not files.exists(f"{selection}/_SUCCESS"):
        plan.select(read_text(spark, sources, strict=strict)).repartition("file_ord").write.mode("overwrite").partitionBy("file_ord").parquet(selection)
    winners = spark.read.parquet(selection) if plan.collapse and open_ else None
    for e in open_:
        if state(e.source) != (e.source_size, e.source_modified):
            raise CaptureError(f"{e.source} changed since the plan was made")
        e.state = "processing"
        book.save(signature, entries)
        try:
            if sorted_input and (wrong := sorted_violations(read_text(spark, [e.source], strict=strict)).first()) is not None:
                raise CaptureError(f"{e.source}:{wrong['line_number']}: {wrong['urlkey']!r} after {wrong['previous_urlkey']!r}")
            rows = winners.where(F.col("file_ord") == sources.index(e.source)) if winners is not None else plan.select(read_text(spark, [e.source], strict=strict))
            if fmt == "packed":
                got = packed.write_packed(rows, e.output, force or old is not None, check=check)
            else:
                got = WRITERS[fmt](rows, e.output, force or old is not None)
            if not isinstance(got, dict):
                got = {"record_count": got if isinstance(got, int) else spark.read.text(e.output).count()}
            if fmt not in BUILT_IN and got["record_count"] != rows.count():
                raise CaptureError(f"{e.output} does not hold the planned rows")
            if state(e.source) != (e.source_size, e.source_modified):
                raise CaptureError(f"{e.source} changed while it was read")
            e.state, e.record_count, e.error = "complete", got["record_count"], None
            e.fingerprint = {k: got[k] for k in ("record_count", "xor", "sum") if k in got}
        except Exception as error:
            e.state, e.error = "failed", str(error)[:500]
            book.save(signature, entries)
            raise
        book.save(signature, entries)
        if progress:
            progress(e)
    if winners is not None:
        files.delete(selection)
    for e in entries if delete_sources else []:  # only now: a collapse reads all sources for each output
        if e.state != "deleted":
            e.state = "delete_pending"
            book.save(signature, entries)
            files.delete(e.source)
            e.state = "deleted"
            book.save(signature, entries)
            if progress:
                progress(e)
    return entries
