"""Registered queries over real files: the capture view is written as an index in the shared folder and read back from it."""

from __future__ import annotations

import atexit
import gzip
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capweave.plans import derive
from capweave.plans.fixture import CTE, captures_view
from capweave.sources import packed
from capweave.sources.files import Files, shared_dir
from capweave.sources.index import Index
from capweave.sources.text import read_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_ALL = ["urlkey", "timestamp", "url", "mime", "mime_detected", "status", "digest", "length", "offset", "filename"]
_ALL_SQL = ", ".join(f'"{c}"' for c in _ALL)
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY urlkey ORDER BY timestamp DESC, file_ord DESC, line_number DESC) AS rn FROM captures) WHERE rn = 1"


def register(name: str, sql: str):
    """The decorated function takes (spark, view, folder of its own); sql may select from `captures`."""

    def add(build):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            folder = f"{shared_dir(spark)}/capweave-{uuid.uuid4().hex}"
            atexit.register(_remove, spark, folder)
            return build(spark, captures_view(spark, sf_dir), folder)

        QUERIES[name], ORACLE[name] = query, CTE + sql
        return build

    return add


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        Files(spark).delete(folder)
    except Exception:  # the JVM may be gone when the interpreter ends
        pass


def shards(v: DataFrame, folder: str, lines=derive.cdxj_line, header: str | None = None, ending: str = ".cdxj", compressed: bool = True) -> list[str]:
    """A text file for each file_ord of the view, rows in the order of their lines."""
    store, rows = Files(v.sparkSession), v.select("file_ord", "line_number", lines(v).alias("value"))
    if header is not None:
        rows = rows.unionByName(v.select("file_ord").distinct().select("file_ord", F.lit(-1).cast("long").alias("line_number"), F.lit(header).alias("value")))
    sorted_rows = rows.repartition("file_ord").sortWithinPartitions("file_ord", "line_number").select("file_ord", "value")
    sorted_rows.write.partitionBy("file_ord").option("compression", "gzip" if compressed else "none").text(f"{folder}/_written")
    out = []
    for f in store.walk(f"{folder}/_written"):
        if f.name.startswith("part-"):
            n = int(f.path.rpartition("/file_ord=")[2].partition("/")[0])
            out.append(f"{folder}/cdx-{n:05d}{ending}{'.gz' if compressed else ''}")
            store.rename(f.path, out[-1])
    store.delete(f"{folder}/_written")
    return sorted(out)


@register("src_gzip_shards", f"SELECT {_ALL_SQL}, file_ord, line_number + 1 AS line_number FROM captures")
def _gzip(spark, v, folder):
    shards(v, folder)
    return Index.open(spark, folder).rows().select(*_ALL, "file_ord", "line_number")


@register("src_cdxj", f"SELECT {_ALL_SQL}, file_ord, line_number + 1 AS line_number FROM captures WHERE host = 'example.org' OR host LIKE '%.example.org'")
def _cdxj(spark, v, folder):
    shards(v, folder, compressed=False)
    return Index.open(spark, f"{folder}/*.cdxj").captures("*.example.org").select(*_ALL, "file_ord", "line_number")


_ELEVEN = ["urlkey", "timestamp", "url", "mime", "status", "digest", "redirect", "meta", "length", "offset", "filename"]


@register(
    "src_cdx11_header",
    """SELECT urlkey, timestamp, url, coalesce(replace(mime, ' ', ''), '-') AS mime, status, coalesce(digest, '-') AS digest, '-' AS redirect, '-' AS meta, length, "offset", filename, file_ord, line_number + 2 AS line_number FROM captures""",
)
def _eleven(spark, v, folder):
    cell = lambda n: F.lit("-") if n in ("redirect", "meta") else F.coalesce(F.replace(F.col(n), F.lit(" "), F.lit("")), F.lit("-"))
    shards(v, folder, lambda df: F.concat_ws(" ", *map(cell, _ELEVEN)), " CDX N b a m s k r M S V g", ".cdx")
    return Index.open(spark, folder).rows().select(*_ELEVEN, "file_ord", "line_number")


@register("src_zipnum", f"SELECT {_ALL_SQL} FROM captures WHERE host = 'example.com' OR host LIKE '%.example.com'")
def _zipnum(spark, v, folder):
    """One shard of gzip members of 500 lines and its block index; the fixture is put together on the driver."""
    store, lines = Files(spark), v.select("urlkey", "timestamp", derive.cdxj_line(v).alias("value")).orderBy("urlkey", "timestamp", "seq").toLocalIterator()
    data, index, block, key = bytearray(), [], [], ""

    def close() -> None:
        member = gzip.compress("".join(f"{x}\n" for x in block).encode(), mtime=0)
        index.append(f"{key}\tcdx-00000.gz\t{len(data)}\t{len(member)}\t{len(index) + 1}")
        data.extend(member)
        block.clear()

    for r in lines:
        if not block:
            key = f"{r['urlkey']} {r['timestamp']}"
        block.append(r["value"])
        if len(block) == 500:
            close()
    if block:
        close()
    store.write_bytes(f"{folder}/cdx-00000.gz", bytes(data))
    store.write(f"{folder}/cluster.idx", "\n".join(index) + "\n")
    return Index.open(spark, folder, trust_keys=True).captures("*.example.com", fields=_ALL)


@register("src_packed_pruned", f"SELECT {_ALL_SQL}, file_ord, line_number FROM captures WHERE host = 'example.net' OR host LIKE '%.example.net'")
def _pruned(spark, v, folder):
    packed.write_packed(v.drop("seq"), f"{folder}/p.parquet", check=False, files=8)
    return Index.open(spark, f"{folder}/p.parquet", trust_keys=True).captures("*.example.net").select(*_ALL, "file_ord", "line_number")


@register("src_packed_count", "SELECT count(*) AS captures FROM captures WHERE host = 'example.net' OR host LIKE '%.example.net'")
def _count(spark, v, folder):
    packed.write_packed(v.drop("seq"), f"{folder}/p.parquet", check=False, files=8)
    return Index.open(spark, f"{folder}/p.parquet", trust_keys=True).count("*.example.net")


@register("snk_packed_roundtrip", f"SELECT {_ALL_SQL}, file_ord, line_number FROM captures")
def _packed(spark, v, folder):
    packed.write_packed(v.drop("seq"), f"{folder}/p.parquet", check=False)
    return Index.open(spark, f"{folder}/p.parquet").rows().select(*_ALL, "file_ord", "line_number")


@register("snk_cdxj_roundtrip", f"SELECT {_ALL_SQL} FROM captures WHERE status = '200'")
def _text(spark, v, folder):
    derive.write_cdxj(v.where("status = '200'"), f"{folder}/out")
    return read_text(spark, [f.path for f in Files(spark).walk(f"{folder}/out") if f.name.startswith("part-")]).select(*_ALL)


def _two_stores(v: DataFrame, folder: str) -> Index:
    """Two packed stores whose rows have equal places in their own files."""
    for n in (0, 1):
        packed.write_packed(v.where(F.col("file_ord") % 2 == n).withColumn("file_ord", F.lit(0)).drop("seq"), f"{folder}/{n}.parquet", check=False, files=2)
    return Index.open(v.sparkSession, folder)


@register("pages_two_shards", f"SELECT {_ALL_SQL}, line_number FROM captures WHERE status = '200' AND file_ord < 2 ORDER BY file_ord, line_number LIMIT 90 OFFSET (SELECT greatest(count(*) - 45, 0) FROM captures WHERE status = '200' AND file_ord = 0)")
def _pages(spark, v, folder):
    """The pages round the border of two stores, joined: 45 rows of the first and as many of the second."""
    index = _two_stores(v.where("file_ord < 2"), folder)
    first = index.stores(None, 0, 1).where("status = '200'").count()
    start = index.captures(filters=["=status:200"], page_size=max(1, first - 45))
    rows, cursor = [], start.next_cursor
    while cursor is not None and len(rows) < 90:
        page = index.captures(filters=["=status:200"], page_size=30, cursor=cursor)
        rows, cursor = rows + list(page), page.next_cursor
    return spark.createDataFrame([tuple(r[c] for c in (*_ALL, "line_number")) for r in rows], ", ".join(f"{c} string" for c in _ALL) + ", line_number long")


@register("limit_two_shards", f"SELECT {_ALL_SQL}, line_number FROM captures WHERE file_ord < 2 AND status = '404' ORDER BY file_ord, line_number LIMIT 40")
def _limit(spark, v, folder):
    return _two_stores(v.where("file_ord < 2"), folder).captures(filters=["=status:404"], limit=40).select(*_ALL, "line_number")


@register("batch_collapsed", f"SELECT {_ALL_SQL}, file_ord FROM ({_LATEST})")
def _batch(spark, v, folder):
    """Each shard derived to a packed store, with a collapse over all of them."""
    done = derive.batch(spark, shards(v, f"{folder}/in"), f"{folder}/out", derive.Plan(collapse="urlkey"), check=False)
    return spark.read.parquet(*[e.output for e in done]).select(*_ALL, "file_ord")
