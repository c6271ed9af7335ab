"""Operator 10: line dedup by site-relative frequency.

A host's pages are its distinct texts, so a page copied many times counts once and its own lines do not
become boilerplate. A line that stands on more than `ratio` of its host's pages, and on `min_pages` of them
at least, is dropped wherever the host shows it; blank lines neither count nor go. A page of which nothing
but blank lines would be left keeps its text (`emptied` says so): that is a copy, not boilerplate.

Scale: text is read once to count and once to drop, and is never shuffled. Counting shuffles 128-bit hashes
of lines with their page's hash, combined before the shuffle. Lines over the ratio are at most (mean lines
of a page / ratio) for each host, whatever the number of its pages, so they go to the documents as one short
array for each host: broadcast while their bytes stay under a checked bound, joined by host beyond it.

Defined results: null text: no lines, stays null; empty text: one blank line; null host: a host of its own;
repeated rows: one page; an empty table: no rows. Working columns are prefixed and dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capweave.llm.common import stored, table

RATIO, MIN_PAGES = 0.1, 5
BROADCAST_ROWS = 200_000


def _hash(x: Column) -> Column:
    """128 bits of a string as two independently seeded 64-bit hashes."""
    return F.struct(F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text: str = "text", host: str = "source") -> DataFrame:
    """(_host, _bad): for each host that has any, the hashes of its lines over the ratio."""
    page = docs.where(F.col(text).isNotNull()).select(
        F.col(host).alias("_host"), _hash(F.col(text)).alias("_page"),
        F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: ~_blank(x)), _hash)).alias("_l"),
    )
    totals = page.select("_host", "_page").distinct().groupBy("_host").agg(F.count("*").alias("_pages"))
    seen = page.select("_host", "_page", F.explode("_l").alias("_line")).distinct()
    counts = seen.groupBy("_host", "_line").agg(F.count("*").alias("_on")).where(F.col("_on") >= min_pages)
    over = counts.join(totals.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h"))).where(F.col("_on") > F.col("_pages") * ratio)
    return over.groupBy("_host").agg(F.collect_list("_line").alias("_bad"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text: str = "text", host: str = "source") -> DataFrame:
    """The documents with the lines dropped from their text, plus n_lines, n_dropped and emptied."""
    bad = stored(boilerplate(docs, ratio, min_pages, text, host)).withColumnRenamed("_host", "_bad_host")
    lines = bad.agg(F.sum(F.size("_bad"))).first()[0] or 0
    if lines <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    j = docs.join(bad, docs[host].eqNullSafe(F.col("_bad_host")), "left").drop("_bad_host")
    all_lines = _lines(F.col(text))
    kept = F.when(F.col("_bad").isNull(), all_lines).otherwise(F.filter(all_lines, lambda x: _blank(x) | ~F.array_contains(F.col("_bad"), _hash(x))))
    j = j.withColumn("_n", F.coalesce(F.size(all_lines), F.lit(0))).withColumn("_kept", kept)
    j = j.withColumn("_gone", F.when(F.col(text).isNull(), 0).otherwise(F.col("_n") - F.size("_kept")))
    emptied = (F.col("_gone") > 0) & ~F.exists("_kept", lambda x: ~_blank(x))
    j = j.withColumn("_emptied", F.coalesce(emptied, F.lit(False)))
    out = F.when((F.col("_gone") == 0) | F.col("_emptied"), F.col(text)).otherwise(F.array_join("_kept", "\n"))
    return j.select(
        *[out.alias(c) if c == text else docs[c] for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.col("_n")).cast("long").alias("n_lines"),
        F.when(F.col("_emptied"), 0).otherwise(F.col("_gone")).cast("long").alias("n_dropped"), F.col("_emptied").alias("emptied"),
    )


def relined(docs: DataFrame, length: str = "n_chars", **options) -> DataFrame:
    """drop_boilerplate with the columns of docs alone; a column that holds the text's length follows it."""
    out = drop_boilerplate(docs, **options)
    text = F.col(options.get("text", "text"))
    if length in docs.columns:
        n = F.when(F.col("n_dropped") > 0, F.char_length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType)
        out = out.withColumn(length, n)
    return out.select(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", "emptied", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def sql(ratio: float = RATIO, min_pages: int = MIN_PAGES, of: str = "documents", columns: str = "doc_id") -> str:
    """DuckDB SQL of drop_boilerplate over a table with a unique doc_id: `columns`, kept_text, n_lines, n_dropped, emptied."""
    return f"""
    WITH ld_l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {of}),
    ld_t AS (SELECT source, count(DISTINCT text) AS pages FROM {of} WHERE text IS NOT NULL GROUP BY source),
    ld_c AS (SELECT source, line, count(DISTINCT text) AS seen FROM ld_l WHERE trim(line) <> '' GROUP BY source, line HAVING count(DISTINCT text) >= {min_pages}),
    ld_b AS (SELECT ld_c.source, ld_c.line FROM ld_c JOIN ld_t ON ld_c.source IS NOT DISTINCT FROM ld_t.source WHERE ld_c.seen > ld_t.pages * {ratio}::DOUBLE),
    ld_m AS (SELECT ld_l.*, ld_b.line IS NOT NULL AS bad FROM ld_l LEFT JOIN ld_b ON ld_l.source IS NOT DISTINCT FROM ld_b.source AND ld_l.line = ld_b.line),
    ld_d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS gone, coalesce(bool_or(NOT bad AND trim(line) <> ''), false) AS some,
        string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad) AS kept FROM ld_m GROUP BY doc_id)
    SELECT {columns}, coalesce(d.n_lines, 0)::BIGINT AS n_lines, (CASE WHEN d.some THEN d.gone ELSE 0 END)::BIGINT AS n_dropped,
        coalesce(d.gone > 0 AND NOT d.some, false) AS emptied, CASE WHEN d.gone > 0 AND d.some THEN d.kept ELSE o.text END AS kept_text
    FROM {of} o LEFT JOIN ld_d d ON o.doc_id = d.doc_id"""
