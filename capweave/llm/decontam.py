"""Operator 5: benchmark decontamination by size-partitioned MinHash containment search.

Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased; shingles are `width` words. An item is found
in a document if at least `threshold` of the item's distinct shingles occur in it (an item of fewer words is
one shingle of its own length). The Jaccard similarity of a short item and a long document says nothing, so
items are partitioned by size (shingle count, doubling classes) and, for each class, every document is cut in
overlapping windows of the class's own size: a contained item meets a window with similarity of about 0.2 or
more, and one of `hashes` minima agrees with near certainty (a miss has odds of about 0.8 ** (2 * hashes)). Equal
minima only make candidates; each is verified by exact containment of the shingles' text in the whole document.

Scale: one pass over the documents, nothing of them is shuffled. The items' minima and shingles are broadcast in
blocks of at most `block_bytes` of item text; a larger benchmark takes more passes, not more memory.

Defined results: null or empty texts, and items without words, match nothing; repeated items and documents are
reported for each row; empty tables give no rows; other columns stay out of the result, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capweave.llm.common import table

WIDTH, THRESHOLD, HASHES, BLOCK_BYTES = 5, 0.8, 64, 4 << 20
_RNG = np.random.default_rng(20240501)
_ODD = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _word_ids(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """A benchmark word's id; 0 for any other word, which no item's shingle can hold."""
    return np.fromiter(map(known.get, words, (0 for _ in words)), np.uint64, len(words))


def _shingle_ids(ids: np.ndarray, width: int) -> np.ndarray:
    h = np.zeros(len(ids) - width + 1, np.uint64)
    for i in range(width):
        h = (h ^ ids[i : len(h) + i]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _minima(h: np.ndarray, i: int) -> np.ndarray:
    x = (h + _ADD[i]) * _ODD[i]
    return x ^ (x >> np.uint64(32))


class Items:
    """A block of benchmark items: their shingles, and their minima by size class."""

    def __init__(self, rows: list[tuple], width: int, hashes: int) -> None:
        self.width, self.hashes = width, hashes
        self.ids, self.shingles, words = [], [], []
        for item, text in rows:
            w = words_of(text)
            if w:
                k = min(width, len(w))
                self.ids.append(item)
                words.append((w, k))
                self.shingles.append(frozenset(b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)))
        vocabulary = sorted({x for w, _ in words for x in w})
        self.known = {w: i + 1 for i, w in enumerate(vocabulary)}
        by_class: dict[tuple[int, int], list[int]] = {}
        hashed = []
        for n, (w, k) in enumerate(words):
            h = np.unique(_shingle_ids(_word_ids(w, self.known), k))
            hashed.append(h)
            by_class.setdefault((k, 1 << (len(h) - 1).bit_length()), []).append(n)
        #: (shingle width, window) -> for each hash function the distinct minima in order and the items of each
        self.classes = {}
        for key, members in sorted(by_class.items()):
            tables = []
            for i in range(hashes):
                of: dict[int, list[int]] = {}
                for n in members:
                    of.setdefault(int(_minima(hashed[n], i).min()), []).append(n)
                tables.append((np.array(sorted(of), np.uint64), [of[x] for x in sorted(of)]))
            self.classes[key] = tables

    def candidates(self, docs: list[np.ndarray]) -> list[set[int]]:
        """For each document, given as word ids, the items one of whose minima is also that of one of its windows."""
        out: list[set[int]] = [set() for _ in docs]
        widths: dict[int, tuple] = {}
        for k in {k for k, _ in self.classes}:
            # shingles with a word that no item has are left out: they are in no item, and windows only get more similar
            kept, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for d, ids in enumerate(docs):
                if len(ids) >= k:
                    sums = np.concatenate([[0], np.cumsum(ids > 0)])
                    h = _shingle_ids(ids, k)[sums[k:] - sums[:-k] == k]
                    kept.append(h)
                    of.append(np.full(len(h), d))
            h, doc = np.concatenate(kept), np.concatenate(of)
            first = np.searchsorted(doc, doc, "left")
            widths[k] = h, doc, np.arange(len(h)) - first
        for k, (h, doc, pos) in widths.items():
            if not len(h):
                continue
            cuts = {size: np.flatnonzero(pos % size == 0) for kk, size in self.classes if kk == k}
            for i in range(self.hashes):
                x = _minima(h, i)
                for size, starts in cuts.items():
                    block, owner = np.minimum.reduceat(x, starts), doc[starts]
                    window = block.copy()
                    window[:-1] = np.where(owner[1:] == owner[:-1], np.minimum(block[:-1], block[1:]), block[:-1])
                    low, members = self.classes[k, size][i]
                    at = np.minimum(np.searchsorted(low, window), len(low) - 1)
                    for w in np.flatnonzero(low[at] == window).tolist():
                        out[owner[w]].update(members[at[w]])
        return out

    def search(self, texts: list, threshold: float) -> list[list[tuple]]:
        """For each text, (item, its shingles, those that the text holds) for each item that it contains."""
        docs = [words_of(t) for t in texts]
        ids = [_word_ids(w, self.known) for w in docs]
        out: list[list[tuple]] = []
        for words, known, found in zip(docs, ids, self.candidates(ids)):
            held: dict[int, set[bytes]] = {}
            hits = []
            for n in sorted(found):
                want = self.shingles[n]
                k = next(iter(want)).count(b" ") + 1
                if k not in held:
                    sums = np.concatenate([[0], np.cumsum(known > 0)])
                    held[k] = {b" ".join(words[i : i + k]) for i in np.flatnonzero(sums[k:] - sums[:-k] == k).tolist()}
                both = len(want & held[k])
                if both >= threshold * len(want) - 1e-9:
                    hits.append((self.ids[n], len(want), both))
            out.append(hits)
        return out


def blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """The benchmark's rows in blocks of bounded bytes, one at a time."""
    rows, size = [], 0
    for r in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        rows.append((r["i"], r["t"]))
        size += len(r["t"].encode("utf-8", "surrogatepass"))
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, hashes: int = HASHES, block_bytes: int = BLOCK_BYTES,
                  key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, n_shingles, n_found, containment): one row for each item that a document contains."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text is not null")
    item_type = benchmark.select(item).schema[0].dataType
    out = T.StructType([T.StructField("_key", rows.schema[0].dataType), T.StructField("_item", item_type), T.StructField("n_shingles", T.LongType()), T.StructField("n_found", T.LongType())])

    def search(block):
        shared = spark.sparkContext.broadcast((block, width, hashes))

        def run(batches):
            items = Items(*shared.value)
            for b in batches:
                key_type = b.schema.field(0).type
                for i in range(0, b.num_rows, 256):
                    part = b.slice(i, 256)
                    hits = [(k, *hit) for k, found in zip(part.column(0).to_pylist(), items.search(part.column(1).to_pylist(), threshold)) for hit in found]
                    if hits:
                        k, it, n, m = zip(*hits)
                        yield pa.RecordBatch.from_arrays([pa.array(k, key_type), pa.array(it), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=["_key", "_item", "n_shingles", "n_found"])

        return rows.mapInArrow(run, out)

    parts = [search(b) for b in blocks(benchmark, item, item_text, block_bytes)]
    found = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], out)
    return found.select(F.col("_key").alias(key), F.col("_item").alias(item), "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, hashes: int = HASHES, block_bytes: int = BLOCK_BYTES,
          text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that contain no item, all columns as they are; one pass for each block of items, no shuffle."""
    at = docs.columns.index(text)

    def without(rows: DataFrame, block: list) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast((block, width, hashes))

        def run(batches):
            items = Items(*shared.value)
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    part = b.slice(i, 256)
                    yield part.filter(pa.array([not found for found in items.search(part.column(at).to_pylist(), threshold)], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    return reduce(without, blocks(benchmark, item, item_text, block_bytes), docs)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def sql(width: int = WIDTH, threshold: float = THRESHOLD, of: str = "documents") -> str:
    """DuckDB SQL of contamination() where every item has `width` words at least and ids are unique."""
    def shingles(t: str, key: str) -> str:
        return f"""SELECT DISTINCT {key}, array_to_string(w[i:i+{width - 1}], ' ') AS s FROM (
            SELECT {key}, w, unnest(generate_series(1, len(w) - {width - 1})) AS i FROM (
            SELECT {key}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {t}))"""

    return f"""
    WITH dc_b AS ({shingles('benchmark', 'item_id')}), dc_n AS (SELECT item_id, count(*) AS n_shingles FROM dc_b GROUP BY 1), dc_d AS ({shingles(of, 'doc_id')})
    SELECT d.doc_id, b.item_id, any_value(n.n_shingles)::BIGINT AS n_shingles, count(*)::BIGINT AS n_found, count(*) / any_value(n.n_shingles)::DOUBLE AS containment
    FROM dc_d d JOIN dc_b b ON d.s = b.s JOIN dc_n n ON n.item_id = b.item_id GROUP BY d.doc_id, b.item_id HAVING count(*) >= {threshold} * any_value(n.n_shingles)"""
