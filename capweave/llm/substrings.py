"""Operator 4: removal of repeated byte strings, by suffix arrays from induced sorting.

A byte goes if a string of `length` bytes over it also starts in a document with a smaller id; strings are those of the
input, matches stay inside a document, and overlaps count.

1. Equal texts are one: all but the smallest id's lose every byte (from `length` bytes on) and go no further.
2. Every string of `length` bytes holds an anchor: the gram of GRAM bytes with the least hash in it (winnowing). Equal
   strings hold equal anchors at equal places, so only strings round anchors of two documents can repeat: nothing
   is lost, and text that nothing shares is never sorted.
3. The anchors' contexts (all strings that the anchor may stand for) are dealt to shards by anchor; in a shard, equal contexts
   are one. What different contexts may share gets a suffix array by induced sorting, for each shard of bounded bytes, and its
   permuted common prefixes; suffixes with `length` bytes in common form a class, whose smallest id is the first holder of that string.
4. What is not the first holder's is marked, and each document drops the bytes under its marks.

Scale: anchors travel packed, a few thousand to a row, and are sorted bucket by bucket. A third of the documents may share a
passage: of an anchor of more than `crowd` occurrences equal contexts are one before they are dealt (partial aggregation), and
what the shard finds for one goes back to its holders (by a look-up where it is little, else by a join). An anchor with more
than `crowd` different contexts is dealt by its strings instead. So no shard holds more than `crowd` contexts of an anchor.
Text moves once to meet its anchors, and only sharing documents' text again.

Defined results: null text: an empty one; null id: kept whole and never a first holder; rows of one id: don't take from
each other; repeated rows: repeated results; an empty table: no rows; other columns stay out of the result. Ids are integers.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capweave.llm.common import SMALL_ROWS, release, small, stored, table
from capweave.llm.suffix import Text, repeated_classes

LENGTH, GRAM, CROWD, SHARD_BYTES = 50, 26, 10_000, 4 << 20
FEW, OFTEN = 50_000, 10_000
PIECE = 1 << 20
_B = 0x9E3779B97F4A7C15 | 1


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram of a byte array, by doubling."""
    parts, size, h = {}, 1, (b.astype(np.uint64) + np.uint64(0x51)) * np.uint64(0xD6E8FEB86659FD93)
    while size <= gram:
        parts[size] = h
        if 2 * size <= gram:
            h = h[: len(h) - size] * np.uint64(pow(_B, size, 1 << 64)) + h[size:]
        size *= 2
    out, done = None, 0
    for size in sorted(parts, reverse=True):
        if gram - done >= size:
            n = len(b) - gram + 1
            part = parts[size][done : done + n]
            out = part if out is None else out * np.uint64(pow(_B, size, 1 << 64)) + part
            done += size
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def anchors(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that are the least one, or equal to it, of some string of `length` bytes."""
    if len(b) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, hashes, w = [], [], length - gram + 1
    for at in range(0, len(b) - length + 1, PIECE):
        h = gram_hashes(b[at : at + PIECE + length - 1], gram)
        low, span = h, 1
        while 2 * span <= w:
            low, span = np.minimum(low[: len(low) - span], low[span:]), 2 * span
        low = np.minimum(low[: len(h) - w + 1], low[w - span : len(h) - span + 1])
        # a gram is an anchor exactly if the greatest minimum of the windows over it is its own hash
        p = np.flatnonzero(_most_over(low, w) == h)
        places.append(p + at)
        hashes.append(h[p])
    p, h = np.concatenate(places), np.concatenate(hashes)
    p, i = np.unique(p, return_index=True)
    return p, h[i].view(np.int64)


def _most_over(low: np.ndarray, w: int) -> np.ndarray:
    """For each of the len(low) + w - 1 places, the greatest of the (at most w) windows that hold it."""
    n, pad = len(low) + w - 1, np.zeros(w - 1, low.dtype)
    x, span = np.concatenate([pad, low, pad]), 1
    while 2 * span <= w:
        x, span = np.maximum(x[: len(x) - span], x[span:]), 2 * span
    return np.maximum(x[:n], x[w - span : w - span + n])


def _shared_anchors(texts: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    """(doc, places, crowded): of each document, the places of anchors that another document has too.

    Anchors travel packed: a row holds those that fall in one bucket of one piece of the input. A bucket is sorted in one go, so
    buckets are 4 times as many as shuffle partitions. One anchor is at most a few of a document's hundreds, so no bucket is hot.
    """
    buckets = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packed(anchor: list, doc: list, place: list) -> pa.RecordBatch:
        a, d, p = np.concatenate(anchor), np.concatenate(doc), np.concatenate(place)
        to = (a.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], to[by][1:] != to[by][:-1]]))
        pieces = [pa.array([x.tobytes() for x in np.split(v[by], cuts[1:])], pa.binary()) for v in (a, d, p)]
        return pa.RecordBatch.from_arrays([pa.array(to[by][cuts]), *pieces], names=["bucket", "anchors", "docs", "places"])

    def find(batches):
        anchor, doc, place, n = [], [], [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                p, a = anchors(np.frombuffer(t.as_buffer(), np.uint8), length, gram)
                if len(p):
                    place.append(p.astype(np.int32))
                    anchor.append(a)
                    doc.append(np.full(len(p), d, np.int64))
                    n += len(p)
                if n >= PIECE:
                    yield packed(anchor, doc, place)
                    anchor, doc, place, n = [], [], [], 0
        if n:
            yield packed(anchor, doc, place)

    rows = texts.select("doc", "text").mapInArrow(find, "bucket int, anchors binary, docs binary, places binary")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")

    def settled(held: list):
        a, d, p = (np.concatenate([np.frombuffer(h[i], t) for h in held]) for i, t in enumerate((np.int64, np.int64, np.int32)))
        by = np.argsort(a, kind="stable")
        a, d, p = a[by], d[by], p[by]
        cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        sizes = np.diff(np.append(cuts, len(a)))
        many = np.minimum.reduceat(d, cuts) < np.maximum.reduceat(d, cuts)
        keep = np.repeat(many, sizes)
        d, p, c = d[keep], p[keep], np.repeat(sizes > crowd, sizes)[keep]
        for i in range(0, len(d), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (d, p, c)], names=["doc", "place", "crowded"])

    def shared(batches):
        bucket, held = None, []
        for b in batches:
            for k, *piece in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and k != bucket:
                    yield from settled(held)
                    held = []
                bucket = k
                held.append(piece)
        if held:
            yield from settled(held)

    flagged = rows.mapInArrow(shared, "doc long, place int, crowded boolean")
    parts = [F.collect_list(F.when(~F.col("crowded"), F.col("place"))).alias("places"), F.collect_list(F.when(F.col("crowded"), F.col("place"))).alias("crowded")]
    return flagged.groupBy("doc").agg(*parts)  # bounded by the document's own length


def windows(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of all given stretches of a byte array, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of a byte matrix."""
    wide = np.zeros((len(x), -(-x.shape[1] // 8) * 8), np.uint8)
    wide[:, : x.shape[1]] = x
    out = np.zeros(len(x), np.uint64)
    for word in wide.view("<u8").T:
        out = (out ^ word) * np.uint64(_B)
        out ^= out >> np.uint64(29)
    return out


CONTEXT = "anchor long, ctx binary, at int, doc long, tid long, start long"


def _contexts(sharing: DataFrame, places: str, length: int, gram: int, then=None, schema: str = CONTEXT) -> DataFrame:
    """(anchor, ctx, at, doc, tid, start): the context of each listed anchor (all strings that hold it) and where the gram is in it.

    then: what to make of a batch of these, if not they themselves, with a schema of its own.
    """

    def made(part: pa.RecordBatch):
        texts, listed = part.column(1).cast(pa.binary()), part.column(2)
        flat = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]).astype(np.int64)
        every = np.repeat(np.arange(len(texts)), listed.value_lengths().to_numpy())
        place = listed.flatten().to_numpy().astype(np.int64)
        fits = place + gram <= sizes[every]  # rows of one id may have texts of their own
        every, place = every[fits], place[fits]
        for i in range(0, len(every), 10_000):
            of, at = every[i : i + 10_000], place[i : i + 10_000]
            begin = (np.cumsum(sizes) - sizes)[of]
            start, stop = np.maximum(0, at + gram - length), np.minimum(at + length, sizes[of])
            key = _mixed(flat[(begin + at)[:, None] + np.arange(gram)]).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
            ctx = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets), pa.py_buffer(windows(flat, begin + start, stop - start))])
            own = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(key), ctx, pa.array((at - start).astype(np.int32)), part.column(0).take(own), part.column(3).take(own), pa.array(start)], names=["anchor", "ctx", "at", "doc", "tid", "start"])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 128):
                for c in made(b.slice(i, 128)):
                    if then is None:
                        yield c
                    elif (out := then(c)) is not None:
                        yield out

    rows = sharing.where(F.size(places) > 0).select("doc", "text", F.col(places).alias("places"), "tid")
    return rows.mapInArrow(run, schema)


def _held_twice(*keys: np.ndarray) -> np.ndarray:
    """Which rows have keys that another row has too."""
    by = np.lexsort(keys)
    new = np.zeros(len(by), bool)
    for k in keys:
        new[1:] |= k[by][1:] != k[by][:-1]
    new[:1] = True
    out = np.empty(len(by), bool)
    out[by] = ~new | ~np.append(new[1:], True)
    return out


def first_holders(anchor: np.ndarray, ctx: pa.BinaryArray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, firsts) of a shard, contexts of whole anchors: firsts[i, j] is the smallest id that holds the string at j of the context of
    rows[i]. Left out are rows of contexts that share no string. low, high: the ids that hold a row's context."""
    side, width, none = length - gram, 2 * length - gram, np.iinfo(np.int64).max
    offsets = np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset : ctx.offset + len(ctx) + 1].astype(np.int64)
    data, sizes, first = np.frombuffer(ctx.buffers()[2], np.uint8), np.diff(offsets), side - at.astype(np.int64)
    # a row for each context, the grams below each other
    cell = np.arange(width) - first[:, None]
    there = (cell >= 0) & (cell < sizes[:, None])
    grid = np.where(there, data[np.minimum(np.maximum(offsets[:-1, None] + cell, 0), len(data) - 1)], 0)
    # equal contexts are one; a clash of hashes only leaves some apart
    by = np.lexsort((_mixed(grid), sizes, at, anchor))
    a, b = by[1:], by[:-1]
    same = (anchor[a] == anchor[b]) & (at[a] == at[b]) & (sizes[a] == sizes[b]) & (grid[a] == grid[b]).all(axis=1)
    cuts = np.flatnonzero(np.concatenate([[True], ~same]))
    of = np.empty(len(by), np.int64)
    of[by] = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(by))))
    lows, highs, one = np.minimum.reduceat(low[by], cuts), np.maximum.reduceat(high[by], cuts), by[cuts]
    # the strings of a context are its smallest holder's, unless another context has them: then both reach half of what is
    # left over the gram to one side, and go into the array
    half, twice = (side + 1) // 2, np.zeros(len(one), bool)
    for ok, part in ((at[one] >= half, grid[one, side - half : side]), (sizes[one] - at[one] - gram >= half, grid[one, side + gram : side + gram + half])):
        some = np.flatnonzero(ok)
        twice[some] |= _held_twice(_mixed(part[some]), anchor[one][some])
    table = np.where(np.arange(side + 1) + length <= sizes[one][:, None], lows[:, None], none)
    if twice.any():
        one, owns = one[twice], lows[twice]
        x = Text((grid[one][there[one]], sizes[one]))
        found, number = repeated_classes(x, length)
        firsts = np.repeat(owns, x.ends - x.starts + 1)
        if len(found):
            cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            firsts[found] = np.repeat(np.minimum.reduceat(owns[np.searchsorted(x.ends, found)], cuts), np.diff(np.append(cuts, len(found))))
        where = x.starts[:, None] + np.arange(side + 1)
        table[twice] = np.where(where + length <= x.ends[:, None], firsts[np.minimum(where, len(firsts) - 1)], none)
    rows = np.flatnonzero((twice | (lows < highs))[of])
    return rows, table[of[rows]]


def _shards(batches, shard_bytes: int):
    """Rows in the order of their first column, in pieces of about so many bytes that hold whole runs of it."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size >= shard_bytes:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            a = rows.column(0).to_numpy()
            at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            cut, done, goal = int(at[-1]), 0, max(1, shard_bytes * len(a) // size)
            while done < cut:  # a batch may hold many shards
                end = int(at[min(np.searchsorted(at, done + goal), len(at) - 1)])
                yield rows.slice(done, end - done)
                done = end
            held, size = [rows.slice(cut)], size * (len(a) - cut) // len(a)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


MARK = "doc long, tid long, start long, mask long"


def lost(b: pa.RecordBatch, rows: np.ndarray, firsts: np.ndarray) -> pa.RecordBatch | None:
    """The marks of some rows of a batch of contexts, of which the first holders of their strings are known."""
    mask = np.where(firsts < b.column(3).to_numpy()[rows][:, None], np.int64(1) << np.arange(firsts.shape[1]), 0).sum(axis=1)
    on = np.flatnonzero(mask)
    if not len(on):
        return None
    some = b.take(pa.array(rows[on]))
    return pa.RecordBatch.from_arrays([*(some.column(i) for i in (3, 4, 5)), pa.array(mask[on])], names=["doc", "tid", "start", "mask"])


#: the same with the marks of a document together
MARKS, ONE_MARK = "doc long, tid long, marks array<struct<start:long,mask:long>>", "array(struct(start, mask)) AS marks"


def by_document(b: pa.RecordBatch) -> pa.RecordBatch:
    """Marks, those of a document in a row, as one row for each document."""
    doc, tid = b.column(0).to_numpy(), b.column(1).to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tid[1:] != tid[:-1])]))
    each = pa.StructArray.from_arrays([b.column(2), b.column(3)], ["start", "mask"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(doc)).astype(np.int32)), each)
    return pa.RecordBatch.from_arrays([pa.array(doc[cuts]), pa.array(tid[cuts]), lists], names=["doc", "tid", "marks"])


def _marks(contexts: DataFrame, length: int, gram: int, shard_bytes: int) -> DataFrame:
    """(doc, tid, start, mask): bit i of mask marks the string at start + i as held by a smaller id."""

    def run(batches):
        for b in _shards(batches, shard_bytes):
            anchor, at, doc = (b.column(i).to_numpy() for i in (0, 2, 3))
            if (out := lost(b, *first_holders(anchor, b.column(1), at, doc, doc, length, gram))) is not None:
                yield out

    rows = contexts.repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(run, MARK)


def _crowded_marks(sharing: DataFrame, length: int, gram: int, crowd: int, shard_bytes: int, few: int) -> DataFrame:
    """The same for anchors of many documents: equal contexts become one before they are dealt, and what is found of one goes back to all.

    Where an anchor has over `crowd` different contexts, their strings are dealt instead (a context of a gram of `length` bytes is its string).
    """
    contexts = _contexts(sharing, "crowded", length, gram)
    one = stored(contexts.groupBy("anchor", "ctx", "at").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n")))
    wide = small(stored(one.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > crowd).select(F.col("anchor").alias("w"))))

    def run(batches):
        for b in _shards(batches, shard_bytes):
            anchor, at, low, high = (b.column(i).to_numpy() for i in (0, 2, 3, 4))
            rows, firsts = first_holders(anchor, b.column(1), at, low, high, length, gram)
            on = (firsts < high[rows][:, None]).any(axis=1)
            if on.any():
                lost, firsts = b.take(pa.array(rows[on])), firsts[on]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(firsts) + 1, dtype=np.int32) * firsts.shape[1]), pa.array(firsts.ravel()))
                yield pa.RecordBatch.from_arrays([lost.column(1), lost.column(5), lists], names=["c", "n", "firsts"])

    narrow = one.join(wide, F.col("anchor") == F.col("w"), "left_anti").select("anchor", "ctx", "at", "low", "high", "n")
    solved = narrow.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "c binary, n long, firsts array<long>")
    some = one.join(wide, F.col("anchor") == F.col("w"), "left_semi")
    spelt = some.select("ctx", "low", "high", "n", F.explode(F.sequence(F.lit(0), F.octet_length("ctx") - length)).alias("i")).where("i >= 0")
    spelt = spelt.withColumn("s", F.expr(f"substring(ctx, i + 1, {length})"))
    lowest = spelt.groupBy("s").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last").select("s", "first")
    back = spelt.join(lowest, "s").groupBy("ctx").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "first"))).alias("f"))
    full = F.transform(F.sequence(F.lit(0), F.lit(length - gram)), lambda i: F.coalesce(F.get(F.filter("f", lambda x: x["i"] == i), F.lit(0))["first"], F.lit(np.iinfo(np.int64).max)))
    solved = stored(solved.unionByName(back.select(F.col("ctx").alias("c"), "n", full.alias("firsts"))))
    known = solved.limit(few + 1).toArrow()
    if known.num_rows <= few:
        found = known.combine_chunks()
        firsts = np.array(found["firsts"].to_pylist(), np.int64).reshape(-1, length - gram + 1)
        shared = sharing.sparkSession.sparkContext.broadcast((pa.array(found["c"].to_pylist(), pa.binary()), firsts))

        def look_up(b: pa.RecordBatch):
            held, firsts = shared.value
            at = pc.fill_null(pc.index_in(b.column(1), held), -1).to_numpy()
            rows = np.flatnonzero(at >= 0)
            out = lost(b, rows, firsts[at[rows]])
            return None if out is None else by_document(out)

        return _contexts(sharing, "crowded", length, gram, look_up, MARKS)
    # too many to hold: those of very many documents are few, and go to all; the rest meets in a join
    mask = F.expr("aggregate(transform(firsts, (f, i) -> if(f < doc, shiftleft(1L, i), 0L)), 0L, (a, b) -> a + b)")
    parts = [small(solved.where(F.col("n") > OFTEN)), solved.where(F.col("n") <= OFTEN)]
    return reduce(DataFrame.unionByName, [contexts.join(df, F.col("ctx") == F.col("c")).select("doc", "tid", "start", mask.alias("mask")).where("mask <> 0").selectExpr("doc", "tid", ONE_MARK) for df in parts])


def strip(raw: bytes, marks: list[tuple[int, int]], length: int) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, bytes kept) for marks (start, mask)."""
    edge = np.zeros(len(raw) + 1, np.int64)
    if marks:
        start = np.array([m[0] for m in marks], np.int64)
        mask = np.array([m[1] for m in marks], np.int64)
        width = int(mask.max()).bit_length()
        row, bit = np.nonzero((mask[:, None] >> np.arange(width)) & 1)
        hit = np.bincount(start[row] + bit, minlength=len(edge)) > 0
        edge += hit
        edge[length:] -= hit[:-length]
    gone = np.cumsum(edge[:-1]) > 0
    runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
    return int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, shard_bytes: int = SHARD_BYTES, few: int = FEW, key: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) for every row."""
    if not length - 62 <= gram <= length:
        raise ValueError("a context's strings must fit the bits of a mask")
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = rows.select("doc", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("tid"))
    known = stored(known)
    # texts of several rows; those of very many rows are few, and go to all where not all fit
    held = stored(known.where("doc is not null").groupBy("sha").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"))
    several = [held] if held.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else [held.where(F.col("n") > OFTEN), held.where(F.col("n") <= OFTEN)]
    for i, df in enumerate(several):
        known = known.join(small(df.select(F.col("sha").alias(f"sha{i}"), F.col("first").alias(f"first{i}"))), F.col("sha") == F.col(f"sha{i}"), "left")
    known = stored(known.withColumn("first", F.coalesce(*(f"first{i}" for i in range(len(several))))).select("doc", "sha", "n_bytes", "tid", "first"))
    # texts of their first holder, long enough to hold a string
    long_rows = rows.where(F.col("doc").isNotNull() & (F.octet_length("text") >= length))
    copies = known.where((F.col("doc") > F.col("first")) & (F.col("n_bytes") >= length)).select(F.col("doc").alias("d"), F.col("tid").alias("t")).distinct()
    singles = long_rows.withColumn("tid", F.xxhash64("text")).join(small(copies), (F.col("doc") == F.col("d")) & (F.col("tid") == F.col("t")), "left_anti")
    places = stored(_shared_anchors(singles, length, gram, crowd))
    release(spark)
    sharing = stored(singles.join(places, "doc"))
    release(spark)
    marks = _marks(_contexts(sharing, "places", length, gram), length, gram, shard_bytes).selectExpr("doc", "tid", ONE_MARK)
    marks = marks.unionByName(_crowded_marks(sharing, length, gram, crowd, shard_bytes, few))
    marks = stored(marks.groupBy(F.col("doc").alias("d"), F.col("tid").alias("t")).agg(F.flatten(F.collect_list("marks")).alias("marks")))
    release(spark)
    marked = sharing.join(marks, (F.col("doc") == F.col("d")) & (F.col("tid") == F.col("t"))).select("doc", "tid", "text", "marks")

    def drop(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part, out = b.slice(i, 64), []
                for d, tid, t, m in zip(*(part.column(j).to_pylist() for j in range(4))):
                    n, runs, kept = strip(t.encode("utf-8", "surrogatepass"), [(x["start"], x["mask"]) for x in m], length)
                    out.append((d, tid, n, runs, hashlib.sha256(kept).hexdigest(), kept if texts else None))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4]), pa.array(cols[5], pa.binary())], names=["md", "mt", "removed", "runs", "kept_sha", "kept"])

    done = marked.mapInArrow(drop, "md long, mt long, removed long, runs long, kept_sha string, kept binary").dropDuplicates(["md", "mt"])
    if not texts:
        done = done.drop("kept")
    out = known.join(done, (F.col("doc") == F.col("md")) & (F.col("tid") == F.col("mt")), "left")
    copy = F.coalesce((F.col("doc") > F.col("first")) & (F.col("n_bytes") >= length), F.lit(False))
    zero = F.lit(0).cast("long")
    picked = [
        F.col("doc").alias(key), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("runs", zero)).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    ]
    if texts:
        picked.append(F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))  # null: the text as it is
    return out.select(*picked)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
