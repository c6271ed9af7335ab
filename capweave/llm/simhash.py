"""Operator 3: SimHash near-duplicates by pigeonhole blocks.

Fingerprint: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, shingles of `width` words joined by one space,
repeats included (fewer words: the whole sequence; none, or a null text: fingerprint zero, linked like any
other). A bit is 1 if it is 1 in over half of the shingles' XXH64 (seed 42) values.

Links: equal texts fall together first, so all that follows works on distinct fingerprints. Their 64 bits
are split in `distance` + 3 blocks; two fingerprints within the distance agree in three blocks at least, so
every triple of blocks is a join key (about 38 bits at distance 2: chance meetings stay rare at any size).
A key with two fingerprints gives one pair, verified by its Hamming distance. A key with more would give
pairs by the square; there each fingerprint lists the points within half the distance instead: two
fingerprints are within the distance if and only if they share a point, so a link from each to the point's
smallest one gives the same components in linear size. No cap, no sampled key.

Components: large-star/small-star over links of distinct fingerprints, on the executors.

Defined results: null key: the row keeps its fingerprint and component, but never names one; repeated rows
give repeated results; an empty table gives no rows; other columns stay out of the result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capweave.llm.common import components, release, scratch, small, stored, table

WIDTH, DISTANCE, SEED = 3, 2, 42
PIECE = 1 << 16
#: byte -> its 8 bits, each in a byte of its own
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def shingle_hashes(text: str | None, width: int):
    """Arrays of the XXH64 of the text's shingles, in pieces of bounded length."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    norm, n, h = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= width:
        yield np.array([h(norm, SEED)], dtype=np.uint64)
        return
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    for i in range(0, n - width + 1, PIECE):
        a, b = starts[i : min(i + PIECE, n - width + 1)].tolist(), ends[i + width - 1 : i + width - 1 + PIECE].tolist()
        yield np.array([h(norm[x:y], SEED) for x, y in zip(a, b)], dtype=np.uint64)


def fingerprints(texts: list, width: int = WIDTH) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text."""
    counts, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if not held:
            return
        lanes = LANES[np.concatenate([h for _, h in held]).view(np.uint8).reshape(-1, 8)]
        cuts, of, at = [], [], 0
        for doc, h in held:
            n = -(-len(h) // 255)  # a byte counts to 255
            cuts.append(at + 255 * np.arange(n))
            of.append(np.full(n, doc))
            at += len(h)
        sums = np.add.reduceat(lanes, np.concatenate(cuts), axis=0).view(np.uint8).reshape(-1, 64)
        owner = np.concatenate(of)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        counts[owner[first]] += np.add.reduceat(sums.astype(np.int64), first, axis=0)
        held.clear()

    size = 0
    for doc, text in enumerate(texts):
        for h in shingle_hashes(text, width):
            held.append((doc, h))
            totals[doc] += len(h)
            size += len(h)
            if size >= 2 * PIECE:
                flush()
                size = 0
    flush()
    return np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view("<u8").ravel()


def with_fingerprint(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long) for every row."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                fp = fingerprints(part.column(1).to_pylist(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["_key", "fp"])

    return rows.mapInArrow(run, T.StructType([T.StructField("_key", rows.schema[0].dataType), T.StructField("fp", T.LongType())]))


def masks(distance: int) -> list[int]:
    """Signed masks, each of three of the distance + 3 blocks."""
    edges = [round(64 * i / (distance + 3)) for i in range(distance + 4)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(blocks, 3))]


def balls(distance: int) -> list[int]:
    """Signed xor patterns of at most half the distance's bits."""
    out = [0]
    for r in range(1, distance // 2 + 1):
        out += [sum(1 << i for i in c) for c in combinations(range(64), r)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v) pairs that give the components of the relation "at most `distance` bits differ" (an even number)."""
    if distance % 2:
        raise ValueError("the distance must be even")
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(distance))])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.m", "k.key")
    met = stored(keyed.groupBy("m", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"))
    pairs = met.where("n = 2").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).select("u", "v").distinct()
    crowded = met.where("n > 2").select("m", "key")
    many = keyed.join(crowded, ["m", "key"], "left_semi").select("fp").distinct()
    points = many.select("fp", F.explode(F.array(*[F.lit(x) for x in balls(distance)])).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("p"))
    shared = points.groupBy("p").agg(F.count("*").alias("n"), F.min("fp").alias("v")).where("n > 1").select("p", "v")
    stars = points.join(shared, "p").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id): component_id is the smallest key reachable over links."""
    marked = stored(with_fingerprint(docs, width, key, text))
    classes = stored(marked.groupBy("fp").agg(F.min("_key").alias("low")))
    found = components(links(classes.select("fp"), distance))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return marked.join(of, "fp").select(F.col("_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def least_common(n: int, similarity: float) -> int:
    """The fewest of n distinct shingles that a text of that Jaccard similarity must share."""
    return int(np.ceil(similarity * n - 1e-9))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)])).view(np.int64)


#: of a set's parity bits; rounds of linking a key's groups, as long as its pairs are over so many times its holders
BITS, TURNS, DENSE = 512, 2, 8
#: keys before a key that go with it, by which a pair that has met already is known
BEFORE = 8


def parity(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bits as longs: each says whether an odd number of the hashes falls on it. Two sets differ in at least as many hashes as bits."""
    odd = np.bincount(hashes.view(np.uint64) % np.uint64(bits), minlength=bits) & 1 if len(hashes) else np.zeros(bits, np.int64)
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_parity(hashes: np.ndarray) -> np.ndarray:
    """Parity bits by a power of two, four or more to a hash: BITS of them tell long sets no longer apart."""
    return parity(hashes, 64 << max(0, (-(-len(hashes) // 16) - 1).bit_length()))


def wide_difference(a: Column, b: Column) -> Column:
    """The places in which two wide parities differ, the one of twice the length folded; 0 where lengths are further apart."""
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda x, y: F.when(F.size(x) == 2 * F.size(y), F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), xor)).otherwise(x)
    places = F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda x, y: F.bit_count(xor(x, y)).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
    return F.coalesce(places, F.lit(0))


def common_shingles(rows: DataFrame, width: int, docs: int = 8192, most: int = 200_000) -> np.ndarray:
    """Shingles that two of about `docs` sampled documents hold, rarest first: they only set an order, so any sample gives the same pairs."""
    n = rows.count()
    few = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(6), "_key"), 32) < int(min(1.0, docs / max(1, n)) * (1 << 32)))

    def run(batches):
        for b in batches:
            for t in b.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, width))], names=["k"])

    held = few.mapInArrow(run, "k long").groupBy("k").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "k").limit(most)
    return np.array([r["k"] for r in held.collect()][::-1], np.int64)


def fingerprint_pairs(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v) of rows (_key, fp), u > v, that give the components of "fingerprints differ in at most `distance` bits".

    Rows of one fingerprint meet its smallest key, and the smallest keys of linked fingerprints meet: linear in the rows.
    """
    classes = stored(rows.groupBy("fp").agg(F.min("_key").alias("low"), F.count("*").alias("c")))
    several = small(classes.where("c > 1").select("fp", "low"))
    within = rows.select("_key", "fp").join(several, "fp").where("_key <> low").select(F.col("_key").alias("u"), F.col("low").alias("v"))
    x, y = (classes.select(F.col("fp").alias(c), F.col("low").alias(f"low{c}")) for c in "uv")
    between = links(classes.select("fp"), distance).join(x, "u").join(y, "v")
    between = between.select(F.greatest("lowu", "lowv").alias("u"), F.least("lowu", "lowv").alias("v"))
    return within.unionAll(between).distinct()


def with_keys_before(holders: DataFrame, most: int = BEFORE) -> DataFrame:
    """Rows (_key, pos, k) with `before`, the last keys of the same document before this one.

    Keys have one order, so a pair that also shares one of those has met under it or an earlier one: the first key that
    a pair shares never has a shared one before it.
    """
    return holders.withColumn("before", F.collect_list("k").over(Window.partitionBy("_key").orderBy("pos").rowsBetween(-most, -1)))


def close_pairs(docs: DataFrame, similarity: float = 0.8, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(u, v): links that give the components of "distinct shingles of `width` words have that Jaccard similarity or more".

    Search: first op3's method: pairs of fingerprints within DISTANCE bits, by pigeonhole blocks. It finds light edits, but not all
    pairs of that similarity, and also unlike texts; so the exact similarity decides on each, and what it can't find comes
    from a prefix filter, which misses no pair. Shingles have one total order, rare ones first (by a sample; the order decides the
    work, not the result). Texts that share s of their n shingles share one of their first n - s + 1, so those, for the least s
    that the similarity allows, are the join keys of a text of any length. Pairs whose sizes and places can't reach the
    similarity go (a shared key's places i, j bound what is left to share), and the rest is verified by the exact similarity.

    Work: equal shingle sets are one class. Then the fingerprints' pairs are tested, and each document meets the one next to it in size under each key. While the documents of a
    key that are not yet in one group would make far more pairs than they are, one of each group, drawn anew, meets that of the
    largest group and those of the three next in size: a crowd of near copies falls together in linear size. What is still apart under a key meets in full, less pairs
    that share one of the few keys before it in both, which have met there. Before sets are
    fetched for a pair, its parity bits must allow the similarity, first a fixed number of them, then as many as the sets are long:
    they differ in no more places than the sets do.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema[0].dataType
    spark = docs.sparkSession
    shared_order = spark.sparkContext.broadcast(common_shingles(rows, width))

    def block(batches):
        common = shared_order.value
        at = np.argsort(common)
        held = common[at]
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sigs, sizes, keys, bits = [], [], [], []
                for t in part.column(1).to_pylist():
                    s = shingle_set(t, width)
                    rank = np.zeros(len(s), np.int64)
                    if len(held):
                        place = np.minimum(np.searchsorted(held, s), len(held) - 1)
                        rank = np.where(held[place] == s, at[place] + 1, 0)
                    sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sizes.append(len(s))
                    bits.append(parity(s))
                    keys.append(s[np.argsort(rank, kind="stable")][: len(s) - least_common(len(s), similarity) + 1])
                fps = pa.array(fingerprints(part.column(1).to_pylist()).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), fps], names=["_key", "sig", "n", "keys", "bits", "fp"])

    keyed = stored(rows.mapInArrow(block, T.StructType([T.StructField("_key", kind), T.StructField("sig", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())])))
    classes = keyed.groupBy("sig").agg(F.min("_key").alias("v"), F.count("*").alias("c")).where("c > 1").select("sig", "v")
    same = stored(keyed.select("sig", F.col("_key").alias("u")).join(classes, "sig").where("u <> v").select("u", "v").distinct())
    once = keyed.join(small(same.select(F.col("u").alias("_copy")).distinct()), F.col("_key") == F.col("_copy"), "left_anti")
    release(spark)

    places = once.select("_key", "n", F.posexplode("keys").alias("pos", "k"))
    order = Window.partitionBy("k").orderBy("n", "_key")
    places = places.withColumn("prev", F.lag(F.struct("_key", "n", "pos")).over(order)).withColumn("next", F.lead("_key").over(order))
    places = stored(places.where(F.col("prev").isNotNull() | F.col("next").isNotNull()).drop("next"))

    release(spark)

    def possible(n, i, m, j):
        """The first key that a pair shares stands at i and j: the shingles before it, and the difference of those after it, are not shared."""
        return (1 + similarity) * (i + j + F.abs((n - i) - (m - j))) <= (1 - similarity) * (n + m) + 1e-6

    def differ(n, m, a, b):
        """The bits in which two sets differ, of which the similarity allows no more than a share of their sizes."""
        bits = sum(F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64))
        return bits * (1 + similarity) <= (1 - similarity) * (n + m) + 1e-6

    def hopeful(pairs: DataFrame) -> DataFrame:
        x, y = (keyed.select(F.col("_key").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "uv")
        return stored(pairs.join(x, "u").join(y, "v").where(differ(F.col("nu"), F.col("nv"), F.col("bitsu"), F.col("bitsv"))).select("u", "v"))

    def shingle(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = [shingle_set(t, width) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array([wide_parity(x) for x in sets], pa.list_(pa.int64()))], names=["_key", "s", "w"])

    def both_sides(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
        """(u, v, a, b): only the column of each u moves to its v."""
        x = sets.join(small(pairs), F.col("_key") == F.col("u")).select("u", "v", F.col(column).alias("a"))
        y = sets.join(small(pairs.select(F.col("v").alias("_id")).distinct()), F.col("_key") == F.col("_id"), "left_semi")
        return x.join(y.select(F.col("_key").alias("v"), F.col(column).alias("b")), "v")

    def verified(pairs: DataFrame) -> DataFrame:
        with scratch(spark, keep=1):
            ids = pairs.select(F.col("u").alias("_id")).union(pairs.select("v")).distinct()
            some = rows.join(small(stored(ids)), F.col("_key") == F.col("_id"), "left_semi")
            longs = T.ArrayType(T.LongType())
            sets = stored(some.mapInArrow(shingle, T.StructType([T.StructField("_key", kind), T.StructField("s", longs), T.StructField("w", longs)])))
            sized = sets.select("_key", F.struct(F.size("s").alias("n"), "w").alias("w"))
            alike = wide_difference(F.col("a.w"), F.col("b.w")) * (1 + similarity) <= (1 - similarity) * (F.col("a.n") + F.col("b.n")) + 1e-6
            pairs = stored(both_sides(pairs, sized, "w").where(alike).select("u", "v"))
            both = both_sides(pairs, sets, "s")
            common = F.size(F.array_intersect("a", "b"))
            return stored(both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v"))

    def pairs_of(rows: DataFrame) -> DataFrame:
        """(u, v) of rows (_key, n, pos, prev) that can be similar, each once."""
        rows = rows.where(F.col("_key") != F.col("prev._key")).where(possible(F.col("n"), F.col("pos"), F.col("prev.n"), F.col("prev.pos")))
        return rows.select(F.greatest("_key", "prev._key").alias("u"), F.least("_key", "prev._key").alias("v")).distinct()

    alike = stored(fingerprint_pairs(once.select("_key", "fp")))
    release(spark)
    tested = stored(pairs_of(places.where(F.col("prev").isNotNull())).unionAll(alike).distinct())
    linked, places = verified(hopeful(tested)), places.drop("prev")
    for turn in range(TURNS + 1):
        roots = stored(components(linked)).select("node", "root")
        apart = places.join(small(roots), F.col("_key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "_key")).drop("node")
        mixed = apart.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("k")
        apart = stored(apart.join(mixed, "k", "left_semi"))
        each = apart.groupBy("k", "root").agg(F.count("*").cast("double").alias("c")).groupBy("k").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own"))
        meets, held = each.agg(F.sum((F.col("c") * F.col("c") - F.col("own")) / 2), F.sum("c")).first()
        if turn == TURNS or meets is None or meets <= DENSE * held:
            break
        one = apart.groupBy("k", "root").agg(F.min_by(F.struct("_key", "n", "pos"), F.xxhash64(F.lit(turn), "_key")).alias("x"), F.count("*").alias("c"))
        order = Window.partitionBy("k").orderBy(F.desc("c"), F.xxhash64(F.lit(turn), "root"), "root")
        one = one.select("x.*", F.array(F.first("x").over(order), *[F.lag("x", i).over(order) for i in range(1, 4)]).alias("prevs")).select("_key", "n", "pos", F.explode("prevs").alias("prev"))
        fresh = stored(pairs_of(one.where(F.col("prev").isNotNull())).join(tested, ["u", "v"], "left_anti"))
        found = verified(hopeful(fresh))
        tested, linked = stored(tested.unionAll(fresh)), stored(linked.unionAll(found))
        if found.isEmpty():
            break
    # both sides carry their bits into the join, so that it makes only pairs that these allow
    release(spark)
    bits = with_keys_before(apart).join(keyed.select("_key", "bits"), "_key")
    x, y = (bits.select("k", *[F.col(c).alias(c + side) for c in ("_key", "n", "pos", "root", "before", "bits")]) for side in "xy")
    both = x.join(y, "k").where((F.col("_keyx") > F.col("_keyy")) & (F.col("rootx") != F.col("rooty"))).where(possible(F.col("nx"), F.col("posx"), F.col("ny"), F.col("posy")))
    both = both.where(~F.arrays_overlap("beforex", "beforey")).where(differ(F.col("nx"), F.col("ny"), F.col("bitsx"), F.col("bitsy")))
    rest = both.select(F.col("_keyx").alias("u"), F.col("_keyy").alias("v")).distinct().join(tested, ["u", "v"], "left_anti")
    return same.unionAll(linked).unionAll(verified(stored(rest)))


def one_of_each(docs: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents less all but the first key of each group of near copies, and less repeats of a row; rows without a key stay.

    Groups: components of pairs of that similarity in words of five; texts without a word are copies. Pairs within op3's two bits are
    searched first and are among them if they have that similarity, and stay apart if they don't. Rows of one key with different texts are documents of
    their own, each removed only for what its own text is like.
    """
    rows = docs.where(F.col(key).isNotNull())
    h = F.xxhash64(F.lit(3), F.coalesce(F.col(text), F.lit("")))
    shared = rows.groupBy(key).agg(F.min(h).alias("a"), F.max(h).alias("b"), F.count("*").alias("n"))
    several, repeats = shared.agg(F.max((F.col("a") != F.col("b")).cast("int")), F.max("n")).first()
    own = F.struct(F.col(key).alias("k"), h.alias("h")) if several else F.col(key)
    keyed = rows.withColumn("_own", own)
    spark = docs.sparkSession
    release(spark)
    with scratch(spark, keep=1):
        groups = components(close_pairs(keyed, similarity, key="_own", text=text))
        found = stored(groups.where("node <> root").select(F.col("node").alias("_copy")))
    release(spark)
    kept = keyed.join(small(found), F.col("_own") == F.col("_copy"), "left_anti")
    if repeats and repeats > 1:  # repeats of one row: any will do, as they have one key and one text
        kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy("_own").orderBy(F.lit(0)))).where("_n = 1")
    return kept.select(*docs.columns).unionAll(docs.where(F.col(key).isNull()))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
