"""Operator 7: mixing sources to target weights by weighted fair queueing.

Every document's words are its size. Sources in code-point order (null last) weigh 5, 2, 1, repeating,
and share all words by weight; a target stops at max_epochs times its source's words, and the excess is
shared again. Within a source, documents stand in a seeded hash order; a copy of a document finishes at
virtual time (words of its source up to it, repeats counted) / target. Copies of all sources are ranged
by finish time and taken from the front until the next one would exceed the total budget.

Scale: no window ever holds a whole source. Both running sums are two-level: sums per (source, slice of
the hash order) or per slice of virtual time, whose number is fixed, then rows within a slice. A source
with a third of all rows is spread over all slices; virtual time serves all sources at an even rate, so
its slices are even too.

Defined results: null text or no word: size 0, taken 0; null source: a source of its own; no rows: no rows;
repeated rows: each is a document of its own; other columns of the input stay out of the result, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capweave.llm.common import cut, release, small, stored, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SLICES = 1024


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """(_source, source_size, target) of a table with columns _source and size.

    The level L with sum(min(cap, L * weight)) = budget is the largest (budget - caps so far) / weight left
    over all prefixes of the sources ordered by cap / weight, so two running sums over the sources and one
    max find it: no rounds of resharing.
    """
    per = cut(sizes.groupBy("_source").agg(F.sum("size").alias("source_size")))
    # one row per source: ranked in code-point order
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weighed = per.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("_cap", F.col("source_size").cast("double") * max_epochs)
    w = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = weighed.withColumn("_caps", F.sum("_cap").over(w)).withColumn("_ws", F.sum("_w").over(w))
    total = ranked.agg(F.sum("source_size").alias("_b"), F.sum("_w").alias("_wall"))
    budget = F.coalesce(F.col("_b"), F.lit(0)) * share
    steps = ranked.crossJoin(F.broadcast(total)).select(
        (budget / F.col("_wall")).alias("_first"),
        F.when(F.col("_wall") > F.col("_ws"), (budget - F.col("_caps")) / (F.col("_wall") - F.col("_ws"))).alias("_next"),
    )
    level = steps.agg(F.greatest(F.max("_first"), F.max("_next")).alias("_level"))
    return weighed.crossJoin(F.broadcast(level)).select("_source", "source_size", F.least("_cap", F.coalesce("_level", F.lit(0.0)) * F.col("_w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """One row per document: key, size, source_size, target, taken, copies, first_finish (virtual time).

    row: a column that tells rows without a key apart (null for the others); it comes last in the result.
    """
    own = F.col(row) if row else F.lit(None).cast("string")
    sized = stored(docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), word_count(F.col(text)).alias("size"), own.alias("_row")))
    targets = source_targets(sized, weights, max_epochs)
    # hash order of the documents of a source, cut in slices by ten of its bits
    keyed = sized.withColumn("_h", F.xxhash64(F.lit(seed), F.col("_key"), F.col("size"), F.col("_row"))).withColumn("_slice", F.pmod(F.shiftright("_h", 40), F.lit(SLICES)))
    per_slice = keyed.groupBy("_source", "_slice").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("_source", "_slice").orderBy("_h", F.col("_key").asc_nulls_last(), "size", "_row").rowsBetween(Window.unboundedPreceding, 0)
    starts = starts.join(targets.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    starts = starts.select(F.col("_source").alias("_s"), F.col("_slice").alias("_sl"), "_start", "source_size", "target")
    placed = keyed.withColumn("_in", F.sum("size").over(within))
    placed = placed.join(starts, (F.col("_source").eqNullSafe(F.col("_s"))) & (F.col("_slice") == F.col("_sl"))).drop("_s", "_sl")
    placed = stored(placed.select("_key", "_row", "_source", "_h", "size", "source_size", "target", (F.col("_start") + F.col("_in")).alias("_end")))

    # a copy joins the queue if it starts before its source has its target: at most one starts inside and ends past it
    epochs = F.array(*[F.lit(e) for e in range(max_epochs)])
    end = (F.col("_e") * F.col("source_size") + F.col("_end")).cast("double")
    copies = placed.where("size > 0 and target > 0").withColumn("_e", F.explode(epochs))
    copies = copies.withColumn("_vf", end / F.col("target")).where((end - F.col("size")) / F.col("target") < 1.0)
    copies = copies.withColumn("_range", F.floor(F.col("_vf") * SLICES))
    budget = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_budget"))

    # which range of virtual time holds the end of the budget, then which copy in it
    ranges = copies.groupBy("_range").agg(F.sum("size").alias("_n"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("_sum", F.sum("_n").over(upto)).crossJoin(F.broadcast(budget))
    crossing = ranges.where("_sum > _budget").agg(F.min("_range").alias("_cross"), F.min(F.struct("_range", (F.col("_sum") - F.col("_n")).alias("b"), "_budget")).alias("_at"))
    order = ["_vf", F.col("_source").asc_nulls_last(), "_h", F.col("_key").asc_nulls_last(), "_row", "_e"]
    inside = copies.join(F.broadcast(crossing.where("_cross is not null")), F.col("_range") == F.col("_cross"))
    inside = inside.withColumn("_cum", F.col("_at.b") + F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    at = inside.where("_cum > _at._budget").agg(F.min("_vf").alias("_cut"))
    at = cut(at.crossJoin(crossing.select("_cross")))
    # the copies that stand before the first one that no longer fits; ties of virtual time with it stay out together
    taken = placed.crossJoin(F.broadcast(at))
    vf = [(F.lit(e) * F.col("source_size") + F.col("_end")).cast("double") / F.col("target") for e in range(max_epochs)]
    begin = [(F.lit(e) * F.col("source_size") + F.col("_end") - F.col("size")).cast("double") / F.col("target") for e in range(max_epochs)]
    n = sum((((F.col("size") > 0) & (F.col("target") > 0) & (begin[e] < 1.0) & (F.col("_cut").isNull() | (vf[e] < F.col("_cut")))).cast("long") for e in range(max_epochs)), F.lit(0))
    n = F.coalesce(n, F.lit(0))
    return taken.select(
        F.col("_key").alias(key), F.col("_source").alias(source), "size", "source_size", "target",
        (n * F.col("size")).alias("taken"), n.alias("copies"), F.when(F.col("target") > 0, vf[0]).alias("first_finish"), *([F.col("_row").alias(row)] if row else []),
    )


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents that the mix takes, all their columns plus copies, ranged by first finish time.

    Rows whose key is null or repeated get one of their own, from their key, text, source and a number among equals.
    """
    release(docs.sparkSession)
    again = stored(docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_again")).agg(F.count("*").alias("_c")).where("_c > 1").select("_again"))
    odd = docs.where(F.col(key).isNull())
    if not again.isEmpty():
        odd = odd.unionByName(docs.join(small(again), F.col(key) == F.col("_again"), "left_semi"))
    same = [F.col(key), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), F.col(source)]
    number = F.row_number().over(Window.partitionBy(*same).orderBy(*same))
    known = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in same]
    # stored, so that a row has the same number in the mix and in the join
    odd = stored(odd.withColumn("_row", F.concat_ws("|", *known, number.cast("string"))))
    plain = docs.where(F.col(key).isNotNull()).join(small(again), F.col(key) == F.col("_again"), "left_anti")
    rows = plain.withColumn("_row", F.lit(None).cast("string")).unionByName(odd)
    decided = stored(mix(rows, key=key, text=text, source=source, row="_row", **options).where("copies > 0"))
    chosen = decided.select(F.col(key).alias("_k"), F.col("_row").alias("_r"), F.col("copies").alias("_copies"), F.col("first_finish").alias("_first"))
    named = plain.join(small(chosen.where("_r is null").drop("_r")), F.col(key) == F.col("_k")).drop("_k")
    out = named.unionByName(odd.join(chosen.where("_r is not null"), F.col("_row") == F.col("_r")).drop("_row", "_r", "_k"))
    return out.repartitionByRange("_first").sortWithinPartitions("_first", key).withColumnRenamed("_copies", "mix_copies").withColumnRenamed("_first", "mix_finish")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
