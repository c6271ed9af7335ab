"""Operator 6: license scans by diagonal voting.

Words: A-Z lower-cased, runs of 0-9, a-z and non-ASCII bytes. Base places are those where the words of a fixed
phrase stand in a row. Beyond them, templates of known notices are found in any text: all rolling word k-gram hashes
of the documents are joined to the templates' k-grams, each hit votes for its diagonal (document position less
template position), diagonals of a document and template at most half the template's length apart merge (words added or left
out shift the diagonal), and each merged span is verified: the longest common word sequence of span and template, read from the text,
must hold `threshold` of the template's words.

Scale: the templates are a fixed table and are broadcast. A k-gram with a word that no template holds can't join and is
not emitted, so ordinary prose gives few rows; hits are counted by (document, template, diagonal) before any shuffle.
Spans go back to the documents by broadcast while they are few (checked), by a join on the document beyond that.

Defined results: null text: an empty one; no words: zero counts, null places, empty labels, score 0; repeated rows:
repeated results (a row is known by its id and its text's hash); null ids are kept; an empty table gives no rows;
other columns stay out of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capweave.llm.common import small, stored, table

K, GAP, VOTE_SHARE, SHORT, THRESHOLD = 4, 3, 0.4, 12, 0.8
#: fixed values: phrase, label
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: public license notices: label, text
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
_TO_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def base_places(words: list[bytes], phrases=PHRASES) -> list[tuple[int, str]]:
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        want, at = f" {phrase} ".encode(), -1
        while (at := joined.find(want, at + 1)) >= 0:
            out.append((joined.count(b" ", 0, at), label))
    return out


class Templates:
    def __init__(self, templates=TEMPLATES, k: int = K) -> None:
        self.k, self.labels = k, [label for label, _ in templates]
        self.words = [words_of(t) for _, t in templates]
        if any(len(w) < k for w in self.words):
            raise ValueError(f"a template has fewer than {k} words")
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for t in self.words for w in t}))}

    def grams(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the word k-grams that hold template words only."""
        ids = np.fromiter(map(self.ids.get, words, (0 for _ in words)), np.uint64, len(words))
        if len(ids) < self.k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(ids) - self.k + 1
        every, h = np.ones(n, bool), np.zeros(n, np.uint64)
        for i in range(self.k):
            part = ids[i : i + n]
            every &= part > 0
            h = (h ^ part) * _MIX
            h ^= h >> np.uint64(29)
        at = np.flatnonzero(every)
        return at, h[at].view(np.int64)

    def coverage(self, template: int, words: list[bytes]) -> float:
        """Longest common word sequence of the template and a span, as a share of the template."""
        want = self.words[template]
        row = np.zeros(len(want) + 1, np.int64)
        target = np.array([self.ids[w] for w in want])
        for w in words:
            same = target == self.ids.get(w, 0)
            diagonal = np.concatenate([[0], np.where(same, row[:-1] + 1, 0)])
            row = np.maximum.accumulate(np.maximum(row, diagonal))
        return float(row[-1]) / len(want)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text")).select("_key", "_hash", "_text")


def base(docs: DataFrame, phrases=PHRASES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _hash, n_words, n_base, first_word, last_word, base_labels) for every row."""
    rows = _keyed(docs, key, text)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                out = []
                for t in part.column(2).to_pylist():
                    w = words_of(t)
                    p = base_places(w, phrases)
                    at = [x for x, _ in p]
                    out.append((len(w), len(p), min(at, default=None), max(at, default=None), sorted({x for _, x in p})))
                n, m, lo, hi, labels = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.int64()) for x in (n, m, lo, hi)), pa.array(labels, pa.list_(pa.string()))], names=out_schema.names)

    out_schema = T.StructType([rows.schema["_key"], T.StructField("_hash", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")), T.StructField("_base", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(run, out_schema)


def template_spans(docs: DataFrame, templates=TEMPLATES, k: int = K, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _hash, label, first, last, coverage): verified spans of templates, in words of the document."""
    spark, known, rows = docs.sparkSession, Templates(templates, k), _keyed(docs, key, text)
    shared = spark.sparkContext.broadcast(templates)
    gram_type = T.StructType([rows.schema["_key"], T.StructField("_hash", T.LongType()), T.StructField("_grams", T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("gram", T.LongType())])))])
    arrow_grams = pa.list_(pa.struct([("pos", pa.int64()), ("gram", pa.int64())]))

    def roll(batches):
        t = Templates(shared.value, k)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                found = [t.grams(words_of(x)) for x in part.column(2).to_pylist()]
                offsets = pa.array(np.cumsum([0, *(len(p) for p, _ in found)]), pa.int32())
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate([p for p, _ in found]), pa.int64()), pa.array(np.concatenate([h for _, h in found]), pa.int64())], names=["pos", "gram"])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, flat).cast(arrow_grams)], names=gram_type.names)

    positions = [(n, int(p), int(h), len(w)) for n, w in enumerate(known.words) for p, h in zip(*known.grams(w))]
    places = F.broadcast(spark.createDataFrame(positions, "template int, tpos long, gram long, n_template int"))  # fixed size
    grams = rows.mapInArrow(roll, gram_type).where(F.size("_grams") > 0).select("_key", "_hash", F.explode("_grams").alias("g")).select("_key", "_hash", "g.pos", "g.gram")
    votes = grams.join(places, "gram").groupBy("_key", "_hash", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("n_template").alias("n_template"))
    # diagonals at most GAP, or half the template, apart belong to one span
    order = Window.partitionBy("_key", "_hash", "template").orderBy("diagonal")
    marked = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > F.greatest(F.lit(GAP), F.floor(F.col("n_template") / 2))).cast("int"))
    grouped = marked.withColumn("span", F.coalesce(F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    spans = grouped.groupBy("_key", "_hash", "template", "span").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("diagonal").alias("lo"), F.max("diagonal").alias("hi"), F.first("n_template").alias("n_template"))
    # a changed word costs k votes at most; in a short template one word can name another license, so there a share of the votes is asked for
    sure = F.col("n_template") - (k - 1) - k * F.floor(F.col("n_template") * (1 - threshold) + 1e-9)
    least = F.when(F.col("n_template") < SHORT, F.ceil((F.col("n_template") - (k - 1)) * VOTE_SHARE)).otherwise(sure)
    spans = spans.where(F.col("votes") >= F.greatest(F.lit(1), least))
    each = spans.select("_key", "_hash", F.struct("template", F.greatest(F.col("lo"), F.lit(0)).alias("first"), (F.col("hi") + F.col("n_template")).alias("last")).alias("s"))
    candidates = stored(each.groupBy("_key", "_hash").agg(F.collect_list("s").alias("spans")))  # bounded by the document's own length
    c = small(candidates).withColumnsRenamed({"_key": "_k", "_hash": "_h"})
    texts = rows.join(c, rows["_key"].eqNullSafe(F.col("_k")) & (rows["_hash"] == F.col("_h"))).select("_key", "_hash", "_text", "spans")
    out = T.StructType([rows.schema["_key"], T.StructField("_hash", T.LongType()), T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("coverage", T.DoubleType())])

    def verify(batches):
        t = Templates(shared.value, k)
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                w, hits = words_of(one.column(2)[0].as_py()), []
                for s in one.column(3)[0].as_py():
                    cover = t.coverage(s["template"], w[s["first"] : s["last"]])
                    if cover >= threshold:
                        hits.append((t.labels[s["template"]], s["first"], min(s["last"], len(w)), cover))
                if hits:
                    n = len(hits)
                    names, first, last, cover = zip(*hits)
                    yield pa.RecordBatch.from_arrays([pa.array([one.column(0)[0].as_py()] * n, one.schema.field(0).type), pa.array([one.column(1)[0].as_py()] * n, pa.int64()), pa.array(names), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(cover)], names=out.names)

    return texts.mapInArrow(verify, out)


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = template_spans(docs, templates, key=key, text=text).groupBy("_key", "_hash").agg(F.collect_set("label").alias("_more"), F.max("coverage").alias("_cover"))
    found = small(stored(found)).withColumnsRenamed({"_key": "_k", "_hash": "_h"})
    own = base(docs, phrases, key, text)
    j = own.join(found, own["_key"].eqNullSafe(F.col("_k")) & (own["_hash"] == F.col("_h")), "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    return j.select(
        F.col("_key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("_cover", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
