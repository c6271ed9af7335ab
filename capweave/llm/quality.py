"""Operator 9: quality by hashed word n-gram logistic regression with follow-the-regularised-leader updates.

Every word of a text (white-space separated) counts by its lower-cased form and by its shape (classes of
characters, runs collapsed; a repeat of the word before is a shape of its own); both give unigrams and bigrams, hashed
to 2 ** BITS weights. A text's features are the counts divided by its words, and its score is the logistic of their
dot product with the weights.

Training: at most `per_class` labelled rows of each label (a documented bound), dealt to `shards` tasks by
hash; each makes `epochs` of per-coordinate FTRL-proximal steps in a fixed order and the shards' weights
are averaged. The label's share among all training rows corrects the intercept.

Defined results: null or empty texts get the intercept's score; no labelled rows: 0.5 for all;
repeated rows: repeated results; other columns stay out of the result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capweave.llm.common import crc_of, labelled_sample, table

BITS, PER_CLASS, SHARDS, EPOCHS = 18, 2000, 4, 3
ALPHA, BETA, L1, L2, SCALE = 0.3, 1.0, 0.02, 0.1, 8.0
PIECE = 1 << 16
RUNS = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "9"), (re.compile(r"(.)\1+", re.S), r"\1"))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> str:
    def letters(m: re.Match) -> str:
        w = m[0]
        return "a" if w.islower() else ("A" if len(w) > 1 else "B") if w.isupper() else "Aa" if w[0].isupper() else "aA"

    s = RUNS[0][0].sub(letters, word)
    return RUNS[2][0].sub(r"\1", RUNS[1][0].sub("9", s))


class Words:
    """Word -> two hashes, remembered up to a bound."""

    def __init__(self, most: int = 300_000) -> None:
        self.known: dict[str, tuple[int, int]] = {}
        self.most = most

    def __call__(self, word: str) -> tuple[int, int]:
        h = self.known.get(word)
        if h is None:
            if len(self.known) >= self.most:
                self.known.clear()
            h = self.known[word] = (zlib.crc32(word.lower().encode("utf-8", "surrogatepass")), zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) + (1 << 33))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)


def features(text: str | None, words: Words):
    """Arrays of hashed feature numbers of a text's words, with repeats, in pieces of bounded length."""
    w = (text or "").split()
    for i in range(0, len(w), PIECE):
        h = np.array([words(x) for x in w[max(0, i - 1) : i + PIECE]], np.uint64).reshape(-1, 2)
        same = np.r_[False, (h[1:, 0] == h[:-1, 0])]
        h[same, 1] = np.uint64(1 << 40)
        pair = h[1:] + h[:-1] * np.uint64(0x100000001B3) + np.uint64(1 << 50)
        own = h[1 if i else 0 :]
        yield np.concatenate([_mix(own.ravel()), _mix(pair.ravel())]).astype(np.int64)


def sparse(text: str | None, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values)."""
    total = len((text or "").split())
    idx, n = np.zeros(0, np.int64), np.zeros(0)
    for f in features(text, words):
        u, c = np.unique(np.concatenate([idx, f]), return_inverse=True)
        n = np.bincount(c, np.concatenate([n, np.ones(len(f))]), len(u))
        idx = u
    return idx, SCALE * n / max(1, total)


def ftrl(rows: list[tuple[int, str | None]], epochs: int) -> tuple[np.ndarray, float]:
    """(weights, intercept) of one shard."""
    size = (1 << BITS) + 1  # the last one is the intercept, without penalty
    z, n = np.zeros(size), np.zeros(size)
    words = Words()
    data = [(y, *sparse(t, words)) for y, t in rows]

    def weights(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    for _ in range(epochs):
        for y, idx, x in data:
            i, v = np.append(idx, size - 1), np.append(x, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -30, 30))) - y) * v
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange(size))
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, shards: int = SHARDS, epochs: int = EPOCHS, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, float]:
    """(weights, intercept)."""
    sample, share = labelled_sample(docs, labels, label, per_class, 9, key, text)
    dealt = sample.withColumn("h", F.xxhash64(F.lit(9), "text", "label")).withColumn("shard", F.pmod("h", F.lit(shards)))

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["h", "label"], kind="stable")
        w, b = ftrl(list(zip(pdf["label"].tolist(), pdf["text"].tolist())), epochs)
        at = np.flatnonzero(w)
        n1 = int(pdf["label"].sum())
        return pd.DataFrame({"i": np.append(at, -1), "w": np.append(w[at], b), "n1": n1, "n0": len(pdf) - n1})

    got = dealt.groupBy("shard").applyInPandas(fit, "i long, w double, n1 long, n0 long").toPandas()  # at most shards * 2 ** BITS numbers
    weights = np.zeros(1 << BITS)
    if not len(got):
        return weights, 0.0
    last = got[got["i"] < 0]
    n = max(1, len(last))
    own = got[got["i"] >= 0]
    np.add.at(weights, own["i"].to_numpy(), own["w"].to_numpy() / n)
    n1, n0 = last["n1"].sum(), last["n0"].sum()
    bias = float(last["w"].mean())
    if n1 and n0 and 0 < share < 1:
        bias += float(np.log(share / (1 - share)) - np.log(n1 / n0))
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row."""
    at = np.flatnonzero(model[0])
    shared = docs.sparkSession.sparkContext.broadcast((at, model[0][at], model[1]))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches):
        at, values, bias = shared.value
        weights, words = np.zeros(1 << BITS), Words()
        weights[at] = values
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                out = []
                for t in part.column(1).to_pylist():
                    total = sum(weights[f].sum() for f in features(t, words))
                    out.append(bias + SCALE * total / max(1, len((t or "").split())))
                p = 1 / (1 + np.exp(-np.clip(np.array(out), -60, 60)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], names=["_key", "score"])

    return rows.mapInArrow(run, T.StructType([T.StructField("_key", rows.schema[0].dataType), T.StructField("score", T.DoubleType())])).withColumnRenamed("_key", key)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_of(F.col("doc_id")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
