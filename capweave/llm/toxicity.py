"""Operator 8: toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding: lower case, look-alike letters of other scripts to Latin ones, digits and signs that stand for letters to
those letters, and l to i (so 1 can stand for both); words are then the runs of letters. The lexicon holds whole
words and word beginnings with log-odds weights; exception phrases of two words silence a match inside them. A
text's raw score is the sum of the matches' weights for 100 words, and a logistic curve makes it a probability.

Training: at most `per_class` labelled rows of each label (a documented bound) give the document frequencies of words
and beginnings, the phrases in which entries are harmless, and the curve; the label's share among all training
rows corrects its intercept.

Defined results: null or empty texts have no match and get the curve's value at zero; no labelled rows: an
empty lexicon and score 0 for all; repeated rows: repeated results; other columns stay out of the result.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capweave.llm.common import crc_of, labelled_sample, table

PER_CLASS, ENTRIES, MIN_DOCS, MIN_WEIGHT, MIN_Z = 2000, 4000, 5, 2.0, 4.0
LETTERS = re.compile(r"[^\W\d_]+")
#: letters of other scripts that look like Latin ones
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "i", "ℓ": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "l": "i"}
FOLD = str.maketrans(LOOKALIKES | DIGITS | {chr(0xFF41 + i): chr(97 + i) if chr(97 + i) != "l" else "i" for i in range(26)})
SIGNS = re.compile(r"[@$!|](?=[^\W\d_])")
SIGN = {"@": "a", "$": "s", "!": "i", "|": "i"}


def fold(text: str | None) -> str:
    """The folded words of a text, one space around each."""
    t = (text or "").lower()
    if "@" in t or "$" in t or "!" in t or "|" in t:
        t = SIGNS.sub(lambda m: SIGN[m[0]], t)
    return " " + " ".join(LETTERS.findall(t.translate(FOLD))) + " "


def beginnings(words: set[str]) -> set[str]:
    """Entries that a set of words could support: ' word ' and ' beginning'."""
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in range(3, min(8, len(w)) + 1)}


class Lexicon:
    def __init__(self, entries: dict[str, float], exceptions: list[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for e, w in entries.items():
            self.automaton.add_word(e, (len(e), w))
        for e in exceptions:
            self.automaton.add_word(e, (len(e), 0.0))
        self.any = bool(entries)
        if self.any:
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start of the word, end, weight): the heaviest entry of each matched word outside exception phrases."""
        if not self.any:
            return []
        best: dict[int, tuple[int, int, float]] = {}
        quiet = []
        for end, (n, w) in self.automaton.iter(folded):
            start = end - n + 1
            if w == 0.0:
                quiet.append((start, end))
            elif start not in best or w > best[start][2]:
                best[start] = (start, end, w)
        # the furthest end of the phrases that start up to each place: a match inside one of them is told by one look
        quiet.sort()
        starts, reach = [a for a, _ in quiet], list(accumulate((b for _, b in quiet), max))
        outside = lambda m: (i := bisect_right(starts, m[0])) == 0 or m[1] > reach[i - 1] + 1
        return [m for m in best.values() if outside(m)]

    def density(self, text: str | None) -> float:
        folded = fold(text)
        found = self.matches(folded)
        return 100.0 * sum(w for _, _, w in found) / (folded.count(" ") - 1) if found else 0.0


def weigh(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio of document frequencies a of na and b of nb, and its z-value."""
    parts = [a + 0.5, na - a + 0.5, b + 0.5, nb - b + 0.5]
    weight = np.log(parts[0] / parts[1]) - np.log(parts[2] / parts[3])
    return weight, weight / np.sqrt(sum(1 / p for p in parts))


def select(counts: list[tuple[str, int, int]], na: int, nb: int) -> dict[str, float]:
    """Entries of enough weight and certainty; a longer one stays only if it says clearly more than a beginning of it."""
    if not counts:
        return {}
    a, b = np.array([c[1] for c in counts], float), np.array([c[2] for c in counts], float)
    weight, z = weigh(a, b, na, nb)
    good = {c[0]: (float(w), int(c[1])) for c, w, y in zip(counts, weight, z) if c[1] >= MIN_DOCS and w >= MIN_WEIGHT and y >= MIN_Z}
    out: dict[str, float] = {}
    for e in sorted(good, key=lambda e: (len(e), e)):
        shorter = [out[e[:n]] for n in range(2, len(e)) if e[:n] in out]
        if not shorter or good[e][0] > max(shorter) + 1.0:
            out[e] = good[e][0]
    return out


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, rounds: int = 50) -> np.ndarray:
    """(intercept, slope) by Newton steps with a ridge on the slope."""
    X, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (p - y) + l2 * np.array([0.01, 1.0]) * w
        H = (X * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ X + l2 * np.diag([0.01, 1.0])
        step = np.linalg.solve(H, g)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple:
    """(entries, exceptions, curve)."""
    sample, share = labelled_sample(docs, labels, label, per_class, 8, key, text)
    sample = sample.cache()
    spark = docs.sparkSession
    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    na, nb = n.get(1, 0), n.get(0, 0)
    if not na or not nb:
        sample.unpersist()
        return {}, [], np.array([-50.0, 0.0])

    def count(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for e in beginnings(set(fold(t).split())):
                    seen.setdefault(e, [0, 0])[1 - y] += 1
        if seen:
            v = list(seen.values())
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array([x[0] for x in v], pa.int64()), pa.array([x[1] for x in v], pa.int64())], names=["e", "a", "b"])

    df = sample.mapInArrow(count, "e string, a long, b long").groupBy("e").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= MIN_DOCS)
    odds = F.log((F.col("a") + 0.5) / (F.lit(na) - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (F.lit(nb) - F.col("b") + 0.5))
    top = df.withColumn("w", odds).where(F.col("w") >= MIN_WEIGHT).orderBy(F.desc(F.col("w") * F.sqrt("a")), "e").limit(ENTRIES)
    entries = select([(r["e"], r["a"], r["b"]) for r in top.collect()], na, nb)
    first = spark.sparkContext.broadcast(entries)

    def phrases(batches):
        lexicon, seen = Lexicon(first.value, []), {}
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folded = fold(t)
                around = set()
                for start, _, _ in lexicon.matches(folded):
                    end = folded.index(" ", start + 1)
                    if start:
                        around.add(folded[folded.rindex(" ", 0, start) : end + 1])
                    if end + 1 < len(folded):
                        around.add(folded[start : folded.index(" ", end + 1) + 1])
                for p in around:
                    seen.setdefault(p, [0, 0])[1 - y] += 1
        if seen:
            v = list(seen.values())
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array([x[0] for x in v], pa.int64()), pa.array([x[1] for x in v], pa.int64())], names=["e", "a", "b"])

    harmless = sample.mapInArrow(phrases, "e string, a long, b long").groupBy("e").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    harmless = harmless.where((F.col("b") >= 3) & (F.col("a") * 10 <= F.col("b"))).orderBy(F.desc("b"), "e").limit(ENTRIES)
    exceptions = sorted(r["e"] for r in harmless.collect())
    both = spark.sparkContext.broadcast((entries, exceptions))

    def densities(batches):
        lexicon = Lexicon(*both.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lexicon.density(t) for t in b.column(1).to_pylist()], pa.float64())], names=["y", "x"])

    points = sample.mapInArrow(densities, "y int, x double").collect()  # two numbers for each row of the sample
    sample.unpersist()
    curve = logistic(np.log1p([r["x"] for r in points]), np.array([r["y"] for r in points], float))
    curve[0] += np.log(share / (1 - share)) - np.log(na / nb) if 0 < share < 1 else 0.0
    return entries, exceptions, curve


def score(docs: DataFrame, model: tuple, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, matches) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches):
        entries, exceptions, curve = shared.value
        lexicon = Lexicon(entries, exceptions)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                x = np.log1p([lexicon.density(t) for t in part.column(1).to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * x, -60, 60)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], names=["_key", "score"])

    return rows.mapInArrow(run, T.StructType([T.StructField("_key", rows.schema[0].dataType), T.StructField("score", T.DoubleType())])).withColumnRenamed("_key", key)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_of(F.col("doc_id")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
