"""Operator 2: language identification by segmentation-marginalised unigrams.

For each language, every piece of a fixed public vocabulary has a probability. A word's probability is the sum
over all its segmentations in pieces of the product of their probabilities, by a forward recursion over the
word's letters; a text's is the product over its words. The prediction is the language with the highest
posterior under equal priors, and the score is that posterior.

Words are runs of letters of the lower-cased text, with the vocabulary's mark of a word's start before them;
runs of over 32 letters are taken 32 at a time. A letter that is no piece counts as a piece of a fixed small
probability. Whole texts are scored.

Training: expectation-maximisation over word counts of at most `sample_docs` labelled documents a language
(the first ones in a seeded hash order of doc_id; the bound is this parameter). The counts stay distributed; the
driver holds one number for each piece and language.

Defined results: null text or no letter: `und`, score 0; no labelled rows: `und` for all; ties: the language
whose name sorts first; repeated rows: repeated results; other columns stay out of the result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capweave.llm.common import crc_of, small, stored, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE_DOCS, ROUNDS, LONGEST, CACHE = 1000, 3, 32, 400_000
START = "▁"
UNKNOWN = 1e-7
LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces that can occur in a lower-cased word, in the file's order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [p for p in pieces if (w := p.removeprefix(START)) == w.lower() and (p == START or LETTERS.fullmatch(w))]


class Pieces:
    """Finds the pieces of many words at once."""

    def __init__(self, pieces: list[str]) -> None:
        keys = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            h = np.uint64(len(p))
            with np.errstate(over="ignore"):
                for c in p:
                    h = (h * _BASE + np.uint64(ord(c))) * _SPREAD
            keys[i] = h
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.longest = max(map(len, pieces), default=1)
        self.none = len(pieces)  # row of the probability table that is zero
        self.unknown = len(pieces) + 1

    def spans(self, words: list[str]):
        """For words of one length with the start mark: (start, length, piece of each word); `none` where there is no such piece."""
        codes = np.array(words, dtype=f"U{len(words[0])}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)
        n = codes.shape[1]
        for length in range(1, min(self.longest, n) + 1):
            h = np.full((len(words), n - length + 1), length, np.uint64)
            for i in range(length):
                h = (h * _BASE + codes[:, i : n - length + 1 + i]) * _SPREAD
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            found = np.where(self.keys[at] == h, self.order[at], self.none)
            if length == 1:
                found = np.where(found == self.none, self.unknown, found)
            for start in range(n - length + 1):
                yield start, length, found[:, start]

    def forward(self, words: list[str], probs: np.ndarray, spans=None) -> np.ndarray:
        """(word, position, language) sums over the segmentations of each prefix."""
        n = len(words[0])
        alpha = np.zeros((len(words), n + 1, probs.shape[1]))
        alpha[:, 0] = 1.0
        for start, length, piece in sorted(spans or self.spans(words), key=lambda s: s[0]):
            alpha[:, start + length] += alpha[:, start] * probs[piece]
        return alpha

    def expected(self, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """(piece, language) expected uses, given (word, language) counts."""
        n = len(words[0])
        spans = [s for s in self.spans(words) if (s[2] != self.none).any()]
        alpha = self.forward(words, probs, spans)
        beta = np.zeros_like(alpha)
        beta[:, n] = 1.0
        for start, length, piece in sorted(spans, key=lambda s: -s[0]):
            beta[:, start] += beta[:, start + length] * probs[piece]
        share = counts / np.maximum(alpha[:, n], 1e-300)
        out = np.zeros_like(probs)
        for start, length, piece in spans:
            use = alpha[:, start] * probs[piece] * beta[:, start + length] * share
            for k in range(probs.shape[1]):
                out[:, k] += np.bincount(piece, use[:, k], minlength=len(probs))
        return out


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def cut_words(words: list[str]) -> list[str]:
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)] if any(len(w) > LONGEST for w in words) else words


def by_length(words: list[str], most: int = 20_000):
    """(positions, words with the start mark) of one length each."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for g in groups.values():
        for i in range(0, len(g), most):
            yield g[i : i + most], [START + words[j] for j in g[i : i + most]]


class Model:
    def __init__(self, pieces: list[str], languages: list[str], probs: np.ndarray) -> None:
        self.pieces, self.languages, self.probs = pieces, languages, probs

    def start(self) -> None:
        self.finder, self.known, self.logs = Pieces(self.pieces), {}, np.zeros((1 << 16, len(self.languages)))

    def log_probs(self, words: list[str]) -> None:
        """Makes sure that all words are known."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(dict.fromkeys(words))
        base = len(self.known)
        while base + len(new) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        for at, group in by_length(new):
            alpha = self.finder.forward(group, self.probs)[:, -1]
            self.logs[base + np.array(at)] = np.log(np.maximum(alpha, 1e-300))
        self.known.update(zip(new, range(base, base + len(new))))

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        docs = [cut_words(words_of(t)) for t in texts]
        self.log_probs([w for d in docs for w in d])
        names, scores = [], []
        for d in docs:
            if not self.languages or not any(c.isalpha() for w in d for c in w):
                names.append("und")
                scores.append(0.0)
                continue
            total = self.logs[np.fromiter(map(self.known.__getitem__, d), np.int64, len(d))].sum(axis=0)
            best = int(total.argmax())
            names.append(self.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return names, scores


def first_of_each(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` distinct keys (_k) of each language (_l) in a seeded hash order.

    Counts by slices of that order tell where a language has enough, so that only those slices are ranked, not the whole language.
    """
    ids = stored(rows.distinct().withColumn("_h", F.xxhash64(F.lit(3), "_k")).withColumn("_slice", F.shiftright("_h", 52)))
    before = F.sum("_c").over(Window.partitionBy("_l").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    open_ = ids.groupBy("_l", "_slice").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < most)
    last = small(stored(open_.groupBy(F.col("_l").alias("_of")).agg(F.max("_slice").alias("_last"))))
    near = ids.join(last, (F.col("_l") == F.col("_of")) & (F.col("_slice") <= F.col("_last")))
    ranked = near.withColumn("_n", F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_k")))
    return ranked.where(F.col("_n") <= most).select("_k", "_l")


def train(labelled: DataFrame, path: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of the labelled rows (text and lang not null)."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    chosen = small(stored(first_of_each(rows.select(F.col(key).alias("_k"), F.col(lang).alias("_l")), sample_docs)))
    texts = rows.join(chosen, (F.col(key) == F.col("_k")) & (F.col(lang) == F.col("_l"))).select(F.col("_l").alias("lang"), F.col(text).alias("text"))

    def count(batches):
        from collections import Counter

        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                seen: Counter = Counter()
                for la, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seen.update((la, w) for w in cut_words(words_of(t)))
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(seen.values(), pa.int64())], names=["lang", "word", "n"])

    counts = stored(texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())  # one row a language
    pieces = vocabulary(path)
    probs = np.full((len(pieces) + 2, len(languages)), 1.0 / max(1, len(pieces)))
    probs[-2], probs[-1] = 0.0, UNKNOWN
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast((pieces, languages, probs))

        def expect(batches):
            pieces, languages, probs = shared.value
            finder, total, column = Pieces(pieces), np.zeros_like(probs), {x: i for i, x in enumerate(languages)}
            for b in batches:
                words = b.column(1).to_pylist()
                n = np.zeros((len(words), len(languages)))
                n[np.arange(len(words)), [column[x] for x in b.column(0).to_pylist()]] = b.column(2).to_numpy()
                for at, group in by_length(words, 4000):
                    total += finder.expected(group, n[at], probs)
            p, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(k, pa.int64()), pa.array(total[p, k])], names=["p", "k", "n"])

        sums = counts.mapInArrow(expect, "p long, k long, n double").groupBy("p", "k").agg(F.sum("n").alias("n")).toPandas()  # at most pieces x languages
        total = np.zeros_like(probs)
        total[sums["p"], sums["k"]] = sums["n"]
        total = total[: len(pieces)] + 0.1
        probs[: len(pieces)] = total / total.sum(axis=0)
        shared.unpersist()
    return Model(pieces, languages, probs)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, model.languages, model.probs))

    def run(batches):
        m = Model(*shared.value)
        m.start()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                names, scores = m.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["_key", "lang_pred", "score"])

    out = T.StructType([T.StructField("_key", rows.schema[0].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, out).withColumnRenamed("_key", key)


def accepted(docs: DataFrame, model: Model, min_score: float = 0.5, text: str = "text") -> DataFrame:
    """The rows with a predicted language of that posterior at least, all columns as they are; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, model.languages, model.probs))
    at = docs.columns.index(text)

    def run(batches):
        m = Model(*shared.value)
        m.start()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                names, scores = m.predict(part.column(at).to_pylist())
                keep = pa.array([n != "und" and s >= min_score for n, s in zip(names, scores)], pa.bool_())
                yield part.filter(keep)

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(crc_of(F.col(key)) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
