"""Operator 1: approximate nearest neighbours by balanced posting lists.

Centroids come from a balanced hierarchical k-means over a bounded sample (`sample` vectors); every vector is indexed.
A vector joins the posting list of its nearest centroid and, as a boundary vector, of each further centroid that is
within `closure` times that distance and not hidden behind one already chosen. Centroids are searched by a navigable
graph in memory (beam search over a neighbour graph). A query searches the lists whose centroid is within `prune` times
its nearest centroid's distance (at least so many that they hold `least` vectors; the beam is no limit: where it ends inside
the ratio, all centroids are compared), and compares itself there with every
vector in double precision.

Scale: equal vectors are one class, of which only the k + 1 smallest ids can ever be answers (kept by a group limit before
the shuffle); equal queries are searched once. Centroids are at most `max_lists`, so what is broadcast is bounded; lists
and the queries of a list are dealt to blocks of at most `block` rows by counts, so a crowded list is many small tasks.
No pair is shuffled: each block sends its k + 1 best for a query.

Defined results: null, zero and non-finite vectors (or components) take no part, nor do rows without an id; vectors of
different lengths have no distance, so each length is searched by itself; fewer candidates than k: all of them; repeated rows of one id and vector
count once; no rows or no queries: no rows; other columns stay out of the result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capweave.llm.common import stored, table

K, LIST_SIZE, MAX_LISTS, SAMPLE, BLOCK = 10, 96, 16_384, 65_536, 4096
CLOSURE, COPIES, PRUNE, BEAM, LEAST, DEGREE = 1.15, 6, 1.35, 96, 200, 24


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col(vector)
    rows = vectors.where(F.col(key).isNotNull() & v.isNotNull()).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0.0)
    return rows.where(fine)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, quick rather than exact: only for choosing lists."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0.0)


def split(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """A cluster number for each row; sizes are held together by a penalty on full clusters."""
    c = x[rng.choice(len(x), n, replace=False)].astype(np.float64)
    penalty = np.zeros(n)
    for _ in range(rounds):
        d = distances(x, c)
        at = (d + penalty).argmin(1)
        sizes = np.bincount(at, minlength=n)
        penalty += 0.1 * d.min(1).mean() * (sizes * n / len(x) - 1)
        for k in range(n):
            c[k] = x[at == k].mean(0) if sizes[k] else x[rng.integers(len(x))]
    return at


def fit_centroids(x: np.ndarray, lists: int, fan: int = 32, seed: int = 1) -> np.ndarray:
    """About `lists` centroids of leaves of about equal size. The sample is centred: distances lose no digits to a common offset."""
    middle = x.mean(0)
    rng, leaves, todo = np.random.default_rng(seed), [], [(x - middle, lists)]
    while todo:
        part, n = todo.pop()
        n = min(n, len(part))
        if n <= 1:
            leaves.append(part.mean(0))
            continue
        at = split(part, min(fan, n), rng)
        if (at == at[0]).all():  # too close together to be told apart
            leaves.append(part.mean(0))
            continue
        for k in range(min(fan, n)):
            own = part[at == k]
            if len(own):
                todo.append((own, max(1, round(n * len(own) / len(part)))))
    return np.array(leaves) + middle


class Graph:
    """Centroids and a neighbour graph over them."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE) -> None:
        n = len(centroids)
        self.offset = centroids.mean(0)
        centroids = self.c = centroids - self.offset
        degree = min(degree, max(1, n - 1))
        near = np.zeros((n, degree), np.int64)
        for i in range(0, n, 1024):
            d = distances(centroids[i : i + 1024], centroids)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i : i + 1024] = np.argsort(d, axis=1)[:, :degree] if n > 1 else 0
        rng = np.random.default_rng(2)
        far = rng.integers(0, n, (n, max(1, degree // 4)))  # long links keep the graph in one piece
        self.near = np.concatenate([near, far], axis=1)
        self.entries = rng.choice(n, min(n, 16), replace=False)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of each row's `beam` best that a best-first walk finds, nearest first."""
        n, m, q = len(self.c), len(q), q - self.offset
        beam = min(beam, n)
        ids = np.full((m, beam), -1, np.int64)
        dist = np.full((m, beam), np.inf)
        done = np.zeros((m, beam), bool)
        seen = np.zeros((m, n), bool)
        norms = (self.c * self.c).sum(1)
        own = (q * q).sum(1)

        def merge(rows: np.ndarray, new: np.ndarray) -> None:
            fresh = ~seen[rows[:, None], new]
            srt = np.sort(np.where(fresh, new, -1), axis=1)
            new = np.where(np.c_[np.ones(len(srt), bool), srt[:, 1:] != srt[:, :-1]], srt, -1)
            seen[rows[:, None], np.maximum(new, 0)] |= new >= 0
            d = own[rows, None] - 2 * np.einsum("ij,ikj->ik", q[rows], self.c[np.maximum(new, 0)]) + norms[np.maximum(new, 0)]
            d = np.where(new >= 0, np.maximum(d, 0.0), np.inf)
            all_d, all_i = np.concatenate([dist[rows], d], 1), np.concatenate([ids[rows], new], 1)
            all_done = np.concatenate([done[rows], np.zeros(new.shape, bool)], 1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[rows], ids[rows], done[rows] = (np.take_along_axis(x, best, 1) for x in (all_d, all_i, all_done))

        every = np.arange(m)
        merge(every, np.broadcast_to(self.entries, (m, len(self.entries))))
        while True:
            open_ = np.where(done | (ids < 0), np.inf, dist)
            rows = np.flatnonzero(np.isfinite(open_.min(1)))
            if not len(rows):
                return ids, dist
            at = open_[rows].argmin(1)
            done[rows, at] = True
            merge(rows, self.near[ids[rows, at]])


def chosen_lists(graph: Graph, v: np.ndarray, closure: float, copies: int):
    """Which lists each vector joins: (row, list) arrays, the nearest first."""
    ids, d = graph.search(v, 16)
    rows, lists = [np.arange(len(v))], [ids[:, 0]]
    taken = [ids[:, :1]]
    for k in range(1, ids.shape[1]):
        inside = (ids[:, k] >= 0) & (d[:, k] <= closure**2 * d[:, 0]) & (sum((t >= 0).sum(1) for t in taken) < copies)
        for t in taken:  # not if a chosen centroid is nearer to this one than the vector is
            prev = graph.c[np.maximum(t[:, 0], 0)]
            gap = ((graph.c[np.maximum(ids[:, k], 0)] - prev) ** 2).sum(1)
            inside &= (t[:, 0] < 0) | (gap > 0.25 * d[:, k])
        taken.append(np.where(inside, ids[:, k], -1)[:, None])
        rows.append(np.flatnonzero(inside))
        lists.append(ids[inside, k])
    return np.concatenate(rows), np.concatenate(lists)


def probed(graph: Graph, q: np.ndarray, counts: np.ndarray, beam: int, prune: float, least: int):
    """The lists that each row searches, as (row, list) arrays: all within `prune` times the nearest centroid's distance, and
    at least so many that they hold `least` vectors. Where that may go on past the beam, every centroid is compared."""

    def inside(ids: np.ndarray, d: np.ndarray) -> np.ndarray:
        before = np.cumsum(np.where(ids >= 0, counts[np.maximum(ids, 0)], 0), axis=1)
        before = np.c_[np.zeros(len(ids)), before[:, :-1]]
        return (ids >= 0) & ((d <= prune**2 * d[:, :1]) | (before < least))

    ids, d = graph.search(q, beam)
    keep = inside(ids, d)
    on = (keep | (ids < 0)).all(1) & (ids.shape[1] < len(graph.c))
    r, c = np.nonzero(keep & ~on[:, None])
    rows, lists = [r], [ids[r, c]]
    if on.any():
        d = distances(q[on] - graph.offset, graph.c)
        ids = np.argsort(d, axis=1, kind="stable")
        r, c = np.nonzero(inside(ids, np.take_along_axis(d, ids, 1)))
        rows.append(np.flatnonzero(on)[r])
        lists.append(ids[r, c])
    return np.concatenate(rows), np.concatenate(lists)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, list_size: int = LIST_SIZE, max_lists: int = MAX_LISTS, sample: int = SAMPLE, closure: float = CLOSURE, prune: float = PRUNE,
               beam: int = BEAM, least: int = LEAST, block: int = BLOCK, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, itself excluded; score is the Euclidean distance."""
    rows, asked = usable(vectors, key, vector), usable(queries, key, vector)
    lengths = sorted(r[0] for r in asked.select(F.size("v")).distinct().collect())  # a few numbers
    options = dict(k=k, list_size=list_size, max_lists=max_lists, sample=sample, closure=closure, prune=prune, beam=beam, least=least, block=block)
    parts = [_of_one_length(rows.where(F.size("v") == n).distinct(), asked.where(F.size("v") == n).distinct(), **options) for n in lengths]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionAll, parts)


def _of_one_length(rows: DataFrame, asked: DataFrame, k: int, list_size: int, max_lists: int, sample: int, closure: float, prune: float, beam: int, least: int, block: int) -> DataFrame:
    spark = rows.sparkSession
    asked = stored(asked)
    # the k + 1 smallest ids of each vector
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = stored(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = int(min(max_lists, max(1, -(-n // list_size))))
    size = min(sample, max(lists * 16, 1024))
    # distinct vectors with a small seeded hash are the sample: about `size` of them, or all
    part = F.shiftrightunsigned(F.xxhash64(F.lit(5), "v"), 32)
    few = classes.where(part < int(min(1.0, size / n) * (1 << 32))).select("v", part.alias("h"))
    x = np.array([v for _, v in sorted((r["h"], r["v"]) for r in few.toLocalIterator())] or [classes.first()["v"]])
    # the graph is built once; its size is bounded by max_lists
    shared = spark.sparkContext.broadcast(Graph(fit_centroids(x, lists)))

    def post(batches):
        graph = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                row, at = chosen_lists(graph, matrix(part.column(0)), closure, COPIES)
                picked = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), picked.column(0), picked.column(1)], names=["list", "v", "ids"])

    postings = stored(classes.mapInArrow(post, "list long, v array<double>, ids array<long>"))
    held = {r[0]: r[1] for r in postings.groupBy("list").count().collect()}  # at most max_lists numbers
    counts = np.array([held.get(i, 0) for i in range(len(shared.value.c))])
    shared_counts = spark.sparkContext.broadcast(counts)

    def probe(batches):
        graph, counts = shared.value, shared_counts.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                row, at = probed(graph, matrix(part.column(0)), counts, beam, prune, least)
                for j in range(0, len(row), 8192):
                    own = pa.array(row[j : j + 8192])
                    yield pa.RecordBatch.from_arrays([pa.array(at[j : j + 8192], pa.int64()), part.column(0).take(own), part.column(1).take(own)], names=["list", "q", "no"])

    # equal queries are one, named by the smallest id
    named = stored(asked.groupBy("v").agg(F.min("id").alias("no")))
    probes = stored(named.mapInArrow(probe, "list long, q array<double>, no long"))
    sizes = postings.groupBy("list").agg(F.ceil(F.count("*") / block).alias("nv")).join(probes.groupBy("list").agg(F.ceil(F.count("*") / block).alias("nq")), "list")
    sizes = F.broadcast(sizes)  # one row a list
    spread = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = postings.join(sizes, "list").withColumn("vb", F.pmod(F.xxhash64("v"), F.col("nv"))).withColumn("qb", spread("nq")).select("list", "vb", "qb", "v", "ids")
    right = probes.join(sizes, "list").withColumn("qb", F.pmod(F.xxhash64("q"), F.col("nq"))).withColumn("vb", spread("nv")).select("list", "vb", "qb", "q", "no")

    def compare(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = {"no": [], "vec_id": [], "score": []}  # a row for each query
        if len(v) and len(q):
            data = np.stack(v["v"].to_list())
            ids = [np.asarray(i) for i in v["ids"]]
            for no, one in zip(q["no"], q["q"]):
                d = np.sqrt(((data - np.asarray(one)) ** 2).sum(1))
                near = np.argsort(d, kind="stable")
                if len(near) > k + 1:
                    near = np.flatnonzero(d <= d[near[k]])
                best = sorted((d[j], i) for j in near for i in ids[j])[: k + 1]
                out["no"].append(int(no))
                out["vec_id"].append([int(i) for _, i in best])
                out["score"].append([float(s) for s, _ in best])
        return pd.DataFrame(out).astype({"no": "int64"})

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        """The k + 1 best of all blocks of a query, at most one row for each list and block of it; a vector is in several lists."""
        pairs = {(s, i) for scores, ids in zip(found["score"], found["vec_id"]) for s, i in zip(scores, ids)}
        best = sorted(pairs)[: k + 1]
        return pd.DataFrame({"no": found["no"].iloc[:1].to_list(), "found": [[{"score": float(s), "vec_id": int(i)} for s, i in best]]})

    found = left.groupBy("list", "vb", "qb").cogroup(right.groupBy("list", "vb", "qb")).applyInPandas(compare, "no long, vec_id array<long>, score array<double>")
    best = found.groupBy("no").applyInPandas(merge, "no long, found array<struct<score:double,vec_id:long>>")
    # each query row takes its vector's answers, without itself
    mine = asked.join(named, "v").select("id", "no").join(best, "no")
    own = F.slice(F.array_sort(F.filter("found", lambda f: f["vec_id"] != F.col("id"))), 1, k)
    return mine.select(F.col("id").alias("query_id"), F.posexplode(own).alias("pos", "f")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))
