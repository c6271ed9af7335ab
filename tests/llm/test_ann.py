import numpy as np
from pyspark.sql import functions as F

from capweave.llm import ann


def exact(rows, k):
    out = {}
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8]
    seen = sorted({(i, tuple(v)) for i, v in usable})
    for i, v in seen:
        if i % 100 == 0:
            d = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in seen if j != i)
            out[i] = d[:k]
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(900)]
    rows += [(i, rows[100][1]) for i in range(1000, 1060)] + [(2000, rows[100][1])]  # a common vector
    rows += [(3000, None), (3100, [0.0] * 8), (3200, [float("nan")] + [1.0] * 7), (3300, [None] + [1.0] * 7), (3400, [1.0, 2.0]), (3500, [float("inf")] + [1.0] * 7), (None, rows[0][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("list", F.lit(1))
    found = {}
    for r in ann.neighbours(df, df.where("vec_id % 100 = 0"), list_size=40).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact(rows, 10)
    assert set(found) == set(want)
    hits = 0
    for q, near in want.items():
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 11)) and [(g[2], g[1]) for g in got] == sorted((g[2], g[1]) for g in got) and q not in [g[1] for g in got]
        score = dict((j, d) for d, j in exact_of(rows, q))
        assert all(abs(score[g[1]] - g[2]) < 1e-12 for g in got)
        hits += len({j for _, j in near} & {g[1] for g in got})
    assert hits >= 0.9 * 10 * len(want)
    assert [g[1] for g in sorted(found[2000])] == [100, *range(1000, 1009)] and [g[1] for g in sorted(found[100])] == list(range(1000, 1010))


def exact_of(rows, q):
    v = np.array(next(v for i, v in rows if i == q))
    return [(float(np.sqrt(((np.array(w, float) - v) ** 2).sum())), j) for j, w in rows if j is not None and w is not None and None not in w and len(w) == 8]


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.neighbours(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    empty = spark.createDataFrame([], schema)
    assert ann.neighbours(empty, empty).collect() == [] and ann.neighbours(df, empty).collect() == []


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(2)
    c, q = rng.normal(size=(400, 8)), rng.normal(size=(50, 8))
    ids, d = ann.Graph(c).search(q, 40)
    true = np.argsort(ann.distances(q, c), axis=1)
    assert np.mean(ids[:, 0] == true[:, 0]) > 0.95 and (np.diff(d, axis=1) >= 0).all()
    assert np.mean([len(set(a[:10]) & set(b[:10])) for a, b in zip(ids, true)]) > 9
    assert len(ann.fit_centroids(rng.normal(size=(1000, 4)), 50)) >= 40


def test_the_beam_is_no_cap_on_the_lists(spark):
    """Vectors without structure: nearly every centroid is inside the ratio, many times the beam."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = lambda beam: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.neighbours(df, df.where("vec_id % 100 = 0"), list_size=40, beam=beam, least=1).collect())
    assert found(4) == found(1000)


def test_vectors_that_can_hardly_be_told_apart(spark):
    """Close together and far from the origin: centroids are fitted, and the neighbours are the nearest."""
    rng = np.random.default_rng(9)
    x = 1e8 + 1e-4 * rng.permutation(300)[:, None] * np.ones((1, 4))
    assert 1 <= len(ann.fit_centroids(x, 40)) <= 300 and len(ann.fit_centroids(np.full((50, 3), 1e300), 8)) == 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.neighbours(df, df.where("vec_id % 100 = 0"), k=3, list_size=20).collect()
    hits = 0
    for q in (0, 100, 200):
        d = sorted((float(np.sqrt(((x[j] - x[q]) ** 2).sum())), j) for j in range(300) if j != q)[:3]
        hits += len({j for _, j in d} & {r["vec_id"] for r in got if r["query_id"] == q})
    assert len(got) == 9 and hits >= 8


def test_each_length_is_searched_by_itself(spark):
    rows = [(i, [float(i), 1.0]) for i in range(0, 300, 50)] + [(1000 + i, [float(i), 1.0, 2.0]) for i in range(0, 300, 50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(df, df.where("vec_id % 100 = 0"), k=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    two = {0: [50, 100], 100: [50, 150], 200: [150, 250]}
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == two | {1000 + q: [1000 + v for v in x] for q, x in two.items()}
