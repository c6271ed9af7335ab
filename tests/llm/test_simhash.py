import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from capweave.llm import simhash
from capweave.llm.common import components

from odd_rows import ODD


def fingerprint(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_match_plain_counting(prose):
    texts = [None, "", " ", "One", "one TWO", "a b c", "\x1cA\x85b c d", *(prose(i, n) for i, n in enumerate((4, 255, 256, 258, 700)))]
    assert simhash.fingerprints(texts).tolist() == [fingerprint(t) for t in texts]
    assert simhash.fingerprints(texts, 5).tolist() == [fingerprint(t, 5) for t in texts]


def test_links_and_components(spark):
    """Random fingerprints, close pairs, chains and a crowd that shares most blocks."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:40]:
        for _ in range(3):
            f ^= 1 << rng.randrange(64)
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    base = rng.getrandbits(64)
    fps |= {base ^ sum(1 << b for b in c) for c in itertools.combinations(range(12), 3)} | {0, (1 << 64) - 1}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for distance in (2, 4):
        got = {r["node"]: r["root"] for r in components(simhash.links(df, distance)).collect()}
        want = closed(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance])
        assert {n: got.get(n, n) for n in signed} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300), (300, 301)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}


def test_near_duplicates(make, prose):
    a = prose(1, 400)
    rows = [(9, a), (3, a), (5, a + " tail"), (7, prose(2, 300)), (11, None), (10, ""), *ODD]
    df = make(rows, clash=True)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    ids, fps = [r[0] for r in rows], [fingerprint(r[1]) for r in rows]
    groups = closed(sorted(set(fps)), [(x, y) for x, y in itertools.combinations(sorted(set(fps)), 2) if (x ^ y).bit_count() <= 2])
    low = {}
    for i, f in zip(ids, fps):
        if i is not None:
            low[groups[f]] = min(i, low.get(groups[f], i))
    want = sorted((str(i), f"{f:016x}", low.get(groups[f])) for i, f in zip(ids, fps))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    chosen = sorted(str(r["doc_id"]) for r in kept.collect())
    assert chosen.count("None") == 2 and "9" not in chosen and chosen.count("4") == 1
    assert simhash.near_duplicates(make([])).collect() == []


def jaccard(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((a or "").lower().split(), (b or "").lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def kept_and_wanted(make, rows):
    got = sorted(r["doc_id"] for r in simhash.one_of_each(make(rows)).collect())
    ids, texts = [r[0] for r in rows], dict(rows)
    roots = closed(ids, [(a, b) for a, b in itertools.combinations(ids, 2) if jaccard(texts[a], texts[b]) >= 0.8])
    return got, sorted(i for i in ids if roots[i] == i)


def test_copies_that_share_all_with_a_longer_page(make, prose):
    """A page with the smallest id holds the article and more; the copies differ in their last line."""
    rng = random.Random(3)
    fresh = lambda n: " ".join(str(rng.getrandbits(40)) for _ in range(n))
    article = fresh(300)
    rows = [(0, f"{article} {fresh(160)}")] + [(i, f"{article} {fresh(9)}") for i in range(1, 25)]
    got, want = kept_and_wanted(make, rows)
    assert got == want == [0, 1]


def test_short_near_copies(make):
    """Texts of a few words and the same plus one word or less one; chains; passages that repeat."""
    rng = random.Random(4)
    fresh = lambda n: " ".join(str(rng.getrandbits(40)) for _ in range(n))
    rows = []
    for n in [*range(1, 40), *range(9, 16), 80, 200, 600]:
        t = fresh(n)
        rows += [(len(rows), t), (len(rows) + 1, f"{t} {fresh(1)}"), (len(rows) + 2, t.split(" ", 1)[-1])]
    line, tail = fresh(60), fresh(60)
    rows += [(len(rows), f"{line} {line} {tail}"), (len(rows) + 1, f"{' '.join([line] * 40)} {tail}"), (len(rows) + 2, None), (len(rows) + 3, "")]
    got, want = kept_and_wanted(make, rows)
    assert got == want and len(want) < len(rows) - 80


def test_equal_fingerprints_of_different_texts_stay(make):
    rng = random.Random(5)
    fresh = lambda n: " ".join(str(rng.getrandbits(40)) for _ in range(n))
    line = fresh(9)
    rows = [(i, f"{' '.join([line] * 100)} {fresh(300)}") for i in range(3)] + [(3 + i, f"{'- ' * 400}{fresh(300)}") for i in range(3)]
    fps = [fingerprint(t) for _, t in rows]
    assert any((a ^ b).bit_count() <= 2 for a, b in itertools.combinations(fps, 2))
    got, want = kept_and_wanted(make, rows)
    assert got == want == list(range(6))


def test_fingerprint_pairs_give_the_components_of_op3(spark):
    """Fingerprints of one row and of many, chains, and a crowd under one key; fewer pairs than a crowd's square."""
    rng = random.Random(9)
    fps = [rng.getrandbits(63) for _ in range(30)]
    fps += [f ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for f in fps[:10]] + [fps[3]] * 40 + fps[20:25] + [fps[7] ^ (1 << i) for i in range(30)]
    rng.shuffle(fps)
    rows = [(i, f) for i, f in enumerate(fps)]
    got = [(r["u"], r["v"]) for r in simhash.fingerprint_pairs(spark.createDataFrame(rows, "_key long, fp long")).collect()]
    want = closed(range(len(fps)), [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert closed(range(len(fps)), got) == want and len(set(got)) == len(got) < 10 * len(fps) and all(u > v for u, v in got)


def test_near_copies_are_found_by_their_fingerprints(make, monkeypatch):
    """With no shingle as a key only op3's method is left: it finds light edits, and the exact similarity keeps unlike texts."""
    rng = random.Random(10)
    fresh = lambda n: " ".join(str(rng.getrandbits(40)) for _ in range(n))
    rows, line = [], fresh(9)
    for i in range(0, 24, 2):
        t = fresh(3000)
        rows += [(i, t), (i + 1, f"{t} {fresh(1)}")]
    unlike = [(50 + i, f"{' '.join([line] * 100)} {fresh(300)}") for i in range(3)]
    near = [i for i in range(0, 24, 2) if (fingerprint(rows[i][1]) ^ fingerprint(rows[i + 1][1])).bit_count() <= 2]
    assert len(near) > 6
    monkeypatch.setattr(simhash, "least_common", lambda n, similarity: n + 1)
    got = {r["doc_id"] for r in simhash.one_of_each(make(rows + unlike)).collect()}
    assert got == {i for i, _ in rows + unlike} - {i + 1 for i in near}


def test_a_pair_meets_first_under_its_first_key_and_seldom_again(spark):
    """Documents of 60 of 80 keys each: every pair shares about 45, and meets under its first one and few others."""
    rng = random.Random(11)
    docs = {i: sorted(rng.sample(range(80), 60)) for i in range(12)}
    rows = spark.createDataFrame([(i, pos, k) for i, ks in docs.items() for pos, k in enumerate(ks)], "_key long, pos int, k long")
    x, y = (simhash.with_keys_before(rows).select("k", *[F.col(c).alias(c + side) for c in ("_key", "before")]) for side in "xy")
    met = x.join(y, "k").where("_keyx > _keyy").where(~F.arrays_overlap("beforex", "beforey")).select("_keyx", "_keyy", "k").collect()
    first = {(a, b, min(set(docs[a]) & set(docs[b]))) for a, b in itertools.permutations(docs, 2) if a > b}
    assert first <= {tuple(r) for r in met} and len(met) < 1.1 * len(first)


def test_long_near_copies_round_the_threshold(make, monkeypatch):
    """They share many keys; without rounds of linking the meeting under the first one decides alone."""
    rng = random.Random(12)
    words, rows = [str(rng.getrandbits(40)) for _ in range(300)], []
    for i in range(36):
        w = list(words)
        for at in rng.sample(range(300), rng.choice((3, 4, 5, 6, 7, 30))):
            w[at] = str(rng.getrandbits(40))
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(simhash, "TURNS", 0)
    got, want = kept_and_wanted(make, rows)
    assert got == want and 3 < len(want) < 30


def test_rows_of_one_key_with_texts_of_their_own(make, prose):
    """Each is a document: none goes for what another row of its key is like; a repeated row goes."""
    a, b, c = prose(61, 80), prose(62, 80), prose(63, 80)
    rows = [(1, a), (1, b), (2, c), (2, c), (3, a + " tail"), (0, b + " tail"), (None, c)]
    got = sorted((str(r["doc_id"]), r["text"]) for r in simhash.one_of_each(make(rows)).collect())
    assert got == sorted([("1", a), ("2", c), ("0", b + " tail"), ("None", c)])


def test_crowds_of_near_copies(make, monkeypatch):
    """Many texts round the threshold that share their keys: the same groups, by rounds of linking and without them."""
    rng = random.Random(8)
    words = [str(rng.getrandbits(40)) for _ in range(60)]
    rows = []
    for i in range(70):
        w = list(words)
        w[rng.randrange(60)] = w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    for turns, dense in ((2, 0), (0, 8), (2, 8)):
        monkeypatch.setattr(simhash, "TURNS", turns)
        monkeypatch.setattr(simhash, "DENSE", dense)
        got, want = kept_and_wanted(make, rows)
        assert got == want, (turns, dense)


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 900):
        a, b = (rng.integers(-(1 << 62), 1 << 62, n) for _ in range(2))
        both = np.concatenate([a, b[: n // 2]]), np.concatenate([b, a[: n // 3]])
        x, y = (np.unique(v) for v in both)
        bits = sum((int(p) ^ int(q)).bit_count() if (p >= 0) == (q >= 0) else ((int(p) ^ int(q)) & (1 << 64) - 1).bit_count() for p, q in zip(simhash.parity(x), simhash.parity(y)))
        assert bits <= len(np.setxor1d(x, y))


def test_wide_parity_never_differs_in_more_places_than_the_sets(spark):
    rng = np.random.default_rng(3)
    rows, apart = [], []
    for n, m, shared in ((40, 40, 40), (63, 66, 60), (900, 1100, 850), (5000, 5000, 4600), (5000, 5000, 100), (4000, 4200, 4000)):
        h = rng.integers(-(1 << 62), 1 << 62, n + m - shared)
        a, b = h[:n], h[n - shared :]
        rows.append((len(apart), simhash.wide_parity(a).tolist(), simhash.wide_parity(b).tolist()))
        apart.append(n + m - 2 * shared)
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    got = {r["i"]: r["d"] for r in df.select("i", simhash.wide_difference(F.col("a"), F.col("b")).alias("d")).collect()}
    assert all(got[i] <= d for i, d in enumerate(apart))
    assert got[0] == 0 and got[4] * 1.8 > 0.2 * 10_000  # 5000 and 5000 with little in common are told apart


def test_wide_difference_of_unlike_lengths_lets_the_pair_pass(spark):
    df = spark.createDataFrame([([1] * 8, [1] * 2)], "a array<long>, b array<long>")
    assert df.select(simhash.wide_difference(F.col("a"), F.col("b")).alias("d")).first()["d"] == 0
