import random

import pytest

from capweave.llm import mix

from odd_rows import ODD


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Resharing in rounds, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = budget - sum(fixed.values())
        level = left / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if level * w[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **{s: level * w[s] for s in rest}}
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_and_taken(spark, make, prose):
    rng = random.Random(1)
    rows = [(i, prose(i, rng.randint(1, 60)), "en", rng.choice(["a", "b", "c", "é", None, "big", "big", "big", "tiny"])) for i in range(600)]
    rows = [r for r in rows if r[3] != "tiny" or r[0] < 40]
    got = {r["doc_id"]: r for r in mix.mix(make(rows, clash=True)).collect()}
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want, taken = targets(sizes), {}
    for r in rows:
        g = got[r[0]]
        assert g["size"] == len(r[1].split()) and g["source_size"] == sizes[r[3]] and g["target"] == pytest.approx(want[r[3]])
        assert g["taken"] % g["size"] == 0 and g["taken"] <= 3 * g["size"]
        taken[r[3]] = taken.get(r[3], 0) + g["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 61
    total = sum(sizes.values())
    assert total - 61 <= sum(taken.values()) <= total
    again = {r["doc_id"]: r["taken"] for r in mix.mix(make(rows[::-1]).repartition(5)).collect()}
    assert again == {k: v["taken"] for k, v in got.items()}


def test_odd_rows(make):
    got = mix.mix(make(ODD, clash=True)).collect()
    assert len(got) == len(ODD) and sum(r["size"] for r in got) == 20_017
    assert mix.mix(make([])).collect() == [] and all(r["taken"] == 0 for r in mix.mix(make([(1, None), (2, "")])).collect())


def test_mixed_documents_are_ordered(make, prose):
    df = make([(i, prose(i, 20), "en", "ab"[i % 2]) for i in range(60)])
    out = mix.mixed_documents(df).collect()
    assert [r["mix_finish"] for r in out] == sorted(r["mix_finish"] for r in out) and all(r["mix_copies"] > 0 for r in out)


def test_rows_without_an_id_are_taken(make, prose):
    """As many words as the budget, whoever has an id; equal rows without one are documents of their own."""
    rows = [(i if i % 3 else None, prose(i, 20), "en", "abc"[i // 3 % 3]) for i in range(90)] + [(None, prose(500, 20), "en", None)] * 3
    df = make(rows)
    out = mix.mixed_documents(df).collect()
    assert sum(r["mix_copies"] for r in out) == sum(r["copies"] for r in mix.mix(df).collect()) and out
    assert sum(r["doc_id"] is None for r in out) > 20
    count = lambda x: {k: x.count(k) for k in x}
    was, got = count([r[:2] for r in rows]), count([(r["doc_id"], r["text"]) for r in out])
    assert all(n <= was[k] for k, n in got.items())


def test_repeated_keys_come_out_once_a_row(make):
    rows = [(1, "a b c", "en", "x"), (1, "d e f", "en", "x"), (2, "g h i", "en", "x"), (2, "g h i", "en", "x"), (3, "j k l", "en", "y"), (None, "m n o", "en", "y")]
    got = mix.mixed_documents(make(rows)).collect()
    taken = sum(3 * r["mix_copies"] for r in got)
    assert len(got) <= len(rows) and taken <= 18 and len({(r["doc_id"], r["text"], i) for i, r in enumerate(got)}) == len(got)
    few = mix.mix(make(rows[:2] + rows[4:])).collect()
    assert len(few) == 4
