import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from capweave.llm import substrings, suffix

from odd_rows import ODD


def classes(segments, length):
    text, found = suffix.Text(segments), {}
    for start, seg in zip(text.starts.tolist(), segments):
        for o in range(len(seg) - length + 1):
            found.setdefault(seg[o : o + length], []).append(start + o)
    return sorted(sorted(v) for v in found.values() if len(v) > 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab\x00", min_size=1, max_size=24).map(str.encode), min_size=1, max_size=10), st.integers(1, 5))
def test_repeated_classes(segments, length):
    text = suffix.Text(segments)
    assert sorted(suffix.suffix_array(text).tolist()) == list(range(len(text.t)))
    at, number = suffix.repeated_classes(text, length)
    got = {}
    for p, n in zip(at.tolist(), number.tolist()):
        got.setdefault(n, []).append(p)
    assert sorted(sorted(v) for v in got.values()) == classes(segments, length)


def test_suffix_order_is_right():
    rng = random.Random(2)
    for _ in range(50):
        segments = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40))) for _ in range(6)]
        text = suffix.Text(segments)
        tails = [text.t[i : text.end_of[i] + 1].tolist() for i in suffix.suffix_array(text).tolist()]
        assert tails == sorted(tails)


def test_equal_strings_hold_equal_anchors():
    import numpy as np

    rng = random.Random(3)
    for alphabet in (b"ab", bytes(range(97, 123))):
        shared = bytes(rng.choice(alphabet) for _ in range(50))
        for _ in range(40):
            found = []
            for _ in range(2):
                left = bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
                raw = left + shared + bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
                p, h = substrings.anchors(np.frombuffer(raw, np.uint8), 50, 26)
                found.append({(int(a) - len(left), int(b)) for a, b in zip(p, h) if len(left) <= a <= len(left) + 24})
            assert found[0] & found[1]


def removed(rows, length=50):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, string by string."""
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for o in range(len(raw) - length + 1):
                s = raw[o : o + length]
                first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if i is not None:
            for o in range(len(raw) - length + 1):
                if first[raw[o : o + length]] < i:
                    gone[o : o + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((str(i), len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(prose):
    passage, other = prose(100, 30), prose(101, 12)
    rows = [(i, prose(i, 40)) for i in range(20)]
    rows += [(20 + i, f"{prose(50 + i, 6)} {passage} {prose(80 + i, 5)}") for i in range(12)]
    rows += [(40, passage), (41, passage[:49]), (42, passage[:50]), (39, passage[7:90] + passage[3:60]), (43, other + other + other), (44, "é" * 40 + other), (45, rows[3][1]), (2, rows[3][1]), (46, rows[3][1] + "!"), (47, "ab" * 60), (48, "ba" * 40)]
    return rows + ODD


def test_against_brute_force(make, prose):
    rows = corpus(prose)
    want = removed(rows)
    for options in ({}, {"crowd": 4}, {"crowd": 4, "few": 0}, {"shard_bytes": 200}):
        got = substrings.without_repeats(make(rows, clash=True), **options).collect()
        assert sorted((str(r["doc_id"]), *(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))) for r in got) == want, options


def test_texts_and_empty(make, prose):
    rows = [(1, prose(1, 60)), (2, "head " + prose(1, 60) + " tail"), (3, prose(1, 60))]
    got = {r["doc_id"]: r["kept"] for r in substrings.without_repeats(make(rows), texts=True).collect()}
    assert got[1] is None and bytes(got[2]) == b"head  tail" and bytes(got[3]) == b""
    assert substrings.without_repeats(make([])).collect() == []
