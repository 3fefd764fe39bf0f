"""Vector codes against plain Lloyd rounds; edit fingerprints against a walk step by step."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from sparkquire.llm import edit_embedding, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, code string"


def plain_codes(rows, parts, entries, rounds, scale=4096):
    """Rows of (id, vector, label), all sound and of one length, in Python's integers."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(scale * x) for x in v] for _, v, _ in order]
    w = len(ints[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(p, v[p])[0] for v in cut]
            for k in range(len(books[p])):
                mine = [v[p] for v, a in zip(cut, of) if a == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    by = Counter()
    for (_, _, label), f in zip(order, found):
        by[label] += sum(d for _, d in f)
    return Counter((i, "".join(f"{k:02x}" for k, _ in f), sum(d for _, d in f), by[label], digest) for (i, _, label), f in zip(order, found))


def coded(spark, rows, **how):
    return Counter(map(tuple, vector_codes.vector_codes(spark.createDataFrame([(*r, "x") for r in rows], VECTORS), **how).collect()))


@pytest.mark.parametrize(("seed", "grid"), [(1, 0.0), (2, 0.25), (3, 1.0)])
def test_codes_equal_plain_rounds(spark, seed, grid):
    """A coarse grid makes ties, equal entries and repeated vectors."""
    rng = random.Random(seed)

    def component():
        return round(rng.gauss(0, 1) / grid) * grid if grid else rng.gauss(0, 0.1)

    rows = [(rng.randrange(150), [component() for _ in range(12)], rng.choice((None, 1, 2))) for _ in range(200)]
    rows += rows[:9]
    assert coded(spark, rows, parts=4, entries=6, rounds=5) == plain_codes(rows, 4, 6, 5)


def test_codes_in_small_blocks_and_by_label(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 7)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 20) for _ in range(8)], i % 3 or None) for i in range(90)]
    assert coded(spark, rows, parts=8, entries=16, rounds=6) == plain_codes(rows, 8, 16, 6)


def test_odd_vectors_are_dropped(spark):
    good = [(3, [1.0, 2.0], 1), (None, [0.5, -2.0], None), (4, [1.0, 2.0], 1), (7, [1e4, -1e4], 1)]
    odd = [(1, None, 1), (2, [1.0, None], 1), (5, [math.nan, 1.0], 1), (6, [math.inf, 1.0], 1), (9, [1.0], 1), (8, [1.0, 2.0, 3.0], 1), (0, [], 1), (10, [1e300, 1.0], 1)]
    want = plain_codes(good, 2, 3, 2)
    assert coded(spark, good + odd, parts=2, entries=3, rounds=2) == want
    assert not coded(spark, odd[:4], parts=2) and not coded(spark, [])


def test_bounds_skip_most_scans():
    """Rows of well-parted clusters keep their entries by bounds alone, and bounds always hold."""
    rng = np.random.default_rng(3)
    heart = rng.integers(-4000, 4000, (5, 4))
    x = np.repeat(heart, 40, axis=0) + rng.integers(-9, 9, (200, 4))
    books = vector_codes.Books(heart[None, :, :], np.zeros((1, 5), np.float32))
    code, upper, lower = books.assign(0, x, np.full(200, vector_codes.UNASSIGNED, np.uint8), np.zeros(200, np.float32), np.zeros(200, np.float32))
    new = heart + rng.integers(-3, 3, heart.shape)
    after = vector_codes.Books(new[None, :, :], vector_codes._moved(heart[None, :, :], new[None, :, :]))
    again, upper, lower = after.assign(0, x, code, upper, lower)
    far = np.sqrt(((x[:, None, :] - new[None, :, :]) ** 2).sum(axis=2))
    own = far[np.arange(200), again]
    far[np.arange(200), again] = np.inf
    assert (again == np.repeat(np.arange(5), 40)).all() and (upper >= own).all() and (lower <= far.min(axis=1)).all()
    assert (upper > own + 1e-3).any()  # bounds that were not taken again


def slow_fingerprint(text):
    """Step by step with the shared bits, the output kept whole."""
    pace, (_, _, table) = edit_embedding._pace(), edit_embedding._records()
    out = []
    for ch in text:
        c = (ord(ch) ^ (ord(ch) >> 8)) & 255
        out += [ch] * pace[c][len(out) % edit_embedding.PERIOD]
    if not out:
        return ""
    last = [int(row[row < len(out)][-1]) for row in table]
    return "".join(f"{edit_embedding._digits(np.array([ord(out[t])]), np.array([s]))[0]:x}" for s, t in enumerate(last))


def like(a, b):
    if not a or not b:
        return float(a == b)
    return max(0.0, (16 * sum(x == y for x, y in zip(a, b)) / len(a) - 1) / 15)


DOCS = "doc_id long, text string, h string, fingerprint string"
TEXTS = [(5, "The quick brown fox jumps. " * 30), (5, "Zażółć gęślą jaźń 你好 " * 20), (9, "The quick brown fox jumps. " * 29 + "Over."), (1, None), (2, ""), (3, "ab"), (4, "𝄞𝄞𝄞𝄞"), (None, "no id"), (7, "x" * 70_000), (7, "x" * 70_000)]


def test_fingerprints_of_edited_texts(spark):
    rows = TEXTS
    got = edit_embedding.edited_fingerprints(spark.createDataFrame([(i, t, "h", "f") for i, t in rows], DOCS)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    keys = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), sha(r[1])))
    after = {k: keys[(n + 1) % len(keys)][1] for n, k in enumerate(keys)}
    want = Counter()
    for i, t in rows:
        t = t or ""
        nxt = after[(i, t)]
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        a, b, c = slow_fingerprint(t), slow_fingerprint(edited), slow_fingerprint(nxt)
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(like(a, b), 9), round(like(a, c), 9))] += 1
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == want


def test_no_documents_and_one(spark):
    assert edit_embedding.edited_fingerprints(spark.createDataFrame([], DOCS)).collect() == []
    (r,) = edit_embedding.edited_fingerprints(spark.createDataFrame([(1, "abcabc", "h", "f")], DOCS)).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcaab").hexdigest()


def test_small_edits_stay_near_and_other_texts_far():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abcdefghij klmno", k=n))
    mark = lambda t: edit_embedding.Walk().over(t).fingerprint().hex()
    near, far = [], []
    for _ in range(30):
        t = text(3000)
        at = rng.randrange(2900)
        near.append(like(mark(t), mark(t[:at] + "!" + t[at + 2 :])))
        far.append(like(mark(t), mark(text(3000))))
    assert sum(near) / len(near) > 0.85 and max(far) < 0.3


@pytest.mark.parametrize("block", [512, 3])
def test_near_copies_by_bands(spark, monkeypatch, block):
    monkeypatch.setattr(edit_embedding, "BLOCK", block)
    rng = random.Random(4)
    prints, start = [], ["".join(rng.choices("0123456789abcdef", k=edit_embedding.SLOTS)) for _ in range(4)]
    for i in range(60):
        p = list(start[i % 4])
        for at in rng.sample(range(len(p)), rng.choice((0, 3, 9, 40))):
            p[at] = rng.choice("0123456789abcdef")
        prints.append((i, "".join(p)))
    prints += [(100, ""), (101, None), (None, prints[0][1]), (102, prints[1][1]), (102, prints[1][1])]
    some = [p for p in prints if p[1]]
    root = {p: p for _, p in some}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for _, a in some:
        for _, b in some:
            if any(a[k : k + 8] == b[k : k + 8] for k in range(0, len(a), 8)) and like(a, b) >= 0.8:
                root[top(a)] = top(b)
    least = {}
    for i, p in some:
        if i is not None:
            least[top(p)] = min(least.get(top(p), i), i)
    want = Counter((i, (least[top(p)] if i is not None else None) if p else i) for i, p in prints)
    assert Counter(map(tuple, edit_embedding.near_copies(spark.createDataFrame(prints, "doc_id long, fingerprint string")).collect())) == want


def test_fingerprints_alone(spark):
    got = edit_embedding.fingerprints(spark.createDataFrame([(i, t, "h", "f") for i, t in TEXTS], DOCS)).collect()
    assert Counter(map(tuple, got)) == Counter((i, slow_fingerprint(t or "")) for i, t in TEXTS)
