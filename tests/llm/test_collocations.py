"""Collocations against counting all phrases one by one."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkquire.llm import collocations as c
from sparkquire.llm import sieve

DOCS = "doc_id long, text string, lang string, n long, k int, phrase string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def plain(rows, most, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for w in words_of(text):
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, x in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and p[i:j] in cand and 100 * x >= share * cand[p[i:j]]}
        best = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return Counter(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "e", "zêta", "eta\xa0x", "theta", "naïve-approach-of-long-words", "κ"]
    said = ["New York City", "of the", "alpha beta gamma délta", "e e e e"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(said) if rng.random() < 0.4 else " ".join(rng.choices(vocabulary, k=rng.randint(1, 5))) for _ in range(rng.randint(0, 12))]
        text = parts[0] if parts else ""
        for p in parts[1:]:
            text += rng.choice([" ", "  ", "\t", ". ", ",", "\n", " : ", "\r\n"]) + p
        rows.append((text, rng.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" \t .", "fr"), ("x " * 300, "en"), ("y", "one")] + rows[:7]


def got(spark, rows, **how):
    return Counter(map(tuple, c.collocations(spark.createDataFrame([(i, t, x, 0, 0, "p") for i, (t, x) in enumerate(rows)], DOCS), **how).collect()))


@pytest.mark.parametrize(("seed", "most", "least", "share", "top"), [(1, 3, 10, 50, 2000), (2, 4, 3, 90, 25), (3, 2, 2, 50, 7)])
def test_collocations(spark, seed, most, least, share, top):
    rows = corpus(seed)
    assert got(spark, rows, most=most, least=least, share=share, top=top) == plain(rows, most, least, share, top)


def test_texts_over_several_shards_and_a_full_sieve(spark, monkeypatch):
    monkeypatch.setattr(c, "SHARD_BYTES", 40)
    monkeypatch.setattr(sieve, "BITS", 64)
    monkeypatch.setattr(sieve, "MOST_BITS", 64)
    rows = corpus(5) + [("alpha beta" + " " * 200 + "gamma délta" + " " * 90 + ". beta" + "." * 100 + "gamma", "en")] * 12
    assert got(spark, rows, most=4, least=5, share=60, top=500) == plain(rows, 4, 5, 60, 500)


def test_no_rows_and_one_hot_text(spark):
    assert not got(spark, [])
    rows = [("the same words again", "en")] * 500 + [("other", "en")]
    assert got(spark, rows) == plain(rows, 3, 10, 50, 2000)


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000
    counts = spark.createDataFrame([("en", "", 0, 10**13), ("en", "a", 1, 2 * big), ("en", "b", 1, big + 7), ("en", "a b", 2, big)], "lang string, phrase string, k int, n long")
    (row,) = c._cuts(counts).collect()
    assert (row.a, row.l, row.r) == (big, 2 * big, big + 7)


@pytest.mark.parametrize("most", [2, 3, 5])
def test_states_are_the_classes_of_equal_ends(most):
    """A state's substrings have the same end positions, and no substring of another state has them."""
    rng = random.Random(most)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 30))) + rng.choice([".", " "]) + " ".join(rng.choices("ab", k=9)) for _ in range(6)]
    ((_, shard),) = list(c._shards(pa.array(["x"] * len(texts)), pa.array(texts), most, 1 << 20))
    ends = defaultdict(set)
    for i in range(len(shard.word)):
        for k in range(1, int(shard.depth[i]) + 1):
            ends[tuple(shard.word[i - k + 1 : i + 1])].add(i)
    states = c.automaton(shard, most)
    found = defaultdict(set)
    for e, a, b, n in zip(states.end, states.shortest, states.longest, states.count):
        mine = {tuple(shard.word[e - k + 1 : e + 1]) for k in range(a, b + 1)}
        for p in mine:
            assert len(ends[p]) == n
            found[frozenset(ends[p])].add(p)
        assert len({frozenset(ends[p]) for p in mine}) == 1
    want = defaultdict(set)
    for p, e in ends.items():
        want[frozenset(e)].add(p)
    assert found == want and len(states.end) == len(want)
    assert np.all(states.shortest <= states.longest)
