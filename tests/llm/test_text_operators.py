"""Tokens, shingle joins, decontamination, sharding: against plain versions of the same."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkquire.llm import bpe, bytetext, decontaminate, jaccard_join, queries, sharding, sieve

DOCS = "doc_id long, text string, lang string, source string, n_shingles int"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups phi chi psi ome".split()
ODD = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "ONE two"), (None, "one two three four"), (8, "one two three four"), (8, "one two three four"), (9, "É é É é É é")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def corpus(seed, n=60):
    """Texts with exact copies, edits at many rates and shared passages."""
    rng = random.Random(seed)
    rows, base = [], [rng.choices(WORDS, k=rng.randint(1, 220)) for _ in range(8)]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 9))):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i * 3, " ".join(w)))
    return rows


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, num, k):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return Counter((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize(("seed", "num", "k"), [(1, 90, 3), (2, 80, 5), (3, 60, 2)])
def test_jaccard_components(spark, seed, num, k):
    rows = corpus(seed) + ODD
    got = Counter(map(tuple, jaccard_join.jaccard_components(docs(spark, rows), num, 100, k).collect()))
    assert got == brute_components(rows, num, k)


def test_jaccard_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    rows = corpus(7, 50)
    got = Counter(map(tuple, jaccard_join.jaccard_components(docs(spark, rows), 80, 100, 3).collect()))
    assert got == brute_components(rows, 80, 3)


def test_texts_that_a_polynomial_confuses_stay_apart(spark):
    """The Thue-Morse word and its complement collide under every polynomial modulo 2**64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}"), (5, a.upper())]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs(spark, rows), 90, 100, 3).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    spans = bytetext.SpanHashes(np.frombuffer((a + b).encode(), np.uint8))(np.array([0, 4096, 0, 8, 4096, 4104]), np.array([4096, 8192, 8, 16, 4104, 4112]))
    assert spans[0] != spans[1] and spans[2] == spans[5] and spans[3] == spans[4]


def test_one_row_of_a_class_is_signed():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "rid": list(range(50)), "text": ["one two three four five"] * 48 + ["six seven eight nine", None]})
    out = pa.Table.from_batches(jaccard_join._class_rows(80, 100, 2)(iter([batch, batch])))
    assert sum(out["signs"].to_pylist()) == 2
    assert all(bool(s) == new for s, new in zip(out["sigs"].to_pylist(), out["signs"].to_pylist()))


def test_one_row_of_each_component_stays(spark):
    text = " ".join(WORDS * 3)
    rows = [(5, text), (3, text + " more"), (3, "unlike the other of this id"), (3, text + " more"), (9, None), (9, None), (7, "alone"), (7, "alone"), (None, "nameless words")]
    gone, again = jaccard_join.repeats(docs(spark, rows), 80, 100, 2)
    key = {r.k: (r.doc_id, r.text) for r in docs(spark, rows).withColumn("k", F.xxhash64("doc_id", "text")).collect()}
    assert [key[r.key] for r in gone.collect()] == [(5, text)]
    assert sorted(key[r.key] for r in again.collect()) == [(3, text + " more"), (7, "alone")]


def test_jaccard_without_rows(spark):
    assert jaccard_join.jaccard_components(docs(spark, []), 90, 100, 3).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 10**6), st.sampled_from([60, 80, 90]))
def test_similar_sets_share_a_signature(size, edits, seed, num):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(1, 2**63, size, dtype=np.uint64))
    b = np.unique(np.concatenate([a[edits:], rng.integers(1, 2**63, edits // 2, dtype=np.uint64)]))
    inter = len(np.intersect1d(a, b))
    if not len(b) or 100 * inter < num * (len(a) + len(b) - inter) or np.array_equal(a, b):
        return
    sizes = np.array([len(a), len(b)])
    sig, of = jaccard_join.Bands(num, 100, 1000).signatures(np.concatenate([a, b]), sizes)
    assert set(sig[of == 0]) & set(sig[of == 1])


def test_seams_do_not_depend_on_what_a_task_has_seen(spark):
    words = [f"w{i}" for i in range(160)]
    pairs = [(94, 96), (141, 146)]  # 90 and 92, 137 and 142 shingles of five words: on either side of a band's edge
    rows = [(10 * i + j, " ".join(f"{w}x{i}" for w in words[:n])) for i, pair in enumerate(pairs) for j, n in enumerate(pair)]
    apart = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(apart, 80, 100, 5).collect()}
    assert got == {0: 0, 1: 0, 10: 10, 11: 10}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB é\n\t\x0b\x0c\x1c中", max_size=40), max_size=6), st.integers(1, 4))
def test_shingles_of_a_batch(texts, k):
    got = []
    for _, x, _, sizes in bytetext.shingle_sets(pa.array(texts, pa.string()), k):
        got += [len(s) for s in np.split(x, np.cumsum(sizes)[:-1])] if len(sizes) else []
    assert got == [len(shingle_set(t, k)) for t in texts]


@pytest.mark.parametrize("k", [2, 3, 5])
def test_short_texts_hash_alike_anywhere_in_a_slice(k):
    short = ["one", "one two", "one two three four"]
    for text in short:
        (_, x, row, _), = bytetext.shingle_sets(pa.array([text, "a b c d e f", text, text, "g", text]), k)
        sets = [x[row == i].tolist() for i in (0, 2, 3, 5)]
        assert sets[0] and all(s == sets[0] for s in sets)
    alone = {x.tobytes() for t in short for _, x, _, _ in bytetext.shingle_sets(pa.array([t]), k)}
    assert len(alone) == len(short)


def test_short_copies_link_from_a_partitions_end(spark):
    rows = [(1, "one two"), (2, "a b c d e f"), (3, "one two"), (4, "one three")]
    for parts in (1, 4):
        apart = spark.createDataFrame(spark.sparkContext.parallelize(rows[:3] + rows[3:] * (parts > 1), parts), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(apart, 80, 100, 5).collect()}
        assert (got[1], got[2], got[3], got.get(4, 4)) == (1, 2, 1, 4)


def brute_hits(rows, items, window=10):
    pattern, lower = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {i: i + 32 for i in range(65, 91)}
    words = lambda t: pattern.findall((t or "").translate(lower))
    known = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = Counter()
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in known}:
            for j in range(len(w) - n + 1):
                if ids := known.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    found |= {str(i) for i in ids if i is not None}
        out[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


def test_decontamination(spark):
    rng = random.Random(11)
    items = [(i, " ".join(rng.choices(WORDS, k=n))) for i, n in enumerate((1, 2, 9, 10, 11, 30, 60, 30))] + [(20, None), (21, ""), (None, "unnamed item of four"), (6, "repeated id with other words and more than ten of them here")]
    rows = corpus(5, 30) + ODD
    for i in range(30):
        w = rng.choices(WORDS, k=20)
        item = (items[rng.randrange(8)][1] or "").split()
        cut = rng.randint(0, 3)
        rows.append((1000 + i, "! ".join(w[:10]) + "? " + ", ".join(x.upper() for x in item[cut:]) + " " + " ".join(w[10:])))
    rows.append((5000, "unnamed item of four"))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_hit int")
    got = Counter(map(tuple, decontaminate.contaminated(docs(spark, rows), bench).collect()))
    assert got == brute_hits(rows, items)


def test_decontamination_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.contaminated(docs(spark, [(1, "a b c")]), none).collect()] == [False]
    assert decontaminate.contaminated(docs(spark, []), none).collect() == []


def test_decontamination_joins_a_large_benchmark_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    text = " ".join(WORDS)
    bench = spark.createDataFrame([(1, text), (2, "alpha beta")], "item_id long, text string")
    rows = [(1, "x " + text), (2, "none of it"), (3, None)]
    assert Counter(map(tuple, decontaminate.contaminated(docs(spark, rows), bench).collect())) == brute_hits(rows, [(1, text), (2, "alpha beta")])


def test_ids_of_few_windows_in_many_items_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, items = [(1, " ".join(WORDS[:12])), (2, "clean")], [(i, " ".join(WORDS[:10])) for i in range(3)]
        found = decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
        assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
        assert Counter(map(tuple, found.collect())) == brute_hits(rows, items)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_winnowing_keeps_few_fingerprints_and_loses_no_window(spark):
    """At most about 2 / (w + 1) rows a word go to the join, and equal windows share one."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 400, 2000))) for i in range(6)]
    rows.append((6, " ".join(["same"] * 300)))
    hashed = docs(spark, rows).select("doc_id", decontaminate.word_hashes(F.col("text")).alias("h"))
    for kind in ((5, 10), (2, 4), (1, 1), (3, 3)):
        w = kind[1] - kind[0] + 1
        got = decontaminate.fingerprints(hashed, [kind]).select("doc_id", "p", "fp").collect()
        assert len(got) <= 1.1 * 2 / (w + 1) * 12_300
        places = {(r.doc_id, r.p) for r in got}
        for d, t in rows:
            for j in range(len(t.split()) - kind[1] + 1):
                assert any((d, p) in places for p in range(j, j + w))
    text = rows[0][1].split()
    shared = docs(spark, [(10, "x y z " + " ".join(text[50:60])), (11, " ".join(text[50:60]) + " other words")]).select("doc_id", decontaminate.word_hashes(F.col("text")).alias("h"))
    got = decontaminate.fingerprints(shared, [(5, 10)]).select("doc_id", "fp").collect()
    assert {r.fp for r in got if r.doc_id == 10} & {r.fp for r in got if r.doc_id == 11}


def test_documents_are_read_once(spark, tmp_path, monkeypatch):
    docs(spark, [(1, "a b c"), (2, " ".join(WORDS))]).write.parquet(f"{tmp_path}/documents")
    bench = spark.createDataFrame([(1, " ".join(WORDS)), (2, "b c")], "item_id long, text string")
    scans, plain = [], decontaminate.cut
    count = lambda df: len(re.findall(r"FileScan parquet[^\n]*documents", df._jdf.queryExecution().executedPlan().toString()))
    monkeypatch.setattr(decontaminate, "cut", lambda df: scans.append(count(df)) or plain(df))
    out = decontaminate.contaminated(spark.read.parquet(f"{tmp_path}/documents"), bench)
    assert sum(scans) + count(out) == 1
    assert {r.doc_id for r in out.where("contaminated").collect()} == {1, 2}


def test_native_plan_has_no_python(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = decontaminate.contaminated(docs(spark, [(1, "a b c")]), bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    bench = spark.createDataFrame([(1, " ".join(WORDS[:10]))], "item_id long, text string")
    rows = docs(spark, [(1, "clean text"), (1, " ".join(WORDS)), (None, " ".join(WORDS)), (None, "clean"), (2, None)])
    gone = decontaminate.contaminated_keys(rows, bench)
    left = sieve.leave_out(rows, gone, F.xxhash64("doc_id", "text"), "doc_id")
    assert not re.search("Python|Pandas|Arrow", left._jdf.queryExecution().executedPlan().toString())
    left = left.collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter([(1, "clean text"), (None, "clean"), (2, None)])


def test_a_full_sieve_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(sieve, "BITS", 64)
    monkeypatch.setattr(sieve, "MOST_BITS", 64)
    rows = docs(spark, [(i, f"t{i}") for i in range(200)])
    gone = rows.where("doc_id % 3 = 0").select(F.xxhash64("doc_id", "text").alias("key"), "doc_id")
    assert sorted(r.doc_id for r in sieve.leave_out(rows, gone, F.xxhash64("doc_id", "text"), "doc_id").collect()) == [i for i in range(200) if i % 3]


# sharding


def brute_shard(doc_id, weights):
    best = None
    for i, w in enumerate(weights):
        if w > 0:
            u = (int(hashlib.md5(f"shard:{i}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            best = max(best or (-1, -1), (-w / np.log(u), i))
    return best[1]


def test_sharding(spark):
    rows = [(i, f"text {i % 7}") for i in range(300)] + ODD
    out = sharding.shard_rows(docs(spark, rows), [1, 1, 2, 0], [1, 1, 2, 0, 1]).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    for r in out:
        assert r.shard == brute_shard(r.doc_id, [1, 1, 2, 0]) and r.grown_shard in (r.shard, 4)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    heavy = Counter(r.shard for r in out)
    assert heavy[2] > heavy[0] and 3 not in heavy


def test_sharding_without_rows_or_weights(spark):
    assert sharding.shard_rows(docs(spark, []), [1], [1, 1]).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_rows(docs(spark, []), [0], [1])


# tokens

tokens = pytest.mark.skipif(not os.path.exists(queries.TOKENIZER), reason="no tokenizer file")
TRICKY = [" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　", "don't we'll I'M 's 'sx", "<|endoftext|>a<|endoftext|>", "²³½Ⅷ٣12", "中文的\U0001f642\U0001f469‍", "a" * 70, "  two  spaces ", "x\n\n\ny", "_under_score", "﻿", "", "é" * 40, "!!!***???"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER)


@tokens
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.sampled_from(TRICKY)), max_size=5))
def test_tokens_equal_the_library(texts):
    model, lib = bpe.tokenizer(queries.TOKENIZER), library()
    texts = [re.sub("[\ud800-\udfff]", "", t) for t in texts]
    for text, ids in zip(texts, bpe.Encoder(model).encode(texts)):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert model.decode(np.frombuffer(ids, "<u4")) == lib.decode(want, skip_special_tokens=False)


@tokens
def test_lexicon_decides_speed_only(tmp_path):
    model = bpe.tokenizer(queries.TOKENIZER)
    rng = random.Random(2)
    words = {"".join(rng.choices("abcde fgé", k=rng.randint(1, 12))).encode() for _ in range(800)}
    built = bpe.Transducer.build({w: model.merge(w) for w in words})
    mapped = bpe.Transducer.map(built.save(str(tmp_path)))
    assert mapped.find(sorted(words)).tolist() == list(range(len(words)))
    assert (mapped.find([b"", b"zzz", b"a" * 99]) == -1).all()
    assert len(mapped.final) < sum(len(w) for w in words) / 2  # suffixes are shared
    texts = ["".join(rng.choices("abcde fgé ", k=80)) for _ in range(50)] + TRICKY
    assert bpe.Encoder(model, mapped).encode(texts) == bpe.Encoder(model).encode(texts)


@tokens
def test_merging_together_equals_merging_alone():
    model, rng = bpe.tokenizer(queries.TOKENIZER), random.Random(4)
    words = [bytes(rng.choices(b"aeiou thr\xc3\xa9!*", k=rng.randint(1, 60))) for _ in range(800)]
    ids, at = model.merge_many(words)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [model.merge(w) for w in words]
    assert model._merge_long([model.of_byte[b] for b in words[0]]) == model.merge(words[0])


@tokens
def test_round_trip_of_rows(spark, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 500)
    rows = ODD + [(100, "the " * 400), (101, "<|endoftext|>")] + corpus(3, 10)
    df = docs(spark, rows).withColumnRenamed("n_shingles", "ids")
    lexicon = bpe.build_lexicon(df, queries.TOKENIZER, 50)
    out = bpe.encode_decode(df, queries.TOKENIZER, lexicon, ["doc_id", "ids"]).collect()
    lib = library()
    assert Counter((r.doc_id, r.decoded, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out) == Counter((d, t or "", tuple(lib.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    empty = docs(spark, [])
    assert bpe.digests(bpe.encode_decode(empty, queries.TOKENIZER, bpe.build_lexicon(empty, queries.TOKENIZER), ["doc_id"])).collect() == []


def test_large_families_are_parted_before_they_are_verified(spark, monkeypatch):
    """A chain of chance meetings is one family of the meetings; only what may be linked stays together."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    rng = np.random.default_rng(5)
    bases = [rng.integers(0, 2**63, 300).astype(np.uint64) for _ in range(6)]
    sets = [np.concatenate([b[: 300 - k], rng.integers(0, 2**63, k).astype(np.uint64)]) for b in bases for k in (0, 20)]
    told = jaccard_join.sketches(np.concatenate(sets), np.full(12, 300))
    rows = [(bytes([i]), i, 300, i, 0) for i in range(12)]
    members = spark.createDataFrame(rows, "cid binary, rid long, n long, c1 long, family long")
    meets = [(g, g, i, j) for g, (i, *others) in enumerate([(0, 1, 2, 3), (2, 3, 4, 5, 6), (6, 7, 8, 9, 10, 11)]) for j in (i, *others)]
    parted = jaccard_join._parted(members, spark.createDataFrame(meets, "k1 long, k2 long, a long, b long"), spark.createDataFrame([(bytes([i]), i, 300, t) for i, t in enumerate(told)], "cid binary, c1 long, n long, sketch binary"), 80, 100)
    assert sorted((r.c1, r.family) for r in parted.collect()) == [(i, i - i % 2) for i in range(12)]


def test_sketches_never_part_what_is_linked():
    """Sets at the very threshold, of sizes whose sketches differ in length."""
    rng = np.random.default_rng(6)
    for n in (1, 5, 60, 64, 65, 120, 128, 500, 1000, 1024):
        x = rng.integers(0, 2**63, 2 * n + 10).astype(np.uint64)
        for other in (x[: max(1, -(-4 * n // 5))], x[: n + n // 4], np.concatenate([x[: n - n // 9], x[n : n + n // 9]])):
            a = x[:n]
            inter = len(np.intersect1d(a, other))
            linked = 100 * inter >= 80 * (len(a) + len(other) - inter)
            sizes = np.array([n, len(other)])
            root = jaccard_join.possible_roots(jaccard_join.sketches(np.concatenate([a, other]), sizes), sizes, 80, 100)
            assert linked and root.tolist() == [0, 0]
