"""Ids and orders beyond the digits they are padded to, numbers in a global order, number formats."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkquire.functions import text as T
from sparkquire.operators import dedup, facts, judging, numbering, sequence, threads
from sparkquire.params import Params
from sparkquire.sinks import export
from sparkquire.sources import manifest, readers


def test_more_than_999_groups_have_a_main_version_each(spark):
    pairs = spark.range(1200).select(F.concat(F.lit("s"), F.col("id") * 2).alias("a"), F.concat(F.lit("s"), F.col("id") * 2 + 1).alias("b"))
    groups = dedup.version_groups(pairs)
    scenes = spark.range(2400).select(F.concat(F.lit("s"), "id").alias("id"), F.col("id").alias("chars"), F.lit(0.0).alias("mtime"))
    mains = dedup.choose_main(groups, scenes).collect()
    by_group = {}
    for r in mains:
        by_group.setdefault(r.group, []).append(r)
    assert len(by_group) == 1200 and all(len(g) == 2 and sum(r.is_main for r in g) == 1 for g in by_group.values())
    first = {r.first: r.group for r in groups.collect()}
    assert first["s0"] == "G-001" and first["s1998"] == "G-1000" and first["s2398"] == "G-1200"


def test_more_than_999_holes_keep_their_ids(spark):
    placed = spark.range(1, 11).select(F.concat(F.lit("S-"), "id").alias("scene"), F.lit("T-1").alias("thread"), F.col("id").alias("place"))
    gaps = spark.range(1200).select(F.concat(F.lit("g"), "id").alias("gap"), F.lit("T-1").alias("thread"), F.when(F.col("id") < 1100, F.concat(F.lit("S-"), F.col("id") % 10 + 1)).alias("after"), F.lit(None).cast("string").alias("before"))
    board = spark.createDataFrame([], "thread string, col string, merge_into string")
    items, unplaced = sequence.insert_holes(placed, gaps, board)
    holes = [r.item for r in items.where("type = 'hole'").orderBy("place").collect()] + sorted((r.item for r in unplaced.collect()), key=lambda x: int(x[2:]))
    assert holes == [f"H-{i:03d}" for i in range(1, 1201)]
    assert [r.place for r in items.orderBy("place").collect()] == list(range(1, 1111))


def test_more_than_9999_scenes_keep_their_ids(spark):
    old = spark.createDataFrame([("S-0003", "a", 0, "h", False)], "id string, source string, index long, hash string, removed boolean")
    new = spark.range(10_001).select(F.lit("b").alias("source"), F.col("id").alias("index"), F.lit("x").alias("hash"))
    got = {r["index"]: r.id for r in manifest.reconcile_scenes(old, new).where("status = 'new'").collect()}
    assert len(set(got.values())) == 10_001 and got[0] == "S-0004" and got[9995] == "S-9999" and got[9996] == "S-10000"
    ids = manifest.next_ids(old, spark.range(2), "S", [F.col("id")]).collect()
    assert sorted(r.id for r in ids) == ["S-0004", "S-0005"]


def test_digit_runs_of_any_length_compare_by_value(spark):
    a, b = "x" + "1" * 25 + "7", "x" + "1" * 25 + "8"
    names = [b, a, "x2", "X10", "x" + "9" * 24, "x007", "y1"]
    rows = spark.createDataFrame([(n,) for n in names], "s string").orderBy(T.natural_text(F.col("s"))).collect()
    assert [r.s for r in rows] == ["x2", "x007", "X10", "x" + "9" * 24, a, b, "y1"]


def test_numbers_have_six_digits_as_python_formats_them(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, -2.5, 1234567.25, 12345678901234.0, 0.0001234567, 0.00001234, 100000.0, 999999.4, 999999.6, 1e6, 1e-5, 1e300, -1e-300, 3.0, 0.1 + 0.2, 120.0] + [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 12) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.format_number(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in rows} == {v: f"{v:g}" for v in values}
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double").select(T.format_number(F.col("v")).alias("s"))
    assert [r.s for r in odd.collect()] == ["?", "nan", "inf", "-inf"]


def test_numbers_in_a_global_order(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(900)).alias("k"), "id").repartition(7)
    got = numbering.numbered(rows, [F.desc("k"), "id"]).orderBy("no").collect()
    assert [r.no for r in got] == list(range(1, 5001)) and [(r.k, r.id) for r in got] == sorted(((r.k, r.id) for r in got), key=lambda x: (-x[0], x[1]))
    assert numbering.numbered(rows.limit(0), ["k"]).collect() == []
    with pytest.raises(ValueError):
        numbering.numbered(rows, [])


def test_spellings_of_one_number_are_one_value(spark):
    rows = spark.createDataFrame([(s, "甲", "年龄", v) for s, v in enumerate(["十二岁", "12岁", "十三", "13岁", "二十"])] + [(9, "乙", "年龄", "三"), (9, "乙", "其他", "四"), (9, None, "年龄", "五")], "scene long, subject string, attribute string, value string")
    got = {(r.subject, r.value): r.merged for r in facts.merge_values(rows).collect()}
    assert got[("甲", "12岁")] == got[("甲", "十二岁")] == "12岁" and got[("甲", "十三")] == "13岁" and got[("甲", "二十")] == "二十" and got[("乙", "三")] == "三"
    assert ("乙", "四") not in got


def test_chains_of_many_points_are_quick():
    rng = random.Random(3)
    points = [(float(i), rng.random()) for i in range(20_000)]
    found = threads.longest_chain(points)
    assert 200 < len(found) < 400 and all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(found, found[1:]))


def test_detectors_are_given_not_found():
    assert readers.detect_encoding(b"\xff\xff\xff") == "utf-8"
    assert readers.detect_encoding(b"\xff\xff\xff", lambda data: "cp1252") == "cp1252"
    assert readers.decode(b"\xff\xff\xff", lambda data: None)[1] == "utf-8"


def test_hand_broken_lines_become_paragraphs():
    assert export.paragraphs("一行。\n二行。") == ["一行。", "二行。"]
    assert export.paragraphs("　　第一段的第一行\n第二行\n第三行。\n　　第二段。") == ["第一段的第一行第二行第三行。", "第二段。"]
    assert export.paragraphs(" \n\n") == []


def test_paths_stay_within_their_folder(tmp_path):
    assert manifest.ensure_within(str(tmp_path), "a/../b.txt") == tmp_path.resolve() / "b.txt"
    assert manifest.ensure_within(str(tmp_path), ".") == tmp_path.resolve()
    for bad in ("../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(ValueError):
            manifest.ensure_within(str(tmp_path), bad)


def test_small_rules(spark):
    row = spark.createDataFrame([("abcdef", "ab")], "a string, b string").select(T.now_iso().alias("now"), T.shortened(F.col("a"), 3).alias("x"), T.shortened(F.col("b"), 3).alias("y")).first()
    assert len(row.now) == 19 and row.now[10] == "T" and row.x == "abc…" and row.y == "ab"
    plain, refused = ValueError("one"), judging.Refused("no key")
    assert judging.pick_error([plain, refused]) is refused and judging.pick_error([plain, KeyError("two")]) is plain and judging.pick_error([]) is None


@pytest.mark.parametrize("seed", range(3))
def test_pairs_equal_counting_all_shingles(spark, monkeypatch, seed):
    """Rarest shingles first lose no pair: against every pair's countable shingles, with a cap that bites."""
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcd", k=rng.randint(60, 300))) for _ in range(5)]
    texts = []
    for _ in range(70):
        t = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 4, 12, 40))):
            t[rng.randrange(len(t))] = rng.choice("abcde")
        a = rng.randrange(len(t) // 2)
        texts.append("".join(t[a : a + rng.randint(len(t) // 3, len(t))]))
    params = Params(dedup_min_shingles=20, dedup_common_df=25)
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} if len(t) >= 5 else {t} for t in texts]
    big = [i for i, s in enumerate(sets) if len(s) >= 20]
    df = {}
    for i in big:
        for g in sets[i]:
            df[g] = df.get(g, 0) + 1
    able = {i: {g for g in sets[i] if 2 <= df[g] <= 25} for i in big}
    want = {}
    for i in big:
        for j in big:
            n = len(able[i] & able[j])
            if i < j and n and (n / (len(sets[i]) + len(sets[j]) - n) >= 0.5 or n / min(len(sets[i]), len(sets[j])) >= 0.8):
                want[(str(i), str(j))] = n
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    for few in (dedup.BROADCAST_PAIRS, 0):
        monkeypatch.setattr(dedup, "BROADCAST_PAIRS", few)
        got = {(r.a, r.b): (r.inter, r.na, r.nb) for r in dedup.shared_counts(docs, params).collect()}
        assert all(got[k] == (n, len(sets[int(k[0])]), len(sets[int(k[1])])) for k, n in want.items()) and want


def test_shingle_sets_in_slices(spark):
    texts = ["", None, "ab", "abcde", "abcdef", "字" * 9, "a-b c.d!e f", "𝒳𝒳𝒳𝒳𝒳x"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    got = {r.id: (r.n, set(r.hs)) for r in dedup.shingle_counts(docs).join(dedup.shingle_sets(docs), "id").collect()}
    assert [got[str(i)][0] for i in range(8)] == [0, 0, 1, 1, 2, 1, 2, 2] and all(len(s) == n for n, s in got.values())
    assert got["4"][1] == got["6"][1] > got["3"][1]  # noise between letters doesn't count
    whole, rng = [], random.Random(1)
    texts = pa.array(["".join(rng.choices("abc", k=rng.randrange(50))) for _ in range(200)] + [None])
    for size in (10**6, 70, 1):
        dedup.SLICE_CHARS, kept = size, dedup.SLICE_CHARS
        try:
            runs = list(dedup._windows(texts, 5))
        finally:
            dedup.SLICE_CHARS = kept
        whole.append((np.concatenate([h for h, _ in runs]).tolist(), np.concatenate([n for _, n in runs]).tolist()))
    assert whole[0] == whole[1] == whole[2] and len(whole[0][1]) == 201


def test_texts_in_parts_by_their_references(spark):
    said = ["见[S-0001、S-0012]和[x][S-3] [[S-0002]]", "", None, "[S-0001][S-0002]", "无", "x" * 200_000 + "[S-0001]" + "\n[" * 50]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", T.ref_parts(F.col("s")).alias("p")).orderBy("i").collect()
    assert [["".join(x.text for x in r.p)] for r in rows] == [[s or ""] for s in said]
    assert [(x.text, x.refs) for x in rows[0].p] == [("见", []), ("[S-0001、S-0012]", ["S-0001", "S-0012"]), ("和[x][S-3] [", []), ("[S-0002]", ["S-0002"]), ("]", [])]
    assert [len(r.p) for r in rows] == [5, 0, 0, 2, 1, 3]
