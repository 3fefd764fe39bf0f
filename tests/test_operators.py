"""Hand-computed cases of single operators."""

import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkquire import storage
from sparkquire.functions import text as T
from sparkquire.functions import vectorised as V
from sparkquire.operators import archive, dedup, entities, facts, folds, sequence, split, state, threads, timeline, triage
from sparkquire.operators import components as module
from sparkquire.operators.components import components
from sparkquire.params import DEFAULTS, Params
from sparkquire.plans import fact_queries
from sparkquire.sinks import export
from sparkquire.sources import manifest, readers


def column(spark, rows, kind, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(df.v).alias("x")).orderBy("i").collect()]


# scalars


def test_text_functions(spark):
    assert column(spark, ["a, b_c 中。1", ""], "string", T.normalize) == ["abc中1", ""]
    assert column(spark, ["年齡", "【官职】", "心事", None], "string", T.norm_attribute) == ["年龄", "官职", "其他", "其他"]
    names = ["片段10", "片段2", "a1", "A01", "b"]
    assert sorted(names, key=dict(zip(names, column(spark, names, "string", T.natural_text))).get)[-2:] == ["片段2", "片段10"]
    assert column(spark, ["[S-0001] x [S-0002、S-0003] S-0004", "none"], "string", T.scene_refs) == [["S-0001", "S-0002", "S-0003"], []]
    assert column(spark, ['a/b:c?"', " .x. "], "string", T.safe_name) == ["a_b_c__", "x"]


def test_headings_agree_in_both_forms(spark):
    lines = ["第一章", "第一章 风起", "第九章他来了", "第二卷。", "Chapter 4", "chapter 5,", "# T", "#T", "12", "十二", "好！", "", "  第五回  ", "x" * 60, "第1章：开", "Chapter x", "一百"]
    assert column(spark, lines, "string", T.is_heading) == [split.heading(x) for x in lines]
    assert column(spark, lines, "string", T.heading_level) == [split.level(x) for x in lines]
    marks = ["***", "--", "- - -", "=-=", "a--", "☆☆☆"]
    assert column(spark, marks, "string", T.is_separator) == [split.separator(x) for x in marks] == [True, False, True, True, False, True]


@pytest.mark.parametrize(("run", "value"), [("十六", 16), ("二十四", 24), ("三千", 3000), ("十", 10), ("一百零五", 105), ("十万", 100000), ("三万五千", 35000), ("六", 6), ("千", None), ("万", None), ("百", None), ("一九三七", None), ("二零零八", None)])
def test_chinese_integers(run, value):
    assert V.chinese_integer(run) == value


def test_number_and_name_keys():
    assert V.number_key("十六岁") == V.number_key("16岁") and V.number_key("千年") == "千年"
    assert V.name_core("林姑娘") == "林" and V.name_core("师父") == "师父" and V.name_core("老王大哥") == "王"
    assert V.nick_core("阿清") == V.nick_core("清儿") == "清" and V.nick_core("阿") == "阿"
    assert V.id_key("w-1") == V.id_key("Ｗ－０１") == V.id_key("W01") and V.id_key("S-0001-3") != V.id_key("S-0013")


def test_params_overlay():
    assert DEFAULTS.overlay({"dedup_jaccard": 0.7, "other": 1}).dedup_jaccard == 0.7
    with pytest.raises(ValueError):
        DEFAULTS.overlay({"split_target_chars": 9000})


# splitting


def test_split_cuts_and_headings():
    text = "序言一段。\n\n\n第一章 风起\n正文甲。\n***\n正文乙。\n\n第二章\n正文丙。"
    found = [(text[a:b], h, p) for a, b, h, p in split.blocks(text)]
    assert found == [("序言一段。", "", 1), ("第一章 风起\n正文甲。", "第一章 风起", 1), ("正文乙。", "第一章 风起", 2), ("第二章\n正文丙。", "第二章", 1)]
    contents = "目录\n第一章\n\n\n第二章\n\n\n第三章\n\n\n第一章\n正文。"
    assert [h for *_, h, _ in split.blocks(contents)][-1] == "第一章"
    joined = split.blocks("第一卷\n第一章\n正文。")
    assert [(h, p) for *_, h, p in joined] == [("第一卷 / 第一章", 1)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="字a。\n　#第一章*-", max_size=400))
def test_split_keeps_order_and_loses_no_text(text):
    rules = split.Rules(60, 30, 2)
    found = split.blocks(text, rules)
    assert all(a < b for a, b, *_ in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    assert all(b - a <= 60 for a, b, *_ in found)
    left = "".join(text[x:y] for x, y in zip([0] + [b for _, b, *_ in found], [a for a, *_ in found] + [len(text)]))
    assert not left.strip() or all(split.separator(x) or not x.strip() for x in left.split("\n"))


def test_split_table_function(spark):
    split.register_udtf(spark)
    rows = spark.sql("SELECT s.* FROM VALUES ('第一章\n甲。\n\n\n乙。') t(x), LATERAL split_scenes(x, 5000, 3000, 2) s").collect()
    assert [(r["index"], r.heading, r.part) for r in rows] == [(0, "第一章", 1), (1, "第一章", 2)]


# near duplicates


def han(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))


def test_versions_of_a_scene(spark):
    rng = random.Random(1)
    whole = han(rng, 2000)
    copy = "".join(whole[i : i + 100] for i in range(0, 2000, 100) if i % 700)
    rows = [("S-0001", whole), ("S-0002", copy), ("S-0010", whole[400:1400]), ("S-0003", han(rng, 1500)), ("S-0004", "短")]
    docs = spark.createDataFrame(rows, "id string, text string")
    pairs = dedup.near_duplicate_pairs(docs)
    kinds = {(r.a, r.b): r.kind for r in pairs.collect()}
    assert kinds["S-0001", "S-0002"] == "jaccard" and ("S-0001", "S-0010") in kinds
    groups = dedup.version_groups(pairs)
    assert {(r.group, r.id) for r in groups.collect()} == {("G-001", "S-0001"), ("G-001", "S-0002"), ("G-001", "S-0010")}
    scenes = docs.select("id", F.length("text").alias("chars"), F.lit(1.0).alias("mtime"))
    mains = dedup.choose_main(groups, scenes)
    assert [r.id for r in mains.where("is_main").collect()] == ["S-0001"]
    pinned = spark.createDataFrame([("S-0010",), ("S-0099",)], "id string")
    mains = dedup.choose_main(groups, scenes, pinned)
    assert [(r.id, r.main_by) for r in mains.where("is_main").collect()] == [("S-0010", "author")]
    assert [r.id for r in dedup.voided_pins(mains, pinned).collect()] == ["S-0099"]
    assert [r.id for r in dedup.set_main(mains, "G-001", "S-0002").where("is_main").collect()] == ["S-0002"]


def test_a_fragment_joins_its_best_container_only(spark):
    rng = random.Random(2)
    a, b, piece = han(rng, 900), han(rng, 900), han(rng, 150)
    docs = spark.createDataFrame([("1", a + piece), ("2", b + piece[:140] + han(rng, 60)), ("3", piece)], "id string, text string")
    got = dedup.near_duplicate_pairs(docs, Params(dedup_min_shingles=50)).collect()
    assert [(r.a, r.b, r.kind) for r in got] == [("1", "3", "containment")]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_a_round_of_components_shuffles_twice_and_stars_need_no_second_cut(spark, monkeypatch):
    cuts = []

    def cut(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        cuts.append(plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning"))
        return storage.cut(df)

    monkeypatch.setattr(module, "cut", cut)
    edges = [(0, i) for i in range(1, 40)] + [(50, 51), (50, 52), (51, 50), (60, 60), (None, 61)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == dict.fromkeys(range(40), 0) | {50: 50, 51: 50, 52: 50, 60: 60}
    assert cuts == [1, 5]  # repeats; the first step and two rounds
    chain = [(i, i + 1) for i in range(200)]
    random.Random(3).shuffle(chain)
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert got == dict.fromkeys(range(201), 0) and set(cuts[3:]) <= {4, 5}


# names and facts


def test_merged_values(spark):
    rows = [("S-1", "甲", "年龄", v, "") for v in ("十六", "16岁", "十六岁")] + [("S-2", "甲", "年龄", "二十", "")] + [("S-1", "乙", "兵器", v, "") for v in ("金箍棒", "如意金箍棒")] + [("S-1", "乙", "来历", v, "") for v in ("千年", "万年")]
    merged = facts.merge_values(spark.createDataFrame(rows, "scene string, subject string, attribute string, value string, quote string"))
    got = {(r.subject, r.attribute): r for r in facts.candidates(merged).collect()}
    assert got.keys() == {("甲", "年龄"), ("乙", "来历")}
    assert (got["甲", "年龄"].n_values, got["甲", "年龄"].scenes, got["甲", "年龄"].merged, got["甲", "年龄"].weight) == (2, 2, 2, 4)


def test_hints(spark):
    names = ["林清", "清儿", "林姑娘", "青州城外", "青州", "黄兄", "黄夫人", "黄老爷", "黄公子", "师父"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, place int")
    got = {(r.a, r.b): r.hint for r in entities.hint_pairs(df).collect()}
    assert got[("青州", "青州城外")] == "contains" and got[("清儿", "林清")] == "nickname"
    assert not any("黄兄" in k for k in got)  # one character, and many of it


def test_name_batches(spark):
    big = [f"n{i}" for i in range(50)]
    rows = [("big", n, i) for i, n in enumerate(big, 1)] + [("small", n, i) for i, n in enumerate(big[:20], 1)]
    chain = [("big", f"n{i}", f"n{i + 1}") for i in range(28, 46)] + [("big", "n6", "n20"), ("big", "n20", "n26"), ("big", "n0", "n49"), ("big", "zz", "n7"), ("small", "n1", "n2")]
    names = spark.createDataFrame(rows, "book string, name string, place int")
    out = {}
    for r in entities.name_batches(names, spark.createDataFrame(chain, "book string, a string, b string"), most=20, anchors=5).orderBy("place").collect():
        out.setdefault((r.book, r.batch), []).append(r.name)
    assert out.pop(("small", 1)) == big[:20]
    assert all(b[:5] == big[:5] and len(b) <= 20 for b in out.values()) and len(out) == 3
    assert sorted(n for b in out.values() for n in b[5:]) == sorted(big[5:])
    home = {n: k for k, b in out.items() for n in b[5:]}
    assert home["n6"] == home["n20"] == home["n26"]  # a family, though no pair links its ends
    assert len({home[f"n{i}"] for i in range(28, 43)}) == 1  # the first 15 of a family of 19: a batch's room


def test_dealt_sizes():
    assert entities.dealt_sizes([3, 3, 1, 2, 1], 5) == [1, 2, 1, 2, 1]
    assert entities.dealt_sizes([5, 1, 4], 5) == [1, 2, 2] and entities.dealt_sizes([], 5) == []
    assert entities.dealt_sizes([4, 4, 4], 6) == [1, 2, 3]  # more than all need, as none has room
    assert entities.dealt_sizes([3, 4, 3], 6) == [1, 2, 1]


def test_group_merging_with_anchors(spark):
    rows = [(0, 1, "a"), (0, 1, "b"), (1, 2, "b"), (1, 2, "c"), (1, 3, "a"), (1, 3, "z"), (1, 3, "d")]
    groups = spark.createDataFrame([(k, g, n, "b" if g == 2 else "a") for k, g, n in rows], "batch int, group int, name string, canonical string")
    counts = spark.createDataFrame([("a", 1), ("b", 5)], "name string, scenes int")
    merged, conflicts = entities.merge_groups(groups, counts, spark.createDataFrame([("a",), ("b",), ("z",)], "name string"))
    assert {(r.name, r.canonical) for r in merged.collect()} == {("a", "b"), ("b", "b"), ("c", "b")}
    assert [r.names for r in conflicts.collect()] == [["a", "d", "z"]]


def test_entity_votes_take_every_order_and_line(spark, tmp_path):
    rng = random.Random(3)
    lines = [(o, n + 1, 20 * (o % 5) + rng.randrange(20)) for o in range(1, 60) for n in range(rng.randint(1, 5))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    sets = []
    for o in {o for o, _, _ in lines}:
        mine = {s for k, _, s in lines if k == o}
        near = [s for s in sets if s & mine]
        sets = [s for s in sets if not s & mine] + [mine.union(*near)]
    got = sorted(map(tuple, fact_queries.q_entity_votes(spark, str(tmp_path)).collect()))
    assert got == sorted((n, min(s), len(s)) for s in sets for n in s)


# lines


@pytest.mark.parametrize(("orders", "want"), [([["a", "b", "c"]], list("abc")), ([list("abc"), list("abc"), list("cab")], list("abc")), ([list("ab"), list("bc")], list("abc")), ([], []), ([[], list("xy")], list("xy"))])
def test_consensus(orders, want):
    assert threads.consensus_order(orders) == want


def test_interleaving_keeps_lines():
    lines = {"L-1": list("abc"), "L-2": list("xy")}
    assert threads.interleave(list("baxcy"), lines) == list("abxcy")
    assert threads.interleave(["a", "x", "a", "?"], lines) == ["a", "b", "c", "x", "y"]
    assert threads.interleave([], lines) == list("abcxy")
    assert threads.interleave_score(list("abcxy"), lines) == 0 and threads.interleave_score(["b", "a", "?"], lines) == 1 + 9 + 5
    assert threads.mostly_placed(list("abcx"), lines) and not threads.mostly_placed(list("abc"), lines)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(list("abcdexyz?")), max_size=14))
def test_any_answer_becomes_a_valid_merge(order):
    lines = {"1": list("abcde"), "2": list("xyz")}
    out = threads.interleave(order, lines)
    assert sorted(out) == sorted("abcdexyz")
    assert all([s for s in out if s in line] == line for line in lines.values())


def test_chain_and_mapping(spark):
    assert threads.longest_chain([(1, 5), (2, 3), (3, 4), (3, 6), (4, 5)]) == [(1, 5.0), (3, 5.0), (4, 5.0)]  # of equal lengths, the earliest predecessors
    anchors = spark.createDataFrame([("L", 0.0, 10.0), ("L", 10.0, 40.0)], "line string, x double, y double")
    times = spark.createDataFrame([("L", "a", -1.0), ("L", "b", 0.0), ("L", "c", 5.0), ("L", "d", 12.0), ("L", "e", None), ("M", "f", 3.0)], "line string, scene string, t double")
    offsets = spark.createDataFrame([("L", None), ("M", 2.0)], "line string, offset double")
    moved, off = threads.anchor_times(times, offsets, threads.chains(anchors))
    assert {r.scene: r.t for r in moved.collect()} == {"a": -1.0, "b": 0.0, "c": 15.0, "d": 32.0, "e": None, "f": 3.0}
    assert {r.line: r.offset for r in off.collect()} == {"L": 10.0, "M": 2.0}
    assert threads.piecewise([(0, 10), (10, 40)], 5) == 25


def test_sequence_of_versions_and_holes(spark):
    scenes = spark.createDataFrame([("L-1", 0, "S-1", 1.0), ("L-1", 1, "S-2", 3.0), ("L-2", 0, "S-3", 0.5), ("L-2", 1, "S-9", 1.0), ("L-3", 0, "S-4", 1.0), ("L-4", 0, "S-5", None), ("L-5", 0, "S-6", 1.0)], "thread string, pos int, scene string, t double")
    lines = spark.createDataFrame([("L-1", 0.0, 1), ("L-2", 1.0, 2), ("L-3", None, 3), ("L-4", 0.0, 4), ("L-5", 0.0, 5)], "thread string, offset double, no int")
    board = spark.createDataFrame([("L-5", "cut", None)], "thread string, col string, merge_into string")
    vmap = spark.createDataFrame([("S-9", "S-1")], "scene string, main string")
    placed, rest = sequence.build_sequence(scenes, lines, board, "L-1", vmap)
    assert [r.scene for r in placed.orderBy("place").collect()] == ["S-1", "S-3", "S-2"]
    assert {(r.scene, r.why) for r in rest.collect()} == {("S-4", "unaligned_thread"), ("S-5", "no_time")}
    gaps = spark.createDataFrame([("Q-2", "L-1", "S-1", None), ("Q-1", None, None, "S-3"), ("Q-3", "L-1", "S-8", None), ("Q-4", "L-5", "S-1", None)], "gap string, thread string, after string, before string")
    items, left = sequence.insert_holes(placed, gaps, board)
    assert [r.item for r in items.orderBy("place").collect()] == ["S-1", "H-001", "H-002", "S-3", "S-2"]
    assert [(r.item, r.gap) for r in left.collect()] == [("H-003", "Q-3")]
    ranks = spark.createDataFrame([("S-2", 0), ("S-3", 1), ("S-1", 2)], "scene string, rank int")
    assert [r.scene for r in sequence.build_sequence(scenes, lines, board, "L-1", vmap, None, ranks)[0].orderBy("place").collect()] == ["S-2", "S-3", "S-1"]


def test_usable_order(spark):
    members = spark.createDataFrame([("1", "a", 0), ("1", "b", 1), ("2", "x", 0)], "line string, scene string, pos int")
    usable = lambda *o: threads.usable_order(spark.createDataFrame([(s, i) for i, s in enumerate(o)], "scene string, rank int"), members).first().usable
    assert usable("a", "x", "b") and not usable("b", "x", "a") and not usable("a", "x") and not usable("a", "x", "b", "y") and not usable("a", "a", "b", "x")


def test_folds():
    assert list(folds.overlapping_windows([9] * 25, 100, 3)) == [(0, 10), (7, 17), (14, 24), (21, 25)]
    assert list(folds.overlapping_windows([500, 1, 1], 100, 0)) == [(0, 1), (1, 3)]
    assert folds.sample_stride([10] * 100, 250) == 4 and folds.sample_stride([1], 5) == 1


def test_later_scenes_are_spread(spark):
    rows = spark.createDataFrame([("w", i) for i in range(12)], "who string, pos int")
    assert sorted(r.pos for r in timeline.pick_later(rows, ["who"], "pos").collect()) == [0, 1, 3, 7, 10]


def test_deaths(spark):
    rows = [("生死", "战死"), ("生死", "假死"), ("兵器", "死"), ("身份", "已故掌门"), ("生死", "")]
    df = spark.createDataFrame(rows, "a string, v string")
    assert [r.x for r in df.select(timeline.is_death(F.col("a"), F.col("v")).alias("x")).collect()] == [True, False, False, True, False]
    killer = spark.createDataFrame([("墨冉死于萧炎之手", ["萧炎"]), ("萧炎战死", ["萧炎", ""])], "v string, n array<string>")
    assert [r.x for r in killer.select(timeline.is_killer(F.col("v"), F.col("n")).alias("x")).collect()] == [True, False]


def test_board(spark):
    lines = spark.createDataFrame([("A",), ("B",), ("C",)], "thread string")
    board = spark.createDataFrame([("A", "merge", "B", "n"), ("B", "cut", None, None), ("D", "keep", None, None)], "thread string, col string, merge_into string, note string")
    got = {r.thread: (r.col, r.orphan, r.merge_invalid) for r in triage.reconcile(board, lines).collect()}
    assert got == {"A": ("merge", False, True), "B": ("cut", False, False), "C": ("undecided", False, False), "D": ("keep", True, False)}
    with pytest.raises(ValueError):
        triage.set_card(board, lines, "C", "merge", "B")
    assert {r.thread: r.col for r in triage.set_card(board, lines, "B", "keep").collect()}["B"] == "keep"
    with pytest.raises(KeyError):
        triage.set_card(board, lines, "X", "keep")


def test_steps(spark):
    steps = spark.createDataFrame([(s, "done") for s in state.STEPS], "step string, status string")
    assert {r.step: r.status for r in state.finish(steps, "dedup").collect()}["cards"] == "outdated"
    assert state.ready(steps, "archive") and not state.ready(state.finish(steps, "dedup"), "archive")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sig = lambda df: state.content_signature(df, ["k", "v"]).first().sig
    assert sig(rows) == sig(rows.orderBy(F.desc("k"))) != sig(rows.limit(1))


def test_jobs(spark):
    jobs = state.Jobs()
    job = jobs.submit(spark, "j", lambda progress: progress(1, 2) or 7)
    job.thread.join(20)
    assert (job.status, job.result, job.done) == ("done", 7, 1)
    job = jobs.submit(spark, "bad", lambda progress: 1 / 0)
    job.thread.join(20)
    assert job.status == "failed" and "ZeroDivision" in job.error


# archives, files, books


def test_backfill_runs_twice_to_the_same(spark):
    text = "### 兵器\n- **孫悟空**：棒（多个说法）\n- 行者: 棒（多个说法）\n- 八戒：耙（多个说法）（多个说法）\n# 兵器\n- 二名：（多个说法）\n## 兵器（多个说法）\n## 地理\n- 孙悟空：（多个说法）\n（多个说法）\n"
    bodies = spark.createDataFrame([("w", text), ("x", None), ("y", "无")], "id string, body string")
    groups = spark.createDataFrame([("孙悟空", "兵器", "C-007"), ("沙僧", "兵器", "C-008")], "subject string, attribute string, id string")
    aliases = spark.createDataFrame([("行者", "孙悟空"), ("二名", "孙悟空"), ("二名", "沙僧")], "name string, canonical string")
    once = archive.backfill(bodies, groups, aliases, ("孫", "孙"))
    got = {r.id: (r.body, r.left) for r in once.collect()}
    assert got["x"] == ("", 0) and got["y"] == ("无", 0)
    lines = got["w"][0].split("\n")
    assert [k for k, x in enumerate(lines) if "见矛盾 C-007" in x] == [1, 2] and got["w"][1] == 5
    assert lines[6] == "## 兵器（多个说法）" and lines[3].count(archive.MINOR) == 2 and lines[-1] == "" and len(lines) == text.count("\n") + 1
    assert {r.id: (r.body, r.left) for r in archive.backfill(once.select("id", "body"), groups, aliases, ("孫", "孙")).collect()} == got


def test_archive_faults(spark):
    bodies = spark.createDataFrame([("a", "## 缺口\n见 [S-0001]"), ("b", "nothing"), ("c", "## 缺口 [S-0009]")], "id string, body string")
    scope = spark.createDataFrame([("a", "S-0001"), ("c", "S-0001")], "id string, scene string")
    got = {r.id: r.faults for r in archive.archive_faults(bodies, scope, ["缺口"]).collect()}
    assert got == {"a": [], "b": ["no section 缺口", "no reference"], "c": ["outside the scope: S-0009"]}


def test_folder_import(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "片段10.txt").write_bytes("第一章\r\n文".encode("gb18030"))
    (tmp_path / "sub" / "片段2.md").write_text("文字", "utf-8")
    (tmp_path / "~$x.docx").write_bytes(b"x")
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "bad.docx").write_bytes(b"x")
    doc = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "good.docx").write_bytes(doc.getvalue())
    texts, left = readers.read_folder(spark, str(tmp_path))
    assert {r.relative: r.text for r in texts.collect()} == {"sub/片段10.txt": "第一章\n文", "sub/片段2.md": "文字", "good.docx": "## Head\nBody"}
    assert {r.relative: r.reason.split(":")[0] for r in left.collect()} == {"~$x.docx": "lock file", "a.pdf": "unsupported", "bad.docx": "BadZipFile"}
    assert [r.relative for r in manifest.scan(spark, str(tmp_path)).where("relative like 'sub/%'").orderBy("place").collect()] == ["sub/片段2.md", "sub/片段10.txt"]
    with pytest.raises(ValueError):
        manifest.check_folder(str(tmp_path / "sub"), str(tmp_path))


def test_scene_file_round_trip():
    meta, text = {"id": "S-0001", "chars": 3, "heading": "a: b"}, "---\nx\n---\ny"
    assert readers.parse_scene(readers.dump_scene(meta, text)) == (meta, text)


def test_paragraphs():
    assert export.paragraphs("甲。\n乙。\n\n丙。") == ["甲。", "乙。", "丙。"]
    wrapped = "这是一句很长很长的话它被按固定宽度\n折成了两行。\n又是一句很长很长的话它也被按宽度折\n成了两行。"
    assert len(export.paragraphs(wrapped)) == 2
    assert export.paragraphs("　　甲说\n话。\n　　乙说\n话。") == ["甲说话。", "乙说话。"]
    assert export.paragraphs("甲\n。乙") == ["甲。乙"] and export.paragraphs("") == []


def test_books_are_written(spark, tmp_path):
    items = spark.createDataFrame([(1, 0, 0, "卷", "章", "scene", "S-1", None), (2, 0, 0, "卷", "章", "hole", "H-001", "写\n它"), (3, 0, 1, "卷", "二", "scene", "S-9", None), (4, None, None, None, None, "scene", "S-2", None)], "place int, volume int, chapter int, volume_title string, chapter_title string, type string, item string, task string")
    scenes = spark.createDataFrame([("S-1", "旧文。", False), ("S-3", "正文 <b>。", False), ("S-2", "末。", False)], "id string, text string, removed boolean")
    nodes = export.nodes(items, scenes, spark.createDataFrame([("S-1", "S-3")], "scene string, main string"))
    assert [r.kind for r in nodes.orderBy("place").collect()] == ["volume", "chapter", "scene", "hole", "chapter", "missing", "volume", "scene"]
    assert export.counts(nodes).first().asDict() == {"scenes": 2, "holes": 1, "missing": 1, "chars": 9}
    export.write_epub(nodes, str(tmp_path / "b.epub"), "书")
    with zipfile.ZipFile(tmp_path / "b.epub") as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert "正文 &lt;b&gt;。" in z.read("p00001.xhtml").decode()
    export.write_docx(nodes, str(tmp_path / "b.docx"), "书")
    assert readers.docx_text((tmp_path / "b.docx").read_bytes()).split("\n")[1:4] == ["# 卷", "## 章", "正文 <b>。"]


def test_rows_of_votes_and_signs_stand_for_whole_lines(spark):
    """Lines and keys reach Python as lists, many at a time, not as a group each."""
    rows = spark.createDataFrame([(line, p, s, k) for line in "ab" for p, o in enumerate(("xyz", "yxz", "yzx")) for k, s in enumerate(o)], "line string, pass int, scene string, pos int")
    order = threads.consensus(rows)
    assert [(r.line, r.scene) for r in order.orderBy("line", "pos").collect()] == [(line, s) for line in "ab" for s in "yxz"]
    points = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("a", 2, 1), ("a", 3, 1), ("b", 1, None), ("b", 2, 1), ("c", 1, 1), (None, 1, 2), (None, 2, 3)], "line string, x int, y int")
    signs = threads.pair_signs(points, "line", "x", "y")
    assert {r[0]: tuple(r)[1:] for r in signs.collect()} == {"a": (0, 4, 0, 1, 1), "b": (0, 0, 0, 0, 0), None: (1, 0, 0, 0, 0)}
    for frame in (order, signs):
        assert "FlatMapGroups" not in frame._jdf.queryExecution().toString()


def test_only_shingles_that_may_be_common_leave_their_sets(spark):
    """Tasks tally the sets' numbers, and what no other text has is never a row."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": [1, 2, 3], "n": [2, 0, 2], "hs": pa.array([[5, 7], [], [7, 9]], pa.list_(pa.int64()))})
    told = pa.Table.from_batches(dedup._tallies(iter([batch, batch, batch.slice(1, 1)])))
    assert dict(zip(told["h"].to_pylist(), told["df"].to_pylist())) == {5: 2, 7: 4, 9: 2}
    assert not list(dedup._tallies(iter([batch.slice(1, 1)])))
    sieve = dedup.Sieve(spark.createDataFrame([(7,)], "key long"))
    out = pa.Table.from_batches(dedup._sifted(sieve)(iter([batch.slice(0, 2), batch.slice(2)])))
    assert list(zip(*(out[c].to_pylist() for c in ("k", "n", "h")))) == [(1, 2, 7), (3, 2, 7)]
