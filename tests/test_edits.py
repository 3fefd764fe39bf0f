"""Edits of lines, rendering, collections, planted truth."""

import random

import pytest
from pyspark.sql import functions as F

from sparkquire.operators import dedup, edits, evaluation, fixtures, rendering
from sparkquire.params import Params
from sparkquire.sources import collection, readers


@pytest.fixture
def book(spark):
    df = spark.createDataFrame
    members = [("L-1", 0, "a", 1.0), ("L-1", 1, "b", 2.0), ("L-1", 2, "c", 3.0), ("L-2", 0, "x", 0.0), ("L-2", 1, "y", 1.0), ("L-3", 0, "z", None)]
    return edits.Book(
        threads=df([("L-1", "W", "one", "", "draft", 0.0), ("L-2", "W", "two", "", "draft", 5.0), ("L-3", "V", "three", "", "draft", None)], "id string, world string, name string, about string, status string, offset double"),
        members=df([(t, p, s, False, x, "高") for t, p, s, x in members] + [("L-2", 0, "o", True, None, None)], "thread string, pos long, scene string, outline boolean, t double, conf string"),
        crossings=df([("L-2", "x", "b"), ("L-3", "z", "c")], "thread string, scene string, main_scene string"),
        gaps=df([("Q-1", "L-2", "x", "y"), ("Q-2", None, None, None)], "gap string, thread string, after string, before string"),
        pending=df([("p", "L-2", "r"), ("q", "L-3", "r")], "scene string, thread string, reason string"),
        unassigned=df([("u", "no card")], "scene string, reason string"),
        world_outlines=df([], "world string, scene string"),
        main="L-1",
    )


def scenes(b, thread):
    return [r.scene for r in b.members.where((F.col("thread") == thread) & ~F.col("outline")).orderBy("pos").collect()]


def test_moving_scenes(book):
    b = edits.move_scenes(book, ["x", "u"], "L-1", 1)
    assert scenes(b, "L-1") == ["a", "x", "u", "b", "c"] and scenes(b, "L-2") == ["y"]
    assert {r.scene: r.t for r in b.members.collect()}["x"] is None
    assert b.unassigned.count() == 0 and b.crossings.where("thread = 'L-2'").count() == 0
    assert [(r.gap, r.thread, r.after, r.before) for r in b.gaps.orderBy("gap").collect()] == [("Q-1", "L-2", None, "y"), ("Q-2", None, None, None)]
    assert {r.id: r.status for r in b.threads.collect()}["L-1"] == "confirmed"
    assert scenes(edits.move_scenes(book, ["a"], "L-1", 2), "L-1") == ["b", "c", "a"]
    with pytest.raises(KeyError):
        edits.move_scenes(book, ["a"], "L-9")


def test_emptied_lines_go(book):
    b = edits.move_scenes(book, ["x", "y"], "L-1")
    assert scenes(b, "L-1") == ["a", "b", "c", "x", "y"] and "L-2" not in {r.id for r in b.threads.collect()}
    assert [(r.world, r.scene) for r in b.world_outlines.collect()] == [("W", "o")]
    assert {r.scene for r in b.unassigned.collect()} == {"u", "p"} and {r.scene for r in b.pending.collect()} == {"q"}
    b = edits.move_scenes(book, ["a", "b", "c"], "L-2")
    assert b.main == "L-2" and [tuple(r) for r in b.crossings.collect()] == [("L-3", "z", "c")]


def test_merging_and_splitting(book):
    b = edits.merge_threads(book, ["L-2", "L-1"])
    assert b.main == "L-1" and scenes(b, "L-1") == ["a", "b", "c", "x", "y"]
    assert {r.scene: r.t for r in b.members.collect()}["y"] == 6.0
    with pytest.raises(ValueError):
        edits.merge_threads(book, ["L-1", "L-3"])
    b = edits.split_thread(book, "L-1", "b", "L-4")
    assert scenes(b, "L-1") == ["a"] and scenes(b, "L-4") == ["b", "c"]
    with pytest.raises(ValueError):
        edits.split_thread(book, "L-1", "a", "L-4")


def test_main_pending_names_worlds(book):
    b = edits.set_main(book, "L-2")
    assert {r.id: r.offset for r in b.threads.collect()} == {"L-1": -5.0, "L-2": 0.0, "L-3": None}
    assert {r.scene for r in edits.reject_pending(book, ["p"]).unassigned.collect()} == {"u", "p"}
    assert {r.id: r.name for r in edits.rename(book, "L-3", " new ").threads.collect()}["L-3"] == "new"
    assert {r.id: r.world for r in edits.move_thread(book, "L-1", "V").threads.collect()}["L-1"] == "V"
    assert edits.confirm(book, ["L-1", "L-2"]).threads.where("status = 'confirmed'").count() == 2


def test_chapters_move(spark):
    rows = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c")], "volume long, no long, title string")
    got = {r.title: (r.volume, r.no) for r in edits.move_chapter(rows, 0, 0, 0, 2).collect()}
    assert got == {"b": (0, 0), "a": (0, 1), "c": (1, 0)}
    assert {r.title: (r.volume, r.no) for r in edits.move_chapter(rows, 1, 0, 0, 0).collect()} == {"c": (0, 0), "a": (0, 1), "b": (0, 2)}


def test_rendering(spark):
    assert rendering.find_snippets("一" * 100 + "林清" + "二" * 100 + "林清儿", ["林清", "林清儿", ""], 5) == ["一" * 5 + "林清" + "二" * 5, "二" * 5 + "林清儿"]
    assert rendering.find_snippets("开头\n文", ["无"]) == ["开头 文"]
    assert "要找的事" in rendering.focused("甲。" * 3000 + "要找的事在此。" + "乙。" * 3000, ["要找的事"], 100)
    groups = spark.createDataFrame([("C-001", "甲", "年龄")], "id string, subject string, attribute string")
    values = spark.createDataFrame([("C-001", "十六", "S-2", "q2"), ("C-001", "十六", "S-1", "q1")], "id string, value string, scene string, quote string")
    times = spark.createDataFrame([("S-1", "L-1", 3.0, "高")], "scene string, thread string, t double, conf string")
    assert rendering.group_texts(groups, values, times, "年").first().text == "C-001 主语：甲　属性：年龄\n  值「十六」出现在：\n    [S-1] L-1 故事时间约 3年（把握高）：q1\n    [S-2] 故事时间未知：q2"
    rows = spark.createDataFrame([("k", i, 10) for i in range(10)], "k string, i int, c int")
    assert [r.i for r in rendering.sampled_rows(rows, ["k"], "i", "c", 35).orderBy("i").collect()] == [0, 3, 6, 9]
    lines = spark.createDataFrame([("L-1", 1, "b"), ("L-1", 0, "a")], "thread string, pos int, line string")
    none = spark.createDataFrame([], "thread string, gap string, event string, no int, hook string")
    text = rendering.thread_inputs(spark.createDataFrame([("L-1", "n", "about")], "thread string, name string, about string"), lines, none, none).first().text
    assert text == "# L-1 n\nabout\n\n## 场景\na\nb\n\n## 缺口\n（没有）\n\n## 开放的伏笔\n（没有）"


def test_collections(spark, tmp_path):
    made = collection.create(spark, str(tmp_path), "书：一/二")
    collection.create(spark, str(tmp_path), "书10")
    collection.create(spark, str(tmp_path), "书2")
    assert [c.root.rsplit("/", 1)[1] for c in collection.catalog(str(tmp_path))] == ["书2", "书10", "书：一_二"]
    with pytest.raises(ValueError):
        collection.open_collection(str(tmp_path), "../x")
    with pytest.raises(FileExistsError):
        collection.create(spark, str(tmp_path), "书2")
    (tmp_path / "书2" / "t").mkdir()
    (tmp_path / "书2" / "t" / "a.json").write_text('{"k": 1}\n{broken\n')
    book = collection.open_collection(str(tmp_path), "书2")
    assert [r.k for r in book.read(spark, "t", "k int").collect()] == [1]
    with pytest.raises(collection.Damaged):
        book.read(spark, "t", "k int", owned=True)
    assert made.read(spark, "none", "k int").count() == 0
    assert collection.render("pre\n## system\nS $a\n## user\nU", a="1") == ("S 1", "U")
    with pytest.raises(KeyError):
        collection.render("## system\n$a\n## user\n")
    raw = spark.createDataFrame([("L-1", None, None, None, ["a", "a"], {"a": ("3", "高"), "b": ("x", "?"), "c": ("nan", "中")}, "inf")], "id string, world string, name string, status string, scenes array<string>, times map<string,struct<t:string,conf:string>>, offset string")
    got = collection.normalise_threads(raw).first()
    assert got.scenes == ["a"] and got.offset is None and got.times["a"].t == 3.0 and "c" not in got.times


def test_planted_copies_are_found(spark):
    rng = random.Random(3)
    han = lambda n: "".join("。" if i % 20 == 19 else chr(rng.randrange(0x4E00, 0x9F00)) for i in range(n))
    body = "".join(f"第{n}回 题\n{han(900)}\n\n{han(900)}\n" for n in "一二三四五六七八")
    book = fixtures.chapters(body)
    files, key = fixtures.scramble(book, 5, ages=[("甲", "")], dead=["乙"])
    assert len(book) == 8 and len(key.deleted) == 1 and len(key.variants) == 3 and key.contradictions and key.deaths
    assert fixtures.scramble(book, 5, ages=[("甲", "")], dead=["乙"])[0] == files
    docs, planted = fixtures.as_frames(spark, files, key)
    pairs = dedup.near_duplicate_pairs(docs, Params(dedup_min_shingles=50))
    recall = {r.kind: r.recall for r in evaluation.dedup_recall(dedup.version_groups(pairs), planted).collect()}
    assert recall[None] == 1.0
    assert readers.detect_encoding(b"\xff\xfea\x00") == "utf-16"
