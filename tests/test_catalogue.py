"""Catalogue parts, picks, hooks paired and merged, judgements carried on: against loops and hand-made cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkquire.operators import archive, catalogue, contradictions, numbering, timeline


def lines_of(rng, n):
    return [(f"s{k:04d}", k, "x" * rng.randint(0, 60)) for k in range(n)]


@pytest.mark.parametrize("span", [100_000, 7])
def test_parts_depend_on_what_stands_before_them(spark, monkeypatch, span):
    monkeypatch.setattr(numbering, "SPAN", span)
    rows = lines_of(random.Random(span), 200)
    long = catalogue.parts(spark.createDataFrame(rows, "scene string, pos long, line string"), ["pos"], "line", 300).collect()
    short = catalogue.parts(spark.createDataFrame(rows[:120], "scene string, pos long, line string"), ["pos"], "line", 300).collect()
    before, want = 0, {}
    for k, (scene, _, line) in enumerate(rows):
        want[scene] = (before // 300 + 1, k + 1)
        before += len(line) + 1
    assert {r.scene: (r.part, r.no) for r in long} == want
    assert {r.scene: (r.part, r.no) for r in short} == {s: want[s] for s, _, _ in rows[:120]}
    sizes = Counter()
    for r in long:
        sizes[r.part] += len(r.line) + 1
    assert max(sizes.values()) <= 300 + 60


def test_calls_go_ahead_once_a_part(spark):
    parted = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "part long, scene string")
    items = spark.createDataFrame([(f"r{k:02d}",) for k in range(7)], "ref string")
    rows, asked = catalogue.calls(parted, items, ["ref"], 3)
    assert [(r.ref, r.batch, r.slot) for r in rows.orderBy("ref").collect()] == [(f"r{k:02d}", k // 3 + 1, k % 3 + 1) for k in range(7)]
    assert sorted(map(tuple, asked.collect())) == [(p, b, int(b > 1)) for p in (1, 2) for b in (1, 2, 3)]
    assert catalogue.calls(parted, items.limit(0), ["ref"])[1].collect() == []


def test_picks_over_parts(spark):
    parted = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "e")], "part long, scene string")
    told = [(1, "r", "c", 1), (1, "r", "c", 2), (1, "r", "zz", 3), (1, "r", "d", 4), (1, "r", "a", 5), (1, "r", "b", 6), (2, "r", "e", 1), (2, "q", "d", 1), (1, "a", "a", 1), (1, "a", "b", 2), (1, "a", "c", 3)]
    answers = spark.createDataFrame(told, "part long, ref string, candidate string, no int")
    found = {(r.ref, r.picked): r.candidate for r in catalogue.picks(answers, parted, ["ref"]).collect()}
    assert found == {("r", 0): "c", ("r", 1): "a", ("r", 2): "e", ("q", 0): "d", ("a", 0): "a", ("a", 1): "b"}
    own = {(r.ref, r.picked): r.candidate for r in catalogue.picks(answers, parted, ["ref"], own="ref").collect()}
    assert own[("a", 0)] == "b" and ("a", 1) not in own


def test_picks_change_the_candidates(spark):
    order = spark.createDataFrame([(f"s{k}", k, "l") for k in range(9)], "scene string, pos long, line string")
    people = spark.createDataFrame([(f"s{k}", w) for k in range(1, 9) for w in ("p", "q")] + [("s0", "p"), ("s0", "q")], "scene string, who string")
    refs = spark.createDataFrame([("s0", "那件事")], "scene string, ref string")
    none, names = spark.createDataFrame([], "id string, bigram string"), spark.createDataFrame([], "name string, who string")
    chosen = spark.createDataFrame([("s0", "那件事", "s7", 0), ("s0", "那件事", "s5", 1)], "scene string, ref string, candidate string, picked int")
    rank = lambda df: [r.candidate for r in df.orderBy("r").collect()]
    assert rank(timeline.ref_candidates(refs, people, order, none, names)) == [f"s{k}" for k in range(1, 9)]
    assert rank(timeline.ref_candidates(refs, people, order, none, names, chosen)) == ["s7", "s5", "s1", "s2", "s3", "s4", "s6", "s8"]


def test_catalogue_lines(spark):
    rows = spark.createDataFrame([("S-1", " a\n b ", ["x ", "", None, "y"]), ("S-2", "é" * 200, []), ("S-3", None, None)], "scene string, summary string, resolved array<string>")
    got = [r[0] for r in rows.select(catalogue.catalogue_line(F.col("scene"), F.col("summary"), F.col("resolved"))).collect()]
    assert got == ["[S-1] a b（这场收了：x；y）", "[S-2] " + "é" * 100, "[S-3] "]


def test_hooks_are_paired_and_merged(spark):
    order = spark.createDataFrame([(f"s{k}", k) for k in range(6)], "scene string, pos long")
    hooks = spark.createDataFrame([("s1", 1, "who?"), ("s2", 2, "why?"), ("s3", 3, "Who then?"), ("s4", 4, "where?")], "scene string, pos long, hook string")
    parted = order.select("scene", (F.col("pos") / 3).cast("long").alias("part"))
    answers = [(1, "s1", "who?", "s5", 1), (0, "s1", "who?", "s1", 1), (0, "s2", "why?", "s0", 1), (1, "s4", "where?", "s4", 1), (1, "sx", "none", "s5", 1)]
    pairs = catalogue.paired_hooks(hooks, spark.createDataFrame(answers, "part long, scene string, hook string, candidate string, no int"), parted)
    assert {(r.scene, r.resolved_in) for r in pairs.collect()} == {("s1", "s5"), ("s2", "s0")}
    left = catalogue.open_items(hooks, pairs, order)
    assert {r.scene for r in left.collect()} == {"s2", "s3", "s4"}  # what comes before doesn't resolve
    bunched = catalogue.bunches(left, ["pos"], 10_000)
    told = [(1, 7, "s3", "Who then?"), (1, 7, "s4", "where?"), (1, 9, "s4", "where?"), (1, 9, "s2", "why?"), (2, 7, "s2", "why?"), (1, 7, "s9", "?")]
    same = catalogue.same_hooks(spark.createDataFrame(told, "part long, set int, scene string, hook string"), bunched)
    assert {(r.scene, r.group) for r in same.collect()} == {("s3", 1), ("s4", 1)}
    planted = hooks.withColumns({"line": F.lit("l"), "no": F.lit(0)})
    found = archive.open_hooks(planted, hooks.select("hook").limit(0), archive.closed_hooks(pairs, order), same).collect()
    assert {(r.scene, tuple(r.scenes), r.hooks) for r in found} == {("s2", ("s2",), 1), ("s3", ("s3", "s4"), 2)}
    assert catalogue.bunches(left.limit(1), ["pos"], 10).collect() == []


def test_pairs_go_stale_with_what_they_were_judged_on(spark):
    rows = [(k, f"line {k}") for k in range(30)]
    frame = lambda r: spark.createDataFrame(r, "no long, line string")
    sig = catalogue.list_signature(frame(rows), "no", ["line"], "prompt")
    assert sig == catalogue.list_signature(frame(rows[::-1]).repartition(5), "no", ["line"], "prompt")
    swapped = [(0, "line 1"), (1, "line 0"), *rows[2:]]
    others = {catalogue.list_signature(frame(r), "no", ["line"], p) for r, p in ((rows[:-1], "prompt"), (swapped, "prompt"), (rows, "other"))}
    assert sig not in others and len(others) == 3 and len(sig) == 16
    kept = frame(rows)
    assert catalogue.still_valid(kept, sig, sig) is kept
    assert catalogue.still_valid(kept, sig, "x") is None and catalogue.still_valid(kept, None, sig) is None and catalogue.still_valid(kept, sig, sig, failed=True) is None


def test_judgements_of_failed_batches_are_carried(spark):
    groups = spark.createDataFrame([("a", "x", "1", 1), ("b", "x", "1", 1), ("c", "x", "1", 2), ("d", "x", "1", 2), ("e", "x", "1", 2), ("f", "x", "1", 3)], "subject string, attribute string, sig string, batch int")
    judged = spark.createDataFrame([("a", "x", "真矛盾", "now"), ("c", "x", "可解释", "part of a failed batch"), ("f", "x", "no such status", "?")], "subject string, attribute string, status string, reason string")
    failed = spark.createDataFrame([(2,), (2,)], "batch int")
    earlier = [(1, "b", "1", "真矛盾"), (1, "d", "1", "可解释"), (2, "d", "1", "有意为之"), (3, "d", "2", "真矛盾"), (2, "e", "0", "真矛盾"), (4, "d", "1", "broken")]
    earlier = spark.createDataFrame([(r, s, "x", g, t, f"run {r}") for r, s, g, t in earlier], "run int, subject string, attribute string, sig string, status string, reason string")
    got = {r.subject: (r.status, r.reason, r.from_run, r.failed) for r in contradictions.carry_judgements(groups, judged, failed, earlier).collect()}
    unknown = contradictions.UNKNOWN
    assert got == {
        "a": ("真矛盾", "now", None, False), "b": (unknown, "", None, False), "c": ("可解释", "part of a failed batch", None, False),
        "d": ("有意为之", "run 2", 2, True), "e": (unknown, "", None, True), "f": (unknown, "", None, False),
    }


def test_candidates_with_a_hero_in_every_scene(spark):
    """Against all pairs: two persons in common, whatever one of them is in."""
    rng = random.Random(6)
    cast = {f"s{k}": {"hero"} | {rng.choice("abcdefghij") for _ in range(rng.randint(0, 3))} for k in range(40)}
    people = spark.createDataFrame([(s, w) for s, ws in cast.items() for w in ws], "scene string, who string")
    order = spark.createDataFrame([(f"s{k}", k, "xy"[k % 2]) for k in range(40)], "scene string, pos long, line string")
    refs = spark.createDataFrame([(f"s{k}", "A去了" if k % 3 == 0 else "那件事") for k in range(0, 40, 2)], "scene string, ref string")
    none, names = spark.createDataFrame([], "id string, bigram string"), spark.createDataFrame([("A", "a")], "name string, who string")
    want = {}
    for k in range(0, 40, 2):
        rows = []
        for j in range(40):
            shared, named = len(cast[f"s{k}"] & cast[f"s{j}"]), k % 3 == 0 and "a" in cast[f"s{j}"]
            if j != k and (named or shared >= 2):
                rows.append((-named, -shared, (k - j) % 2, abs(k - j), j))
        for r, row in enumerate(sorted(rows)[:8], 1):
            want[(f"s{k}", r)] = f"s{row[-1]}"
    got = timeline.ref_candidates(refs, people, order, none, names).collect()
    assert {(r.scene, r.r): r.candidate for r in got} == want
