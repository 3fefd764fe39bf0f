"""Stitched windows, long lines by volumes, lines interleaved in frames: against loops over the same rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquire.operators import folds, interleaving, long_lines, stitching, threads


def stitched_by_hand(windows, answers, overlap):
    """windows: {book: [(first, last)]}, answers: {(book, window): [(kind, title, start)]}."""
    out = Counter()
    for book, spans in windows.items():
        edges = [0] + [a + overlap // 2 for a, _ in spans[1:]] + [spans[-1][1]]
        found = {"chapter": {}, "volume": {}}
        for w, (first, _) in enumerate(spans):
            for kind, title, start in answers.get((book, w), []):
                if edges[w] <= first + start < edges[w + 1]:
                    row = first + start
                    found[kind][row] = min(title, found[kind].get(row, title))
        chapters, taken = found["chapter"], set()
        out.update((book, "chapter", t, r) for r, t in chapters.items())
        for row, title in sorted(found["volume"].items()):
            at = min((c for c in chapters if c >= row), default=None)
            if at is not None and at not in taken:
                taken.add(at)
                out[(book, "volume", title, at)] += 1
    return out


@pytest.mark.parametrize("overlap", [2, 5, 10])
def test_stitched_windows(spark, overlap):
    rng, windows, answers = random.Random(overlap), {}, {}
    for book in range(6):
        windows[book] = list(folds.overlapping_windows([rng.randint(1, 40) for _ in range(rng.choice((1, 3, 90)))], 300, overlap))
        for w, (a, b) in enumerate(windows[book]):
            answers[(book, w)] = [(kind, f"{kind[0]}{w}.{k}", rng.randrange(b - a)) for kind in ("chapter", "volume") for k in range(rng.randint(0, 5))]
    frames = spark.createDataFrame([(b, w, a, z) for b, s in windows.items() for w, (a, z) in enumerate(s)], "book long, window long, first long, last long")
    said = spark.createDataFrame([(b, w, *x) for (b, w), xs in answers.items() for x in xs] + [(0, 99, "chapter", "lost", 0), (1, 0, "chapter", "null", None)], "book long, window long, kind string, title string, start long")
    assert Counter(map(tuple, stitching.stitched(frames, said, overlap).collect())) == stitched_by_hand(windows, answers, overlap)
    own = stitching.owned(frames, overlap).orderBy("book", "window").collect()
    for book, spans in windows.items():
        mine = [(r.low, r.high) for r in own if r.book == book]
        assert mine[0][0] == 0 and mine[-1][1] == spans[-1][1] and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))


def scenes_of(rng, line, n):
    rows, k = [], 0
    while len(rows) < n:
        source = f"s{rng.randrange(9)}-{k}"
        k += 1
        start = rng.randrange(50)
        rows += [(line, f"{line}/{source}/{i}", source, i) for i in range(start, start + rng.randint(1, 6))]
    return rows[:n]


def test_a_long_line_is_ordered_in_volumes(spark):
    rng = random.Random(1)
    scenes = scenes_of(rng, "long", 3000) + scenes_of(rng, "short", 40)
    frame = spark.createDataFrame(scenes, "line string, scene string, source string, index int")
    names = {"long": [f"v{k}" for k in range(20)], "short": ["only"]}
    volumes = spark.createDataFrame([(x, v, k) for x, vs in names.items() for k, v in enumerate(vs)], "line string, volume string, place int")
    put = [(x, s, rng.choice(names[x][: rng.randint(1, len(names[x]))])) for x, s, _, _ in scenes if rng.random() < 0.7] + [("long", scenes[0][1], "no such volume")]
    assigned = spark.createDataFrame(put, "line string, scene string, volume string")
    truth = {s: rng.random() for _, s, _, _ in scenes}
    told = {}

    def judge(members):
        rows = []
        for r in members.collect():
            told.setdefault((r.line, r.volume), []).append(r.scene)
        for (line, volume), mine in told.items():
            if volume == "v3":
                continue  # a judge that fails on one volume
            for p in range(3):
                order = sorted(mine, key=lambda s: truth[s] + (0.02 * rng.random() if p else 0))
                order = [s for s in order if not (p == 2 and hash(s) % 11 == 0)]
                rows += [(line, volume, p, s, k, float(k) if k % 4 else None) for k, s in enumerate(order)]
        told["rows"] = rows
        return spark.createDataFrame(rows, "line string, volume string, pass int, scene string, pos long, t double")

    ordered, lost = long_lines.order_long_lines(frame, volumes, assigned, judge)
    got, lost = ordered.collect(), {(r.line, r.scene) for r in lost.collect()}

    # runs by hand: neighbours of one source with indexes on end
    runs, wanted = {}, dict()
    for x in names:
        mine = sorted((r for r in scenes if r[0] == x), key=lambda r: ([int(p) if p.isdigit() else p for p in r[2].replace("s", "").split("-")], r[3]))
        run, last = 0, None
        for _, s, source, i in mine:
            run += last != (source, i - 1)
            last = (source, i)
            runs[s] = (x, run)
    votes = {}
    for x, s, v in put:
        if v in names[x]:
            votes.setdefault(runs[s], []).append(names[x].index(v))
    of = {r: min(set(v), key=lambda k: (-v.count(k), k)) for r, v in votes.items()}
    assert lost == {(x, s) for x, s, _, _ in scenes if runs[s] not in of}
    rows = told.pop("rows")
    for x in names:
        pos, shift = 0, 0.0
        for k, v in enumerate(names[x]):
            mine = [s for y, s, _, _ in scenes if y == x and of.get(runs[s]) == k]
            passes = [[r[3] for r in rows if r[:3] == (x, v, p)] for p in range(3)]
            if not mine:
                continue
            if any(passes):
                order = threads.consensus_order([p for p in passes if p])
                place = {s: i for i, s in enumerate(order)}

                def agree(p):
                    pairs = [(place[a] < place[b]) for i, a in enumerate(p) for b in p[i + 1 :]]
                    return round(sum(pairs) / len(pairs), 6) if pairs else 1.0

                best = max(range(3), key=lambda p: (agree(passes[p]), -p))
                times = {r[3]: r[5] for r in rows if r[:3] == (x, v, best)}
            else:
                order, times = sorted(mine, key=lambda s: (runs[s], int(s.split("/")[-1]))), {}
            for i, s in enumerate(order):
                wanted[(x, s)] = (v, pos + i, None if times.get(s) is None else times[s] + shift)
            pos += len(order)
            shift += max([t for t in times.values() if t is not None], default=0.0)
    assert {(r.line, r.scene): (r.volume, r.pos, r.t) for r in got} == wanted and len(got) == len(wanted)
    assert max(Counter((r.line, r.volume) for r in got).values()) < 1500  # no task has the whole line


def test_counts_of_volumes(spark):
    rows = spark.createDataFrame([("a",)] * 451 + [("b",)] * 3, "line string").withColumn("scene", F.monotonically_increasing_id())
    assert {r.line: (r.n, r.least, r.most) for r in long_lines.volume_counts(rows).collect()} == {"a": (4, 2, 8), "b": (1, 2, 2)}


@pytest.mark.parametrize("seed", range(4))
def test_interleaved_equals_the_list_version(spark, seed):
    rng = random.Random(seed)
    base = [(rng.choice("abcd"[: rng.randint(1, 4)]), f"s{k}", k + 1) for k in range(rng.choice((1, 61, 180)))]
    frame = spark.createDataFrame(base, "line string, scene string, place long")
    members = interleaving.windowed(frame, 25)
    spans = {}
    for r in members.orderBy("place").collect():
        spans.setdefault(r.window, []).append((r.line, r.scene))
    sizes = [len(v) for _, v in sorted(spans.items())]
    assert len(sizes) == -(-len(base) // 25) and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    judged, want = [], []
    for w, rows in sorted(spans.items()):
        order = [s for _, s in rows]
        rng.shuffle(order)
        order = [s for s in order if rng.random() < rng.choice((0.5, 0.9, 1.0))] + rng.choices(order, k=2) + ["who?"]
        rng.shuffle(order)
        judged += [(w, s, k) for k, s in enumerate(order)]
        lines = {}
        for x, s in rows:
            lines.setdefault(x, []).append(s)
        good = len(lines) > 1 and threads.mostly_placed(order, lines)
        want += threads.interleave(order, lines) if good else [s for _, s in rows]
    told = spark.createDataFrame(judged, "window long, scene string, rank long")
    got = interleaving.interleaved(members, told).orderBy("place").collect()
    assert [r.scene for r in got] == want and [r.place for r in got] == list(range(1, len(base) + 1))
    found = {r.window: r for r in interleaving.faults(members, told).collect()}
    hurt = {r.window: r.damage for r in interleaving.damage(interleaving.faults(members, told)).collect()}
    for w, rows in spans.items():
        lines = {}
        for x, s in rows:
            lines.setdefault(x, []).append(s)
        order = [s for v, s, _ in judged if v == w]
        f = threads.interleave_faults(order, lines)
        assert (found[w].repeated, found[w].unknown, found[w].broken, found[w].scenes - found[w].named) == tuple(len(f[k]) for k in ("repeated", "unknown", "broken", "missing"))
        assert hurt[w] == threads.interleave_score(order, lines)


def test_nothing_to_interleave(spark):
    none = spark.createDataFrame([], "line string, scene string, place long")
    told = spark.createDataFrame([], "window long, scene string, rank long")
    assert interleaving.interleaved(interleaving.windowed(none), told).collect() == []


def test_chapters_are_carried_over_spans(spark, monkeypatch):
    from sparkquire.operators import sequence

    monkeypatch.setattr(sequence, "SPAN", 7)
    items = spark.createDataFrame([(f"i{k}", k) for k in range(1, 60)], "item string, place long")
    starts = spark.createDataFrame([(3, 0, 0), (4, 1, 0), (40, 2, 1)], "start long, chapter int, volume int")
    got = {r.place: (r.chapter, r.volume) for r in sequence.assemble(items, starts).collect()}
    assert got == {k: (None, None) if k < 3 else (0, 0) if k < 4 else (1, 0) if k < 40 else (2, 1) for k in range(1, 60)}


@pytest.mark.parametrize("seed", range(4))
def test_pair_signs_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), rng.choice((None, *range(rng.choice((3, 40))))), rng.choice((None, *range(12)))) for _ in range(120)] + [("one", 1, 1), ("none", None, None), ("none", 1, None)]
    want = {}
    for k in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == k]
        if len(mine) < 2:
            continue
        n = dict.fromkeys(("same", "opposed", "tied_x", "tied_y", "tied_both"), 0)
        held = [r for r in mine if None not in r]
        for i, (a, b) in enumerate(held):
            for c, d in held[:i]:
                n["tied_both" if a == c and b == d else "tied_x" if a == c else "tied_y" if b == d else "same" if (a < c) == (b < d) else "opposed"] += 1
        want[k] = tuple(n.values())
    frame = spark.createDataFrame(rows, "line string, x int, y int")
    assert {r[0]: tuple(r)[1:] for r in threads.pair_signs(frame, "line", "x", "y").collect()} == want


def test_inversions():
    rng = random.Random(3)
    for n in (0, 1, 2, 50, 300):
        y = [rng.randrange(max(n // 3, 1)) for _ in range(n)]
        assert threads.inversions(np.array(y, float)) == sum(y[j] > y[i] for i in range(n) for j in range(i))


@pytest.mark.parametrize("few", [200_000, 0])
def test_items_found_whole(spark, monkeypatch, few):
    from sparkquire.operators import search

    monkeypatch.setattr(search, "BROADCAST_ITEMS", few)
    rng = random.Random(few)
    docs = [(k, "".join(rng.choices("ab c字", k=rng.randrange(60)))) for k in range(60)] + [(60, None), (61, ""), (3, "x")]
    items = [(k, t[a : a + rng.randint(0, 20)]) for k, (_, t) in enumerate(docs[:40]) if t for a in [rng.randrange(len(t))]] + [(100, "no such text at all"), (101, ""), (102, None), (103, "x")]
    want = {(d, i) for d, t in docs for i, w in items if t and w and w in t}
    got = search.verbatim(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "item long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_stretches_are_those_of_each_text_alone():
    """Stretches of a whole batch are hashed at once; none runs from one text into the next."""
    import pyarrow as pa

    from sparkquire.operators import search

    texts = ["", "short", "exactly8", "字 and 😀 both", "xexactly8x", "exactly8"]
    h, of = search._hashed(pa.array(texts))
    want = [(k, t[i : i + 8]) for k, t in enumerate(texts) for i in range(len(t) - 7)]
    assert of.tolist() == [k for k, _ in want] and len(set(h.tolist())) == len({w for _, w in want})
    assert len(set(zip(h.tolist(), (w for _, w in want)))) == len({w for _, w in want})
