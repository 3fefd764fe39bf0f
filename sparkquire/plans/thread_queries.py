"""Queries of story lines over ``events`` (a line a user) and ``conversations`` (a line each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import axis, folds, sequence, threads, timeline, triage
from .registry import query, table

# Lines of the events: thread = user, scene = event, pos by time; a signup or refund has no time, users
# divisible by 7 no offset, others one of 0 to 4; every fifth user's line is cut, every third merged.
_LINES = """e AS (SELECT user_id AS thread, event_id AS scene, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
 CASE WHEN event_id % 9 = 0 THEN NULL ELSE floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600.0 END AS t,
 CASE WHEN user_id % 7 = 0 THEN NULL ELSE (user_id % 5)::DOUBLE END AS off,
 CASE WHEN user_id % 5 = 0 THEN 'cut' WHEN user_id % 3 = 0 THEN 'merge' ELSE 'undecided' END AS col FROM events)"""


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    hours = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 3600.0
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("thread"), F.col("event_id").alias("scene"), "event_type", pos.cast("long").alias("pos"), F.when(F.col("event_id") % 9 != 0, hours).alias("t"))


def _threads(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select(F.col("user_id").alias("thread")).distinct()
    return users.select("thread", F.when(F.col("thread") % 7 != 0, (F.col("thread") % 5).cast("double")).alias("offset"), F.col("thread").alias("no"))


def _board(spark: SparkSession, d: str) -> DataFrame:
    col = F.when(F.col("thread") % 5 == 0, "cut").when(F.col("thread") % 3 == 0, "merge").otherwise("undecided")
    return _threads(spark, d).select("thread", col.alias("col"), F.when(col == "merge", F.col("thread") + 1).alias("merge_into"), F.lit("").alias("note"))


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sequence.build_sequence(_scenes(spark, d), _threads(spark, d), _board(spark, d), "1")


_PLACED = f"""{_LINES}, pl AS (SELECT scene, thread, row_number() OVER (ORDER BY off + t, thread <> 1, thread, pos) AS place FROM e WHERE col <> 'cut' AND off IS NOT NULL AND t IS NOT NULL)"""


@query("""WITH k AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role <> 'system' AND (conv_id + turn) % 4 <> 0)
SELECT conv_id, turn, sum(CASE WHEN p + 1 = turn THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS segment FROM k""")
def q_segments_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role <> 'system' and (conv_id + turn) % 4 <> 0").select("conv_id", "turn", F.lit("one").alias("source"))
    return threads.segments(rows, ["conv_id"], "source", "turn").select("conv_id", "turn", "segment")


_PASSES = """p AS (SELECT user_id AS line, 1 AS pass, event_id AS scene, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events
UNION ALL SELECT user_id, 2, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) FROM events
UNION ALL SELECT user_id, 3, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) FROM events)"""


def _passes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    w = W.partitionBy("user_id")
    every = [e.select(F.col("user_id").alias("line"), F.lit(k).alias("pass"), F.col("event_id").alias("scene"), F.row_number().over(w.orderBy(*order)).alias("pos")) for k, order in ((1, ("ts", "event_id")), (2, ("value", "event_id")), (3, ("event_id",)))]
    return every[0].union(every[1]).union(every[2])


@query(f"WITH {_PASSES} SELECT line, count(*)::BIGINT AS pairs, sum(CASE WHEN 2 * f > v THEN 1 ELSE 0 END)::BIGINT AS agreed, sum(f)::BIGINT AS forward FROM (SELECT a.line, a.scene, b.scene, count(*) AS v, sum(CASE WHEN a.pos < b.pos THEN 1 ELSE 0 END) AS f FROM p a JOIN p b ON a.line = b.line AND a.pass = b.pass AND a.scene < b.scene GROUP BY 1, 2, 3) GROUP BY 1")
def q_consensus_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = threads.majority(_passes(spark, d))
    return m.groupBy("line").agg(F.count("*").alias("pairs"), F.count_if(F.col("first") * 2 > F.col("votes")).alias("agreed"), F.sum("first").alias("forward"))


@query()
def q_consensus_order(spark: SparkSession, d: str) -> DataFrame:
    return threads.consensus(_passes(spark, d))


_SIGNS = """s AS (SELECT a.conv_id, sign(b.turn - a.turn) AS dx, sign(length(b.text) - length(a.text)) AS dy FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn)"""


@query(f"""WITH {_SIGNS}, c AS (SELECT conv_id, count(*) FILTER (dx * dy > 0) AS same, count(*) FILTER (dx * dy < 0) AS opp, count(*) FILTER (dy = 0 AND dx <> 0) AS ty, count(*) AS n FROM s GROUP BY 1)
SELECT conv_id, n::BIGINT AS pairs, CASE WHEN same + opp > 0 THEN round((same - opp) / sqrt((same + opp)::DOUBLE * (same + opp + ty)), 6) END AS tau FROM c""")
def q_kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return threads.kendall_tau_b(rows, "conv_id", "turn", "n").select("conv_id", "pairs", "tau")


@query("""WITH o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS p FROM conversations), s AS (SELECT a.conv_id, count(*) AS n, count(*) FILTER (a.p < b.p) AS same FROM o a JOIN o b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY 1)
SELECT DISTINCT o.conv_id, coalesce(round(same / n, 6), 1.0)::DOUBLE AS agreement FROM o LEFT JOIN s USING (conv_id)""")
def q_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("line"), F.col("turn").alias("scene"), F.length("text").alias("n"))
    by_length = rows.select("line", "scene", F.row_number().over(W.partitionBy("line").orderBy("n", "scene")).alias("pos"))
    return threads.agreement(rows.select("line", "scene", F.col("scene").alias("pos")), by_length).select(F.col("line").alias("conv_id"), "agreement")


@query(f"WITH {_PLACED} SELECT scene, thread, place::BIGINT AS place FROM pl")
def q_global_sequence(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d)[0].select("scene", "thread", F.col("place").cast("long").alias("place"))


@query(f"WITH {_LINES} SELECT scene, thread, CASE WHEN off IS NULL THEN 'unaligned_thread' ELSE 'no_time' END AS why FROM e WHERE col <> 'cut' AND (off IS NULL OR t IS NULL)")
def q_unplaced(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d)[1]


_GAPS = "g AS (SELECT event_id AS gap, user_id AS thread, CASE WHEN event_id % 2 = 0 THEN event_id END AS aft, CASE WHEN event_id % 3 = 0 THEN event_id + 1 END AS bef FROM events WHERE event_type = 'error')"


@query(f"""WITH {_PLACED}, {_GAPS}, h AS (SELECT gap, g.thread, coalesce(a.place, b.place) AS p, CASE WHEN a.place IS NOT NULL THEN 2 ELSE 0 END AS side FROM g LEFT JOIN pl a ON a.scene = aft LEFT JOIN pl b ON b.scene = bef WHERE g.thread % 5 <> 0),
m AS (SELECT *, row_number() OVER (ORDER BY p NULLS LAST, CASE WHEN p IS NULL THEN 0 ELSE side END, gap)::VARCHAR AS no FROM h),
i AS (SELECT 'scene' AS type, scene::VARCHAR AS item, thread, place AS p, 1 AS side, 0 AS o FROM pl UNION ALL SELECT 'hole', 'H-' || lpad(no, greatest(3, length(no))::INTEGER, '0'), thread, p, side, gap FROM m WHERE p IS NOT NULL)
SELECT type, item, thread, row_number() OVER (ORDER BY p, side, o)::BIGINT AS place FROM i""")
def q_insert_holes(spark: SparkSession, d: str) -> DataFrame:
    items, _ = sequence.insert_holes(*_holes(spark, d))
    return items.select("type", "item", "thread", F.col("place").cast("long").alias("place"))


def _holes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    placed = _placed(spark, d)[0].select(F.col("scene").cast("string").alias("scene"), "thread", "place")
    e = table(spark, d, "events").where("event_type = 'error'")
    gaps = e.select(F.col("event_id").cast("string").alias("gap"), F.col("user_id").alias("thread"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).cast("string").alias("after"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") + 1).cast("string").alias("before"))
    return placed, gaps, _board(spark, d)


@query(f"""WITH {_PLACED}, {_GAPS} SELECT count(*)::BIGINT AS holes FROM g LEFT JOIN pl a ON a.scene = aft LEFT JOIN pl b ON b.scene = bef WHERE g.thread % 5 <> 0 AND a.place IS NULL AND b.place IS NULL""")
def q_holes_unplaced(spark: SparkSession, d: str) -> DataFrame:
    return sequence.insert_holes(*_holes(spark, d))[1].agg(F.count("*").alias("holes"))


@query(f"""WITH {_PLACED}, x AS (SELECT user_id AS thread, event_id + 1 AS scene FROM events WHERE user_id % 5 = 0 AND event_type = 'error'),
n AS (SELECT (place - 1) // 50 AS chapter, 'note' || thread AS k, CASE WHEN thread % 3 = 0 THEN 'merge' ELSE 'undecided' END AS kind, thread, CASE WHEN thread % 3 = 0 THEN thread + 1 END AS other FROM pl UNION SELECT (place - 1) // 50, 'x', 'cut_crossing', x.thread, pl.scene FROM pl JOIN x ON x.scene = pl.scene)
SELECT chapter::BIGINT AS chapter, kind, thread, other FROM n""")
def q_chapter_notes(spark: SparkSession, d: str) -> DataFrame:
    items = _placed(spark, d)[0].select(F.floor((F.col("place") - 1) / 50).alias("chapter"), "place", F.col("scene").alias("item"), F.lit("scene").alias("type"), "thread")
    crossings = table(spark, d, "events").where("user_id % 5 = 0 and event_type = 'error'").select(F.col("user_id").alias("thread"), (F.col("event_id") + 1).alias("main_scene"))
    return sequence.chapter_notes(items, _board(spark, d), crossings).select("chapter", "kind", "thread", "other")


@query("""WITH r AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events), k AS (SELECT *, ceil(n / 20.0)::BIGINT AS k FROM r), s AS (SELECT *, n // k AS size, n % k AS extra FROM k)
SELECT user_id, event_id, (1 + CASE WHEN p < extra * (size + 1) THEN p // (size + 1) ELSE extra + (p - extra * (size + 1)) // size END)::BIGINT AS "window" FROM s""")
def q_equal_windows(spark: SparkSession, d: str) -> DataFrame:
    return threads.equal_windows(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 20)


@query("""WITH RECURSIVE r AS (SELECT source, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY source) AS n, sum(n_chars + 1) OVER w AS upto, n_chars + 1 AS size FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
e AS (SELECT a.source, a.k AS s, a.n, least(a.n, greatest(max(CASE WHEN b.upto - a.upto + a.size <= 30000 THEN b.k + 1 ELSE a.k + 1 END), a.k + 11)) AS e FROM r a JOIN r b ON a.source = b.source AND b.k >= a.k GROUP BY a.source, a.k, a.n),
w AS (SELECT source, 0 AS "window", s, e, n FROM e WHERE s = 0 UNION ALL SELECT w.source, "window" + 1, e.s, e.e, w.n FROM w JOIN e ON e.source = w.source AND e.s = w.e - 10 WHERE w.e < w.n)
SELECT source, "window"::BIGINT AS "window", s::BIGINT AS first, e::BIGINT AS last FROM w""")
def q_overlap_windows(spark: SparkSession, d: str) -> DataFrame:
    return folds.window_rows(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 30_000)


_FOLD = "r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)"


@query(f"""WITH RECURSIVE {_FOLD}, f AS (SELECT source, doc_id, k, n_chars AS total, 0 AS chapter FROM r WHERE k = 1 UNION ALL
SELECT r.source, r.doc_id, r.k, CASE WHEN f.total >= 10000 THEN r.n_chars ELSE f.total + r.n_chars END, CASE WHEN f.total >= 10000 THEN f.chapter + 1 ELSE f.chapter END FROM f JOIN r ON r.source = f.source AND r.k = f.k + 1)
SELECT source, doc_id, chapter::BIGINT AS chapter, (chapter // 10)::BIGINT AS volume FROM f""")
def q_chapter_fallback(spark: SparkSession, d: str) -> DataFrame:
    return folds.chapter_starts(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars")


@query(f"""WITH RECURSIVE {_FOLD}, f AS (SELECT source, doc_id, k, n_chars AS total, 1 AS n, 0 AS batch FROM r WHERE k = 1 UNION ALL
SELECT r.source, r.doc_id, r.k, CASE WHEN f.total + r.n_chars > 12000 OR f.n >= 5 THEN r.n_chars ELSE f.total + r.n_chars END, CASE WHEN f.total + r.n_chars > 12000 OR f.n >= 5 THEN 1 ELSE f.n + 1 END, CASE WHEN f.total + r.n_chars > 12000 OR f.n >= 5 THEN f.batch + 1 ELSE f.batch END FROM f JOIN r ON r.source = f.source AND r.k = f.k + 1)
SELECT source, doc_id, batch::BIGINT AS batch FROM f""")
def q_budget_batches(spark: SparkSession, d: str) -> DataFrame:
    return folds.budget_batches(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 12_000, 5)


@query("""WITH RECURSIVE r AS (SELECT event_type, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
f AS (SELECT event_type, event_id, user_id, k, 1 AS n, 0 AS batch FROM r WHERE k = 1 UNION ALL
SELECT r.event_type, r.event_id, r.user_id, r.k, CASE WHEN f.n >= 20 AND r.user_id <> f.user_id THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 20 AND r.user_id <> f.user_id THEN f.batch + 1 ELSE f.batch END FROM f JOIN r ON r.event_type = f.event_type AND r.k = f.k + 1)
SELECT event_type, event_id, batch::BIGINT AS batch FROM f""")
def q_group_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", "event_id", "user_id")
    return folds.group_batches(rows, "event_type", "event_id", "user_id", 20)


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("line"), F.col("event_id").cast("double").alias("x"), F.round("value", 2).alias("y"))


@query()
def q_lnds(spark: SparkSession, d: str) -> DataFrame:
    return threads.chains(_anchors(spark, d))


@query("""WITH a AS (SELECT user_id AS line, min(event_id)::DOUBLE AS x0, max(event_id)::DOUBLE AS x1 FROM events GROUP BY 1 HAVING count(*) > 1), m AS (SELECT event_id, user_id AS line, event_id::DOUBLE AS t FROM events)
SELECT event_id, CASE WHEN x0 IS NULL THEN t ELSE round(CASE WHEN t <= x0 THEN 10 + t - x0 WHEN t >= x1 THEN 1000 + t - x1 ELSE 10 + 990 * (t - x0) / (x1 - x0) END - (10 - x0), 4) END AS t FROM m LEFT JOIN a USING (line)""")
def q_time_anchor_map(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ends = e.groupBy(F.col("user_id").alias("line")).agg(F.min("event_id").cast("double").alias("x0"), F.max("event_id").cast("double").alias("x1"), F.count("*").alias("n")).where("n > 1")
    chain = ends.select("line", F.inline(F.array(F.struct(F.lit(0).cast("long").alias("k"), F.col("x0").alias("x"), F.lit(10.0).alias("y")), F.struct(F.lit(1).cast("long").alias("k"), F.col("x1").alias("x"), F.lit(1000.0).alias("y")))))
    times = e.select(F.col("user_id").alias("line"), F.col("event_id").alias("scene"), F.col("event_id").cast("double").alias("t"))
    offsets = e.select(F.col("user_id").alias("line")).distinct().withColumn("offset", F.lit(None).cast("double"))
    return threads.anchor_times(times, offsets, chain)[0].select(F.col("scene").alias("event_id"), "t")


# Deaths: an error event says that its user died, unless its number is divisible by 4 (nearly died) or 6 (killer).
_DEATHS = f"""{_LINES}, o AS (SELECT scene, thread, row_number() OVER (ORDER BY scene) - 1 AS p FROM e), d AS (SELECT thread AS who, min(p) AS died FROM o JOIN events ON event_id = scene WHERE event_type = 'error' AND scene % 4 <> 0 AND scene % 6 <> 0 GROUP BY 1),
l AS (SELECT who, scene AS later, p, row_number() OVER (PARTITION BY who ORDER BY p) - 1 AS r, count(*) OVER (PARTITION BY who) AS m FROM d JOIN o ON o.thread = d.who AND p > died)"""


def _deaths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, d, "events").select(F.col("event_id").alias("scene"), F.col("user_id").cast("string").alias("who"), "event_type")
    order = e.select("scene", F.col("scene").alias("pos"))
    value = F.when(F.col("scene") % 4 == 0, "险些死去").when(F.col("scene") % 6 == 0, F.concat(F.lit("有人死于"), "who", F.lit("之手"))).otherwise("战死")
    facts = e.where("event_type = 'error'").select("scene", "who", F.lit("生死").alias("attribute"), value.alias("value"), F.lit("").alias("quote"), F.lit(0).alias("no"))
    names = e.select(F.col("who").alias("name"), "who").distinct()
    return timeline.first_deaths(facts, order, names), e.select("scene", "who"), order


@query(f"WITH {_DEATHS} SELECT who, later FROM l WHERE m <= 5 OR r < 2 OR (r - 2) IN (floor(0.5 * (m - 2) / 3.0)::BIGINT, floor(1.5 * (m - 2) / 3.0)::BIGINT, floor(2.5 * (m - 2) / 3.0)::BIGINT)")
def q_death_suspects(spark: SparkSession, d: str) -> DataFrame:
    found, _ = timeline.death_suspects(*_deaths(spark, d))
    return found.select(F.col("who").cast("long").alias("who"), "later")


@query(f"WITH {_DEATHS} SELECT who, (max(m) - 5)::BIGINT AS capped FROM l GROUP BY 1 HAVING max(m) > 5")
def q_later_sample(spark: SparkSession, d: str) -> DataFrame:
    return timeline.death_suspects(*_deaths(spark, d))[1].select(F.col("who").cast("long").alias("who"), F.col("capped").cast("long").alias("capped"))


_BIGRAMS = """b AS (SELECT DISTINCT conv_id, turn, substr(w, i, 2) AS bigram FROM (SELECT conv_id, turn, w, unnest(generate_series(1, length(w) - 1)) AS i FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[a-z]{2,}')) AS w FROM conversations)))"""


@query(f"WITH {_BIGRAMS}, f AS (SELECT bigram FROM b GROUP BY 1 HAVING count(*) > 0.3 * (SELECT count(*) FROM conversations)) SELECT conv_id, turn, count(*)::BIGINT AS rare FROM b WHERE bigram NOT IN (SELECT bigram FROM f) GROUP BY 1, 2")
def q_bigram_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    rare = timeline.rare_bigrams(timeline.bigrams(c, "text", "a-z"), c.count())
    return rare.groupBy("id").agg(F.count("*").alias("rare")).select("id.conv_id", "id.turn", "rare")


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS scene, l_suppkey AS who FROM lineitem), o AS (SELECT o_orderkey AS scene, o_orderkey AS pos FROM orders), r AS (SELECT o_orderkey AS scene FROM orders WHERE o_orderkey % 50 = 0),
c AS (SELECT r.scene, b.scene AS candidate, count(*) AS shared FROM r JOIN p a ON a.scene = r.scene JOIN p b ON b.who = a.who AND b.scene <> a.scene GROUP BY 1, 2 HAVING count(*) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY shared DESC, abs(candidate - scene), candidate) AS r FROM c)
SELECT scene, candidate, r::BIGINT AS r FROM k WHERE r <= 8""")
def q_ref_candidates(spark: SparkSession, d: str) -> DataFrame:
    """References of a stated query set of orders; persons are suppliers, two in common make a candidate."""
    people = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scene"), F.col("l_suppkey").alias("who")).distinct()
    orders = table(spark, d, "orders")
    order = orders.select(F.col("o_orderkey").alias("scene"), F.col("o_orderkey").alias("pos"), F.lit("one").alias("line"))
    refs = orders.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("scene"), F.lit("那件事").alias("ref"))
    none = spark.createDataFrame([], "id long, bigram string")
    aliases = spark.createDataFrame([], "name string, who long")
    found = timeline.ref_candidates(refs, people, order, none, aliases)
    return found.select("scene", "candidate", F.col("r").cast("long").alias("r"))


@query(f"""WITH {_LINES}, p AS (SELECT DISTINCT thread, off + t AS g FROM e WHERE off IS NOT NULL AND t IS NOT NULL), s AS (SELECT thread, g, g - lag(g) OVER (PARTITION BY thread ORDER BY g) AS gap, min(g) OVER (PARTITION BY thread) AS lo, max(g) OVER (PARTITION BY thread) AS hi FROM p),
b AS (SELECT *, sum(CASE WHEN gap > (hi - lo) * 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY g) AS block FROM s), k AS (SELECT thread, block, min(g) AS t0, max(g) AS t1 FROM b GROUP BY 1, 2)
SELECT thread, block::BIGINT AS block, t0, t1 FROM k""")
def q_broken_axis(spark: SparkSession, d: str) -> DataFrame:
    return axis.build(_global(spark, d), ["thread"], "g").select("thread", "block", "t0", "t1")


def _global(spark: SparkSession, d: str) -> DataFrame:
    return _scenes(spark, d).join(_threads(spark, d), "thread").select("thread", "scene", "event_type", (F.col("offset") + F.col("t")).alias("g"))


_AXIS = f"""{_LINES}, p AS (SELECT DISTINCT thread, off + t AS g FROM e WHERE off IS NOT NULL AND t IS NOT NULL), s AS (SELECT thread, g, g - lag(g) OVER (PARTITION BY thread ORDER BY g) AS gap, min(g) OVER (PARTITION BY thread) AS lo, max(g) OVER (PARTITION BY thread) AS hi FROM p),
b AS (SELECT *, sum(CASE WHEN gap > (hi - lo) * 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY g) AS block FROM s),
k AS (SELECT thread, block, lo, hi, min(g) AS t0, max(g) AS t1 FROM b GROUP BY 1, 2, 3, 4),
m AS (SELECT *, count(*) OVER (PARTITION BY thread) AS n, sum(t1 - t0) OVER (PARTITION BY thread) AS total FROM k),
v AS (SELECT *, CASE WHEN n = 1 THEN 0.0::DOUBLE WHEN (n - 1) * 3.0::DOUBLE + n >= 100 THEN greatest(1.0::DOUBLE, greatest(0.0::DOUBLE, 100.0::DOUBLE - n) * 0.4::DOUBLE / (n - 1)) ELSE 3.0::DOUBLE END AS bw FROM m),
x AS (SELECT *, 1.0::DOUBLE + CASE WHEN total > 0 THEN (t1 - t0) / total * (100.0::DOUBLE - (n - 1) * bw - n) ELSE (100.0::DOUBLE - (n - 1) * bw - n) / n END AS w, n > 1 AND (n - 1) * bw + n >= 100 AS degraded FROM v),
y AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY thread ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) + block * bw AS l FROM x),
axis AS (SELECT thread, block::BIGINT AS block, CASE WHEN degraded THEN lo ELSE t0 END AS t0, CASE WHEN degraded THEN hi ELSE t1 END AS t1, CASE WHEN degraded THEN 0.0::DOUBLE ELSE l END AS x0, CASE WHEN degraded OR block = n - 1 THEN 100.0::DOUBLE ELSE l + w END AS x1, degraded FROM y WHERE NOT degraded OR block = 0)"""


@query(f"WITH {_AXIS} SELECT thread, block, round(x0, 6) AS x0, round(x1, 6) AS x1, degraded FROM axis")
def q_axis_widths(spark: SparkSession, d: str) -> DataFrame:
    return axis.build(_global(spark, d), ["thread"], "g").select("thread", "block", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"), "degraded")


@query(f"""WITH {_AXIS}, z AS (SELECT e.thread, event_type, block, axis.t0 AS b0, axis.t1 AS b1, x0 AS c0, x1 AS c1, min(off + t) AS t0, max(off + t) AS t1 FROM e JOIN axis ON e.thread = axis.thread AND off + t BETWEEN axis.t0 AND axis.t1 GROUP BY ALL),
q AS (SELECT *, CASE WHEN b0 = b1 THEN (c0 + c1) / 2 ELSE c0 + (t0 - b0) / (b1 - b0) * (c1 - c0) END AS p0, CASE WHEN b0 = b1 THEN (c0 + c1) / 2 ELSE c0 + (t1 - b0) / (b1 - b0) * (c1 - c0) END AS p1 FROM z),
u AS (SELECT *, least(greatest(c0, (p0 + p1) / 2 - 0.3::DOUBLE), c1 - 0.6::DOUBLE) AS s FROM q)
SELECT thread, event_type, block, t0, t1, round(CASE WHEN b0 = b1 THEN c0 WHEN p1 - p0 < 0.6::DOUBLE THEN s ELSE p0 END, 6) AS x0, round(CASE WHEN b0 = b1 THEN c1 WHEN p1 - p0 < 0.6::DOUBLE THEN s + 0.6::DOUBLE ELSE p1 END, 6) AS x1 FROM u""")
def q_lane_segments(spark: SparkSession, d: str) -> DataFrame:
    g = _global(spark, d)
    return axis.lane_segments(g, axis.build(g, ["thread"], "g"), ["thread"], "event_type", "g").select("thread", "event_type", "block", "t0", "t1", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query(f"""WITH RECURSIVE {_LINES}, r AS (SELECT thread, off + t AS g, row_number() OVER (PARTITION BY thread ORDER BY off + t) AS k FROM e WHERE event_type = 'error' AND off IS NOT NULL AND t IS NOT NULL),
f AS (SELECT thread, g, k, g AS a, 0 AS cluster FROM r WHERE k = 1 UNION ALL
SELECT r.thread, r.g, r.k, CASE WHEN r.g - (f.a + f.g) / 2 < 24 THEN f.a ELSE r.g END, CASE WHEN r.g - (f.a + f.g) / 2 < 24 THEN f.cluster ELSE f.cluster + 1 END FROM f JOIN r ON r.thread = f.thread AND r.k = f.k + 1)
SELECT thread, g AS position, cluster::BIGINT AS cluster, round((min(g) OVER (PARTITION BY thread, cluster) + max(g) OVER (PARTITION BY thread, cluster)) / 2, 6) AS centre FROM f""")
def q_gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    g = _global(spark, d).where("event_type = 'error' and g is not null")
    return folds.gap_clusters(g.select("thread", "g"), "thread", "g", 24.0)


@query("""WITH s AS (SELECT o_custkey AS thread, o_orderkey AS scene, o_totalprice FROM orders) SELECT thread, sum(CASE WHEN scene % 11 = 0 OR scene % 13 = 0 THEN 0 ELSE 1 + scene % 100 END)::BIGINT AS words, count(*)::BIGINT AS scenes, count(*) FILTER (scene % 17 = 0)::BIGINT AS gaps FROM s GROUP BY 1""")
def q_thread_stats(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("thread"), F.col("o_orderkey").alias("scene"))
    scenes = o.select("scene", (1 + F.col("scene") % 100).alias("chars"), (F.col("scene") % 13 == 0).alias("removed"))
    stats = triage.thread_stats(o, scenes, o.where("scene % 17 = 0").select("thread"), o.where("scene % 11 = 0").select("scene"))
    return stats


@query("""WITH t AS (SELECT c_custkey AS thread FROM customer WHERE c_custkey % 10 <> 0), b AS (SELECT c_custkey AS thread, CASE c_custkey % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'merge' WHEN 2 THEN 'cut' ELSE 'bogus' END AS col, c_custkey - c_custkey % 3 AS target FROM customer WHERE c_custkey % 7 <> 0),
u AS (SELECT coalesce(t.thread, b.thread) AS thread, CASE WHEN col IN ('keep', 'merge', 'cut') THEN col ELSE 'undecided' END AS col, CASE WHEN col = 'merge' THEN target END AS merge_into, t.thread IS NULL AS orphan FROM t FULL JOIN b ON t.thread = b.thread)
SELECT u.thread, u.col, u.merge_into, u.orphan, u.col = 'merge' AND (v.thread IS NULL OR v.col IN ('cut', 'merge') OR u.merge_into = u.thread) AS merge_invalid FROM u LEFT JOIN u v ON v.thread = u.merge_into AND NOT v.orphan""")
def q_board_reconcile(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("thread"))
    kind = F.element_at(F.array(F.lit("keep"), F.lit("merge"), F.lit("cut"), F.lit("bogus")), (F.col("thread") % 4 + 1).cast("int"))
    board = c.where("thread % 7 <> 0").select("thread", kind.alias("col"), (F.col("thread") - F.col("thread") % 3).alias("merge_into"), F.lit("").alias("note"))
    return triage.reconcile(board, c.where("thread % 10 <> 0")).select("thread", "col", "merge_into", "orphan", "merge_invalid")


@query("SELECT thread, name, scenes FROM (SELECT min(l_partkey) AS thread, max(l_partkey) AS last, l_orderkey AS name, count(DISTINCT CASE WHEN l_returnflag IN ('A', 'N') THEN l_linenumber END)::BIGINT AS scenes FROM lineitem GROUP BY l_orderkey) WHERE thread = last AND scenes > 0")
def q_impact_only(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("thread"), F.col("l_linenumber").alias("scene"), F.col("l_orderkey").cast("string").alias("name"), F.when(F.col("l_returnflag").isin("A", "N"), "主要").otherwise("提及").alias("role"))
    return triage.only_here(rows).select("thread", F.col("name").cast("long").alias("name"), "scenes")


@query("WITH x AS (SELECT user_id AS thread, event_id AS scene, event_id + 1 AS main_scene FROM events WHERE event_type = 'error' AND user_id <> 1) SELECT thread, 1::BIGINT AS other, scene, main_scene FROM x UNION ALL SELECT 1, thread, scene, main_scene FROM x")
def q_impact_crossings(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").where("event_type = 'error' and user_id <> 1").select(F.col("user_id").cast("string").alias("thread"), F.col("event_id").alias("scene"), (F.col("event_id") + 1).alias("main_scene"))
    return triage.crossings(x, "1").select(F.col("thread").cast("long").alias("thread"), F.col("other").cast("long").alias("other"), "scene", "main_scene")


@query("WITH n AS (SELECT DISTINCT n_nationkey AS thread, n_name AS name FROM nation), r AS (SELECT s_nationkey AS other, s_suppkey AS scene, '见' || n_name || '旧事' AS text FROM supplier JOIN nation ON n_nationkey = (s_suppkey * 7) % 25) SELECT thread, scene, other, text, name FROM n JOIN r ON contains(text, name) AND thread <> other")
def q_impact_refs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("thread"), F.col("n_name").alias("name"))
    s = table(spark, d, "supplier").withColumn("k", F.col("s_suppkey") * 7 % 25).join(n.select(F.col("thread").alias("k"), "name"), "k")
    refs = s.select(F.col("s_nationkey").alias("thread"), F.col("s_suppkey").alias("scene"), F.concat(F.lit("见"), "name", F.lit("旧事")).alias("text"))
    return triage.maybe_refs(n, n.select("name", F.col("name").alias("alias")), refs)
