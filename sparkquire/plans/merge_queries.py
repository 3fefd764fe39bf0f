"""Windows' answers stitched, long lines by volumes, lines interleaved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import folds, interleaving, long_lines, stitching
from .registry import query, table

# windows of whole books (sources) as q_overlap_windows has them
_WINDOWS = """r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, n_chars + 1 AS size, sum(n_chars + 1) OVER (PARTITION BY source ORDER BY doc_id) AS upto, count(*) OVER (PARTITION BY source) AS n FROM documents),
e AS (SELECT a.source, a.k AS s, a.n, least(a.n, greatest(max(CASE WHEN b.upto - a.upto + a.size <= 30000 THEN b.k + 1 ELSE a.k + 1 END), a.k + 11)) AS e FROM r a JOIN r b ON a.source = b.source AND b.k >= a.k GROUP BY a.source, a.k, a.n),
w AS (SELECT source, 0 AS win, s, e, n FROM e WHERE s = 0 UNION ALL SELECT w.source, win + 1, e.s, e.e, w.n FROM w JOIN e ON e.source = w.source AND e.s = w.e - 10 WHERE w.e < w.n)"""


def chapters_by_rule(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """A judge by rule, with an answer for each window: a chapter begins at its first row and wherever its rows' sizes pass
    another 10,000; every third of these chapters begins a volume, and so does a row behind a very long one.
    rows: book, row (from 0), size."""
    inside = windows.join(rows, "book").where((F.col("row") >= F.col("first")) & (F.col("row") < F.col("last")))
    own = W.partitionBy("book", "window").orderBy("row")
    before = F.coalesce(F.sum("size").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = inside.withColumns({"chapter": F.floor(before / 10_000), "behind": F.coalesce(F.lag("size").over(own) > 12_000, F.lit(False))})
    rows = rows.withColumn("opens", F.coalesce(F.lag("chapter").over(own) != F.col("chapter"), F.lit(True)))
    said = F.concat(F.col("window").cast("string"), F.lit("/"), F.col("chapter").cast("string"))
    start = (F.col("row") - F.col("first")).alias("start")
    chapters = rows.where("opens").select("book", "window", F.lit("chapter").alias("kind"), F.concat(F.lit("c"), said).alias("title"), start)
    volumes = rows.where("behind or opens and chapter % 3 = 0").select("book", "window", F.lit("volume").alias("kind"), F.concat(F.lit("v"), said).alias("title"), start)
    return chapters.unionByName(volumes)


@query(f"""WITH RECURSIVE {_WINDOWS},
i AS (SELECT w.source, win, s, r.k, r.size - 1 AS size, coalesce(sum(r.size - 1) OVER (PARTITION BY w.source, win ORDER BY r.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 10000 AS ch FROM w JOIN r ON r.source = w.source AND r.k >= s AND r.k < e),
o AS (SELECT *, coalesce(lag(ch) OVER q <> ch, true) AS opens, coalesce(lag(size) OVER q > 12000, false) AS behind FROM i WINDOW q AS (PARTITION BY source, win ORDER BY k)),
a AS (SELECT source, win, 'chapter' AS kind, 'c' || win || '/' || ch::BIGINT AS title, k FROM o WHERE opens UNION ALL SELECT source, win, 'volume', 'v' || win || '/' || ch::BIGINT, k FROM o WHERE behind OR opens AND ch % 3 = 0),
c AS (SELECT source, win, CASE WHEN win = 0 THEN 0 ELSE s + 5 END AS low, coalesce(lead(s) OVER (PARTITION BY source ORDER BY win) + 5, e) AS high FROM w),
g AS (SELECT source, kind, k, min(title) AS title FROM a JOIN c USING (source, win) WHERE k >= low AND k < high GROUP BY ALL),
v AS (SELECT source, title, k, (SELECT min(x.k) FROM g x WHERE x.source = g.source AND x.kind = 'chapter' AND x.k >= g.k) AS spot FROM g WHERE kind = 'volume')
SELECT source AS book, kind, title, k::BIGINT AS start FROM g WHERE kind = 'chapter' UNION ALL SELECT source, 'volume', arg_min(title, k), spot::BIGINT FROM v WHERE spot IS NOT NULL GROUP BY source, spot""")
def q_stitched_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("book"), "doc_id", F.col("n_chars").alias("size"))
    windows = folds.window_rows(docs, "book", "doc_id", "size", 30_000)
    rows = docs.select("book", (F.row_number().over(W.partitionBy("book").orderBy("doc_id")) - 1).alias("row"), "size")
    return stitching.stitched(windows, chapters_by_rule(windows, rows)).select("book", "kind", "title", "start")


_EVENT_INDEX = "x AS (SELECT event_id, event_type AS line, user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx FROM events)"


def _line_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Event types as lines: a user's events, numbered, are the source that their runs come from."""
    e = table(spark, d, "events")
    index = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return e.select(F.col("event_type").alias("line"), F.col("event_id").alias("scene"), F.col("user_id").alias("source"), index.alias("index"), "ts", "value")


@query(f"""WITH {_EVENT_INDEX},
m AS (SELECT *, CASE WHEN lag(idx) OVER q = idx - 1 THEN 0 ELSE 1 END AS new FROM x WINDOW q AS (PARTITION BY line, user_id ORDER BY idx)), s AS (SELECT *, sum(new) OVER (PARTITION BY line ORDER BY user_id, idx) AS seg FROM m),
a AS (SELECT line, seg, event_id, CASE WHEN event_id % 5 = 0 THEN event_id % 8 ELSE user_id % 8 END + 1 AS vol FROM s WHERE event_id % 17 <> 0),
b AS (SELECT line, seg, vol, row_number() OVER (PARTITION BY line, seg ORDER BY count(*) DESC, vol) AS k FROM a GROUP BY line, seg, vol), v AS (SELECT s.*, b.vol FROM s LEFT JOIN b ON b.line = s.line AND b.seg = s.seg AND b.k = 1),
o AS (SELECT line, vol, event_id, value, row_number() OVER (PARTITION BY line, vol ORDER BY ts, event_id) - 1 AS pos FROM v WHERE vol IS NOT NULL AND event_id % 23 <> 0),
n AS (SELECT line, vol, count(*) AS n, max(CASE WHEN event_id % 7 <> 0 THEN floor(value) END) AS t FROM o GROUP BY ALL),
f AS (SELECT line, vol, coalesce(sum(n) OVER q, 0) AS ahead, coalesce(sum(coalesce(t, 0)) OVER q, 0) AS shift FROM n WINDOW q AS (PARTITION BY line ORDER BY vol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o.line, event_id AS scene, o.vol::BIGINT AS volume, (ahead + pos)::BIGINT AS pos, CASE WHEN event_id % 7 <> 0 THEN floor(value) + shift END AS t FROM o JOIN f ON f.line = o.line AND f.vol = o.vol
UNION ALL SELECT line, event_id, NULL, NULL, NULL FROM v WHERE vol IS NULL OR event_id % 23 = 0""")
def q_long_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows left over have no volume.  One pass a volume: what a judge by rule gives, by time; it loses a scene now and then."""
    scenes = _line_scenes(spark, d)
    volumes = scenes.select("line").distinct().withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(8)))).select("line", F.col("place").cast("long").alias("volume"), "place")
    assigned = scenes.where("scene % 17 <> 0").select("line", "scene", (F.when(F.col("scene") % 5 == 0, F.col("scene") % 8).otherwise(F.col("source") % 8) + 1).alias("volume"))

    def by_time(members: DataFrame) -> DataFrame:
        rows = members.join(scenes.select("line", "scene", "ts", "value"), ["line", "scene"]).where("scene % 23 <> 0")
        pos = F.row_number().over(W.partitionBy("line", "volume").orderBy("ts", "scene")) - 1
        return rows.select("line", "volume", F.lit(0).alias("pass"), "scene", pos.cast("long").alias("pos"), F.when(F.col("scene") % 7 != 0, F.floor("value").cast("double")).alias("t"))

    ordered, lost = long_lines.order_long_lines(scenes, volumes, assigned, by_time)
    return ordered.unionByName(lost, allowMissingColumns=True).select("line", "scene", "volume", "pos", "t")


@query("""WITH b AS (SELECT user_id % 6 AS line, event_id AS scene, value, row_number() OVER (ORDER BY ts, event_id) AS place FROM events), n AS (SELECT count(*) AS n, (count(*) + 59) // 60 AS k FROM events),
w AS (SELECT b.*, CASE WHEN place - 1 < (n % k) * (n // k + 1) THEN (place - 1) // (n // k + 1) ELSE n % k + (place - 1 - (n % k) * (n // k + 1)) // (n // k) END + 1 AS win FROM b, n),
j AS (SELECT win, scene, min(rank) AS rank FROM (SELECT win, scene, row_number() OVER (PARTITION BY win ORDER BY value, scene) * 2 AS rank FROM w WHERE scene % 9 <> 0 AND (win % 5 <> 0 OR scene % 2 = 0) UNION ALL SELECT win, scene + 1, row_number() OVER (PARTITION BY win ORDER BY value, scene) * 2 + 1 FROM w WHERE scene % 31 = 0) GROUP BY ALL),
p AS (SELECT w.*, j.rank AS told, count(j.rank) OVER q >= 0.8 * count(*) OVER q AND (SELECT count(DISTINCT z.line) FROM w z WHERE z.win = w.win) > 1 AS judged FROM w LEFT JOIN j ON j.win = w.win AND j.scene = w.scene WINDOW q AS (PARTITION BY w.win)),
r AS (SELECT *, CASE WHEN judged THEN told END AS rank FROM p),
k AS (SELECT *, greatest(1, count(rank) OVER (PARTITION BY win, line ORDER BY place)) AS block, min(place) OVER (PARTITION BY win, line) AS head FROM r),
s AS (SELECT win, line, rank AS slot, row_number() OVER (PARTITION BY win, line ORDER BY rank) AS block FROM r WHERE rank IS NOT NULL)
SELECT k.line, k.scene, row_number() OVER (ORDER BY k.win, slot IS NULL, coalesce(slot, 0), CASE WHEN judged AND slot IS NULL THEN head ELSE 0 END, place) AS place FROM k LEFT JOIN s ON s.win = k.win AND s.line = k.line AND s.block = k.block""")
def q_interleaved(spark: SparkSession, d: str) -> DataFrame:
    """A judge by rule orders each window by value; it forgets some scenes, names some twice or from another window, and too few in some windows."""
    e = table(spark, d, "events")
    base = interleaving.numbered(e.select((F.col("user_id") % 6).alias("line"), F.col("event_id").alias("scene"), "ts"), ["ts", "scene"], "place").select("line", "scene", "place")
    values = e.select(F.col("event_id").alias("scene"), "value")

    def by_value(members: DataFrame) -> DataFrame:
        rows = members.join(values, "scene")
        order = W.partitionBy("window").orderBy("value", "scene")
        own = rows.where("scene % 9 <> 0 and (window % 5 <> 0 or scene % 2 = 0)").select("window", "scene", (2 * F.row_number().over(order)).alias("rank"))
        other = rows.where("scene % 31 = 0").select("window", (F.col("scene") + 1).alias("scene"), (2 * F.row_number().over(order) + 1).alias("rank"))
        return own.unionByName(other)

    return interleaving.interleave_book(base, by_value).select("line", "scene", F.col("place").cast("long").alias("place"))
