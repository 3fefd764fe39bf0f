"""Queries of the near-duplicate step over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, whole_sets
from ..storage import cut
from .registry import query, table

_SHINGLES = """sh AS (SELECT DISTINCT doc_id, CASE WHEN length(s) < 5 THEN s ELSE substr(s, i, 5) END AS g FROM (SELECT doc_id, s, unnest(generate_series(1, greatest(length(s) - 4, 1))) AS i FROM (SELECT doc_id, regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g') AS s FROM documents) WHERE s <> ''))"""
_PAIRS = f"""{_SHINGLES},
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1 HAVING count(*) >= 100),
el AS (SELECT sh.doc_id, g FROM sh JOIN n USING (doc_id)),
df AS (SELECT g FROM el GROUP BY 1 HAVING count(*) BETWEEN 2 AND 200),
e AS (SELECT el.doc_id, g FROM el JOIN df USING (g)),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
m AS (SELECT a, b, inter, inter / (na.n + nb.n - inter) AS j, inter / least(na.n, nb.n) AS c, CASE WHEN na.n <= nb.n THEN a ELSE b END AS smaller FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b),
k AS (SELECT *, CASE WHEN j >= 0.5 THEN 'jaccard' ELSE 'containment' END AS kind FROM m WHERE j >= 0.5 OR c >= 0.8),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, smaller ORDER BY inter DESC, round(j, 4) DESC, CASE WHEN smaller = a THEN b ELSE a END) AS r FROM k),
p AS (SELECT a, b, inter, round(j, 4) AS jaccard, round(c, 4) AS containment, smaller, kind FROM r WHERE kind = 'jaccard' OR r = 1)"""
#: The pairs by all shingles, however many texts have them.
_WHOLE = _PAIRS.replace("BETWEEN 2 AND 200", ">= 2")
_GROUPS = f"""WITH RECURSIVE {_PAIRS},
u AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p),
reach AS (SELECT x, x AS y FROM u UNION SELECT reach.x, u.y FROM reach JOIN u ON reach.y = u.x),
g AS (SELECT x AS doc_id, min(y) AS first FROM reach GROUP BY 1)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")


@query(f"WITH {_SHINGLES} SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1) USING (doc_id)")
def q_shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    return dedup.shingle_counts(_docs(spark, d)).select(F.col("id").cast("long").alias("doc_id"), "n")


@query(f"WITH {_SHINGLES} SELECT df::BIGINT AS df, count(*)::BIGINT AS shingles FROM (SELECT g, count(*) AS df FROM sh GROUP BY 1) GROUP BY 1")
def q_shingle_df(spark: SparkSession, d: str) -> DataFrame:
    return dedup.shingles(_docs(spark, d)).groupBy("h").agg(F.count("*").alias("df")).groupBy("df").agg(F.count("*").alias("shingles"))


@query(f"WITH {_PAIRS} SELECT a, b, inter::BIGINT AS inter, jaccard, containment, smaller, kind FROM p")
def q_near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = dedup.near_duplicate_pairs(_docs(spark, d))
    return pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "inter", "jaccard", "containment", F.col("smaller").cast("long").alias("smaller"), "kind")


@query(f"{_GROUPS}, z AS (SELECT doc_id, first, dense_rank() OVER (ORDER BY first)::VARCHAR AS no FROM g) SELECT doc_id, first, 'G-' || lpad(no, greatest(3, length(no))::INTEGER, '0') AS label FROM z")
def q_version_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = dedup.version_groups(dedup.near_duplicate_pairs(_docs(spark, d)))
    return groups.select(F.col("id").cast("long").alias("doc_id"), F.col("first").cast("long").alias("first"), F.col("group").alias("label"))


@query(f"{_GROUPS} SELECT first, doc_id AS main FROM (SELECT first, doc_id, row_number() OVER (PARTITION BY first ORDER BY n_chars DESC, doc_id) AS r FROM g JOIN documents USING (doc_id)) WHERE r = 1")
def q_main_version(spark: SparkSession, d: str) -> DataFrame:
    groups = cut(dedup.version_groups(dedup.near_duplicate_pairs(_docs(spark, d))))
    scenes = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("chars"), F.lit(0.0).alias("mtime"))
    mains = dedup.choose_main(groups, scenes).where("is_main").join(groups.select("id", "first"), "id")
    return mains.select(F.col("first").cast("long").alias("first"), F.col("id").cast("long").alias("main"))


@query(f"{_GROUPS} SELECT (SELECT count(*) FROM documents)::BIGINT AS scenes, (SELECT count(*) FROM p)::BIGINT AS pairs, count(DISTINCT first)::BIGINT AS groups, count(*)::BIGINT AS scenes_in_groups FROM g")
def q_dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    pairs = cut(dedup.near_duplicate_pairs(docs))
    return dedup.summary(docs, pairs, dedup.version_groups(pairs))


@query("""WITH w AS (SELECT item_id, text FROM benchmark) SELECT item_id, count(doc_id)::BIGINT AS documents FROM w LEFT JOIN documents d ON contains(d.text, w.text) GROUP BY 1""")
def q_planted_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whole items found verbatim.  A stated query set against all rows: item lines are looked up by
    their first five words among the documents' word windows, then compared whole."""
    from ..operators.search import verbatim

    found = verbatim(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("item"), "text"))
    items = table(spark, d, "benchmark").select("item_id")
    counts = found.groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("documents"))
    return items.join(counts, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))


@query(f"WITH {_WHOLE} SELECT smaller, CASE WHEN smaller = a THEN b ELSE a END AS container, inter::BIGINT AS inter, containment FROM p WHERE kind = 'containment'")
def q_containment_best(spark: SparkSession, d: str) -> DataFrame:
    """The one best container of each text that is no more than a part of others, by all shingles that they share."""
    best = whole_sets.best_containers(_docs(spark, d))
    return best.select(F.col("smaller").cast("long").alias("smaller"), F.col("container").cast("long").alias("container"), "inter", "containment")
