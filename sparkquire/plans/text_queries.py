"""Queries over texts: scalar rules, line classes, hashes, references, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import split
from .registry import query, table

LINES = [
    "第一章 风起", "第十二回", "第3节：渡口", "第九章他来了", "第二卷。", "Chapter 4", "chapter iv: night", "Chapter 5,", "# Title", "#NoSpace", "12", "12.", "1234、", "十二", "一百零八",
    "他走了。", "好！", "* * *", "---", "--", "＝＝＝", "=-=-=", "普通的一行", "　　第五回　", "", "　", "第二幕", "第二幕布", "###### deep", "0123456",
]
_VALUES = ", ".join(f"({i}, '{x}')" for i, x in enumerate(LINES))
_S = "trim(line, ' \t　\xa0')"
_B = r"\s:：、.．·—\-～~「『【《（(“"
_N = T.NUMBER_CHARS
_U = T.UNIT_CHARS


@query("SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g'))::BIGINT AS n, substr(sha256(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')), 1, 16) AS digest FROM documents")
def q_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    s = T.normalize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(s).cast("long").alias("n"), T.short_hash(s).alias("digest"))


@query("SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 16) AS short FROM documents")
def q_text_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.signature(F.col("text")).alias("digest"), T.short_hash(F.col("text")).alias("short"))


_RAW = ("年齡", "「官職」", "心事", "稱號：", "坐騎", "", "外貌", "親屬")


@query(f"""WITH r AS (SELECT doc_id, [{', '.join(repr(x) for x in _RAW)}][doc_id % {len(_RAW)} + 1] AS v, length(source) % 2 = 0 AS w FROM documents), f AS (SELECT doc_id, CASE WHEN w THEN '（' || v || '）' ELSE v END AS raw FROM r),
s AS (SELECT *, regexp_replace(translate(raw, '{T.ATTRIBUTE_FOLD[0]}', '{T.ATTRIBUTE_FOLD[1]}'), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS s FROM f)
SELECT doc_id, raw, CASE WHEN s IN ({', '.join(repr(a) for a in T.ATTRIBUTES)}) THEN s ELSE '其他' END AS attribute FROM s""")
def q_trad_fold(spark: SparkSession, d: str) -> DataFrame:
    """An attribute as a card may name it, for each document, in brackets by its source."""
    docs = table(spark, d, "documents")
    v = F.get(F.array(*map(F.lit, _RAW)), (F.col("doc_id") % len(_RAW)).cast("int"))
    raw = F.when(F.length("source") % 2 == 0, F.concat(F.lit("（"), v, F.lit("）"))).otherwise(v)
    return docs.select("doc_id", raw.alias("raw")).withColumn("attribute", T.norm_attribute(F.col("raw")))


@query("SELECT conv_id, turn, length(regexp_replace(text, '[\\s\\p{P}\\p{S}的了着过之其此]', '', 'g'))::BIGINT AS n, substr(sha256(regexp_replace(text, '[\\s\\p{P}\\p{S}的了着过之其此]', '', 'g')), 1, 16) AS digest FROM conversations")
def q_loose_key(spark: SparkSession, d: str) -> DataFrame:
    key = T.loose_key(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.length(key).cast("long").alias("n"), T.short_hash(key).alias("digest"))


@query(f"""WITH r AS (SELECT -1::BIGINT AS doc_id, i::BIGINT AS i, line FROM (VALUES {_VALUES}) t(i, line) UNION ALL SELECT doc_id, i, lines[i + 1] FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
l AS (SELECT doc_id, i, {_S} AS s, line FROM r)
SELECT doc_id, i, s = '' AS blank,
 length(regexp_replace(line, '[\\s　\xa0]+', '', 'g')) >= 3 AND translate(regexp_replace(line, '[\\s　\xa0]+', '', 'g'), '{T.SEPARATOR_CHARS}', '') = '' AS separator,
 CASE WHEN s = '' OR length(s) > 50 THEN false WHEN regexp_matches(s, '^#{{1,6}}\\s+\\S') THEN true
  WHEN regexp_matches(s, '^第[{_N}]+[{_U}]($|[{_B}])') OR regexp_matches(s, '(?i)^chapter\\s+[0-9ivxlc]+\\b') THEN NOT contains('{T.PLAIN_END}', right(s, 1))
  WHEN contains('{T.PROSE_END}', right(s, 1)) THEN false
  ELSE regexp_matches(s, '^第[{_N}]+[{_U}]') OR regexp_matches(s, '^[0-9０-９]{{1,4}}[.、．]?$') OR regexp_matches(s, '^[一二三四五六七八九十百零〇]{{1,6}}$') END AS heading,
 CASE WHEN regexp_matches(s, '^#{{1,6}}\\s+\\S') THEN 'md' || length(regexp_extract(s, '^(#+)', 1)) WHEN regexp_matches(s, '^第[{_N}]+[{_U}]') THEN regexp_extract(s, '^第[{_N}]+([{_U}])', 1)
  WHEN regexp_matches(s, '(?i)^chapter\\s+[0-9ivxlc]+\\b') THEN 'chapter' WHEN regexp_matches(s, '^[0-9０-９]{{1,4}}[.、．]?$') OR regexp_matches(s, '^[一二三四五六七八九十百零〇]{{1,6}}$') THEN 'num' END AS level
FROM l""")
def q_line_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every line of all documents, and hand-made ones of each kind."""
    made = spark.createDataFrame([(-1, i, x) for i, x in enumerate(LINES)], "doc_id long, i long, line string")
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    line = F.col("line")
    return made.union(lines.withColumn("i", F.col("i").cast("long"))).select("doc_id", "i", T.is_blank(line).alias("blank"), T.is_separator(line).alias("separator"), T.is_heading(line).alias("heading"), T.heading_level(line).alias("level"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?is)<p[ >]'))::BIGINT AS paragraphs FROM pages")
def q_page_headings(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all(html, F.lit("(?is)<p[ >]"), 0)).cast("long").alias("paragraphs"))


@query("SELECT doc_id, length(text) < 300 AS fragment FROM documents")
def q_fragment_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", split.is_fragment(F.col("text")).alias("fragment"))


@query()
def q_scene_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return split.split_scenes(docs).select(F.col("id").alias("doc_id"), "index", "start", "end", "heading", "part")


@query()
def q_size_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    scenes = split.split_scenes(docs, split.Rules(1200, 800, 2))
    return scenes.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("scenes"), F.max(F.col("end") - F.col("start")).alias("longest"))


@query("""WITH a AS (SELECT doc_id, source, sha256(text) AS sha FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT doc_id, source, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 13 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.sha = b.sha THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def q_manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.manifest import diff

    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    new = docs.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary"), 256).alias("sha256"))
    return diff(old, new).select(F.col("path").alias("doc_id"), "status")


@query("""SELECT doc_id, array_to_string(regexp_extract_all(t, 'S-\\d{4,}'), ',') AS refs FROM (SELECT doc_id, '见 [S-' || lpad((doc_id % 50)::VARCHAR, 4, '0') || '、S-' || lpad((doc_id % 7)::VARCHAR, 4, '0') || ']，又见 [S-0001] 等' AS t FROM documents)""")
def q_scene_refs(spark: SparkSession, d: str) -> DataFrame:
    number = lambda m: F.lpad((F.col("doc_id") % m).cast("string"), 4, "0")
    t = F.concat(F.lit("见 [S-"), number(50), F.lit("、S-"), number(7), F.lit("]，又见 [S-0001] 等"))
    return table(spark, d, "documents").select("doc_id", F.array_join(T.scene_refs(t), ",").alias("refs"))


@query("""SELECT source, row_number() OVER (ORDER BY regexp_extract(source, '^\\D+'), CAST(regexp_extract(source, '\\d+$') AS BIGINT))::BIGINT AS place FROM (SELECT DISTINCT source FROM documents)""")
def q_natural_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = table(spark, d, "documents").select("source").distinct()
    return rows.select("source", F.row_number().over(W.orderBy(T.natural_text(F.col("source")))).cast("long").alias("place"))
