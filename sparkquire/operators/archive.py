"""Archives of lines and worlds: open hooks, outdated entries, sections, references, back-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

MANY, MINOR = "（多个说法）", "（几处写法略有出入）"
_DECOR = r"(?U)[*`_\s【】\[\]]+"


def hook_items(order: DataFrame, cards: DataFrame, column: str) -> DataFrame:
    """(scene, pos, no, hook): a card's texts in story order, trimmed, each once a scene.
    order: scene, pos; cards: scene, <column> array<string>."""
    rows = order.join(cards.select("scene", F.array_distinct(F.filter(F.transform(F.col(column), lambda h: F.btrim(h)), lambda h: h.isNotNull() & (h != ""))).alias("h")), "scene")
    return rows.select("scene", "pos", F.posexplode("h").alias("no", "hook"))


def closed_hooks(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """(scene, hook) that a later scene resolves.  pairs: scene, hook, resolved_in."""
    a = order.select("scene", F.col("pos").alias("p0"))
    b = order.select(F.col("scene").alias("resolved_in"), F.col("pos").alias("p1"))
    return pairs.join(a, "scene").join(b, "resolved_in").where("p1 > p0").select("scene", "hook").distinct()


def open_hooks(planted: DataFrame, resolved: DataFrame, closed: DataFrame | None = None, same: DataFrame | None = None) -> DataFrame:
    """(line, hook, scene, scenes, hooks): planted hooks that nothing in the book resolves, by a loose key;
    the first of equals, and of a group that tells of one thing, with all of its scenes and the number of its hooks.
    planted: line, scene, pos, no, hook; resolved: hook; closed: scene, hook; same: scene, hook, group."""
    rows = planted.withColumn("k", T.loose_key(F.col("hook"))).where("k <> ''")
    rows = rows.join(resolved.select(T.loose_key(F.col("hook")).alias("k")).distinct(), "k", "left_anti")
    if closed is not None:
        rows = rows.join(closed.select("scene", "hook"), ["scene", "hook"], "left_anti")
    first = W.partitionBy("line", "k").orderBy("pos", "no")
    rows = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    rows = rows.join(same.select("scene", "hook", "group"), ["scene", "hook"], "left") if same is not None else rows.withColumn("group", F.lit(None).cast("long"))
    bunch = F.coalesce(F.col("group").cast("string"), F.concat(F.lit("k"), "k"))
    out = rows.withColumn("bunch", bunch).groupBy("line", "bunch").agg(F.min(F.struct("pos", "no", "hook", "scene")).alias("x"), F.array_sort(F.collect_set(F.struct("pos", "scene"))).alias("s"), F.count("*").alias("hooks"))
    return out.select("line", "x.hook", "x.scene", F.array_distinct(F.transform("s", lambda v: v["scene"])).alias("scenes"), "hooks")


def outdated(index: DataFrame, live: DataFrame) -> DataFrame:
    """Index entries (id) whose line or world is gone."""
    return index.join(live.select("id"), "id", "left_anti").select("id")


def fresh(index: DataFrame, inputs: DataFrame) -> DataFrame:
    """Entries whose input signature still holds and that nothing marked outdated.  Both: id, sig."""
    return index.where("not coalesce(outdated, false)").join(inputs.select("id", "sig"), ["id", "sig"], "left_semi")


def archive_faults(bodies: DataFrame, allowed: DataFrame, headings: list[str]) -> DataFrame:
    """(id, faults): missing headings, no reference at all, references outside the scope.
    bodies: id, body; allowed: id, scene."""
    missing = F.filter(F.array(*(F.when(~F.contains("body", F.lit(f"## {h}")), F.lit(f"no section {h}")) for h in headings)), lambda x: x.isNotNull()) if headings else F.array().cast("array<string>")
    rows = bodies.select("id", missing.alias("m"), T.scene_refs(F.coalesce("body", F.lit(""))).alias("refs"))
    scope = allowed.groupBy("id").agg(F.collect_set("scene").alias("scope"))
    rows = rows.join(scope, "id", "left")
    alien = F.array_sort(F.array_except("refs", F.coalesce("scope", F.array().cast("array<string>"))))
    none = F.when(F.size("refs") == 0, F.array(F.lit("no reference"))).otherwise(F.array().cast("array<string>"))
    return rows.select("id", F.concat("m", none, F.transform(alien, lambda r: F.concat(F.lit("outside the scope: "), r))).alias("faults"))


def merge_sections(bodies: DataFrame) -> DataFrame:
    """(id, body): the batches' texts (id, batch, body) as one: the first one's head, then each ``## ``
    section once, in order of appearance, its parts one after another."""
    parts = F.split(F.concat(F.lit("\n"), F.btrim("body")), r"\n(?=## )")
    rows = bodies.select("id", "batch", F.posexplode(parts).alias("no", "part"))
    head = rows.where("no = 0 and batch = 0").select("id", F.btrim("part").alias("head")).where("head <> ''")
    title = F.substring_index("part", "\n", 1)
    rest = F.btrim(F.substr("part", F.length(title) + 1), F.lit(" \n\t"))
    sections = rows.where("no > 0").select("id", F.struct("batch", "no").alias("at"), title.alias("title"), rest.alias("rest"))
    joined = sections.groupBy("id", "title").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "rest"))).alias("x"))
    texts = F.filter(F.transform("x", lambda v: v["rest"]), lambda t: t != "")
    joined = joined.select("id", F.struct("at", F.concat_ws("\n", "title", F.array_join(texts, "\n")).alias("text")).alias("s"))
    whole = joined.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda v: v["text"]), "\n\n").alias("body"))
    return whole.join(head, "id", "full").select("id", F.concat_ws("\n\n", "head", "body").alias("body"))


def subject_key(s: Column, fold: tuple[str, str] = ("", "")) -> Column:
    """A subject without decoration and spaces, characters folded by a table (from, to)."""
    return F.translate(F.regexp_replace(s, _DECOR, ""), *fold)


def section_attribute(title: Column) -> Column:
    """The controlled attribute that a section's title names, or empty: what stands behind the last divider."""
    bare = F.regexp_replace(F.regexp_replace(title, _DECOR, ""), "[：:]+$", "")
    last = F.translate(F.regexp_replace(F.element_at(F.split(bare, "[·：:、/]"), -1), r"(?U)^[\W_]+|[\W_]+$", ""), *T.ATTRIBUTE_FOLD)
    return F.when(last.isin(*T.ATTRIBUTES), last).otherwise("")


def backfill(bodies: DataFrame, groups: DataFrame, aliases: DataFrame | None = None, fold: tuple[str, str] = ("", "")) -> DataFrame:
    """(id, body, left): worlds' texts with every MANY linked to its contradiction, and how many fit none and became MINOR.

    bodies: id, body; groups: subject, attribute, id; aliases: name, canonical.  A line is matched by the attribute that its section
    names and the subject at its head, or that subject's canonical name where its aliases name one only.  Links and MINORs of an
    earlier run become MANY first, so that running it again changes nothing.  Bodies are lines here: those with a MANY
    meet the groups by (attribute, subject), and a body is put together again by its lines' numbers; null bodies are empty.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce("body", F.lit("")), "（多个说法，见矛盾 C-[0-9]+）", MANY), MINOR, MANY)
    lines = bodies.select("id", F.posexplode(F.split(text, "\n")).alias("no", "line"))
    title = F.regexp_extract("line", r"(?U)^\s*#{2,4}\s+(.+?)\s*$", 1)
    order = W.partitionBy("id").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumns({"title": title, "many": F.contains("line", F.lit(MANY))})
    lines = lines.withColumn("attribute", F.last(F.when(F.col("title") != "", section_attribute(F.col("title"))), True).over(order))
    head = F.regexp_extract("line", r"(?U)^\s*[-*+]\s+(.+?)\s*[：:]", 1)
    asked = F.col("many") & (F.col("title") == "") & (head != "") & (F.coalesce("attribute", F.lit("")) != "")
    lines = lines.withColumn("key", F.when(asked, subject_key(head, fold)))
    found = groups.groupBy(subject_key(F.col("subject"), fold).alias("key"), "attribute").agg(F.min("id").alias("link"))
    rows = lines.join(found, ["key", "attribute"], "left")
    if aliases is not None:
        single = aliases.groupBy(subject_key(F.col("name"), fold).alias("key")).agg(F.min("canonical").alias("c"), F.max("canonical").alias("d")).where("c = d")
        other = single.select("key", subject_key(F.col("c"), fold).alias("_to")).join(found.select(F.col("key").alias("_to"), "attribute", F.col("link").alias("other")), "_to").drop("_to")
        rows = rows.join(other, ["key", "attribute"], "left").withColumn("link", F.coalesce("link", "other"))
    shown = F.when(F.col("link").isNotNull(), F.concat(F.lit("（多个说法，见矛盾 "), "link", F.lit("）"))).otherwise(MINOR)
    rows = rows.select("id", F.struct("no", F.when(F.col("many") & (F.col("title") == ""), F.replace("line", F.lit(MANY), shown)).otherwise(F.col("line")).alias("line")).alias("row"), F.when(F.col("link").isNull() & (F.col("title") == ""), (F.length("line") - F.length(F.replace("line", F.lit(MANY), F.lit("")))) / len(MANY)).otherwise(0).cast("long").alias("n"))
    whole = rows.groupBy("id").agg(F.array_sort(F.collect_list("row")).alias("rows"), F.sum("n").alias("left"))
    return whole.select("id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("body"), "left")


def sections(bodies: DataFrame) -> DataFrame:
    """(id, no, title, line): lines under their section, a heading of 1 to 4 marks or a bold line."""
    lines = bodies.select("id", F.posexplode(F.split("body", "\n")).alias("no", "line"))
    bare = F.btrim("line")
    title = F.when(bare.rlike(r"^#{1,4}\s+\S"), F.regexp_replace(bare, r"^#{1,4}\s+", "")).when(bare.rlike(r"^\*\*[^*]+\*\*$"), F.regexp_extract(bare, r"^\*\*([^*]+)\*\*$", 1))
    lines = lines.withColumn("title", title)
    under = F.last("title", True).over(W.partitionBy("id").orderBy("no"))
    return lines.select("id", "no", F.coalesce(under, F.lit("")).alias("section"), F.when(F.col("title").isNull(), bare).alias("line")).where("line <> ''")


def sentences(lines: DataFrame) -> DataFrame:
    """(id, section, sentence) ending in 。！ or ？, or at the line's end."""
    found = F.regexp_extract_all("line", F.lit("([^。！？]*[。！？]+|[^。！？]+$)"), 1)
    return lines.select("id", "section", F.explode(found).alias("sentence")).where(F.btrim("sentence") != "")


def reference_rates(sentence_rows: DataFrame, allowed: DataFrame, lenient: tuple[str, ...] = ()) -> DataFrame:
    """(sentences, without_ref, no_ref_rate, refs, fabricated, fabricated_rate), one row.
    allowed: id, scene.  Sentences of lenient sections need no reference."""
    strict = ~F.col("section").isin(*lenient) if lenient else F.lit(True)
    # one pass: a row for each reference, one with nulls for a sentence without any, added up by text and scene before they meet those allowed
    each = sentence_rows.select("id", strict.alias("strict"), F.col("sentence").isNotNull().alias("told"), F.posexplode_outer(T.scene_refs(F.col("sentence"))).alias("no", "scene"))
    none = F.col("no").isNull()
    sums = each.groupBy("id", "scene").agg(F.count_if(F.col("strict") & (none | (F.col("no") == 0))).alias("sentences"), F.count_if(F.col("strict") & F.col("told") & none).alias("without_ref"), F.count("scene").alias("refs"))
    known = sums.join(allowed.select("id", "scene").distinct().withColumn("ok", F.lit(1)), ["id", "scene"], "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    both = known.agg(total("sentences").alias("sentences"), total("without_ref").alias("without_ref"), total("refs").alias("refs"), total(F.when(F.col("ok").isNull(), F.col("refs"))).alias("fabricated"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    return both.select("sentences", "without_ref", rate("without_ref", "sentences").alias("no_ref_rate"), "refs", "fabricated", rate("fabricated", "refs").alias("fabricated_rate"))
