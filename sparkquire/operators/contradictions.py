"""Contradictions over runs: ids and verdicts carried on, settled facts, scenes to follow up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import signature
from ..functions.vectorised import norm_number
from .timeline import carry_ids

#: A judgement's statuses, levels and categories; what a missing one becomes.
STATUSES = ("真矛盾", "有意为之", "可解释", "无法判断")
UNKNOWN = "无法判断"


def scene_times(members: DataFrame, threads: DataFrame) -> DataFrame:
    """(scene, thread, t, conf): global times; here an unaligned line counts as offset 0.
    members: thread, scene, t, conf; threads: thread, offset."""
    both = members.join(threads, "thread", "left")
    return both.select("scene", "thread", (F.coalesce("offset", F.lit(0.0)) + F.col("t")).alias("t"), "conf")


def values_signature(values: DataFrame) -> DataFrame:
    """(subject, attribute, sig) of groups' values, numerals read as numbers.  values: subject, attribute, value."""
    keyed = values.withColumn("k", norm_number(F.btrim("value")))
    return keyed.groupBy("subject", "attribute").agg(signature(F.array_join(F.array_sort(F.collect_list("k")), "\x1f")).alias("sig"))


def build_result(groups: DataFrame, judged: DataFrame, old: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of this run with id, judgement, verdict and whether it is stale; and orphans: old
    verdicts whose group is gone.

    groups: subject, attribute, sig, no; judged: subject, attribute, status, reason; old: subject,
    attribute, sig, verdict, verdict_sig, verdict_stale, orphan (groups go before orphans); registry:
    subject, attribute, id (and number, see ``carry_ids``).  A verdict is stale while the values differ from those it was given
    for; where those are unknown, as it was.
    """
    key = F.concat_ws("\x1f", "subject", "attribute")
    last = old.groupBy("subject", "attribute").agg(F.min_by(F.struct("sig", "verdict", "verdict_sig", "verdict_stale"), F.coalesce("orphan", F.lit(False)).cast("int")).alias("o"))
    basis = F.coalesce(F.col("o.verdict_sig"), F.when(~F.coalesce("o.verdict_stale", F.lit(False)), F.col("o.sig")))
    numbered = carry_ids(groups.withColumns({"group_sig": F.col("sig"), "sig": key}), registry.withColumn("sig", key).drop("subject", "attribute"), registry.select(key.alias("sig"), F.lit(None).cast("string").alias("verdict")).limit(0), "C-")
    both = numbered.drop("verdict", "sig").withColumnRenamed("group_sig", "sig").join(judged, ["subject", "attribute"], "left").join(last, ["subject", "attribute"], "left")
    has = F.col("o.verdict").isNotNull()
    stale = F.when(~has, False).when(basis.isNotNull(), basis != F.col("sig")).otherwise(F.coalesce("o.verdict_stale", F.lit(False)))
    out = both.select("id", "subject", "attribute", F.coalesce("status", F.lit(UNKNOWN)).alias("status"), "sig", F.col("o.verdict").alias("verdict"), F.when(has, basis).alias("verdict_sig"), stale.alias("verdict_stale"))
    gone = last.where("o.verdict is not null").join(groups.select("subject", "attribute"), ["subject", "attribute"], "left_anti")
    gone = gone.select("subject", "attribute", F.col("o.verdict").alias("verdict"), F.col("o.sig").alias("sig"), basis.alias("verdict_sig"), F.when(basis.isNotNull(), ~basis.eqNullSafe(F.col("o.sig"))).otherwise(F.coalesce("o.verdict_stale", F.lit(False))).alias("verdict_stale"))
    return out, gone


def reuse_judgement(groups: DataFrame, judged: DataFrame, earlier: DataFrame) -> DataFrame:
    """Judgements of this run, and for groups whose batch failed that of the last one if the
    values are the same.  earlier: subject, attribute, sig, status, reason."""
    both = groups.select("subject", "attribute", "sig").join(judged.select("subject", "attribute", "status", "reason"), ["subject", "attribute"], "left")
    both = both.join(earlier.select("subject", "attribute", "sig", F.col("status").alias("s0"), F.col("reason").alias("r0")), ["subject", "attribute", "sig"], "left")
    return both.select("subject", "attribute", F.coalesce("status", "s0", F.lit(UNKNOWN)).alias("status"), F.coalesce("reason", "r0", F.lit("")).alias("reason"))


def canon_items(verdicts: DataFrame, values: DataFrame) -> DataFrame:
    """(subject, attribute, value, sources, note): what authors settled, stale verdicts aside; the
    scenes of a picked value are found however its numerals are written.
    verdicts: subject, attribute, kind, value, note, stale; values: subject, attribute, value, scene."""
    live = verdicts.where("kind in ('pick', 'own') and not coalesce(stale, false)").withColumn("k", norm_number(F.btrim("value")))
    found = values.withColumn("k", norm_number(F.btrim("value"))).groupBy("subject", "attribute", "k").agg(F.array_sort(F.collect_set("scene")).alias("scenes"))
    both = live.join(found, ["subject", "attribute", "k"], "left")
    none = F.array().cast(found.schema["scenes"].dataType)
    return both.select("subject", "attribute", "value", F.when(F.col("kind") == "pick", F.coalesce("scenes", none)).otherwise(none).alias("sources"), F.coalesce("note", F.lit("")).alias("note"))


def followups(verdicts: DataFrame, values: DataFrame) -> DataFrame:
    """(subject, attribute, scene, value): scenes with another value than the one picked, or with any
    value if the author wrote their own."""
    decided = verdicts.where("kind in ('pick', 'own')").select("subject", "attribute", "kind", norm_number(F.btrim("value")).alias("k"))
    both = values.withColumn("vk", norm_number(F.btrim("value"))).join(decided, ["subject", "attribute"])
    return both.where("kind = 'own' or vk <> k").select("subject", "attribute", "scene", "value").distinct()


def check_verdict(kind: str, value: str | None, values: list[str]) -> None:
    if kind not in ("pick", "own", "ignore"):
        raise ValueError("a verdict is pick, own or ignore")
    if kind == "pick" and value not in values:
        raise ValueError("a picked value must be one of the group's")
    if kind == "own" and not (value or "").strip():
        raise ValueError("an own value can't be empty")


def carry_judgements(groups: DataFrame, judged: DataFrame, failed: DataFrame, earlier: DataFrame) -> DataFrame:
    """(subject, attribute, batch, status, reason, from_run, failed): every group of this run with its judgement.

    groups: subject, attribute, sig (of its values), batch; judged: subject, attribute, status, reason (batches may answer in part);
    failed: batch; earlier: run, subject, attribute, sig, status, reason, of all runs before.  A group that was judged
    keeps that.  One whose batch failed takes the last judgement that any earlier run gave for the same values (``from_run``
    says which); values that have changed are never judged by what was said of others, and a group that a sound batch
    passed over isn't either.  What is left is UNKNOWN.  ``failed`` groups are due again, whether they carry one or not.
    """
    told = judged.where(F.col("status").isin(*STATUSES)).groupBy("subject", "attribute").agg(F.min(F.struct("status", "reason")).alias("j"))
    kept = earlier.where(F.col("status").isin(*STATUSES)).groupBy("subject", "attribute", "sig").agg(F.max(F.struct("run", "status", "reason")).alias("e"))
    rows = groups.select("subject", "attribute", "sig", "batch").join(failed.select("batch", F.lit(True).alias("_f")).distinct(), "batch", "left").join(told, ["subject", "attribute"], "left").join(kept, ["subject", "attribute", "sig"], "left")
    lost = F.coalesce("_f", F.lit(False)) & F.col("j").isNull()
    old = lost & F.col("e").isNotNull()
    status = F.coalesce("j.status", F.when(old, F.col("e.status")), F.lit(UNKNOWN))
    reason = F.coalesce("j.reason", F.when(old, F.col("e.reason")), F.lit(""))
    return rows.select("subject", "attribute", "batch", status.alias("status"), reason.alias("reason"), F.when(old, F.col("e.run")).alias("from_run"), lost.alias("failed"))
