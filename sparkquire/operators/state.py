"""Steps of a collection: what is done, outdated or due, signatures of inputs, settings."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = ("import", "split", "dedup", "cards", "entities", "threads", "archive")
STATES = ("pending", "running", "done", "failed", "outdated")


def finish(steps: DataFrame, step: str, changed: bool = True, status: str = "done") -> DataFrame:
    """Steps (step, status, and any columns that say whose they are) after one has ended: if its result changed, later ones that
    are done become outdated; others stay as they are."""
    place = F.array_position(F.array(*map(F.lit, STEPS)), F.col("step"))
    later = place > STEPS.index(step) + 1
    return steps.select(*(c for c in steps.columns if c != "status"), F.when(F.col("step") == step, status).when(later & (F.col("status") == "done") & F.lit(changed), "outdated").otherwise(F.col("status")).alias("status"))


def ready(steps: DataFrame, step: str) -> bool:
    """Whether every earlier step is done."""
    before = STEPS[: STEPS.index(step)]
    return steps.where(F.col("step").isin(*before) & (F.col("status") == "done")).count() == len(before)


def recover(steps: DataFrame) -> DataFrame:
    """After a crash: what was running has failed."""
    return steps.withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))


def content_signature(rows: DataFrame, keys: list[str], ordered: bool = False) -> DataFrame:
    """(sig), one row: changes with the content of ``keys``, in no order unless ``ordered``.  Rows are
    hashed before they meet: sums of their hashes are order-free and merge on the map side."""
    h = F.xxhash64(*keys)
    both = (F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(38,0)")), F.count("*"))
    if ordered:
        both = (F.sum(F.xxhash64(F.monotonically_increasing_id(), h).cast("decimal(38,0)")), *both[1:])
    return rows.agg(F.sha2(F.concat_ws("/", *(x.cast("string") for x in both)).cast("binary"), 256).alias("sig"))


def stale(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Stored rows (key, sig) with ``stale``: their input's signature (key, sig) is another now, or gone."""
    now = current.select(key, F.col("sig").alias("_now"))
    return stored.join(now, key, "left").withColumn("stale", ~F.col("sig").eqNullSafe(F.col("_now"))).drop("_now")


def due(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items (key, sig) without a result of the same signature: only these are computed again."""
    return items.join(done.select(key, "sig"), [key, "sig"], "left_anti")


def swap(spark: SparkSession, read: Callable[[], str], compute: Callable[[], DataFrame], path: str) -> bool:
    """Writes what is computed if the inputs' signature is the same before and after; else nothing."""
    before = read()
    result = compute()
    result.write.mode("overwrite").parquet(f"{path}.new")
    if read() != before:
        return False
    spark.read.parquet(f"{path}.new").write.mode("overwrite").parquet(path)
    return True


def coverage(listed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, fault, weight): unknown, repeated (a row for the key, its weight the extra ones) or missing."""
    n = listed.groupBy(key).agg(F.count("*").alias("n"))
    both = n.join(expected.select(key).distinct().withColumn("known", F.lit(True)), key, "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    weight: Column = F.when(fault == "missing", 2).when(fault == "repeated", F.col("n") - 1).otherwise(1)
    return both.select(key, fault.alias("fault"), weight.cast("long").alias("weight")).where("fault is not null")


def masked(secret: str) -> str:
    """A secret as it may be shown."""
    return "" if not secret else f"{secret[:3]}…{secret[-4:]}" if len(secret) > 8 else "…"


@dataclass
class Job:
    name: str
    status: str = "queued"
    done: int = 0
    total: int = 0
    error: str = ""
    result: Any = None
    cancelled: threading.Event = field(default_factory=threading.Event)


class Cancelled(Exception):
    pass


class Jobs:
    """One job at a time; a job looks at ``progress`` now and then, where a wish to cancel ends it."""

    def __init__(self):
        self.lock, self.current = threading.Lock(), None

    def submit(self, spark: SparkSession, name: str, work: Callable[[Callable[[int, int], None]], Any]) -> Job:
        if not self.lock.acquire(blocking=False):
            raise RuntimeError("another job is running")
        job = self.current = Job(name, "running")

        def progress(done: int, total: int) -> None:
            job.done, job.total = done, total
            if job.cancelled.is_set():
                raise Cancelled

        def run() -> None:
            try:
                spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
                job.result = work(progress)
                job.status = "done"
            except Cancelled:
                job.status = "cancelled"
            except Exception as e:
                job.status, job.error = "failed", f"{type(e).__name__}: {e}"
            finally:
                self.lock.release()

        job.thread = threading.Thread(target=run, daemon=True)
        job.thread.start()
        return job
