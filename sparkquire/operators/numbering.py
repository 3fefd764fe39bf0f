"""Numbers in a global order without a window over everything.

Rows are dealt by ranges of the order and sorted within them; a range's first number is the count of all
rows before it, from one row a partition.  No task sees more than its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut

#: A partition's number stands above these bits of ``monotonically_increasing_id``.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[Column | str], name: str = "no") -> DataFrame:
    """df with ``name``: 1, 2 and on in that order (equal rows in any), checkpointed.  Only the
    columns of df are carried, so numbering a wide table means numbering its keys and joining."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    if not keys:
        raise ValueError("numbers need an order")
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = cut(rows.withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, ROW_BITS)
    before, total = [], 0
    for p, n in sorted(tuple(r) for r in rows.groupBy(part.alias("p")).count().collect()):  # a row a partition
        before.append((p, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before or [(0, 0)], "_p long, _before long")
    place = F.col(name).bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + F.col("_before") + 1
    return rows.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, place).select(*df.columns, name)


#: Rows whose totals one task makes.
SPAN = 100_000


def running_totals(df: DataFrame, order: list[Column | str], value: Column, name: str = "before") -> DataFrame:
    """df with ``no`` (see ``numbered``) and ``name``: the sum of ``value`` over all rows before it in the order, checkpointed.

    Numbers are cut into spans of SPAN rows; a span is summed on its own and begins with the total of the spans
    before it, of which there is a row each.  What a row gets depends on the rows before it alone."""
    rows = numbered(df.withColumn("_value", F.coalesce(value, F.lit(0)).cast("long")), order, "no").withColumn("_span", F.floor((F.col("no") - 1) / SPAN))
    totals = rows.groupBy("_span").agg(F.sum("_value").alias("_total"))
    ahead = totals.select("_span", F.coalesce(F.sum("_total").over(W.orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = F.coalesce(F.sum("_value").over(W.partitionBy("_span").orderBy("no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut(rows.withColumn("_inside", inside).join(ahead, "_span").withColumn(name, F.col("_inside") + F.col("_ahead")).select(*df.columns, "no", name))
