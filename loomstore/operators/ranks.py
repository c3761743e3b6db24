"""Places in a sorted order, and values at places, without one task for all rows or for a hot group.

Rows are dealt to ranges of (group, order); each range counts inside, and what the ranges before it have of the group is added.
There are as many counts as ranges and groups meet, not as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle


def places(df: DataFrame, order: Sequence[Column], group: Sequence[str] = ()) -> DataFrame:
    """df with `place` (from 0) of each row in the order, inside its group, and `rows`, the group's number. Ties take places in any order."""
    ranged = settle(df.repartitionByRange(*[F.col(f"`{g}`") for g in group], *order).withColumn("__p", F.spark_partition_id()))
    keys = [F.col(f"`{g}`") for g in group]
    counts = ranged.groupBy("__p", *keys).agg(F.count(F.lit(1)).alias("__c"))
    of_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__c").over(of_group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__p", *keys, before.alias("__b"), F.sum("__c").over(of_group).alias("rows"))
    inside = F.row_number().over(Window.partitionBy("__p", *keys).orderBy(*order)) - 1
    left, right = ranged.withColumn("__i", inside).alias("l"), offsets.alias("r")
    same = F.col("l.__p") == F.col("r.__p")
    for g in group:
        same = same & F.col(f"l.`{g}`").eqNullSafe(F.col(f"r.`{g}`"))
    out = left.join(right, same)
    return out.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("__i") + F.col("__b")).alias("place"), F.col("r.rows").alias("rows"))


def quantiles(df: DataFrame, value: str, at: dict[str, float], group: Sequence[str] = (), nearest: bool = False) -> DataFrame:
    """the group and a column for each name in `at`: the value at that share of the sorted values that are not null.

    By linear interpolation between the two values around (n - 1) q; or, if nearest, the value at place min(n - 1, floor(q n)).
    """
    p = places(df.select(*[F.col(f"`{g}`") for g in group], F.col(value).alias("v")).filter("v IS NOT NULL"), [F.col("v")], group)
    out = []
    for name, q in at.items():
        if nearest:
            out.append(F.max(F.when(F.col("place") == F.least(F.col("rows") - 1, F.floor(F.lit(q) * F.col("rows"))), F.col("v"))).alias(name))
        else:
            x = (F.col("rows") - 1) * F.lit(float(q))
            lo = F.floor(x)
            a, b = F.max(F.when(F.col("place") == lo, F.col("v"))), F.max(F.when(F.col("place") == F.least(lo + 1, F.col("rows") - 1), F.col("v")))
            out.append((a + (b - a) * F.max(x - lo)).alias(name))
    keys = [F.col(f"`{g}`") for g in group]
    return p.groupBy(*keys).agg(*out) if keys else p.agg(*out)
