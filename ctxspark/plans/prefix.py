"""Row numbers and running sums within groups that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.plans.stage import range_parts, written


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the sum of its column up to and with the row, within ``by`` in the order of ``order``.

    A window over a group would sort the group in one task. Here rows are cut into ranges of (by, order), each range is summed on
    its own, and what comes before a range is added from one row for each range and group. Null keys are a group; ``order`` should be
    unique within a group, else rows that tie come in some order. F.lit(1) gives row numbers from 1.
    """
    ranged = df.select("*", *(c.alias(f"__{n}") for n, c in sums.items())).repartitionByRange(range_parts(df), *by, *order).withColumn("__block", F.spark_partition_id())
    rows = written(ranged, "prefix")
    key = [*by, "__block"]
    inner = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy(*key).agg(*(F.sum(f"__{n}").alias(f"__{n}") for n in sums))
    base = total.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__b{n}") for n in sums))
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    local = rows.select(*df.columns, "__block", *(F.coalesce(F.sum(f"__{n}").over(inner), F.lit(0)).alias(f"__{n}") for n in sums))
    return local.join(base, same).select(*df.columns, *((F.col(f"__{n}") + F.col(f"__b{n}")).alias(n) for n in sums))
