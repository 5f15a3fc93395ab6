"""Row numbers over a whole table or inside groups of any size, without one task that sorts them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _dealt(df: DataFrame, order: list) -> DataFrame:
    """``df`` in range partitions sorted by ``order``, with its partition ``__part`` and its place there ``__mid``."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id())
    return cut_lineage(dealt.withColumn("__part", F.shiftright("__mid", 33)))


def numbered_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the place (from 1) of each row in its group, by the columns ``order`` ascending, nulls first.

    Rows are dealt by range over group and order, so that a group of any size is spread over tasks; a group's parts are
    then counted, one row for each part. Rows equal in group and order take places in any order.
    """
    dealt = _dealt(df, [group, *order])
    parts = dealt.groupBy(group, "__part").agg(F.min("__mid").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n").withColumnRenamed(group, "__group")
    joined = dealt.join(parts.withColumnRenamed("__part", "__of"), F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")))
    return joined.withColumn(name, F.col("__mid") - F.col("__first") + F.col("__before") + 1).drop("__group", "__of", "__part", "__mid", "__first", "__before")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: the place (from 1) of each row in the whole table by the columns ``order``."""
    dealt = _dealt(df, order)
    parts = dealt.groupBy("__part").agg(F.min("__mid").alias("__first"), F.count("*").alias("__n"))   # one row for each partition
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    return dealt.join(parts, "__part").withColumn(name, F.col("__mid") - F.col("__first") + F.col("__before") + 1).drop("__part", "__mid", "__first", "__before")


def running_total(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of its group up to its own ``order`` (one row for each ``by`` and ``order``).

    The sums run inside range partitions and are shifted by what lies in the partitions before, one row for each.
    """
    dealt = _dealt(df, [*by, order]).drop("__mid")
    inside = F.sum(value).over(Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = dealt.groupBy(*by, "__part").agg(F.sum(value).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shift = parts.withColumn("__before", F.coalesce(before, F.lit(0))).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__of"), "__before")
    same = F.col("__part") == F.col("__of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = dealt.withColumn("__inside", inside).join(shift, same)
    return out.withColumn(name, F.col("__inside") + F.col("__before")).drop("__part", "__of", "__inside", "__before", *[f"__{c}" for c in by])
