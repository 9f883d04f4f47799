"""Running sums inside groups of any size.

A window sorts each group in one task. Here the rows are range-partitioned by group and order,
so a group may span tasks; each task sums its own part, and the parts' totals, one row for each
group and task, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provisio.runtime import cut


def running_sums(df: DataFrame, group: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    """``df`` plus, for each ``sums`` entry {new: old}, the sum of ``old`` over the rows up to this one.

    ``order`` must be unique within a group. The partitioned rows are written to the checkpoint
    folder, so that both passes see the same parts. Null summands count as zero.
    """
    parts = cut(df.repartitionByRange(*group, order).withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy(*group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*group, "_part").agg(*(F.sum(old).alias(f"_t_{new}") for new, old in sums.items()))
    offsets = totals.select(*group, "_part", *(F.coalesce(F.sum(f"_t_{new}").over(outer), F.lit(0)).alias(f"_o_{new}") for new in sums))
    out = parts
    for new, old in sums.items():
        out = out.withColumn(new, F.coalesce(F.sum(old).over(inner), F.lit(0)))
    out = out.join(offsets, [*group, "_part"])
    for new in sums:
        out = out.withColumn(new, F.col(new) + F.col(f"_o_{new}")).drop(f"_o_{new}")
    return out.drop("_part")
