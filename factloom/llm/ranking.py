"""Exact sums over the rows that come before each row of its group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that one range holds on average at most.
RANGE_ROWS = 1_000_000


def running_sums(df: DataFrame, group: str, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with ``<name>_before`` and ``<name>_total`` for each of ``values``: the sum over the rows of the same ``group`` that
    precede in ``order``, and the group's sum.

    Rows are dealt to ranges of (group, order), so a group of any size lies in many ranges; each range is summed by itself, and only
    the sums of (range, group) are summed once more. ``df`` should be a written table, as it is read twice. ``group`` and the values
    must not be null; rows that are equal by ``order`` come in any order.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    dealt = cut(df.withColumns(values).repartitionByRange(parts, F.col(group), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    inside = Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    sums = dealt.groupBy("_range", group).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    sums = sums.select("_range", group, *[none(F.sum(f"_sum_{v}").over(earlier)).alias(f"_start_{v}") for v in values], *[F.sum(f"_sum_{v}").over(whole).alias(f"{v}_total") for v in values])
    found = dealt.withColumns({f"_in_{v}": none(F.sum(v).over(inside)) for v in values}).join(sums, ["_range", group])
    return found.withColumns({f"{v}_before": F.col(f"_in_{v}") + F.col(f"_start_{v}") for v in values}).select(*df.columns, *[f"{v}_{x}" for v in values for x in ("before", "total")])
