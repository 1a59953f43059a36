"""Running sums over whole tables, by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywell.session import checkpoint_ready


def running(counts: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    """``counts`` with upto_<weight> for each of ``weights``: its sum over rows of the same keys up to each x.

    Rows are dealt into ranges of x; sums run within a range, and what stands
    before a range comes from its totals, of which there are as many as ranges.
    """
    checkpoint_ready(counts.sparkSession)
    dealt = counts.repartitionByRange(*keys, "x").withColumn("part", F.spark_partition_id()).checkpoint()
    totals = dealt.groupBy(*keys, "part").agg(*[F.sum(w).alias(f"total_{w}") for w in weights])
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "part", *[F.coalesce(F.sum(f"total_{w}").over(earlier), F.lit(0)).alias(f"before_{w}") for w in weights])
    own = Window.partitionBy(*keys, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(before, [*keys, "part"])
    return joined.withColumns({f"upto_{w}": F.col(f"before_{w}") + F.sum(w).over(own) for w in weights}).drop("part", *[f"before_{w}" for w in weights])


def cumulative(counts: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``counts`` with upto: the running sum of one weight."""
    return running(counts, keys, [weight]).withColumnRenamed(f"upto_{weight}", "upto")
