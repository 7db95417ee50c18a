"""Running totals over ordered values of groups that may be very large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.joins import on_groups

RANGES = 4096


def running_totals(counts: DataFrame, by: list[str], value: str, weights: list[str]) -> DataFrame:
    """`counts` with `<weight>_upto`: the sum of a weight over the group's rows up to and with each value.

    The values between a group's least and largest fall into RANGES ranges of equal width. Their totals are
    summed up first, RANGES + 1 rows a group, then the rows inside each range, so no task orders a whole group.
    Values are distinct in a group and not null.
    """
    ends = counts.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")).cast("double")
    place = F.when(width > 0, F.floor((F.col(value) - F.col("_lo")).cast("double") / width * RANGES)).otherwise(F.lit(0)).cast("int")
    placed = on_groups(counts, ends, by).withColumn("_range", place).drop("_lo", "_hi")
    totals = placed.groupBy(*by, "_range").agg(*(F.sum(w).alias(f"_{w}") for w in weights))
    before = Window.partitionBy(*by).orderBy("_range")
    below = totals.select(*by, "_range", *((F.sum(f"_{w}").over(before) - F.col(f"_{w}")).alias(f"_{w}_below") for w in weights))
    inside = Window.partitionBy(*by, "_range").orderBy(value)
    summed = placed.select("*", *(F.sum(w).over(inside).alias(f"_{w}_inside") for w in weights))
    joined = on_groups(summed, below, [*by, "_range"])
    return joined.select(*counts.columns, *((F.col(f"_{w}_below") + F.col(f"_{w}_inside")).alias(f"{w}_upto") for w in weights))
