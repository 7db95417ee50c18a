"""Samples that come back the same on every machine: order by a hash of seed and key, never by a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_place(key: Column, seed: int | str = 0) -> Column:
    """The place of a key in the permutation of a seed: 32 hex digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def permuted(rows: DataFrame, key: str, seed: int | str = 0, name: str = "ordinal") -> DataFrame:
    """`rows` with the place of their key in the permutation, from 1, without ordering all rows in one task.

    Keys are counted by the first three digits of their place; 4096 running sums and a window inside each of
    these buckets give the ordinal. Rows with equal keys share one.
    """
    keys = rows.select(key).distinct().withColumn("_place", hash_place(F.col(key), seed)).withColumn("_bucket", F.substring("_place", 1, 3))
    counts = keys.groupBy("_bucket").agg(F.count("*").alias("_m"))
    below = counts.select("_bucket", (F.sum("_m").over(Window.orderBy("_bucket")) - F.col("_m")).alias("_below"))  # 4096 rows
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_place", key))
    placed = keys.withColumn("_inside", inside).join(F.broadcast(below), "_bucket").select(key, (F.col("_below") + F.col("_inside")).alias(name))
    return rows.join(placed, key)


def split(rows: DataFrame, key: str, sizes: dict[str, int], seed: int | str = 0) -> DataFrame:
    """The keys of the first places, dealt to the named splits in order; more keys than sizes leave the rest out."""
    total = sum(sizes.values())
    dealt = permuted(rows.select(key).distinct(), key, seed).where(F.col("ordinal") <= total)
    name, upto = F.lit(None).cast("string"), 0
    for label, size in sizes.items():
        name = F.when((F.col("ordinal") > upto) & (F.col("ordinal") <= upto + size), label).otherwise(name)
        upto += size
    return dealt.select(key, name.alias("split"))


def nested_subset(rows: DataFrame, key: str, fraction: float, seed: int | str = 0) -> DataFrame:
    """All rows of the first round-half-up(keys * fraction) keys, at least one; a smaller fraction gives a part of a larger one."""
    if not 0 < fraction <= 1:
        raise ValueError(f"fraction {fraction} lies outside (0, 1]")
    size = rows.agg(F.greatest(F.lit(1), F.floor(F.countDistinct(key) * F.lit(fraction) + 0.5)).alias("_k"))
    chosen = permuted(rows.select(key).distinct(), key, seed).join(F.broadcast(size)).where(F.col("ordinal") <= F.col("_k"))
    return rows.join(chosen.select(key), key, "left_semi")


def deal(rows: DataFrame, key: str, sizes: list[int], seed: int | str = 0) -> DataFrame:
    """(key, block) of disjoint blocks of the given sizes, from 0; too few distinct keys are refused when the rows are read."""
    distinct = rows.agg(F.countDistinct(key).alias("_n"))
    said = F.concat(F.lit(f"the blocks need {sum(sizes)} keys, there are "), F.col("_n").cast("string"))
    enough = F.when(F.col("_n") >= sum(sizes), True).otherwise(F.raise_error(said).cast("boolean"))
    rows = rows.join(F.broadcast(distinct)).where(enough).select(rows.columns)  # one row
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    dealt = permuted(rows.select(key).distinct(), key, seed).where(F.col("ordinal") <= sum(sizes))
    block = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("ordinal")))
    return dealt.select(key, block.alias("block"))


def ordinals(rows: DataFrame, order: str, name: str = "_ordinal") -> DataFrame:
    """`rows` numbered from 0 by a unique numeric key: counts over 4096 key ranges, then a window inside each."""
    ends = rows.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    spread = rows.join(F.broadcast(ends))
    width = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / 4096))
    spread = spread.withColumn("_range", F.floor((F.col(order) - F.col("_lo")) / width)).drop("_lo", "_hi")
    counts = spread.groupBy("_range").agg(F.count("*").alias("_m"))
    below = counts.select("_range", (F.sum("_m").over(Window.orderBy("_range")) - F.col("_m")).alias("_below"))  # 4097 rows at most
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return spread.withColumn("_inside", inside).join(F.broadcast(below), "_range").withColumn(name, F.col("_below") + F.col("_inside")).drop("_range", "_inside", "_below")


def strided(rows: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at even distance: every max(1, size // n)-th in order, the first n of these."""
    size = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") / n)).cast("bigint").alias("_step"))
    numbered = ordinals(rows, order).join(F.broadcast(size))
    kept = numbered.where((F.col("_ordinal") % F.col("_step") == 0) & (F.col("_ordinal") < F.col("_step") * n))
    return kept.select(rows.columns)


def evenly(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The rows at the ordinals floor(i * size / n)."""
    size = rows.agg(F.count("*").alias("_size"))
    numbered = ordinals(rows, order).join(F.broadcast(size))
    # The largest i whose ordinal doesn't lie beyond this row, tried against the row itself.
    i = F.floor(((F.col("_ordinal") + 1) * n - 1) / F.col("_size"))
    kept = numbered.where((F.floor(i * F.col("_size") / n) == F.col("_ordinal")) & (i < n))
    return kept.select(rows.columns)


def epoch_order(slots: DataFrame, slot: str, items: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """(slot, epoch, place, key): the item each slot takes when every pass goes through all items in an order of its own.

    The order of a pass is by the hash of seed plus pass and key. Slots are taken by their place in the pass, items
    by theirs, which is counted for the passes that occur; passes x items rows, as many as the slots they fill.
    """
    n = items.select(key).distinct().agg(F.count("*").alias("_n"))
    placed = slots.join(F.broadcast(n)).where("_n > 0").select(slot, F.floor(F.col(slot) / F.col("_n")).alias("epoch"), F.pmod(F.col(slot), F.col("_n")).alias("place"))  # n is one row
    last = placed.agg(F.min("epoch").alias("_from"), F.max("epoch").alias("_to"))
    passes = items.select(key).distinct().join(F.broadcast(last)).where("_to is not null").select(key, F.explode(F.sequence("_from", "_to")).alias("epoch"))
    hashed = passes.withColumn("_hash", F.md5(F.concat_ws(":", (F.col("epoch") + seed).cast("string"), F.col(key).cast("string")).cast("binary"))).withColumn("_bucket", F.substring("_hash", 1, 3))
    counts = hashed.groupBy("epoch", "_bucket").agg(F.count("*").alias("_m"))
    below = counts.select("epoch", "_bucket", (F.sum("_m").over(Window.partitionBy("epoch").orderBy("_bucket")) - F.col("_m")).alias("_below"))  # 4096 rows a pass
    inside = F.row_number().over(Window.partitionBy("epoch", "_bucket").orderBy("_hash", key)) - 1
    ordered = hashed.withColumn("_inside", inside).join(below, ["epoch", "_bucket"]).select("epoch", (F.col("_below") + F.col("_inside")).alias("place"), key)
    return placed.join(ordered, ["epoch", "place"]).select(slot, "epoch", "place", key)


def epochal(slots: DataFrame, slot: str, size: int) -> DataFrame:
    """(slot, epoch, place): which pass over `size` items a slot belongs to, and its place in that pass."""
    return slots.select("*", F.floor(F.col(slot) / size).alias("epoch"), F.pmod(F.col(slot), F.lit(size)).alias("place"))
