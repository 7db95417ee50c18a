"""Checks as queries: each gives the rows that break a rule, and `require` refuses them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.joins import on_groups


class InvariantViolation(Exception):
    """A rule that must hold doesn't."""


def require(broken: DataFrame, rule: str) -> None:
    """Raise with a few of the rows if there are any."""
    if rows := broken.take(5):
        raise InvariantViolation(f"{rule}: {rows}")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def leaked(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Keys in both splits."""
    return train.select(key).intersect(held_out.select(key)).where(F.col(key).isNotNull())


def stray(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Keys that aren't allowed; a null key is stray."""
    return rows.select(key).exceptAll(rows.select(key).join(allowed.select(key), key, "left_semi")).distinct()


def empty_sides(sides: dict[str, DataFrame]) -> DataFrame:
    """(rule, n): 1 for each side without a row; a check of disjoint splits says nothing about an empty one."""
    counted = [df.limit(1).agg(F.count("*").alias("_n")).select(F.lit(f"{name} is empty").alias("rule"), (1 - F.col("_n")).alias("n")) for name, df in sides.items()]
    return functools.reduce(DataFrame.unionByName, counted)


def complete_join(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """The inner join, in which a left row without partner is an error when the rows are read."""
    marked = right.withColumn("_there", F.lit(True))
    joined = left.join(marked, key, "left")
    said = F.concat(F.lit("no partner for "), F.to_json(F.struct(*key)))
    return joined.where(F.when(F.col("_there").isNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True))).drop("_there")


def wrong_greeting(messages: DataFrame, greeting: str) -> DataFrame:
    """Episodes whose message 0 isn't the greeting."""
    return messages.where((F.col("pos") == 0) & ~F.coalesce((F.col("role") == "assistant") & (F.col("content") == greeting), F.lit(False)))


def floating_alias(model: Column) -> Column:
    """Whether a model's name points to a moving version."""
    return F.lower(model).rlike("latest|preview")


def same_model(a: Column, b: Column) -> Column:
    """Whether two names are one model, whatever the provider's prefix."""
    bare = lambda c: F.regexp_replace(c, "^.*/", "")
    return bare(a) == bare(b)


def latest_identity(rows: DataFrame, file: str, line: str, identity: str) -> DataFrame:
    """All rows of the identity that a file's last line has."""
    last = rows.groupBy(file).agg(F.max_by(identity, line).alias("_last"))
    return on_groups(rows, last, [file]).where(F.col(identity).eqNullSafe(F.col("_last"))).drop("_last")


def empty_streaks(batches: DataFrame, by: list[str], order: str, size: str, least: int = 2) -> DataFrame:
    """(by, first, last, length) of runs of at least `least` batches without rows."""
    w = Window.partitionBy(*by).orderBy(order)
    ordered = batches.select(*by, order, F.col(size).alias("_size"), F.row_number().over(w).alias("_n"))
    runs = ordered.where("_size = 0").withColumn("_run", F.col("_n") - F.row_number().over(w))
    return runs.groupBy(*by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_run")


def pending(targets: DataFrame, variant: str, variants: list, done: DataFrame, key: list[str]) -> DataFrame:
    """Cells of targets and variants that aren't done. The variants are a run's few settings, a list of values."""
    return targets.select("*", F.explode(F.array(*map(F.lit, variants))).alias(variant)).join(done.select(*key).distinct(), key, "left_anti")


def latest_checkpoint(paths: DataFrame, by: list[str], path: str) -> DataFrame:
    """(by, path) with the largest number at the path's end."""
    number = F.regexp_extract(F.col(path), r"(\d+)/?$", 1).try_cast("bigint")
    return paths.where(number.isNotNull()).groupBy(*by).agg(F.max_by(path, number).alias(path))
