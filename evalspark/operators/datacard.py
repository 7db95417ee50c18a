"""The data card of a set of episodes: counts, use of tools, errors, lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import whole_number
from evalspark.operators import stats, turns


def successful(episodes: DataFrame) -> DataFrame:
    return episodes.where(F.col("reward") == F.lit(1.0))


def episodes_per_task(episodes: DataFrame) -> DataFrame:
    """(n_episodes, n_tasks): how many tasks have how many episodes."""
    per = episodes.groupBy(whole_number(F.col("task_id")).alias("task")).agg(F.count("*").alias("n_episodes"))
    return per.where("task is not null").groupBy("n_episodes").agg(F.count("*").alias("n_tasks"))


def by_temperature(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("temperature").agg(F.count("*").alias("n"))


def without_success(tasks: DataFrame, episodes: DataFrame) -> DataFrame:
    """(task) of the tasks none of whose episodes won."""
    known = tasks.select(whole_number(F.col("task_id")).alias("task")).where("task is not null").distinct()
    return known.join(successful(episodes).select(whole_number(F.col("task_id")).alias("task")), "task", "left_anti")


def decision_counts(episodes: DataFrame) -> DataFrame:
    """One row: decisions, calls, replies, turns with several calls."""
    steps = turns.decisions(episodes)
    return steps.agg(F.count("*").alias("n_decisions"), F.count_if(F.col("kind") == "tool_call").alias("n_calls"), F.count_if(F.col("kind") == "reply").alias("n_replies"), F.count_if(F.size("names") > 1).alias("n_parallel"))


def tool_use(episodes: DataFrame, native: DataFrame) -> DataFrame:
    """(name, n, is_native) of every native tool, called or not, and every other tool that was called."""
    used = turns.decisions(episodes).select(F.explode("names").alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    return native.select("name", F.lit(True).alias("is_native")).join(used, "name", "full_outer").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("is_native", F.lit(False)).alias("is_native"))


def tool_results(episodes: DataFrame) -> DataFrame:
    """One row: tool results, errors among them, and their lengths."""
    rows = turns.messages(episodes).where("role = 'tool'").select((F.lower("error") == "true").alias("bad"), F.length(F.coalesce("content", F.lit(""))).alias("chars"))
    return rows.agg(F.count("*").alias("n_results"), F.count_if("bad").alias("n_errors"), F.sum("chars").alias("chars"), F.max("chars").alias("longest"))


def sizes(rows: DataFrame, by: str, tokens: str) -> DataFrame:
    """(by, n, mean, p50, p95, max, over_<limit>): mean at 1 place, shares over the limits at 3."""
    found = stats.length_summary(rows, [by], tokens)
    over = [c for c in found.columns if c.startswith("over_")]
    return found.select(by, "n", F.round("mean", 1).alias("mean"), "p50", "p95", "max", *(F.round(c, 3).alias(c) for c in over))
