"""Splits that keep related records together.

Tasks are vertices; a task is linked to the smallest task of each user it is registered for (a star, never the
pairs of a user's tasks) and to the task it was derived from. Components come from random-mate contraction: in
each round every vertex tosses a coin, each vertex that shows tails and has a neighbour that shows heads is
merged into the smallest such neighbour, edges follow, and those inside a merged vertex vanish. When no edges
are left the merges are unwound. Each round's table is written to the
shared folder, so lineage stays one round long and nothing of the graph is on the driver but its edge count.

Components are then dealt to splits by the running sum of their weights.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.joins import on_groups
from evalspark.functions.text import folded, strip, whole_number
from evalspark.operators.sampling import hash_place
from evalspark.shared import counted, written

# What a user_id says when no user is known.
NO_USER = ["", "?", "-", "--", "n/a", "na", "nan", "none", "null", "nil", "unknown", "undefined", "anonymous", "no user", "not known"]
# More rounds together are fewer jobs, but compute their merges again.
MAX_ROUNDS, TOGETHER = 200, 1
EDGE, MERGE = 0, 1


def known_user(column: Column) -> Column:
    user = folded(column)
    return F.when(~user.isin(NO_USER), user)


def task_links(tasks: DataFrame) -> DataFrame:
    """(a, b) with a < b: tasks that must stay together, as stars around the smallest task of a user."""
    rows = tasks.select(whole_number(F.col("task_id")).alias("task"), known_user(F.col("user_id")).alias("user"), whole_number(F.col("derived_from")).alias("origin"))
    rows = rows.where("task is not null")
    by_user = rows.where("user is not null").select("user", "task").distinct()
    hubs = by_user.groupBy("user").agg(F.min("task").alias("hub"))
    stars = on_groups(by_user, hubs, ["user"]).select(F.col("hub").alias("a"), F.col("task").alias("b"))
    known = rows.select(F.col("task").alias("origin")).distinct()
    derived = rows.where("origin is not null").select("task", "origin").distinct().join(known, "origin", "left_semi")
    derived = derived.select(F.least("task", "origin").alias("a"), F.greatest("task", "origin").alias("b"))
    return stars.unionByName(derived).where("a < b").distinct()


def heads(vertex: Column, round_: int) -> Column:
    return F.xxhash64(vertex, F.lit(round_)) % 2 == 0


def contracted(edges: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
    """((a, b) of the edges that are left after a round, (v, into) of who was merged into whom)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tails = both.where(~heads(F.col("a"), round_) & heads(F.col("b"), round_))
    mates = tails.groupBy("a").agg(F.min("b").alias("into"))
    # Null-safe keys need exchanges of their own, so the edges of one giant vertex are split over tasks.
    left = on_groups(edges, mates.withColumnRenamed("into", "into_a"), ["a"], "left")
    left = on_groups(left, mates.withColumnsRenamed({"a": "b", "into": "into_b"}), ["b"], "left")
    a, b = F.coalesce("into_a", "a"), F.coalesce("into_b", "b")
    moved = left.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    return moved, mates.select(F.col("a").alias("v"), "into")


def components(links: DataFrame) -> DataFrame:
    """(v, component) of every vertex that has a link; component is the smallest vertex it is connected with.

    TOGETHER rounds are one job: it writes the edges that are left and the merges as one table, and the write
    counts the edges. As a vertex is merged once only, all merges together are a forest, which is unwound by following two
    steps at once: as many joins as the rounds have binary digits.
    """
    edges, count = counted(links.select(F.lit(EDGE).alias("kind"), "a", "b"), "links", F.col("kind") == EDGE)
    merges: list[DataFrame] = []
    for round_ in range(0, MAX_ROUNDS, TOGETHER):
        if count == 0:
            break
        left, merged = edges.where(F.col("kind") == EDGE).select("a", "b"), []
        for step in range(TOGETHER):
            left, mates = contracted(left, round_ + step)
            merged.append(mates.select(F.lit(MERGE).alias("kind"), F.col("v").alias("a"), F.col("into").alias("b")))
        rows = functools.reduce(DataFrame.unionByName, merged, left.select(F.lit(EDGE).alias("kind"), "a", "b"))
        edges, count = counted(rows, "contracted", F.col("kind") == EDGE)
        merges.append(edges.where(F.col("kind") == MERGE).select(F.col("a").alias("v"), F.col("b").alias("into")))
    else:
        raise RuntimeError("edges are left after all rounds")
    if not merges:
        return links.select(F.col("a").alias("v"), F.col("b").alias("component")).limit(0)
    root = functools.reduce(DataFrame.unionByName, merges)
    for _ in range((TOGETHER * len(merges)).bit_length()):
        above = root.select(F.col("v").alias("into"), F.col("into").alias("top"))
        root = written(on_groups(root, above, ["into"], "left").select("v", F.coalesce("top", "into").alias("into")), "roots")
    whole = root.withColumnRenamed("into", "root")
    whole = whole.unionByName(whole.select(F.col("root").alias("v"), "root").distinct())
    smallest = whole.groupBy("root").agg(F.min("v").alias("component"))
    return on_groups(whole, smallest, ["root"]).select("v", "component")


def task_weights(tasks: DataFrame, episodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(task_no, n_episodes, n_steps) of every task number in any of the tables. Ids that are no number are left out."""
    none = F.lit(0).cast("bigint")
    known = tasks.select(whole_number(F.col("task_id")).alias("task_no"), none.alias("e"), none.alias("s")).distinct()
    played = episodes.groupBy(whole_number(F.col("task_id")).alias("task_no")).agg(F.count("*").alias("e")).withColumn("s", none)
    of_step = whole_number(F.regexp_extract(strip(F.col("step_id")), r"^([^:]*):", 1))
    stepped = steps.groupBy(of_step.alias("task_no")).agg(F.count("*").alias("s")).withColumn("e", none)
    every = known.unionByName(played).unionByName(stepped).where("task_no is not null")
    return every.groupBy("task_no").agg(F.sum("e").alias("n_episodes"), F.sum("s").alias("n_steps"))


def groups(tasks: DataFrame, episodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(task_no, group_no, n_episodes, n_steps); a task without links is a group of its own.

    Null, blank and non-numeric task ids belong to no task; a derived_from that tasks doesn't know and a
    user_id that names nobody link nothing; empty tables give no rows.
    """
    found = components(task_links(tasks)).withColumnRenamed("v", "task_no")
    joined = task_weights(tasks, episodes, steps).join(found, "task_no", "left")
    return joined.select("task_no", F.coalesce("component", "task_no").alias("group_no"), "n_episodes", "n_steps")


def assign(grouped: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """`grouped` with split_name: groups in hash order, each put where the middle of its weight falls.

    A group weighs its episodes and steps, at least 1. The running sum is taken over 4096 hash buckets
    first and inside each bucket then, so no task orders all groups. Shares need not add up to 1.
    """
    weight = F.greatest(F.sum(F.col("n_episodes") + F.col("n_steps")), F.lit(1))
    by_group = grouped.groupBy("group_no").agg(weight.alias("weight"))
    by_group = by_group.withColumn("place", hash_place(F.col("group_no"), seed)).withColumn("bucket", F.substring("place", 1, 3))
    sums = by_group.groupBy("bucket").agg(F.sum("weight").alias("bucket_weight"))
    one = Window.partitionBy(F.lit(1))
    running = F.sum("bucket_weight").over(one.orderBy("bucket"))
    sums = sums.select("bucket", (running - F.col("bucket_weight")).alias("below"), F.sum("bucket_weight").over(one).alias("total"))
    inside = F.sum("weight").over(Window.partitionBy("bucket").orderBy("place", "group_no"))
    middle = (F.col("below") + inside - F.col("weight") / 2) / F.col("total")
    placed = by_group.join(F.broadcast(sums), "bucket").select("group_no", middle.alias("middle"))
    # Few rows by nature: one for each split.
    ends = targets.where("share > 0").select("split_name", (F.sum("share").over(one.orderBy(F.col("share").desc(), "split_name")) / F.sum("share").over(one)).alias("end"), (F.col("share") / F.sum("share").over(one)).alias("part"))
    ends = ends.select(F.array_sort(F.collect_list(F.struct("end", "split_name")).over(one)).alias("ends")).limit(1)
    chosen = placed.join(F.broadcast(ends)).select("group_no", F.coalesce(F.filter("ends", lambda x: x["end"] > F.col("middle"))[0]["split_name"], F.element_at("ends", -1)["split_name"]).alias("split_name"))
    return on_groups(grouped, chosen, ["group_no"])


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a split: target and actual share of the records, and the counts."""
    given = assigned.groupBy("split_name").agg(F.countDistinct("group_no").alias("n_groups"), F.count("*").alias("n_tasks"), F.sum("n_episodes").alias("n_episodes"), F.sum("n_steps").alias("n_steps"))
    joined = targets.join(given, "split_name", "left").na.fill(0)
    one = Window.partitionBy(F.lit(1))
    records = F.col("n_episodes") + F.col("n_steps")
    return joined.select("split_name", F.col("share").alias("target_share"), (records / F.sum(records).over(one)).alias("actual_share"), "n_groups", "n_tasks", "n_episodes", "n_steps")
