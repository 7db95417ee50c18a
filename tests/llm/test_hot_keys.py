"""Joins on a key that half of the rows share are split over tasks, also where the other side is an aggregate."""

import re

import pytest

pytest.importorskip("evalspark.llm")

from pyspark.sql import functions as F  # noqa: E402

from evalspark.functions.joins import on_groups  # noqa: E402

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df):
    rows = df.collect()
    return len(rows), df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n=60_000):
    return spark.range(0, n, 1, 6).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 5_000).alias("key"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))


def test_an_aggregate_joined_back_is_split(small_partitions):
    rows = hot(small_partitions)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    n, plan = plan_of(on_groups(rows, sizes, ["key"]))
    assert n == 60_000 and re.search(r"skew=true", plan)


def test_groups_of_a_giant_component_are_split(small_partitions):
    from evalspark.llm import splits

    rows = hot(small_partitions).select(F.col("id").alias("task_no"), F.col("key").alias("group_no"), F.lit(1).alias("n_episodes"), F.lit(0).alias("n_steps"), "text")
    targets = small_partitions.createDataFrame([("train", 0.6), ("test", 0.4)], "split_name string, share double")
    n, plan = plan_of(splits.assign(rows, targets))
    assert n == 60_000 and re.search(r"skew=true", plan)


def test_a_text_stored_very_often_is_split(small_partitions):
    times = hot(small_partitions).groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    n, plan = plan_of(on_groups(hot(small_partitions), times, ["key"], "left"))
    assert n == 60_000 and re.search(r"skew=true", plan)
