"""The run log as a stream: arrivals are appended once, and requests are counted in windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.sources.readers import RUN_LOG

KEY = ["config_fingerprint", "task_id", "seed"]


def append_once(target: str):
    """A foreachBatch function that appends a micro-batch below its own number, overwritten if it is repeated after a failure."""

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return take


def logged(rows: DataFrame, ended: Column) -> DataFrame:
    """The rows that go to the log; a cell that failed stays out of it and so is pending again."""
    return rows.where(F.coalesce(ended, F.lit(False)))


def resume(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = RUN_LOG, key: list[str] | None = None) -> None:
    """Take everything that has arrived in `source` since the last call, each cell once, then stop.

    Which cells were taken is the stream's own state, kept beside the checkpoint and partitioned by key, so a
    micro-batch looks up its own rows and never reads the sink. The state lives on disk (RocksDB) and grows by a
    key a cell; a source whose repeats come within bounded time takes `first_within` instead.
    """
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 128).json(source).dropDuplicates(key or KEY)
        query = stream.writeStream.foreachBatch(append_once(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


def first_within(stream: DataFrame, at: str, key: list[str], delay: str = "10 minutes") -> DataFrame:
    """A stream without repeated keys, for sources whose repeats come within `delay`; state is bounded by it."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def window_counts(rows: DataFrame, at: str, length: str = "60 seconds", slide: str | None = None, delay: str = "1 minute") -> DataFrame:
    """(start, end, n): requests in windows, over a table or a stream."""
    windows = F.window(at, length, slide) if slide else F.window(at, length)
    marked = rows.withWatermark(at, delay) if rows.isStreaming else rows
    return marked.groupBy(windows.alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")


def in_last_minute(rows: DataFrame, by: list[str], at: str, seconds: int = 60, block: int = 3600) -> DataFrame:
    """`rows` with the number of requests of their group in the `seconds` up to and with their own; exactly `seconds` old ones no longer count.

    A group is cut into blocks of time, and the last `seconds` of a block are shown to the next one too, so a
    group with most of the rows is many tasks' work. Rows without a time have no count.
    """
    if block < seconds:
        raise ValueError("a block must be at least as long as the window")
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    own, span = F.floor(micros / (block * 1_000_000)), (seconds * 1_000_000) - 1
    next_too = F.pmod(micros, F.lit(block * 1_000_000)) >= block * 1_000_000 - span
    shown = rows.withColumn("_micros", micros).withColumn("_own", own).withColumn("_block", F.explode(F.when(next_too, F.array(own, own + 1)).otherwise(F.array(own))))
    frame = Window.partitionBy(*by, "_block").orderBy("_micros").rangeBetween(-span, 0)
    counted = shown.withColumn("n_window", F.when(F.col("_micros").isNotNull(), F.count("_micros").over(frame)))
    return counted.where(F.col("_block").eqNullSafe(F.col("_own"))).select(*rows.columns, "n_window")


def daily(rows: DataFrame, by: list[str], at: str, cap: int) -> DataFrame:
    """(by, day, n, over): requests a UTC day, and how many were over the cap."""
    agg = rows.groupBy(*by, F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    return agg.withColumn("over", F.greatest(F.lit(0), F.col("n") - cap))


def progress(log: DataFrame, by: list[str], first_seeds: int) -> DataFrame:
    """(by, done): distinct cells whose repetition is among the first ones."""
    cells = log.where(F.col("seed") < first_seeds).select(*by, "task_id", "seed").distinct()
    return cells.groupBy(*by).agg(F.count("*").alias("done"))


def incomplete_first(progress_: DataFrame, order: str, wanted: int) -> DataFrame:
    """The cells to run next: up to the first that isn't complete."""
    upto = progress_.where(F.col("done") < wanted).agg(F.min(order).alias("_stop"))
    return progress_.join(F.broadcast(upto)).where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def utc_day(ts: Column) -> Column:
    return F.to_date(F.timestamp_seconds(ts))
