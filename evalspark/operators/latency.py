"""Latency levels and their spread over repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def levels(requests: DataFrame, by: list[str], latency: str, ok: str, wall: str | None = None) -> DataFrame:
    """(by, requests, errors, p50, p95, p99, mean[, per_second]) of the requests that succeeded."""
    good = F.when(F.col(ok), F.col(latency))
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by case when `{ok}` then `{latency}` end)")
    counted = [F.count("*").alias("requests"), F.count_if(~F.col(ok)).alias("errors"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.avg(good).alias("mean")]
    if wall is not None:
        counted.append(F.try_divide(F.count_if(F.col(ok)).cast("double"), F.max(wall).cast("double")).alias("per_second"))
    return requests.groupBy(*by).agg(*counted)


def across_repeats(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, mean, sd) over repeats of every metric; nulls don't count, one value has no sd."""
    stacked = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select(*by, "x.*")
    return stacked.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def served_levels(requests: DataFrame, by: list[str], latency: str, first: str, tokens: str, ok: str, wall: str) -> DataFrame:
    """(by, requests, errors, p50, p99, ttft_p50, ttft_p99, per_second, tokens_per_second) of a load level.

    Percentiles are over the requests that succeeded; a request without any text has no time to first token and
    doesn't count there. The level's wall time is the largest of its rows'.
    """
    good = F.col(ok)
    at = lambda q, c: F.expr(f"percentile_disc({q}) within group (order by case when `{ok}` then `{c}` end)")
    per_wall = lambda c: F.try_divide(c.cast("double"), F.max(wall).cast("double"))
    return requests.groupBy(*by).agg(
        F.count("*").alias("requests"), F.count_if(~good).alias("errors"), at(0.5, latency).alias("p50"), at(0.99, latency).alias("p99"), at(0.5, first).alias("ttft_p50"), at(0.99, first).alias("ttft_p99"),
        F.round(per_wall(F.count_if(good)), 3).alias("per_second"), F.round(per_wall(F.sum(F.when(good, F.col(tokens)))), 1).alias("tokens_per_second"),
    )


def streamed(chunks: DataFrame, request: str, at: str, text: str, usage: str) -> DataFrame:
    """(request, ttft, latency, completion_tokens, n_chunks) of captured streams.

    ttft is when the first chunk with text came, null if none did; tokens are what the last chunk with a usage
    says. A stream without one is an error.
    """
    agg = chunks.groupBy(request).agg(F.min(F.when(F.col(text) != "", F.col(at))).alias("ttft"), F.max(at).alias("latency"), F.max_by(usage, F.when(F.col(usage).isNotNull(), F.col(at))).alias("_usage"), F.count("*").alias("n_chunks"))
    said = F.concat(F.lit("no usage in the stream of "), F.col(request).cast("string"))
    tokens = F.coalesce(F.col("_usage").cast("int"), F.raise_error(said).cast("int"))
    return agg.select(request, "ttft", "latency", tokens.alias("completion_tokens"), "n_chunks")


def modelled(text: Column) -> Column:
    """A stand-in latency: 1 ms and one more for each 1000 characters."""
    return 1 + F.length(text) / 1000
