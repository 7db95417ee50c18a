"""Success statistics: pass^k, t-intervals, percentiles, rates of repeated trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.joins import on_groups
from evalspark.functions.running import running_totals
from evalspark.functions.text import folded

# Two-sided 95 % quantiles of Student's t by degrees of freedom; 2.042 holds for 11 to 30, 1.96 above.
T95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228}
T95_TO_30, T95_ABOVE = 2.042, 1.96
DEFAULT_SIMULATOR = "v1"


def t95(degrees: Column) -> Column:
    """The quantile; null below one degree of freedom."""
    found = F.when(degrees > 30, F.lit(T95_ABOVE)).when(degrees > 10, F.lit(T95_TO_30))
    for df, value in T95.items():
        found = found.when(degrees == df, F.lit(value))
    return found


def mean_ci(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, ci95_low, ci95_high); the interval is null for one value, nulls are no values."""
    agg = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = t95(F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    return agg.select(*by, "n", "mean", (F.col("mean") - half).alias("ci95_low"), (F.col("mean") + half).alias("ci95_high"))


def pass_ratio(successes: Column, trials: Column, k: int) -> Column:
    """C(c, k) / C(n, k) as a product of k quotients: 0 if c < k, null if n < k."""
    ratio = F.lit(1.0)
    for i in range(k):
        ratio = ratio * F.greatest(F.lit(0), successes - i) / F.greatest(F.lit(1), trials - i)
    return F.when(trials >= k, ratio)


def success_table(trials: DataFrame, by: list[str], task: str, seed: str, success: str, ks: int = 5) -> DataFrame:
    """One row a group of trials.

    complete: every task has as many trials as any other, and there are at least two seeds; only then are mean,
    interval and pass^k given. Per-seed rates are rounded to 4 places before they are averaged, pass^k is not.
    """
    tasks = trials.groupBy(*by, task).agg(F.count("*").alias("n"), F.sum(F.col(success).cast("int")).alias("c"))
    seeds = trials.groupBy(*by, seed).agg(F.bround(F.avg(F.col(success).cast("double")), 4).alias("rate"))
    passes = [F.avg(pass_ratio(F.col("c"), F.col("n"), k)).alias(f"pass_{k}") for k in range(1, ks + 1)]
    per_task = tasks.groupBy(*by).agg(
        F.count("*").alias("n_tasks"), F.sum("n").alias("n_trials"), F.sum("c").alias("n_successes"),
        (F.min("n") == F.max("n")).alias("equal"), F.min("n").alias("trials_each"),
        F.count_if(F.col("c") > 0).alias("solved_any"), F.count_if(F.col("c") == F.col("n")).alias("solved_every"), *passes,
    )
    per_seed = mean_ci(seeds, by, "rate").withColumnRenamed("n", "n_seeds")
    joined = on_groups(per_task, per_seed, by)
    complete = F.col("equal") & (F.col("n_seeds") >= 2)
    only = lambda c: F.when(complete, F.col(c)).alias(c)
    shown = [F.when(complete & (F.col("trials_each") >= k), F.col(f"pass_{k}")).alias(f"pass_{k}") for k in range(1, ks + 1)]
    return joined.select(*by, "n_tasks", "n_trials", "n_seeds", "n_successes", complete.alias("complete"), "solved_any", "solved_every", only("mean"), only("ci95_low"), only("ci95_high"), *shown)


def run_label(config_name: Column) -> Column:
    """The second part of a name with colons, else the whole name."""
    parts = F.split(config_name, ":")
    return F.when(F.size(parts) >= 2, parts[1]).otherwise(config_name)


def cell_of_file(name: Column) -> Column:
    """label, threshold and catalog that a file name holds (`free-<label>[-esc<t>]-c<n>.jsonl`); null for other names."""
    pattern = r"^free-(.+?)(?:-esc([0-9.]+))?-c(\d+)\.jsonl$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    fields = F.struct(part(1).alias("label"), part(2).try_cast("double").alias("threshold"), part(3).try_cast("int").alias("catalog"))
    return F.when(name.rlike(pattern), fields)


def free_rows(log: DataFrame) -> DataFrame:
    """One row a configuration and simulator of a log of free runs: rates of its episodes, smoke runs left out.

    A missing simulator is the first one; escalation_rate is a ratio of sums, null without student turns.
    identities tells how many fingerprints the cell mixes: it should be 1.
    """
    rows = log.where(~F.coalesce("smoke", F.lit(False)))
    rows = rows.withColumn("simulator", F.coalesce("simulator", F.lit(DEFAULT_SIMULATOR))).withColumn("label", run_label(F.col("config_name")))
    agg = rows.groupBy("label", "catalog", "simulator").agg(
        F.countDistinct(folded(F.col("config_fingerprint"))).alias("identities"), F.count("*").alias("n_episodes"),
        F.count_if(F.col("reward") == 1.0).alias("n_successes"), F.sum("escalated_turns").alias("escalated"), F.sum("student_turns").alias("turns"),
        F.count_if(F.coalesce("degenerate_user_turn", F.lit(False))).alias("degenerate_episodes"),
    )
    return agg.select("*", F.try_divide(F.col("escalated").cast("double"), F.col("turns").cast("double")).alias("escalation_rate"))


def rounded_rank(n: Column, q: float) -> Column:
    """The nearest rank with half-to-even rounding, at least 1 and at most n."""
    return F.greatest(F.lit(1), F.least(n, F.rint(F.lit(q / 100) * n).cast("bigint")))


def nearest_rank(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(by, a column for each q): the value at the half-to-even nearest rank; nulls are no values.

    Values are counted, then summed up in order by ranges, so no task orders a whole group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("m"))
    sizes = counts.groupBy(*by).agg(F.sum("m").alias("n"))
    running = on_groups(running_totals(counts, by, value, ["m"]), sizes, by)
    at = [F.min(F.when(F.col("m_upto") >= rounded_rank(F.col("n"), q), F.col(value))).alias(name) for name, q in qs.items()]
    return running.groupBy(*by).agg(*at)


def length_summary(df: DataFrame, by: list[str], value: str, limits: tuple[int, ...] = (2048, 4096, 8192, 12288, 16384)) -> DataFrame:
    """n, mean, p50, p95, max and the share over each limit."""
    agg = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), *(F.avg((F.col(value) > limit).cast("double")).alias(f"over_{limit}") for limit in limits))
    return on_groups(agg, nearest_rank(df, by, value, {"p50": 50, "p95": 95}), by, "left")


def token_counts(rows: DataFrame, text: str, counter=None, name: str = "tokens") -> DataFrame:
    """`rows` with the tokens of a text: by a column function if there is one that counts them, else estimated."""
    return rows.withColumn(name, counter(F.col(text)) if counter is not None else estimated_tokens(F.col(text)))


def identity_rows(log: DataFrame, fingerprint: Column | str) -> DataFrame:
    """Rows of one identity, or of all that begin with the given text, smoke runs left out."""
    begins = F.lit(fingerprint) if isinstance(fingerprint, str) else fingerprint
    return log.where(F.startswith(F.col("config_fingerprint"), begins) & ~F.coalesce("smoke", F.lit(False)))


def estimated_tokens(text: Column) -> Column:
    """Characters over 3.5, rounded half to even."""
    return F.rint(F.length(text) / F.lit(3.5)).cast("bigint")
