"""Two runs of the same steps: pairing, agreement of texts, paired differences with a bootstrap interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.invariants import require
from evalspark.operators.scoring import BUCKETS, CALL, REPLY
from evalspark.operators.steps import places


def pairing(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One row: n_both, only_in_base, only_in_new of the distinct keys. A comparison is paired if the last two are 0."""
    a, b = base.select(*key).distinct().withColumn("in_base", F.lit(1)), new.select(*key).distinct().withColumn("in_new", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("in_base").isNotNull() & F.col("in_new").isNotNull()).alias("n_both"), F.count_if(F.col("in_new").isNull()).alias("only_in_base"), F.count_if(F.col("in_base").isNull()).alias("only_in_new"))


def same_texts(first: DataFrame, second: DataFrame, key: str, text: str) -> DataFrame:
    """One row: keys in both, in either only, and how many texts are the same when stripped; passes from 95 % on."""
    from evalspark.functions.text import strip

    a = first.select(key, strip(F.col(text)).alias("a"), F.lit(True).alias("ia"))
    b = second.select(key, strip(F.col(text)).alias("b"), F.lit(True).alias("ib"))
    both = F.col("ia").isNotNull() & F.col("ib").isNotNull()
    agg = a.join(b, key, "full_outer").agg(F.count_if(both).alias("n_common"), F.count_if(F.col("ib").isNull()).alias("only_in_first"), F.count_if(F.col("ia").isNull()).alias("only_in_second"), F.count_if(both & F.col("a").eqNullSafe(F.col("b"))).alias("n_same"))
    return agg.withColumn("passes", F.try_divide(F.col("n_same").cast("double"), F.col("n_common").cast("double")) >= 0.95)


def rate_rows(bucket: str = "bucket") -> Column:
    """An array of (rate, counted, hit), one for each rate a step may count for."""
    call, reply = F.col("reference_kind") == CALL, F.col("reference_kind") == REPLY
    is_ = lambda name: F.coalesce(F.col(bucket) == name, F.lit(False))
    rates = [("step_agreement", call, F.col("normalized_match")), ("tool_name", call, F.col("name_match")), ("reply_as_reply", reply, F.col("kind_match")), ("call_as_call", call, F.coalesce(F.col("predicted_kind") == CALL, F.lit(False)))]
    rates += [(b, call, is_(b)) for b in BUCKETS] + [("call_instead_of_reply", reply, is_("call_instead_of_reply")), ("malformed_output", F.lit(True), is_("malformed_output"))]
    return F.array(*(F.struct(F.lit(n).alias("rate"), c.cast("int").alias("counted"), (c & h).cast("int").alias("hit")) for n, c, h in rates))


def episode_sums(base: DataFrame, new: DataFrame, episode: list[str], step: str) -> DataFrame:
    """(episode, rate, den, base_hits, new_hits) of steps in both runs; the input rows are scored and classified."""
    a = base.select(*episode, step, F.explode(rate_rows()).alias("r")).select(*episode, step, "r.rate", "r.counted", F.col("r.hit").alias("base_hit"))
    b = new.select(*episode, step, F.explode(rate_rows()).alias("r")).select(*episode, step, "r.rate", F.col("r.hit").alias("new_hit"))
    joined = a.join(b, [*episode, step, "rate"])
    return joined.groupBy(*episode, "rate").agg(F.sum("counted").alias("den"), F.sum("base_hit").alias("base_hits"), F.sum("new_hit").alias("new_hits"))


def drawn(resample: Column, slot: Column, n: Column) -> Column:
    """Which of n episodes a resample draws for a slot: a number from a hash, the same for every rate and engine."""
    text = F.md5(F.concat_ws(":", resample.cast("string"), slot.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint"), n)


def paired_bootstrap(sums: DataFrame, episode: list[str], resamples: int = 2000) -> DataFrame:
    """(rate, n_steps, base, new, delta, ci95_low, ci95_high) of per-episode sums.

    Episodes are numbered in key order, range by range; resample r draws episode `drawn(r, slot)` for each slot. All
    rates of an episode stand in one row, and what a task's draws add up to is summed by resample before it is
    exchanged, so the aggregate has `resamples` rows a task. Resamples without steps are left out; the interval
    ends at the ranks floor(0.025 m) and floor(0.975 m) - 1, from 0. The method is for tables of episodes, whose
    number times the resamples is the size of the draws.
    """
    spark = sums.sparkSession
    rates = [r.rate for r in sums.select("rate").distinct().orderBy("rate").collect()]  # the fixed rates of `rate_rows`
    if not rates:
        return spark.createDataFrame([], "rate string, n_steps bigint, base double, new double, delta double, ci95_low double, ci95_high double")
    at = lambda rate, c: F.sum(F.when(F.col("rate") == rate, c))
    gain = F.col("new_hits") - F.col("base_hits")
    wide = sums.groupBy(*episode).agg(*(f(r, c).alias(f"{n}{i}") for i, r in enumerate(rates) for n, f, c in (("d", at, F.col("den")), ("g", at, gain))))
    numbered = places(wide.withColumn("_key", F.struct(*episode)), {"_place": "_key"}).withColumn("e", F.col("_place") - 1)
    n = wide.agg(F.count("*").alias("n"))
    # Slots are dealt to tasks, not resamples: there are enough of either.
    sized = spark.range(0, resamples, 1, max(8, spark.sparkContext.defaultParallelism)).withColumnRenamed("id", "r").join(F.broadcast(n)).where("n > 0")  # n is one row
    draws = sized.select("r", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("slot")).select("r", drawn(F.col("r"), F.col("slot"), F.col("n")).alias("e"))
    fields = [f"{x}{i}" for i in range(len(rates)) for x in "dg"]
    # The draws look small to the planner and aren't; without the hint it would broadcast them.
    met = draws.join(numbered.select("e", *fields).hint("shuffle_hash"), "e")
    per = met.groupBy("r").agg(*(F.sum(f).alias(f) for f in fields))
    stacked = per.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), F.col(f"d{i}").alias("den"), F.col(f"g{i}").alias("gain")) for i, r in enumerate(rates)))).alias("x")).select("x.*").where("den > 0")
    deltas = stacked.groupBy("rate").agg(F.array_sort(F.collect_list(F.col("gain").cast("double") / F.col("den"))).alias("deltas"))  # `resamples` numbers a rate
    m = F.size("deltas")
    ends = deltas.select("rate", F.get("deltas", F.floor(0.025 * m).cast("int")).alias("ci95_low"), F.get("deltas", (F.floor(0.975 * m) - 1).cast("int")).alias("ci95_high"))
    whole = sums.groupBy("rate").agg(F.sum("den").alias("n_steps"), F.sum("base_hits").alias("b"), F.sum("new_hits").alias("w")).where("n_steps > 0")
    joined = whole.join(ends, "rate", "left")
    ratio = lambda c: c.cast("double") / F.col("n_steps")
    return joined.select("rate", "n_steps", ratio(F.col("b")).alias("base"), ratio(F.col("w")).alias("new"), ratio(F.col("w") - F.col("b")).alias("delta"), "ci95_low", "ci95_high")


def step_sequences(base: DataFrame, new: DataFrame, episode: list[str], step: str, index: str) -> DataFrame:
    """One row: n_same, n_differ of the episodes in both runs, by whether they hold the same steps in the same order."""
    steps = lambda df, name: df.groupBy(*episode).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, step))), lambda s: s[step]).alias(name))
    same = F.col("_a") == F.col("_b")
    return steps(base, "_a").join(steps(new, "_b"), episode).agg(F.count_if(same).alias("n_same"), F.count_if(~same).alias("n_differ"))


def chosen_runs(rows: DataFrame, label: str, wanted: list[str]) -> DataFrame:
    """The rows of the wanted labels; a label without rows is an error."""
    missing = rows.sparkSession.createDataFrame([(w,) for w in wanted], f"{label} string").join(rows.select(label), label, "left_anti")
    require(missing, "every run that is compared has results")
    return rows.where(F.col(label).isin(*wanted))


def base_of(labels: DataFrame, wanted: str, other: str, by: list[str]) -> DataFrame:
    """(by, base): the wanted label where a group has it, else the other, else null."""
    has = lambda label: F.max(F.when(F.col("label") == label, F.col("label")))
    return labels.groupBy(*by).agg(F.coalesce(has(wanted), has(other)).alias("base"))


def gate(rates: DataFrame, by: list[str], one: str, two: str, least: float = 0.15) -> DataFrame:
    """(by, delta, verdict): whether label `two` beats `one` by at least `least` in the difference rounded to 4 places; incomplete if one is missing."""
    at = lambda label: F.max(F.when(F.col("label") == label, F.col("rate")))
    delta = F.bround(F.col("b") - F.col("a"), 4)
    agg = rates.groupBy(*by).agg(at(one).alias("a"), at(two).alias("b"))
    return agg.select(*by, delta.alias("delta"), F.when(delta.isNull(), "incomplete").when(delta >= least, "pass").otherwise("fail").alias("verdict"))
