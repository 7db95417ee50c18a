"""Queries over run logs and events: success, intervals, rates, latency, sampling, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.text import folded, label, number_text, strip, whole_number
from evalspark.operators import compare, escalation, invariants, latency, pairs, reward, sampling, stats
from evalspark.plans.tables import table
from evalspark.sources import sinks
from evalspark.streaming import runlog

PLACES = 6


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles at 6 places, for comparison with another engine."""
    return df.withColumns({c: F.round(c, PLACES) for c in columns})


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five trials of every user and event type: trial s is won if any of the events with event_id = s (mod 5) is worth 20 or more."""
    won = lambda s: F.coalesce(F.max(F.when(F.col("event_id") % 5 == s, F.col("value") >= 20)), F.lit(False))
    users = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.array(*map(won, range(5))).alias("won"))
    return users.select("event_type", "user_id", F.posexplode("won").alias("seed", "ok"))


def success_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: users as tasks with five trials each over all events, grouped by event type."""
    found = stats.success_table(_trials(spark, sf_dir), ["event_type"], "user_id", "seed", "ok")
    return rounded(found, "mean", "ci95_low", "ci95_high", *(f"pass_{k}" for k in range(1, 6)))


def mean_ci_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.mean_ci(table(spark, sf_dir, "events"), ["user_id"], "value"), "mean", "ci95_low", "ci95_high")


def free_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.free_rows(table(spark, sf_dir, "free_log")), "escalation_rate")


def file_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What file names of free runs say, from names built of each configuration."""
    parts = F.split("config_name", ":")
    names = table(spark, sf_dir, "free_log").select(F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2], F.lit(".jsonl")).alias("file")).distinct()
    cell = names.select("file", stats.cell_of_file(F.col("file")).alias("c")).where("c is not null")
    return cell.select("file", "c.label", "c.threshold", "c.catalog")


def latest_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a batch file has of the identity of its last line."""
    rows = table(spark, sf_dir, "free_log").select("batch_file", "delivery_id", "config_fingerprint")
    kept = invariants.latest_identity(rows, "batch_file", "delivery_id", "config_fingerprint")
    return kept.groupBy("batch_file").agg(F.count("*").alias("n"), F.max("config_fingerprint").alias("identity"))


def pending_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, seed) of the first three repetitions that the log of free runs lacks."""
    targets = table(spark, sf_dir, "tasks").select(whole_number(F.col("task_id")).alias("task")).where("task is not null").distinct()
    done = table(spark, sf_dir, "free_log").select(whole_number(F.col("task_id")).alias("task"), "seed")
    return invariants.pending(targets, "seed", [0, 1, 2], done, ["task", "seed"])


def latency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "value", (F.col("value") > 1).alias("ok"))
    return rounded(latency.levels(rows, ["event_type"], "value", "ok"), "mean")


def repeat_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread over repetitions of mean turns and calls of each label."""
    rows = table(spark, sf_dir, "free_log").withColumn("label", stats.run_label(F.col("config_name")))
    per = rows.groupBy("label", "seed").agg(F.avg("n_messages").alias("n_messages"), F.avg("tool_calls").alias("tool_calls"), F.avg("threshold").alias("threshold"))
    return rounded(latency.across_repeats(per, ["label"], ["n_messages", "tool_calls", "threshold"]), "mean", "sd")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.try_divide(F.col("escalated_turns").cast("double"), F.col("student_turns").cast("double"))
    return table(spark, sf_dir, "free_log").select("catalog", "student_turns", (1 - share).alias("signal"), F.coalesce(F.col("reward") == 1.0, F.lit(False)).alias("right"))


def escalation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = escalation.sweep(_signals(spark, sf_dir), [0.5, 0.7, 0.85, 0.95], ["catalog"])
    return rounded(found, "accuracy_before", "escalation_rate", "accuracy_after", "mistakes_caught", "wasted_escalations")


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(escalation.auroc(_signals(spark, sf_dir), ["catalog"]), "auroc")


def route_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir)
    return rows.groupBy("catalog", escalation.route(F.col("student_turns").isNotNull(), F.col("signal"), 0.7).alias("reason")).agg(F.count("*").alias("n"))


def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sft runs of a catalog beat the zero-shot ones."""
    name = F.when(F.col("config_name").contains("zeroshot"), "zeroshot").when(F.col("config_name").contains("sft"), "sft")
    rates = table(spark, sf_dir, "free_log").select("catalog", name.alias("label"), "reward").where("label is not null")
    rates = rates.groupBy("catalog", "label").agg(F.try_divide(F.count_if(F.col("reward") == 1.0).cast("double"), F.count("*").cast("double")).alias("rate"))
    return rounded(compare.gate(rates, ["catalog"], "zeroshot", "sft"), "delta")


def pivot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins of each label by catalog, side by side."""
    rows = table(spark, sf_dir, "free_log").select(stats.run_label(F.col("config_name")).alias("label"), "catalog", "reward")
    return sinks.pivoted(rows, "label", "catalog", F.count_if(F.col("reward") == 1.0), [16, 40, 80]).select("label", *(F.coalesce(F.col(str(c)), F.lit(0)).alias(f"wins_c{c}") for c in (16, 40, 80)))


def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest minute of each user."""
    counted = runlog.in_last_minute(table(spark, sf_dir, "events").select("user_id", "ts"), ["user_id"], "ts")
    return counted.groupBy("user_id").agg(F.max("n_window").alias("most"), F.count("*").alias("n"))


def minute_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in hours, of each type."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return runlog.window_counts(rows, "ts", "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runlog.daily(table(spark, sf_dir, "events"), ["event_type"], "ts", 40)
    return found.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "over")


def empty_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of batches in which no run of a label won."""
    rows = table(spark, sf_dir, "free_log").select(stats.run_label(F.col("config_name")).alias("label"), "batch_file", "reward")
    batches = rows.groupBy("label", "batch_file").agg(F.count_if(F.col("reward") == 1.0).alias("wins"))
    return invariants.empty_streaks(batches, ["label"], "batch_file", "wins")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells done of each label among the first three repetitions."""
    log = table(spark, sf_dir, "free_log").select(stats.run_label(F.col("config_name")).alias("label"), number_text(F.col("task_id")).alias("task_id"), "seed").where("task_id is not null")
    return runlog.progress(log, ["label"], 3)


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    return sampling.split(keys, "c_custkey", {"train": 60, "eval": 40}, seed=7)


def nested_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a quarter of the customers."""
    return sampling.nested_subset(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 0.25, seed=7)


def deal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.deal(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", [8, 32, 8, 32], seed=3)


def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.strided(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 64)


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.evenly(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 50)


def balance_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with as many finished as open ones."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return pairs.balanced(rows, "o_orderstatus", "F", "P", "o_orderkey", seed=5)


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 documents for review, a source in turn."""
    rows = table(spark, sf_dir, "documents").select("doc_id", label(F.col("source")).alias("source")).where("source is not null")
    return pairs.round_robin(rows, "source", "doc_id", 30, seed=1)


def group_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round("l_discount", 2).alias("reward"))
    return rounded(reward.group_advantages(rows, ["l_orderkey"], "reward"), "advantage")


def dpo_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    loss, weight, z = reward.preference_terms(0.1, -F.col("l_quantity"), -F.col("l_extendedprice") / 1000, -F.col("l_discount") * 100, -F.col("l_tax") * 100)
    return rounded(rows.select("l_orderkey", "l_linenumber", loss.alias("loss"), weight.alias("weight"), z.alias("z")), "loss", "weight", "z")


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", reward.learning_rate(F.col("c_custkey"), 1000).alias("lr")), "lr")


def batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.length("o_orderpriority").alias("n"))
    return rounded(reward.batch_loss(rows, "o_orderkey", "o_totalprice", "n", 64), "loss")


def policy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("p"))
    loss = reward.policy_loss(F.col("p"), F.transform("p", lambda x: x / 2), F.lit(0.5), 0.04)
    return rounded(rows.select("vec_id", loss.alias("loss"), reward.target_count(F.transform("p", lambda x: F.when(x > 0, 1).otherwise(-100))).alias("n_targets")), "loss")


def logprob_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log-probability over the tokens that overlap a span, tokens being 4 characters wide."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("p"))
    starts = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: i * 4)
    mean = escalation.span_mean(F.col("p"), starts, F.transform(starts, lambda s: s + 4), F.lit(10), F.lit(25))
    tops = escalation.best_alternatives(F.transform("p", lambda x, i: F.struct(i.alias("id"), x.alias("lp"))), 5)
    call = escalation.call_probability(tops, 3)
    return rounded(rows.select("vec_id", F.exp(mean).alias("confidence"), call["p"].alias("p_call"), call["bounded"].alias("bounded"), tops[0]["id"].alias("best")), "confidence", "p_call")


def quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What limits allow, of invented quotas in orders and customers."""
    rows = table(spark, sf_dir, "customer")
    per_minute = reward.calls_per_minute(F.col("c_custkey") * 100, F.lit(900), F.when(F.col("c_nationkey") > 5, F.lit(20)))
    episodes = reward.affordable(F.lit(30), F.when(F.col("c_nationkey") > 3, F.col("c_custkey")), F.lit(27))
    return rounded(rows.select("c_custkey", per_minute.alias("per_minute"), episodes.alias("episodes")), "per_minute")


def full_outer_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether episodes and eval steps hold the same (task, repetition)."""
    key = [whole_number(F.col("task_id")).alias("task"), "rep"]
    a, b = (table(spark, sf_dir, n).select(*key).where("task is not null and rep is not null") for n in ("episodes", "eval_steps"))
    return compare.pairing(a, b, ["task", "rep"])


def split_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of broken rules between the evaluation and the training side."""
    e, t, k = (table(spark, sf_dir, n).select(whole_number(F.col("task_id")).alias("task")) for n in ("eval_steps", "train_states", "tasks"))
    parts = [("in both splits", invariants.leaked(t, e, "task")), ("train task unknown", invariants.stray(t.where("task is not null"), k, "task")), ("eval task unknown", invariants.stray(e.where("task is not null"), k, "task"))]
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, df in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def identity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulators by whether their name may move and whether judge and teacher would be one model, the judge being named with its provider."""
    model = F.split(stats.run_label(F.col("config_name")), "-")[0]
    rows = table(spark, sf_dir, "free_log").select(F.coalesce("simulator", F.lit(stats.DEFAULT_SIMULATOR)).alias("simulator"), model.alias("teacher"), F.concat(F.lit("p/"), F.when(F.col("backend") == "mlx", model).otherwise(F.concat(model, F.lit("-preview")))).alias("judge"))
    return rows.groupBy("simulator", invariants.floating_alias(F.col("judge")).alias("floats"), invariants.same_model(F.col("judge"), F.col("teacher")).alias("same")).agg(F.count("*").alias("n"))


def runlog_stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as three arrivals, the second repeating part of the first: each cell is taken once."""
    from evalspark.shared import new_path

    folder = new_path(spark, "stream")
    rows = table(spark, sf_dir, "free_log").select(folded(F.col("config_fingerprint")).alias("config_fingerprint"), number_text(F.col("task_id")).alias("task_id"), "seed", "ts", "config_name", "smoke", "reward")
    rows = rows.where("config_fingerprint is not null and task_id is not null")
    early = F.col("seed") < 2
    for name, part in (("a", rows.where(early)), ("b", rows.where(F.col("seed") < 4)), ("c", rows)):
        part.write.mode("append").json(f"{folder}/in/arrival={name}")
        runlog.resume(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").groupBy("seed").agg(F.count("*").alias("n"))


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small text rules over all documents: targets, cuts, tokens, reasoning, modelled latency."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text: Column = F.col("text")
    return docs.select(
        "doc_id", F.length(pairs.as_target(text)).alias("target_chars"), F.length(reward.cut(text, 700)).alias("cut_chars"),
        stats.estimated_tokens(text).alias("tokens"), pairs.teacher_reasoning(text).alias("reasoning"), F.round(latency.modelled(text), 6).alias("latency"),
    )


def over_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of documents by language, in estimated tokens."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), stats.estimated_tokens(F.col("text")).alias("tokens"))
    found = stats.length_summary(docs, ["lang"], "tokens")
    return rounded(found, "mean", *(c for c in found.columns if c.startswith("over_")))


def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether an earlier one has the same text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"))
    return pairs.first_pairs(docs, ["text"], "doc_id").select("doc_id", "duplicate")


RUNS = [
    success_table, mean_ci_by_user, free_rows, file_cells, latest_identity, pending_cells, latency_levels, repeat_mean_sd, escalation_sweep, auroc, route_decision, gate_verdict, pivot_report,
    rate_window, minute_windows, daily_quota, empty_streak, progress, hash_split, nested_subset, deal_blocks, stride_sample, even_sample, balance_buckets, round_robin, group_advantages, dpo_terms,
    lr_schedule, batch_loss, policy_loss, logprob_confidence, quota, full_outer_pairing, split_leak_check, identity_checks, runlog_stream_resume, text_rules, over_limits, first_wins_dedupe,
]
QUERIES = {f.__name__: f for f in RUNS}

_LABEL = "CASE WHEN len(string_split(config_name, ':')) >= 2 THEN string_split(config_name, ':')[2] ELSE config_name END"
_TASK = "CASE WHEN regexp_full_match(trim(task_id), '[0-9]{1,18}') THEN CAST(trim(task_id) AS BIGINT) END"
_T95 = "CASE WHEN {0} > 30 THEN 1.96 WHEN {0} > 10 THEN 2.042 " + " ".join(f"WHEN {{0}} = {d} THEN {v}" for d, v in stats.T95.items()) + " END"
_SIGNALS = "SELECT catalog, student_turns, 1 - CASE WHEN student_turns <> 0 THEN escalated_turns::double / student_turns END AS signal, coalesce(reward = 1.0, false) AS ok FROM free_log"
_PASS = lambda k: "round(avg(" + " * ".join(f"(greatest(0, c - {i})::double / greatest(1, n - {i}))" for i in range(k)) + f"), 6) AS pass_{k}"
_PLACE = "md5('{seed}:' || {key})"


def _ordered(source: str, key: str, seed: int) -> str:
    return f"SELECT {key}, row_number() OVER (ORDER BY {_PLACE.format(seed=seed, key=key)}, {key}) AS o FROM (SELECT DISTINCT {key} FROM {source})"


ORACLES = {
    "success_table": f"""
        WITH f AS (SELECT u.event_type, u.user_id, s.seed, coalesce(bool_or(value >= 20), false) AS ok FROM (SELECT DISTINCT event_type, user_id FROM events) u CROSS JOIN range(5) s(seed)
            LEFT JOIN events e ON e.event_type = u.event_type AND e.user_id = u.user_id AND e.event_id % 5 = s.seed GROUP BY ALL),
        k AS (SELECT event_type, user_id, count(*) AS n, sum(ok::int) AS c FROM f GROUP BY ALL),
        s AS (SELECT event_type, seed, round_even(avg(ok::int::double), 4) AS rate FROM f GROUP BY ALL),
        r AS (SELECT event_type, count(*) AS n_seeds, avg(rate) AS mean, stddev_samp(rate) AS sd FROM s GROUP BY ALL),
        p AS (SELECT event_type, count(*) AS n_tasks, sum(n)::bigint AS n_trials, sum(c)::bigint AS n_successes, min(n) = max(n) AS equal, count(*) FILTER (c > 0) AS solved_any, count(*) FILTER (c = n) AS solved_every, {", ".join(map(_PASS, range(1, 6)))} FROM k GROUP BY ALL)
        SELECT event_type, n_tasks, n_trials, n_seeds, n_successes, equal AND n_seeds >= 2 AS complete, solved_any, solved_every, round(mean, 6) AS mean,
            round(mean - ({_T95.format("(n_seeds - 1)")}) * sd / sqrt(n_seeds), 6) AS ci95_low, round(mean + ({_T95.format("(n_seeds - 1)")}) * sd / sqrt(n_seeds), 6) AS ci95_high, pass_1, pass_2, pass_3, pass_4, pass_5
        FROM p JOIN r USING (event_type)""",
    "mean_ci_by_user": f"""
        WITH a AS (SELECT user_id, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY user_id)
        SELECT user_id, n, round(mean, 6) AS mean, round(mean - ({_T95.format("(n - 1)")}) * sd / sqrt(n), 6) AS ci95_low, round(mean + ({_T95.format("(n - 1)")}) * sd / sqrt(n), 6) AS ci95_high FROM a""",
    "free_rows": f"""
        SELECT {_LABEL} AS label, catalog, coalesce(simulator, 'v1') AS simulator, count(DISTINCT lower(trim(config_fingerprint, E' \\t\\n'))) AS identities, count(*) AS n_episodes, count(*) FILTER (reward = 1.0) AS n_successes,
            sum(escalated_turns)::bigint AS escalated, sum(student_turns)::bigint AS turns, count(*) FILTER (coalesce(degenerate_user_turn, false)) AS degenerate_episodes,
            round(CASE WHEN sum(student_turns) <> 0 THEN sum(escalated_turns)::double / sum(student_turns) END, 6) AS escalation_rate
        FROM free_log WHERE NOT coalesce(smoke, false) GROUP BY 1, 2, 3""",
    "file_cells": """
        WITH f AS (SELECT DISTINCT string_split(config_name, ':')[1] || '-' || string_split(config_name, ':')[2] || '-' || string_split(config_name, ':')[3] || '.jsonl' AS file FROM free_log)
        SELECT file, regexp_extract(file, '^free-(.+?)(?:-esc([0-9.]+))?-c(\\d+)\\.jsonl$', 1) AS label, try_cast(nullif(regexp_extract(file, '^free-(.+?)(?:-esc([0-9.]+))?-c(\\d+)\\.jsonl$', 2), '') AS double) AS threshold, regexp_extract(file, '^free-(.+?)(?:-esc([0-9.]+))?-c(\\d+)\\.jsonl$', 3)::int AS catalog
        FROM f WHERE regexp_matches(file, '^free-(.+?)(?:-esc([0-9.]+))?-c(\\d+)\\.jsonl$')""",
    "latest_identity": """
        WITH l AS (SELECT batch_file, config_fingerprint AS last FROM (SELECT *, row_number() OVER (PARTITION BY batch_file ORDER BY delivery_id DESC) AS rn FROM free_log) WHERE rn = 1)
        SELECT batch_file, count(*) AS n, max(config_fingerprint) AS identity FROM free_log JOIN l USING (batch_file) WHERE config_fingerprint IS NOT DISTINCT FROM last GROUP BY batch_file""",
    "pending_cells": f"""
        SELECT task, seed FROM (SELECT DISTINCT {_TASK} AS task FROM tasks) CROSS JOIN (VALUES (0), (1), (2)) v(seed) WHERE task IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM (SELECT {_TASK} AS t, seed AS s FROM free_log) WHERE t = task AND s = seed)""",
    "latency_levels": "SELECT event_type, count(*) AS requests, count(*) FILTER (NOT value > 1) AS errors, quantile_disc(value, 0.5) FILTER (value > 1) AS p50, quantile_disc(value, 0.95) FILTER (value > 1) AS p95, quantile_disc(value, 0.99) FILTER (value > 1) AS p99, round(avg(value) FILTER (value > 1), 6) AS mean FROM events GROUP BY 1",
    "repeat_mean_sd": f"""
        WITH p AS (SELECT {_LABEL} AS label, seed, avg(n_messages) AS n_messages, avg(tool_calls) AS tool_calls, avg(threshold) AS threshold FROM free_log GROUP BY 1, 2),
        s AS (SELECT label, 'n_messages' AS metric, n_messages AS v FROM p UNION ALL SELECT label, 'tool_calls', tool_calls FROM p UNION ALL SELECT label, 'threshold', threshold FROM p)
        SELECT label, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM s GROUP BY 1, 2""",
    "escalation_sweep": f"""
        WITH s AS ({_SIGNALS}), p AS (SELECT catalog, t AS threshold, count(*) AS n, count(*) FILTER (NOT ok) AS w, count(*) FILTER (signal IS NULL OR signal < t) AS e, count(*) FILTER ((signal IS NULL OR signal < t) AND NOT ok) AS c
            FROM s CROSS JOIN (VALUES (0.5::double), (0.7::double), (0.85::double), (0.95::double)) v(t) GROUP BY ALL)
        SELECT catalog, threshold, n AS n_steps, round((n - w)::double / n, 6) AS accuracy_before, round(e::double / n, 6) AS escalation_rate, round((n - w + c)::double / n, 6) AS accuracy_after,
            round(CASE WHEN w > 0 THEN c::double / w END, 6) AS mistakes_caught, round(CASE WHEN e > 0 THEN (e - c)::double / e END, 6) AS wasted_escalations FROM p""",
    "auroc": f"""
        WITH s AS (SELECT * FROM ({_SIGNALS}) WHERE signal IS NOT NULL), r AS (SELECT catalog, ok, rank() OVER (PARTITION BY catalog ORDER BY signal) + (count(*) OVER (PARTITION BY catalog, signal) - 1) / 2.0::double AS mid FROM s)
        SELECT catalog, count(*) FILTER (ok) AS n_right, count(*) FILTER (NOT ok) AS n_wrong,
            round(CASE WHEN count(*) FILTER (ok) > 0 AND count(*) FILTER (NOT ok) > 0 THEN (sum(mid) FILTER (ok) - count(*) FILTER (ok) * (count(*) FILTER (ok) + 1) / 2.0::double) / (count(*) FILTER (ok) * count(*) FILTER (NOT ok)) END, 6) AS auroc
        FROM r GROUP BY catalog""",
    "route_decision": f"SELECT catalog, CASE WHEN student_turns IS NULL THEN 'overflow' WHEN signal IS NULL THEN 'unmeasured' WHEN signal < 0.7::double THEN 'low_confidence' ELSE 'confident' END AS reason, count(*) AS n FROM ({_SIGNALS}) GROUP BY 1, 2",
    "gate_verdict": """
        WITH r AS (SELECT catalog, CASE WHEN contains(config_name, 'zeroshot') THEN 'zeroshot' WHEN contains(config_name, 'sft') THEN 'sft' END AS label, count(*) FILTER (reward = 1.0)::double / count(*) AS rate FROM free_log GROUP BY 1, 2),
        d AS (SELECT catalog, round_even(max(rate) FILTER (label = 'sft') - max(rate) FILTER (label = 'zeroshot'), 4) AS delta FROM r WHERE label IS NOT NULL GROUP BY 1)
        SELECT catalog, delta, CASE WHEN delta IS NULL THEN 'incomplete' WHEN delta >= 0.15 THEN 'pass' ELSE 'fail' END AS verdict FROM d""",
    "pivot_report": f"SELECT {_LABEL} AS label, count(*) FILTER (reward = 1.0 AND catalog = 16) AS wins_c16, count(*) FILTER (reward = 1.0 AND catalog = 40) AS wins_c40, count(*) FILTER (reward = 1.0 AND catalog = 80) AS wins_c80 FROM free_log GROUP BY 1",
    "rate_window": "SELECT user_id, max(k) AS most, count(*) AS n FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS k FROM events) GROUP BY 1",
    "minute_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events GROUP BY 1",
    "daily_quota": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, greatest(0, count(*) - 40) AS over FROM events GROUP BY 1, 2",
    "empty_streak": f"""
        WITH b AS (SELECT {_LABEL} AS label, batch_file, count(*) FILTER (reward = 1.0) AS wins FROM free_log GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY batch_file) AS n FROM b),
        r AS (SELECT label, batch_file, n - row_number() OVER (PARTITION BY label ORDER BY batch_file) AS run FROM o WHERE wins = 0)
        SELECT label, min(batch_file) AS first, max(batch_file) AS last, count(*) AS length FROM r GROUP BY label, run HAVING count(*) >= 2""",
    "progress": f"""
        SELECT label, count(*) AS done FROM (SELECT DISTINCT {_LABEL} AS label, regexp_replace(lower(trim(task_id)), '^0+(.)', '\\1') AS task, seed FROM free_log WHERE seed < 3 AND trim(task_id) <> '') GROUP BY 1""",
    "hash_split": f"SELECT c_custkey, CASE WHEN o <= 60 THEN 'train' ELSE 'eval' END AS split FROM ({_ordered('customer', 'c_custkey', 7)}) WHERE o <= 100",
    "nested_subset": f"WITH p AS ({_ordered('orders', 'o_custkey', 7)}) SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM p WHERE o <= greatest(1, floor((SELECT count(*) FROM p) * 0.25 + 0.5)))",
    "deal_blocks": f"SELECT p_partkey, CASE WHEN o <= 8 THEN 0 WHEN o <= 40 THEN 1 WHEN o <= 48 THEN 2 ELSE 3 END AS block FROM ({_ordered('part', 'p_partkey', 3)}) WHERE o <= 80",
    "stride_sample": "WITH n AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, greatest(1, count(*) OVER () // 64) AS step FROM orders) SELECT o_orderkey, o_custkey FROM n WHERE i % step = 0 AND i < step * 64",
    "even_sample": "WITH n AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), k AS (SELECT DISTINCT (j * (SELECT count(*) FROM orders)) // 50 AS i FROM range(50) t(j)) SELECT o_orderkey, o_custkey FROM n WHERE i IN (SELECT i FROM k)",
    "balance_buckets": f"""
        WITH k AS (SELECT least(count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'P')) AS keep FROM orders),
        r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_PLACE.format(seed=5, key="o_orderkey")}, o_orderkey) AS rn FROM orders)
        SELECT o_orderkey, o_orderstatus FROM r, k WHERE o_orderstatus NOT IN ('F', 'P') OR rn <= keep""",
    "round_robin": f"""
        WITH d AS (SELECT doc_id, regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') AS source FROM documents WHERE trim(source) <> ''),
        r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_PLACE.format(seed=1, key="doc_id")}, doc_id) AS turn, count(*) OVER (PARTITION BY source) AS size FROM d)
        SELECT doc_id, source, turn FROM r ORDER BY turn, size DESC, source LIMIT 30""",
    "group_advantages": """
        WITH r AS (SELECT l_orderkey, l_linenumber, round(l_discount, 2) AS reward FROM lineitem), m AS (SELECT l_orderkey, avg(reward) AS mean, stddev_pop(reward) AS sd FROM r GROUP BY 1)
        SELECT l_orderkey, l_linenumber, reward, round(CASE WHEN sd >= 1e-6 THEN (reward - mean) / (sd + 1e-4) END, 6) AS advantage FROM r JOIN m USING (l_orderkey)""",
    "dpo_terms": """
        WITH z AS (SELECT l_orderkey, l_linenumber, 0.1::double * ((-l_quantity + l_extendedprice / 1000) - (-l_discount * 100 + l_tax * 100)) AS z FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(greatest(-z, 0) + ln(1 + exp(-abs(z))), 6) AS loss, round(0.05::double * (1 - tanh(z / 2)), 6) AS weight, round(z, 6) AS z FROM z""",
    "lr_schedule": "SELECT c_custkey, round(CASE WHEN c_custkey < 100 THEN (c_custkey + 1)::double / 100 ELSE greatest(0, (1000 - c_custkey)::double / 900) END, 6) AS lr FROM customer",
    "batch_loss": "SELECT floor(o_orderkey / 64)::bigint AS batch, round(sum(o_totalprice) / sum(length(o_orderpriority)), 6) AS loss FROM orders GROUP BY 1",
    "policy_loss": """
        SELECT vec_id, round(-0.5::double * list_sum(list_transform(embedding, lambda x: x::double)) / len(embedding) + 0.04::double * list_sum(list_transform(embedding, lambda x: exp(-x::double / 2) + x::double / 2 - 1)) / len(embedding), 6) AS loss,
            len(list_filter(embedding[2:], lambda x: x > 0))::int AS n_targets FROM embeddings""",
    "logprob_confidence": """
        WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: -abs(x::double)) AS p FROM embeddings), s AS (SELECT vec_id, p, list_reverse_sort(p)[1:5] AS top FROM p)
        SELECT vec_id, round(exp(list_sum(p[3:7]) / 5), 6) AS confidence, round(exp(CASE WHEN p[4] >= top[5] THEN p[4] ELSE top[5] END), 6) AS p_call, NOT p[4] >= top[5] AS bounded, (list_position(p, top[1]) - 1)::int AS best FROM s""",
    "quota": "SELECT c_custkey, round(least((c_custkey * 100)::double / 900, CASE WHEN c_nationkey > 5 THEN 20::double END), 6) AS per_minute, least(30, CASE WHEN c_nationkey > 3 THEN c_custkey // 27 END)::bigint AS episodes FROM customer",
    "full_outer_pairing": f"""
        WITH a AS (SELECT DISTINCT {_TASK} AS task, rep FROM episodes), b AS (SELECT DISTINCT {_TASK} AS task, rep FROM eval_steps), x AS (SELECT * FROM a WHERE task IS NOT NULL AND rep IS NOT NULL), y AS (SELECT * FROM b WHERE task IS NOT NULL AND rep IS NOT NULL)
        SELECT (SELECT count(*) FROM x JOIN y USING (task, rep)) AS n_both, (SELECT count(*) FROM (FROM x EXCEPT FROM y)) AS only_in_base, (SELECT count(*) FROM (FROM y EXCEPT FROM x)) AS only_in_new""",
    "split_leak_check": f"""
        WITH e AS (SELECT DISTINCT {_TASK} AS task FROM eval_steps), t AS (SELECT DISTINCT {_TASK} AS task FROM train_states), k AS (SELECT DISTINCT {_TASK} AS task FROM tasks)
        SELECT 'in both splits' AS rule, count(*) AS n FROM e JOIN t USING (task) UNION ALL SELECT 'train task unknown', count(*) FROM t WHERE task IS NOT NULL AND task NOT IN (SELECT task FROM k WHERE task IS NOT NULL)
        UNION ALL SELECT 'eval task unknown', count(*) FROM e WHERE task IS NOT NULL AND task NOT IN (SELECT task FROM k WHERE task IS NOT NULL)""",
    "identity_checks": f"""
        WITH r AS (SELECT coalesce(simulator, 'v1') AS simulator, string_split({_LABEL}, '-')[1] AS t, backend FROM free_log), j AS (SELECT simulator, t, CASE WHEN backend = 'mlx' THEN t ELSE t || '-preview' END AS j FROM r)
        SELECT simulator, regexp_matches(lower(j), 'latest|preview') AS floats, j = t AS same, count(*) AS n FROM j GROUP BY 1, 2, 3""",
    "runlog_stream_resume": """
        SELECT seed, count(*) AS n FROM (SELECT DISTINCT lower(trim(config_fingerprint, E' \\t\\n')) AS fp, regexp_replace(lower(trim(task_id)), '^0+(.)', '\\1') AS task, seed FROM free_log WHERE config_fingerprint IS NOT NULL AND trim(task_id) <> '') GROUP BY 1""",
    "text_rules": r"""
        SELECT doc_id, length(string_split(text, '<|im_end|>')[1]) + 10 AS target_chars, CASE WHEN length(text) > 700 THEN 702 ELSE length(text) END AS cut_chars, round_even(length(text) / 3.5::double, 0)::bigint AS tokens,
            coalesce(regexp_matches(regexp_replace(text, '(?i)\bthe user(''s|’s)?\s*(id|account)\b', '', 'g'), '(?i)\bthe user(''s|’s)?\b'), false) AS reasoning, round(1 + length(text) / 1000::double, 6) AS latency FROM documents""",
    "over_limits": """
        WITH d AS (SELECT coalesce(lang, 'none') AS lang, round_even(length(text) / 3.5::double, 0)::bigint AS tokens FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tokens) AS rn, count(tokens) OVER (PARTITION BY lang) AS m FROM d WHERE tokens IS NOT NULL)
        SELECT lang, m AS n, round(mean, 6) AS mean, max, round(o1, 6) AS over_2048, round(o2, 6) AS over_4096, round(o3, 6) AS over_8192, round(o4, 6) AS over_12288, round(o5, 6) AS over_16384, p50, p95 FROM (
            SELECT lang, max(m) AS m, avg(tokens) AS mean, max(tokens) AS max, avg((tokens > 2048)::int::double) AS o1, avg((tokens > 4096)::int::double) AS o2, avg((tokens > 8192)::int::double) AS o3, avg((tokens > 12288)::int::double) AS o4, avg((tokens > 16384)::int::double) AS o5,
                max(tokens) FILTER (rn = greatest(1, least(m, round_even(0.5 * m::double, 0)))) AS p50, max(tokens) FILTER (rn = greatest(1, least(m, round_even(0.95::double * m, 0)))) AS p95 FROM r GROUP BY lang)""",
    "first_wins_dedupe": "SELECT doc_id, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) > 1 AS duplicate FROM documents",
}
