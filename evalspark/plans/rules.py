"""Queries of the smaller rules over steps, prompts and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.text import label, strip, whole_number
from evalspark.operators import stats, steps
from evalspark.plans.runs import rounded
from evalspark.plans.tables import table


def step_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every step id."""
    rows = table(spark, sf_dir, "eval_steps").select("eval_id", steps.step_parts(strip(F.col("step_id"))).alias("p"))
    return rows.select("eval_id", "p.task", "p.rep", "p.index")


def prompt_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of every prompt, as its hash and length."""
    end = steps.tail(F.col("prompt"))
    return table(spark, sf_dir, "eval_steps").where("prompt is not null").select("eval_id", F.length(end).alias("chars"), F.md5(end.cast("binary")).alias("hash"))


def fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length(steps.without_fence(F.concat(F.lit("```json\n"), "text", F.lit("\n```")))).alias("fenced"), F.length(steps.without_fence(F.col("text"))).alias("bare"))


def first_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 tasks by number that have an episode, and those of the first 20 that have none yet."""
    number = whole_number(F.col("task_id"))
    ordered = table(spark, sf_dir, "tasks").select(number.alias("task")).where("task is not null").distinct().withColumn("ordinal", F.col("task"))
    played = table(spark, sf_dir, "episodes").select(number.alias("task")).where("task is not null")
    a = steps.first_present(ordered, played, "task", "ordinal", 20).select(F.lit("present").alias("kind"), "task")
    return a.unionByName(steps.pending_first(ordered, played, "task", "ordinal", 20).select(F.lit("pending").alias("kind"), "task"))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unscored episodes by repetition and temperature, with the first of them."""
    rows = table(spark, sf_dir, "episodes").where("reward is null").select("rep", "temperature", F.lpad(F.col("episode_id").cast("string"), 9, "0").alias("episode"))
    return steps.failures(rows, ["rep", "temperature"], "episode")


def policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of a task as a group of completions, by repetition count."""
    rows = table(spark, sf_dir, "free_log").where("reward is not null").select("catalog", F.concat_ws(":", "config_fingerprint", "task_id").alias("group"), "reward", (F.col("tool_calls") > 5).alias("called"), (F.col("termination") == "max_steps").alias("cut"), F.col("n_messages").cast("double").alias("messages"), "threshold")
    found = steps.policy_metrics(rows, ["catalog"], ["messages", "threshold"])
    return rounded(found, "reward", "call_rate", "truncated", "flat_groups", "r_messages", "r_threshold")


def prefix_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many leading numbers each embedding, cut to one digit, shares with the average sign pattern of its label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("ids"))
    first = vectors.groupBy("label").agg(F.min_by("ids", "vec_id").alias("other"))
    return vectors.join(first, "label").select("vec_id", steps.common_prefix(F.col("ids"), F.col("other")).alias("shared"))


def length_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that don't fit, by reason."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length("text").alias("n"), (F.length("text") == F.col("n_chars")).alias("aligned"))
    return steps.length_guard(docs, "n", 2000, "aligned")[1]


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivered row of each configuration and repetition, by source of the label."""
    rows = table(spark, sf_dir, "free_log").select(F.concat_ws(":", "config_name", "seed").alias("key"), "delivery_id", "reward")
    return steps.latest_by_step(rows, "key", "delivery_id")


def cell_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of cells, and whether reading them gives the cell back."""
    rows = table(spark, sf_dir, "free_log").select(F.regexp_replace(stats.run_label(F.col("config_name")), r"-esc[0-9.]+$", "").alias("label"), "threshold", "catalog").distinct()
    named = rows.withColumn("file", steps.cell_name(F.col("label"), F.col("threshold"), F.col("catalog"))).withColumn("c", stats.cell_of_file(F.col("file")))
    return named.select("file", ((F.col("c.label") == F.col("label")) & F.col("c.threshold").eqNullSafe(F.col("threshold")) & (F.col("c.catalog") == F.col("catalog"))).alias("same"))


def sources_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source under one spelling."""
    return table(spark, sf_dir, "documents").groupBy(label(F.col("source")).alias("source")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("spellings"))


ALL = [step_ids, prompt_tails, fences, first_tasks, failures, policy_metrics, prefix_reuse, length_guards, latest_rows, cell_names, sources_spelled]
QUERIES = {f.__name__: f for f in ALL}

_TASK = "CASE WHEN regexp_full_match(trim(task_id), '[0-9]{1,18}') THEN CAST(trim(task_id) AS BIGINT) END"
_ONE = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

ORACLES = {
    "step_ids": "SELECT eval_id, CASE WHEN m THEN regexp_extract(s, '(?s)^(.*):([^:]*):(\\d+)$', 1) END AS task, CASE WHEN m THEN regexp_extract(s, '(?s)^(.*):([^:]*):(\\d+)$', 2) END AS rep, CASE WHEN m THEN regexp_extract(s, '(?s)^(.*):([^:]*):(\\d+)$', 3)::int END AS \"index\" FROM (SELECT eval_id, trim(step_id) AS s, regexp_matches(trim(step_id), '(?s)^.*:[^:]*:\\d+$') AS m FROM eval_steps)",
    "prompt_tails": f"""
        WITH p AS (SELECT eval_id, string_split(prompt, '<|im_start|>') AS p FROM eval_steps WHERE prompt IS NOT NULL),
        t AS (SELECT eval_id, array_to_string(list_transform(p[greatest(1, len(p) - 2):len(p) - 1], lambda x: {_ONE.format("replace(x, '<|im_end|>', '')")}[-600:]), chr(10)) AS t FROM p)
        SELECT eval_id, length(t) AS chars, md5(t) AS hash FROM t""",
    "fences": r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS fenced, length(CASE WHEN regexp_full_match(text, '(?s)\s*```(?:json)?\s*.*?\s*```\s*') THEN regexp_extract(text, '(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$', 1) ELSE text END) AS bare FROM documents WHERE text IS NOT NULL",
    "cell_names": """
        WITH r AS (SELECT DISTINCT regexp_replace(CASE WHEN len(string_split(config_name, ':')) >= 2 THEN string_split(config_name, ':')[2] ELSE config_name END, '-esc[0-9.]+$', '') AS l, threshold AS t, catalog AS c FROM free_log)
        SELECT 'free-' || l || CASE WHEN t IS NOT NULL THEN printf('-esc%.2f', t) ELSE '' END || '-c' || c || '.jsonl' AS file, l IS NOT NULL AS same FROM r""",
    "first_tasks": f"""
        WITH t AS (SELECT DISTINCT {_TASK} AS task FROM tasks WHERE {_TASK} IS NOT NULL), e AS (SELECT DISTINCT {_TASK} AS task FROM episodes WHERE {_TASK} IS NOT NULL)
        SELECT 'present' AS kind, task FROM (SELECT task FROM t WHERE task IN (SELECT task FROM e) ORDER BY task LIMIT 20) UNION ALL SELECT 'pending', task FROM (SELECT task FROM t ORDER BY task LIMIT 20) WHERE task NOT IN (SELECT task FROM e)""",
    "failures": "SELECT rep, temperature, count(*) AS n, array_to_string((list_sort(list(lpad(episode_id::varchar, 9, '0'))))[1:8], ', ') AS first, greatest(0, count(DISTINCT episode_id) - 8) AS more FROM episodes WHERE reward IS NULL GROUP BY 1, 2",
    "policy_metrics": """
        WITH r AS (SELECT catalog, concat_ws(':', config_fingerprint, task_id) AS g, reward, (tool_calls > 5)::int::double AS called, (termination = 'max_steps')::int::double AS cut, n_messages::double AS m, threshold FROM free_log WHERE reward IS NOT NULL),
        f AS (SELECT catalog, round(avg((sd < 1e-6)::int::double), 6) AS flat_groups FROM (SELECT catalog, g, stddev_pop(reward) AS sd FROM r GROUP BY 1, 2) GROUP BY 1)
        SELECT r.catalog, round(avg(reward), 6) AS reward, round(avg(called), 6) AS call_rate, round(avg(cut), 6) AS truncated, round(avg(m), 6) AS r_messages, round(avg(threshold), 6) AS r_threshold, any_value(flat_groups) AS flat_groups FROM r JOIN f ON r.catalog IS NOT DISTINCT FROM f.catalog GROUP BY 1""",
    "prefix_reuse": """
        WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: (x > 0)::int) AS ids FROM embeddings), f AS (SELECT label, arg_min(ids, vec_id) AS other FROM v GROUP BY 1)
        SELECT vec_id, (coalesce(list_position(list_transform(range(1, len(ids) + 1), lambda i: ids[i] <> other[i]), true), len(ids) + 1) - 1)::int AS shared FROM v JOIN f USING (label)""",
    "length_guards": "SELECT CASE WHEN NOT length(text) = n_chars THEN 'token_boundary' ELSE 'too_long' END AS reason, count(*) AS n FROM documents WHERE text IS NOT NULL AND (NOT length(text) = n_chars OR length(text) > 2000) GROUP BY 1",
    "latest_rows": "SELECT concat_ws(':', config_name, seed) AS key, max(delivery_id) AS delivery_id, arg_max_null(reward, delivery_id) AS reward FROM free_log GROUP BY 1",
    "sources_spelled": "SELECT nullif(regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g'), '') AS source, count(*) AS n, count(DISTINCT source) AS spellings FROM documents GROUP BY 1",
}
