"""Queries that write the tables as files of the run's formats and read them again: readers, sinks and streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.text import whole_number
from evalspark.operators import invariants, stats, steps, turns
from evalspark.plans import conversations
from evalspark.plans.conversations import CATALOG, NATIVE
from evalspark.plans.tables import table
from evalspark.shared import new_path, write_text
from evalspark.sources import readers, sinks


def log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of free runs appended in chunks, read back line by line and counted by repetition."""
    path = new_path(spark, "log")
    rows = table(spark, sf_dir, "free_log").select("task_id", "seed", "reward", "n_messages")
    sinks.append_log(rows, path, {"config_fingerprint": "f", "config_name": "n"}, per_file=4096)
    readers.line_counts(spark, path, expected=rows.count())
    back = readers.jsonl(spark, path, readers.RUN_LOG)
    return back.groupBy("seed").agg(F.count("*").alias("n"), F.count_if(F.col("reward") == 1.0).alias("n_won"), F.sum("n_messages").alias("n_messages"), F.count("task_id").alias("n_tasks"), F.count_if((F.col("ts") > 1e9) & (F.col("line") > 0)).alias("n_stamped"))


def strict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records written as JSON lines and read where any bad line is an error."""
    path = new_path(spark, "records")
    table(spark, sf_dir, "train_states").select("task_id", "rep", F.length("prompt").alias("chars"), F.size("prior_calls").alias("n_decisions")).write.json(path)
    return readers.strict_jsonl(spark, path, readers.SFT_RECORD).groupBy("rep").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("n_decisions").alias("n_decisions"))


def cells_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as one folder for each cell; label, threshold and catalog come from the names, other names are left out."""
    folder = new_path(spark, "cells")
    parts = F.split("config_name", ":")
    names = F.concat_ws("-", parts[0], parts[1], parts[2])
    rows = table(spark, sf_dir, "free_log").where("config_name is not null").select("reward", "catalog", F.when(F.col("seed") == 4, F.lit("other.jsonl")).otherwise(F.concat(names, F.lit(".jsonl"))).alias("name"))
    sinks.write_cells(rows, folder, "name")
    back = readers.free_cells(spark, f"{folder}/*")
    return back.groupBy("file_label", "file_threshold", "file_catalog").agg(F.count("*").alias("n"), F.sum("catalog").alias("catalogs"))


def forced_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eval steps as forced results of each repetition, those of the first also as a smoke run that isn't read."""
    folder = new_path(spark, "forced")
    rows = table(spark, sf_dir, "eval_steps").select("task_id", "rep", "step_index").where("rep is not null")
    sinks.write_cells(rows.withColumn("name", F.concat(F.lit("forced-c"), F.col("rep").cast("string"), F.lit(".jsonl"))), folder, "name")
    sinks.write_cells(rows.where("rep = 0").withColumn("name", F.lit("forced-c0.smoke.jsonl")), folder, "name")
    back = readers.forced_results(spark, folder, "task_id string, rep int, step_index int")
    return back.groupBy(readers.log_name(F.col("file")).alias("file")).agg(F.count("*").alias("n"), F.sum("step_index").alias("indexes"))


def trajectory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes as documents of simulations, read back and joined with their log rows, each of which must have its simulation."""
    path = new_path(spark, "trajectories")
    rows = table(spark, sf_dir, "episodes").where("trajectory_file is not null and task_id is not null")
    once = rows.groupBy("trajectory_file", "task_id").agg(F.min_by(F.struct("episode_id", "reward", "messages"), F.struct(F.col("reward").isNull(), "episode_id")).alias("e"))
    sims = once.select(F.col("trajectory_file").alias("file"), F.array(F.struct("task_id", F.when(F.col("e.reward").isNotNull(), F.struct(F.col("e.reward").alias("reward"))).alias("reward_info"), F.col("e.messages").alias("messages"))).alias("simulations"))
    sims.write.json(path)
    scanned = readers.trajectories(spark, path, lines=True)
    log = once.where("e.reward is not null").select(F.col("trajectory_file").alias("file"), "task_id", "e.episode_id")
    met = invariants.complete_join(log, scanned, ["file", "task_id"])
    return met.select("episode_id", "reward", F.size("messages").alias("n_messages"))


def function_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function documents made of parts, some listed in one record; the first of a name wins, parameters become plain schemas."""
    folder = new_path(spark, "functions")
    kind = F.when(F.col("p_size") > 25, "float").otherwise("dict")
    doc = lambda name: F.struct(name.alias("name"), F.struct(F.lit("dict").alias("type"), F.struct(F.struct(kind.alias("type"), F.lit(1).alias("x")).alias("a")).alias("properties")).alias("parameters"))
    base = F.regexp_replace("p_type", " ", ".")
    rows = table(spark, sf_dir, "part").repartitionByRange("p_partkey").sortWithinPartitions("p_partkey")
    alone = rows.where("p_partkey % 3 <> 0").select(doc(base).alias("d")).select("d.*")
    listed = rows.where("p_partkey % 3 = 0").select(F.array(doc(F.concat(F.lit("list "), base)), doc(base)).alias("function"))
    alone.write.json(folder)
    listed.write.json(f"{folder}/multi_turn_func_doc")
    found = readers.functions(spark, folder)
    return found.select("name", "schema", F.col("file").contains("multi_turn").alias("of_turns"))


def pinned_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog written, read back against its hash and size, and put in order beside what is called."""
    import hashlib

    path = new_path(spark, "catalog")
    text = json.dumps({"tools": [{"name": n} for n in CATALOG]})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    tools = readers.catalog(spark, f"{path}/part-*", hashlib.sha256(f"{text}\n".encode()).hexdigest(), len(CATALOG))
    catalog = spark.createDataFrame([(t["name"], i) for i, t in enumerate(tools)], "name string, ordinal int")
    native = spark.createDataFrame([(n,) for n in NATIVE], "name string")
    invariants.require(steps.missing_native(catalog, native), "the catalog holds all native tools")
    used = turns.messages(conversations._episodes(spark, sf_dir)).select(F.explode(turns.call_names(F.col("tool_calls"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return steps.in_catalog_order(catalog, native).join(used, "name", "left").na.fill(0, ["n"])


def label_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong steps as a sheet for people, written and read back."""
    path = new_path(spark, "sheet")
    prompts = table(spark, sf_dir, "eval_steps").select("eval_id", "prompt")
    rows = conversations.scored_steps(spark, sf_dir).where("bucket is not null").join(prompts, "eval_id")
    sheet = rows.select(F.col("eval_id").cast("string").alias("step_id"), F.col("bucket").alias("auto_bucket"), F.lit(None).cast("string").alias("human_bucket"), F.array_join("reference_tools", ",").alias("reference_tools"), F.col("prompt").alias("completion"), steps.tail(F.col("prompt")).alias("context"))
    sinks.write_label_sheet(sheet, path)
    back = readers.label_sheet(spark, path)
    return back.select(F.col("step_id").cast("bigint").alias("eval_id"), "auto_bucket", F.length("completion").alias("chars"), F.md5(F.coalesce("completion", F.lit("")).cast("binary")).alias("hash"))


def training_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of won episodes as an ordered file, and its manifest."""
    won = conversations._episodes(spark, sf_dir).where(F.col("reward") == F.lit(1.0))
    counts = turns.decisions(won).groupBy("episode_id").agg(F.count("*").alias("n_decisions"), F.max("chars_before").alias("chars"))
    rows = won.select("episode_id", F.coalesce(whole_number(F.col("task_id")).cast("string"), F.lit("")).alias("task_id"), "rep").join(counts, "episode_id", "left").select("episode_id", "task_id", "rep", "n_decisions", "chars")
    manifest = sinks.write_with_manifest(rows, new_path(spark, "training"), ["episode_id"], sinks.training_counts(), parts=1)
    fields = [manifest[k] for k in ("n", "n_decisions", "n_tasks", "max_chars", "hash")] + [",".join(manifest["task_ids"])]
    return spark.createDataFrame([fields], "n bigint, n_decisions bigint, n_tasks bigint, max_chars bigint, hash string, task_ids string")


def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of won runs of each label and catalog as the lines of a table in Markdown."""
    rows = table(spark, sf_dir, "free_log").groupBy(stats.run_label(F.col("config_name")).alias("label"), F.concat(F.lit("c"), F.col("catalog").cast("string")).alias("catalog"))
    rates = rows.agg(F.avg((F.coalesce("reward", F.lit(0.0)) == 1.0).cast("double")).alias("rate")).where("label is not null")
    text = sinks.markdown(rates, "label", "catalog", "rate", ["c16", "c40", "c80"])
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line int, text string")


def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Won runs of each label as a summary in JSON, read back."""
    path = f"{new_path(spark, 'summary')}.json"
    rows = table(spark, sf_dir, "free_log").groupBy(stats.run_label(F.col("config_name")).alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("reward") == 1.0).alias("n_won"))
    sinks.write_summary(rows, path)
    return spark.read.schema("label string, n bigint, n_won bigint").option("multiLine", True).json(path)


def config_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of sources as a configuration, its larger ones doubled by one that extends it."""
    rows = table(spark, sf_dir, "mix_targets").select("source", "weight", "max_repeats").collect()  # a fixed table of a few rows
    folder = new_path(spark, "configs")
    files = {
        "base.json": {"weights": {r.source: r.weight for r in rows}, "repeats": {r.source: [r.max_repeats] for r in rows}},
        "doubled.json": {"weights": {r.source: 2 * r.weight for r in rows if r.weight > 5}},
        "top.json": {"extends": ["base.json", "doubled.json"], "repeats": {r.source: [0] for r in rows if r.max_repeats == 1}},
    }
    for name, body in files.items():
        write_text(spark, f"{folder}/{name}", json.dumps(body))
    found = readers.config(f"{folder}/top.json", spark=spark)
    return spark.createDataFrame([(s, float(w), int(found["repeats"][s][0])) for s, w in found["weights"].items()], "source string, weight double, max_repeats int")


ALL = [log_round_trip, strict_scan, cells_by_file, forced_scan, trajectory_scan, function_scan, pinned_catalog, label_sheet, training_manifest, markdown_report, summary_file, config_scan]
QUERIES = {f.__name__: f for f in ALL}

_LABEL = "CASE WHEN len(string_split(config_name, ':')) >= 2 THEN string_split(config_name, ':')[2] ELSE config_name END"
_TASK = "CASE WHEN regexp_full_match(trim(task_id), '[0-9]{1,18}') THEN CAST(trim(task_id) AS BIGINT) END"
_FILE = "replace(config_name, ':', '-') || '.jsonl'"
_NAME = r"'^free-(.+?)(?:-esc([0-9.]+))?-c(\d+)\.jsonl$'"

ORACLES = {
    "summary_file": f"SELECT {_LABEL} AS label, count(*) AS n, count(*) FILTER (reward = 1.0) AS n_won FROM free_log GROUP BY 1",
    "config_scan": "SELECT source, CASE WHEN weight > 5 THEN 2 * weight ELSE weight END AS weight, CASE WHEN max_repeats = 1 THEN 0 ELSE max_repeats END AS max_repeats FROM mix_targets",
    "log_round_trip": "SELECT seed, count(*) AS n, count(*) FILTER (reward = 1.0) AS n_won, sum(n_messages)::bigint AS n_messages, count(task_id) AS n_tasks, count(*) AS n_stamped FROM free_log GROUP BY 1",
    "strict_scan": "SELECT rep, count(*) AS n, sum(length(prompt))::bigint AS chars, sum(len(prior_calls))::bigint AS n_decisions FROM train_states GROUP BY 1",
    "cells_by_file": f"""
        WITH f AS (SELECT {_FILE} AS f, catalog FROM free_log WHERE config_name IS NOT NULL AND seed IS DISTINCT FROM 4)
        SELECT regexp_extract(f, {_NAME}, 1) AS file_label, try_cast(nullif(regexp_extract(f, {_NAME}, 2), '') AS double) AS file_threshold, regexp_extract(f, {_NAME}, 3)::int AS file_catalog, count(*) AS n, sum(catalog)::bigint AS catalogs FROM f WHERE regexp_matches(f, {_NAME}) GROUP BY 1, 2, 3""",
    "forced_scan": "SELECT 'forced-c' || rep || '.jsonl' AS file, count(*) AS n, sum(step_index)::bigint AS indexes FROM eval_steps WHERE rep IS NOT NULL GROUP BY 1",
    "trajectory_scan": """
        SELECT episode_id, reward, len(messages)::int AS n_messages FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_file, task_id ORDER BY reward IS NULL, episode_id) AS rn FROM episodes WHERE trajectory_file IS NOT NULL AND task_id IS NOT NULL) WHERE rn = 1 AND reward IS NOT NULL""",
    "function_scan": """
        WITH d AS (SELECT 0 AS g, p_partkey AS k, 0 AS i, replace(p_type, ' ', '.') AS name, p_size FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 1, p_partkey, 0, 'list ' || replace(p_type, ' ', '.'), p_size FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 1, p_partkey, 1, replace(p_type, ' ', '.'), p_size FROM part WHERE p_partkey % 3 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') ORDER BY g, k, i) AS rn FROM d)
        SELECT regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g')[:64] AS name, '{"properties":{"a":{"type":"' || CASE WHEN p_size > 25 THEN 'number' ELSE 'object' END || '"}},"type":"object"}' AS schema, g = 1 AS of_turns FROM r WHERE rn = 1""",
    "pinned_catalog": f"""
        WITH c(name, ordinal, own) AS (VALUES {", ".join(f"('{n}', {i}, {str(n in NATIVE).lower()})" for i, n in enumerate(CATALOG))}), u AS (SELECT name, count(*) AS n FROM (SELECT unnest({conversations._NAMES}) AS name FROM ({conversations._MESSAGES})) GROUP BY 1)
        SELECT c.name, ordinal, own, coalesce(n, 0) AS n FROM c LEFT JOIN u ON c.name = u.name""",
    "label_sheet": f"SELECT x.eval_id, bucket AS auto_bucket, CASE WHEN prompt <> '' THEN length(prompt[:1500]) END AS chars, md5(coalesce(prompt[:1500], '')) AS hash FROM (SELECT eval_id, {conversations._BUCKET} AS bucket FROM ({conversations._scored()})) x JOIN eval_steps e ON e.eval_id = x.eval_id WHERE bucket IS NOT NULL",
    "training_manifest": f"""
        WITH d AS (SELECT episode_id, count(*) AS n_decisions, max(chars_before) AS chars FROM ({conversations.ORACLES["decision_steps"]}) GROUP BY 1),
        r AS (SELECT e.episode_id, coalesce(({_TASK})::varchar, '') AS task_id, rep, n_decisions, chars FROM episodes e LEFT JOIN d ON d.episode_id = e.episode_id WHERE reward = 1.0),
        l AS (SELECT *, '{{"episode_id":' || episode_id || ',"task_id":"' || task_id || '"' || coalesce(',"rep":' || rep, '') || coalesce(',"n_decisions":' || n_decisions, '') || coalesce(',"chars":' || chars, '') || '}}' || chr(10) AS line FROM r)
        SELECT count(*) AS n, coalesce(sum(n_decisions), 0)::bigint AS n_decisions, count(DISTINCT task_id) AS n_tasks, coalesce(max(chars), 0)::bigint AS max_chars, sha256(string_agg(line, '' ORDER BY episode_id)) AS hash,
            (SELECT string_agg(task_id, ',' ORDER BY length(task_id), task_id) FROM (SELECT DISTINCT task_id FROM r)) AS task_ids FROM l""",
    "markdown_report": f"""
        WITH r AS (SELECT {_LABEL} AS label, catalog AS c, round(100 * avg((coalesce(reward, 0) = 1.0)::int::double), 1) AS p FROM free_log GROUP BY 1, 2), q AS (SELECT label, {", ".join(f"coalesce(format('{{:.1f}} %', max(p) FILTER (c = {c})), 'n/a') AS c{c}" for c in (16, 40, 80))} FROM r WHERE label IS NOT NULL GROUP BY 1)
        SELECT (row_number() OVER (ORDER BY label) + 1)::int AS line, '| ' || label || ' | ' || c16 || ' | ' || c40 || ' | ' || c80 || ' |' AS text FROM q UNION ALL VALUES (0, '| label | c16 | c40 | c80 |'), (1, '|---|---|---|---|')""",
}
