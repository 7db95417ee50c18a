"""Queries of rules that must hold, of joins that must be complete, and of orders and names."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions import canon
from evalspark.functions.text import folded, label, strip, whole_number
from evalspark.operators import catalogs, compare, invariants, reward, sampling, stats, steps, turns
from evalspark.plans import conversations
from evalspark.plans.conversations import CATALOG, NATIVE, SCHEMAS
from evalspark.plans.tables import table
from evalspark.streaming import runlog

GREETING = "Good day, this is the order desk. What can I do for you?"


def identity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the identity the log's first delivery has, smoke runs left out, by repetition; the identity as prefix of 12."""
    log = table(spark, sf_dir, "free_log")
    first = log.where("config_fingerprint is not null").agg(F.min_by(F.substring("config_fingerprint", 1, 12), "delivery_id").alias("_fp"))
    rows = stats.identity_rows(log.join(F.broadcast(first)), F.col("_fp"))  # one row
    return rows.groupBy("_fp", "seed").agg(F.count("*").alias("n"), F.count_if(F.col("reward") == F.lit(1.0)).alias("n_won")).withColumnRenamed("_fp", "identity")


def greeting_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that don't begin with the desk's greeting."""
    return invariants.wrong_greeting(turns.messages(conversations._episodes(spark, sf_dir)), GREETING).select("episode_id", "role")


def complete_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins in which no row may lack a partner, or have two: line items and orders, orders and customers, stock and regions."""
    t = functools.partial(table, spark, sf_dir)
    joins = [
        ("lineitem", t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v")), t("orders").select(F.col("o_orderkey").alias("k"))),
        ("orders", t("orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v")), t("customer").select(F.col("c_custkey").alias("k"))),
        ("customer", t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v")), t("nation").select(F.col("n_nationkey").alias("k"))),
    ]
    counted = []
    for name, left, right in joins:
        met = invariants.complete_join(left, right, ["k"]).agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))
        twice = invariants.duplicates(right, ["k"]).agg(F.count("*").alias("n_twice"))
        counted.append(met.join(F.broadcast(twice)).select(F.lit(name).alias("name"), "n", "total", "n_twice"))  # one row each
    return functools.reduce(DataFrame.unionByName, counted)


def step_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of both sides that share a step id: how many eval steps have a completion, how many lack one, which ids occur twice."""
    key = strip(F.col("step_id")).alias("step")
    left, right = (table(spark, sf_dir, n).select(key).where("step is not null") for n in ("eval_steps", "train_states"))
    known = right.distinct().withColumn("there", F.lit(True))
    joined = left.join(known, "step", "left").agg(F.count("there").alias("n_found"), F.count_if(F.col("there").isNull()).alias("n_missing"))
    return joined.join(F.broadcast(invariants.duplicates(right, ["step"]).agg(F.count("*").alias("n_twice"))))


def sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether episodes that both sides have hold the same steps in the same order."""
    sides = [table(spark, sf_dir, n).select(whole_number(F.col("task_id")).alias("task"), "rep", "step_index", strip(F.col("step_id")).alias("step")).where("task is not null and rep is not null and step_index is not null and step is not null") for n in ("eval_steps", "train_states")]
    return compare.step_sequences(*sides, ["task", "rep"], "step", "step_index")


def empty_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sides of the split are empty: none may be."""
    return invariants.empty_sides({n: table(spark, sf_dir, n).select("task_id") for n in ("eval_steps", "train_states", "tasks")})


def registered_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents looked up by hash in a registry of those in English, by whether they are registered."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    found = steps.parent_of(docs.select("doc_id", "sha"), docs.where("lang = 'en'").select("sha", F.col("doc_id").alias("name")), "sha", "name")
    return found.groupBy((F.col("parent") == F.col("doc_id")).alias("own")).agg(F.count("*").alias("n"), F.count("parent").alias("n_registered"), F.sum("parent").alias("parents"))


def straddling_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of seven characters that lie across the edge of a trained span, by episode."""
    spans = turns.segments(conversations._episodes(spark, sf_dir)).select("episode_id", "train", "start", "end")
    length = spans.groupBy("episode_id").agg(F.max("end").alias("chars"))
    tokens = length.select("episode_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chars") - 1, F.lit(7).cast("bigint"))).alias("start")).withColumn("end", F.col("start") + 7)
    return turns.straddling(tokens, spans).groupBy("episode_id").agg(F.countDistinct("start").alias("n"))


def id_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the tasks in the three orders of ids: as text, by length and text, numbers first."""
    ids = table(spark, sf_dir, "tasks").select(strip(F.col("task_id")).alias("id")).where("id is not null").distinct()
    keyed = ids.select("id", F.struct(F.length("id").alias("a"), F.col("id").alias("b")).alias("length"), F.struct(*(c.alias(n) for c, n in zip(steps.numbers_first(F.col("id")), "ab", strict=True))).alias("number"))
    return steps.places(keyed, {"as_text": "id", "by_length": "length", "numbers_first": "number"}).select("id", "as_text", "by_length", "numbers_first")


def episode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of episodes by task as text, repetition and id."""
    rows = table(spark, sf_dir, "episodes").where("task_id is not null and rep is not null").select("episode_id", F.struct(strip(F.col("task_id")).alias("task"), "rep", "episode_id").alias("key"))
    return steps.places(rows, {"place": "key"}).select("episode_id", "place")


def epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes over the customers, one order after another, with slots as order keys."""
    size = table(spark, sf_dir, "customer").agg((F.count("*") * 5 / 2).cast("bigint").alias("n"))
    slots = size.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("slot"))
    return sampling.epoch_order(slots, "slot", table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", seed=11)


def nested_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogs of growing size from the tools that are called: which smaller ones aren't part of the next."""
    calls = turns.messages(conversations._episodes(spark, sf_dir)).select(F.explode(turns.calls(F.col("tool_calls"))).alias("c"))
    names = calls.select(F.col("c.name").alias("name")).where("name is not null").distinct().withColumn("description", F.regexp_replace("name", "_", " "))
    native = spark.createDataFrame([(n, n.replace("_", " ")) for n in NATIVE], "name string, description string")
    scored = catalogs.likeness(names, native)
    sizes = [catalogs.ranked(scored, n).select("name") for n in (4, 8, 16)]
    rules = [(f"{a} in {b}", invariants.stray(x, y, "name"), y) for (a, x), (b, y) in (((4, sizes[0]), (8, sizes[1])), ((8, sizes[1]), (16, sizes[2])))]
    counted = [broken.agg(F.count("*").alias("n_stray")).select(F.lit(rule).alias("rule"), "n_stray").join(F.broadcast(whole.agg(F.count("*").alias("n")))) for rule, broken, whole in rules]
    return functools.reduce(DataFrame.unionByName, counted)


def slot_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign patterns of embeddings served by pools of three caches, a pool for each label."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("ids"))
    return steps.slot_choices(rows, "label", "vec_id", "ids", 3)


def run_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each catalog the run that is compared: the sft one if there is one, else zero-shot; both labels must exist."""
    kind = F.when(F.col("config_name").contains("sft"), "sft").when(F.col("config_name").contains("zeroshot"), "zeroshot")
    rows = table(spark, sf_dir, "free_log").select("catalog", "backend", kind.alias("label")).where("label is not null")
    return compare.base_of(compare.chosen_runs(rows, "label", ["sft", "zeroshot"]), "sft", "zeroshot", ["catalog", "backend"])


def last_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trajectory file with the highest batch of each configuration, batches taken as checkpoints."""
    rows = table(spark, sf_dir, "free_log").select("config_name", F.regexp_replace("trajectory_file", r"\.json$", "").alias("path"))
    return invariants.latest_checkpoint(rows, ["config_name"], "path").select("config_name", F.regexp_extract("path", r"(\d+)$", 1).cast("bigint").alias("number"))


def rebuilt_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior calls of the training states as messages again."""
    rows = table(spark, sf_dir, "train_states").where("prior_calls is not null").select("state_id", steps.rebuilt_context(F.filter("prior_calls", lambda c: c.isNotNull())).alias("m"))
    return rows.select("state_id", F.size("m").alias("n_messages"), F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(":"), m["tool_calls"][0]["name"])), ",").alias("calls"))


def longest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest documents over 2000 characters, which a guard of 2000 would name."""
    return steps.longest_over(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars")), "doc_id", "chars", 2000)


def aligned_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and their prompts with an answer behind, as characters in place of tokens: the one must begin the other."""
    ids = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("lang", ids(F.substring("text", 1, 40)).alias("a"), ids(F.concat(F.substring("text", 1, 30), F.lit("x"), F.substring("text", 31, 80))).alias("b"))
    return rows.groupBy("lang").agg(F.count_if(steps.is_prefix(F.col("a"), F.col("b"))).alias("n_aligned"), F.count("*").alias("n"))


def option_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of suppliers as `name=repository` options."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", steps.options(F.array(F.concat(F.lit("name="), "s_name"), F.concat(F.lit("key="), F.col("s_suppkey"), F.lit("=x")))).alias("o"))
    return rows.select("s_suppkey", F.col("o")["name"].alias("name"), F.col("o")["key"].alias("key"))


def next_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in order up to the first that hasn't 20 cells of the first two repetitions done."""
    log = table(spark, sf_dir, "free_log").select(stats.run_label(F.col("config_name")).alias("label"), whole_number(F.col("task_id")).alias("task_id"), "seed").where("task_id is not null")
    return runlog.incomplete_first(runlog.progress(log, ["label"], 2), "label", 20)


def unlogged_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the log that ended and those that failed, which stay unlogged so that they are tried again, by repetition."""
    rows = table(spark, sf_dir, "free_log").select(folded(F.col("config_fingerprint")).alias("config_fingerprint"), whole_number(F.col("task_id")).alias("task_id"), "seed", "reward").where("config_fingerprint is not null and task_id is not null")
    done = runlog.logged(rows, F.col("reward").isNotNull())
    again = rows.select(*runlog.KEY).distinct().join(done.select(*runlog.KEY).distinct(), runlog.KEY, "left_anti")
    return done.groupBy("seed").agg(F.count("*").alias("n_logged")).join(again.groupBy("seed").agg(F.count("*").alias("n_again")), "seed", "full_outer").na.fill(0, ["n_logged", "n_again"])


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What request caps permit a day, and what an episode may need at worst."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") > 4, F.col("c_custkey") * 10).alias("cap"), F.col("c_nationkey").alias("turns"))
    return rows.select("c_custkey", F.round(reward.episodes_per_day(F.col("cap")), 6).alias("per_day"), reward.worst_case(F.col("turns")).alias("worst"))


def token_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys read back from `token_id:<n>`."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("token_id:"), F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))).alias("t"))
    return rows.select("o_orderkey", steps.token_number(F.col("t")).alias("number"))


def batch_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each batch file of the log."""
    rows = table(spark, sf_dir, "free_log").groupBy("batch_file").agg(F.max("seed").alias("rep"), F.count("*").cast("int").alias("n"))
    return rows.select("batch_file", steps.batch_path(F.lit("runs"), F.regexp_replace("batch_file", r"\.jsonl$", ""), F.col("rep"), F.col("n")).alias("path"))


def canonical_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of all calls in canonical form with their hashes: strict and normal ones, and those that can't be read."""
    rows = turns.messages(conversations._episodes(spark, sf_dir)).select("episode_id", "pos", F.posexplode(turns.calls(F.col("tool_calls"))).alias("i", "c"))
    read = rows.select("episode_id", "pos", "i", canon.canonical_json(F.col("c.arguments")).alias("text"), canon.normal_args(F.col("c.arguments")).alias("normal"))
    return read.select("episode_id", "pos", "i", F.substring(F.sha2("text", 256), 1, 12).alias("hash"), (F.col("text") == F.col("normal")).alias("plain"))


def catalog_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools of the test data as they stand in a prompt, with how often each is called."""
    rows = spark.createDataFrame([(n, catalogs.tool_text({"name": n, "parameters": SCHEMAS[n]})) for n in CATALOG], "name string, text string")
    used = turns.messages(conversations._episodes(spark, sf_dir)).select(F.explode(turns.call_names(F.col("tool_calls"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return rows.join(used, "name", "left").na.fill(0, ["n"])


def plain_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter schema of each part in another dialect, made plain."""
    kind = F.element_at(F.array(*map(F.lit, ("dict", "float", "tuple", "int", "any", "String"))), F.pmod(F.col("p_partkey"), F.lit(6)).cast("int") + 1)
    doc = F.to_json(F.struct(F.lit("dict").alias("type"), F.lit(1).alias("x"), F.struct(F.struct(kind.alias("type"), F.lit("d").alias("description"), F.lit(2).alias("format")).alias("a")).alias("properties"), F.array(F.lit("a")).alias("required")))
    return table(spark, sf_dir, "part").select("p_partkey", canon.mapped_json(catalogs.plain_schema)(doc).alias("schema"))


def guided_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether guided decoding over the catalog would have let them pass as a completion."""
    pattern = "^(?:" + catalogs.completion_pattern(CATALOG).replace(r"(.|\n)*", r"[\s\S]*") + ")$"
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.groupBy(label(F.col("source")).alias("source")).agg(F.count_if(F.col("text").rlike(pattern)).alias("n_guided"), F.count("*").alias("n"))


ALL = [
    identity_filter, greeting_check, complete_joins, step_completions, sequence_check, empty_sides, registered_parents, straddling_tokens, id_orders, episode_order, epoch_order, nested_catalogs, slot_choices, run_choice,
    last_checkpoints, rebuilt_contexts, longest_documents, aligned_prompts, option_pairs, next_cells, unlogged_failures, budgets, token_numbers, batch_paths, canonical_arguments, catalog_texts, plain_schemas, guided_documents,
]
QUERIES = {f.__name__: f for f in ALL}

_TASK = "CASE WHEN regexp_full_match(trim(task_id), '[0-9]{1,18}') THEN CAST(trim(task_id) AS BIGINT) END"
_LABEL = "CASE WHEN len(string_split(config_name, ':')) >= 2 THEN string_split(config_name, ':')[2] ELSE config_name END"
_SRC = r"nullif(regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g'), '')"
_SEQ = f"SELECT {_TASK} AS task, rep, list(trim(step_id) ORDER BY step_index, trim(step_id)) AS s FROM {{0}} WHERE {_TASK} IS NOT NULL AND rep IS NOT NULL AND step_index IS NOT NULL AND step_id IS NOT NULL GROUP BY 1, 2"
_LIKE = f"""
        c AS (SELECT DISTINCT name FROM (SELECT unnest({conversations._NAMES}) AS name FROM ({conversations._MESSAGES})) WHERE name IS NOT NULL), w AS (SELECT name, {conversations._WORDS.format("name")} AS words FROM c), n AS (SELECT list_distinct(flatten(list_transform({conversations._NATIVE}, lambda a: {conversations._WORDS.format("a")}))) AS own),
        s AS (SELECT name, row_number() OVER (ORDER BY 3.0::double * len(list_intersect(list_intersect(words, own), {catalogs.OBJECT_WORDS})) + len(list_intersect(list_intersect(words, own), {catalogs.VERB_WORDS})) + least(2.0::double, 0.5::double * len(list_intersect(list_intersect(words, own), {catalogs.OBJECT_WORDS}))) DESC, name) AS r FROM w, n)"""
# JSON with sorted keys, two levels deep, which is as deep as arguments go; and its strings without blanks around and case.
_CANON = "CASE WHEN json_type({0}) = 'OBJECT' THEN '{{' || array_to_string(list_transform(list_sort(list_distinct(json_keys({0}))), lambda k: '\"' || k || '\":' || {1}), ',') || '}}' ELSE ({0})::varchar END"
_PLAIN = r'''regexp_replace(regexp_replace(regexp_replace(lower(s), '"\s+', '"', 'g'), '\s+"', '"', 'g'), '(\d)\.0([,}\]])', '\1\2', 'g')'''

ORACLES = {
    "identity_filter": "WITH f AS (SELECT arg_min(config_fingerprint[:12], delivery_id) AS fp FROM free_log WHERE config_fingerprint IS NOT NULL) SELECT fp AS identity, seed, count(*) AS n, count(*) FILTER (reward = 1.0) AS n_won FROM free_log, f WHERE starts_with(config_fingerprint, fp) AND NOT coalesce(smoke, false) GROUP BY 1, 2",
    "greeting_check": f"SELECT episode_id, m.role AS role FROM ({conversations._MESSAGES}) WHERE pos = 0 AND NOT coalesce(m.role = 'assistant' AND m.content = '{GREETING}', false)",
    "complete_joins": """
        SELECT 'lineitem' AS name, count(*) AS n, round(sum(l_quantity), 2) AS total, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n_twice FROM lineitem
        UNION ALL SELECT 'orders', count(*), round(sum(o_totalprice), 2), (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)) FROM orders UNION ALL SELECT 'customer', count(*), round(sum(c_acctbal), 2), (SELECT count(*) FROM (SELECT n_nationkey FROM nation GROUP BY 1 HAVING count(*) > 1)) FROM customer""",
    "step_completions": """
        WITH r AS (SELECT trim(step_id) AS s, count(*) AS n FROM train_states WHERE step_id IS NOT NULL GROUP BY 1)
        SELECT count(*) FILTER (trim(step_id) IN (SELECT s FROM r)) AS n_found, count(*) FILTER (trim(step_id) NOT IN (SELECT s FROM r)) AS n_missing, (SELECT count(*) FROM r WHERE n > 1) AS n_twice FROM eval_steps WHERE step_id IS NOT NULL""",
    "sequence_check": f"SELECT count(*) FILTER (a.s = b.s) AS n_same, count(*) FILTER (a.s <> b.s) AS n_differ FROM ({_SEQ.replace('{0}', 'eval_steps')}) a JOIN ({_SEQ.replace('{0}', 'train_states')}) b ON a.task = b.task AND a.rep = b.rep",
    "empty_sides": " UNION ALL ".join(f"SELECT '{n} is empty' AS rule, 1 - (SELECT count(*) FROM (SELECT 1 FROM {n} LIMIT 1)) AS n" for n in ("eval_steps", "train_states", "tasks")),
    "registered_parents": """
        WITH d AS (SELECT doc_id, lang, sha256(text) AS sha FROM documents WHERE text IS NOT NULL), r AS (SELECT sha, min(doc_id) AS parent FROM d WHERE lang = 'en' GROUP BY 1)
        SELECT parent = doc_id AS own, count(*) AS n, count(parent) AS n_registered, sum(parent)::bigint AS parents FROM d LEFT JOIN r USING (sha) GROUP BY 1""",
    "straddling_tokens": f"""
        WITH s AS (SELECT episode_id, train, start, "end" FROM ({conversations.ORACLES["segment_spans"]})), l AS (SELECT episode_id, max("end") AS chars FROM s GROUP BY 1), t AS (SELECT episode_id, unnest(range(0, chars, 7)) AS a FROM l)
        SELECT episode_id, count(DISTINCT a) AS n FROM t JOIN s USING (episode_id) WHERE train AND a < "end" AND a + 7 > start AND (a < start OR a + 7 > "end") GROUP BY 1""",
    "id_orders": """
        WITH i AS (SELECT DISTINCT trim(task_id) AS id FROM tasks WHERE task_id IS NOT NULL)
        SELECT id, row_number() OVER (ORDER BY id) AS as_text, row_number() OVER (ORDER BY length(id), id) AS by_length, row_number() OVER (ORDER BY coalesce(CASE WHEN regexp_full_match(id, '[0-9]+') THEN try_cast(id AS int) END, 1 << 30), id) AS numbers_first FROM i""",
    "episode_order": "SELECT episode_id, row_number() OVER (ORDER BY trim(task_id), rep, episode_id) AS place FROM episodes WHERE task_id IS NOT NULL AND rep IS NOT NULL",
    "epoch_order": """
        WITH n AS (SELECT count(*) AS n FROM customer), s AS (SELECT unnest(range((n * 5) // 2)) AS slot, n FROM n), p AS (SELECT e AS epoch, row_number() OVER (PARTITION BY e ORDER BY md5((e + 11) || ':' || c_custkey), c_custkey) - 1 AS place, c_custkey FROM customer, range(3) t(e))
        SELECT slot, slot // n AS epoch, slot % n AS place, c_custkey FROM s JOIN p ON p.epoch = slot // n AND p.place = slot % n""",
    "nested_catalogs": f"WITH {_LIKE} SELECT '4 in 8' AS rule, count(*) FILTER (r <= 4 AND r > 8) AS n_stray, count(*) FILTER (r <= 8) AS n FROM s UNION ALL SELECT '8 in 16', count(*) FILTER (r <= 8 AND r > 16), count(*) FILTER (r <= 16) FROM s",
    "run_choice": "SELECT catalog, backend, CASE WHEN bool_or(contains(config_name, 'sft')) THEN 'sft' ELSE 'zeroshot' END AS base FROM free_log WHERE contains(config_name, 'sft') OR contains(config_name, 'zeroshot') GROUP BY 1, 2",
    "last_checkpoints": "SELECT config_name, max(nullif(regexp_extract(trajectory_file, '(\\d+)\\.json$', 1), '')::bigint) AS number FROM free_log WHERE regexp_matches(trajectory_file, '\\d\\.json$') GROUP BY 1",
    "rebuilt_contexts": "SELECT state_id, len(c)::int AS n_messages, array_to_string(list_filter(list_transform(c, lambda x: 'assistant:' || x.name), lambda x: x IS NOT NULL), ',') AS calls FROM (SELECT state_id, list_filter(prior_calls, lambda x: x IS NOT NULL) AS c FROM train_states WHERE prior_calls IS NOT NULL)",
    "longest_documents": "SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) > 2000 ORDER BY chars DESC, doc_id LIMIT 5",
    "aligned_prompts": "SELECT lang, count(*) FILTER (starts_with(text[:30] || 'x' || text[31:110], text[:40])) AS n_aligned, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "option_pairs": "SELECT s_suppkey, s_name AS name, s_suppkey || '=x' AS key FROM supplier",
    "next_cells": f"""
        WITH d AS (SELECT label, count(*) AS done FROM (SELECT DISTINCT {_LABEL} AS label, {_TASK} AS t, seed FROM free_log WHERE seed < 2 AND {_TASK} IS NOT NULL) GROUP BY 1), s AS (SELECT min(label) AS stop FROM d WHERE done < 20)
        SELECT label, done FROM d, s WHERE stop IS NULL OR label <= stop""",
    "unlogged_failures": f"""
        WITH r AS (SELECT lower(trim(config_fingerprint, E' \\t\\n')) AS f, {_TASK} AS t, seed, reward FROM free_log WHERE config_fingerprint IS NOT NULL AND {_TASK} IS NOT NULL), c AS (SELECT f, t, seed, bool_or(reward IS NOT NULL) AS ok, count(reward) AS n FROM r GROUP BY ALL)
        SELECT seed, sum(n)::bigint AS n_logged, count(*) FILTER (NOT ok AND seed IS NOT NULL) + count(*) FILTER (seed IS NULL AND NOT ok) AS n_again FROM c GROUP BY 1""",
    "budgets": "SELECT c_custkey, round(CASE WHEN c_nationkey > 4 THEN c_custkey * 10 / 8::double END, 6) AS per_day, c_nationkey * 2 + 2 AS worst FROM customer",
    "token_numbers": "SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN -o_orderkey ELSE o_orderkey END)::int AS number FROM orders",
    "batch_paths": "SELECT batch_file, printf('runs/rep%d-%s-batch%03d.json', max(seed), regexp_replace(batch_file, '\\.jsonl$', ''), count(*)::int) AS path FROM free_log GROUP BY 1",
    "canonical_arguments": f"""
        WITH c AS (SELECT episode_id, pos, j - 1 AS i, ({conversations._CALLS})[j].arguments AS t FROM ({conversations._MESSAGES}), unnest(range(1, len({conversations._CALLS}) + 1)) AS u(j)),
        a AS (SELECT *, try_cast(t AS json) AS a FROM c), k AS (SELECT *, {_CANON.format("a", "{inner}").replace("{inner}", _CANON.format("(a->k)", "(a->k->k2)::varchar").replace("lambda k:", "lambda k2:").replace("|| k ||", "|| k2 ||"))} AS s FROM a)
        SELECT episode_id, pos, i::int AS i, sha256(s)[:12] AS hash, s = {_PLAIN} AS plain FROM k""",
    "catalog_texts": f"""
        WITH t(name, text) AS (VALUES {", ".join(f"('{n}', '{n}(' || '{', '.join(a + ('' if a in s['required'] else '?') + ': ' + (p['type'] + '[any]' if p['type'] == 'array' else p['type']) for a, p in s['properties'].items())}' || ')')" for n, s in SCHEMAS.items())}),
        u AS (SELECT name, count(*) AS n FROM (SELECT unnest({conversations._NAMES}) AS name FROM ({conversations._MESSAGES})) GROUP BY 1)
        SELECT t.name, text, coalesce(n, 0) AS n FROM t LEFT JOIN u ON t.name = u.name""",
    "plain_schemas": """
        SELECT p_partkey, '{"properties":{"a":{"description":"d"' || CASE p_partkey % 6 WHEN 0 THEN ',"type":"object"' WHEN 1 THEN ',"type":"number"' WHEN 2 THEN ',"type":"array"' WHEN 3 THEN ',"type":"integer"' WHEN 4 THEN '' ELSE ',"type":"string"' END || '}},"required":["a"],"type":"object"}' AS schema FROM part""",
    "guided_documents": f"""
        WITH d AS (SELECT {_SRC} AS source, text, '<tool_call>\\n\\{{"name": ("{'"|"'.join(CATALOG)}"), "arguments": \\{{[^\\n]*\\}}\\}}\\n</tool_call>' AS b FROM documents WHERE text IS NOT NULL)
        SELECT source, count(*) FILTER (text <> '' AND (NOT starts_with(text, '<') OR regexp_full_match(text, b || '(\\n' || b || ')*'))) AS n_guided, count(*) AS n FROM d GROUP BY 1""",
}
