"""Queries over served and scored completions: confidences, responses, streams, load levels, prompts, catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions import canon
from evalspark.functions.text import label, strip
from evalspark.operators import catalogs, datacard, escalation, latency, reward, scoring, stats, steps, turns
from evalspark.plans import conversations
from evalspark.plans.conversations import CATALOG, NATIVE, SCHEMAS
from evalspark.plans.runs import rounded
from evalspark.plans.tables import table

# The system turn of the test data's desk, as the engine renders it.
POLICY = "You are the agent of an order desk."
TOOLS = [{"name": name, "description": name.replace("_", " "), "parameters": SCHEMAS[name]} for name in CATALOG]
SYSTEM = catalogs.system_text(POLICY, TOOLS)
CHUNK = 4  # characters a token of the invented tokenizer has


def _completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state_id, source, text): the action of every training state as if it had been generated."""
    rows = table(spark, sf_dir, "train_states").select("state_id", label(F.col("source")).alias("source"), F.col("reference").alias("r")).where("r is not null")
    said = F.when(F.col("r.kind") == "reply", F.col("r.text")).otherwise(canon.rendered_calls(F.col("r.calls")))
    return rows.select("state_id", "source", F.concat(said, F.lit(turns.IM_END)).alias("text"), "r").where("text is not null")


def step_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure each action would be with tokens of four characters and invented log-probabilities."""
    rows = _completions(spark, sf_dir).select("state_id", F.substring_index("text", turns.IM_END, 1).alias("said"))
    rows = rows.select("*", canon.parse_completion("said").alias("p"), canon.called_spans("said").alias("spans"), F.greatest(F.lit(1), F.ceil(F.length("said") / CHUNK)).cast("int").alias("n"))
    starts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i * CHUNK)
    lps = F.transform(starts, lambda s: -(F.pmod(s + F.col("state_id"), F.lit(10)) / 10))
    tops = F.when(F.col("state_id") % 7 != 0, F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((F.col("state_id") % 3 + i).cast("int").alias("id"), (-(i + 1) / 4.0).alias("lp"))))
    found = escalation.step_confidence(F.col("p.kind"), F.transform("p.calls", lambda c: c["name"]), F.col("spans"), lps, starts, F.transform(starts, lambda s: s + CHUNK), tops, 1)
    return rounded(rows.select("state_id", found.alias("c")).select("state_id", "c.*"), "name_confidence", "p_call", "step_confidence")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both signals held against a threshold, and what is kept of the routed turns, by source."""
    rows = step_confidence(spark, sf_dir).join(table(spark, sf_dir, "train_states").select("state_id", label(F.col("source")).alias("source")), "state_id")
    sent = escalation.routed(0.8, F.lit(True), F.col("step_confidence"), F.lit(None).cast("string"))
    rows = rows.select("source", sent.alias("r"), escalation.signal(F.col("kind"), F.col("name_confidence"), F.col("step_confidence"), "name_only").alias("name"), escalation.signal(F.col("kind"), F.col("name_confidence"), F.col("step_confidence"), "step").alias("step"))
    found = rows.groupBy("source", "r.route_reason").agg(F.count("*").alias("n"), F.count_if("r.escalated").alias("n_escalated"), F.avg("name").alias("name_signal"), F.avg("step").alias("step_signal"))
    return rounded(found, "name_signal", "step_signal")


def measured_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep over the eval steps that have a confidence (an invented one, for two of three)."""
    known = table(spark, sf_dir, "eval_steps").where("eval_id % 3 <> 0").select("eval_id", (F.pmod(F.col("eval_id") * 37, F.lit(100)) / 100).alias("signal"))
    rows = conversations.scored_steps(spark, sf_dir).select("eval_id", "source", F.when(F.col("reference_kind") == "reply", F.col("kind_match")).otherwise(F.col("normalized_match")).alias("right"))
    found = escalation.sweep(escalation.measured(rows, known, "eval_id"), [0.25, 0.5, 0.75], ["source"])
    return rounded(found, "accuracy_before", "escalation_rate", "accuracy_after", "mistakes_caught", "wasted_escalations")


def response_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as served responses: their numbers as log-probabilities of tokens named by place."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: -F.abs(F.round(x.cast("double"), 6))).alias("v"))
    name = lambda i: F.concat(F.lit("token_id:"), i.cast("string"))
    tops = F.array(F.map_from_entries(F.transform(F.slice("v", 1, 5), lambda x, i: F.struct(name(i), x))))
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("t"), F.col("vec_id")).alias("text"), F.struct(F.transform("v", lambda x, i: name(i)).alias("tokens"), F.col("v").alias("token_logprobs"), tops.alias("top_logprobs")).alias("logprobs"))).alias("choices")))
    read = vectors.select("vec_id", body.alias("body")).select("vec_id", escalation.response_scores(F.col("body")).alias("r"))
    tables = F.transform("r.token_ids", lambda i: F.create_map(i, F.lit(0.5), i + 1, F.lit(0.25)))
    emitted = F.aggregate(escalation.emitted_logprobs(F.col("r.token_ids"), tables), F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate("r.token_logprobs", F.lit(0.0), lambda a, x: a + x)
    return read.select("vec_id", "r.text", F.size("r.token_ids").alias("n_tokens"), F.round(total, 4).alias("logprob"), F.size("r.first").alias("n_first"), F.round(F.array_max(F.transform("r.first", lambda x: x["lp"])), 6).alias("best"), emitted.alias("emitted"))


def served_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of a load level: value is the latency, a quarter of it the time to the first token."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select("event_type", "value", F.when(k % 5 != 0, F.col("value") / 4).alias("first"), k.alias("tokens"), (F.col("value") > 1).alias("ok"), F.lit(60.0).alias("wall"))
    rows = rows.withColumn("first", F.when(F.col("ok"), F.col("first")))
    return latency.served_levels(rows, ["event_type"], "value", "first", "tokens", "ok", "wall")


def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as the chunks of one stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")).alias("text"), k.alias("usage"))
    return latency.streamed(rows, "user_id", "event_id", "text", "usage")


def prompt_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt before every decision of the episodes, as length and hash."""
    found = turns.prompt_states(conversations._episodes(spark, sf_dir), SYSTEM)
    return found.select("episode_id", "pos", F.length("prompt").alias("chars"), F.md5(F.col("prompt").cast("binary")).alias("hash"))


def template_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all configurations of the log were written with one template: here each name with its fingerprints, and the live template's hash."""
    rows = table(spark, sf_dir, "free_log").groupBy("config_name").agg(F.countDistinct(F.lower(strip(F.col("config_fingerprint")))).alias("n_fingerprints"))
    golden = spark.createDataFrame([(1, "1", 0, [("assistant", "Hello.", None, None, 0, None, None), ("user", "stop it", None, None, 1, None, None), ("assistant", None, [("c", "stop_order", '{"order_id": "#1"}')], None, 2, None, None), ("tool", "done", None, None, 3, None, None), ("assistant", " Done. ", None, None, 4, None, None)])], f"episode_id bigint, task_id string, rep int, messages {table(spark, sf_dir, 'episodes').schema['messages'].dataType.simpleString()}")
    live = turns.prompt_states(golden, SYSTEM).where("pos = 4").select(F.sha2("prompt", 256).alias("template"))
    return rows.join(F.broadcast(live)).select("config_name", "n_fingerprints", "template")  # one row


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns.histories(conversations._episodes(spark, sf_dir))
    calls = F.transform("history", lambda m: F.size(F.coalesce(m["tool_calls"], F.array().cast("array<struct<name:string,arguments:string>>"))))
    return found.select("episode_id", F.size("history").alias("n_messages"), F.array_join(F.transform(calls, lambda n: n.cast("string")), ",").alias("calls"), F.array_join(F.transform("history", lambda m: m["role"]), ",").alias("roles")).where("n_messages >= 0")


def review_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as a reviewer reads it, as length and hash."""
    rows = turns.messages(conversations._episodes(spark, sf_dir))
    text = turns.review_turn(F.col("role"), F.col("content"), F.col("tool_calls"))
    return rows.select("episode_id", "pos", F.length(text).alias("chars"), F.md5(text.cast("binary")).alias("hash"))


def served_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as completions of a turn: what is executed, what is said, who answered, by kind."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", canon.parse_completion(F.coalesce("text", F.lit(""))).alias("p"))
    overflow = F.col("doc_id") % 50 == 0
    turn = steps.served_turn(F.col("p"), F.col("text"), overflow, "I can't go on.")
    rows = rows.select(steps.student_action(F.col("p")).alias("a"), turn.alias("t"), steps.answered_by(overflow, F.when(F.col("doc_id") % 100 != 0, "x")).alias("by"))
    return rows.groupBy("a.kind", "by").agg(F.count("*").alias("n"), F.sum(F.length("t.content")).alias("chars"), F.count_if(F.col("t.content") == steps.EMPTY_REPLY).alias("n_empty"), F.sum(F.size("t.calls")).alias("n_calls"))


def self_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's own actions, rendered, read back and scored against it: every call step must agree."""
    rows = _completions(spark, sf_dir).select("state_id", "source", "r", canon.parse_completion("text").alias("p"))
    columns = rows.select("state_id", "source", F.col("r.kind").alias("reference_kind"), canon.canonical_calls(F.col("r.calls")).alias("reference_calls"), F.col("p.kind").alias("predicted_kind"), F.col("p.calls").alias("predicted_calls"))
    scored = scoring.score(columns, CATALOG)
    return scored.groupBy("source").agg(F.count("*").alias("n"), F.count_if("kind_match").alias("n_kind"), F.count_if("strict_match").alias("n_strict"))


def data_card_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of prompts and of episodes in estimated tokens, with the share over each limit."""
    prompts = stats.token_counts(table(spark, sf_dir, "train_states"), "prompt").select(F.lit("prompt").alias("what"), "tokens")
    whole = turns.merged_turns(conversations._episodes(spark, sf_dir)).groupBy("episode_id").agg(F.sum(F.length(turns.turn_text(F.col("role"), F.col("text")))).alias("chars"))
    episodes = whole.select(F.lit("episode").alias("what"), F.rint(F.col("chars") / F.lit(3.5)).cast("bigint").alias("tokens"))
    found = datacard.sizes(prompts.unionByName(episodes), "what", "tokens")
    return found


def label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of the first prediction against those of the last, as if a person had labelled two thirds of the steps."""
    auto = conversations.scored_steps(spark, sf_dir).select("eval_id", F.col("bucket").alias("auto_bucket")).where("auto_bucket is not null")
    human = conversations.scored_steps(spark, sf_dir, "last").select("eval_id", F.when(F.col("eval_id") % 3 != 0, F.coalesce("bucket", F.lit("malformed_output"))).otherwise(F.lit(" ")).alias("human_bucket"))
    found = steps.label_agreement(auto.join(human, "eval_id"))
    return rounded(found, "agreement")


def drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the call rate of a configuration's later runs ran away from that of the eval steps."""
    teacher = table(spark, sf_dir, "eval_steps").where("reference is not null").agg(F.avg((F.col("reference.kind") == "tool_call").cast("double")).alias("teacher"))
    called = (F.col("tool_calls") > 2).cast("double")
    rows = table(spark, sf_dir, "free_log").groupBy("catalog", "backend").agg(F.avg(F.when(F.col("seed") < 2, called)).alias("before"), F.avg(F.when(F.col("seed") >= 2, called)).alias("after"))
    met = rows.join(F.broadcast(teacher))  # one row
    return met.select("catalog", "backend", reward.collapsed(F.col("before"), F.col("after"), F.col("teacher"), 0.01).alias("collapsed"))


ALL = [step_confidence, signals, measured_sweep, response_scores, served_levels, stream_chunks, prompt_states, template_hash, histories, review_turns, served_turns, self_reference, data_card_sizes, label_check, drift_check]
QUERIES = {f.__name__: f for f in ALL}

_SYS = "'" + SYSTEM.replace("'", "''") + "'"
_SRC = r"nullif(regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g'), '')"
# Rendered calls with sorted keys: the reference's arguments are flat but for `address`, and are stored as they were written.
_ARGS = "coalesce(nullif(c.arguments, ''), '{}')"
_SAID = "CASE WHEN r.kind = 'reply' THEN r.text ELSE array_to_string(list_transform(r.calls, lambda c: '<tool_call>' || chr(10) || '{\"name\": \"' || c.name || '\", \"arguments\": ' || " + _ARGS + " || '}' || chr(10) || '</tool_call>'), chr(10)) END"
_CONF = f"""
    WITH s AS (SELECT state_id, reference AS r FROM train_states WHERE reference IS NOT NULL), t AS (SELECT state_id, r, {_SAID} AS said FROM s), u AS (SELECT state_id, r, said, CASE WHEN r.kind = 'reply' AND trim(said) <> '' THEN 'reply' WHEN r.kind = 'tool_call' AND len(r.calls) > 0 THEN 'tool_call' ELSE 'unparsed' END AS kind, greatest(1, ceil(length(said) / 4.0))::int AS n FROM t WHERE said IS NOT NULL),
    v AS (SELECT *, list_transform(range(len(coalesce(r.calls, []))), lambda k: coalesce(list_sum(list_transform(range(k), lambda j: length(r.calls[j + 1].name) + length(coalesce(nullif(r.calls[j + 1].arguments, ''), '{{}}')) + 53)), 0)::int + 22) AS s0 FROM u),
    w AS (SELECT *, list_transform(range(len(s0)), lambda k: list_filter(range(n), lambda i: i * 4 < s0[k + 1] + length(r.calls[k + 1].name) AND i * 4 + 4 > s0[k + 1])) AS hit FROM v),
    x AS (SELECT *, list_transform(hit, lambda h: list_avg(list_transform(h, lambda i: -(((i * 4 + state_id) % 10) / 10.0::double)))) AS means FROM w),
    y AS (SELECT *, CASE WHEN kind <> 'unparsed' AND state_id % 7 <> 0 THEN exp(CASE WHEN state_id % 3 <= 1 THEN -((1 - state_id % 3) + 1) / 4.0::double ELSE -1.25::double END) END AS p FROM x)
    SELECT state_id, kind, round(CASE WHEN kind = 'tool_call' THEN exp(list_min(means)) END, 6) AS name_confidence, CASE WHEN kind = 'tool_call' THEN list_sum(list_transform(hit, lambda h: len(h)))::int ELSE 0 END AS name_tokens, round(p, 6) AS p_call, kind <> 'unparsed' AND state_id % 7 <> 0 AND state_id % 3 = 2 AS bounded,
        round(CASE WHEN kind = 'reply' THEN 1 - p WHEN kind = 'tool_call' AND p IS NOT NULL THEN least(p, exp(list_min(means))) END, 6) AS step_confidence FROM y"""
_ONE_TEXT = f"WITH t AS (SELECT '<|im_start|>system' || chr(10) || {_SYS} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || 'Hello.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'stop it<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<tool_call>' || chr(10) || '{{\"name\": \"stop_order\", \"arguments\": {{\"order_id\": \"#1\"}}}}' || chr(10) || '</tool_call><|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '<tool_response>' || chr(10) || 'done' || chr(10) || '</tool_response><|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS t)"

ORACLES = {
    "step_confidence": _CONF,
    "signals": f"""
        WITH c AS ({_CONF}), j AS (SELECT {_SRC} AS source, kind, CASE WHEN kind = 'reply' THEN 1.0::double WHEN kind = 'tool_call' THEN name_confidence END AS a, step_confidence AS b FROM c JOIN train_states t USING (state_id)),
        q AS (SELECT *, CASE WHEN b IS NULL THEN 'unmeasured' WHEN b < 0.8::double THEN 'low_confidence' ELSE 'confident' END AS route_reason FROM j)
        SELECT source, route_reason, count(*) AS n, count(*) FILTER (route_reason <> 'confident') AS n_escalated, round(avg(a), 6) AS name_signal, round(avg(b), 6) AS step_signal FROM q GROUP BY 1, 2""",
    "measured_sweep": f"""
        WITH s AS (SELECT source, (eval_id * 37) % 100 / 100.0::double AS s, CASE WHEN rk = 'reply' THEN kind_match ELSE coalesce(normalized_match, false) END AS ok FROM ({conversations._scored()}) WHERE eval_id % 3 <> 0),
        p AS (SELECT source, t AS threshold, count(*) AS n, count(*) FILTER (NOT ok) AS w, count(*) FILTER (s < t) AS e, count(*) FILTER (s < t AND NOT ok) AS c FROM s CROSS JOIN (VALUES (0.25::double), (0.5::double), (0.75::double)) v(t) GROUP BY ALL)
        SELECT source, threshold, n AS n_steps, round((n - w)::double / n, 6) AS accuracy_before, round(e::double / n, 6) AS escalation_rate, round((n - w + c)::double / n, 6) AS accuracy_after, round(CASE WHEN w > 0 THEN c::double / w END, 6) AS mistakes_caught, round(CASE WHEN e > 0 THEN (e - c)::double / e END, 6) AS wasted_escalations FROM p""",
    "response_scores": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: -abs(round(x::double, 6))) AS v FROM embeddings)
        SELECT vec_id, 't' || vec_id AS text, len(v)::int AS n_tokens, round(list_sum(v), 4) AS logprob, 5 AS n_first, round(list_max(v[1:5]), 6) AS best, len(v) * 0.5::double AS emitted FROM v""",
    "served_levels": """
        WITH e AS (SELECT event_type, value, (props->>'$.k')::int AS k, value > 1 AS ok FROM events)
        SELECT event_type, count(*) AS requests, count(*) FILTER (NOT ok) AS errors, quantile_disc(value, 0.5) FILTER (ok) AS p50, quantile_disc(value, 0.99) FILTER (ok) AS p99, quantile_disc(value / 4, 0.5) FILTER (ok AND k % 5 <> 0) AS ttft_p50, quantile_disc(value / 4, 0.99) FILTER (ok AND k % 5 <> 0) AS ttft_p99,
            round(count(*) FILTER (ok) / 60.0::double, 3) AS per_second, round(sum(k) FILTER (ok) / 60.0::double, 1) AS tokens_per_second FROM e GROUP BY 1""",
    "stream_chunks": "SELECT user_id, min(event_id) FILTER (event_type <> 'error') AS ttft, max(event_id) AS latency, arg_max((props->>'$.k')::int, event_id) AS completion_tokens, count(*) AS n_chunks FROM events GROUP BY 1",
    "prompt_states": f"""
        WITH t AS (SELECT episode_id, first_pos AS pos, role, coalesce(string_agg('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10), '') OVER (PARTITION BY episode_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS told FROM ({conversations._TURNS})),
        p AS (SELECT episode_id, pos, '<|im_start|>system' || chr(10) || {_SYS} || '<|im_end|>' || chr(10) || told || '<|im_start|>assistant' || chr(10) AS p FROM t WHERE role = 'assistant' AND pos > 0)
        SELECT episode_id, pos, length(p) AS chars, md5(p) AS hash FROM p""",
    "template_hash": _ONE_TEXT + " SELECT config_name, count(DISTINCT lower(trim(config_fingerprint, E' \\t\\n'))) AS n_fingerprints, (SELECT sha256(t) FROM t) AS template FROM free_log GROUP BY 1",
    "served_turns": f"""
        WITH p AS ({conversations._PARSED.format("coalesce(text, '')")}), o AS (SELECT *, doc_id % 50 = 0 AS o FROM p)
        SELECT coalesce(kind, 'unparsed') AS kind, CASE WHEN NOT o THEN 'student' WHEN doc_id % 100 <> 0 THEN 'teacher' ELSE 'nobody' END AS "by", count(*) AS n,
            sum(length(CASE WHEN o THEN 'I can''t go on.' WHEN kind = 'tool_call' THEN NULL WHEN kind = 'reply' THEN said WHEN whole <> '' THEN whole ELSE '[empty response]' END))::bigint AS chars,
            count(*) FILTER (NOT o AND kind IS NULL AND whole = '') AS n_empty, sum(CASE WHEN NOT o AND kind = 'tool_call' THEN len(blocks) ELSE 0 END)::bigint AS n_calls FROM o GROUP BY 1, 2""",
    "histories": f"SELECT e.episode_id, count(m)::int AS n_messages, coalesce(string_agg(len({conversations._CALLS})::varchar, ',' ORDER BY pos) FILTER (m IS NOT NULL), '') AS calls, coalesce(string_agg(m.role, ',' ORDER BY pos), '') AS roles FROM episodes e LEFT JOIN ({conversations._MESSAGES}) x ON x.episode_id = e.episode_id WHERE e.messages IS NOT NULL GROUP BY 1",
    "review_turns": f"""
        WITH m AS (SELECT episode_id, pos, m, coalesce(m.content, '') AS said, {conversations._CALLS} AS calls FROM ({conversations._MESSAGES})),
        t AS (SELECT episode_id, pos, CASE WHEN m.role = 'tool' THEN '> **tool output:** `' || CASE WHEN length(said) > 700 THEN said[:700] || ' …' ELSE said END || '`' WHEN len(calls) > 0 THEN '> **agent calls:** ' || array_to_string(list_transform(calls, lambda c: '`' || coalesce(c.name, '') || '(' || coalesce(c.arguments, '{{}}') || ')`'), '; ')
            ELSE '> **' || CASE WHEN m.role = 'assistant' THEN 'agent' ELSE 'customer' END || ':** ' || replace(said, chr(10), chr(10) || '> ') END AS t FROM m)
        SELECT episode_id, pos, length(t) AS chars, md5(t) AS hash FROM t""",
    "self_reference": f"SELECT {_SRC} AS source, count(*) AS n, count(*) FILTER (coalesce(reference.kind = 'tool_call' OR trim(reference.text) <> '', false)) AS n_kind, count(*) FILTER (reference.kind = 'tool_call') AS n_strict FROM train_states WHERE reference IS NOT NULL AND (reference.text IS NOT NULL OR reference.calls IS NOT NULL) GROUP BY 1",
    "data_card_sizes": f"""
        WITH x AS (SELECT 'prompt' AS what, round_even(length(prompt) / 3.5::double, 0)::bigint AS t FROM train_states UNION ALL SELECT 'episode', round_even(sum(length(body) + length(role) + 24) / 3.5::double, 0)::bigint FROM ({conversations._TURNS}) GROUP BY episode_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY what ORDER BY t) AS rn, count(*) OVER (PARTITION BY what) AS m FROM x WHERE t IS NOT NULL)
        SELECT what, count(*) AS n, round(avg(t), 1) AS mean, max(t) FILTER (rn = greatest(1, least(m, round_even(0.5 * m::double, 0)))) AS p50, max(t) FILTER (rn = greatest(1, least(m, round_even(0.95::double * m, 0)))) AS p95, max(t) AS max, {", ".join(f"round(avg((t > {n})::int::double), 3) AS over_{n}" for n in (2048, 4096, 8192, 12288, 16384))} FROM r GROUP BY 1""",
    "label_check": f"""
        WITH a AS (SELECT eval_id, {conversations._BUCKET} AS b FROM ({conversations._scored()})), h AS (SELECT eval_id, CASE WHEN eval_id % 3 <> 0 THEN coalesce({conversations._BUCKET}, 'malformed_output') END AS h FROM ({conversations._scored("arg_max")})), j AS (SELECT * FROM a JOIN h USING (eval_id) WHERE b IS NOT NULL AND h IS NOT NULL)
        SELECT count(*) AS labelled, count(*) FILTER (b = h) AS agreeing, round(count(*) FILTER (b = h)::double / nullif(count(*), 0), 6) AS agreement, coalesce(count(*) FILTER (b = h)::double / nullif(count(*), 0) >= 0.9, false) AS passes FROM j""",
    "drift_check": """
        WITH t AS (SELECT avg((reference.kind = 'tool_call')::int::double) AS t FROM eval_steps WHERE reference IS NOT NULL), r AS (SELECT catalog, backend, avg((tool_calls > 2)::int::double) FILTER (seed < 2) AS b, avg((tool_calls > 2)::int::double) FILTER (seed >= 2) AS a FROM free_log GROUP BY 1, 2)
        SELECT catalog, backend, (abs(a - t) - abs(b - t) > 0.01) OR (a < 0.5 * least(b, t)) AS collapsed FROM r, t""",
}
