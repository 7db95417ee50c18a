"""Queries over episodes and steps: turns, decisions, scoring, comparison, pairs, rewards, data card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.functions import canon
from evalspark.functions.text import label, strip, whole_number
from evalspark.operators import catalogs, compare, datacard, pairs, reward, scoring, steps, turns
from evalspark.plans.runs import rounded
from evalspark.plans.tables import table

# The tools of the test data that belong to the desk itself, and those that only pad its catalog.
NATIVE = ["find_account_by_mail", "find_account_by_name", "get_account_card", "get_parcel_trace", "get_order_sheet", "list_open_orders", "list_item_variants", "swap_order_line", "stop_order", "start_return", "move_delivery", "set_default_address"]
CATALOG = [*NATIVE, "add_goodwill_credit", "get_stock_level", "work_out", "hand_to_person"]

# What the tools of the test data take; every argument is required but limit, reason, refund_to and address.
SIGNATURES = """
find_account_by_mail(mail) | find_account_by_name(given_name, family_name, postcode) | get_account_card(account_id) | get_parcel_trace(parcel_id) | get_order_sheet(order_id)
list_open_orders(account_id, limit) | list_item_variants(item_id) | swap_order_line(order_id, old_item, new_item, reason) | stop_order(order_id, reason) | start_return(order_id, item_ids, refund_to)
move_delivery(order_id, new_day, address) | set_default_address(account_id, address) | add_goodwill_credit(account_id, amount) | get_stock_level(item_id, depot) | work_out(formula) | hand_to_person(summary)
"""
ARGUMENT_TYPES = {"limit": "integer", "amount": "number", "item_ids": "array", "address": "object"}
OPTIONAL = ["limit", "reason", "refund_to", "address"]
TOOLS = {name: args.split(", ") for name, args in (s.strip(" )").split("(") for line in SIGNATURES.strip().splitlines() for s in line.split("|"))}
SCHEMAS = {name: {"properties": {a: {"type": ARGUMENT_TYPES.get(a, "string")} for a in args}, "required": [a for a in args if a not in OPTIONAL]} for name, args in TOOLS.items()}


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "episodes").select("episode_id", "task_id", "rep", "temperature", "reward", "messages")


def decision_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns.decisions(_episodes(spark, sf_dir))
    return found.select("episode_id", "pos", "kind", F.array_join("names", ",").alias("names"), "n_before", "calls_before", "chars_before")


def prefix_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns.prior_calls(_episodes(spark, sf_dir))
    return found.select("episode_id", "pos", F.size("prior").alias("n"), F.array_join(F.transform("prior", lambda c: c["name"]), ",").alias("prior"), F.md5(F.array_join(F.transform("prior", turns.call_key), "\n").cast("binary")).alias("hash"))


def later_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns.later_calls(_episodes(spark, sf_dir))
    return found.select("episode_id", "pos", F.size("later").alias("n"), F.array_join(F.transform("later", lambda c: c["name"]), ",").alias("later"), F.md5(F.array_join(F.transform("later", turns.call_key), "\n").cast("binary")).alias("hash"))


def fifo_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.matched_results(_episodes(spark, sf_dir))


def merged_turn_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns.merged_turns(_episodes(spark, sf_dir))
    return found.select("episode_id", "turn", "first_pos", "role", "n_messages", F.length("text").alias("chars"))


def prompt_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each serialized conversation."""
    return turns.transcripts(_episodes(spark, sf_dir))


def segment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.segments(_episodes(spark, sf_dir))


def degenerate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _episodes(spark, sf_dir).where(turns.degenerate(F.col("messages"))).select("episode_id")


def episode_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns.episode_stats(_episodes(spark, sf_dir), CATALOG, NATIVE)
    return found.drop("task_id", "rep")


def token_limit_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that ended at a token limit."""
    rows = turns.messages(_episodes(spark, sf_dir)).where("role = 'assistant'")
    hit = turns.hit_token_limit(F.col("raw_data"), F.col("completion_tokens"), 400)
    return rows.groupBy("rep").agg(F.count_if(hit).alias("n_hit"), F.count("*").alias("n"))


def scored_steps(spark: SparkSession, sf_dir: str, which: str = "first", canonical: bool = False) -> DataFrame:
    """Eval steps scored against an action of the training side of the same task: of its smallest or largest state id.

    Tasks without training states have no prediction. Arguments are compared as stored, or in canonical form.
    """
    pick = F.min_by if which == "first" else F.max_by
    states = table(spark, sf_dir, "train_states").select(whole_number(F.col("task_id")).alias("task"), "state_id", "reference", "cut_off").where("task is not null and reference is not null")
    predicted = states.groupBy("task").agg(pick("reference", "state_id").alias("p"), pick("cut_off", "state_id").alias("cut_off"))
    steps = table(spark, sf_dir, "eval_steps").select("eval_id", whole_number(F.col("task_id")).alias("task"), "rep", "step_index", label(F.col("source")).alias("source"), F.col("reference").alias("r")).where("r is not null")
    joined = steps.join(predicted, "task", "left")
    if canonical:
        args = canon.canonical_calls
    else:
        args = lambda c: F.transform(c, lambda x: F.struct(x["name"].alias("name"), x["arguments"].alias("strict"), F.lower(strip(x["arguments"])).alias("normal"), x["arguments"].alias("arguments"), turns.call_key(x).alias("key")))
    columns = joined.select("eval_id", "task", "rep", "step_index", "source", "cut_off", F.col("r.kind").alias("reference_kind"), F.col("r.text").alias("reference_text"), args(F.col("r.calls")).alias("reference_calls"), F.col("p.kind").alias("predicted_kind"), args(F.col("p.calls")).alias("predicted_calls"))
    scored = scoring.score(columns, CATALOG)
    return scored.withColumn("bucket", scoring.bucket())


def step_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_steps(spark, sf_dir).select("eval_id", "kind_match", "name_match", "normalized_match", "strict_match", "hallucinated_tool")


def step_scores_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with arguments compared as JSON."""
    return scored_steps(spark, sf_dir, canonical=True).select("eval_id", "kind_match", "name_match", "normalized_match", "strict_match", "bucket")


def step_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.summarize(scored_steps(spark, sf_dir), ["source"])
    return rounded(found, *scoring.RATES, "parse_error_rate")


def macro_micro_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.macro_micro(scored_steps(spark, sf_dir), ["source"], ["task", "rep"])
    return rounded(found, "micro", "macro")


def bucket_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.bucket_table(scored_steps(spark, sf_dir), ["source"]), "share")


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last training state's action against the first one's, over episodes of eval steps."""
    base, new = (scored_steps(spark, sf_dir, which).where("task is not null and rep is not null") for which in ("first", "last"))
    sums = compare.episode_sums(base, new, ["task", "rep"], "eval_id")
    found = compare.paired_bootstrap(sums, ["task", "rep"])
    return rounded(found, "base", "new", "delta", "ci95_low", "ci95_high")


def engine_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of both sides that carry one step id, the first of each."""
    sides = [table(spark, sf_dir, n).select(strip(F.col("step_id")).alias("step"), F.col(k).alias("k"), "prompt").where("step is not null").groupBy("step").agg(F.min_by("prompt", "k").alias("prompt")) for n, k in (("eval_steps", "eval_id"), ("train_states", "state_id"))]
    return compare.same_texts(*sides, "step", "prompt")


def judged_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored steps with what each prediction amounts to; later calls are those of the reference at later steps of the episode."""
    rows = scored_steps(spark, sf_dir)
    placed = F.col("task").isNotNull() & F.col("rep").isNotNull() & F.col("step_index").isNotNull()
    keys = F.coalesce(F.transform("reference_calls", lambda c: c["key"]), F.array().cast("array<string>"))
    after = Window.partitionBy("task", "rep").orderBy("step_index").rangeBetween(1, Window.unboundedFollowing)
    later = rows.where(placed).withColumn("later", F.flatten(F.collect_list(keys).over(after)))
    rows = later.unionByName(rows.where(~placed).withColumn("later", F.array().cast("array<string>")))
    reasoning = (F.col("reference_kind") == "reply") & pairs.teacher_reasoning(F.col("reference_text"))
    equivalent = pairs.same_outcome(F.col("predicted_calls"), F.col("reference_calls"))
    ordering = (F.col("reference_kind") == "tool_call") & pairs.ordering_only(F.col("predicted_calls"), F.col("later"))
    return rows.withColumn("outcome", pairs.verdict(F.col("bucket"), equivalent, F.col("cut_off"), reasoning, ordering))


def pair_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step's prediction amounts to, by source."""
    return pairs.outcome_counts(judged_steps(spark, sf_dir), ["source"])


def pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each bucket, disagreements of calls and how many of these had the same effect, by source."""
    return pairs.pair_report(judged_steps(spark, sf_dir), ["source"])


def step_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gated reward of each step's prediction against the schemas of all tools."""
    rows = scored_steps(spark, sf_dir)
    fit = canon.calls_check(SCHEMAS)(F.col("predicted_calls"))
    effect = F.col("normalized_match") | pairs.same_outcome(F.col("predicted_calls"), F.col("reference_calls"))
    total = reward.step_reward(F.col("reference_kind"), F.col("predicted_kind"), ~F.col("hallucinated_tool"), F.col("name_match"), fit, effect)
    return rows.select("eval_id", F.round(total, 6).alias("reward"))


def teacher_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that speak of the customer, by source."""
    rows = table(spark, sf_dir, "train_states").select(label(F.col("source")).alias("source"), F.col("reference.text").alias("text"))
    return rows.groupBy("source").agg(F.count_if(pairs.teacher_reasoning(F.col("text"))).alias("n_reasoning"), F.count("text").alias("n_text"))


def completions_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents read as completions: what kind they are, and why they can't be read."""
    parsed = table(spark, sf_dir, "documents").where("text is not null").select(canon.parse_completion("text").alias("p"))
    return parsed.groupBy("p.kind", "p.error", "p.stray").agg(F.count("*").alias("n"), F.sum(F.size("p.calls")).alias("n_calls"))


def completion_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the form they would have as a completion."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select(steps.completion_form(F.col("text")).alias("f"))
    return rows.groupBy("f.kind").agg(F.count("*").alias("n"), F.sum("f.n_blocks").alias("n_blocks"))


def argument_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all tools by whether their arguments are of the declared form; tools without a schema have neither."""
    rows = turns.messages(_episodes(spark, sf_dir)).select(F.explode(turns.calls(F.col("tool_calls"))).alias("c"))
    checked = rows.select("c.name", canon.schema_check(SCHEMAS)(F.col("c.name"), F.col("c.arguments")).alias("fits"))
    return checked.groupBy("name").agg(F.count_if("fits").alias("n_fit"), F.count_if(~F.col("fits")).alias("n_unfit"), F.count("*").alias("n"))


def data_card_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    native = spark.createDataFrame([(n,) for n in CATALOG], "name string")
    return datacard.tool_use(_episodes(spark, sf_dir), native)


def data_card_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions and tool results of the episodes that won."""
    won = datacard.successful(_episodes(spark, sf_dir))
    a, b = datacard.decision_counts(won), datacard.tool_results(won)
    wide = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("bigint").alias("value")) for c in (*a.columns, *b.columns)]
    rows = lambda df: df.select(F.explode(F.array(*(w for w, c in zip(wide, (*a.columns, *b.columns), strict=True) if c in df.columns))).alias("x")).select("x.*")
    return rows(a).unionByName(rows(b))


def episodes_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datacard.episodes_per_task(datacard.successful(_episodes(spark, sf_dir)))


def by_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datacard.by_temperature(_episodes(spark, sf_dir))


def tasks_without_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datacard.without_success(table(spark, sf_dir, "tasks"), _episodes(spark, sf_dir))


def name_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every part name and brand."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("_", "p_name", "p_type").alias("name"))
    return names.select("p_partkey", F.array_join(F.array_sort(catalogs.name_words(F.col("name"))), ",").alias("words"), catalogs.sanitized(F.col("name")).alias("safe"))


def neighbor_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 called tools outside of the catalog's first twelve that are most like them."""
    calls = turns.messages(_episodes(spark, sf_dir)).select(F.explode(turns.calls(F.col("tool_calls"))).alias("c"))
    candidates = calls.select(F.col("c.name").alias("name")).where(F.col("name").isNotNull() & ~F.col("name").isin(*NATIVE)).distinct().withColumn("description", F.regexp_replace("name", "_", " "))
    native = spark.createDataFrame([(n, n.replace("_", " ")) for n in NATIVE], "name string, description string")
    return catalogs.ranked(catalogs.likeness(candidates, native), 24).select("name", "score", "rank")


ALL = [
    decision_steps, prefix_calls, later_lookahead, fifo_match, merged_turn_islands, prompt_hash, segment_spans, degenerate_filter, episode_diagnostics, token_limit_hits, step_scores, step_scores_json,
    step_summary, macro_micro_agreement, bucket_table, paired_bootstrap, engine_check, pair_outcomes, pair_report, step_rewards, teacher_reasoning, completions_parsed, completion_kinds, argument_schemas,
    data_card_tools, data_card_counts, episodes_per_task, by_temperature, tasks_without_success, name_stems, neighbor_topk,
]
QUERIES = {f.__name__: f for f in ALL}

_TASK = "CASE WHEN regexp_full_match(trim(task_id), '[0-9]{1,18}') THEN CAST(trim(task_id) AS BIGINT) END"
_MESSAGES = "SELECT episode_id, task_id, rep, reward, i AS pos, messages[i + 1] AS m FROM episodes, unnest(range(len(messages))) AS t(i) WHERE messages[i + 1] IS NOT NULL"
_CALLS = "list_filter(coalesce(m.tool_calls, []), lambda c: c IS NOT NULL)"
_NAMES = f"list_transform({_CALLS}, lambda c: c.name)"
_TEXT = r"regexp_replace(coalesce(m.content, ''), '^\s+|\s+$', '', 'g')"
_KEY = r"concat_ws(chr(9), c.name, lower(regexp_replace(coalesce(c.arguments, ''), '^\s+|\s+$', '', 'g')))"
_AROUND = f"""
        WITH w AS (SELECT episode_id, pos, flatten(list({_CALLS}) OVER (PARTITION BY episode_id ORDER BY pos ROWS BETWEEN {{frame}})) AS a FROM ({_MESSAGES}) WHERE m.role = 'assistant'), x AS (SELECT episode_id, pos, coalesce(a, []) AS a FROM w WHERE pos > 0)
        SELECT episode_id, pos, len(a)::int AS n, array_to_string(list_filter(list_transform(a, lambda c: c.name), lambda n: n IS NOT NULL), ',') AS {{name}}, md5(array_to_string(list_transform(a, lambda c: {_KEY}), chr(10))) AS hash FROM x"""
_BLOCKS = f"array_to_string(list_transform({_CALLS}, lambda c: '<tool_call>' || chr(10) || '{{\"name\": \"' || coalesce(c.name, '') || '\", \"arguments\": ' || coalesce(c.arguments, '{{}}') || '}}' || chr(10) || '</tool_call>'), chr(10))"
_TURNS = f"""
    SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY first_pos) AS turn, first_pos, role, n_messages, body FROM (
        SELECT episode_id, min(pos) AS first_pos, CASE WHEN role = 'tool' THEN 'user' ELSE role END AS role, count(*) AS n_messages, string_agg(body, chr(10) ORDER BY pos) AS body FROM (
            SELECT episode_id, pos, m.role AS role, CASE WHEN m.role = 'tool' THEN ord - row_number() OVER (PARTITION BY episode_id, m.role ORDER BY pos) ELSE -ord END AS run,
                CASE WHEN m.role = 'tool' THEN '<tool_response>' || chr(10) || coalesce(m.content, '') || chr(10) || '</tool_response>' WHEN len({_CALLS}) > 0 THEN {_BLOCKS} ELSE {_TEXT} END AS body
            FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY pos) AS ord FROM ({_MESSAGES})))
        GROUP BY episode_id, role, run)"""
_SAID = """count(*) FILTER (regexp_matches(coalesce(m.raw_data, ''), '(?i)[''"]{0}[''"]: *(?:true|[''"][^''"])'))"""
_CATALOG = "[" + ", ".join(f"'{n}'" for n in CATALOG) + "]"
_NATIVE = "[" + ", ".join(f"'{n}'" for n in NATIVE) + "]"
_SOURCE = r"nullif(regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g'), '')"
_FORM = r"list_transform(coalesce({0}.calls, []), lambda c: {{'n': c.name, 'a': lower(regexp_replace(c.arguments, '^\s+|\s+$', '', 'g'))}})"


_TYPED = {"string": "= 'VARCHAR'", "integer": "IN ('BIGINT', 'UBIGINT', 'HUGEINT')", "number": "IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE')", "array": "= 'ARRAY'", "object": "= 'OBJECT'"}
# An object `a` of a tool `n`: no key that isn't declared, all required ones, each value of its type.
_FITS = "CASE " + " ".join(f"""WHEN n = '{n}' THEN len(list_filter(json_keys(a), lambda k: k NOT IN ({", ".join(f"'{p}'" for p in s["properties"])}))) = 0{"".join(f" AND json_exists(a, '$.{r}')" for r in s["required"])}{"".join(f" AND (NOT json_exists(a, '$.{p}') OR json_type(a, '$.{p}') {_TYPED[t['type']]})" for p, t in s["properties"].items())}""" for n, s in SCHEMAS.items()) + " END"
_OBJECT = "SELECT * EXCLUDE (a), CASE WHEN json_type(a) = 'OBJECT' THEN a END AS a FROM (SELECT * EXCLUDE (a), CASE WHEN json_type(a) = 'VARCHAR' THEN try_cast(a->>'$' AS json) ELSE a END AS a FROM (SELECT *, try_cast(CASE WHEN t = '' THEN '{{}}' ELSE coalesce(t, '{{}}') END AS json) AS a FROM ({0})))"


def _scored(pick: str = "arg_min") -> str:
    both = "(coalesce(r.kind = 'tool_call', false) AND coalesce(p.kind = 'tool_call', false))"
    return f"""
        SELECT eval_id, s.task, rep, source, cut_off, r.kind AS rk, p.kind AS pk, r.text AS text, coalesce(p.kind = r.kind, false) AS kind_match,
            {both} AND list_transform(r.calls, lambda c: c.name) = list_transform(p.calls, lambda c: c.name) AS name_match,
            {both} AND {_FORM.format("r")} = {_FORM.format("p")} AS normalized_match, {both} AND r.calls = p.calls AS strict_match,
            coalesce(p.kind = 'tool_call', false) AND len(list_filter(p.calls, lambda c: NOT list_contains({_CATALOG}, c.name))) > 0 AS hallucinated_tool,
            step_index, r.calls AS rc, p.calls AS pc, list_transform(coalesce(r.calls, []), lambda c: c.name) AS rt, list_transform(coalesce(p.calls, []), lambda c: c.name) AS pt
        FROM (SELECT eval_id, {_TASK} AS task, rep, step_index, {_SOURCE} AS source, reference AS r FROM eval_steps WHERE reference IS NOT NULL) s
        LEFT JOIN (SELECT {_TASK} AS task, {pick}(reference, state_id) AS p, {pick}(cut_off, state_id) AS cut_off FROM train_states WHERE reference IS NOT NULL GROUP BY 1) q ON s.task = q.task"""


_WORDS = "list_distinct(list_transform(list_filter(regexp_split_to_array(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 3 AND w[-1] = 's' THEN w[:-2] ELSE w END))"
_CONNECTORS = "[" + ", ".join(f"'{w}'" for w in catalogs.CONNECTORS) + "]"
_NEAR = f"len(list_filter(pt, lambda a: len(list_filter(rt, lambda b: len(list_filter(list_intersect({_WORDS.format('a')}, {_WORDS.format('b')}), lambda w: NOT list_contains({_CONNECTORS}, w))) > 0)) > 0)) > 0"
_BUCKET = f"""CASE WHEN rk = 'reply' THEN CASE WHEN kind_match THEN NULL WHEN pk IS NULL THEN 'malformed_output' ELSE 'call_instead_of_reply' END
    WHEN normalized_match THEN NULL WHEN pk IS NULL THEN 'malformed_output' WHEN pk = 'reply' THEN 'premature_termination' WHEN hallucinated_tool THEN 'hallucinated_tool'
    WHEN name_match THEN 'right_tool_wrong_args' WHEN {_NEAR} THEN 'wrong_tool_neighbor' ELSE 'wrong_tool_unrelated' END"""
_RATE = lambda rows, hit: f"round(CASE WHEN count(*) FILTER ({rows}) > 0 THEN count(*) FILTER ({rows} AND {hit})::double / count(*) FILTER ({rows}) END, 6)"
_VALUES = ", ".join(f"('{b}', {str(b in scoring.BUCKETS).lower()})" for b in scoring.BUCKETS + scoring.OUTSIDE)
_RATES = [("step_agreement", "rk = 'tool_call'", "normalized_match"), ("tool_name", "rk = 'tool_call'", "name_match"), ("reply_as_reply", "rk = 'reply'", "kind_match"), ("call_as_call", "rk = 'tool_call'", "coalesce(pk = 'tool_call', false)")]
_RATES += [(b, "rk = 'tool_call'", f"coalesce(bucket = '{b}', false)") for b in scoring.BUCKETS] + [("call_instead_of_reply", "rk = 'reply'", "coalesce(bucket = 'call_instead_of_reply', false)"), ("malformed_output", "true", "coalesce(bucket = 'malformed_output', false)")]
_RATE_ROWS = " UNION ALL ".join(f"SELECT task, rep, eval_id, '{n}' AS rate, ({c})::int AS den, (({c}) AND ({h}))::int AS hit FROM x" for n, c, h in _RATES)
_REASONING = r"regexp_matches(regexp_replace({0}, '(?i)\bthe user(''s|’s)?\s*(id|account)\b', '', 'g'), '(?i)\bthe user(''s|’s)?\b')"
_FLAT = "list_transform({0}.calls, lambda c: c.name || ' ' || coalesce(array_to_string(list_sort(list_transform(json_keys(try_cast(c.arguments AS json)), lambda k: k || '=' || {1}(coalesce(json_type(try_cast(c.arguments AS json), '$.' || k), '') || trim(coalesce(json_extract_string(try_cast(c.arguments AS json), '$.' || k), ''))))), ','), c.arguments))"
_SCORED_JSON = f"""
        SELECT * REPLACE (two AND {_FLAT.format('r', 'lower')} = {_FLAT.format('p', 'lower')} AS normalized_match, two AND {_FLAT.format('r', '')} = {_FLAT.format('p', '')} AS strict_match) FROM (
            SELECT *, coalesce(rk = 'tool_call', false) AND coalesce(pk = 'tool_call', false) AS two, {{'calls': rc}} AS r, {{'calls': pc}} AS p FROM ({_scored()}))"""
_KEYS = r"list_transform(coalesce({0}, []), lambda c: concat_ws(chr(9), c.name, lower(regexp_replace(coalesce(c.arguments, ''), '^\s+|\s+$', '', 'g'))))"
_READS, _CHANGES = (f"list_filter({_KEYS}, lambda k: {no} regexp_matches(k, '^(get_|find_|list_)'))" for no in ("", "NOT"))
_SAME = f"(len(coalesce(pc, [])) > 0 AND len(coalesce(rc, [])) > 0 AND {_CHANGES.format('pc')} = {_CHANGES.format('rc')} AND list_sort(list_distinct({_READS.format('pc')})) = list_sort(list_distinct({_READS.format('rc')})))"
_LATER = f"flatten(list({_KEYS.format('rc')}) OVER (PARTITION BY task, rep ORDER BY step_index RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"
_JUDGED = f"""
        SELECT *, CASE WHEN bucket IS NULL THEN 'agree' WHEN {_SAME} THEN 'equivalent' WHEN cut_off THEN 'teacher_cut_off' WHEN rk = 'reply' AND coalesce({_REASONING.format("text")}, false) THEN 'teacher_reasoning'
            WHEN rk = 'tool_call' AND len(coalesce(pc, [])) > 0 AND len({_CHANGES.format('pc')}) = 0 AND list_has_all(CASE WHEN task IS NULL OR rep IS NULL OR step_index IS NULL THEN [] ELSE coalesce(later, []) END, {_KEYS.format('pc')}) THEN 'ordering_only' ELSE 'pair' END AS outcome
        FROM (SELECT *, {_BUCKET} AS bucket, {_LATER} AS later FROM ({_scored()}))"""
_SPACE = r"[\s\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{3000}}\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}]"
_PARSED = r"""
        SELECT doc_id, blocks, said, whole, calls, CASE WHEN error IS NULL THEN CASE WHEN len(blocks) > 0 THEN 'tool_call' ELSE 'reply' END END AS kind, error, error IS NULL AND len(blocks) > 0 AND said <> '' AS stray FROM (
            SELECT *, CASE WHEN len(blocks) = 0 THEN CASE WHEN contains(said, '<tool_call>') THEN 'unclosed' WHEN said = '' THEN 'empty' END ELSE list_filter(calls, lambda e: e IS NOT NULL)[1] END AS error FROM (
                SELECT *, list_transform(blocks, lambda b: CASE WHEN try_cast(b AS json) IS NULL THEN 'block_no_json' WHEN coalesce(json_type(try_cast(b AS json), '$.name'), '') <> 'VARCHAR' THEN 'no_name'
                    WHEN json_type(try_cast(b AS json), '$.arguments') = 'VARCHAR' THEN CASE WHEN try_cast(try_cast(b AS json)->>'$.arguments' AS json) IS NULL THEN 'arguments_no_json' WHEN json_type(try_cast(try_cast(b AS json)->>'$.arguments' AS json)) <> 'OBJECT' THEN 'arguments_no_object' END
                    WHEN coalesce(json_type(try_cast(b AS json), '$.arguments'), 'OBJECT') <> 'OBJECT' THEN 'arguments_no_object' END) AS calls FROM (
                    SELECT doc_id, regexp_replace(body, '^SPACE+|SPACE+$', '', 'g') AS whole, regexp_extract_all(body, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1) AS blocks, regexp_replace(regexp_replace(body, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', '', 'g'), '^SPACE+|SPACE+$', '', 'g') AS said
                    FROM (SELECT doc_id, string_split({0}, '<|im_end|>')[1] AS body FROM documents))))""".replace("SPACE", _SPACE)

ORACLES = {
    "decision_steps": f"""
        SELECT episode_id, pos, kind, array_to_string(names, ',') AS names, n_before, calls_before, chars_before FROM (
            SELECT episode_id, pos, m.role AS role, CASE WHEN len({_CALLS}) > 0 THEN 'tool_call' WHEN {_TEXT} <> '' THEN 'reply' END AS kind, {_NAMES} AS names, count(*) OVER w AS n_before,
                coalesce(sum(CASE WHEN m.role = 'assistant' THEN len({_CALLS}) END) OVER w, 0)::bigint AS calls_before, coalesce(sum(length(coalesce(m.content, ''))) OVER w, 0)::bigint AS chars_before
            FROM ({_MESSAGES}) WINDOW w AS (PARTITION BY episode_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant' AND pos > 0""",
    "prefix_calls": _AROUND.format(frame="UNBOUNDED PRECEDING AND 1 PRECEDING", name="prior"),
    "later_lookahead": _AROUND.format(frame="1 FOLLOWING AND UNBOUNDED FOLLOWING", name="later"),
    "fifo_match": f"""
        WITH c AS (SELECT episode_id, pos AS call_pos, c.name AS call_name, row_number() OVER (PARTITION BY episode_id ORDER BY pos, j) AS ordinal FROM (SELECT episode_id, pos, j, ({_CALLS})[j] AS c FROM ({_MESSAGES}), unnest(range(1, len({_CALLS}) + 1)) AS u(j) WHERE m.role = 'assistant')),
        r AS (SELECT episode_id, pos AS result_pos, coalesce(lower(m.error) = 'true', false) AS is_error, row_number() OVER (PARTITION BY episode_id ORDER BY pos) AS ordinal FROM ({_MESSAGES}) WHERE m.role = 'tool')
        SELECT r.episode_id, r.ordinal, call_pos, call_name, result_pos, is_error, call_pos < result_pos AS in_order FROM r LEFT JOIN c ON r.episode_id = c.episode_id AND r.ordinal = c.ordinal""",
    "merged_turn_islands": f"SELECT episode_id, turn, first_pos, role, n_messages, length(body) AS chars FROM ({_TURNS})",
    "prompt_hash": f"""
        WITH t AS (SELECT episode_id, count(*) AS n_turns, string_agg('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS text FROM ({_TURNS}) GROUP BY 1)
        SELECT episode_id, n_turns, length(text) AS chars, sha256(text) AS sha FROM t""",
    "segment_spans": f"""
        WITH t AS (SELECT episode_id, turn, role, length(body) AS n, role = 'assistant' AND first_pos > 0 AS d FROM ({_TURNS})),
        p AS (SELECT episode_id, turn, 0 AS piece, false AS train, 13 + length(role) + CASE WHEN d THEN 0 ELSE n + 11 END AS c FROM t UNION ALL SELECT episode_id, turn, 1, true, n + 10 FROM t WHERE d UNION ALL SELECT episode_id, turn, 2, false, 1 FROM t WHERE d),
        r AS (SELECT *, sum(c) OVER (PARTITION BY episode_id ORDER BY turn, piece)::bigint AS e FROM p)
        SELECT episode_id, turn, piece, train, e - c AS start, e AS "end" FROM r""",
    "degenerate_filter": f"SELECT DISTINCT episode_id FROM ({_MESSAGES}) WHERE m.role = 'user' AND length(coalesce(m.content, '')) > 20000",
    "episode_diagnostics": f"""
        WITH x AS (SELECT * FROM ({_MESSAGES})), s AS (SELECT episode_id, count(*) AS turns, sum(len({_CALLS})) AS calls, {_SAID.format("escalated")} AS se, {_SAID.format("parse_error")} AS sp, {_SAID.format("context_overflow")} AS so, sum(len(list_filter({_NAMES}, lambda n: list_contains({_CATALOG}, n) AND NOT list_contains({_NATIVE}, n)))) AS d, sum(len(list_filter({_NAMES}, lambda n: n IS NOT NULL AND NOT list_contains({_CATALOG}, n)))) AS h FROM x WHERE m.role = 'assistant' AND pos > 0 GROUP BY 1),
        u AS (SELECT episode_id, bool_or(length(coalesce(m.content, '')) > 20000) AS g FROM x WHERE m.role = 'user' GROUP BY 1)
        SELECT e.episode_id, coalesce(turns, 0) AS student_turns, coalesce(se, 0) AS escalated_turns, coalesce(calls, 0)::bigint AS tool_calls, coalesce(sp, 0) AS parse_errors, coalesce(so, 0) AS context_overflows, coalesce(d, 0)::bigint AS distractor_calls, coalesce(h, 0)::bigint AS hallucinated_calls, coalesce(g, false) AS degenerate_user_turn FROM episodes e LEFT JOIN s USING (episode_id) LEFT JOIN u USING (episode_id)""",
    "token_limit_hits": f"SELECT rep, count(*) FILTER (contains(coalesce(m.raw_data, ''), '''finish_reason'': ''length''') OR coalesce(m.\"usage\".completion_tokens, 0) >= 400) AS n_hit, count(*) AS n FROM ({_MESSAGES}) WHERE m.role = 'assistant' GROUP BY 1",
    "step_scores": f"SELECT eval_id, kind_match, coalesce(name_match, false) AS name_match, coalesce(normalized_match, false) AS normalized_match, coalesce(strict_match, false) AS strict_match, hallucinated_tool FROM ({_scored()})",
    "step_scores_json": f"SELECT eval_id, kind_match, coalesce(name_match, false) AS name_match, coalesce(normalized_match, false) AS normalized_match, coalesce(strict_match, false) AS strict_match, {_BUCKET} AS bucket FROM ({_SCORED_JSON})",
    "step_summary": f"""
        SELECT source, count(*) AS n_steps, count(*) FILTER (rk = 'tool_call') AS n_tool_call_steps, count(*) FILTER (rk = 'reply') AS n_reply_steps, {_RATE("rk = 'tool_call'", "normalized_match")} AS step_agreement, {_RATE("rk = 'tool_call'", "strict_match")} AS step_agreement_strict,
            {_RATE("rk = 'tool_call'", "name_match")} AS tool_name_accuracy, {_RATE("true", "kind_match")} AS decision_type_accuracy, {_RATE("rk = 'reply'", "kind_match")} AS reply_step_decision_accuracy, {_RATE("pk = 'tool_call'", "hallucinated_tool")} AS hallucinated_tool_rate, {_RATE("true", "pk IS NULL")} AS parse_error_rate
        FROM ({_scored()}) GROUP BY source""",
    "macro_micro_agreement": f"""
        WITH e AS (SELECT source, task, rep, count(*) FILTER (rk = 'tool_call') AS c, count(*) FILTER (rk = 'tool_call' AND normalized_match) AS h FROM ({_scored()}) GROUP BY 1, 2, 3)
        SELECT source, round(CASE WHEN sum(c) > 0 THEN sum(h)::double / sum(c) END, 6) AS micro, round(avg(CASE WHEN c > 0 THEN h::double / c END), 6) AS macro, count(CASE WHEN c > 0 THEN 1 END) AS n_episodes FROM e GROUP BY source""",
    "bucket_table": f"""
        WITH x AS (SELECT source, {_BUCKET} AS bucket FROM ({_scored()})), d AS (SELECT DISTINCT source FROM x), b(bucket, counted) AS (VALUES {_VALUES}),
        f AS (SELECT d.source, b.bucket, counted, (SELECT count(*) FROM x WHERE x.source IS NOT DISTINCT FROM d.source AND x.bucket = b.bucket) AS n FROM d CROSS JOIN b)
        SELECT source, bucket, n, round(CASE WHEN counted AND w > 0 THEN n::double / w END, 6) AS share FROM (SELECT *, sum(n) FILTER (counted OR bucket = 'malformed_output') OVER (PARTITION BY source) AS w FROM f)""",
    "paired_bootstrap": f"""
        WITH a AS (SELECT * FROM (WITH x AS (SELECT *, {_BUCKET} AS bucket FROM ({_scored()}) WHERE task IS NOT NULL AND rep IS NOT NULL) {_RATE_ROWS})), b AS (SELECT * FROM (WITH x AS (SELECT *, {_BUCKET} AS bucket FROM ({_scored("arg_max")}) WHERE task IS NOT NULL AND rep IS NOT NULL) {_RATE_ROWS})),
        s AS (SELECT a.task, a.rep, a.rate, sum(a.den) AS den, sum(a.hit) AS bh, sum(b.hit) AS nh FROM a JOIN b ON a.eval_id = b.eval_id AND a.rate = b.rate GROUP BY 1, 2, 3),
        e AS (SELECT task, rep, row_number() OVER (ORDER BY task, rep) - 1 AS e FROM (SELECT DISTINCT task, rep FROM s)), n AS (SELECT count(*) AS n FROM e),
        w AS (SELECT r, ('0x' || substr(md5(r || ':' || k), 1, 8))::bigint % n AS e, count(*) AS w FROM range(2000) t(r), n, range((SELECT n FROM n)) u(k) GROUP BY ALL),
        p AS (SELECT r, rate, sum(w * (nh - bh))::double / sum(w * den) AS delta FROM w JOIN e USING (e) JOIN s USING (task, rep) GROUP BY 1, 2 HAVING sum(w * den) > 0),
        q AS (SELECT rate, delta, row_number() OVER (PARTITION BY rate ORDER BY delta) - 1 AS rk, count(*) OVER (PARTITION BY rate) AS m FROM p),
        c AS (SELECT rate, max(delta) FILTER (rk = floor(0.025::double * m)) AS lo, max(delta) FILTER (rk = floor(0.975::double * m) - 1) AS hi FROM q GROUP BY 1)
        SELECT rate, sum(den)::bigint AS n_steps, round(sum(bh)::double / sum(den), 6) AS base, round(sum(nh)::double / sum(den), 6) AS new, round((sum(nh) - sum(bh))::double / sum(den), 6) AS delta, round(max(lo), 6) AS ci95_low, round(max(hi), 6) AS ci95_high FROM s LEFT JOIN c USING (rate) GROUP BY rate HAVING sum(den) > 0""",
    "engine_check": r"""
        WITH a AS (SELECT trim(step_id) AS s, first(prompt ORDER BY eval_id) AS p FROM eval_steps WHERE step_id IS NOT NULL GROUP BY 1), b AS (SELECT trim(step_id) AS s, first(prompt ORDER BY state_id) AS q FROM train_states WHERE step_id IS NOT NULL GROUP BY 1),
        j AS (SELECT a.s AS x, b.s AS y, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p, regexp_replace(q, '^\s+|\s+$', '', 'g') AS q FROM a FULL OUTER JOIN b ON a.s = b.s),
        c AS (SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_common, count(*) FILTER (y IS NULL) AS only_in_first, count(*) FILTER (x IS NULL) AS only_in_second, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND p IS NOT DISTINCT FROM q) AS n_same FROM j)
        SELECT *, n_same::double / nullif(n_common, 0) >= 0.95 AS passes FROM c""",
    "pair_outcomes": f"SELECT source, outcome, count(*) AS n FROM ({_JUDGED}) GROUP BY 1, 2",
    "pair_report": f"""
        SELECT source, count(*) AS n, count(*) FILTER (outcome = 'pair') AS n_pairs, count(*) FILTER (rk = 'tool_call' AND pk = 'tool_call' AND outcome <> 'agree') AS call_disagreements,
            round(count(*) FILTER (outcome = 'equivalent')::double / nullif(count(*) FILTER (rk = 'tool_call' AND pk = 'tool_call' AND outcome <> 'agree'), 0), 4) AS equivalent_share, {", ".join(f"count(*) FILTER (outcome = 'pair' AND bucket = '{b}') AS pairs_{b}" for b in scoring.BUCKETS + scoring.OUTSIDE)} FROM ({_JUDGED}) GROUP BY 1""",
    "step_rewards": f"""
        WITH s AS (SELECT *, normalized_match OR {_SAME} AS effect FROM ({_scored()})), c AS (SELECT eval_id, u.c.name AS n, u.c.arguments AS t FROM (SELECT eval_id, unnest(coalesce(pc, [])) AS c FROM s) u), f AS (SELECT eval_id, bool_and(coalesce({_FITS}, false)) AS fit FROM ({_OBJECT.format("FROM c")}) GROUP BY 1)
        SELECT s.eval_id, round(CASE WHEN pk IS NULL THEN 0 WHEN rk = 'tool_call' AND pk = 'tool_call' THEN CASE WHEN hallucinated_tool THEN 0 ELSE 0.1::double + 0.1::double * coalesce(fit, true)::int + 0.2::double * (name_match OR (coalesce(fit, true) AND effect))::int + 0.6::double * (coalesce(fit, true) AND effect)::int END WHEN rk = 'reply' AND pk = 'reply' THEN 1 ELSE 0 END, 6) AS reward FROM s LEFT JOIN f ON s.eval_id = f.eval_id""",
    "argument_schemas": f"SELECT n AS name, count(*) FILTER (f) AS n_fit, count(*) FILTER (NOT f) AS n_unfit, count(*) AS n FROM (SELECT n, {_FITS} AS f FROM ({_OBJECT.format(f'SELECT c.name AS n, c.arguments AS t FROM (SELECT unnest({_CALLS}) AS c FROM ({_MESSAGES}))')})) GROUP BY 1",
    "teacher_reasoning": f"SELECT {_SOURCE} AS source, count(*) FILTER ({_REASONING.format('reference.text')}) AS n_reasoning, count(reference.text) AS n_text FROM train_states GROUP BY 1",
    "completions_parsed": f"SELECT kind, error, stray, count(*) AS n, sum(CASE WHEN error IS NULL THEN len(blocks) ELSE 0 END)::bigint AS n_calls FROM ({_PARSED.format('text')}) WHERE whole IS NOT NULL GROUP BY 1, 2, 3",
    "completion_kinds": r"""
        WITH b AS (SELECT string_split(text, '<|im_end|>')[1] AS b FROM documents WHERE text IS NOT NULL), n AS (SELECT b, len(regexp_extract_all(b, '(?s)<tool_call>(.*?)</tool_call>', 1)) AS k FROM b)
        SELECT CASE WHEN contains(b, '<tool_call>') THEN CASE WHEN k > 0 THEN 'blocks' ELSE 'unclosed' END WHEN regexp_replace(b, '[\s\x{00a0}\x{2000}-\x{200a}\x{3000}\x{0b}\x{85}\x{2028}\x{2029}\x{202f}]+', '', 'g') <> '' THEN 'reply' ELSE 'empty' END AS kind, count(*) AS n, sum(k)::bigint AS n_blocks FROM n GROUP BY 1""",
    "data_card_tools": f"""
        WITH u AS (SELECT unnest({_NAMES}) AS name FROM ({_MESSAGES}) WHERE m.role = 'assistant' AND pos > 0), k AS (SELECT name, count(*) AS n FROM u WHERE name IS NOT NULL GROUP BY 1), c AS (SELECT unnest({_CATALOG}) AS name)
        SELECT coalesce(c.name, k.name) AS name, coalesce(n, 0) AS n, c.name IS NOT NULL AS is_native FROM c FULL OUTER JOIN k ON c.name = k.name""",
    "data_card_counts": f"""
        WITH x AS (SELECT * FROM ({_MESSAGES}) WHERE reward = 1.0), d AS (SELECT len({_CALLS}) AS c, {_TEXT} AS t FROM x WHERE m.role = 'assistant' AND pos > 0), r AS (SELECT coalesce(lower(m.error) = 'true', false) AS e, length(coalesce(m.content, '')) AS n FROM x WHERE m.role = 'tool')
        SELECT 'n_decisions' AS measure, count(*) AS value FROM d UNION ALL SELECT 'n_calls', count(*) FILTER (c > 0) FROM d UNION ALL SELECT 'n_replies', count(*) FILTER (c = 0 AND t <> '') FROM d UNION ALL SELECT 'n_parallel', count(*) FILTER (c > 1) FROM d
        UNION ALL SELECT 'n_results', count(*) FROM r UNION ALL SELECT 'n_errors', count(*) FILTER (e) FROM r UNION ALL SELECT 'chars', sum(n)::bigint FROM r UNION ALL SELECT 'longest', max(n) FROM r""",
    "episodes_per_task": f"SELECT n_episodes, count(*) AS n_tasks FROM (SELECT {_TASK} AS task, count(*) AS n_episodes FROM episodes WHERE reward = 1.0 GROUP BY 1) WHERE task IS NOT NULL GROUP BY 1",
    "by_temperature": "SELECT temperature, count(*) AS n FROM episodes GROUP BY 1",
    "tasks_without_success": f"SELECT task FROM (SELECT DISTINCT {_TASK} AS task FROM tasks) WHERE task IS NOT NULL AND task NOT IN (SELECT t FROM (SELECT {_TASK} AS t FROM episodes WHERE reward = 1.0) WHERE t IS NOT NULL)",
    "name_stems": f"WITH n AS (SELECT p_partkey, p_name || '_' || p_type AS name FROM part) SELECT p_partkey, array_to_string(list_sort({_WORDS.format('name')}), ',') AS words, regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g')[:64] AS safe FROM n",
    "neighbor_topk": f"""
        WITH c AS (SELECT DISTINCT name FROM (SELECT unnest({_NAMES}) AS name FROM ({_MESSAGES})) WHERE name IS NOT NULL AND NOT list_contains({_NATIVE}, name)), w AS (SELECT name, {_WORDS.format("name")} AS words FROM c), n AS (SELECT list_distinct(flatten(list_transform({_NATIVE}, lambda a: {_WORDS.format("a")}))) AS own),
        s AS (SELECT name, 3.0::double * len(list_intersect(list_intersect(words, own), {catalogs.OBJECT_WORDS})) + len(list_intersect(list_intersect(words, own), {catalogs.VERB_WORDS})) + least(2.0::double, 0.5::double * len(list_intersect(list_intersect(words, own), {catalogs.OBJECT_WORDS}))) AS score FROM w, n)
        SELECT name, score, row_number() OVER (ORDER BY score DESC, name) AS rank FROM s ORDER BY score DESC, name LIMIT 24""",
}
