"""Conversations as positioned messages: decisions, prefixes, look-ahead, matching, turns, segments and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.text import strip

# Fixed formats of the serialized conversation.
IM_START, IM_END = "<|im_start|>", "<|im_end|>"
DEGENERATE_CHARS = 20_000
EPISODE = ["episode_id", "task_id", "rep"]


def messages(episodes: DataFrame) -> DataFrame:
    """(episode_id, task_id, rep, pos, role, content, tool_calls, error, raw_data, completion_tokens); null messages have no row, positions stay."""
    rows = episodes.select(*EPISODE, F.posexplode("messages").alias("pos", "m")).where("m is not null")
    return rows.select(*EPISODE, "pos", "m.role", "m.content", "m.tool_calls", "m.error", "m.raw_data", F.col("m.usage.completion_tokens").alias("completion_tokens"))


def calls(tool_calls: Column) -> Column:
    """The calls that aren't null; an empty array if there are none."""
    return F.filter(F.coalesce(tool_calls, F.array().cast("array<struct<id:string,name:string,arguments:string>>")), lambda c: c.isNotNull())


def call_names(tool_calls: Column) -> Column:
    return F.transform(calls(tool_calls), lambda c: c["name"])


def action_kind(tool_calls: Column, content: Column) -> Column:
    """Any call makes a tool_call; else text a reply; a turn with neither is null."""
    return F.when(F.size(calls(tool_calls)) > 0, "tool_call").when(strip(F.coalesce(content, F.lit(""))) != "", "reply")


def decisions(episodes: DataFrame) -> DataFrame:
    """Assistant messages after position 0, with kind, called names and what lies before: messages, calls, characters.

    The prefix is kept as counts and offsets, never as text for each decision, which would grow with the square
    of a conversation.
    """
    rows = messages(episodes)
    before = Window.partitionBy("episode_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    assistant = F.col("role") == "assistant"
    placed = rows.select(
        *EPISODE, "pos", "role", action_kind(F.col("tool_calls"), F.col("content")).alias("kind"), call_names(F.col("tool_calls")).alias("names"),
        F.count("*").over(before).alias("n_before"),
        zero(F.sum(F.when(assistant, F.size(calls(F.col("tool_calls"))))).over(before)).alias("calls_before"),
        zero(F.sum(F.length(F.coalesce("content", F.lit("")))).over(before)).alias("chars_before"),
    )
    return placed.where((F.col("role") == "assistant") & (F.col("pos") > 0)).drop("role")


def prior_calls(episodes: DataFrame) -> DataFrame:
    """(episode_id, pos, prior): all calls (name, arguments) before each decision, in order."""
    return _calls_around(episodes, Window.unboundedPreceding, -1, "prior")


def later_calls(episodes: DataFrame) -> DataFrame:
    """(episode_id, pos, later): all calls (name, arguments) the episode makes after each decision, in order."""
    return _calls_around(episodes, 1, Window.unboundedFollowing, "later")


def _calls_around(episodes: DataFrame, start: int, end: int, name: str) -> DataFrame:
    made = F.transform(calls(F.col("tool_calls")), lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")))
    rows = messages(episodes).where("role = 'assistant'").select("episode_id", "pos", made.alias("made"))
    frame = Window.partitionBy("episode_id").orderBy("pos").rowsBetween(start, end)
    return rows.select("episode_id", "pos", F.flatten(F.collect_list("made").over(frame)).alias(name)).where("pos > 0")


def call_key(call: Column) -> Column:
    """A call as one text: its name and its arguments, stripped and in lower case, for sets of calls."""
    return F.concat_ws("\t", call["name"], F.lower(strip(F.coalesce(call["arguments"], F.lit("")))))


def matched_results(episodes: DataFrame) -> DataFrame:
    """Tool results with the oldest waiting call: the k-th result answers the k-th call.

    (episode_id, ordinal, call_pos, call_name, result_pos, is_error, in_order): in_order is false if the result
    comes before its call, null if there is no such call.
    """
    rows = messages(episodes)
    made = rows.where("role = 'assistant'").select("episode_id", "pos", F.posexplode(calls(F.col("tool_calls"))).alias("j", "c"))
    made = made.select("episode_id", F.row_number().over(Window.partitionBy("episode_id").orderBy("pos", "j")).alias("ordinal"), F.col("pos").alias("call_pos"), F.col("c.name").alias("call_name"))
    results = rows.where("role = 'tool'").select("episode_id", F.row_number().over(Window.partitionBy("episode_id").orderBy("pos")).alias("ordinal"), F.col("pos").alias("result_pos"), (F.lower("error") == "true").alias("is_error"))
    joined = results.join(made, ["episode_id", "ordinal"], "left")
    return joined.select("episode_id", "ordinal", "call_pos", "call_name", "result_pos", F.coalesce("is_error", F.lit(False)).alias("is_error"), (F.col("call_pos") < F.col("result_pos")).alias("in_order"))


def degenerate(episodes: DataFrame, limit: int = DEGENERATE_CHARS) -> Column:
    """Whether any user turn is longer than the limit; null messages have no length."""
    runaway = F.exists("messages", lambda m: F.coalesce((m["role"] == "user") & (F.length(F.coalesce(m["content"], F.lit(""))) > limit), F.lit(False)))
    return F.coalesce(runaway, F.lit(False))


def hit_token_limit(raw_data: Column, completion_tokens: Column, limit: int) -> Column:
    stopped = F.contains(F.coalesce(raw_data, F.lit("")), F.lit("'finish_reason': 'length'"))
    return stopped | (F.coalesce(completion_tokens, F.lit(0)) >= limit)


def episode_stats(episodes: DataFrame, catalog: list[str], native: list[str]) -> DataFrame:
    """The diagnostics of each episode: turns, calls, calls of distractors and of unknown tools, runaway users."""
    student = F.filter(F.slice(F.coalesce("messages", F.array().cast(episodes.schema["messages"].dataType)), 2, 1 << 30), lambda m: m["role"] == "assistant")
    names = F.flatten(F.transform(student, lambda m: call_names(m["tool_calls"])))
    known, own = (F.array(*map(F.lit, x)) for x in (catalog, native))
    said = lambda key: F.size(F.filter(student, lambda m: F.coalesce(m["raw_data"], F.lit("")).rlike(rf"(?i)['\"]{key}['\"]: *(?:true|['\"][^'\"])")))
    return episodes.select(
        *EPISODE, F.size(student).alias("student_turns"), said("escalated").alias("escalated_turns"), F.size(names).alias("tool_calls"),
        said("parse_error").alias("parse_errors"), said("context_overflow").alias("context_overflows"),
        F.size(F.filter(names, lambda n: F.array_contains(known, n) & ~F.array_contains(own, n))).alias("distractor_calls"),
        F.size(F.filter(names, lambda n: n.isNotNull() & ~F.array_contains(known, n))).alias("hallucinated_calls"), degenerate(episodes).alias("degenerate_user_turn"),
    )


def merged_turns(episodes: DataFrame) -> DataFrame:
    """Runs of tool messages as one user turn, every other message a turn of its own.

    (episode_id, turn, first_pos, role, n_messages, text); a run is where position minus rank among tool messages
    stays the same.
    """
    rows = messages(episodes)
    by_role = Window.partitionBy("episode_id", "role").orderBy("pos")
    in_episode = Window.partitionBy("episode_id").orderBy("pos")
    content = F.coalesce("content", F.lit(""))
    rows = rows.withColumn("ordinal", F.row_number().over(in_episode)).withColumn("run", F.when(F.col("role") == "tool", F.col("ordinal") - F.row_number().over(by_role)).otherwise(-F.col("ordinal")))
    body = F.when(F.col("role") == "tool", F.concat(F.lit("<tool_response>\n"), content, F.lit("\n</tool_response>"))).otherwise(rendered(F.col("tool_calls"), content))
    grouped = rows.withColumn("body", body).groupBy("episode_id", "role", "run").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_messages"), F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("parts"))
    role = F.when(F.col("role") == "tool", "user").otherwise(F.col("role"))
    turn = F.row_number().over(Window.partitionBy("episode_id").orderBy("first_pos"))
    return grouped.select("episode_id", turn.alias("turn"), "first_pos", role.alias("role"), "n_messages", F.array_join(F.transform("parts", lambda p: p["body"]), "\n").alias("text"))


def rendered(tool_calls: Column, content: Column) -> Column:
    """A turn's content: its calls, each in a block with the stored arguments, or its stripped text."""
    block = lambda c: F.concat(F.lit('<tool_call>\n{"name": "'), F.coalesce(c["name"], F.lit("")), F.lit('", "arguments": '), F.coalesce(c["arguments"], F.lit("{}")), F.lit("}\n</tool_call>"))
    return F.when(F.size(calls(tool_calls)) > 0, F.array_join(F.transform(calls(tool_calls), block), "\n")).otherwise(strip(content))


ROLES = ["system", "user", "assistant", "tool"]


def turn_text(role: Column, text: Column) -> Column:
    """A turn with its marks; a role that no template knows is an error."""
    known = F.when(role.isin(*ROLES), role).otherwise(F.raise_error(F.concat(F.lit("no turn for role "), F.coalesce(role, F.lit("null")))).cast("string"))
    return F.concat(F.lit(IM_START), known, F.lit("\n"), text, F.lit(f"{IM_END}\n"))


def prompt_states(episodes: DataFrame, system: str) -> DataFrame:
    """(episode_id, pos, prompt): what the model sees before each decision: the system turn, all turns before, an open turn."""
    turns = merged_turns(episodes).select("episode_id", "role", "first_pos", turn_text(F.col("role"), F.col("text")).alias("text"))
    before = Window.partitionBy("episode_id").orderBy("first_pos").rowsBetween(Window.unboundedPreceding, -1)
    told = turns.select("episode_id", "role", F.col("first_pos").alias("pos"), F.array_join(F.collect_list("text").over(before), "").alias("told"))
    head = turn_text(F.lit("system"), F.lit(system))
    return told.where("role = 'assistant' and pos > 0").select("episode_id", "pos", F.concat(head, "told", F.lit(f"{IM_START}assistant\n")).alias("prompt"))


def histories(episodes: DataFrame) -> DataFrame:
    """(episode_id, history): messages as (role, content, tool_calls), calls as (name, arguments), null where a turn makes none."""
    short = lambda m: F.struct(
        m["role"].alias("role"), m["content"].alias("content"),
        F.when(F.size(calls(m["tool_calls"])) > 0, F.transform(calls(m["tool_calls"]), lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")))).alias("tool_calls"),
    )
    kept = F.filter("messages", lambda m: m.isNotNull())
    return episodes.select("episode_id", F.transform(kept, short).alias("history"))


def review_turn(role: Column, content: Column, tool_calls: Column, limit: int = 700) -> Column:
    """A message as a reviewer reads it: tool output cut, calls with their arguments, who said what."""
    said = F.coalesce(content, F.lit(""))
    shown = F.when(F.length(said) > limit, F.concat(F.substring(said, 1, limit), F.lit(" …"))).otherwise(said)
    call = lambda c: F.concat(F.lit("`"), F.coalesce(c["name"], F.lit("")), F.lit("("), F.coalesce(c["arguments"], F.lit("{}")), F.lit(")`"))
    who = F.when(role == "assistant", "agent").otherwise("customer")
    return (
        F.when(role == "tool", F.concat(F.lit("> **tool output:** `"), shown, F.lit("`")))
        .when(F.size(calls(tool_calls)) > 0, F.concat(F.lit("> **agent calls:** "), F.array_join(F.transform(calls(tool_calls), call), "; ")))
        .otherwise(F.concat(F.lit("> **"), who, F.lit(":** "), F.replace(said, F.lit("\n"), F.lit("\n> "))))
    )


def transcripts(episodes: DataFrame) -> DataFrame:
    """(episode_id, n_turns, chars, sha): the serialized conversation up to the next turn, as its hash and length."""
    turns = merged_turns(episodes).select("episode_id", F.struct("turn", turn_text(F.col("role"), F.col("text")).alias("text")).alias("t"))
    joined = turns.groupBy("episode_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    text = F.concat(F.array_join(F.transform("ts", lambda t: t["text"]), ""), F.lit(f"{IM_START}assistant\n"))
    return joined.select("episode_id", F.size("ts").alias("n_turns"), F.length(text).alias("chars"), F.sha2(text, 256).alias("sha"))


def segments(episodes: DataFrame) -> DataFrame:
    """The pieces of each serialized episode with their place and whether they are trained on.

    A decision's content takes the end mark with it and is trained; its header and the line end are not.
    (episode_id, turn, piece, train, start, end) with character offsets from the episode's beginning.
    """
    turns = merged_turns(episodes)
    decision = (F.col("role") == "assistant") & (F.col("first_pos") > 0)
    header = F.length(F.concat(F.lit(IM_START), F.col("role"), F.lit("\n")))
    pieces = F.when(decision, F.array(header, F.length("text") + len(IM_END), F.lit(1))).otherwise(F.array(header + F.length("text") + len(IM_END) + 1))
    rows = turns.select("episode_id", "turn", decision.alias("decision"), F.posexplode(pieces).alias("piece", "chars"))
    upto = F.sum("chars").over(Window.partitionBy("episode_id").orderBy("turn", "piece"))
    return rows.select("episode_id", "turn", "piece", (F.col("decision") & (F.col("piece") == 1)).alias("train"), (upto - F.col("chars")).alias("start"), upto.alias("end"))


def straddling(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens [start, end) that overlap a trained span of their episode without lying inside it."""
    trained = spans.where("train").select("episode_id", F.col("start").alias("s"), F.col("end").alias("e"))
    met = tokens.join(trained, "episode_id").where((F.col("start") < F.col("e")) & (F.col("end") > F.col("s")))
    return met.where((F.col("start") < F.col("s")) | (F.col("end") > F.col("e"))).select(tokens.columns)
